"""Weighting and response hygiene."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import prod
from operator import mul

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions.columns import answered, mapped, quoted

#: Most cells of raking that go to the driver.
DRIVER_CELLS = 100_000


def _shares(targets: dict) -> dict:
    total = sum(targets.values())
    if total <= 0:
        raise ValueError("targets add up to nothing")
    return {k: v / total for k, v in targets.items()}


def cell_weights(df: DataFrame, column: str, targets: dict, into: str = "weight") -> DataFrame:
    """Post-stratification to the target shares of one variable; the mean weight is 1. Rows whose value is null or has
    no target get a null weight and do not count."""
    shares = _shares(targets)
    known = quoted(column).isin(list(shares))
    counts = df.filter(known).groupBy(quoted(column).alias("v")).agg(F.count("*").alias("n")).collect()  # a row a target
    total = sum(r["n"] for r in counts)
    there = sum(shares[r["v"]] for r in counts)
    return df.withColumn(into, mapped(quoted(column), {r["v"]: shares[r["v"]] / there * total / r["n"] for r in counts}).cast("double"))


def rake_weights(df: DataFrame, margins: dict[str, dict], into: str = "weight", rounds: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """Iterative proportional fitting to several margins; the mean weight is 1. Rows with a value that is null or has no target
    get a null weight and do not count.

    A weight is the product of one factor a margin value, so only these factors (as many as targets) are fitted. Rows are
    counted by cell once; up to DRIVER_CELLS cells are summed on the driver, more in Spark, a job a margin and round.
    """
    names = list(margins)
    shares = {m: _shares(t) for m, t in margins.items()}
    factor: dict[str, dict] = {m: {} for m in names}
    usable = df
    for m in names:
        usable = usable.filter(quoted(m).isin(list(shares[m])))
    cells = usable.groupBy([quoted(m).alias(f"_m{i}") for i, m in enumerate(names)]).agg(F.count("*").alias("_n")).persist(StorageLevel.MEMORY_AND_DISK)
    few = [(tuple(c[:-1]), c["_n"]) for c in cells.limit(DRIVER_CELLS + 1).collect()]

    def weight(columns: list[Column]) -> Column:
        known = [mapped(c, {v: factor[m].get(v, 1.0) for v in shares[m] if v is not None}).cast("double") for m, c in zip(names, columns, strict=True)]
        return reduce(mul, known, F.lit(1.0))

    def sums(i: int) -> dict:
        """Weight now on each value of margin i."""
        if len(few) > DRIVER_CELLS:
            weighted = F.sum(F.col("_n") * weight([F.col(f"_m{k}") for k in range(len(names))]))
            return dict(map(tuple, cells.groupBy(f"_m{i}").agg(weighted).collect()))  # at most a row a target
        now: dict = {}
        for key, n in few:
            now[key[i]] = now.get(key[i], 0.0) + n * prod(factor[m].get(v, 1.0) for m, v in zip(names, key, strict=True))
        return now

    total = cells.agg(F.sum("_n")).first()[0] if len(few) > DRIVER_CELLS else sum(n for _, n in few)
    for _ in range(rounds):
        moved = 0.0
        for i, m in enumerate(names):
            now = sums(i)
            there = sum(shares[m][v] for v in now)
            step = {v: shares[m][v] / there * total / x if x else 0.0 for v, x in now.items()}
            factor[m] = {v: factor[m].get(v, 1.0) * f for v, f in step.items()}
            moved = max([moved, *(abs(f - 1) for f in step.values())])
        if moved < tolerance:
            break
    cells.unpersist()
    return df.withColumn(into, weight([quoted(m) for m in names]))


def dedup_responses(df: DataFrame, respondent: str, time: str, tie: str | None = None) -> DataFrame:
    """The latest response of each respondent; rows without a respondent stay as they are."""
    order = [F.desc_nulls_last(quoted(time))] + ([F.desc(quoted(tie))] if tie else [])
    rank = F.row_number().over(Window.partitionBy(quoted(respondent)).orderBy(*order))
    named = df.filter(quoted(respondent).isNotNull()).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    return named.unionByName(df.filter(quoted(respondent).isNull()))


def completion_time(df: DataFrame, duration: str | None = None, started: str | None = None, submitted: str | None = None, into: str = "completion_seconds") -> DataFrame:
    """Seconds taken: the duration column where it is there, else the difference of two timestamps."""
    if duration in df.columns:
        return df.withColumn(into, quoted(duration).cast("double"))
    if started is None or submitted is None:
        raise ValueError("completion time needs a duration, or both timestamps")
    return df.withColumn(into, quoted(submitted).cast("timestamp").cast("double") - quoted(started).cast("timestamp").cast("double"))


def partial_flag(df: DataFrame, required: Sequence[str], into: str = "is_partial") -> DataFrame:
    """Whether any required answer is missing or blank."""
    blank = F.lit(False)
    for c in required:
        blank = blank | ~answered(quoted(c), df.schema[c].dataType)
    return df.withColumn(into, blank)


def insights(df: DataFrame, respondent: str, time: str, partial: str) -> DataFrame:
    """Total responses, respondents, partial responses and the last response's time, in one row."""
    return df.agg(F.count("*").alias("responses"), F.count_distinct(quoted(respondent)).alias("respondents"), F.count_if(quoted(partial)).alias("partials"), F.max(quoted(time)).alias("last_response"))


def responses_per_day(df: DataFrame, time: str) -> DataFrame:
    return df.groupBy(F.window(quoted(time), "1 day").start.cast("date").alias("day")).agg(F.count("*").alias("n"))


def browse(df: DataFrame, order: str, descending: bool = False, where=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a table."""
    rows = df if where is None else df.filter(where)
    return rows.orderBy(F.desc(quoted(order)) if descending else F.asc(quoted(order))).offset(offset).limit(limit)


def without_responses(df: DataFrame, ids: DataFrame, key: str = "_response_id") -> DataFrame:
    """df without the responses whose id is listed."""
    return df.join(ids.select(key), key, "left_anti")
