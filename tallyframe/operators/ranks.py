"""Mid-ranks without a global sort in one task: values are first counted, and ranks follow from running counts.

Up to FEW distinct values (survey codes have a handful) are ranked by one window over the counts. More are dealt by
range; each range's total is added to those after it (a row a range and group), so no window ever spans all values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES, FEW = 64, 200_000
_kept: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept (memory and disk, recomputed where an executor is lost) until it is released."""
    _kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _kept[-1]


def release(since: int = 0) -> int:
    """Gives back what tables, charts and quantiles keep; what is asked of them afterwards is computed again."""
    found = _kept[since:]
    del _kept[since:]
    for df in found:
        df.unpersist()
    return len(found)


@contextmanager
def released() -> Iterator[None]:
    """What is kept within is released at the end."""
    since = len(_kept)
    try:
        yield
    finally:
        release(since)


def value_counts(rows: DataFrame, value: str, *by: str) -> DataFrame:
    return rows.groupBy(value, *by).agg(F.count("*").cast("double").alias("n"))


def edges_below(value: Column, edges: list, first: int = 0) -> Column:
    """Number of ordered edges below a value, by halves: a handful of comparisons a row, in generated code."""
    if not edges:
        return F.lit(first)
    middle = len(edges) // 2
    return F.when(value > F.lit(edges[middle]), edges_below(value, edges[middle + 1 :], first + middle + 1)).otherwise(edges_below(value, edges[:middle], first))


def running_counts(counts: DataFrame, value: str, *by: str) -> tuple[DataFrame, bool]:
    """counts(value, n, by...) with `before` and `upto`, the running sums of n in order of value within each group, and
    whether there are FEW rows. counts are kept (memory and disk, recomputed where an executor is lost)."""
    counts = kept(counts)
    if counts.limit(FEW + 1).count() <= FEW:
        upto = F.sum("n").over(Window.partitionBy(*by).orderBy(value))
        return counts.withColumns({"upto": upto, "before": upto - F.col("n")}), True
    edges = counts.agg(F.percentile_approx(value, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(1000)).alias("e")).first()["e"]
    dealt = counts.withColumn("part", edges_below(F.col(value), sorted(set(edges))))
    # a row a group and range: what stands before a range comes from the ranges' totals
    sums = dealt.groupBy(*by, "part").agg(F.sum("n").alias("t"))
    sums = sums.withColumn("start", F.sum("t").over(Window.partitionBy(*by).orderBy("part")) - F.col("t")).drop("t")
    upto = F.col("start") + F.sum("n").over(Window.partitionBy(*by, "part").orderBy(value))
    out = dealt.join(sums, [*by, "part"]).withColumn("upto", upto)
    return out.withColumn("before", F.col("upto") - F.col("n")).drop("start", "part"), False


def running_sums(rows: DataFrame, order: Sequence[Column], value: str, into: str) -> DataFrame:
    """rows with the sum of `value` over all rows up to each one in `order` (which leaves no ties).

    FEW rows are one window. More are dealt by range, and what stands before a range comes from the ranges' totals."""
    if rows.limit(FEW + 1).count() <= FEW:
        return rows.withColumn(into, F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    dealt = kept(rows.repartitionByRange(RANGES, *order).withColumn("_part", F.spark_partition_id()))  # ranges are chosen once
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_t"))  # RANGES rows
    sums = sums.withColumn("_start", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(sums), "_part").withColumn(into, F.col("_start") + within).drop("_part", "_start")


def mid_ranks_of(counts: DataFrame, value: str) -> DataFrame:
    """(value, n, midrank) of counts(value, n); few of them (FEW rows of 24 bytes) are marked for broadcasting."""
    running, few = running_counts(counts, value)
    ranks = running.select(value, "n", (F.col("before") + (F.col("n") + 1) / 2).alias("midrank"))
    return F.broadcast(ranks) if few else ranks


def mid_ranks(rows: DataFrame, value: str) -> DataFrame:
    """(value, n, midrank) of the non-null values of a numeric column."""
    return mid_ranks_of(value_counts(rows.filter(F.col(value).isNotNull()), value), value)


def quantiles(rows: DataFrame, value: str, by: str, shares: Sequence[float]) -> DataFrame:
    """(by, q): exact, interpolated quantiles of the non-null values in each group, q an array in order of shares.

    Selected by rank from running counts, so no task holds the values of a group.
    """
    return quantiles_of(value_counts(rows.filter(F.col(value).isNotNull()), value, by), value, by, shares)


def quantiles_of(counts: DataFrame, value: str, by: str, shares: Sequence[float]) -> DataFrame:
    """quantiles from counts(value, by, n)."""
    running, _ = running_counts(counts, value, by)
    totals = counts.groupBy(by).agg((F.sum("n") - 1).alias("last"))
    ranked = running.join(totals.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    ends = [x for p in shares for x in (at(F.floor(F.col("last") * p)), at(F.ceil(F.col("last") * p)))]
    found = ranked.groupBy(by, "last").agg(*[e.cast("double").alias(f"e{i}") for i, e in enumerate(ends)])

    def between(i: int, p: float) -> Column:
        place, low, high = F.col("last") * p, F.col(f"e{2 * i}"), F.col(f"e{2 * i + 1}")
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return found.select(by, F.array(*[between(i, p) for i, p in enumerate(shares)]).alias("q"))


def tie_term() -> Column:
    """Sum of n**3 - n over the distinct values."""
    return F.sum(F.pow("n", F.lit(3)) - F.col("n"))


def group_rank_sums(rows: DataFrame, value: str, group: str) -> tuple[DataFrame, float, float]:
    """(group, count, rank sum) as a DataFrame (g, n, r), number of rows, tie term, for numeric values in groups."""
    rows = rows.select(F.col(value).alias("v"), F.col(group).alias("g")).filter("v is not null and g is not null")
    joint = kept(value_counts(rows, "v", "g").withColumnRenamed("n", "m"))
    ranks = mid_ranks_of(joint.groupBy("v").agg(F.sum("m").alias("n")), "v")
    ties = ranks.agg(tie_term().alias("t"), F.sum("n").alias("n")).first()
    per = joint.join(ranks, "v").groupBy("g").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("midrank")).alias("r"))
    return per, float(ties["n"] or 0), float(ties["t"] or 0)


def rank_gram(rows: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    """Number of complete rows, and the sums of products of centred mid-ranks of every two columns.

    All columns are counted in one long table. Ranks of columns with few values (FEW together) are looked up in arrays that go
    to every task; a column of more values is replaced by its ranks in a join first. Then one pass over the rows adds up
    one matrix a task."""
    with _without_constraints(rows.sparkSession):
        return _rank_gram(rows, columns)


@contextmanager
def _without_constraints(spark: SparkSession) -> Iterator[None]:
    """The optimizer reasons on what holds for every column and alias; over one predicate on many columns that takes time
    exponential in their number, so it is left out."""
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _rank_gram(rows: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    wide = len(columns)
    packed = rows.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    whole = packed.filter(~F.exists("x", lambda v: v.isNull()))
    counts = kept(whole.select(F.posexplode("x").alias("c", "v")).groupBy("c", "v").agg(F.count("*").cast("double").alias("n")))
    sizes = {r["c"]: (r["k"], r["n"]) for r in counts.groupBy("c").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()}  # a row a column
    n, few = int(sizes[0][1]) if sizes else 0, []
    for c in sorted(sizes, key=lambda c: sizes[c][0]):
        if sum(sizes[f][0] for f in few) + sizes[c][0] <= FEW:
            few.append(c)
        else:
            ranks = mid_ranks_of(counts.filter(F.col("c") == c).select("v", "n"), "v").select("v", (F.col("midrank") - (n + 1) / 2).alias("r"))
            joined = whole.join(ranks, F.col("x")[c] == F.col("v"))
            whole = joined.select(F.concat(F.slice("x", 1, c), F.array("r"), F.slice("x", c + 2, wide)).alias("x"))
    looked_up: dict[int, tuple] = {c: ([], []) for c in few}
    for r in sorted(counts.filter(F.col("c").isin(few)).collect()):  # FEW rows at most
        looked_up[r["c"]][0].append(r["v"])
        looked_up[r["c"]][1].append(r["n"])
    tables = {c: (np.array(v), np.cumsum(t) - np.array(t) + (np.array(t) + 1) / 2 - (n + 1) / 2) for c, (v, t) in looked_up.items()}

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide, wide))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, wide).copy()
            for c, (values, ranks) in tables.items():
                x[:, c] = ranks[np.searchsorted(values, x[:, c])]
            total += np.einsum("ij,ik->jk", x, x)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["g"])

    tasks = whole.mapInArrow(products, "g array<double>")
    sums = tasks.select(F.posexplode("g").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()  # a row a pair of columns
    gram = np.zeros(wide * wide)
    gram[[r["at"] for r in sums]] = [r["x"] for r in sums]
    return n, gram.reshape(wide, wide)
