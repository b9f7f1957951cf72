"""Report tables: frequencies, cross tables and group means, with labels, totals and tests.

A table is built once, when first looked at. `to_df` is the Spark form; `to_frame`, markdown and HTML take the
finished table, which has a row a value, to the driver. Weights play no part in report tables.
"""

from __future__ import annotations

import html
from functools import cached_property
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import half_even, label_of, quoted
from tallyframe.operators import hypothesis
from tallyframe.operators.ranks import kept, quantiles, running_sums

if TYPE_CHECKING:
    from tallyframe.operators.dataset import SurveyData

#: Rows of a table that may be rendered, and columns that values may head.
MOST_ROWS, MOST_COLUMNS = 10_000, 1_000


def markdown_of(frame: pd.DataFrame) -> str:
    head = "| " + " | ".join(map(str, frame.columns)) + " |"
    rule = "|" + "|".join("---" for _ in frame.columns) + "|"
    cell = lambda x: "" if x is None or x != x else str(x)
    return "\n".join([head, rule, *("| " + " | ".join(map(cell, r)) + " |" for r in frame.itertuples(index=False))])


def html_of(frame: pd.DataFrame, caption: str | None = None) -> str:
    cell = lambda x, tag: f"<{tag}>{html.escape('' if x is None or x != x else str(x))}</{tag}>"
    head = "".join(cell(c, "th") for c in frame.columns)
    body = "".join("<tr>" + "".join(cell(x, "td") for x in r) + "</tr>" for r in frame.itertuples(index=False))
    title = f"<caption>{html.escape(caption)}</caption>" if caption else ""
    return f"<table>{title}<thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


class SurveyTable:
    """A table with a title and a line of statistics."""

    def __init__(self, data: SurveyData, title: str):
        self.data, self.title = data, title

    def to_df(self) -> DataFrame:
        raise NotImplementedError

    @cached_property
    def stats(self) -> dict:
        return {}

    @cached_property
    def _frame(self) -> pd.DataFrame:
        rows = self.to_df().limit(MOST_ROWS + 1).toPandas()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"the table has more than {MOST_ROWS} rows")
        return rows

    def to_frame(self) -> pd.DataFrame:
        return self._frame.copy()

    def stats_text(self) -> str:
        return ", ".join(f"{k}: {v:.4f}" if isinstance(v, float) else f"{k}: {v}" for k, v in self.stats.items())

    def to_markdown(self) -> str:
        foot = f"\n\n*{self.stats_text()}*" if self.stats else ""
        return f"**{self.title}**\n\n{markdown_of(self._frame)}{foot}"

    def to_html(self) -> str:
        foot = f"<p>{html.escape(self.stats_text())}</p>" if self.stats else ""
        return html_of(self._frame, self.title) + foot

    _repr_html_ = to_html

    def __repr__(self) -> str:
        return f"{self.title}\n{self._frame.to_string(index=False)}\n{self.stats_text()}"

    def export_xlsx(self, path: str) -> str:
        from tallyframe.sources.files import ExcelWriter

        return ExcelWriter().write(self._frame, path)


class FreqTable(SurveyTable):
    """Value, Label, n, %, Cumulative % and a total row. The running sum is of rounded percentages, rounded again; the total
    row always says 100.0."""

    def __init__(self, data: SurveyData, column: str, exclude_missing: bool = True, sort: str = "value"):
        data._need(column)
        if sort not in ("value", "freq", "label"):
            raise ValueError("sort is value, freq or label")
        super().__init__(data, data.label_of(column))
        self.column, self.exclude_missing, self.sort = column, exclude_missing, sort

    @cached_property
    def _counts(self) -> DataFrame:
        """v, n and whole: a row a value, and one (whole = 1) of all rows. One pass over the data, kept."""
        rows = self.data.frame.select(quoted(self.column).alias("v"))
        rows = rows.filter("v is not null") if self.exclude_missing else rows
        return kept(rows.rollup("v").agg(F.count("*").alias("n"), F.grouping_id().alias("whole")))

    @cached_property
    def _total(self) -> int:
        row = self._counts.filter("whole = 1").first()
        return row["n"] if row else 0

    def to_df(self) -> DataFrame:
        counts = self._counts.filter("whole = 0").drop("whole").withColumn("l", label_of(F.col("v"), self.data.labels_of(self.column)))
        order = {"value": [F.asc_nulls_last("v")], "freq": [F.desc("n"), F.asc_nulls_last("v")], "label": [F.asc("l"), F.asc_nulls_last("v")]}[self.sort]
        # tenths of a percent are summed as whole numbers, so the order of adding does not matter
        shares = counts.withColumn("p", half_even(F.col("n") / F.lit(float(max(self._total, 1))) * 100, 1)).withColumn("t", F.round(F.col("p") * 10).cast("long"))
        table = running_sums(shares, order, "t", "c")
        columns = lambda v, label, n, p, c, last: [F.lit(last).alias("last"), v.alias("v"), label.alias("l"), n.alias("n"), p.alias("p"), c.alias("c")]
        body = table.select(columns(F.col("v"), F.col("l"), F.col("n"), F.col("p"), F.col("c") / 10, 0))
        none = F.lit(None).cast(counts.schema["v"].dataType)
        total = self.data.frame.sparkSession.range(1).select(columns(none, F.lit("Total"), F.lit(self._total).cast("long"), F.lit(100.0), F.lit(100.0), 1))
        shown = F.when(F.col("last") == 1, F.lit("")).otherwise(F.col("v").cast("string")).alias("Value")
        ordered = body.unionByName(total).orderBy("last", *order)
        return ordered.select(shown, F.col("l").alias("Label"), "n", F.col("p").alias("%"), F.col("c").alias("Cumulative %"))

    @cached_property
    def stats(self) -> dict:
        return {"Variable": self.data.label_of(self.column), "N valid": self._total}


class CrossTable(SurveyTable):
    """Counts or percentages ('row', 'col', 'total') of complete rows; totals are counts in any case."""

    def __init__(self, data: SurveyData, row: str, col: str, pct: str = "none", test: bool = True):
        data._need(row, col)
        if pct not in ("none", "row", "col", "total"):
            raise ValueError("pct is none, row, col or total")
        super().__init__(data, f"{data.label_of(row)} × {data.label_of(col)}")
        self.row, self.col, self.pct, self.test = row, col, pct, test

    @cached_property
    def _sums(self) -> DataFrame:
        """r, c, n and level: cells (0), totals of rows (1) and of columns (2), and all (3). One pass over the data, whose cells
        are counted before they are added up; kept."""
        rows = self.data.frame.select(quoted(self.row).alias("r"), quoted(self.col).alias("c")).dropna()
        cells = rows.groupBy("r", "c").agg(F.count("*").alias("n"))
        return kept(cells.cube("r", "c").agg(F.sum("n").alias("n"), F.grouping_id().cast("int").alias("level")))

    def _level(self, level: int, n: str, *by: str) -> DataFrame:
        return self._sums.filter(F.col("level") == level).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("n").alias(n))

    def cells(self) -> DataFrame:
        """row, column, n and percent of every occupied cell, with `level` 0, and of the totals of rows (1), columns (2) and all
        (3), whose row or column is null. However many values there are; percentages are those of `pct`, null for none."""
        of = {"none": None, "row": (1, "r"), "col": (2, "c"), "total": (3,)}[self.pct]
        rows = self._sums
        if of is None:
            rows = rows.withColumn("of", F.lit(None).cast("long"))
        elif of == (3,):
            rows = rows.crossJoin(F.broadcast(self._level(3, "of")))  # one row
        else:
            rows = rows.join(self._level(of[0], "of", of[1]), F.col(of[1]) == F.col(f"_{of[1]}"), "left")
        return rows.select(F.col("r").alias("row"), F.col("c").alias("column"), "n", half_even(F.col("n") / F.col("of") * 100, 1).alias("percent"), "level")

    def to_df(self) -> DataFrame:
        """A column a value, in order, and a total row; `cells` has tables of more than MOST_COLUMNS values."""
        totals = {r["_c"]: r["n"] for r in self._level(2, "n", "c").limit(MOST_COLUMNS + 1).collect()}
        if len(totals) > MOST_COLUMNS:
            raise ValueError(f"{self.col} has more than {MOST_COLUMNS} values; it cannot head a table's columns, see cells()")
        values, whole = sorted(totals), sum(totals.values())
        labels = self.data.labels_of(self.col)
        names = [str(labels.get(v, v)) for v in values]
        cell = [F.coalesce(F.sum(F.when(F.col("c") == F.lit(v), F.col("n"))), F.lit(0)).alias(f"c{i}") for i, v in enumerate(values)]
        rows = self._sums.filter("level in (0, 1)").groupBy("r").agg(*cell, F.max(F.when(F.col("level") == 1, F.col("n"))).alias("t"))

        def shown(i: int, v) -> Column:
            n = F.col(f"c{i}")
            if self.pct == "none":
                return n.cast("double")
            return half_even(n / {"row": F.col("t"), "col": F.lit(float(totals[v])), "total": F.lit(float(whole))}[self.pct] * 100, 1)

        head = self.data.label_of(self.row) if self.data.labels_of(self.row) else self.row
        body = rows.select(
            F.lit(0).alias("last"), "r", label_of(F.col("r"), self.data.labels_of(self.row)).alias(head),
            *[shown(i, v).alias(n) for i, (v, n) in enumerate(zip(values, names, strict=True))], F.col("t").cast("double").alias("Total"),
        )
        sums = [F.lit(float(totals[v])).alias(n) for v, n in zip(values, names, strict=True)]
        last = self.data.frame.sparkSession.range(1).select(
            F.lit(1).alias("last"), F.lit(None).cast(rows.schema["r"].dataType).alias("r"), F.lit("Total").alias(head), *sums, F.lit(float(whole)).alias("Total")
        )
        return body.unionByName(last).orderBy("last", "r").drop("last", "r")

    @cached_property
    def stats(self) -> dict:
        if not self.test:
            return {}
        t = self.data.analysis.independence(self.row, self.col, nulls=False)
        if min(t["shape"]) < 2:
            return {}
        return {"χ²": round(t["chi2"], 3), "df": t["dof"], "p": round(t["p_value"], 4), "Cramér's V": round(hypothesis.cramers_v(t), 3), "N": t["n"]}


class GroupMeanTable(SurveyTable):
    """Mean, SD, median and n of each group, with a test that fits the scale and the number of groups."""

    def __init__(self, data: SurveyData, column: str, by: str, test: bool = True):
        data._need(column, by)
        super().__init__(data, f"{data.label_of(column)} by {data.label_of(by)}")
        self.column, self.by, self.test = column, by, test

    def to_df(self) -> DataFrame:
        x = self.data.analysis._number(self.column)
        rows = self.data.frame.select(quoted(self.by).alias("g"), x.alias("x")).dropna()
        stats = rows.groupBy("g").agg(half_even(F.avg("x"), 3).alias("Mean"), half_even(F.stddev_samp("x"), 3).alias("SD"), F.count("*").alias("n"))
        stats = stats.join(quantiles(rows, "x", "g", (0.5,)).select("g", half_even(F.col("q")[0], 3).alias("Median")), "g")
        return stats.orderBy("g").select(label_of(F.col("g"), self.data.labels_of(self.by)).alias(self.data.label_of(self.by)), "Mean", "SD", "Median", "n")

    @cached_property
    def stats(self) -> dict:
        if not self.test:
            return {}
        analysis, ranked = self.data.analysis, self.data.scale_of(self.column) in (None, "ordinal")
        groups = len(analysis.some_moments(self.column, self.by, 3))
        if groups < 2:
            return {"note": "fewer than two groups, no test"}
        name, test = {
            (True, True): ("Mann-Whitney U", analysis.mannwhitney), (True, False): ("Kruskal-Wallis H", analysis.kruskal),
            (False, True): ("t-test", analysis.ttest), (False, False): ("ANOVA F", analysis.anova),
        }[ranked, groups == 2]
        got = test(self.column, self.by)
        return {"Test": name, "statistic": round(got["statistic"], 3), "p": round(got["p_value"], 4)}


class ReportAccessor:
    def __init__(self, data: SurveyData):
        self.data = data

    def freq(self, column: str, exclude_missing: bool = True, sort: str = "value") -> FreqTable:
        return FreqTable(self.data, column, exclude_missing, sort)

    def crosstab(self, row: str, col: str, pct: str = "none", test: bool = True) -> CrossTable:
        return CrossTable(self.data, row, col, pct, test)

    def means(self, column: str, by: str, test: bool = True) -> GroupMeanTable:
        return GroupMeanTable(self.data, column, by, test)
