"""Banner tables: every row variable against every column variable, from one scan and one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions.columns import label_of, number, quoted

if TYPE_CHECKING:
    from tallyframe.operators.dataset import SurveyData

COLUMNS = ("row_variable", "row_value", "row_label", "column_variable", "column_value", "column_label", "n", "share")


class BannerTables:
    def __init__(self, data: SurveyData):
        self.data = data

    def banner(self, rows: Sequence[str], columns: Sequence[str], weight: str | None = None, labels: bool = True) -> DataFrame:
        """For each pair of variables and of their values: n (a count, or a sum of weights) and its share of the column
        value. Rows with a null in the pair are left out; a column of total 0 has share 0.0. Values are text."""
        if not rows or not columns:
            raise ValueError("a banner needs row and column variables")
        data, weight = self.data, weight or self.data.weight
        data._need(*rows, *columns, *([weight] if weight else []))
        w = number(quoted(weight), data.type_of(weight)) if weight else F.lit(1.0)

        def side(names: Sequence[str], kind: str):
            cells = []
            for c in names:
                label = label_of(quoted(c), data.labels_of(c)) if labels else quoted(c).cast("string")
                cells.append(F.struct(F.lit(c).alias(f"{kind}_variable"), quoted(c).cast("string").alias(f"{kind}_value"), label.alias(f"{kind}_label")))
            return F.array(*cells)

        long = data.frame.select(w.alias("w"), side(columns, "column").alias("c"), F.inline(side(rows, "row")))
        long = long.select("w", "row_variable", "row_value", "row_label", F.inline("c")).filter("row_value is not null and column_value is not null")
        counts = long.groupBy(*COLUMNS[:6]).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("n"))
        total = F.sum("n").over(Window.partitionBy("row_variable", "column_variable", "column_value"))
        return counts.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0))).select(*COLUMNS)


def export_banner(table: DataFrame, path: str, kind: str = "csv") -> str:
    """A banner as CSV files under path, or as one xlsx file (needs an Excel writer; tables are small)."""
    from tallyframe.sources.files import ExcelWriter, write_csv

    return write_csv(table, path) if kind == "csv" else ExcelWriter().write(table, path)
