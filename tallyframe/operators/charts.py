"""Chart data: small tidy frames computed by Spark, drawn by whatever the caller likes (matplotlib where it is there)."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import label_of, quoted
from tallyframe.operators.ranks import kept, quantiles_of, rank_gram, released, value_counts

if TYPE_CHECKING:
    from tallyframe.operators.dataset import SurveyData


#: Rows that a drawing may have.
DRAWN_ROWS = 10_000


class Chart:
    """Chart data with a title; `data` is the tidy frame."""

    kind = "chart"

    def __init__(self, title: str, data: DataFrame):
        self.title, self.data = title, data

    def save(self, path: str, dpi: int = 150) -> str:
        try:
            import matplotlib
        except ImportError as e:
            raise RuntimeError("drawing needs matplotlib; use .data for the figures") from e
        matplotlib.use("Agg")
        from matplotlib import pyplot

        frame = self.data.limit(DRAWN_ROWS + 1).toPandas()
        if len(frame) > DRAWN_ROWS:
            raise ValueError(f"a drawing takes at most {DRAWN_ROWS} rows; group the data, or use .data for all of them")
        figure, axes = pyplot.subplots()
        self.draw(axes, frame)
        axes.set_title(self.title)
        figure.savefig(path, dpi=dpi)
        pyplot.close(figure)
        return path

    def draw(self, axes, frame) -> None:
        """One bar a row, named by its label."""
        name = "label" if "label" in frame.columns else frame.columns[0]
        axes.bar(frame[name].astype(str), frame[frame.columns[-1]])


class BoxChart(Chart):
    kind = "box"

    def draw(self, axes, frame) -> None:
        """A box from quartile to quartile, its median, and whiskers to the last values within reach."""
        boxes = [{"label": str(r.group), "whislo": r.lower, "q1": r.q1, "med": r.median, "q3": r.q3, "whishi": r.upper, "fliers": []} for r in frame.itertuples(index=False)]
        axes.bxp(boxes, showfliers=False)


class HeatChart(Chart):
    kind = "heat"

    def draw(self, axes, frame) -> None:
        """A cell a pair of names, with its value written in."""
        across, down = frame.columns[1], frame.columns[0]
        cells = frame.pivot_table(index=down, columns=across, values="value", sort=False)
        axes.imshow(cells.to_numpy(dtype=float), aspect="auto")
        axes.set_xticks(range(cells.shape[1]), [str(c) for c in cells.columns])
        axes.set_yticks(range(cells.shape[0]), [str(c) for c in cells.index])
        for i, row in enumerate(cells.to_numpy(dtype=float)):
            for j, value in enumerate(row):
                axes.text(j, i, f"{value:.2f}", ha="center", va="center")


class ScatterChart(Chart):
    kind = "scatter"

    def __init__(self, title, data, trend: dict | None):
        super().__init__(title, data)
        self.trend = trend

    def draw(self, axes, frame) -> None:
        x, y = frame[frame.columns[0]], frame[frame.columns[1]]
        for name, part in frame.groupby("hue", dropna=False) if "hue" in frame.columns else [(None, frame)]:
            axes.scatter(part[frame.columns[0]], part[frame.columns[1]], label=None if name is None else str(name))
        if self.trend and self.trend["slope"] is not None and len(x):
            ends = [x.min(), x.max()]
            axes.plot(ends, [self.trend["intercept"] + self.trend["slope"] * e for e in ends])
        axes.set_xlabel(x.name)
        axes.set_ylabel(y.name)


class PlotAccessor:
    def __init__(self, data: SurveyData):
        self.data = data

    def bar(self, column: str, by: str | None = None) -> Chart:
        """Counts by value, or the mean of the column in each group, in order of value."""
        d = self.data
        if by is None:
            d._need(column)
            rows = d.frame.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias("value")).agg(F.count("*").alias("n"))
            out = rows.orderBy("value").select("value", label_of(F.col("value"), d.labels_of(column)).alias("label"), "n")
            return Chart(d.label_of(column), out)
        out = d.analysis.grouped_mean(column, by).select(F.col("group").alias("value"), label_of(F.col("group"), d.labels_of(by)).alias("label"), "mean")
        return Chart(f"{d.label_of(column)} by {d.label_of(by)}", out)

    def boxplot(self, column: str, by: str | None = None) -> Chart:
        """Quartiles, whiskers (the last values within 1.5 quartile ranges) and the number of outliers of each group."""
        d = self.data
        group = F.lit("all") if by is None else quoted(by)
        rows = d.frame.select(group.alias("g"), d.analysis._number(column).alias("x")).dropna()
        counts = kept(value_counts(rows, "x", "g"))  # rows are read once; all else comes from the counts
        quartiles = quantiles_of(counts, "x", "g", (0.25, 0.5, 0.75))
        low, high = F.col("q")[0] - 1.5 * (F.col("q")[2] - F.col("q")[0]), F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0])
        out = (F.col("x") < low) | (F.col("x") > high)
        inside = counts.join(quartiles, "g").groupBy("g", "q").agg(
            F.sum("n").cast("long").alias("n"), F.min(F.when(F.col("x") >= low, F.col("x"))).alias("lower"), F.max(F.when(F.col("x") <= high, F.col("x"))).alias("upper"),
            F.sum(F.when(out, F.col("n")).otherwise(F.lit(0.0))).cast("long").alias("outliers"),
        )
        label = F.col("g").cast("string") if by is None else label_of(F.col("g"), d.labels_of(by))
        out = inside.orderBy("g").select(label.alias("group"), "lower", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "upper", "outliers", "n")
        return BoxChart(d.label_of(column), out)

    def heatmap(self, columns: list[str], by: str | None = None) -> Chart:
        """Group means (variable, group, value), or without `by` Spearman correlations (variable, other, value)."""
        d = self.data
        if by is not None:
            items = F.array(*[F.struct(F.lit(d.label_of(c)).alias("variable"), d.analysis._number(c).alias("x")) for c in columns])
            long = d.frame.select(quoted(by).alias("g"), F.inline(items)).dropna()
            means = long.groupBy("variable", "g").agg(F.avg("x").alias("value"))
            return HeatChart(f"Means by {d.label_of(by)}", means.orderBy("variable", "g").select("variable", label_of(F.col("g"), d.labels_of(by)).alias("group"), "value"))
        names = [f"c{i}" for i in range(len(columns))]
        with released():
            n, gram = rank_gram(d.frame.select([d.analysis._number(c).alias(n) for c, n in zip(columns, names, strict=True)]), names)
        spread = np.sqrt(np.diag(gram))
        rows = [(d.label_of(a), d.label_of(b), float(gram[i, j] / (spread[i] * spread[j])) if n and spread[i] > 0 and spread[j] > 0 else None) for i, a in enumerate(columns) for j, b in enumerate(columns)]
        return HeatChart("Spearman correlations", d.frame.sparkSession.createDataFrame(rows, "variable string, other string, value double"))

    def scatter(self, x: str, y: str, hue: str | None = None, points: int = 5_000, seed: int = 1) -> ScatterChart:
        """A random sample of points for drawing; the trend, without hue, is fitted to all rows."""
        d = self.data
        rows = d.frame.select(d.analysis._number(x).alias(x), d.analysis._number(y).alias(y), *([quoted(hue).alias("hue")] if hue else [])).dropna()
        trend = None
        if hue is None:
            got = rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n")).first()
            trend = got.asDict()
        n = rows.count()
        # the points of least hash: no part of the data is favoured, and a rerun draws the same ones, however rows are dealt;
        # the copies of a point are told apart by their number
        copies = F.explode(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(points)))).alias("_k")
        numbered = rows.groupBy(*rows.columns).agg(F.count("*").cast("int").alias("_n")).select(*[quoted(c) for c in rows.columns], copies)
        sample = rows if n <= points else numbered.orderBy(F.xxhash64(F.lit(seed), *numbered.columns), *numbered.columns).limit(points).drop("_k")
        return ScatterChart(f"{d.label_of(y)} against {d.label_of(x)}", sample, trend)
