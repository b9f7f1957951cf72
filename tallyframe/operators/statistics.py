"""Descriptive statistics and tests of a survey dataset.

Tables come back as lazy DataFrames; scalars and test results are small aggregates finished on the driver.
The operators differ in how they treat nulls and weights on purpose; each says how.
"""

from __future__ import annotations

import math
from typing import TYPE_CHECKING, Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import label_of, number, quoted
from tallyframe.functions.distributions import normal_quantile
from tallyframe.operators import hypothesis
from tallyframe.operators.ranks import group_rank_sums, kept, mid_ranks_of, quantiles, released

if TYPE_CHECKING:
    from tallyframe.operators.dataset import SurveyData

#: Most distinct column values of a cross table, which becomes that many columns.
MOST_COLUMNS = 1_000
#: Most cells of a chi-square test that go to the driver.
DRIVER_CELLS = 100_000


class DataAnalysis:
    def __init__(self, data: SurveyData):
        self.data = data

    def _number(self, column: str) -> Column:
        self.data._need(column)
        return number(quoted(column), self.data.type_of(column))

    def _weight(self, weighted: bool) -> Column | None:
        if not weighted:
            return None
        if not self.data.weight:
            raise ValueError("weighted statistics need a weight; see with_weight")
        return number(quoted(self.data.weight), self.data.type_of(self.data.weight))

    def mean(self, column: str, weighted: bool = False) -> float:
        """Mean of the values that are there; 0.0 for none, or for weights that add up to 0 or less."""
        x, w = self._number(column), self._weight(weighted)
        got = self.data.frame.select(x.alias("x"), (F.lit(1.0) if w is None else w).alias("w")).filter("x is not null").agg(F.sum(F.col("x") * F.col("w")).alias("a"), F.sum("w").alias("b")).first()
        return got["a"] / got["b"] if got["b"] and got["b"] > 0 and got["a"] is not None else 0.0

    def median(self, column: str) -> float:
        """Exact, interpolated; 0.0 for no values."""
        rows = self.data.frame.select(self._number(column).alias("x"), F.lit(0).alias("all"))
        with released():
            got = quantiles(rows, "x", "all", (0.5,)).first()
        return 0.0 if got is None else float(got["q"][0])

    def grouped_mean(self, column: str, by: str, weighted: bool = False, labels: bool = False) -> DataFrame:
        """group, mean, n[, label] in order of group; rows null in either are dropped; n is the count or the sum of weights."""
        self.data._need(column, by)
        w = self._weight(weighted)
        rows = self.data.frame.select(quoted(by).alias("group"), self._number(column).alias("x"), (F.lit(1.0) if w is None else w).alias("w")).dropna(subset=["group", "x"])
        share = F.when(F.sum("w") > 0, F.sum(F.col("x") * F.col("w")) / F.sum("w")).otherwise(F.lit(0.0))
        out = rows.groupBy("group").agg(share.alias("mean"), F.sum("w").alias("n"))
        if labels:
            out = out.withColumn("label", label_of(F.col("group"), self.data.labels_of(by), "null"))
        return out.orderBy("group")

    def frequencies(self, column: str, normalize: bool = False, weighted: bool = False, labels: bool = False) -> DataFrame:
        """value, n[, percent | label, percent]: null is a value. Ordered by n, the largest first; weighted, by value."""
        self.data._need(column)
        w = self._weight(weighted)
        out = self.data.frame.groupBy(quoted(column).alias("value")).agg((F.count("*") if w is None else F.coalesce(F.sum(w), F.lit(0.0))).alias("n"))
        if labels or normalize:
            # one number to the driver, so that no window gathers all values in a task
            total = out.agg(F.sum("n")).first()[0] or 0
            share = F.col("n") / F.lit(float(total)) if total > 0 else F.lit(0.0)
            if labels:
                out = out.select("value", label_of(F.col("value"), self.data.labels_of(column), "null").alias("label"), "n", (share * 100).alias("percent"))
            else:
                out = out.withColumn("n", share)
        return out.orderBy("value") if weighted else out.orderBy(F.desc("n"), F.asc_nulls_last("value"))

    def _pivot_values(self, column: str, nulls: bool) -> list:
        found = self.data.frame.select(quoted(column).alias("c")).distinct().limit(MOST_COLUMNS + 1).collect()
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"{column} has more than {MOST_COLUMNS} values; it cannot head a table's columns")
        values = sorted((r["c"] for r in found if r["c"] is not None), key=lambda x: (str(type(x)), x))
        return values + [None] * (nulls and any(r["c"] is None for r in found))

    def crosstab(self, row: str, col: str, normalize: str | bool = False, chi2: bool = False, cramers_v: bool = False, phi: bool = False, weighted: bool = False, labels: bool = False):
        """A column a value of col, a row a value of row.

        Unweighted, null is a category of both (its column is named `null`); weighted, rows with a null are
        dropped. Empty cells are 0. normalize: 'index', 'columns', 'all' or True; zero totals give 0.0. With a
        test asked for, returns (table, statistics); tests use unweighted counts with nulls as categories.
        """
        if normalize not in (False, True, "index", "columns", "all"):
            raise ValueError("normalize is 'index', 'columns', 'all', True or False")
        self.data._need(row, col)
        w = self._weight(weighted)
        rows = self.data.frame.select(quoted(row).alias("r"), quoted(col).alias("c"), (F.lit(1).cast("long") if w is None else w).alias("w"))
        if weighted:
            rows = rows.dropna(subset=["r", "c"])
        values = self._pivot_values(col, nulls=not weighted)
        names = self._column_names(col, values, labels)
        cell = lambda v: F.coalesce(F.sum(F.when(F.col("c").eqNullSafe(F.lit(v)), F.col("w"))), F.lit(0))
        table = rows.groupBy("r").agg(*[cell(v).alias(n) for v, n in zip(values, names, strict=True)])
        if normalize:
            table = self._normalized(table, names, "all" if normalize is True else normalize)
        head = label_of(F.col("r"), self.data.labels_of(row)) if labels else F.col("r")
        table = table.orderBy(F.asc_nulls_last("r")).select(head.alias(row), *[F.col(f"`{n}`") for n in names])
        if not (chi2 or cramers_v or phi):
            return table
        return table, self._tests(row, col, chi2, cramers_v, phi)

    def _column_names(self, col: str, values: list, labels: bool) -> list[str]:
        known = self.data.labels_of(col) if labels else {}
        return ["null" if v is None else str(known.get(v, v)) for v in values]

    @staticmethod
    def _normalized(table: DataFrame, names: list[str], how: str) -> DataFrame:
        """Shares of row totals, or of column or grand totals, which are a number a column on the driver."""
        cells = [F.col(f"`{n}`") for n in names]
        if how == "index":
            across = sum(cells[1:], cells[0]) if cells else F.lit(0)
            totals = [across] * len(cells)
        else:
            got = table.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double") for c in cells]).first() if cells else ()
            totals = [F.lit(sum(got) if how == "all" else x) for x in got]
        return table.select("r", *[F.when(t > 0, c / t).otherwise(F.lit(0.0)).alias(n) for n, c, t in zip(names, cells, totals, strict=True)])

    def _cell_counts(self, row: str, col: str, nulls: bool) -> DataFrame:
        counts = self.data.frame.groupBy(quoted(row).alias("r"), quoted(col).alias("c")).agg(F.count("*").alias("n"))
        return counts if nulls else counts.dropna(subset=["r", "c"])

    def independence(self, row: str, col: str, nulls: bool = True) -> dict:
        """Chi-square test of two variables (see hypothesis.chi_square). Up to DRIVER_CELLS occupied cells are finished on the
        driver; beyond that the sums are taken in Spark, where an empty cell adds its expected count and no row."""
        counts = self._cell_counts(row, col, nulls).persist(StorageLevel.MEMORY_AND_DISK)
        got = counts.limit(DRIVER_CELLS + 1).collect()
        if len(got) <= DRIVER_CELLS:
            counts.unpersist()
            return hypothesis.chi_square({(r["r"], r["c"]): r["n"] for r in got})
        side = lambda name: counts.groupBy(F.col(name).alias(f"_{name}")).agg(F.sum("n").cast("double").alias(f"of_{name}"))
        of_row, of_column = side("r"), side("c")
        total, rows, columns = counts.agg(F.sum("n")).first()[0], of_row.count(), of_column.count()
        met = counts.join(of_row, F.col("r").eqNullSafe(F.col("_r"))).join(of_column, F.col("c").eqNullSafe(F.col("_c")))
        expected = F.col("of_r") * F.col("of_c") / float(total)
        sums = met.select("n", expected.alias("e")).agg(F.sum(F.pow(F.col("n") - F.col("e"), F.lit(2)) / F.col("e")).alias("x"), F.sum("e").alias("e")).first()
        counts.unpersist()
        return hypothesis.independence_test(sums["x"] + max(0.0, total - sums["e"]), total, rows, columns)

    def _tests(self, row: str, col: str, chi2: bool, cramers_v: bool, phi: bool) -> dict[str, Any]:
        test = self.independence(row, col)
        out: dict[str, Any] = {}
        if chi2:
            out |= {"chi2": test["chi2"], "p_value": test["p_value"], "dof": test["dof"]}
        if cramers_v:
            out["cramers_v"] = hypothesis.cramers_v(test)
        if phi:
            out["phi"] = hypothesis.phi(test)
        return out

    def chi2(self, row: str, col: str) -> dict:
        test = self.independence(row, col, nulls=False)
        return {"chi2": test["chi2"], "dof": test["dof"], "p": test["p_value"], "cramers_v": hypothesis.cramers_v(test), "n": test["n"]}

    def proportion_ci(self, column: str, value: Any, confidence: float = 0.95, weighted: bool = False) -> dict:
        """Wald interval of the share of a value, cut to [0, 1]. Unweighted over rows that are not null; weighted over all
        rows (null is another value), with Kish's effective sample size as n."""
        if not 0 < confidence < 1:
            raise ValueError("confidence lies between 0 and 1")
        self.data._need(column)
        hit = F.coalesce((quoted(column) == F.lit(value)).cast("double"), F.lit(0.0))
        if weighted:
            w = self._weight(True)
            got = self.data.frame.select(hit.alias("h"), w.alias("w")).agg(F.sum(F.col("h") * F.col("w")).alias("h"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("ww")).first()
            p = got["h"] / got["w"] if got["w"] and got["w"] > 0 else 0.0
            n = got["w"] ** 2 / got["ww"] if got["ww"] and got["ww"] > 0 else 0.0
        else:
            got = self.data.frame.agg(F.sum(F.when(quoted(column).isNotNull(), hit)).alias("h"), F.count(quoted(column)).alias("n")).first()
            n = got["n"]
            p = got["h"] / n if n else 0.0
        if n <= 0:
            return {"p": 0.0, "lower": 0.0, "upper": 0.0, "n": 0}
        half = normal_quantile(0.5 + confidence / 2) * math.sqrt(p * (1 - p) / n)
        return {"p": p, "lower": max(0.0, p - half), "upper": min(1.0, p + half), "n": n}

    def effective_sample_size(self) -> float:
        """Kish's (sum of weights)**2 / sum of squared weights; 0.0 if not positive."""
        w = self._weight(True)
        got = self.data.frame.agg(F.sum(w).alias("a"), F.sum(w * w).alias("b")).first()
        return got["a"] ** 2 / got["b"] if got["a"] and got["a"] > 0 and got["b"] > 0 else 0.0

    def _rank_groups(self, column: str, group: str):
        self.data._need(column, group)
        rows = self.data.frame.select(self._number(column).alias("v"), quoted(group).alias("g"))
        return group_rank_sums(rows, "v", "g")

    def kruskal(self, column: str, group: str) -> dict:
        with released():
            return self._kruskal(column, group)

    def _kruskal(self, column: str, group: str) -> dict:
        groups, n, ties = self._rank_groups(column, group)
        sums = groups.agg(F.count("*").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("rr")).first()
        if sums["k"] < 2:
            raise ValueError("Kruskal-Wallis needs two groups or more")
        h, p = hypothesis.kruskal_wallis(sums["rr"], sums["k"], n, ties)
        return {"statistic": h, "p_value": p, "groups": sums["k"]}

    def mannwhitney(self, column: str, group: str) -> dict:
        with released():
            groups, n, ties = self._rank_groups(column, group)
            groups = sorted(map(tuple, groups.limit(3).collect()))
        if len(groups) != 2:
            raise ValueError("Mann-Whitney needs exactly two groups")
        u, p = hypothesis.mann_whitney(groups, n, ties)
        return {"statistic": u, "p_value": p, "group_a": groups[0][0], "group_b": groups[1][0]}

    def spearman(self, x: str, y: str) -> dict:
        """Correlation of mid-ranks over complete rows; joint counts, not rows, are joined with ranks."""
        with released():
            return self._spearman(x, y)

    def _spearman(self, x: str, y: str) -> dict:
        rows = self.data.frame.select(self._number(x).alias("x"), self._number(y).alias("y")).dropna()
        joint = kept(rows.groupBy("x", "y").agg(F.count("*").cast("double").alias("m")))
        rx, ry = (mid_ranks_of(joint.groupBy(c).agg(F.sum("m").alias("n")), c).select(c, F.col("midrank").alias(f"r{c}")) for c in ("x", "y"))
        m = lambda e: F.sum(F.col("m") * e)
        a, b = F.col("rx"), F.col("ry")
        got = joint.join(rx, "x").join(ry, "y").agg(F.sum("m").alias("n"), m(a).alias("a"), m(b).alias("b"), m(a * a).alias("aa"), m(b * b).alias("bb"), m(a * b).alias("ab")).first()
        n = int(got["n"] or 0)
        if n == 0:
            return {"rho": 0.0, "p_value": 1.0, "n": 0}
        va, vb = got["aa"] - got["a"] ** 2 / n, got["bb"] - got["b"] ** 2 / n
        rho = (got["ab"] - got["a"] * got["b"] / n) / math.sqrt(va * vb) if va > 0 and vb > 0 else float("nan")
        return {"rho": rho, "p_value": hypothesis.spearman_p(rho, n) if rho == rho else float("nan"), "n": n}

    def _moments(self, column: str, by: str) -> DataFrame:
        """g, n, m, v: count, mean and sample variance of each group."""
        rows = self.data.frame.select(quoted(by).alias("g"), self._number(column).alias("x")).dropna()
        return rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))

    def some_moments(self, column: str, by: str, most: int) -> list[tuple]:
        """(group, count, mean, sample variance) in order of group; of more than `most` groups, any `most`."""
        return sorted(map(tuple, self._moments(column, by).limit(most).collect()), key=lambda r: r[0])

    def ttest(self, column: str, group: str) -> dict:
        moments = self.some_moments(column, group, 3)
        if len(moments) != 2:
            raise ValueError("a t-test needs exactly two groups")
        t, p = hypothesis.pooled_t(moments[0][1:], moments[1][1:])
        return {"statistic": t, "p_value": p, "group_a": moments[0][0], "group_b": moments[1][0]}

    def anova(self, column: str, group: str) -> dict:
        """Sums over the groups are taken in Spark, whatever their number."""
        with released():
            return self._anova(kept(self._moments(column, group)))

    @staticmethod
    def _anova(per: DataFrame) -> dict:
        whole = per.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("x"), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("within")).first()
        if whole["k"] < 2:
            raise ValueError("an analysis of variance needs two groups or more")
        between = per.agg(F.sum(F.col("n") * F.pow(F.col("m") - whole["x"] / whole["n"], F.lit(2)))).first()[0]
        f, p = hypothesis.one_way_anova(between, whole["within"], whole["n"], whole["k"])
        return {"statistic": f, "p_value": p, "groups": whole["k"]}
