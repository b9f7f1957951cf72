"""Queries of frequencies, means, cross tables, banners and chart data, with their SQL."""

from __future__ import annotations

from tallyframe.operators.dataset import SurveyData
from tallyframe.operators.variables import Variable, VariableMap
from tallyframe.plans.common import one_row, renamed, rounded, survey, table

FLAGS = Variable("l_returnflag", "nominal", "Return flag", {"A": "Accepted", "N": "None", "R": "Returned"})
STATUS = Variable("l_linestatus", "nominal", "Line status", {"F": "Filled", "O": "Open"})
QUALITY = Variable("quality", "nominal", "Quality", {0: "Low", 1: "High"})
TOXIC = Variable("toxic", "nominal", "Toxic", {0: "No", 1: "Yes"})


def freq_returnflag(spark, d):
    return renamed(survey(spark, d, "lineitem", FLAGS).report.freq("l_returnflag").to_df(), "value", "label", "n", "percent", "cumulative")


def freq_by_frequency(spark, d):
    return renamed(survey(spark, d, "orders").report.freq("o_orderpriority", sort="freq").to_df(), "value", "label", "n", "percent", "cumulative")


def freq_labels(spark, d):
    return rounded(survey(spark, d, "lineitem", FLAGS).analysis.frequencies("l_returnflag", labels=True))


def freq_normalized(spark, d):
    return rounded(survey(spark, d, "documents").analysis.frequencies("source", normalize=True))


def freq_weighted_priority(spark, d):
    return rounded(survey(spark, d, "orders", weight="o_totalprice").analysis.frequencies("o_orderpriority", normalize=True, weighted=True))


def mean_weighted(spark, d):
    a = survey(spark, d, "lineitem", weight="l_quantity").analysis
    return one_row(spark, mean=a.mean("l_discount"), weighted=a.mean("l_discount", weighted=True), median=a.median("l_extendedprice"))


def grouped_mean(spark, d):
    return rounded(survey(spark, d, "lineitem", FLAGS, weight="l_quantity").analysis.grouped_mean("l_discount", "l_returnflag", weighted=True, labels=True))


def median_by_group(spark, d):
    return renamed(survey(spark, d, "part").report.means("p_retailprice", "p_brand").to_df(), "brand", "mean", "sd", "median", "n")


def crosstab_counts(spark, d):
    return survey(spark, d, "lineitem").analysis.crosstab("l_returnflag", "l_linestatus")


def crosstab_rowpct(spark, d):
    return rounded(survey(spark, d, "lineitem", FLAGS, STATUS).analysis.crosstab("l_returnflag", "l_linestatus", normalize="index", labels=True))


def crosstab_weighted(spark, d):
    return rounded(survey(spark, d, "lineitem", weight="l_quantity").analysis.crosstab("l_returnflag", "l_linestatus", normalize="columns", weighted=True))


def cross_table_percent(spark, d):
    return survey(spark, d, "lineitem", FLAGS, STATUS).report.crosstab("l_returnflag", "l_linestatus", pct="col").to_df().withColumnRenamed("Return flag", "flag")


def cross_cells(spark, d):
    """A cross table in long form, with all totals, whose columns are too many to head a table."""
    return survey(spark, d, "lineitem", FLAGS).report.crosstab("l_returnflag", "l_partkey", pct="row").cells()


#: Columns of the matrix: those of lineitem and remainders of its keys.
_ITEMS = {**{c: c for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")}, **{f"m{p}": f"l_partkey % {p}" for p in (2, 3, 5, 7, 11, 13, 17, 19)}, **{f"s{p}": f"l_suppkey % {p}" for p in (2, 3, 5, 7, 11, 13, 17, 19)}}


def spearman_matrix(spark, d):
    """Rank correlations of 20 columns from one pass over the rows."""
    rows = table(spark, d, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _ITEMS.items()])
    return rounded(SurveyData(rows, VariableMap([])).plot.heatmap(list(_ITEMS)).data)


def crosstab_chi2(spark, d):
    _, stats = survey(spark, d, "labels", QUALITY, TOXIC).analysis.crosstab("quality", "toxic", chi2=True, cramers_v=True, phi=True)
    return one_row(spark, chi2=stats["chi2"], dof=stats["dof"], cramers_v=stats["cramers_v"], phi=stats["phi"])


def crosstab_chi2_wide(spark, d):
    stats = survey(spark, d, "customer").analysis.chi2("c_mktsegment", "c_nationkey")
    return one_row(spark, chi2=stats["chi2"], dof=stats["dof"], cramers_v=stats["cramers_v"], n=stats["n"])


def banner_weighted(spark, d):
    data = survey(spark, d, "lineitem", FLAGS, STATUS, weight="l_quantity")
    return rounded(data.tables.banner(["l_returnflag", "l_linenumber"], ["l_linestatus"]))


def bar_counts(spark, d):
    return survey(spark, d, "customer").plot.bar("c_mktsegment").data


def box_data(spark, d):
    return rounded(survey(spark, d, "customer").plot.boxplot("c_acctbal", by="c_mktsegment").data)


def heatmap_means(spark, d):
    return rounded(survey(spark, d, "lineitem", FLAGS).plot.heatmap(["l_quantity", "l_discount"], by="l_returnflag").data)


def heatmap_spearman(spark, d):
    return rounded(survey(spark, d, "lineitem").plot.heatmap(["l_quantity", "l_extendedprice"]).data)


def scatter_trend(spark, d):
    t = survey(spark, d, "lineitem").plot.scatter("l_quantity", "l_extendedprice").trend
    return one_row(spark, places=4, slope=t["slope"], intercept=t["intercept"], n=t["n"])


_FREQ = """
WITH c AS (SELECT {v} AS v, count(*) AS n FROM {t} WHERE {v} IS NOT NULL GROUP BY 1),
p AS (SELECT *, round_even(n / sum(n) OVER () * 100, 1) AS p, {l} AS label FROM c),
r AS (SELECT *, round_even(sum(p) OVER (ORDER BY {o} ROWS UNBOUNDED PRECEDING), 1) AS cumulative FROM p)
SELECT v AS value, label, n::BIGINT AS n, p AS percent, cumulative FROM r
UNION ALL SELECT '', 'Total', sum(n)::BIGINT, 100.0, 100.0 FROM c
"""
_FLAG = "CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'N' THEN 'None' WHEN 'R' THEN 'Returned' END"
_STATUS = "CASE l_linestatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' END"
_CHI2 = """
WITH o AS (SELECT {r} AS r, {c} AS c, count(*)::DOUBLE AS n FROM {t} GROUP BY 1, 2),
a AS (SELECT r, sum(n) AS nr FROM o GROUP BY 1), b AS (SELECT c, sum(n) AS nc FROM o GROUP BY 1), s AS (SELECT sum(n) AS n FROM o),
e AS (SELECT coalesce(o.n, 0) AS obs, nr * nc / s.n AS exp FROM a CROSS JOIN b CROSS JOIN s LEFT JOIN o ON o.r = a.r AND o.c = b.c),
x AS (SELECT sum({term}) AS chi2 FROM e), k AS (SELECT (SELECT count(*) FROM a) AS nr, (SELECT count(*) FROM b) AS nc, (SELECT n FROM s) AS n)
"""
_RANKS = "SELECT *, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS {r} FROM "

QUERIES = {
    f.__name__: f
    for f in (
        freq_returnflag, freq_by_frequency, freq_labels, freq_normalized, freq_weighted_priority, mean_weighted, grouped_mean, median_by_group,
        crosstab_counts, crosstab_rowpct, crosstab_weighted, cross_table_percent, cross_cells, spearman_matrix, crosstab_chi2, crosstab_chi2_wide, banner_weighted, bar_counts,
        box_data, heatmap_means, heatmap_spearman, scatter_trend,
    )
}

_SPEARMAN = (
    "WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {e}) + (count(*) OVER (PARTITION BY {e}) - 1) / 2.0 AS {n}" for n, e in _ITEMS.items()) + " FROM lineitem) "
    + "SELECT unnest([" + ", ".join(f"'{a}'" for a in _ITEMS for _ in _ITEMS) + "]) AS variable, unnest([" + ", ".join(f"'{b}'" for _ in _ITEMS for b in _ITEMS)
    + "]) AS other, unnest([" + ", ".join(f"round(corr({a}, {b}), 6)" for a in _ITEMS for b in _ITEMS) + "]) AS value FROM r"
)
ORACLES = {
    "freq_returnflag": _FREQ.format(v="l_returnflag", t="lineitem", l=_FLAG.replace("l_returnflag", "v"), o="v"),
    "freq_by_frequency": _FREQ.format(v="o_orderpriority", t="orders", l="v", o="n DESC, v"),
    "freq_labels": f"SELECT l_returnflag AS value, {_FLAG} AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM lineitem GROUP BY 1",
    "freq_normalized": "SELECT source AS value, round(count(*) / sum(count(*)) OVER (), 6) AS n FROM documents GROUP BY 1",
    "freq_weighted_priority": "SELECT o_orderpriority AS value, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 6) AS n FROM orders GROUP BY 1",
    "mean_weighted": "SELECT round(avg(l_discount), 6) AS mean, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted, round(median(l_extendedprice), 6) AS median FROM lineitem",
    "grouped_mean": f'SELECT l_returnflag AS "group", round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean, round(sum(l_quantity), 6) AS n, {_FLAG} AS label FROM lineitem GROUP BY 1',
    "median_by_group": "SELECT p_brand AS brand, round_even(avg(p_retailprice), 3) AS mean, round_even(stddev_samp(p_retailprice), 3) AS sd, round_even(median(p_retailprice), 3) AS median, count(*) AS n FROM part GROUP BY 1",
    "crosstab_counts": "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1",
    "crosstab_rowpct": f"SELECT {_FLAG} AS l_returnflag, round(count(*) FILTER (l_linestatus = 'F') / count(*), 6) AS Filled, round(count(*) FILTER (l_linestatus = 'O') / count(*), 6) AS Open FROM lineitem GROUP BY 1",
    "crosstab_weighted": "WITH c AS (SELECT l_returnflag, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS f, coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS o FROM lineitem GROUP BY 1) SELECT l_returnflag, round(f / sum(f) OVER (), 6) AS F, round(o / sum(o) OVER (), 6) AS O FROM c",
    "cross_table_percent": f"""
WITH c AS (SELECT {_FLAG} AS flag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o, count(*) AS t FROM lineitem GROUP BY 1)
SELECT flag, round_even(f / sum(f) OVER () * 100, 1) AS Filled, round_even(o / sum(o) OVER () * 100, 1) AS Open, t::DOUBLE AS Total FROM c
UNION ALL SELECT 'Total', sum(f)::DOUBLE, sum(o)::DOUBLE, sum(t)::DOUBLE FROM c""",
    "cross_cells": """
SELECT l_returnflag AS row, l_partkey AS "column", count(*) AS n, CASE WHEN GROUPING(l_returnflag) = 0 THEN round_even(count(*) / sum(CASE WHEN GROUPING(l_returnflag) = 0 AND GROUPING(l_partkey) = 0 THEN count(*) END)
  OVER (PARTITION BY l_returnflag) * 100, 1) END AS percent, (2 * GROUPING(l_returnflag) + GROUPING(l_partkey))::INT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_partkey)""",
    "spearman_matrix": _SPEARMAN,
    "crosstab_chi2": _CHI2.format(r="quality", c="toxic", t="labels", term="pow(abs(obs - exp) - least(0.5, abs(obs - exp)), 2) / exp")
    + "SELECT round(chi2, 6) AS chi2, 1 AS dof, round(sqrt(chi2 / n), 6) AS cramers_v, round(sqrt(chi2 / n), 6) AS phi FROM x, k",
    "crosstab_chi2_wide": _CHI2.format(r="c_mktsegment", c="c_nationkey", t="customer", term="pow(obs - exp, 2) / exp")
    + "SELECT round(chi2, 6) AS chi2, ((nr - 1) * (nc - 1))::INT AS dof, round(sqrt(chi2 / (n * (least(nr, nc) - 1))), 6) AS cramers_v, n::INT AS n FROM x, k",
    "banner_weighted": f"""
WITH c AS (
  SELECT 'l_returnflag' AS row_variable, l_returnflag AS row_value, {_FLAG} AS row_label, l_linestatus AS v, {_STATUS} AS l, sum(l_quantity) AS n FROM lineitem GROUP BY ALL
  UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, l_linenumber::VARCHAR, l_linestatus, {_STATUS}, sum(l_quantity) FROM lineitem GROUP BY ALL)
SELECT row_variable, row_value, row_label, 'l_linestatus' AS column_variable, v AS column_value, l AS column_label, round(n, 6) AS n,
  round(n / sum(n) OVER (PARTITION BY row_variable, v), 6) AS share FROM c""",
    "bar_counts": "SELECT c_mktsegment AS value, c_mktsegment AS label, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1",
    "box_data": """
WITH q AS (SELECT c_mktsegment AS g, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS m, quantile_cont(c_acctbal, 0.75) AS q3, count(*) AS n FROM customer GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT g AS "group", round(min(c_acctbal) FILTER (c_acctbal >= lo), 6) AS lower, round(any_value(q1), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(q3), 6) AS q3,
  round(max(c_acctbal) FILTER (c_acctbal <= hi), 6) AS upper, count(*) FILTER (c_acctbal < lo OR c_acctbal > hi) AS outliers, any_value(n) AS n
FROM customer JOIN f ON c_mktsegment = g GROUP BY g""",
    "heatmap_means": f"""
SELECT 'l_quantity' AS variable, {_FLAG} AS "group", round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY ALL
UNION ALL SELECT 'l_discount', {_FLAG}, round(avg(l_discount), 6) FROM lineitem GROUP BY ALL""",
    "heatmap_spearman": "WITH r AS (" + _RANKS.format(x="l_quantity", r="a") + "(" + _RANKS.format(x="l_extendedprice", r="b") + """lineitem)),
c AS (SELECT round(corr(a, b), 6) AS v FROM r)
SELECT * FROM (VALUES ('l_quantity', 'l_quantity', 1.0::DOUBLE), ('l_extendedprice', 'l_extendedprice', 1.0)) AS t(variable, other, value)
UNION ALL SELECT 'l_quantity', 'l_extendedprice', v FROM c UNION ALL SELECT 'l_extendedprice', 'l_quantity', v FROM c""",
    "scatter_trend": "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, count(*)::INT AS n FROM lineitem",
}
