import math
import random

import pytest

from tallyframe.functions.distributions import chi2_tail
from tallyframe.operators import hypothesis, ranks, statistics, weights
from tallyframe.operators.dataset import SurveyData
from tallyframe.operators.variables import Variable, VariableMap
from tallyframe.operators.weights import cell_weights, dedup_responses, partial_flag, rake_weights

ROWS = [(1, 1, 1.0), (1, 2, 2.0), (2, None, 3.0), (None, 1, 4.0), (2, 2, 5.0)]


@pytest.fixture(scope="module")
def small(spark):
    labels = VariableMap([Variable("a", "nominal", "A", {1: "one", 2: "two"}), Variable("b", "nominal", "B", {1: "eins"})])
    return SurveyData(spark.createDataFrame(ROWS, "a long, b long, w double"), labels, weight="w")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_crosstab_nulls(small):
    table = small.analysis.crosstab("a", "b")
    assert table.columns == ["a", "1", "2", "null"] and rows(table) == [(1, 1, 1, 0), (2, 0, 1, 1), (None, 1, 0, 0)]
    assert rows(small.analysis.crosstab("a", "b", weighted=True)) == [(1, 1.0, 2.0), (2, 0.0, 5.0)]
    assert rows(small.analysis.crosstab("a", "b", weighted=True, normalize="index", labels=True))[0] == ("one", pytest.approx(1 / 3), pytest.approx(2 / 3))
    with pytest.raises(ValueError):
        small.analysis.crosstab("a", "b", normalize="rows")


def test_means_and_frequencies(small):
    a = small.analysis
    assert a.mean("b") == 1.5 and a.mean("b", weighted=True) == pytest.approx((1 + 4 + 4 + 10) / 12)
    assert a.median("w") == 3.0
    assert rows(a.grouped_mean("w", "a", labels=True)) == [(1, 1.5, 2.0, "one"), (2, 4.0, 2.0, "two")]
    assert rows(a.frequencies("a")) == [(1, 2), (2, 2), (None, 1)]
    assert rows(a.frequencies("a", weighted=True, labels=True))[0] == (None, None, 4.0, pytest.approx(400 / 15))
    assert a.effective_sample_size() == pytest.approx(225 / 55)
    unweighted = SurveyData(small.frame)
    with pytest.raises(ValueError):
        unweighted.analysis.mean("w", weighted=True)
    nothing = SurveyData(small.frame.limit(0), weight="w").analysis
    assert (nothing.mean("w"), nothing.median("w"), nothing.effective_sample_size()) == (0.0, 0.0, 0.0)
    assert nothing.proportion_ci("a", 1) == {"p": 0.0, "lower": 0.0, "upper": 0.0, "n": 0}


def test_proportion_ci(small):
    got = small.analysis.proportion_ci("b", 1)
    assert (got["p"], got["n"]) == (0.5, 4) and got["upper"] == pytest.approx(0.5 + 1.959964 * 0.25, abs=1e-6) or got["upper"] == 1.0
    assert small.analysis.proportion_ci("b", 1, weighted=True)["p"] == pytest.approx(5 / 15)
    with pytest.raises(ValueError):
        small.analysis.proportion_ci("b", 1, confidence=1)


def test_chi_square_of_a_published_table():
    cells = {(0, 0): 49, (0, 1): 9, (1, 0): 299, (1, 1): 42}
    got = hypothesis.chi_square(cells)
    assert got["dof"] == 1 and got["chi2"] == pytest.approx(0.215, abs=0.01)
    plain = hypothesis.chi_square({(i, j): n for i, r in enumerate([[10, 20, 30], [6, 9, 17]]) for j, n in enumerate(r)})
    assert plain["chi2"] == pytest.approx(0.2715746, abs=1e-6) and plain["p_value"] == pytest.approx(0.8730284, abs=1e-6)
    with pytest.raises(ValueError):
        hypothesis.phi(plain)


def mid(values):
    return [sum(y < x for y in values) + (sum(y == x for y in values) + 1) / 2 for x in values]


def test_rank_tests_with_ties(spark):
    r = random.Random(4)
    data = [(r.randint(0, 9), g) for g in "abc" for _ in range(30)]
    survey = SurveyData(spark.createDataFrame(data, "x long, g string"))
    rank, n = mid([x for x, _ in data]), len(data)
    h = 12 / (n * (n + 1)) * sum(sum(q for q, (_, k) in zip(rank, data, strict=True) if k == g) ** 2 / 30 for g in "abc") - 3 * (n + 1)
    ties = sum(c**3 - c for c in (sum(x == v for x, _ in data) for v in range(10)))
    assert survey.analysis.kruskal("x", "g")["statistic"] == pytest.approx(h / (1 - ties / (n**3 - n)))
    two = SurveyData(survey.frame.filter("g <> 'c'"))
    u = sum((x > y) + 0.5 * (x == y) for x, g in data if g == "a" for y, k in data if k == "b")
    got = two.analysis.mannwhitney("x", "g")
    assert got["statistic"] == u and (got["group_a"], got["group_b"]) == ("a", "b")
    with pytest.raises(ValueError):
        survey.analysis.mannwhitney("x", "g")
    assert ranks.mid_ranks(survey.frame, "x").count() == len({x for x, _ in data})


def test_small_exact_mann_whitney_and_spearman(spark):
    df = spark.createDataFrame([(1.0, "a", 9.0), (2.0, "a", 7.0), (3.0, "a", 5.0), (4.0, "b", 3.0), (5.0, "b", 1.0), (6.0, "b", -1.0)], "x double, g string, y double")
    a = SurveyData(df).analysis
    assert a.mannwhitney("x", "g")["p_value"] == pytest.approx(0.1)
    assert a.spearman("x", "y")["rho"] == pytest.approx(-1) and a.spearman("x", "y")["n"] == 6
    t = a.ttest("x", "g")
    assert t["statistic"] == pytest.approx(-3.6742346) and t["p_value"] == pytest.approx(0.0213117, abs=1e-6)
    assert a.anova("x", "g")["statistic"] == pytest.approx(13.5)
    assert SurveyData(df.limit(0)).analysis.spearman("x", "y") == {"rho": 0.0, "p_value": 1.0, "n": 0}


@pytest.mark.parametrize("few", [200_000, 10])
def test_mid_ranks_by_window_and_by_range(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    r = random.Random(9)
    values = [float(r.randint(0, 200)) for _ in range(1000)]
    got = {x["x"]: x["midrank"] for x in ranks.mid_ranks(spark.createDataFrame([(v,) for v in [*values, None]], "x double"), "x").collect()}
    assert got == dict(zip(values, mid(values), strict=True))


def test_ranks_do_not_depend_on_a_monotone_map(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(r.random(), r.choice("ab")) for _ in range(500)], "x double, g string")
    a, b = (SurveyData(f).analysis.kruskal("x", "g")["statistic"] for f in (df, df.selectExpr("exp(x) as x", "g")))
    assert a == pytest.approx(b)


def test_report_tables(small):
    freq = rows(small.report.freq("a").to_df())
    assert freq == [("1", "one", 2, 50.0, 50.0), ("2", "two", 2, 50.0, 100.0), ("", "Total", 4, 100.0, 100.0)]
    cross = small.report.crosstab("a", "b", pct="row")
    assert rows(cross.to_df()) == [("one", 50.0, 50.0, 2.0), ("two", 0.0, 100.0, 1.0), ("Total", 1.0, 2.0, 3.0)]
    assert cross.to_df().columns == ["A", "eins", "2", "Total"] and cross.stats["N"] == 3
    means = small.report.means("w", "a")
    assert rows(means.to_df())[0] == ("one", 1.5, pytest.approx(0.707), 1.5, 2)
    assert "Mann-Whitney" in means.to_markdown() and "<table>" in means.to_html() and "| one |" in cross.to_markdown()


def test_banner(small):
    got = {(r["row_value"], r["column_value"]): (r["n"], round(r["share"], 6)) for r in small.tables.banner(["a"], ["b"]).collect()}
    assert got == {("1", "1"): (1.0, 1.0), ("1", "2"): (2.0, round(2 / 7, 6)), ("2", "2"): (5.0, round(5 / 7, 6))}
    shares = small.tables.banner(["a", "w"], ["b"]).groupBy("row_variable", "column_value").agg({"share": "sum"}).collect()
    assert all(math.isclose(r[2], 1) for r in shares)
    with pytest.raises(ValueError):
        small.tables.banner([], ["b"])


def test_weighting(spark):
    df = spark.createDataFrame([("m", "n")] * 30 + [("m", "s")] * 30 + [("f", "n")] * 10 + [("f", "s")] * 30 + [(None, "s")], "g string, r string")
    w = cell_weights(df, "g", {"m": 50, "f": 50}).groupBy("g").agg({"weight": "sum"}).collect()
    assert {r[0]: r[1] for r in w} == {"m": pytest.approx(50), "f": pytest.approx(50), None: None}
    raked = rake_weights(df, {"g": {"m": 1, "f": 1}, "r": {"n": 3, "s": 1}}).dropna()
    assert raked.agg({"weight": "avg"}).first()[0] == pytest.approx(1)
    assert {r[0]: r[1] for r in raked.groupBy("r").agg({"weight": "sum"}).collect()} == {"n": pytest.approx(75), "s": pytest.approx(25)}
    assert {r[0]: r[1] for r in raked.groupBy("g").agg({"weight": "sum"}).collect()} == {"m": pytest.approx(50), "f": pytest.approx(50)}


@pytest.mark.parametrize("most", [100_000, 1])
def test_raking_on_the_driver_and_in_spark(spark, monkeypatch, most):
    """Plain proportional fitting; values without a row, without a target and null ones."""
    monkeypatch.setattr(weights, "DRIVER_CELLS", most)
    cells = {("m", 1): 30, ("m", 2): 30, ("f", 1): 10, ("f", 2): 30, ("x", 1): 5}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)] + [(None, 1)], "g string, r int")
    got = {(r["g"], r["r"]): r["weight"] for r in rake_weights(df, {"g": {"m": 1, "f": 1, None: 2}, "r": {1: 3, 2: 1, 9: 4}}).distinct().collect()}
    want = {k: 1.0 for k in cells if k[0] != "x"}
    for _ in range(200):
        for i, share in ((0, {"m": 0.5, "f": 0.5}), (1, {1: 0.75, 2: 0.25})):
            now = {v: sum(w * cells[k] for k, w in want.items() if k[i] == v) for v in share}
            want = {k: w * share[k[i]] * 100 / now[k[i]] for k, w in want.items()}
    assert got == {**{k: pytest.approx(w) for k, w in want.items()}, ("x", 1): None, (None, 1): None}
    assert rake_weights(df.limit(0), {"g": {"m": 1}}).count() == 0


def test_chi_square_beyond_the_driver(spark, monkeypatch):
    draw = random.Random(3)
    pairs = [(draw.choice([None, *range(9)]), draw.choice("abcd")) for _ in range(60)] + [(1, None)] * 20
    data = SurveyData(spark.createDataFrame(pairs, "a int, b string"), VariableMap([Variable("a"), Variable("b")]))
    small = [data.analysis.independence("a", "b", nulls) for nulls in (True, False)]
    monkeypatch.setattr(statistics, "DRIVER_CELLS", 3)
    for nulls, want in zip((True, False), small, strict=True):
        got = data.analysis.independence("a", "b", nulls)
        assert got["shape"] == want["shape"] and got["n"] == want["n"] and got["dof"] == want["dof"]
        assert got["chi2"] == pytest.approx(want["chi2"]) and got["p_value"] == pytest.approx(want["p_value"])
    one = SurveyData(spark.createDataFrame([(i, "x") for i in range(9)], "a int, b string"), VariableMap([Variable("a"), Variable("b")]))
    assert one.analysis.independence("a", "b")["chi2"] == 0 and one.analysis.independence("a", "b")["p_value"] == 1
    assert data.report.crosstab("a", "b").stats["N"] == small[1]["n"]


def test_chi_square_tail_of_many_degrees():
    for x in (0.9985e6, 1e6, 1.0015e6):
        assert chi2_tail(x, 1_000_001) == pytest.approx(chi2_tail(x, 1_000_000), abs=2e-3)
    assert chi2_tail(3e9, 3e9) == pytest.approx(0.5, abs=1e-4)


def test_hygiene(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, " "), ("b", 1, None), (None, 5, "y")], "who string, at long, answer string")
    assert sorted(map(str, rows(dedup_responses(df, "who", "at").select("who", "at")))) == sorted(["('a', 2)", "('b', 1)", "(None, 5)"])
    assert [r["is_partial"] for r in partial_flag(df, ["answer"]).collect()] == [False, True, True, False]


def test_charts(small):
    assert rows(small.plot.bar("a").data) == [(1, "one", 2), (2, "two", 2)]
    box = small.plot.boxplot("w", by="a").data.collect()
    assert box[0]["median"] == 1.5 and box[0]["outliers"] == 0
    trend = small.plot.scatter("w", "a").trend
    assert trend["n"] == 4 and trend["slope"] == pytest.approx(0.285714, abs=1e-5) or trend["slope"] > 0
    assert {(r["variable"], r["group"]): r["value"] for r in small.plot.heatmap(["w"], by="a").data.collect()} == {("w", "one"): 1.5, ("w", "two"): 4.0}
