import pytest
from pyspark.sql import functions as F

from tallyframe.functions.columns import half_even, slug
from tallyframe.functions.distributions import chi2_tail, f_tail, mann_whitney_exact, normal_quantile, t_two_sided
from tallyframe.functions.expressions import AND, NOT, OR, Expression, compare, derived_column, raw, routed_column
from tallyframe.operators.variables import Variable

X, Y = Variable("x", "ratio"), Variable("y", "ratio")


def trees():
    leaves = [X.eq(1), X.ne(1), X > 1, X >= 1, X < 2, X <= 1, X.isin(1, 3), X.notin(1, 3), Y.gt(1), Y.ne(2)]
    return leaves + [NOT(e) for e in leaves] + [op(a, b) for op in (AND, OR) for a in leaves for b in (leaves[2], leaves[1], leaves[8])] + [NOT(AND(X > 1, Y > 1)), OR(NOT(X > 1), Y.eq(2))]


def python_derived(e, row):
    """Reading of a missing answer as NaN: comparisons false, negative ones true."""
    nan = float("nan")
    return e.evaluate({k: nan if v is None else v for k, v in row.items()})


def python_routed(e, row):
    try:
        return e.evaluate(row)
    except TypeError:
        return False


@pytest.mark.parametrize(("compile_", "read"), [(derived_column, python_derived), (routed_column, python_routed)])
def test_columns_agree_with_python_on_missing_answers(spark, compile_, read):
    rows = [(x, y) for x in (1, 2, 3, None) for y in (1, 2, None)]
    df = spark.createDataFrame(rows, "x long, y long")
    exprs = trees()
    got = df.select("x", "y", *[compile_(e).alias(f"e{i}") for i, e in enumerate(exprs)]).collect()
    for r in got:
        for i, e in enumerate(exprs):
            assert r[f"e{i}"] == bool(read(e, {"x": r["x"], "y": r["y"]})), (e.to_text(), r["x"], r["y"])


def test_trees_survive_json_and_are_checked():
    e = AND(X > 1, NOT(Y.isin([1, 2])))
    again = Expression.from_dict(e.to_dict())
    assert again.to_dict() == e.to_dict() and again.variables() == {"x", "y"}
    e.validate(["x", "y"])
    with pytest.raises(ValueError, match="unknown variables"):
        e.validate(["x"])
    with pytest.raises(ValueError):
        raw("x > 1").validate(["x"])
    with pytest.raises(ValueError):
        AND(X > 1)
    with pytest.raises(ValueError):
        compare("x", "~", 1)
    assert e.to_text() == "{x} > 1 and not {y} in [1, 2]"
    assert ((X > 1) & (Y < 1) | ~X.eq(2)).variables() == {"x", "y"}


def test_tails_at_published_critical_values():
    assert chi2_tail(3.8414588, 1) == pytest.approx(0.05, abs=1e-7)
    assert chi2_tail(23.209, 10) == pytest.approx(0.01, abs=1e-5)
    assert t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert f_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert f_tail(2.866081, 4, 20) == pytest.approx(0.05, abs=1e-6)
    assert normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert mann_whitney_exact(0, 3, 3) == pytest.approx(0.1)
    assert mann_whitney_exact(2, 4, 5) == pytest.approx(0.063492, abs=1e-6)
    assert mann_whitney_exact(10, 4, 5) == 1.0


def test_rounding_and_slugs(spark):
    row = spark.range(1).select(half_even(F.lit(12.25), 1).alias("a"), slug(F.lit(" Größe & Co! ")).alias("b"), slug(F.lit("A-B c"), "-").alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (12.2, "gr_e_co", "a-b-c")
