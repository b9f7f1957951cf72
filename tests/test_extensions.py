import pytest

from tallyframe.functions.columns import piped
from tallyframe.functions.rules import FilterRule, Script
from tallyframe.sources.catalog import Tables


def test_piping(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    texts = [r[0] for r in df.select(piped("You said {label:a} ({answer:a}), {var:b}! {other}", {"a": {1: "one"}})).collect()]
    assert texts == ["You said one (1), x! {other}", "You said 2 (2), ! {other}"]


def test_filter_rules_see_none(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (None, "y")], "a long, b string")
    assert FilterRule(lambda r: r["b"] is None or r["a"] is None, "gaps").apply(df).count() == 2
    assert FilterRule(lambda r: r["a"] == 1).apply(df, ["a"]).count() == 1
    with pytest.raises(ValueError):
        Script("onNothing", "x")


def test_catalog_tables(spark):
    tables = Tables(spark)
    tables.drop("catalog_check")
    tables.write(spark.range(3), "catalog_check")
    tables.write(spark.range(2), "catalog_check", "append")
    assert "catalog_check" in tables.list() and tables.read("catalog_check").count() == 5
    tables.write(spark.range(1), "catalog_check", "replace")
    assert tables.read("catalog_check", 10).count() == 1 and tables.schema("catalog_check") == {"id": "bigint"}
    with pytest.raises(ValueError):
        tables.write(spark.range(1), "catalog_check", "odd")
    tables.drop("catalog_check")
