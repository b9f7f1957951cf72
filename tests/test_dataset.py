import math

import pytest

from tallyframe.operators.dataset import SurveyData, recode_in_place
from tallyframe.operators.validation import ValidationError
from tallyframe.operators.variables import MissingValue, Variable, VariableMap, attach_metadata, metadata_of


def values(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


def test_variable_rules():
    v = Variable("q", " Ordinal ", missing=(MissingValue(-1, "Refused", "REFUSAL"),), missing_values=(-1, -2), missing_labels={-2: "No idea"})
    assert v.scale == "ordinal" and v.missing_values == (-1, -2)
    assert [m.label for m in v.missing] == ["Refused", "No idea"] and v.missing[1].kind == "system_missing"
    assert v.is_missing(-2) and v.is_missing(None) and not v.is_missing(1)
    for bad in ({"scale": "odd"}, {"dtype": "x"}, {"role": "x"}, {"valid_range": (1,)}, {"valid_range": (2, 1)}, {"missing_labels": {9: "x"}}):
        with pytest.raises(ValueError):
            Variable("q", **bad)
    assert Variable("q", valid_range=(None, 5)).valid_range == (None, 5)


def test_registry_round_trip(tmp_path, spark):
    variables = VariableMap([Variable("a", "nominal", labels={1: "x", 2.5: "y", "z": "w"}, missing=(MissingValue(9),)), Variable("b", role="weight")])
    again = VariableMap.from_dict(variables.to_dict())
    assert again.to_dict() == variables.to_dict() and list(again["a"].labels) == [1, 2.5, "z"]
    with pytest.raises(ValueError):
        variables.add(Variable("a"))
    assert [v.name for v in variables.by_role("weight")] == ["b"] and variables.missing_dict() == {"a": [9]}
    assert list(variables.replaced(Variable("a"))) == ["b", "a"]
    df = attach_metadata(spark.createDataFrame([(1, 2.0)], "a long, b double"), variables)
    df.write.parquet(str(tmp_path / "p"))
    assert metadata_of(spark.read.parquet(str(tmp_path / "p"))).to_dict() == variables.to_dict()


def test_bins(spark):
    ages = [17, 18, 29, 30, 45, 75, 76, None]
    data = SurveyData(spark.createDataFrame([(a,) for a in ages], "age long"))
    out = data.recode("age", into="open", bins=[18, 30, 45, 75]).recode("age", into="closed", bins=[18, 30, 45, 75], right=True)
    assert values(out.frame, "open") == [None, 1, 1, 2, 3, None, None, None]
    assert values(out.frame, "closed") == [None, 1, 1, 1, 2, 3, None, None]
    assert out.variables["open"].labels == {1: "18-30", 2: "30-45", 3: "45-75"} and out.variables["open"].role == "derived"
    with pytest.raises(ValueError):
        data.recode("age", into="x", bins=[1, 2], labels=["a", "b"])


def test_recodes_and_missing(spark):
    v = Variable("q", "ordinal", missing=(MissingValue(-1, kind="refusal"), MissingValue(-2, kind="dont_know")))
    data = SurveyData(spark.createDataFrame([(1,), (-1,), (-2,), (None,)], "q long"), VariableMap([v]))
    assert values(data.apply_missing_values().frame, "q") == [1, None, None, None]
    assert values(data.apply_missing_values(["refusal"]).frame, "q") == [1, None, -2, None]
    recoded = data.recode_values("q", {1: 10})
    assert values(recoded.frame, "q_recoded") == [10, None, None, None] and recoded.variables["q_recoded"].scale == "ordinal"
    assert values(recode_in_place(data, "q", {1: 10}).frame, "q") == [10, -1, -2, None]
    assert values(data.drop_missing("q").frame, "q") == [1, -1, -2]
    assert data.frame is not recoded.frame and "q_recoded" not in data.frame.columns


def test_derive_index_alpha(spark):
    df = spark.createDataFrame([(1, "2", 3.0), (4, "x", None), (None, None, None), (2, "4", float("nan"))], "a long, b string, c double")
    data = SurveyData(df)
    out = data.derive(name="f", expression=Variable("a").ne(1)).create_index("i", items=["a", "b", "c"])
    assert values(out.frame, "f") == [0, 1, 1, 1]
    assert values(out.frame, "i") == [2.0, 4.0, None, 3.0]
    assert out.variables["f"].labels == {0: "No", 1: "Yes"}
    with pytest.raises(ValueError):
        data.create_index("i", items=["a"], method="sum")
    rows = [(1, 2), (2, 3), (3, 5), (None, 1)]
    assert SurveyData(spark.createDataFrame(rows, "x long, y long")).scale_alpha(["x", "y"]) == pytest.approx(2 * (1 - (1 + 7 / 3) / (19 / 3)))
    assert math.isnan(SurveyData(spark.createDataFrame([(1, 2)], "x long, y long")).scale_alpha(["x", "y"]))
    assert SurveyData(spark.createDataFrame([(1, 1), (1, 1)], "x long, y long")).scale_alpha(["x", "y"]) == 0.0


def test_codebook_and_description(spark):
    data = SurveyData(spark.createDataFrame([(1, None), (1, "b")], "a long, b string"), VariableMap([Variable("a", "nominal", "A", {1: "one"}), Variable("b"), Variable("gone")]))
    assert data.codebook().count() == 3 and len(data.codebook().columns) == 10
    got = {r["name"]: (r["n"], r["n_missing"], r["n_unique"]) for r in data.describe_variables().collect()}
    assert got == {"a": (2, 0, 1), "b": (1, 1, 1), "gone": (0, 0, 0)}


def test_validation(spark):
    variables = VariableMap([
        Variable("gender", "nominal", labels={1: "m", 2: "f"}), Variable("age", "ratio", valid_range=(18, 99), dtype="int", missing_values=(-9,)), Variable("id", role="id"),
        Variable("w", role="weight"), Variable("picks", "nominal", labels={1: "a"}), Variable("gone"), Variable("m", labels={1: "x"}, missing_values=(5,)),
    ])
    rows = [(1, 34.0, "a", "1", [1], 1, 0), (5, 200.0, "a", "2", [1, 7], 1, 0), (2, -9.0, None, "x", None, 1, 0)]
    df = spark.createDataFrame(rows, "gender long, age double, id string, w string, picks array<long>, m long, extra int")
    issues = SurveyData(df, variables, weight="none").validate()
    found = {(i.code, i.variable): i.count for i in issues}
    assert found == {
        ("MISSING_COLUMN", "gone"): 0, ("EXTRA_COLUMN", "extra"): 0, ("INVALID_LABEL_VALUE", "gender"): 1, ("OUT_OF_RANGE", "age"): 1, ("DUPLICATE_ID", "id"): 1,
        ("INVALID_WEIGHT", "w"): 0, ("INVALID_LABEL_VALUE", "picks"): 1, ("MISSING_VALUE_WITHOUT_LABEL", "m"): 0, ("MISSING_WEIGHT_COLUMN", "none"): 0,
    }
    with pytest.raises(ValidationError):
        SurveyData(df, variables).validate(raise_on_error=True)
    assert [i.code for i in SurveyData(df).validate()] == ["MISSING_METADATA"]
