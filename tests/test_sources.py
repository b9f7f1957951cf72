import json

import pytest

from tallyframe.functions.expressions import AND
from tallyframe.operators.dataset import SurveyData
from tallyframe.operators.report import Report
from tallyframe.operators.variables import MissingValue, Variable, VariableMap
from tallyframe.sources import files
from tallyframe.sources.questionnaire import LikertScale, Matrix, MultiChoice, NumericInput, OpenText, Page, Questionnaire, Quota, Ranking, SingleChoice
from tallyframe.sources.responses import ResponseStore, admitted, parsed
from tallyframe.streaming import ingest

CONSENT = Variable("consent", "nominal", labels={1: "Yes", 0: "No"})
AGE = Variable("age", "ratio", valid_range=(18, 75))
ROLE = Variable("role", "nominal", labels={1: "A", 2: "B"})
PICKS = Variable("picks", "nominal", labels={1: "a", 2: "b", 3: "c", 9: "none"})
WIDE = [Variable(f"w{i}", "nominal") for i in range(3)]
ROWS = [Variable(f"m{i}", "ordinal") for i in range(2)]
ORDER = Variable("order", "nominal", labels={i: str(i) for i in range(1, 5)})


def questionnaire():
    return Questionnaire(
        "Demo",
        [
            Page("start", [SingleChoice("Consent", CONSENT, id="consent")]),
            Page("demo", [NumericInput("Age", AGE, id="age"), LikertScale("Mood", Variable("mood", "ordinal"), id="mood", show_if=AGE > 40), SingleChoice("Role", ROLE, id="role", other_specify=True)], show_if=CONSENT.eq(1)),
            Page("more", [
                MultiChoice("Picks", PICKS, id="picks", exclusive=[9], max_answers=3, other_specify=True), MultiChoice("Wide", vars=WIDE, mode="wide", id="wide"),
                Matrix("Rows", ROWS, id="rows"), Ranking("Order", ORDER, id="order", max_ranked=3), OpenText("Story", Variable("story"), id="story"),
            ], hide_if=AND(CONSENT.eq(1), AGE < 20)),
        ],
    )


def test_simulation_follows_routing(spark):
    survey = questionnaire()
    survey.validate()
    data = survey.simulate(spark, 400, seed=5)
    rows = data.frame.collect()
    assert len(rows) == 400 and data.frame.columns == survey.variable_names()
    for r in rows:
        assert (r["age"] is not None) == (r["consent"] == 1)
        assert (r["mood"] is not None) == (r["age"] is not None and r["age"] > 40)
        assert r["age"] is None or 18 <= r["age"] <= 75
        hidden = r["consent"] == 1 and r["age"] < 20
        assert (r["story"] is None) == hidden
        if not hidden:
            assert 1 <= len(r["picks"]) <= 3 and len(set(r["picks"])) == len(r["picks"]) and (9 not in r["picks"] or r["picks"] == [9])
            assert sum(r[v.name] for v in WIDE) >= 1 and len(set(r["order"])) == len(r["order"]) <= 3
    again = survey.simulate(spark, 400, seed=5).frame.repartition(7)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, rows))
    assert not [i for i in data.validate() if i.severity == "error"]


def test_questionnaire_checks():
    with pytest.raises(ValueError, match="used twice"):
        Questionnaire("x", [Page("a", [NumericInput("q", AGE), NumericInput("q", ROLE)])]).validate()
    with pytest.raises(ValueError, match="unknown"):
        Questionnaire("x", [Page("a", [NumericInput("q", AGE, show_if=ROLE.eq(1))])]).validate()
    with pytest.raises(ValueError, match="out of reach"):
        Questionnaire("x", [Page("a", [NumericInput("q", AGE)], default_next="c"), Page("b"), Page("c")]).validate()
    with pytest.raises(ValueError, match="themselves"):
        Questionnaire("x", [Page("a", [NumericInput("q", AGE)]), Page("b", next_if=[(AGE > 1, "a")])]).validate()
    codes = {w.code for w in Questionnaire("x", [Page("a", default_next="b"), Page("b", [SingleChoice("q", Variable("v", "ratio"), required=True, show_if="text")])]).lint("strict")}
    assert codes == {"EMPTY_PAGE", "REDUNDANT_NAVIGATION", "REQUIRED_CONDITIONAL", "INCOMPATIBLE_QUESTION_SCALE"}
    with pytest.raises(ValueError):
        MultiChoice("q", PICKS, mode="odd")


PAYLOADS = [
    ("1", {"consent": 1, "age": 30, "mood": "na", "role": {"code": "__other__", "text": "boss"}, "picks": [1, 3], "rows": {"m0": 4, "m1": 5}, "order": [3, 1], "w0": 1, "story": "hi", "__status": "screened_out"}),
    ("2", {"consent": 0, "role": 2, "picks": {"selected": [2, "__other__"], "otherText": "z"}, "m0": 2, "wide": ["w1"], "age": "old"}),
    ("3", {}), ("4", None),
]


def payload_frame(spark):
    rows = [(i, "no json" if p is None else json.dumps(p), f"2024-01-0{k + 1} 00:00:00") for k, (i, p) in enumerate(PAYLOADS)]
    return spark.createDataFrame(rows, "id string, payload_json string, t string").selectExpr("id", "payload_json", "cast(t as timestamp) submitted_at")


def test_payloads_of_every_shape(spark):
    got = {r["_response_id"]: r for r in parsed(payload_frame(spark), questionnaire()).collect()}
    one, two = got["1"], got["2"]
    assert (one["consent"], one["age"], one["mood"], one["role"], one["role_other"], one["picks"]) == (1, 30.0, None, None, "boss", [1, 3])
    assert (one["m0"], one["m1"], one["order"], one["w0"], one["story"], one["_status"]) == (4, 5, [3, 1], 1, "hi", "screened_out")
    assert (two["role"], two["picks"], two["picks_other"], two["m0"], two["m1"], two["w1"], two["w0"], two["age"]) == (2, [2], "z", 2, None, 1, 0, None)
    assert got["3"]["consent"] is None and got["4"]["consent"] is None and got["4"]["_status"] == "completed"


def test_store_and_quotas(spark, tmp_path):
    store, survey = ResponseStore(spark, str(tmp_path)), questionnaire()
    key = store.provision(survey, [Quota("consent", 1, 1), Quota("consent", 0, 5)])
    assert len(key) == 12
    store.store(key, payload_frame(spark))
    assert store.count(key) == 4 and store.get_responses(key, survey).frame.count() == 4
    assert [r["_response_id"] for r in store.get_responses(key, survey, limit=2, offset=1).frame.collect()] == ["3", "2"]
    assert {r["value"]: (r["current"], r["open"]) for r in store.quota_check(key, survey).collect()} == {"1": (1, False), "0": (1, True)}


def test_admission_orders_ties_and_retries(spark):
    rows = [("a", 2, 1), ("b", 1, 1), ("b", 3, 1), ("c", 1, 1), ("d", 9, 2), ("e", 9, None), ("f", 0, 3)]
    df = spark.createDataFrame(rows, "_response_id string, _submitted_at long, v long")
    got = sorted((r["_response_id"], r["admitted"]) for r in admitted(df, [Quota("v", 1, 2), Quota("v", 3, 0)]).collect())
    assert got == [("a", False), ("b", True), ("b", True), ("c", True), ("d", True), ("e", True), ("f", False)]
    full = admitted(df, [Quota("v", 1, 2)], current={0: 1}).filter("admitted and v = 1").collect()
    assert {r["_response_id"] for r in full} == {"b"}


def test_streaming_ingestion_and_admission(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [json.dumps({"id": str(i % 6), "payload_json": json.dumps({"consent": 1, "age": 20 + i}), "submitted_at": f"2024-01-01T00:00:0{i}Z"}) for i in range(8)]
    (folder / "a.json").write_text("\n".join(lines[:5]))
    (folder / "b.json").write_text("\n".join(lines[5:]))
    typed = ingest.typed_responses(ingest.landed(spark, str(folder)), questionnaire())
    ingest.append_to(typed, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["_response_id"] for r in out.collect()) == [str(i) for i in range(6)]
    stream = ingest.admitted_stream(spark.readStream.schema(out.schema).parquet(str(tmp_path / "out")), [Quota("consent", 1, 4)])
    query = stream.writeStream.format("memory").queryName("admission").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["_response_id"]: r["admitted"] for r in spark.table("admission").collect()}
    assert len(got) == 6 and sum(got.values()) == 4


def test_streamed_admission_takes_the_earliest_of_many_batches(spark, tmp_path):
    """40 rows of a cell come in batches of 3; the places go to the least (time, id), none is told twice."""
    rows = [(f"r{i:02}", (i * 7) % 40 // 2, 1 if i else 2) for i in range(40)]
    folder, setting = str(tmp_path / "typed"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    typed = spark.createDataFrame(rows, "_response_id string, _submitted_at long, v int").coalesce(1)
    typed.write.parquet(folder)
    before = spark.conf.get(setting)
    spark.conf.set(setting, "3")
    try:
        stream = ingest.admitted_stream(spark.readStream.schema(typed.schema).parquet(folder), [Quota("v", 1, 10), Quota("v", 2, 0)])
        query = stream.writeStream.format("memory").queryName("admission_batches").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    finally:
        spark.conf.set(setting, before)
    got = sorted((r["_response_id"], r["admitted"]) for r in spark.table("admission_batches").collect())
    first = {r[0] for r in sorted(rows[1:], key=lambda r: (r[1], r[0]))[:10]}
    assert got == [(r[0], r[0] in first) for r in rows]


def test_files_round_trip(spark, tmp_path):
    variables = VariableMap([Variable("a", "nominal", "A", {1: "one"}, (MissingValue(9, "gone"),), dtype="int"), Variable("b", "ratio", dtype="float")])
    data = SurveyData(spark.createDataFrame([(1, 2.5), (9, None)], "a long, b double"), variables)
    for kind in ("csv", "parquet", "r"):
        data.export(kind, str(tmp_path / kind))
    again = files.CSVReader(spark).read(str(tmp_path / "csv"), variables)
    assert sorted(map(tuple, again.frame.collect())) == [(1, 2.5), (9, None)]
    assert files.ParquetReader(spark).read(str(tmp_path / "parquet")).variables.to_dict() == variables.to_dict()
    assert "%in% 9" in (tmp_path / "r" / "load.R").read_text()
    assert files.DictionaryReader().read(str(tmp_path / "r" / "dictionary.json")).to_dict() == variables.to_dict()
    with pytest.raises(NotImplementedError):
        data.export("odd", "x")
    with pytest.raises(ValueError):
        files.SurveyDataReader(spark).read("x.odd")
    with pytest.raises(ValueError):
        SurveyData(data.frame).export_dictionary("x")


def test_report_document(spark, tmp_path):
    data = SurveyData(spark.createDataFrame([(1,), (2,)], "a long"))
    report = Report("Title <x>", "About").heading("Part").text("words").note("careful").value("N", 2).divider().add(data.report.freq("a"), caption="cap")
    text = report.to_markdown()
    assert text.startswith("# Title <x>") and "> careful" in text and "**N:** 2" in text and "| 1 | 1 |" in text
    assert "Title &lt;x&gt;" in report.to_html() and "<table>" in report.to_html()
    assert (tmp_path / "r.html").exists() is False and report.save(str(tmp_path / "r.html"))
    with pytest.raises(NotImplementedError):
        report.save(str(tmp_path / "r.pdf"))
    assert "- [Title <x>](#title-x)" in Report.combine([report], title="All").to_markdown()
