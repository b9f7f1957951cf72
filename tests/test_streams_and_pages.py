import http.server
import json
import os
import pickle
import re
import threading
import time
import urllib.parse

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.sketches import distinct_sketches, merged_counts, standard_error
from tallyframe.operators import ranks
from tallyframe.operators.dataset import SurveyData
from tallyframe.operators.variables import Variable, VariableMap
from tallyframe.sources import paged, payloads
from tallyframe.sources.catalog import Tables, jdbc_responses
from tallyframe.sources.files import WRITERS, register_writer
from tallyframe.sources.questionnaire import Page, Questionnaire, Quota, SingleChoice
from tallyframe.sources.responses import ResponseStore, parsed
from tallyframe.streaming import ingest, stateful

KIND = Variable("kind", "nominal", labels={"a": "A", "b": "B"})
ASKED = Questionnaire("Q", [Page("one", [SingleChoice("Kind", KIND, id="kind")])])


def test_retries_count_once_until_their_id_expires(spark, tmp_path):
    """Deliveries of a stream: the same id again, twice in a batch, and long after."""

    def deliver(*rows):
        df = spark.createDataFrame([(i, json.dumps({"kind": k}), t) for i, k, t in rows], "id string, payload_json string, t string")
        df.select("id", "payload_json", F.to_timestamp("t").alias("submitted_at")).coalesce(1).write.mode("append").json(f"{tmp_path}/landed")
        out = stateful.admitted_once(parsed(ingest.landed(spark, f"{tmp_path}/landed"), ASKED), [Quota("kind", "a", 3), Quota("kind", "b", 1)], keep_days=10)
        ingest.append_to(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("_response_id", "cell", "status").collect())

    first = deliver(("x", "a", "2024-01-01 00:00:00"), ("y", "a", "2024-01-01 00:00:01"), ("x", "a", "2024-01-01 00:00:02"), ("z", "b", "2024-01-01"), ("n", "c", "2024-01-01"))
    assert first == [("x", 0, "admitted"), ("x", 0, "retry"), ("y", 0, "admitted"), ("z", 1, "admitted")]
    second = deliver(("x", "a", "2024-01-05"), ("w", "a", "2024-01-06"), ("v", "a", "2024-01-07"), ("v", "a", "2024-01-08"), ("u", "b", "2024-01-05"))
    assert sorted(set(second) - set(first)) == [("u", 1, "full"), ("v", 0, "full"), ("w", 0, "admitted")] and second.count(("x", 0, "retry")) == 2
    third = deliver(("t", "a", "2024-02-05"))  # x, y and w expire with it; the places stay taken
    fourth = deliver(("x", "a", "2024-02-06"))
    assert ("t", 0, "full") in third and ("x", 0, "full") in fourth and len(fourth) == len(second) + 2


def test_admission_parses_a_payload_once(spark, tmp_path, capsys):
    os.mkdir(f"{tmp_path}/landed")
    stateful.admitted_once(parsed(ingest.landed(spark, f"{tmp_path}/landed"), ASKED), [Quota("kind", "a", 3), Quota("kind", "b", 1)]).explain()
    shown = capsys.readouterr().out
    assert len(re.findall("from_json|jsontostructs", shown)) == 1, shown[:3000]


def test_admission_writes_blocks_and_rarely_sorts(monkeypatch):
    """7,500 ids of a cell in four calls, 12,000 rows in Arrow batches of 100 in two comparisons; ids expire from within a block."""

    class Kept(dict):
        calls = 0

        def update(self, value):
            self[()] = value

        def updateValue(self, k, v):  # noqa: N802
            self[k], self.calls = v, self.calls + 1

        removeKey, iterator, exists, get = dict.pop, dict.items, dict.__len__, lambda self: self[()]  # noqa: N815

    states, sorts = {}, []
    admission = stateful.Admission(10)
    admission.init(type("Handle", (), {k: lambda self, name, *a: states.setdefault(name, Kept()) for k in ("getValueState", "getMapState")})())
    monkeypatch.setattr(stateful, "AT_ONCE", 1_000)
    in_order = getattr(stateful, "_in_order", lambda rows: rows)
    monkeypatch.setattr(stateful, "_in_order", lambda rows: sorts.append(len(rows)) or in_order(rows), raising=False)

    def told(rows, limit=7_500):
        frame = pd.DataFrame(rows, columns=["response", "submitted"]).assign(limit=limit)
        frame["submitted"] = pd.to_datetime(frame["submitted"])
        out = pd.concat(admission.handleInputRows((0,), iter([frame.iloc[k : k + 100] for k in range(0, len(frame), 100)]), None))
        return sorted(zip(out["_response_id"], out["status"], strict=True))

    start = pd.Timestamp("2024-01-01")
    rows = [(f"r{i:05}", start + pd.Timedelta(minutes=i)) for i in range(12_000)]
    dealt = [rows[i * 7 % 12_000] for i in range(11_999)] + [("r00007", start + pd.Timedelta(days=9))]  # one id twice, none of r11993
    first = told(dealt)
    assert first == sorted([(r, "admitted" if r < "r07500" else "full") for r, _ in rows if r != "r11993"] + [("r00007", "retry")])
    assert states["ids"].calls == 4 and len(states["ids"]) == 4 and sorts == [7_500, 12_000]
    assert told([("r00001", None), ("r09000", start)]) == [("r00001", "retry"), ("r09000", "full")] and states["ids"].calls == 4
    late = start + pd.Timedelta(days=10, minutes=2_500)
    assert told([("new", late), ("none", None)], 7_502) == [("new", "admitted"), ("none", "admitted")]
    assert told([("r02499", start), ("r02500", start), ("new", late), ("none", None)], 7_502) == [("new", "retry"), ("none", "retry"), ("r02499", "full"), ("r02500", "retry")]
    assert [len(v[0]) for _, v in sorted(states["ids"].items())] == [1_500, 2_000, 1_502]


def test_latest_rows_survive_replays_and_lost_batches(spark, tmp_path):
    table = stateful.LatestTable(spark, str(tmp_path / "latest"), "who", ["at"], buckets=4)
    with pytest.raises(ValueError):
        table.read()
    batch = lambda *rows: spark.createDataFrame(rows, "who string, at long, what string")
    rows = lambda: sorted(map(tuple, table.read().collect()), key=repr)
    assert table.upsert(batch(("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), (None, 1, "n")), 0)
    assert rows() == [("a", 3, "y"), ("b", 2, "z"), (None, 1, "n")]
    assert not table.upsert(batch(("a", 9, "again")), 0)
    batch(("lost", 1, "x")).write.parquet(str(tmp_path / "latest/data/batch-1-cut-off/_b=0"))  # files of a batch that failed
    assert table.upsert(batch(("a", 2, "older"), ("c", 1, "new"), (None, 5, "m")), 1) and table.upsert(batch(("a", 1, "x")).limit(0), 2)
    assert rows() == [("a", 3, "y"), ("b", 2, "z"), ("c", 1, "new"), (None, 5, "m")]
    assert table.remove_old() >= 3 and rows()[2] == ("c", 1, "new")


def test_pages_that_a_filter_rules_out_are_not_read(spark, tmp_path):
    paged.register(spark)
    folder = str(tmp_path / "sheet")
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("t"), "id")).alias("text"), F.lit(None).cast("string").alias("none"))
    df.repartitionByRange(2, "id").sortWithinPartitions("id").write.format("sheet_pages").mode("append").option("page_rows", 10).save(folder)
    back = spark.read.format("sheet_pages").load(folder)
    assert back.dtypes == [("id", "double"), ("text", "string"), ("none", "string")] and back.rdd.getNumPartitions() == len(os.listdir(folder)) - 1 >= 10
    some = back.filter("id between 15 and 22")
    assert some.rdd.getNumPartitions() <= 3 and sorted(r["id"] for r in some.collect()) == list(range(15, 23))
    assert back.filter("none = 'x'").count() == 0 and back.filter("none is null").count() == 100 and back.filter("id in (3, 99)").count() == 2
    assert {r["text"] for r in back.filter("text >= 't94'").collect()} == {"t94", "t96", "t98"}
    with pytest.raises(Exception, match="columns are"):
        df.select("id").write.format("sheet_pages").mode("append").save(folder)
    df.limit(0).write.format("sheet_pages").mode("append").save(str(tmp_path / "empty"))
    assert spark.read.format("sheet_pages").load(str(tmp_path / "empty")).count() == 0


def test_large_sheets_are_read_by_parts(spark, tmp_path):
    """2,200 pages of two columns, one of them text on few pages only: no task and no plan gets a line for each page."""
    paged.register(spark)
    folder = str(tmp_path / "sheet")
    number = F.col("id").cast("string")
    df = spark.range(0, 22_000, 1, 4).select("id", F.when(F.col("id") % 9_999 == 9_998, F.concat(F.lit("t"), "id")).otherwise(number).alias("mixed"), F.when(F.col("id") == 5, "nan").otherwise(number).alias("odd"))
    df.write.format("sheet_pages").mode("append").option("page_rows", 10).save(folder)
    index = json.loads((tmp_path / "sheet/index/index.json").read_text())
    back = spark.read.format("sheet_pages").load(folder)
    assert len(index["parts"]) == back.rdd.getNumPartitions() == 24 and back.dtypes == [("id", "double"), ("mixed", "string"), ("odd", "double")]
    assert len(pickle.dumps(paged.SheetReader(folder, index, back.schema))) < 3_000
    whole = lambda got: sorted((int(r["id"]), r["mixed"]) for r in got.collect())
    want = [(i, f"t{i}" if i % 9_999 == 9_998 else str(i)) for i in range(22_000)]
    assert whole(back) == want and whole(back.filter("id < 15000")) == want[:15_000] and back.filter("id < 15000").rdd.getNumPartitions() == 16
    assert whole(back.filter("id between 15 and 22")) == want[15:23] and back.filter("id between 15 and 22").rdd.getNumPartitions() == 2
    assert whole(back.filter("mixed = '77'")) == [want[77]] and whole(back.filter("mixed >= 't'")) == [want[9_998], want[19_997]]
    assert whole(back.filter("odd = 3")) == [want[3]]


def test_sheets_whose_index_names_all_pages_are_read(spark, tmp_path):
    paged.register(spark)
    pages = []
    for k in range(2):
        (tmp_path / f"page-{k}.json").write_text(json.dumps({"values": [[str(k)]]}))
        pages.append({"file": f"page-{k}.json", "rows": 1, "numeric": [True], "bounds": [[k, k]]})
    (tmp_path / "index.json").write_text(json.dumps({"header": ["id"], "pages": pages}))
    spark.range(2, 3).write.format("sheet_pages").mode("append").save(str(tmp_path))
    back = spark.read.format("sheet_pages").load(str(tmp_path))
    assert sorted(r["id"] for r in back.collect()) == [0, 1, 2] and back.rdd.getNumPartitions() == 3 and back.filter("id = 1").rdd.getNumPartitions() == 1


@pytest.mark.parametrize("test, bounds, out", [
    (paged.EqualTo(("a",), 5.0), [1, 4], True), (paged.EqualTo(("a",), 4.0), [1, 4], False), (paged.GreaterThan(("a",), 4), [1, 4], True), (paged.LessThan(("a",), 1), [1, 4], True),
    (paged.LessThanOrEqual(("a",), 1), [1, 4], False), (paged.In(("a",), (0, None)), [1, 4], True), (paged.EqualTo(("a",), 1), None, True), (paged.EqualTo(("b",), 1), [5, 6], False),
])
def test_bounds(test, bounds, out):
    assert paged.rules_out(test, {"a": bounds}) is out


@pytest.fixture
def hosted():
    """A hosted table of 2,345 rows on this machine; requests are kept."""
    rows = [{"id": i, "survey": "s" if i % 3 else "t", "payload": {"k": i}, "note": None} for i in range(2345)]
    asked = []

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            query = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
            asked.append(query)
            found = rows
            for name in set(query) & {"id", "survey"}:
                for sign, value in (c.split(".", 1) for c in query[name]):
                    value = float(value) if name == "id" else value
                    found = [r for r in found if {"eq": r[name] == value, "gt": r[name] > value, "gte": r[name] >= value, "lt": r[name] < value, "lte": r[name] <= value}[sign]]
            at, n = int(query["offset"][0]), int(query["limit"][0])
            body = json.dumps(found[at : at + n]).encode()
            self.send_response(200)
            self.send_header("Content-Range", f"{at}-{at + n}/{len(found)}")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/rows", asked
    server.shutdown()


def test_hosted_pages(spark, hosted):
    url, asked = hosted
    paged.register(spark)
    df = spark.read.format("hosted_pages").option("url", url).option("order", "id").load()
    assert df.rdd.getNumPartitions() == 3 and df.dtypes == [("id", "double"), ("survey", "string"), ("payload", "string"), ("note", "string")]
    assert df.count() == 2345 and df.filter("id = 7").first()["payload"] == '{"k": 7}'
    some = df.filter("survey = 's' and id >= 1000 and payload like '%5}'")
    del asked[:]
    assert sorted(r["id"] for r in some.collect()) == [i for i in range(1000, 2345) if i % 3 and i % 10 == 5]
    assert {"id", "survey"} <= set(asked[-1]) and some.rdd.getNumPartitions() == 1
    assert df.filter("id > 99999").count() == 0


def test_payloads_with_unknown_fields(spark):
    texts = ['{"a": 1, "in": {"x": "t", "deep": {"y": 1.5}}, "list": [1, 2]}', '{"a": 2.5, "in": {"x": 3}, "b c": true}', "no json", None, "[1]", '{"nothing": null, "in": {}}']
    out = payloads.normalised(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, p string"), "p").orderBy("id")
    assert set(out.columns) == {"id", "a", "in.x", "in.deep.y", "list", "b c", "nothing"}
    rows = [r.asDict() for r in out.collect()]
    assert [float(r["a"]) if r["a"] is not None else None for r in rows] == [1, 2.5, None, None, None, None]
    assert [r["in.x"] for r in rows[:2]] == ["t", "3"] and float(rows[0]["in.deep.y"]) == 1.5 and list(rows[0]["list"]) == [1, 2] and rows[1]["b c"] is True
    with pytest.raises(ValueError, match="same name"):
        payloads.normalised(spark.createDataFrame([(1, '{"id": 1}')], "id long, p string"), "p")
    assert payloads.normalised(spark.createDataFrame([], "id long, p string"), "p").columns == ["id"]


def test_deletion_rewrites_only_the_files_it_must(spark, tmp_path):
    store = ResponseStore(spark, str(tmp_path / "store"))
    survey = store.provision(ASKED)
    rows = lambda ids: spark.createDataFrame([(str(i), "{}") for i in ids], "id string, payload_json string").withColumn("submitted_at", F.current_timestamp()).coalesce(1)
    for k in range(4):
        store.store(survey, rows(range(10 * k, 10 * k + 10)))
    folder = store.responses_path(survey)
    times = lambda: {f: os.stat(f"{folder}/{f}").st_mtime_ns for f in os.listdir(folder) if f.endswith(".parquet")}
    before = times()
    time.sleep(0.01)
    gone = spark.createDataFrame([("3",), ("5",), ("31",), ("77",), (None,)], "id string")
    assert store.delete(survey, gone) == 2 and store.count(survey) == 37
    after = times()
    assert len(set(before.items()) & set(after.items())) == 2 and 3 <= len(after) <= 4
    assert store.delete(survey, gone) == 0 and times() == after
    assert store.delete(survey, rows(range(10, 20)).select("id")) == 1 and store.count(survey) == 27  # nothing of a file is left


def test_a_deletion_that_was_cut_off_is_finished(spark, tmp_path, monkeypatch):
    store = ResponseStore(spark, str(tmp_path / "store"))
    survey = store.provision(ASKED)
    store.store(survey, spark.range(20).select(F.col("id").cast("string").alias("id"), F.lit("{}").alias("payload_json"), F.current_timestamp().alias("submitted_at")).coalesce(2))
    finish = store.finish_deletion
    with monkeypatch.context() as m:
        m.setattr(ResponseStore, "finish_deletion", lambda *a: False)
        store.delete(survey, spark.createDataFrame([("1",)], "id string"))
    assert store.count(survey) == 20 and finish(survey) and store.count(survey) == 19 and not finish(survey)


def test_sketches_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 5_000).alias("a"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("b"), (F.col("id") % 7).alias("day"))
    got = {r["variable"]: r["estimate"] for r in merged_counts(distinct_sketches(df, ["a", "b"], day=F.col("day"))).collect()}
    for name, n in (("a", 5_000), ("b", 6_667)):
        assert abs(got[name] - n) < 4 * standard_error() * n
    assert distinct_sketches(df.limit(0), ["a"]).count() == 0


def test_tables_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 10)
    frame = spark.range(3_000).select((F.col("id") * F.col("id") % 997).alias("v"), (F.col("id") % 3).alias("w"))
    data = SurveyData(frame, VariableMap([]))
    rows = data.report.freq("v").to_df().collect()
    shown, total = [r["Cumulative %"] for r in rows[:-1]], 0.0
    for r in rows[:-1]:
        total = round(total + r["%"], 1)
        assert r["Cumulative %"] == pytest.approx(total)
    assert len(shown) == frame.select("v").distinct().count() and [int(r["Value"]) for r in rows[:-1]] == sorted(int(r["Value"]) for r in rows[:-1]) and rows[-1]["n"] == 3_000
    cells = data.report.crosstab("w", "v", pct="row").cells()
    assert cells.filter("level = 3").first()["n"] == 3_000 and cells.filter("level = 0").groupBy("row").agg(F.sum("n").alias("n")).filter("n <> 1000").count() == 0
    monkeypatch.setattr("tallyframe.operators.tables.MOST_COLUMNS", 5)
    with pytest.raises(ValueError, match="cells"):
        data.report.crosstab("w", "v").to_df()


@pytest.mark.parametrize("few", [200_000, 12])
def test_rank_matrix_equals_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    x = F.col("id") * 7919 % 1009
    frame = spark.range(400).select((x % 5).alias("a"), x.alias("b"), F.when(F.col("id") % 10 != 0, (x * x % 31).cast("double")).alias("c"), F.lit(1).alias("same"))
    data = SurveyData(frame, VariableMap([]))
    got = {(r["variable"], r["other"]): r["value"] for r in data.plot.heatmap(["a", "b", "c", "same"]).data.collect()}
    whole = SurveyData(frame.dropna(), VariableMap([]))
    for pair in (("a", "b"), ("b", "c"), ("a", "c")):
        assert got[pair] == pytest.approx(whole.analysis.spearman(*pair)["rho"]) and got[pair] == pytest.approx(got[pair[::-1]])
    assert got["a", "a"] == pytest.approx(1) and got["a", "same"] is None


def test_nothing_stays_cached(spark):
    ranks.release()
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    data = SurveyData(spark.range(100).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("g")), VariableMap([]))
    data.analysis.kruskal("a", "g"), data.analysis.spearman("a", "g"), data.analysis.median("a"), data.analysis.anova("a", "g"), data.plot.heatmap(["a", "g"])
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
    data.report.freq("a").to_df().collect()
    assert ranks.release() >= 1 and len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_scatter_draws_the_same_points_however_rows_are_dealt(spark):
    frame = spark.range(500).select((F.col("id") % 40).alias("x"), (F.col("id") % 30).alias("y"))
    draw = lambda df: sorted(map(tuple, SurveyData(df, VariableMap([])).plot.scatter("x", "y", points=60).data.collect()))
    assert draw(frame) == draw(frame.repartition(7)) and len(draw(frame)) == 60


def test_database_reads_and_exports(spark, tmp_path):
    """The embedded database that comes with Spark."""
    url = f"jdbc:derby:memory:{os.path.basename(tmp_path)};create=true"
    rows = spark.range(50).select(F.col("id"), F.when(F.col("id") % 2 == 0, "s'1").otherwise("s2").alias("survey_id"))
    rows.write.format("jdbc").options(url=url, dbtable="answers", driver="org.apache.derby.jdbc.EmbeddedDriver", createTableColumnTypes="survey_id VARCHAR(20)").save()
    got = jdbc_responses(spark, url, "answers", "s'1", (0, 50), partitions=4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.rdd.getNumPartitions() == 4 and sorted(r["id"] for r in got.collect()) == list(range(0, 50, 2))
    tables = Tables(spark)
    tables.drop("export_check")
    tables.write(rows, "export_check")
    assert spark.read.csv(tables.export("export_check", "csv", f"{tmp_path}/c"), header=True).count() == 50 and spark.read.parquet(tables.export("export_check", "parquet", f"{tmp_path}/p")).count() == 50
    with pytest.raises(ValueError):
        tables.export("export_check", "odd", f"{tmp_path}/o")
    tables.drop("export_check")


def test_writers_can_be_added(spark):
    class Lines:
        def write(self, data, path):
            return f"{path}:{data.frame.count()}"

    register_writer("Lines", Lines)
    try:
        assert SurveyData(spark.range(3).toDF("a"), VariableMap([])).export("lines", "x") == "x:3"
    finally:
        del WRITERS["lines"]


AGE, ROLE = Variable("age", "ratio"), Variable("role", "nominal", labels={1: "one"})


def asks(*items, registry=None, pages=None, **more):
    return Questionnaire("Q", pages or [Page("p", list(items))], variables=registry, **more)


def test_wrong_questionnaires():
    from tallyframe.functions.expressions import Expression
    from tallyframe.functions.rules import Script
    from tallyframe.sources.questionnaire import Block, LikertScale, NumericInput, Option

    def age(**more):
        return NumericInput("Age", AGE, **more)

    asks(age(), registry=VariableMap([AGE, ROLE])).validate()  # a registry may know more
    assert [w.code for w in asks(age(), registry=VariableMap([AGE, ROLE])).lint("strict")] == ["UNUSED_VARIABLE"]
    asks(age(required=True, show_if=AGE > 1)).validate(strict=True)  # a warning only
    wrong = [
        (asks(age(), registry=VariableMap([Variable("age", "interval")])), "defines otherwise: age"), (asks(age(), registry=VariableMap([ROLE])), "lacks"),
        (asks(pages=[Page(" ", [age()])]), "a page needs a name"), (asks(age(show_if="{who} = 1 and {age} > 3")), "unknown variables: who"),
        (asks(age(show_if=ROLE.eq(1))), "role"), (asks(age(show_if=5)), "expression or a text"), (asks(age(show_if=AGE > "x")), "age"),
        (asks(pages=[Page("p", [Block([Block([age(hide_if="{odd}")])])])]), "odd"), (asks(SingleChoice("R", ROLE, choices=[Option(1, "a", show_if="{nobody}")])), "nobody"),
        (asks(age(), scripts=[Script("onSubmit", "x", "nowhere")]), "unknown nowhere"), (asks(age(show_if=Expression("~", "a", 1))), "operator"),
    ]
    for asked, said in wrong:
        with pytest.raises(ValueError, match=re.escape(said)):
            asked.validate()
    strict = [
        (asks(NumericInput("N", Variable("n", "nominal", labels={1: "a"}))), "INCOMPATIBLE_QUESTION_SCALE"), (asks(NumericInput("N", Variable("n"))), "INCOMPATIBLE_QUESTION_SCALE"),
        (asks(LikertScale("L", Variable("l", "interval"))), "INCOMPATIBLE_QUESTION_SCALE"), (asks(SingleChoice("S", Variable("s", "nominal"), choices=[Option(1, "a")])), "CATEGORICAL_WITHOUT_LABELS"),
        (asks(pages=[Page("p", [age()]), Page("q")]), "EMPTY_PAGE"),
    ]
    for asked, code in strict:
        asked.validate()
        assert code in {w.code for w in asked.lint("strict") if w.severity == "error"}
        with pytest.raises(ValueError, match=code):
            asked.validate(strict=True)
