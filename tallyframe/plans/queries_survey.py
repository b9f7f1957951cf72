"""Queries of probabilities, predicates with missing answers, metadata, validation, stores, files and streams, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tallyframe.functions.columns import piped
from tallyframe.functions.expressions import AND, NOT, OR, Expression, routed_column
from tallyframe.functions.rules import FilterRule
from tallyframe.functions.sketches import distinct_sketches, merged_counts, standard_error
from tallyframe.operators import weights
from tallyframe.operators.dataset import SurveyData, recode_in_place
from tallyframe.operators.validation import issues_frame, label_offenders
from tallyframe.operators.variables import MissingValue, Variable, VariableMap
from tallyframe.plans.common import one_row, renamed, rounded, survey, table
from tallyframe.plans.queries_data import _RANKED, SIZE
from tallyframe.sources import files
from tallyframe.sources.questionnaire import Block, LikertScale, Matrix, MultiChoice, NumericInput, OpenText, Page, Questionnaire, Quota, Ranking, SingleChoice
from tallyframe.sources.responses import ResponseStore, parsed, sheet_frame
from tallyframe.streaming import ingest


def scratch(spark, name: str) -> str:
    """A new folder in the shared one of spark.checkpoint.dir; a local one where none is set and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def p_chi2(spark, d):
    return one_row(spark, p=survey(spark, d, "lineitem").analysis.crosstab("l_returnflag", "l_linestatus", chi2=True)[1]["p_value"])


def p_kruskal(spark, d):
    return one_row(spark, p=survey(spark, d, "lineitem").analysis.kruskal("l_quantity", "l_returnflag")["p_value"])


def p_anova(spark, d):
    return one_row(spark, p=survey(spark, d, "lineitem").analysis.anova("l_quantity", "l_returnflag")["p_value"])


def p_mannwhitney(spark, d):
    return one_row(spark, p=survey(spark, d, "lineitem").analysis.mannwhitney("l_quantity", "l_linestatus")["p_value"])


def p_ttest(spark, d):
    return one_row(spark, p=survey(spark, d, "lineitem").analysis.ttest("l_quantity", "l_linestatus")["p_value"])


def p_spearman(spark, d):
    return one_row(spark, p=survey(spark, d, "part").analysis.spearman("p_size", "p_retailprice")["p_value"])


def means_test_line(spark, d):
    stats = survey(spark, d, "lineitem", Variable("l_discount", "ratio")).report.means("l_discount", "l_linestatus").stats
    return one_row(spark, test=stats["Test"], statistic=stats["statistic"], p=stats["p"])


def freq_by_label(spark, d):
    priority = Variable("o_orderpriority", "nominal", labels={"1-URGENT": "zz", "5-LOW": "aa"})
    return renamed(survey(spark, d, "orders", priority).report.freq("o_orderpriority", sort="label").to_df(), "value", "label", "n", "percent", "cumulative")


def _judged(spark, d):
    """Documents with labels where there are any: quality and toxic are null for most."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")


def predicate_nulls(spark, d):
    quality, toxic = Variable("quality", "nominal"), Variable("toxic", "nominal")
    data = SurveyData(_judged(spark, d), VariableMap([quality, toxic]))
    rules = {
        "eq": quality.eq(1), "ne": quality.ne(1), "lt": quality < 1, "le": quality <= 0, "gt": quality > 0, "ge": quality.ge(1), "among": quality.isin(0, 1),
        "outside": quality.notin(1), "negated": NOT(quality < 1), "both": AND(quality.ne(0), toxic.eq(0)), "either": OR(quality.eq(0), toxic.ne(1)),
    }
    for name, rule in rules.items():
        data = data.derive(name=name, expression=rule)
    return data.frame.drop("quality", "toxic")


def routing_nulls(spark, d):
    quality, toxic = Variable("quality", "nominal"), Variable("toxic", "nominal")
    rules = {
        "plain": quality.ge(1), "negated": NOT(quality.ge(1)), "both": AND(toxic.eq(1), quality > 0), "either": OR(quality > 0, toxic.eq(0)),
        "decided": OR(toxic.eq(0), quality > 0), "unequal": quality.ne(1),
    }
    return _judged(spark, d).select("doc_id", *[routed_column(e).cast("int").alias(n) for n, e in rules.items()])


def expression_text(spark, d):
    """A predicate through its JSON form, as text, with its variables, compiled and row by row, over all parts."""
    size, brand = Variable("p_size", "ratio"), Variable("p_brand", "nominal")
    rule = Expression.from_dict(AND(size >= 25, NOT(brand.isin("Brand#11", "Brand#12"))).to_dict())
    data = survey(spark, d, "part", size, brand).derive(name="met", expression=rule)
    judged = FilterRule(rule.evaluate, "the same rule").apply(data.frame, ["p_size", "p_brand"]).select("p_partkey", F.lit(1).alias("read"))
    rows = data.frame.join(judged, "p_partkey", "left").select("p_partkey", "met", F.coalesce("read", F.lit(0)).alias("read"))
    return rows.withColumns({"variables": F.lit(",".join(sorted(rule.variables()))), "text": F.lit(rule.to_text())})


def recode_kept(spark, d):
    return recode_in_place(survey(spark, d, "orders"), "o_orderstatus", {"F": "done"}).frame.select("o_orderkey", "o_orderstatus")


def codebook_rows(spark, d):
    segment = Variable("band", "ordinal", "Band", role="derived", dtype="int", labels={1: "3-20", 2: "20-40"})
    data = survey(spark, d, "part", SIZE).recode("p_size", into="band", bins=[3, 20, 40], label="Band")
    assert data.variables["band"] == segment
    counts = data.frame.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("p_size", "band")])))
    counts = counts.groupBy("name").agg(F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing_rows"))
    return data.codebook().join(counts, "name")


def dictionary_kept(spark, d):
    """Metadata written as JSON, read again and applied to all parts; it stays on the driver, so a folder of its own there will do."""
    path = files.DictionaryWriter().write(VariableMap([SIZE]), f"{tempfile.mkdtemp()}/dictionary.json")
    data = SurveyData(table(spark, d, "part"), files.DictionaryReader().read(path))
    low, high = data.variables["p_size"].valid_range
    size = F.col("p_size")
    return data.apply_missing_values().frame.select("p_partkey", size.cast("long").alias("p_size"), (size.isNotNull() & ~size.between(low, high)).alias("outside"))


def validate_more(spark, d):
    price = Variable("l_returnflag", role="weight", missing=(MissingValue("Q"),), labels={"A": "a", "N": "n", "R": "r"})
    data = survey(spark, d, "lineitem", Variable("l_orderkey", role="id"), price, weight="no_such_weight")
    asked = Questionnaire("Q", [Page("p", [OpenText("T", Variable("story"))])])
    data = SurveyData(data.frame.select("l_orderkey", "l_returnflag"), data.variables, asked, data.weight)
    return issues_frame(data, data.validate()).select("code", "severity", "variable", "count")


def _chosen(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("chosen"))
    return SurveyData(rows, VariableMap([Variable("chosen", "nominal", labels={"click": "Click", "view": "View"})]))


def validate_lists(spark, d):
    data = _chosen(spark, d)
    return issues_frame(data, data.validate()).filter("variable = 'chosen'").select("code", "variable", "count")


def offending_labels(spark, d):
    brand = Variable("p_brand", "nominal", labels={"Brand#11": "First", "Brand#12": "Second"})
    return label_offenders(_chosen(spark, d)).unionByName(label_offenders(survey(spark, d, "part", brand)))


def kept_by_function(spark, d):
    rule = FilterRule(lambda a: a["o_orderstatus"] != "O" and a["o_totalprice"] > 100_000, "dear and done")
    return rule.apply(table(spark, d, "orders"), ["o_orderstatus", "o_totalprice"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def text_piped(spark, d):
    shown = piped("{answer:o_orderstatus}/{label:o_orderstatus}: no. {var:o_orderkey} {other}", {"o_orderstatus": {"F": "Filled", "O": "Open"}})
    return table(spark, d, "orders").select("o_orderkey", shown.alias("shown"))


def browse_page(spark, d):
    return weights.browse(table(spark, d, "orders"), "o_orderkey", descending=True, where=F.col("o_orderstatus") == "F", limit=50, offset=10).select("o_orderkey", "o_custkey")


def responses_deleted(spark, d):
    events = table(spark, d, "events").withColumnRenamed("event_id", "_response_id")
    return weights.without_responses(events, events.filter("event_type = 'click'")).groupBy("event_type").agg(F.count("*").alias("n"))


def _store(spark, d):
    kind, value = Variable("kind", "nominal", labels={"click": "Click", "view": "View"}), Variable("value", "ratio")
    asked = Questionnaire("Events", [Page("one", [SingleChoice("Kind", kind, id="kind"), NumericInput("Value", value, id="value")])])
    store = ResponseStore(spark, scratch(spark, "store"))
    survey_id = store.provision(asked, [Quota("kind", "click", 10), Quota("kind", "view", 10**9), Quota("kind", "none", 1)])
    answers = F.to_json(F.struct(F.col("event_type").alias("kind"), "value"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), answers.alias("payload_json"), F.col("ts").alias("submitted_at"))
    store.store(survey_id, rows)
    return store, survey_id, asked


def store_quotas(spark, d):
    store, survey_id, asked = _store(spark, d)
    return store.quota_check(survey_id, asked).withColumn("stored", F.lit(store.count(survey_id)).cast("long"))


def store_page(spark, d):
    store, survey_id, asked = _store(spark, d)
    return rounded(store.get_responses(survey_id, asked, limit=40, offset=5).frame.select(F.col("_response_id").cast("long").alias("id"), "kind", "value"))


def store_deleted(spark, d):
    """Responses of some users deleted from a store; what is left, and the files that were left alone."""
    store, survey_id, asked = _store(spark, d)
    gone = table(spark, d, "events").filter("event_id % 1000 < 3").select(F.col("event_id").cast("string").alias("id"))
    before = store.count(survey_id)
    rewritten = store.delete(survey_id, gone)
    rows = parsed(store.responses(survey_id), asked).groupBy("kind").agg(F.count("*").alias("n"), F.min(F.col("_response_id").cast("long")).alias("least"))
    return rows.withColumns({"before": F.lit(before).cast("long"), "rewritten": F.lit(rewritten > 0)})


def distinct_sketched(spark, d):
    """Different values a variable and week from daily sketches, beside the exact ones, and whether they are within four
    standard errors (or two) of them."""
    events = table(spark, d, "events")
    days = distinct_sketches(events, ["user_id", "event_id", "value"], day=F.to_date("ts"))
    weeks = merged_counts(days.withColumn("week", F.date_trunc("week", "day").cast("date")), "week")
    exact = events.groupBy(F.date_trunc("week", "ts").cast("date").alias("week")).agg(*[F.count_distinct(c).alias(c) for c in ("user_id", "event_id", "value")])
    exact = exact.select("week", F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("exact")) for c in ("user_id", "event_id", "value")])))
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(2.0), 4 * standard_error() * F.col("exact"))
    return weeks.join(exact, ["variable", "week"]).select("variable", F.col("week").cast("string").alias("week"), "exact", near.alias("near"))


def sheet_scan(spark, d):
    """Rows of a sheet: cells as text, short rows, empty cells."""
    keys = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_shippriority") if "o_shippriority" in table(spark, d, "orders").columns else F.lit("")
    mixed = F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise((F.col("o_orderkey") % 9).cast("string"))
    cells = F.array(keys[0], F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(keys[1]), mixed, (F.col("o_orderkey") % 4).cast("string"))
    cells = F.when(F.col("o_orderkey") % 7 == 0, F.slice(cells, 1, 2)).otherwise(cells)
    rows = table(spark, d, "orders").select(cells.alias("cells"))
    return sheet_frame(rows, ["order", "status", "mixed", "level"])


def _parts(spark, d):
    frame = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    schema = [Variable("p_partkey", dtype="int"), Variable("p_name", dtype="str"), Variable("p_size", dtype="int")]
    return SurveyData(frame, VariableMap(schema))


def _as_stored(data):
    return data.frame.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("p_size").cast("long").alias("p_size"))


def csv_round_trip(spark, d):
    data, path = _parts(spark, d), scratch(spark, "parts") + ".csv"
    data.export("csv", path)
    return _as_stored(files.SurveyDataReader(spark).read(path, variables=data.variables))


def parquet_round_trip(spark, d):
    path = scratch(spark, "parts") + ".parquet"
    _parts(spark, d).export("parquet", path)
    return _as_stored(files.SurveyDataReader(spark).read(path))


def json_round_trip(spark, d):
    path = scratch(spark, "parts") + ".json"
    _parts(spark, d).frame.write.json(path)
    return _as_stored(files.SurveyDataReader(spark).read(path))


def simulated_properties(spark, d):
    """Rows of a simulated survey that break its rules: none, for every kind of question."""
    consent, age = Variable("consent", "nominal", labels={1: "Yes", 0: "No"}), Variable("age", "ratio", valid_range=(18, 75))
    mood, story = Variable("mood", "ordinal", labels={i: str(i) for i in range(1, 6)}), Variable("story")
    picks, order = Variable("picks", "nominal", labels={1: "a", 2: "b", 3: "c"}), Variable("ranked", "nominal", labels={1: "x", 2: "y", 3: "z"})
    cells, wide = [Variable(f"cell{i}", "ordinal", labels={1: "l", 2: "h"}) for i in (1, 2)], [Variable(f"wide{i}", "nominal") for i in (1, 2, 3)]
    items = [NumericInput("Age", age), LikertScale("Mood", mood, show_if=age.ge(30)), OpenText("Story", story)]
    more = [MultiChoice("Picks", picks, min_answers=1, max_answers=2), MultiChoice("Wide", wide, id="wide", mode="wide", min_answers=1), Ranking("Rank", order), Matrix("Cells", cells, id="cells")]
    pages = [Page("start", [SingleChoice("Consent", consent)]), Page("demo", items, show_if=consent.eq(1)), Page("rest", more)]
    n = table(spark, d, "customer").count()
    rows = Questionnaire("Demo", pages).simulate(spark, n, seed=5).frame
    flat = Questionnaire("Flat", blocks=[Block(items), SingleChoice("Consent", consent, show_if=age.lt(0))]).simulate(spark, n, seed=5).frame
    again = Questionnaire("Demo", pages).simulate(spark, n, seed=5).frame
    bad = lambda e: F.count_if(F.coalesce(F.expr(e), F.lit(True)))
    broken = rows.agg(
        F.count("*").alias("n"), bad("consent not in (0, 1)").alias("single"), bad("case when consent = 1 then age not between 18 and 75 else age is not null end").alias("numeric"),
        bad("case when consent = 1 and age >= 30 then mood not between 1 and 5 else mood is not null end").alias("likert"),
        bad("case when consent = 1 then story <> 'sample text' else story is not null end").alias("open_text"),
        bad("size(picks) not in (1, 2) or size(array_distinct(picks)) <> size(picks) or exists(picks, x -> x not in (1, 2, 3))").alias("multi"),
        bad("wide1 + wide2 + wide3 < 1 or wide1 not in (0, 1) or wide2 not in (0, 1) or wide3 not in (0, 1)").alias("wide"),
        bad("size(ranked) not between 1 and 3 or size(array_distinct(ranked)) <> size(ranked)").alias("ranking"), bad("cell1 not in (1, 2) or cell2 not in (1, 2)").alias("matrix"),
    )
    shown = rows.selectExpr("to_json(struct(*)) as j")
    changed = shown.exceptAll(again.selectExpr("to_json(struct(*)) as j")).agg(F.count("*").alias("changed"))
    # without pages nothing is hidden
    plain = flat.agg(bad("age not between 18 and 75 or mood not between 1 and 5 or story <> 'sample text' or consent not in (0, 1)").alias("flat"))
    return broken.crossJoin(changed).crossJoin(plain)  # one row each


def stream_ingested(spark, d):
    """Responses that land as JSON, typed by a stream and appended; retries of an id are dropped."""
    asked = Questionnaire("Events", [Page("one", [SingleChoice("Kind", Variable("kind", "nominal", labels={"click": "Click", "view": "View"}), id="kind"), NumericInput("Value", Variable("value", "ratio"), id="value")])])
    folder = scratch(spark, "stream")
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.to_json(F.struct(F.col("event_type").alias("kind"), "value")).alias("payload_json"), F.col("ts").alias("submitted_at"))
    rows.unionByName(rows.filter("id % 10 = 0")).coalesce(4).write.json(f"{folder}/landed")
    typed = ingest.typed_responses(ingest.landed(spark, f"{folder}/landed"), asked, late="3650 days")
    ingest.append_to(typed, f"{folder}/typed", f"{folder}/checkpoint").awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/typed").select(F.col("_response_id").cast("long").alias("id"), "kind", "value"))


def stream_quotas(spark, d):
    """Quota admission by a stream with keyed state."""
    asked = Questionnaire("Events", [Page("one", [SingleChoice("Kind", Variable("kind", "nominal", labels={"click": "Click", "view": "View"}), id="kind")])])
    folder = scratch(spark, "stream")
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.to_json(F.struct(F.col("event_type").alias("kind"))).alias("payload_json"), F.col("ts").alias("submitted_at"))
    rows.coalesce(2).write.json(f"{folder}/landed")
    out = ingest.admitted_stream(parsed(ingest.landed(spark, f"{folder}/landed"), asked), [Quota("kind", "click", 50), Quota("kind", "view", 200)])
    ingest.append_to(out, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("cell").agg(F.count("*").alias("n"), F.count_if("admitted").alias("admitted"), F.min(F.when(F.col("admitted"), F.col("_response_id").cast("long"))).alias("least"))


def windowed_types(spark, d):
    out = ingest.windowed_counts(table(spark, d, "events"), "ts", "event_type")
    return out.select(F.col("window.start").cast("timestamp").cast("long").alias("start"), F.col("value").alias("kind"), "n")


def weight_chosen(spark, d):
    data = survey(spark, d, "lineitem").with_weight("l_quantity")
    busy = data.with_frame(data.frame.filter("l_linenumber = 1"))
    return one_row(spark, mean=busy.analysis.mean("l_discount", weighted=True), complete=busy.drop_missing("l_tax").frame.count())


#: Twice the tail of a density f beyond z, by Simpson's rule over 0..z.
_TAIL = "round(greatest(0, 1 - 2 * z / 6000 * sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * {f})), {places})"
_NORMAL = _TAIL.format(f="exp(-pow(z * k / 2000, 2) / 2) / sqrt(2 * pi())", places=6)
_STUDENT = "exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * pow(1 + pow(z * k / 2000, 2) / df, -(df + 1) / 2.0)"
_GROUPS = "WITH g AS (SELECT {g} AS g, count(*)::DOUBLE AS n, avg({x}) AS m, var_samp({x}) AS v FROM lineitem GROUP BY 1)"
_T = """, s AS (SELECT a.n + b.n - 2 AS df, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t
FROM g a, g b WHERE a.g = 'F' AND b.g = 'O'), z AS (SELECT df, t, abs(t) AS z FROM s)"""

QUERIES = {
    f.__name__: f
    for f in (
        p_chi2, p_kruskal, p_anova, p_mannwhitney, p_ttest, p_spearman, means_test_line, freq_by_label, predicate_nulls, routing_nulls, expression_text, recode_kept,
        codebook_rows, dictionary_kept, validate_more, validate_lists, offending_labels, kept_by_function, text_piped, browse_page, responses_deleted, store_quotas,
        store_page, store_deleted, distinct_sketched, sheet_scan, csv_round_trip, parquet_round_trip, json_round_trip, simulated_properties, stream_ingested, stream_quotas, windowed_types, weight_chosen,
    )
}

_PARTS = "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part"
ORACLES = {
    "p_chi2": """
WITH c AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT sum(n) AS n FROM c),
e AS (SELECT coalesce(c.n, 0) AS n, a.n * b.n / t.n AS e FROM (SELECT r, sum(n) AS n FROM c GROUP BY 1) a CROSS JOIN (SELECT c, sum(n) AS n FROM c GROUP BY 1) b CROSS JOIN t LEFT JOIN c ON c.r = a.r AND c.c = b.c)
SELECT round(exp(-sum(pow(n - e, 2) / e) / 2), 6) AS p FROM e""",
    "p_kruskal": _RANKED.format(x="l_quantity", g="l_returnflag", t="lineitem")
    + "SELECT round(exp(-(12 / (n * (n + 1)) * (SELECT sum(r * r / m) FROM s) - 3 * (n + 1)) / (1 - t / (pow(n, 3) - n)) / 2), 6) AS p FROM n, t",
    "p_anova": _GROUPS.format(g="l_returnflag", x="l_quantity")
    + """, t AS (SELECT sum(n * m) / sum(n) AS grand, sum(n) AS n FROM g), f AS (SELECT t.n - 3 AS df, (SELECT sum(g.n * pow(m - grand, 2)) FROM g, t) / 2 / ((SELECT sum((n - 1) * v) FROM g) / (t.n - 3)) AS f FROM t)
SELECT round(pow(1 + 2 * f / df, -df / 2), 6) AS p FROM f""",
    "p_mannwhitney": _RANKED.format(x="l_quantity", g="l_linestatus", t="lineitem")
    + f""", u AS (SELECT s.r - s.m * (s.m + 1) / 2 AS u, s.m, o.m AS k FROM s, s o WHERE s.g = 'F' AND o.g = 'O'),
z AS (SELECT (greatest(u, m * k - u) - m * k / 2 - 0.5) / sqrt(m * k / 12 * ((n + 1) - t / (n * (n - 1)))) AS z FROM u, n, t)
SELECT {_NORMAL} AS p FROM z, range(2001) q(k) GROUP BY z""",
    "p_ttest": _GROUPS.format(g="l_linestatus", x="l_quantity") + _T + f" SELECT {_TAIL.format(f=_STUDENT, places=6)} AS p FROM z, range(2001) q(k) GROUP BY z, df",
    "p_spearman": f"""
WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part),
c AS (SELECT corr(a, b) AS rho, count(*)::DOUBLE - 2 AS df FROM r), z AS (SELECT df, abs(rho) * sqrt(df / (1 - rho * rho)) AS z FROM c)
SELECT {_TAIL.format(f=_STUDENT, places=6)} AS p FROM z, range(2001) q(k) GROUP BY z, df""",
    "means_test_line": _GROUPS.format(g="l_linestatus", x="l_discount") + _T
    + f" SELECT 't-test' AS test, round(t, 3) AS statistic, {_TAIL.format(f=_STUDENT, places=4)} AS p FROM z, range(2001) q(k) GROUP BY z, df, t",
    "freq_by_label": """
WITH c AS (SELECT o_orderpriority AS v, CASE o_orderpriority WHEN '1-URGENT' THEN 'zz' WHEN '5-LOW' THEN 'aa' ELSE o_orderpriority END AS l, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2),
p AS (SELECT *, round_even(n / (SELECT sum(n) FROM c) * 100, 1) AS p FROM c)
SELECT v AS value, l AS label, n, p AS percent, round_even(sum(p) OVER (ORDER BY l, v), 1) AS cumulative FROM p UNION ALL SELECT '', 'Total', sum(n)::BIGINT, 100.0, 100.0 FROM c""",
    "predicate_nulls": """
WITH j AS (SELECT d.doc_id, quality AS q, toxic AS t FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, coalesce(q = 1, false)::INT AS eq, coalesce(q <> 1, true)::INT AS ne, coalesce(q < 1, false)::INT AS lt, coalesce(q <= 0, false)::INT AS le, coalesce(q > 0, false)::INT AS gt,
  coalesce(q >= 1, false)::INT AS ge, coalesce(q IN (0, 1), false)::INT AS among, coalesce(q NOT IN (1), true)::INT AS outside, (NOT coalesce(q < 1, false))::INT AS negated,
  (coalesce(q <> 0, true) AND coalesce(t = 0, false))::INT AS "both", (coalesce(q = 0, false) OR coalesce(t <> 1, true))::INT AS either FROM j""",
    "routing_nulls": """
WITH j AS (SELECT d.doc_id, quality AS q, toxic AS t FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, coalesce(q >= 1, false)::INT AS plain, coalesce(NOT q >= 1, false)::INT AS negated, (coalesce(t = 1, false) AND coalesce(q > 0, false))::INT AS "both",
  (q IS NOT NULL AND (q > 0 OR coalesce(t = 0, false)))::INT AS either, (coalesce(t = 0, false) OR coalesce(q > 0, false))::INT AS decided, coalesce(q <> 1, true)::INT AS unequal FROM j""",
    "expression_text": """
SELECT p_partkey, (p_size >= 25 AND p_brand NOT IN ('Brand#11', 'Brand#12'))::INT AS met, (p_size >= 25 AND p_brand NOT IN ('Brand#11', 'Brand#12'))::INT AS read, 'p_brand,p_size' AS variables,
  '{p_size} >= 25 and not {p_brand} in [''Brand#11'', ''Brand#12'']' AS text FROM part""",
    "recode_kept": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "codebook_rows": """
WITH b AS (SELECT p_size, CASE WHEN p_size >= 3 AND p_size < 20 THEN 1 WHEN p_size >= 20 AND p_size < 40 THEN 2 END AS band FROM part)
SELECT 'p_size' AS name, 'Size' AS label, 'ratio' AS scale, NULL::VARCHAR AS dtype, NULL::VARCHAR AS role, '' AS labels, '1=One (refusal); 2=Two (dont_know)' AS missing, '3..40' AS valid_range, NULL::VARCHAR AS construct, NULL::VARCHAR AS description,
  count(p_size) AS n, count(*) - count(p_size) AS missing_rows FROM b
UNION ALL SELECT 'band', 'Band', 'ordinal', 'int', 'derived', '1=3-20; 2=20-40', '', NULL, NULL, NULL, count(band), count(*) - count(band) FROM b""",
    "dictionary_kept": """
SELECT p_partkey, CASE WHEN p_size NOT IN (1, 2) THEN p_size END::BIGINT AS p_size, coalesce(p_size NOT IN (1, 2) AND p_size NOT BETWEEN 3 AND 40, false) AS outside FROM part""",
    "validate_more": """
SELECT 'DUPLICATE_ID' AS code, 'error' AS severity, 'l_orderkey' AS variable, count(*) AS count FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'MISSING_VALUE_WITHOUT_LABEL', 'warning', 'l_returnflag', 0 UNION ALL SELECT 'INVALID_WEIGHT', 'error', 'l_returnflag', 0
UNION ALL SELECT 'MISSING_WEIGHT_COLUMN', 'error', 'no_such_weight', 0 UNION ALL SELECT 'QUESTIONNAIRE_COLUMN_MISSING', 'error', 'story', 0""",
    "validate_lists": "SELECT 'INVALID_LABEL_VALUE' AS code, 'chosen' AS variable, count(DISTINCT user_id) AS count FROM events WHERE event_type NOT IN ('click', 'view') HAVING count(*) > 0",
    "offending_labels": """
SELECT 'chosen' AS variable, event_type AS value, count(DISTINCT user_id) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 2
UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12') GROUP BY 2""",
    "kept_by_function": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' AND o_totalprice > 100000 GROUP BY 1",
    "text_piped": "SELECT o_orderkey, coalesce(o_orderstatus, '') || '/' || coalesce(CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE o_orderstatus END, '') || ': no. ' || o_orderkey || ' {other}' AS shown FROM orders",
    "browse_page": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 50 OFFSET 10",
    "responses_deleted": "SELECT event_type, count(*) AS n FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click') GROUP BY 1",
    "store_quotas": """
WITH q(value, target) AS (VALUES ('click', 10::BIGINT), ('view', 1000000000), ('none', 1)), c AS (SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1)
SELECT 'kind' AS variable, value, target, coalesce(n, 0) AS current, coalesce(n, 0) < target AS open, (SELECT count(*) FROM events) AS stored FROM q LEFT JOIN c USING (value)""",
    "store_page": "SELECT event_id AS id, event_type AS kind, round(value, 6) AS value FROM events ORDER BY ts DESC, event_id::VARCHAR DESC LIMIT 40 OFFSET 5",
    "store_deleted": """
SELECT event_type AS kind, count(*) AS n, min(event_id) AS least, (SELECT count(*) FROM events) AS before, true AS rewritten FROM events WHERE event_id % 1000 >= 3 GROUP BY 1""",
    "distinct_sketched": """
WITH w AS (SELECT date_trunc('week', ts)::DATE AS week, * FROM events)
SELECT unnest(['user_id', 'event_id', 'value']) AS variable, week::VARCHAR AS week, unnest([count(DISTINCT user_id), count(DISTINCT event_id), count(DISTINCT value)]) AS exact, true AS near FROM w GROUP BY week""",
    "sheet_scan": """
SELECT o_orderkey::DOUBLE AS "order", CASE WHEN o_orderkey % 3 <> 0 THEN nullif(o_orderstatus, '') END AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE (o_orderkey % 9)::VARCHAR END AS mixed, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 4)::DOUBLE END AS level FROM orders""",
    "csv_round_trip": _PARTS,
    "parquet_round_trip": _PARTS,
    "json_round_trip": _PARTS,
    "simulated_properties": """SELECT count(*) AS n, 0::BIGINT AS single, 0::BIGINT AS "numeric", 0::BIGINT AS likert, 0::BIGINT AS open_text, 0::BIGINT AS multi, 0::BIGINT AS wide, 0::BIGINT AS ranking,
  0::BIGINT AS matrix, 0::BIGINT AS changed, 0::BIGINT AS flat FROM customer""",
    "stream_ingested": "SELECT event_id AS id, event_type AS kind, round(value, 6) AS value FROM events",
    "stream_quotas": """
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id::VARCHAR) AS k FROM events WHERE event_type IN ('click', 'view'))
SELECT CASE event_type WHEN 'click' THEN 0 ELSE 1 END::INT AS cell, count(*) AS n, count(*) FILTER (k <= CASE event_type WHEN 'click' THEN 50 ELSE 200 END) AS admitted,
  min(event_id) FILTER (k <= CASE event_type WHEN 'click' THEN 50 ELSE 200 END) AS least FROM r GROUP BY event_type""",
    "windowed_types": "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2",
    "weight_chosen": "SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean, count(l_tax)::INT AS complete FROM lineitem WHERE l_linenumber = 1",
}
