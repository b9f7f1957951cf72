"""Queries of transforms, tests, validation, weighting and ingestion, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import quoted, slug
from tallyframe.functions.expressions import AND, NOT, OR
from tallyframe.operators import weights
from tallyframe.operators.validation import issues_frame
from tallyframe.operators.variables import MissingValue, Variable
from tallyframe.plans.common import one_row, rounded, survey, table
from tallyframe.sources.questionnaire import LikertScale, Matrix, MultiChoice, NumericInput, OpenText, Page, Questionnaire, Quota, SingleChoice
from tallyframe.sources.responses import admitted, parsed
from tallyframe.streaming.ingest import sessions

SIZE = Variable("p_size", "ratio", "Size", missing=(MissingValue(1, "One", "refusal"), MissingValue(2, "Two", "dont_know")), valid_range=(3, 40))


def missing_applied(spark, d):
    return survey(spark, d, "part", SIZE).apply_missing_values().frame.select("p_partkey", "p_size")


def missing_by_kind(spark, d):
    data = survey(spark, d, "part", SIZE).apply_missing_values(kinds=["refusal"]).drop_missing("p_size")
    return data.frame.groupBy("p_size").agg(F.count("*").alias("n"))


def recode_bins(spark, d):
    data = survey(spark, d, "lineitem").recode("l_quantity", into="band", bins=[1, 10, 25, 50])
    closed = data.recode("l_quantity", into="closed", bins=[1, 10, 25, 50], right=True)
    return closed.frame.groupBy("band", "closed").agg(F.count("*").alias("n"))


def recode_values(spark, d):
    data = survey(spark, d, "orders").recode_values("o_orderstatus", {"F": "done", "O": "open"})
    return data.frame.select("o_orderkey", "o_orderstatus_recoded")


def derive_flag(spark, d):
    balance, segment = Variable("c_acctbal", "ratio"), Variable("c_mktsegment", "nominal")
    rule = OR(AND(balance > 1000, segment.isin("BUILDING", "MACHINERY")), NOT(balance.ge(0)))
    return survey(spark, d, "customer", balance, segment).derive(name="flag", expression=rule).frame.select("c_custkey", "flag")


def index_mean(spark, d):
    return rounded(survey(spark, d, "lineitem").create_index("score", items=["l_discount", "l_tax"]).frame.select("l_orderkey", "l_linenumber", "score"))


def alpha(spark, d):
    return one_row(spark, alpha=survey(spark, d, "lineitem").scale_alpha(["l_discount", "l_tax", "l_quantity"]))


def ess(spark, d):
    return one_row(spark, ess=survey(spark, d, "lineitem", weight="l_quantity").analysis.effective_sample_size())


def proportion_ci(spark, d):
    a = survey(spark, d, "lineitem", weight="l_quantity").analysis
    plain, weighted = a.proportion_ci("l_returnflag", "R"), a.proportion_ci("l_returnflag", "R", weighted=True)
    return one_row(spark, p=plain["p"], lower=plain["lower"], upper=plain["upper"], n=plain["n"], pw=weighted["p"], lw=weighted["lower"], uw=weighted["upper"])


def kruskal_h(spark, d):
    got = survey(spark, d, "customer").analysis.kruskal("c_acctbal", "c_mktsegment")
    return one_row(spark, statistic=got["statistic"], groups=got["groups"])


def mannwhitney_u(spark, d):
    got = survey(spark, d, "lineitem").analysis.mannwhitney("l_quantity", "l_linestatus")
    return one_row(spark, u=got["statistic"], group_a=got["group_a"], group_b=got["group_b"])


def spearman_rho(spark, d):
    got = survey(spark, d, "lineitem").analysis.spearman("l_quantity", "l_extendedprice")
    return one_row(spark, rho=got["rho"], n=got["n"])


def t_stat(spark, d):
    return one_row(spark, t=survey(spark, d, "lineitem").analysis.ttest("l_quantity", "l_linestatus")["statistic"])


def anova_f(spark, d):
    return one_row(spark, f=survey(spark, d, "customer").analysis.anova("c_acctbal", "c_mktsegment")["statistic"])


def describe_variables(spark, d):
    return survey(spark, d, "customer", Variable("c_acctbal", "ratio", "Balance"), Variable("c_mktsegment", "nominal"), Variable("gone", "nominal")).describe_variables()


def validate_counts(spark, d):
    known = Variable("p_brand", "nominal", labels={"Brand#11": "First", "Brand#12": "Second"})
    data = survey(spark, d, "part", SIZE, known, Variable("p_name", dtype="int"), Variable("p_partkey", role="id"), Variable("absent"))
    return issues_frame(data, data.validate()).select("code", "severity", "variable", "count")


def quota_admit(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("_response_id"), F.col("ts").alias("_submitted_at"), "event_type")
    out = admitted(rows, [Quota("event_type", "click", 50), Quota("event_type", "view", 200)])
    return out.select("_response_id", "admitted")


def dedup_latest(spark, d):
    return weights.dedup_responses(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


def responses_per_day(spark, d):
    return weights.responses_per_day(table(spark, d, "events"), "ts").withColumn("day", F.col("day").cast("string"))


def insights(spark, d):
    rows = weights.partial_flag(table(spark, d, "events"), ["event_type", "props"], "partial")
    return weights.insights(rows, "user_id", "ts", "partial").withColumn("last_response", F.col("last_response").cast("timestamp").cast("long"))


def partial_flag(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return weights.partial_flag(rows, ["quality", "text"]).select("doc_id", "is_partial")


def completion_time(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return rounded(weights.completion_time(rows, started="a", submitted="b").select("user_id", "completion_seconds"), 3)


def cell_weights(spark, d):
    out = weights.cell_weights(table(spark, d, "customer"), "c_mktsegment", {"BUILDING": 3, "MACHINERY": 2, "FURNITURE": 1})
    return rounded(out.groupBy("c_mktsegment").agg(F.count("weight").alias("n"), F.sum("weight").alias("total")))


def rake_weights(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    segments = {s: 1.0 + 0.2 * i for i, s in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))}
    out = weights.rake_weights(rows, {"c_mktsegment": segments, "n_regionkey": {i: 1.0 for i in range(5)}})
    return rounded(out.groupBy("c_mktsegment").agg(F.sum("weight").alias("total")), 3)


def json_props(spark, d):
    props = F.from_json("props", T.MapType(T.StringType(), T.StringType()))
    rows = table(spark, d, "events").select(F.explode(props).alias("key", "value"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"))


def multi_choice_counts(spark, d):
    chosen = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("chosen"))
    return chosen.select(F.explode("chosen").alias("option")).groupBy("option").agg(F.count("*").alias("n"))


def slugged_labels(spark, d):
    return table(spark, d, "part").select("p_partkey", slug(F.col("p_type")).alias("slug"))


def event_sessions(spark, d):
    out = sessions(table(spark, d, "events"), "ts", "user_id")
    return out.select("key", F.col("start").cast("timestamp").cast("long").alias("start"), F.col("end").cast("timestamp").cast("long").alias("end"), "n")


def _questionnaire() -> Questionnaire:
    kind = Variable("kind", "nominal", labels={"click": "Click", "view": "View", "purchase": "Purchase"})
    value, picks, rows = Variable("value", "ratio"), Variable("picks", "nominal", labels={1: "a", 2: "b", 3: "c"}), [Variable(f"m{i}", "ordinal") for i in (1, 2)]
    return Questionnaire("Events", [Page("one", [SingleChoice("Kind", kind, id="kind"), NumericInput("Value", value, id="value"), MultiChoice("Picks", picks, id="picks"), Matrix("Rows", rows, id="rows")])])


def ingest_payloads(spark, d):
    """Payloads made of events, parsed back into typed answers."""
    events = table(spark, d, "events")
    answers = F.struct(
        F.col("event_type").alias("kind"), F.col("value"), F.array(F.col("event_id") % 3 + 1).alias("picks"),
        F.struct((F.col("user_id") % 5).alias("m1"), F.lit(2).alias("m2")).alias("rows"),
    )
    rows = events.select(F.col("event_id").cast("string").alias("id"), F.to_json(answers).alias("payload_json"), F.col("ts").alias("submitted_at"))
    out = parsed(rows, _questionnaire())
    return rounded(out.select(F.col("_response_id").cast("long").alias("id"), "_status", "kind", "value", F.array_join(quoted("picks").cast("array<string>"), ",").alias("picks"), "m1", "m2"))


def simulated(spark, d):
    """A routed survey: the second page is for those who consent."""
    consent, age = Variable("consent", "nominal", labels={1: "Yes", 0: "No"}), Variable("age", "ratio", valid_range=(18, 75))
    mood, story = Variable("mood", "ordinal", labels={i: str(i) for i in range(1, 6)}), Variable("story")
    pages = [Page("start", [SingleChoice("Consent", consent)]), Page("demo", [NumericInput("Age", age), LikertScale("Mood", mood, show_if=age.ge(30)), OpenText("Story", story)], show_if=consent.eq(1))]
    return Questionnaire("Demo", pages).simulate(spark, table(spark, d, "customer").count(), seed=123).frame


_RANKED = """
WITH r AS (SELECT {x} AS x, {g} AS g, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS r FROM {t} WHERE {x} IS NOT NULL AND {g} IS NOT NULL),
s AS (SELECT g, count(*)::DOUBLE AS m, sum(r) AS r FROM r GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM r),
t AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY x))
"""

QUERIES = {
    f.__name__: f
    for f in (
        missing_applied, missing_by_kind, recode_bins, recode_values, derive_flag, index_mean, alpha, ess, proportion_ci, kruskal_h, mannwhitney_u,
        spearman_rho, t_stat, anova_f, describe_variables, validate_counts, quota_admit, dedup_latest, responses_per_day, insights, partial_flag,
        completion_time, cell_weights, rake_weights, json_props, multi_choice_counts, slugged_labels, event_sessions, ingest_payloads, simulated,
    )
}

ORACLES = {
    "missing_applied": "SELECT p_partkey, CASE WHEN p_size NOT IN (1, 2) THEN p_size END AS p_size FROM part",
    "missing_by_kind": "SELECT p_size, count(*) AS n FROM part WHERE p_size <> 1 GROUP BY 1",
    "recode_bins": """
SELECT CASE WHEN l_quantity >= 1 AND l_quantity < 10 THEN 1 WHEN l_quantity >= 10 AND l_quantity < 25 THEN 2 WHEN l_quantity >= 25 AND l_quantity < 50 THEN 3 END::BIGINT AS band,
  CASE WHEN l_quantity >= 1 AND l_quantity <= 10 THEN 1 WHEN l_quantity > 10 AND l_quantity <= 25 THEN 2 WHEN l_quantity > 25 AND l_quantity <= 50 THEN 3 END::BIGINT AS closed,
  count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "recode_values": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS o_orderstatus_recoded FROM orders",
    "derive_flag": "SELECT c_custkey, (coalesce(c_acctbal > 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY'), false) OR NOT coalesce(c_acctbal >= 0, false))::INT AS flag FROM customer",
    "index_mean": "SELECT l_orderkey, l_linenumber, round((coalesce(l_discount, 0) + coalesce(l_tax, 0)) / nullif((l_discount IS NOT NULL)::INT + (l_tax IS NOT NULL)::INT, 0), 6) AS score FROM lineitem",
    "alpha": "SELECT round(1.5 * (1 - (var_samp(l_discount) + var_samp(l_tax) + var_samp(l_quantity)) / var_samp(l_discount + l_tax + l_quantity)), 6) AS alpha FROM lineitem",
    "ess": "SELECT round(pow(sum(l_quantity), 2) / sum(l_quantity * l_quantity), 6) AS ess FROM lineitem",
    "proportion_ci": """
WITH a AS (SELECT avg((l_returnflag = 'R')::INT) AS p, count(l_returnflag) AS n, sum((l_returnflag = 'R')::INT * l_quantity) / sum(l_quantity) AS q, pow(sum(l_quantity), 2) / sum(l_quantity * l_quantity) AS m FROM lineitem)
SELECT round(p, 6) AS p, round(p - 1.959963984540054 * sqrt(p * (1 - p) / n), 6) AS lower, round(p + 1.959963984540054 * sqrt(p * (1 - p) / n), 6) AS upper, n::INT AS n,
  round(q, 6) AS pw, round(q - 1.959963984540054 * sqrt(q * (1 - q) / m), 6) AS lw, round(q + 1.959963984540054 * sqrt(q * (1 - q) / m), 6) AS uw FROM a""",
    "kruskal_h": _RANKED.format(x="c_acctbal", g="c_mktsegment", t="customer")
    + "SELECT round((12 / (n * (n + 1)) * (SELECT sum(r * r / m) FROM s) - 3 * (n + 1)) / (1 - t / (pow(n, 3) - n)), 6) AS statistic, (SELECT count(*) FROM s)::INT AS groups FROM n, t",
    "mannwhitney_u": _RANKED.format(x="l_quantity", g="l_linestatus", t="lineitem") + "SELECT round(r - m * (m + 1) / 2, 6) AS u, 'F' AS group_a, 'O' AS group_b FROM s WHERE g = 'F'",
    "spearman_rho": """
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS rho, count(*)::INT AS n FROM r""",
    "t_stat": """
WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1)
SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)), 6) AS t FROM g a, g b WHERE a.g = 'F' AND b.g = 'O'""",
    "anova_f": """
WITH g AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS grand, sum(n) AS n, count(*) AS k FROM g)
SELECT round((SELECT sum(g.n * pow(m - grand, 2)) FROM g, t) / (k - 1) / ((SELECT sum((n - 1) * v) FROM g) / (n - k)), 6) AS f FROM t""",
    "describe_variables": """
SELECT 'c_acctbal' AS name, 'Balance' AS label, 'ratio' AS scale, count(c_acctbal) AS n, count(*) - count(c_acctbal) AS n_missing, count(DISTINCT c_acctbal) AS n_unique FROM customer
UNION ALL SELECT 'c_mktsegment', 'c_mktsegment', 'nominal', count(c_mktsegment), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer
UNION ALL SELECT 'gone', 'gone', 'nominal', 0, 0, 0""",
    "validate_counts": """
SELECT 'MISSING_COLUMN' AS code, 'error' AS severity, 'absent' AS variable, 0::BIGINT AS count
UNION ALL SELECT 'EXTRA_COLUMN', 'warning', unnest(['p_type', 'p_retailprice']), 0
UNION ALL SELECT 'OUT_OF_RANGE', 'error', 'p_size', count(*) FROM part WHERE p_size NOT IN (1, 2) AND p_size NOT BETWEEN 3 AND 40 HAVING count(*) > 0
UNION ALL SELECT 'INVALID_LABEL_VALUE', 'error', 'p_brand', count(*) FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12') HAVING count(*) > 0
UNION ALL SELECT 'INVALID_DTYPE', 'error', 'p_name', count(p_name) FROM part HAVING count(p_name) > 0
UNION ALL SELECT 'DUPLICATE_ID', 'error', 'p_partkey', count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0""",
    "quota_admit": """
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events)
SELECT event_id AS _response_id, CASE event_type WHEN 'click' THEN k <= 50 WHEN 'view' THEN k <= 200 ELSE true END AS admitted FROM r""",
    "dedup_latest": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "responses_per_day": "SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1",
    "insights": "SELECT count(*) AS responses, count(DISTINCT user_id) AS respondents, count(*) FILTER (event_type IS NULL OR trim(event_type) = '' OR props IS NULL OR trim(props) = '') AS partials, floor(epoch(max(ts)))::BIGINT AS last_response FROM events",
    "partial_flag": "SELECT d.doc_id, quality IS NULL OR text IS NULL OR trim(text, ' ') = '' AS is_partial FROM documents d LEFT JOIN labels l USING (doc_id)",
    "completion_time": "SELECT user_id, round(epoch(max(ts)) - epoch(min(ts)), 3) AS completion_seconds FROM events GROUP BY 1",
    "cell_weights": """
WITH t(s, x) AS (VALUES ('BUILDING', 3.0::DOUBLE), ('MACHINERY', 2.0), ('FURNITURE', 1.0)), c AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1),
k AS (SELECT sum(n) AS n, sum(x) AS x FROM c JOIN t ON s = c_mktsegment)
SELECT c_mktsegment, CASE WHEN t.x IS NULL THEN 0 ELSE c.n END::BIGINT AS n, round(t.x / k.x * k.n, 6) AS total FROM c LEFT JOIN t ON s = c_mktsegment CROSS JOIN k""",
    "rake_weights": """
WITH t(s, x) AS (VALUES ('AUTOMOBILE', 1.0::DOUBLE), ('BUILDING', 1.2), ('FURNITURE', 1.4), ('HOUSEHOLD', 1.6), ('MACHINERY', 1.8))
SELECT s AS c_mktsegment, round(x / 7.0 * (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey), 3) AS total FROM t""",
    "json_props": "WITH p AS (SELECT props::JSON AS j, unnest(json_keys(props::JSON)) AS key FROM events) SELECT key, count(*) AS n, count(DISTINCT json_extract_string(j, '$.' || key)) AS \"values\" FROM p GROUP BY 1",
    "multi_choice_counts": "SELECT event_type AS option, count(DISTINCT user_id) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1",
    "slugged_labels": "SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part",
    "event_sessions": """
WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id AS key, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts) + INTERVAL 30 MINUTE))::BIGINT AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "ingest_payloads": "SELECT event_id AS id, 'completed' AS _status, event_type AS kind, round(value, 6) AS value, (event_id % 3 + 1)::VARCHAR AS picks, user_id % 5 AS m1, 2::BIGINT AS m2 FROM events",
}
