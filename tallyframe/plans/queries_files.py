"""Queries of bundles, dictionaries, rendered reports, catalog tables and checks of types, with their SQL."""

from __future__ import annotations

import uuid
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from tallyframe.operators.banner import export_banner
from tallyframe.operators.dataset import SurveyData
from tallyframe.operators.report import Report
from tallyframe.operators.validation import issues_frame
from tallyframe.operators.variables import MissingValue, Variable, VariableMap
from tallyframe.plans.common import rounded, survey, table
from tallyframe.plans.queries_survey import scratch
from tallyframe.plans.queries_tables import FLAGS, STATUS
from tallyframe.sources import files
from tallyframe.sources.catalog import Tables
from tallyframe.sources.questionnaire import Page, Questionnaire, Quota, SingleChoice
from tallyframe.sources.responses import ResponseStore, reached

SIZE = Variable("p_size", "ratio", "Size", missing=(MissingValue(1, "One", "refusal"), MissingValue(2, "Two", "dont_know")))


def r_bundle(spark, d):
    """Parts as a bundle for R: its data read again with its dictionary, and how often the script sets a code to NA."""
    data = SurveyData(table(spark, d, "part").select("p_partkey", "p_size"), VariableMap([Variable("p_partkey", dtype="int"), SIZE]))
    folder = scratch(spark, "bundle").removeprefix("file://")
    data.export("r", folder)
    known = files.DictionaryReader().read(f"{folder}/dictionary.json")
    script = files.RScriptWriter.script(data)
    rows = spark.read.csv(f"{folder}/data", header=True, schema="p_partkey long, p_size long")
    kept = SurveyData(rows, known).apply_missing_values().frame
    return kept.withColumn("nas", F.lit(script.count("<- NA")).cast("long"))


def dictionary_exported(spark, d):
    """The dictionary of a dataset after an upsert, exported and applied to other rows."""
    path = f"{scratch(spark, 'dictionary').removeprefix('file://')}/d.json"
    data = survey(spark, d, "lineitem", FLAGS, STATUS)
    data = SurveyData(data.frame, data.variables.replaced(Variable("l_returnflag", "nominal", "Flag", {"A": "Taken", "N": "New", "R": "Back"})))
    data.export_dictionary(path)
    again = SurveyData(table(spark, d, "lineitem"), files.DictionaryReader().read(path))
    return rounded(again.analysis.frequencies("l_returnflag", labels=True))


def stat_metadata(spark, d):
    """Metadata of a statistics file (labels, single and ranged missing codes, measures), applied to rows."""
    meta = SimpleNamespace(
        column_names=["p_size", "p_brand"], column_labels=["Size", None], variable_value_labels={"p_size": {1: "One", 2: "Two", 3: "Three"}},
        missing_ranges={"p_size": [{"lo": 1, "hi": 1}, {"lo": 40, "hi": 50}, 2]}, variable_measure={"p_size": "ordinal", "p_brand": "odd"},
    )
    data = SurveyData(table(spark, d, "part"), files.variables_from_stat(meta)).apply_missing_values()
    rows = data.frame.groupBy("p_size").agg(F.count("*").alias("n")).filter("p_size is null or p_size in (3, 40)")
    facts = {"scale": data.variables["p_size"].scale, "other": data.variables["p_brand"].scale, "labels": ",".join(map(str, data.variables["p_size"].labels))}
    return rows.withColumns({k: F.lit(v) for k, v in facts.items()}).withColumn("p_size", F.col("p_size").cast("long"))


def report_rendered(spark, d):
    """The lines of a report with a frequency table, a cross table, a figure and a note."""
    data = survey(spark, d, "lineitem", FLAGS, STATUS)
    report = Report("Orders").heading("Counts").add(data.report.freq("l_linestatus")).value("Rows", data.frame.count()).note("all rows")
    report.add(data.report.crosstab("l_returnflag", "l_linestatus", test=False))
    lines = [x for x in report.to_markdown().split("\n") if x]
    return spark.createDataFrame(pd.DataFrame({"at": range(len(lines)), "line": lines}))  # a line a value of two variables


def banner_exported(spark, d):
    path = scratch(spark, "banner")
    export_banner(survey(spark, d, "lineitem", FLAGS, STATUS).tables.banner(["l_returnflag"], ["l_linestatus"]), path)
    back = spark.read.csv(path, header=True, inferSchema=True)
    return rounded(back.select("row_label", "column_label", F.col("n").cast("double").alias("n"), "share"))


def catalog_exported(spark, d):
    """A table of the catalog, appended to, described and exported."""
    tables, name = Tables(spark), f"segments_{uuid.uuid4().hex[:8]}"
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    tables.write(rows, name)
    tables.write(rows.filter("c_custkey % 10 = 0"), name, "append")
    path = tables.export(name, "csv", scratch(spark, "exported"))
    facts = F.lit(f"{name in tables.list()} {tables.schema(name)['c_mktsegment']}")
    tables.drop(name)
    return spark.read.csv(path, header=True).groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("facts", facts)


def checked_types(spark, d):
    """Values that do not fit their declared types, and values that are no numbers where a range asks for them."""
    frame = table(spark, d, "lineitem").select("l_quantity", "l_discount", (F.col("l_linenumber") % 3).alias("flag"), "l_shipmode" if "l_shipmode" in table(spark, d, "lineitem").columns else F.col("l_returnflag").alias("l_shipmode"))
    variables = [Variable("l_quantity", dtype="int"), Variable("l_discount", dtype="int"), Variable("flag", dtype="bool"), Variable("l_shipmode", dtype="float")]
    data = SurveyData(frame, VariableMap(variables))
    return issues_frame(data, data.validate()).select("code", "variable", "count")


def quotas_reached(spark, d):
    """Whether quotas are reached by the events, and a store's stamp in UTC."""
    kind = Variable("event_type", "nominal", labels={"click": "Click", "view": "View"})
    quotas = [Quota("event_type", "click", 20), Quota("event_type", "view", 10**9), Quota("event_type", "none", 1), Quota("event_type", "none", 0)]
    events = table(spark, d, "events")
    rows = spark.createDataFrame([(q.target_value, q.limit, reached(events, q)) for q in quotas], "value string, target long, reached boolean")
    store = ResponseStore(spark, scratch(spark, "stamped"))
    store.provision(Questionnaire("E", [Page("p", [SingleChoice("Kind", kind)])]), quotas)
    meta = spark.read.parquet(f"{store.folder}/survey_meta")
    stamped = meta.select((F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("created_at")) < 3_600).alias("stamped"))
    return rows.crossJoin(stamped)  # one row


QUERIES = {f.__name__: f for f in (r_bundle, dictionary_exported, stat_metadata, report_rendered, banner_exported, catalog_exported, checked_types, quotas_reached)}

_LABEL = "CASE {x} WHEN 'A' THEN 'Accepted' WHEN 'N' THEN 'None' WHEN 'R' THEN 'Returned' WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' END"
ORACLES = {
    "r_bundle": "SELECT p_partkey, CASE WHEN p_size NOT IN (1, 2) THEN p_size END::BIGINT AS p_size, 2::BIGINT AS nas FROM part",
    "dictionary_exported": """
SELECT l_returnflag AS value, CASE l_returnflag WHEN 'A' THEN 'Taken' WHEN 'N' THEN 'New' ELSE 'Back' END AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM lineitem GROUP BY 1""",
    "stat_metadata": """
SELECT * FROM (SELECT CASE WHEN p_size NOT IN (1, 2) THEN p_size END::BIGINT AS p_size, count(*) AS n, 'ordinal' AS scale, 'interval' AS other, '3' AS labels FROM part GROUP BY 1) WHERE p_size IS NULL OR p_size IN (3, 40)""",
    "report_rendered": f"""
WITH c AS (SELECT l_linestatus AS v, {_LABEL.format(x='l_linestatus')} AS l, count(*) AS n, round_even(count(*) / sum(count(*)) OVER () * 100, 1) AS p FROM lineitem GROUP BY 1),
f AS (SELECT *, round_even(sum(p) OVER (ORDER BY v), 1) AS q, row_number() OVER (ORDER BY v) AS k FROM c), t AS (SELECT count(*) AS n FROM lineitem),
x AS (SELECT l_returnflag AS r, count(*) FILTER (l_linestatus = 'F')::DOUBLE AS f, count(*) FILTER (l_linestatus = 'O')::DOUBLE AS o, count(*)::DOUBLE AS t FROM lineitem GROUP BY 1),
g AS (SELECT *, row_number() OVER (ORDER BY r) AS k FROM x),
lines AS (SELECT 0 AS a, 0 AS b, '# Orders' AS line UNION ALL SELECT 1, 0, '## Counts' UNION ALL SELECT 2, 0, '**Line status**' UNION ALL SELECT 3, 0, '| Value | Label | n | % | Cumulative % |' UNION ALL SELECT 4, 0, '|---|---|---|---|---|'
UNION ALL SELECT 5, k, '| ' || v || ' | ' || l || ' | ' || n || ' | ' || p || ' | ' || q || ' |' FROM f UNION ALL SELECT 6, 0, '|  | Total | ' || n || ' | 100.0 | 100.0 |' FROM t
UNION ALL SELECT 7, 0, '*Variable: Line status, N valid: ' || n || '*' FROM t UNION ALL SELECT 8, 0, '**Rows:** ' || n FROM t UNION ALL SELECT 9, 0, '> all rows' UNION ALL SELECT 10, 0, '**Return flag × Line status**'
UNION ALL SELECT 11, 0, '| Return flag | Filled | Open | Total |' UNION ALL SELECT 12, 0, '|---|---|---|---|' UNION ALL SELECT 13, k, '| ' || {_LABEL.format(x='r')} || ' | ' || f || ' | ' || o || ' | ' || t || ' |' FROM g
UNION ALL SELECT 14, 0, '| Total | ' || sum(f) || ' | ' || sum(o) || ' | ' || sum(t) || ' |' FROM x)
SELECT row_number() OVER (ORDER BY a, b) - 1 AS at, line FROM lines""",
    "banner_exported": f"""
SELECT {_LABEL.format(x='l_returnflag')} AS row_label, {_LABEL.format(x='l_linestatus')} AS column_label, count(*)::DOUBLE AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 6) AS share FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "catalog_exported": "SELECT c_mktsegment, (count(*) + count(*) FILTER (c_custkey % 10 = 0))::BIGINT AS n, 'True string' AS facts FROM customer GROUP BY 1",
    "checked_types": """
SELECT * FROM (SELECT 'INVALID_DTYPE' AS code, unnest(['l_quantity', 'l_discount', 'flag', 'l_shipmode']) AS variable,
  unnest([count(*) FILTER (l_quantity % 1 <> 0), count(*) FILTER (l_discount % 1 <> 0), count(*) FILTER (l_linenumber % 3 NOT IN (0, 1)), count(*)]) AS count FROM lineitem) WHERE count > 0""",
    "quotas_reached": """
WITH q(value, target) AS (VALUES ('click', 20::BIGINT), ('view', 1000000000), ('none', 1), ('none', 0))
SELECT value, target, (SELECT count(*) FROM events e WHERE e.event_type = q.value) >= target AS reached, true AS stamped FROM q""",
}
