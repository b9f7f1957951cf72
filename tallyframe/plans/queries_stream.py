"""Queries of streams with late rows and retries, of paged sources and of payloads, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.variables import Variable
from tallyframe.plans.common import rounded, table
from tallyframe.plans.queries_survey import scratch
from tallyframe.sources import paged, payloads
from tallyframe.sources.questionnaire import Page, Questionnaire, Quota, SingleChoice
from tallyframe.streaming import ingest, stateful

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"
#: Events of the first 20 days land first; every tenth of the last of these days a delivery later; every twentieth of the
#: first half last, when their windows are closed.
_DAY, _LAST = "timestamp'2024-01-20 00:00:00'", "timestamp'2024-01-21 00:00:00'"
_DELIVERY = f"CASE WHEN event_id % 20 = 0 AND ts < timestamp'2024-01-15 00:00:00' THEN 3 WHEN event_id % 10 = 1 AND ts >= {_DAY} AND ts < {_LAST} THEN 2 WHEN ts < {_LAST} THEN 1 ELSE 2 END"


def _delivered(spark, d, start) -> DataFrame:
    """Three deliveries of the events into a folder, each read by a run of the same stream; start(stream, checkpoint) -> query."""
    folder = scratch(spark, "deliveries")
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("delivery", F.expr(_DELIVERY))
    for k in (1, 2, 3):
        events.filter(F.col("delivery") == k).drop("delivery").write.mode("append").parquet(f"{folder}/landed")
        stream = spark.readStream.schema(EVENTS).parquet(f"{folder}/landed")
        start(stream, folder).awaitTermination()
    return folder


def stream_windows(spark, d):
    """Counts a day and type by an append-mode stream: what comes late but before its window closes counts, later rows do not."""

    def start(stream, folder):
        return ingest.append_to(ingest.windowed_counts(stream, "ts", "event_type", "1 day", "1 day"), f"{folder}/out", f"{folder}/checkpoint")

    out = spark.read.parquet(f"{_delivered(spark, d, start)}/out")
    return out.select(F.col("window.start").cast("timestamp").cast("long").alias("start"), F.col("value").alias("kind"), "n")


def stream_sessions(spark, d):
    """Sessions of a user, final once the watermark has passed them; rows that come after that are left out."""

    def start(stream, folder):
        closed = ingest.sessions(stream.withWatermark("ts", "1 day"), "ts", "user_id", "6 hours")
        return ingest.append_to(closed, f"{folder}/out", f"{folder}/checkpoint")

    out = spark.read.parquet(f"{_delivered(spark, d, start)}/out")
    return out.groupBy("key").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max(F.unix_micros("end")).alias("last_end"))


def stream_latest(spark, d):
    """The latest event of each user, kept up by a stream in three deliveries; the last batch is then played again."""
    held = []

    def start(stream, folder):
        target = stateful.LatestTable(spark, f"{folder}/latest", "user_id", ["ts", "event_id"], buckets=8)
        held[:] = [target]
        return target.keep_up(stream, f"{folder}/checkpoint")

    folder = _delivered(spark, d, start)
    again = spark.read.schema(EVENTS).parquet(f"{folder}/landed").withColumn("ts", F.col("ts") + F.expr("interval 1 year"))
    replayed = held[0].upsert(again, held[0]._state()["batch"])
    return rounded(held[0].read().select("user_id", "event_id", "event_type", "value").withColumn("replayed", F.lit(replayed)))


def stream_retries(spark, d):
    """Quota admission where a third of the responses come again three days after the last, when the watermark no longer knows them."""
    asked = Questionnaire("Events", [Page("one", [SingleChoice("Kind", Variable("kind", "nominal", labels={"click": "Click", "view": "View", "error": "Error"}), id="kind")])])
    folder = scratch(spark, "retries")
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.to_json(F.struct(F.col("event_type").alias("kind"))).alias("payload_json"), F.col("ts").alias("submitted_at"))
    end = rows.agg(F.max("submitted_at").alias("end"))
    known = F.col("submitted_at") < F.col("end") - F.expr("interval 1 day")  # ids that the watermark has let go
    again = rows.filter("id % 3 = 0").crossJoin(end).filter(known).withColumn("submitted_at", F.col("end") + F.expr("interval 3 days")).drop("end")  # one row
    quotas = [Quota("kind", "click", 50), Quota("kind", "view", 200), Quota("kind", "error", 10**6)]
    for part in (rows, again):
        part.coalesce(1_000).write.mode("append").json(f"{folder}/landed")  # the files of a delivery fit one batch of the stream
        typed = ingest.typed_responses(ingest.landed(spark, f"{folder}/landed"), asked, late="1 hour")
        ingest.append_to(stateful.admitted_once(typed, quotas), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("cell", "status").agg(F.count("*").alias("n"), F.min(F.col("_response_id").cast("long")).alias("least"))


def sheet_pages(spark, d):
    """Orders written as a sheet of pages and read back with a filter that leaves some pages unread."""
    paged.register(spark)
    folder = scratch(spark, "sheet")
    status = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.col("o_orderstatus")).alias("status")
    rows = table(spark, d, "orders").select("o_orderkey", status, "o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string")).alias("mixed"))
    dealt = rows.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    dealt.write.format("sheet_pages").mode("append").option("page_rows", 500).save(folder)
    dealt.filter("o_orderkey % 100 = 1").write.format("sheet_pages").mode("append").save(folder)  # more rows of a sheet
    middle = rows.agg(F.max("o_orderkey")).first()[0] // 2
    return rounded(spark.read.format("sheet_pages").load(folder).filter(F.col("o_orderkey") <= float(middle)), 2)


def payload_fields(spark, d):
    """Columns from payloads whose fields follow from the data: a field named after each type, nested, some missing, some mixed."""
    more = F.concat(
        F.lit(', "by": {"'), "event_type", F.lit('": {"value": '), F.col("value").cast("decimal(18,2)").cast("string"), F.lit("}}"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "mixed": "a'), "event_id", F.lit('"'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(', "mixed": '), "event_id")).otherwise(F.lit("")), F.lit("}"),
    )
    broken = F.when(F.col("event_id") % 50 == 0, F.lit("no json")).otherwise(F.concat(F.expr("left(props, length(props) - 1)"), more))
    out = payloads.normalised(table(spark, d, "events").select("event_id", broken.alias("payload")), "payload")
    kinds = [c for c in out.columns if c.startswith("by.")]
    return out.select("event_id", F.col("k").cast("long").alias("k"), "mixed", *[F.col(f"`{c}`").cast("double").alias(c.replace(".", "_")) for c in kinds if c in ("by.click.value", "by.view.value", "by.error.value")])


QUERIES = {f.__name__: f for f in (stream_windows, stream_sessions, stream_latest, stream_retries, sheet_pages, payload_fields)}

_DELIVERIES = f"""WITH e AS (SELECT *, {_DELIVERY.replace("timestamp'", "TIMESTAMP '")} AS delivery FROM events),
w AS (SELECT max(ts) FILTER (delivery = 1) - INTERVAL 1 DAY AS first, max(ts) FILTER (delivery <= 2) - INTERVAL 1 DAY AS second FROM e),
"""
ORACLES = {
    "stream_windows": _DELIVERIES + """c AS (SELECT date_trunc('day', ts) AS day, event_type, delivery FROM e),
k AS (SELECT day, event_type FROM c, w WHERE delivery = 1 OR delivery = 2 AND day + INTERVAL 1 DAY > first OR delivery = 3 AND day + INTERVAL 1 DAY > second)
SELECT epoch(day)::BIGINT AS start, event_type AS kind, count(*) AS n FROM k, w WHERE day + INTERVAL 1 DAY <= second GROUP BY 1, 2""",
    "stream_sessions": _DELIVERIES + """k AS (SELECT user_id, ts FROM e, w WHERE delivery = 1 OR delivery = 2 AND ts + INTERVAL 6 HOUR > first OR delivery = 3 AND ts + INTERVAL 6 HOUR > second),
b AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM k),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM b), g AS (SELECT user_id, s, max(ts) + INTERVAL 6 HOUR AS ends, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id AS key, count(*) AS sessions, sum(n)::BIGINT AS events, max(epoch_us(ends))::BIGINT AS last_end FROM g, w WHERE ends <= second GROUP BY 1""",
    "stream_latest": """
SELECT user_id, event_id, event_type, round(value, 6) AS value, false AS replayed FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "stream_retries": """
WITH q(event_type, cell, most) AS (VALUES ('click', 0, 50), ('view', 1, 200), ('error', 2, 1000000)),
r AS (SELECT event_id, cell, CASE WHEN row_number() OVER (PARTITION BY cell ORDER BY ts, event_id::VARCHAR) <= most THEN 'admitted' ELSE 'full' END AS status, ts FROM events JOIN q USING (event_type)),
a AS (SELECT event_id, cell, CASE status WHEN 'admitted' THEN 'retry' ELSE status END AS status FROM r WHERE event_id % 3 = 0 AND ts < (SELECT max(ts) - INTERVAL 1 DAY FROM events))
SELECT cell::INT AS cell, status, count(*) AS n, min(event_id) AS least FROM (SELECT event_id, cell, status FROM r UNION ALL SELECT * FROM a) GROUP BY ALL""",
    "sheet_pages": """
WITH s AS (SELECT o_orderkey::DOUBLE AS o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN nullif(o_orderstatus, '') END AS status, round(o_totalprice::DOUBLE, 2) AS o_totalprice,
  CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE o_custkey::VARCHAR END AS mixed FROM orders)
SELECT * FROM (SELECT * FROM s UNION ALL SELECT * FROM s WHERE o_orderkey % 100 = 1) WHERE o_orderkey <= (SELECT max(o_orderkey) // 2 FROM orders)""",
    "payload_fields": """
SELECT event_id, CASE WHEN ok THEN (props->>'k')::BIGINT END AS k, CASE WHEN ok AND event_id % 3 = 0 THEN 'a' || event_id WHEN ok AND event_id % 3 = 1 THEN event_id::VARCHAR END AS mixed,
  CASE WHEN ok AND event_type = 'click' THEN round(value, 2) END AS by_click_value, CASE WHEN ok AND event_type = 'view' THEN round(value, 2) END AS by_view_value,
  CASE WHEN ok AND event_type = 'error' THEN round(value, 2) END AS by_error_value FROM (SELECT *, event_id % 50 <> 0 AS ok FROM events)""",
}
