"""Response store and ingestion: JSON payloads to typed columns, and quota admission."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyframe.functions.columns import quoted
from tallyframe.operators.dataset import SurveyData
from tallyframe.sources.questionnaire import LikertScale, Matrix, MultiChoice, NumericInput, OpenText, Question, Questionnaire, Quota, Ranking
from tallyframe.sources.storage import Store

OTHER = "__other__"
# The stored tables.
RESPONSES = "id string, survey_id string, payload_json string, submitted_at timestamp"
RESPONSE_ROWS = "id string, payload_json string, submitted_at timestamp"
COUNTERS = "survey_id string, variable string, value string, target long, current long"
META = "survey_id string, title string, schema_json string, max_responses long, created_at timestamp"


def _typed(text: Column, codes: list) -> Column:
    """A code as the type that the question's codes have."""
    if any(isinstance(c, str) for c in codes):
        return text
    return text.try_cast("double" if any(isinstance(c, float) for c in codes) else "long")


def answer_columns(q: Question, answers: Column) -> dict[str, Column]:
    """Columns of one question from a map of JSON texts by key.

    Single choices may be a code or {code, text}; multiple ones a list or {selected, otherText}; a matrix is an
    object by row, or one key a row; 'na' is null. The text of an own answer comes out as NAME_other.
    """
    name = q.variables()[0].name
    own = F.coalesce(F.element_at(answers, name), F.element_at(answers, q.id))
    if isinstance(q, Matrix):
        whole = F.element_at(answers, q.id)
        return {v.name: F.coalesce(F.element_at(answers, v.name), F.get_json_object(whole, f"$.{v.name}")).try_cast("long") for v in q.variables()}
    if isinstance(q, MultiChoice) or isinstance(q, Ranking):
        picked = F.coalesce(F.get_json_object(own, "$.selected"), own)
        listed = F.from_json(picked, "array<string>")
        if isinstance(q, MultiChoice) and q.mode == "wide":
            flags = {v.name: F.coalesce(F.element_at(answers, v.name).try_cast("int"), F.array_contains(F.from_json(F.element_at(answers, q.id), "array<string>"), v.name).cast("int")) for v in q.variables()}
            return flags
        codes = q.codes()
        typed = F.transform(F.filter(listed, lambda c: c != OTHER), lambda c: _typed(c, codes))
        return {name: typed} | ({f"{name}_other": F.get_json_object(own, "$.otherText")} if q.other_specify else {})
    if isinstance(q, OpenText):
        return {name: own}
    if isinstance(q, NumericInput):
        return {name: own.try_cast("double")}
    if isinstance(q, LikertScale):
        return {name: own.try_cast("long")}
    code = F.coalesce(F.get_json_object(own, "$.code"), F.when(~own.startswith("{"), own))
    out = {name: _typed(F.when(code != OTHER, code), q.codes())}
    return out | ({f"{name}_other": F.get_json_object(own, "$.text")} if q.other_specify else {})


def parsed(responses: DataFrame, questionnaire: Questionnaire, payload: str = "payload_json") -> DataFrame:
    """responses(id, payload, submitted_at) as _response_id, _submitted_at, _status and a column an answer. Works on
    batches and streams alike; payloads that are no JSON objects give nulls."""
    rows = responses.withColumn("_a", F.from_json(quoted(payload), T.MapType(T.StringType(), T.StringType())))
    columns: dict[str, Column] = {}
    for q in questionnaire.questions():
        columns |= answer_columns(q, F.col("_a"))
    head = [F.col("id").alias("_response_id"), F.col("submitted_at").alias("_submitted_at"), F.coalesce(F.element_at("_a", F.lit("__status")), F.lit("completed")).alias("_status")]
    return rows.select(*head, *[c.alias(n) for n, c in columns.items()])


def sheet_frame(rows: DataFrame, header: Sequence[str], cells: str = "cells") -> DataFrame:
    """Rows of a sheet, whose cells are an array of texts, as a column a heading. Short rows are padded with nulls and empty
    cells are null; a column becomes numeric only if all of its texts are numbers, so no text is lost."""
    shown = [F.nullif(F.get(quoted(cells), F.lit(i)), F.lit("")).alias(h) for i, h in enumerate(header)]
    table = rows.select(shown)
    odd = table.agg(*[F.count_if(quoted(h).isNotNull() & quoted(h).try_cast("double").isNull()).alias(f"n{i}") for i, h in enumerate(header)]).first()
    some = table.agg(*[F.count(quoted(h)).alias(f"n{i}") for i, h in enumerate(header)]).first()
    return table.select([quoted(h).cast("double").alias(h) if not odd[i] and some[i] else quoted(h) for i, h in enumerate(header)])


def quota_table(spark: SparkSession, quotas: Sequence[Quota]) -> DataFrame:
    return spark.createDataFrame([(q.variable, str(q.target_value), q.limit) for q in quotas], "variable string, value string, target long")


def _cell(quotas: Sequence[Quota], value_of) -> Column:
    """The first quota (its number) that a row falls under, null for none."""
    out = None
    for i, q in enumerate(quotas):
        test = quoted(q.variable).cast("string") == F.lit(str(q.target_value))
        out = F.when(test, F.lit(value_of(i, q))) if out is None else out.when(test, F.lit(value_of(i, q)))
    return F.lit(None) if out is None else out


def admitted(df: DataFrame, quotas: Sequence[Quota], order: Sequence[str] = ("_submitted_at", "_response_id"), key: str = "_response_id", current: dict | None = None) -> DataFrame:
    """df with `admitted`: whether a response came before its quota was full. Retries of a key count once, by their first
    row. Responses under no quota are admitted. current: responses stored before, by number of the quota.

    Only the first `limit` rows of each cell matter, so Spark keeps that many a task before it shuffles cells.
    """
    cell, room = _cell(quotas, lambda i, q: i).cast("int"), _cell(quotas, lambda i, q: max(0, q.limit - (current or {}).get(i, 0))).cast("long")
    keyed = df.withColumns({"_cell": cell, "_room": room})
    first = keyed.filter("_cell is not null").groupBy("_cell", "_room", quoted(key).alias("_key")).agg(F.min(F.struct(*[quoted(c) for c in order])).alias("_order"))
    most = max([max(0, q.limit) for q in quotas], default=0)
    ranked = first.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_order", "_key"))).filter(F.col("_rank") <= most)
    in_time = ranked.filter(F.col("_rank") <= F.col("_room")).select(F.col("_cell").alias("_c"), F.col("_key").alias("_k"), F.lit(True).alias("_in"))
    joined = keyed.join(in_time, (F.col("_cell") == F.col("_c")) & (quoted(key) == F.col("_k")), "left")
    return joined.withColumn("admitted", F.col("_cell").isNull() | F.coalesce("_in", F.lit(False))).drop("_cell", "_room", "_c", "_k", "_in")


def reached(df: DataFrame, quota: Quota) -> bool:
    return df.filter(quoted(quota.variable).cast("string") == str(quota.target_value)).limit(max(quota.limit, 0)).count() >= quota.limit


class ResponseStore:
    """Tables of a survey under one folder: survey_meta, responses (a folder a survey) and quota_counters."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def provision(self, questionnaire: Questionnaire, quotas: Sequence[Quota] = ()) -> str:
        survey = uuid.uuid4().hex[:12]
        meta = json.dumps(questionnaire.variable_map().to_dict(), ensure_ascii=False)
        row = self.spark.createDataFrame([(survey, questionnaire.title, meta, questionnaire.max_responses)], "survey_id string, title string, schema_json string, max_responses long")
        row.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(f"{self.folder}/survey_meta")
        if quotas:
            counters = quota_table(self.spark, quotas).select(F.lit(survey).alias("survey_id"), "variable", "value", "target", F.lit(0).cast("long").alias("current"))
            counters.write.mode("append").parquet(f"{self.folder}/quota_counters")
        return survey

    def responses_path(self, survey: str) -> str:
        return f"{self.folder}/responses/survey_id={survey}"

    def store(self, survey: str, payloads: DataFrame) -> None:
        """Appends payloads(id, payload_json, submitted_at)."""
        payloads.select(F.col("id").cast("string").alias("id"), "payload_json", F.col("submitted_at").cast("timestamp").alias("submitted_at")).write.mode("append").parquet(self.responses_path(survey))

    def responses(self, survey: str) -> DataFrame:
        """All stored payloads (no cap), unordered; order by submitted_at and id where it matters."""
        return self.spark.read.schema(RESPONSE_ROWS).parquet(self.responses_path(survey))

    def get_responses(self, survey: str, questionnaire: Questionnaire, limit: int | None = None, offset: int = 0) -> SurveyData:
        """Typed responses; with a limit, that page of them, newest first."""
        rows = parsed(self.responses(survey), questionnaire)
        if limit is not None:
            rows = rows.orderBy(F.desc("_submitted_at"), F.desc("_response_id")).offset(offset).limit(limit)
        return SurveyData(rows, questionnaire.variable_map(), questionnaire)

    def delete(self, survey: str, ids: DataFrame) -> int:
        """Deletes the responses whose id is listed in ids(id), and returns the number of files rewritten.

        Only files that hold such a response are read and rewritten, all others stay as they are. The rest of these files is
        first written aside; then a journal is left, the new files move in and the old ones go. A deletion that was
        cut off is finished by the next one (or by finish_deletion). Not for two writers at once; a reader between the
        two last steps may meet a response twice. Null ids match nothing.
        """
        self.finish_deletion(survey)
        folder, store = self.responses_path(survey), Store(self.spark, self.responses_path(survey))
        wanted = ids.select(F.col("id").cast("string").alias("id")).distinct()
        rows = self.responses(survey)
        hit = rows.select("id", F.col("_metadata.file_path").alias("file")).join(wanted, "id", "left_semi").select("file").distinct()
        files = [r["file"] for r in hit.collect()]  # names only
        if not files:
            return 0
        aside = f"_rewritten-{uuid.uuid4().hex}"
        rest = self.spark.read.schema(RESPONSE_ROWS).parquet(*files).join(wanted, "id", "left_anti")
        rest.write.parquet(f"{folder}/{aside}")
        old = [unquote(f.rsplit("/", 1)[1]) for f in files]
        store.write_text("_deletion.json", json.dumps({"aside": aside, "old": old}))
        self.finish_deletion(survey)
        return len(files)

    def finish_deletion(self, survey: str) -> bool:
        """Carries out what the journal of a deletion says, from wherever it was cut off."""
        store = Store(self.spark, self.responses_path(survey))
        if not store.exists("_deletion.json"):
            return False
        plan = json.loads(store.read_text("_deletion.json"))
        for name in store.names(plan["aside"]):
            if name.endswith(".parquet"):
                store.move(f"{plan['aside']}/{name}", name)
        for name in plan["old"]:
            store.remove(name)
        store.remove(plan["aside"])
        store.remove("_deletion.json")
        return True

    def count(self, survey: str) -> int:
        return self.responses(survey).count()

    def quota_check(self, survey: str, questionnaire: Questionnaire) -> DataFrame:
        """variable, value, target, current, open for each quota of a survey, counted from the stored responses."""
        quotas = self.spark.read.parquet(f"{self.folder}/quota_counters").filter(F.col("survey_id") == survey).drop("current", "survey_id")
        names = [r["variable"] for r in quotas.select("variable").distinct().collect()]  # a row a quota variable
        rows = parsed(self.responses(survey), questionnaire)
        cells = rows.select(F.inline(F.array(*[F.struct(F.lit(n).alias("variable"), quoted(n).cast("string").alias("value")) for n in names])))
        counts = cells.groupBy("variable", "value").agg(F.count("*").alias("current"))
        joined = quotas.join(counts, ["variable", "value"], "left").withColumn("current", F.coalesce("current", F.lit(0)))
        return joined.withColumn("open", F.col("current") < F.col("target"))
