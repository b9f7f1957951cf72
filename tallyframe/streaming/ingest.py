"""Streaming ingestion: landed JSON responses to a typed table, with retries dropped and quotas kept."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyframe.sources.questionnaire import Questionnaire, Quota
from tallyframe.sources.responses import _cell, parsed

LANDED = "id string, payload_json string, submitted_at timestamp"


def landed(spark: SparkSession, folder: str, files_per_batch: int = 1_000) -> DataFrame:
    """Responses as they land in a folder, one JSON object a line."""
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).json(folder)


def typed_responses(stream: DataFrame, questionnaire: Questionnaire, late: str = "1 day") -> DataFrame:
    """Typed answers; retries of a response id within the watermark are dropped."""
    once = stream.withWatermark("submitted_at", late).dropDuplicatesWithinWatermark(["id"])
    return parsed(once, questionnaire)


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to a Parquet folder, exactly once a row; `once` stops when all that has landed is written."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def admitted_stream(stream: DataFrame, quotas: Sequence[Quota]) -> DataFrame:
    """_response_id, cell, admitted for responses under a quota, in order of arrival (by time, then id, in a batch).

    State is one count a quota cell, so it does not grow with the stream; a retry that the watermark has let
    through would count again, as it would in any store without a key. A task holds the rows of a cell that still have a
    place (at most its limit) and one batch; all others leave at once.
    """

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def told(rows: pd.DataFrame, admitted: bool) -> pd.DataFrame:
            return pd.DataFrame({"_response_id": rows["_response_id"], "cell": key[0], "admitted": admitted})

        taken, first = state.get[0] if state.exists else 0, None
        for batch in batches:
            room = max(0, int(batch["limit"].iloc[0]) - taken)
            met = (batch if first is None else pd.concat([first, batch])).sort_values(["_submitted_at", "_response_id"])
            first = met.iloc[:room]
            if len(met) > room:
                yield told(met.iloc[room:], False)
        state.update((taken + len(first),))
        if len(first):
            yield told(first, True)

    cells = stream.withColumns({"cell": _cell(quotas, lambda i, q: i).cast("int"), "limit": _cell(quotas, lambda i, q: q.limit).cast("long")})
    rows = cells.filter("cell is not null").select("_response_id", "_submitted_at", "cell", "limit")
    return rows.groupBy("cell").applyInPandasWithState(admit, "_response_id string, cell int, admitted boolean", "taken long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts a time window and value, final once the watermark has passed the window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), F.col(by).alias("value")).agg(F.count("*").alias("n"))


def sessions(df: DataFrame, time: str, by: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of activity: events of one key with gaps below the given one. Batch or stream."""
    out = df.groupBy(F.session_window(time, gap).alias("s"), F.col(by).alias("key")).agg(F.count("*").alias("n"))
    return out.select("key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
