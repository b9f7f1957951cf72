"""Streams with state of their own: quotas that no retry fills twice, and tables that keep the latest row of each key."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from tallyframe.functions.columns import quoted
from tallyframe.sources.questionnaire import Quota
from tallyframe.sources.responses import _cell
from tallyframe.sources.storage import Store

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Streams started from now on keep state in RocksDB, which stateful processors need; running and resumed ones keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


#: Ids of one entry of the state: few calls for many ids, and little to write again when one is added.
BLOCK = 2_000
#: Rows that are compared with the first ones at once, at least; as many as there are places where those are more.
AT_ONCE = 100_000


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """By time, then id; rows without a time last."""
    keys = pa.table({c: pa.array(rows[c], from_pandas=True) for c in ("submitted", "response")})
    return rows.take(pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names]).to_numpy())


class Admission(StatefulProcessor):
    """Counts a cell's admitted responses and remembers their ids, so that a retry, however late, never counts again.

    State of a cell: one number, and at most `limit` ids in blocks. An id expires when a response of its cell is submitted `keep` days
    after it (the count stays). Turned down ids are not kept: a retry of one is turned down again.
    """

    def __init__(self, keep: float):
        self.keep = pd.Timedelta(days=keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "taken long")
        self.ids = handle.getMapState("ids", "block long", "ids array<string>, submitted array<long>")

    def _known(self) -> pd.DataFrame:
        """Ids of the cell with their time in microseconds and their block; at most the limit."""
        blocks = [pd.DataFrame({"response": v[0], "submitted": v[1], "block": k[0]}) for k, v in self.ids.iterator()]
        return pd.concat(blocks, ignore_index=True) if blocks else pd.DataFrame({"response": [], "submitted": np.array([], "int64"), "block": np.array([], "int64")})

    def _keep(self, known: pd.DataFrame, first: pd.DataFrame, latest: pd.Timestamp | None) -> None:
        """Writes the blocks that new ids or expired ones change."""
        gone = np.zeros(len(known), bool)
        if pd.notna(latest):
            gone = ((known["submitted"] < (latest - self.keep).value // 1_000) & (known["submitted"] != pd.NaT.value)).to_numpy(bool)
        rest, last = known[~gone], 0 if known.empty else int(known["block"].max())
        at = first["submitted"].astype("datetime64[us]").astype("int64")
        block = last + ((rest["block"] == last).sum() + np.arange(len(first))) // BLOCK
        added = pd.DataFrame({"response": first["response"], "submitted": at, "block": block})
        kept = pd.concat([rest, added]) if len(rest) else added
        touched = {*known["block"][gone], *added["block"]}
        for n, rows in kept[kept["block"].isin(touched)].groupby("block"):
            self.ids.updateValue((int(n),), (rows["response"].tolist(), rows["submitted"].tolist()))
        for n in touched - set(kept["block"]):
            self.ids.removeKey((int(n),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        def told(some: pd.DataFrame, status: str) -> Iterator[pd.DataFrame]:
            for k in range(0, len(some), AT_ONCE):
                yield pd.DataFrame({"_response_id": some["response"].iloc[k : k + AT_ONCE], "cell": key[0], "status": status})

        taken = self.taken.get()[0] if self.taken.exists() else 0
        known = self._known()
        index = pd.Index(known["response"], dtype=object)
        latest = first = None
        again_here = []  # rows of an id that has a candidate in this batch
        held, waiting = [], 0  # rows that were not yet compared with the first ones

        def compared() -> Iterator[pd.DataFrame]:
            nonlocal first, held, waiting
            met = _in_order(pd.concat(held if first is None else [first, *held], ignore_index=True))
            twice = met.duplicated("response")
            if twice.any():  # the earlier row stands
                again_here.append(met[twice])
                met = met[~twice]
            first, held, waiting = met.iloc[:room], [], 0
            yield from told(met.iloc[room:], "full")

        for batch in rows:
            times = batch["submitted"].max()
            latest = times if latest is None or times > latest else latest
            latest = None if pd.isna(latest) else latest
            room = max(0, int(batch["limit"].iloc[0]) - taken)
            again = index.get_indexer(batch["response"]) >= 0
            yield from told(batch[again], "retry")
            held.append(batch[~again])
            waiting += len(held[-1])
            if waiting >= max(room, AT_ONCE):
                yield from compared()
        if waiting:
            yield from compared()
        for some in again_here:
            admitted = some["response"].isin(first["response"])
            for part, status in ((some[admitted], "retry"), (some[~admitted], "full")):
                yield from told(part, status)
        if first is None:
            first = pd.DataFrame({"response": [], "submitted": np.array([], "datetime64[us]")})
        self._keep(known, first, latest)
        if len(first):
            self.taken.update((taken + len(first),))
            yield from told(first, "admitted")

    def close(self) -> None:
        pass


def admitted_once(stream: DataFrame, quotas: Sequence[Quota], keep_days: float = 90) -> DataFrame:
    """_response_id, cell, status ("admitted", "full" or "retry") for responses under a quota, in order of arrival (by time,
    then id, in a batch). Responses without an id count each. A retry of an admitted id is told as such within keep_days; of two
    rows of one id in a batch the earlier one counts. A task holds the open places of a cell and as many rows
    again, AT_ONCE at least.
    """
    keep_state_on_disk(stream.sparkSession)
    cells = stream.withColumns({"cell": _cell(quotas, lambda i, q: i).cast("int"), "limit": _cell(quotas, lambda i, q: q.limit).cast("long")})
    named = F.coalesce("_response_id", F.concat(F.lit("without id "), F.uuid()))
    rows = cells.select(named.alias("response"), F.col("_submitted_at").alias("submitted"), "cell", "limit")  # names that pandas keeps
    rows = rows.filter("cell is not null")  # above the made-up ids, which keep it from parsing the payload again for every mention of an answer
    return rows.groupBy("cell").transformWithStateInPandas(
        Admission(keep_days), outputStructType="_response_id string, cell int, status string", outputMode="Append", timeMode="None"
    )


class LatestTable:
    """The latest row of each key, kept up by micro-batches in a folder.

    Keys are dealt to a fixed number of buckets; a batch rewrites only those that it touches into files of its own, then a
    small state file names, for each bucket, the folder that holds it. Readers follow the newest state file, so they see a batch
    whole or not at all; a batch that is played again finds its number in the state and changes nothing, and files
    of a batch that failed are named by no state. Later means greater in `order`; rows with a null key are one key.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, order: Sequence[str], buckets: int = 64):
        self.spark, self.folder, self.key, self.order, self.buckets = spark, folder.rstrip("/"), key, list(order), buckets
        self.store = Store(spark, self.folder)

    def _state(self) -> dict:
        names = [n for n in self.store.names("state") if n.endswith(".json")]
        return json.loads(self.store.read_text(f"state/{names[-1]}")) if names else {"batch": -1, "buckets": {}, "schema": None}

    def _latest(self, rows: DataFrame) -> DataFrame:
        whole = F.struct(*[quoted(c) for c in rows.columns])
        last = rows.groupBy(quoted(self.key).alias("_k")).agg(F.max_by(whole, F.struct(*[quoted(c) for c in self.order])).alias("_row"))
        return last.select("_row.*")

    def _read(self, state: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        paths = [f"{self.folder}/data/{run}/_b={b}" for b, run in state["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        state = self._state()
        if state["schema"] is None:
            raise ValueError(f"{self.folder} holds no batch yet")
        return self._read(state)

    def upsert(self, batch: DataFrame, number: int) -> bool:
        """Takes a batch in, unless one of this number or a later one is in already."""
        state = self._state()
        if number <= state["batch"]:
            return False
        bucket = F.pmod(F.xxhash64(quoted(self.key)), F.lit(self.buckets)).cast("int").alias("_b")
        fresh = self._latest(batch).persist(StorageLevel.MEMORY_AND_DISK)
        touched = {r[0] for r in fresh.select(bucket).distinct().collect()}  # at most `buckets` rows
        if touched:
            state["schema"] = state["schema"] or json.dumps(fresh.schema.jsonValue())
            run = f"batch-{number}-{uuid.uuid4().hex[:8]}"
            merged = self._latest(self._read(state, touched).unionByName(fresh)).withColumn("_b", bucket)
            merged.repartition(min(self.buckets, len(touched)), "_b").write.partitionBy("_b").parquet(f"{self.folder}/data/{run}")
            state["buckets"] |= {str(b): run for b in touched}
        fresh.unpersist()
        self.store.write_text(f"state/{number:012d}.json", json.dumps(state | {"batch": number}))
        return True

    def keep_up(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Every micro-batch of a stream taken in; `once` stops when all that has landed is in."""
        writer = stream.writeStream.outputMode("update").foreachBatch(lambda rows, number: self.upsert(rows, number) and None)
        writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

    def remove_old(self) -> int:
        """Deletes states before the newest and folders that it does not name; returns their number. Not while readers of
        an older state are at work."""
        state = self._state()
        newest = f"{state['batch']:012d}.json"
        gone = [f"state/{n}" for n in self.store.names("state") if n != newest] + [f"data/{n}" for n in self.store.names("data") if n not in set(state["buckets"].values())]
        for name in gone:
            self.store.remove(name)
        return len(gone)
