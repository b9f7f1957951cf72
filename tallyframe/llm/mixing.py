"""Mixing sources to target weights, by exact quotas of permuted blocks and a hypergeometric splitting tree.

Sizes are words. Every document has a 63-bit key (a seeded hash), which is its place in a random permutation
of its source; blocks are equal ranges of keys, and their number grows with the mix, so that a shard holds many of
them. A source's target is a number of whole passes over it and a remainder, whose quota of blocks, in order of the
permutation, is what fits. The block where it ends is refined once more the same way, and from there
single documents are taken, in order of size from the largest, as long as they fit, out of about WINDOW
documents that follow: so quotas are met to within a small document, whole documents at a time.

The quotas are then dealt to output shards: at each node of a binary tree over the shards, the node's quotas of all
sources are split by a draw from the multivariate hypergeometric distribution, so every shard gets a random but exact
share of every source. Shard j draws the blocks of a source that follow, in the permutation, those of the shards before
it; so draws are disjoint, and each shard is shuffled by itself. A document is taken as often as shards draw its block.

The driver holds one row a source and the top NODES nodes of the tree; the subtrees below them are split by Spark tasks,
and shards meet blocks by rank. What grows with the documents stays in Spark; windows run over a source's
blocks, some SHARD_BLOCKS a shard.
Reruns agree: all draws are seeded.

Cases: a null text has size 0; documents of size 0 are taken with their block or not at all, which changes no quota; a null
source is a source (the last); repeated rows are documents of their own; a source of size 0 has target 0;
an empty table gives an empty result; other columns pass through `mixed`, but for columns named copy, shard or
position, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import n_words_of, written

LEAST_BITS, MOST_BITS, KEY_BITS = 12, 28, 63
SHARD_BLOCKS, NODES = 16, 256
WINDOW, CLOSE = 1_024, 48
MOST_PASSES = 2.0
SHARD_WORDS, LEAST_SHARDS = 20_000_000, 64


def targets(sizes: dict, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = MOST_PASSES) -> dict:
    """Target size of each source: `share` of all sizes dealt by weight (sources by code point, null last, weights
    repeating); no target is above `most` times its source, the excess being dealt again by weight."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, out = set(names), {}
    left = share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not above:
            return out | {s: unit * weight[s] for s in open_}
        out |= {s: most * float(sizes[s]) for s in above}
        left -= sum(out[s] for s in above)
        open_ -= above
    return out


def halves(low: int, high: int, own: np.ndarray, seed: int):
    """The middle of shards low..high and what of the node's quotas falls to its left half. The draw depends on the node alone."""
    middle = (low + high) // 2
    total = int(own.sum())
    draw = np.random.default_rng([seed, low, high])
    # the exact method counts in memory, the marginals one handles any number of blocks
    return middle, draw.multivariate_hypergeometric(own, total * (middle - low) // (high - low), method="marginals") if total else own


def frontier(shards: int, quotas: np.ndarray, seed: int, most: int) -> list[tuple]:
    """The tree's nodes (low, high, quotas, first ranks) at the first depth with `most` nodes, or its leaves."""
    nodes = [(0, shards, quotas.astype(np.int64), np.zeros(len(quotas), np.int64))]
    while len(nodes) < most and any(high - low > 1 for low, high, _, _ in nodes):
        nodes = [x for node in nodes for x in children(*node, seed)]
    return nodes


def children(low, high, own, start, seed) -> list[tuple]:
    if high - low == 1:
        return [(low, high, own, start)]
    middle, left = halves(low, high, own, seed)
    return [(low, middle, left, start), (middle, high, own - left, start + left)]


def leaves(low, high, own, start, seed) -> Iterator[tuple]:
    """(shard, quotas, first ranks) of the shards under a node."""
    stack = [(low, high, own, start)]
    while stack:
        node = stack.pop()
        if node[1] - node[0] == 1:
            yield node[0], node[2], node[3]
        else:
            stack += reversed(children(*node, seed))


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): quotas of blocks dealt down the whole tree."""
    return np.array([own for _, own, _ in leaves(0, shards, quotas.astype(np.int64), np.zeros(len(quotas), np.int64), seed)]).reshape(shards, len(quotas))


def dealt_ranks(spark: SparkSession, quotas: np.ndarray, shards: int, seed: int) -> DataFrame:
    """(k, rank, shard): the shard of every block of quota k, by its rank (from 1) in the permutation."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, own, start in zip(*(batch.column(n).to_pylist() for n in ("low", "high", "own", "start")), strict=True):
                for shard, mine, first in leaves(low, high, np.array(own, np.int64), np.array(start, np.int64), seed):
                    k = np.flatnonzero(mine)
                    yield pa.record_batch([pa.array(k, pa.int64()), pa.array(first[k]), pa.array(mine[k]), pa.array(np.full(len(k), shard))], names=["k", "first", "n", "shard"])

    nodes = [(low, high, own.tolist(), start.tolist()) for low, high, own, start in frontier(shards, quotas, seed, NODES)]
    rows = spark.createDataFrame(nodes, "low long, high long, own array<long>, start array<long>").repartition(min(len(nodes), 64))
    rows = rows.mapInArrow(deal, "k long, first long, n long, shard long")
    return rows.select("k", F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("n"))).alias("rank"), "shard")


def block_of(key: Column, bits: int) -> Column:
    return F.shiftright(key, KEY_BITS - bits)


def keyed(docs: DataFrame, seed: int, text: str = "text") -> DataFrame:
    """(doc_id, source, size, key) of docs(doc_id, source, text), written once: texts are read one time only."""
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", text), 1)
    return written(docs.select("doc_id", "source", n_words_of(F.col(text)).alias("size"), key.alias("key")), "mix-keys")


def _ends(blocks: DataFrame, quota: str) -> DataFrame:
    """The first block of each source that does not fit into its quota, with what is left of the quota there."""
    order = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    return before.filter(F.col("before") + F.col("words") > F.col(quota)).groupBy("source").agg(F.min_by(F.struct("block", (F.col(quota) - F.col("before")).alias("left")), "block").alias("e")).select("source", "e.*")


def _same(a: str, b: Column) -> Column:
    return F.col(a).eqNullSafe(b)


def best_subset(sizes: list[int], quota: int) -> list[int]:
    """Indices of a subset whose sum is as near to the quota as possible without passing it (sums in units of a millionth of
    the quota where that is above 1)."""
    unit = max(1, quota // 1_000_000)
    room, reached = quota // unit, [1]
    scaled = [-(-x // unit) for x in sizes]
    for x in scaled:
        reached.append((reached[-1] | reached[-1] << x) & ((1 << (room + 1)) - 1))
    at, chosen = reached[-1].bit_length() - 1, []
    for i in range(len(scaled) - 1, -1, -1):
        if not reached[i] >> at & 1:
            chosen.append(i)
            at -= scaled[i]
    return chosen


def _fill(frame: pd.DataFrame) -> pd.DataFrame:
    """Chooses among the documents around the cut: the best subset of the first CLOSE in order of keys, then of the others
    the largest that fit, as long as any fits."""
    frame = frame[frame["size"] > 0].sort_values(["key", "doc_id"]).reset_index(drop=True)
    if frame.empty:
        return frame[["source", "key", "doc_id"]]
    left = int(frame["left"].iloc[0]) + int(frame["size"][frame["key"] < frame["cut"]].sum())
    size = frame["size"].tolist()
    chosen = best_subset(size[:CLOSE], left)
    left -= sum(size[i] for i in chosen)
    for i in sorted(range(CLOSE, len(size)), key=lambda i: (-size[i], i)):
        if size[i] <= left:
            chosen.append(i)
            left -= size[i]
    return frame.loc[sorted(chosen), ["source", "key", "doc_id"]]


class Plan:
    """What a mix takes. `rows`: (doc_id, source, size, key, copies), one row a document."""

    def __init__(self, docs: DataFrame, seed: int = 11, text: str = "text", weights: tuple = (5, 2, 1), share: float = 1.5):
        spark = docs.sparkSession
        self.seed, self.keys = seed, keyed(docs, seed, text)
        sums = self.keys.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()  # a row a source
        self.sizes = {r["source"]: r["words"] for r in sums}
        self.targets = targets(self.sizes, weights, share)
        # SHARD_BLOCKS blocks of the largest source for every shard's worth of its words
        blocks = SHARD_BLOCKS * max(self.sizes.values(), default=0) // SHARD_WORDS
        self.bits = min(MOST_BITS, max(LEAST_BITS, int(blocks).bit_length()))
        blocks = self.keys.groupBy("source", block_of(F.col("key"), self.bits).alias("block")).agg(F.sum("size").alias("words"))
        self.blocks = written(blocks, "mix-blocks")
        rows = [(s, int(n), float(self.targets[s]), int(self.targets[s] // n) if n else 0, float(self.targets[s] - self.targets[s] // n * n) if n else 0.0) for s, n in self.sizes.items()]
        docs_of = {r["source"]: r["docs"] for r in sums}
        schema = "source string, source_size long, target double, passes long, quota double, width long"
        self.sources = spark.createDataFrame([(*r, min((1 << KEY_BITS) - 1, WINDOW * (1 << KEY_BITS) // max(docs_of[r[0]], 1))) for r in rows], schema)
        self.rows = self._rows()

    def _rows(self) -> DataFrame:
        own = self.sources.withColumnRenamed("source", "_s")
        named = self.blocks.join(own, _same("source", F.col("_s"))).select("source", "block", "words", "quota")
        first = _ends(named, "quota")
        first = written(first, "mix-ends")
        at = first.select(F.col("source").alias("_s"), F.col("block").alias("end"), F.col("left").alias("rest"))
        inside = self.keys.join(at, _same("source", F.col("_s")) & (block_of(F.col("key"), self.bits) == F.col("end")))
        fine = inside.groupBy("source", block_of(F.col("key"), 2 * self.bits).alias("block")).agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
        second = _ends(fine, "rest").select(F.col("source").alias("_s"), F.shiftleft("block", KEY_BITS - 2 * self.bits).alias("cut"), F.col("left").alias("left"))
        cuts = written(own.join(second.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t"), "mix-cuts")
        # a row a source: documents well below `cut` are in the remainder, those around it are chosen to fill it up
        all_ = self.keys.join(cuts, _same("source", F.col("_s"))).withColumn("sure", F.col("cut") - F.shiftright("width", 5))
        near = all_.filter((F.col("key") >= F.col("sure")) & (F.col("key") - F.col("cut") < F.col("width")))
        near = near.groupBy("source", "key", "doc_id", "left", "cut").agg(F.sum("size").alias("size"))  # equal rows go together
        extra = near.groupBy("source").applyInPandas(_fill, "source string, key long, doc_id long")
        extra = written(extra.distinct(), "mix-extra").select(F.col("key").alias("_k"), F.col("doc_id").alias("_d"), F.col("source").alias("_x"), F.lit(1).alias("extra"))
        whole = F.when(F.col("cut").isNull(), F.lit(0)).otherwise((F.col("key") < F.col("sure")).cast("int"))
        taken = all_.join(extra, (F.col("key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")) & _same("source", F.col("_x")), "left")
        return taken.select("doc_id", "source", "size", "key", "source_size", "target", (F.col("passes") + whole + F.coalesce("extra", F.lit(0))).alias("copies"))

    def shard_count(self) -> int:
        """SHARD_WORDS words a shard, LEAST_SHARDS at least."""
        return max(LEAST_SHARDS, -(-int(sum(self.targets.values())) // SHARD_WORDS))

    def shards(self, n: int) -> DataFrame:
        """(doc_id, source, size, key, copy, shard): the copies of all documents and the shard of each."""
        copies = written(self.rows.filter("copies > 0").select("doc_id", "source", "size", "key", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), block_of(F.col("key"), self.bits).alias("block")), "mix-copies")
        taken = copies.select("source", "copy", "block").distinct()
        ranked = written(taken.withColumn("rank", F.row_number().over(Window.partitionBy("source", "copy").orderBy("block"))), "mix-ranks")
        quotas = {(r["source"], r["copy"]): r["n"] for r in ranked.groupBy("source", "copy").agg(F.max("rank").alias("n")).collect()}
        names = sorted(quotas, key=lambda x: (x[0] is None, x[0] or "", x[1]))
        spark = self.keys.sparkSession
        named = spark.createDataFrame([(*x, k) for k, x in enumerate(names)], "_s string, _c int, k long")
        ranked = ranked.join(named, _same("source", F.col("_s")) & (F.col("copy") == F.col("_c"))).select("k", "rank", "_s", "_c", F.col("block").alias("_b"))
        where = ranked.join(dealt_ranks(spark, np.array([quotas[x] for x in names], np.int64), n, self.seed), ["k", "rank"]).select("_s", "_c", "_b", "shard")
        return copies.join(where, _same("source", F.col("_s")) & (F.col("copy") == F.col("_c")) & (F.col("block") == F.col("_b"))).select("doc_id", "source", "size", "key", "copy", "shard")


def taken(docs: DataFrame, shards: int | None = None, seed: int = 11, text: str = "text") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, shards): what the mix takes of every document, counted
    over the shards that its copies were dealt to."""
    plan = Plan(docs, seed, text)
    dealt = plan.shards(shards or plan.shard_count()).dropDuplicates(["source", "key", "doc_id", "copy"])
    drawn = dealt.groupBy(F.col("source").alias("_s"), F.col("key").alias("_k"), F.col("doc_id").alias("_d")).agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    rows = plan.rows.join(drawn, _same("source", F.col("_s")) & (F.col("key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    copies = F.when(F.col("shards").isNull(), F.lit(0)).otherwise(F.size("shards")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "shards")


def mixed(docs: DataFrame, shards: int | None = None, seed: int = 11, text: str = "text") -> DataFrame:
    """The mixed corpus: docs repeated as often as they are taken, with `copy`, `shard` and `position` (a random
    order key inside the shard). Unless given, the number of shards follows the size of the mix."""
    plan = Plan(docs, seed, text)
    shards = shards or plan.shard_count()
    dealt = plan.shards(shards).select(F.col("key").alias("_k"), F.col("doc_id").alias("_d"), F.col("source").alias("_s"), "copy", "shard").distinct()
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", text), 1)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), key.alias("_key"))
    own = lambda a, b: F.col(f"_doc.{a}").eqNullSafe(F.col(b))
    rows = rows.join(dealt, (F.col("_key") == F.col("_k")) & own("doc_id", "_d") & own("source", "_s"))
    added = {"copy": F.col("copy").cast("int"), "shard": F.col("shard").cast("int"), "position": F.xxhash64(F.lit(seed), "_key", "copy", "shard")}
    kept = [F.col(f"_doc.`{c}`") for c in docs.columns if c not in added]
    out = rows.select(*kept, *[c.alias(n) for n, c in added.items()])
    return out.repartition("shard").sortWithinPartitions("shard", "position")
