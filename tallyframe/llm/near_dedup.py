"""Near-duplicate classes of documents by DartMinHash signatures and banded joining.

1. Every text gets a DartMinHash signature of its 5-word shingles (weight 1 a distinct shingle, or its
   count), cut into BANDS bands of ROWS values. Equal texts are collapsed to one, known by its digest.
2. Texts that share a band's hash meet in a bucket. Every text is tied to the least texts of its buckets; the
   connected components of these ties are the candidate clusters, outside of which no two texts met.
3. Clusters go to tasks, in chunks of at most CHUNK shingles and TEXTS texts. In a chunk, two texts that share a
   bucket and are not connected yet are compared: bitmaps give an upper bound of their similarity, and where it
   reaches the threshold the exact (weighted) Jaccard similarity of the whole shingle sets decides. Only links
   leave the task. A cluster of several chunks is dealt by the least text that each of its texts met, and that
   text goes to all chunks of its group, so that near copies connect across chunks.
4. Buckets of such clusters that still hold several components are open. Their texts outside the cluster's main
   component are streamed past the chunks that hold texts of the same open buckets. So no link between two texts
   that met is lost, whatever the size of their group, and no list of pairs is ever made.

With 32 bands of 4, a pair at similarity 0.8 does not meet with probability (1 - 0.8**4)**32 = 5e-8.

Cases: null texts and texts without words are duplicates of nothing (their class is their own doc_id); texts under 5
words are one shingle of all their words; texts are compared whatever their doc_id, so different texts under one
doc_id, or under null, are judged one by one; a class is named by its least doc_id, null if none of its rows has
one; an empty table gives an empty result; other columns pass through `near_deduplicated` and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import BLANK_CLASS, small_batches, written
from tallyframe.llm.components import components
from tallyframe.llm.dartminhash import bands, signatures
from tallyframe.llm.hashing import distinct_shingles, stretches
from tallyframe.llm.packing import packed_documents, unpacked

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
CHUNK, TEXTS = 250_000, 4_000
BITS = 4_096
WORD = f"[^{BLANK_CLASS[1:]}"


def _digest(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _weights(times: np.ndarray, weighted: bool) -> np.ndarray:
    return times.astype(np.float64) if weighted else np.ones(len(times))


def signed(docs: DataFrame, weighted: bool = False, text: str = "text") -> DataFrame:
    """(doc_id, digest, n_shingles, bands): one row per row of docs; no bands for texts without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in stretches(batch.column("text")):
                element, row, times = distinct_shingles(data, offsets, SHINGLE)
                sizes = np.bincount(row, minlength=b - a)
                hashed = bands(signatures(element, row, _weights(times, weighted), b - a, BANDS * ROWS), BANDS).view(np.int64)
                ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0)))).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashed[sizes > 0].ravel()))
                part = batch.slice(a, b - a)
                yield pa.record_batch([part.column("doc_id"), part.column("digest"), pa.array(sizes, pa.int64()), cells], names=["doc_id", "digest", "n_shingles", "bands"])

    keyed = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), _digest(text).alias("digest"), F.col(text).alias("text"))
    return keyed.mapInArrow(sign, "doc_id long, digest binary, n_shingles long, bands array<bigint>")


def bucket_heads(buckets: DataFrame) -> DataFrame:
    """(id, heads): the least ids of the buckets(bucket, id) of two or more that an id is in; at most BANDS of them."""
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("bucket", "least")
    shared = written(shared, "buckets")  # read again, it leaves Spark free to split hot buckets in the join
    return written(buckets.join(shared, "bucket").groupBy("id").agg(F.collect_set("least").alias("heads")), "heads")


def candidate_edges(heads: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the ids of every bucket: each id to the least of its heads, and those to each other.
    About one edge an id, however many buckets it is in."""
    return heads.select(F.array_min("heads").alias("a"), F.explode(F.array_union("heads", F.array("id"))).alias("b")).distinct()


def shingle_sets(docs: DataFrame, members: DataFrame, text: str = "text") -> DataFrame:
    """members(id, digest, doc_id, bands, ...) with the shingle set (shingles, times) of their text in docs(doc_id, text)."""
    names = [c for c in members.columns if c not in ("digest", "doc_id")]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([unpacked(x, n) for x, n in zip(batch.column("text").to_pylist(), batch.column("n_bytes").to_pylist(), strict=True)], pa.large_binary())
            for a, b, data, offsets in stretches(texts):
                element, row, times = distinct_shingles(data, offsets, SHINGLE)
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b - a)))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (element.view(np.int64), times.astype(np.int32))]
                yield pa.record_batch([*(batch.column(n).slice(a, b - a) for n in names), *lists], names=[*names, "shingles", "times"])

    rows = packed_documents(docs.select(F.col("doc_id").cast("long").alias("_doc"), _digest(text).alias("_digest"), F.col(text).alias("text")))
    rows = rows.join(members, (F.col("_digest") == F.col("digest")) & F.col("_doc").eqNullSafe(F.col("doc_id"))).dropDuplicates(["id"])
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema if f.name in names)
    return rows.select(*names, "text", "n_bytes").mapInArrow(gather, f"{types}, shingles array<bigint>, times array<int>")


class Sets:
    """Shingle sets of some texts, with bitmaps that bound their similarities."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, weighted: bool):
        self.ids = batch["id"].to_numpy()
        self.bands = np.stack([x.values.to_numpy() for x in batch["bands"]]) if len(self.ids) else np.zeros((0, BANDS), np.int64)
        self.shingles = [x.values.to_numpy() for x in batch["shingles"]]
        self.weights = [_weights(x.values.to_numpy(), weighted) for x in batch["times"]]
        self.mass = np.array([w.sum() for w in self.weights])
        self.maps = np.zeros((len(self.ids), BITS // 64), np.uint64)
        row = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.shingles])
        bit = (np.concatenate(self.shingles).view(np.uint64) >> np.uint64(52)) if len(row) else np.zeros(0, np.uint64)
        np.bitwise_or.at(self.maps, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))

    def bounds(self, some: np.ndarray, other: Sets, i: int) -> np.ndarray:
        """Upper bounds of the similarity of other's text i to `some` of these: a bit that one map lacks is a shingle,
        of weight 1 or more, that its text lacks."""
        own, theirs = self.maps[some], other.maps[i]
        lacking = np.bitwise_count(own & ~theirs).sum(1), np.bitwise_count(theirs & ~own).sum(1)
        both = np.minimum(self.mass[some] - lacking[0], other.mass[i] - lacking[1])
        return both / np.maximum(self.mass[some] + other.mass[i] - both, 1e-9)

    def similarity(self, other: Sets, i: int, j: int) -> float:
        _, left, right = np.intersect1d(self.shingles[j], other.shingles[i], assume_unique=True, return_indices=True)
        both = np.minimum(self.weights[j][left], other.weights[i][right]).sum()
        return both / (self.mass[j] + other.mass[i] - both)


class Components:
    """Components of the members of a chunk (`of`, as numbers), and of other texts that were linked to them, by name."""

    def __init__(self, names: list):
        self.number: dict = {}
        self.of = np.array([self.number.setdefault(n, len(self.number)) for n in names], np.int64)
        self.up = list(range(len(self.number)))

    def find(self, name) -> int:
        """The number of a component, -1 if no member and no text linked to one is in it."""
        x = self.number.get(name, -1)
        while x >= 0 and self.up[x] != x:
            x = self.number[name] = self.up[x]
        return x

    def join(self, name, a: int) -> int:
        """Puts the component of this name and number a together; the number of both."""
        b = self.find(name)
        if b < 0:
            self.number[name] = b = a
        self.up[a] = b
        self.of[self.of == a] = b
        return b


class Buckets:
    """The members of a chunk by bucket."""

    def __init__(self, bands: np.ndarray):
        flat = bands.ravel()
        order = np.argsort(flat, kind="stable")
        self.values, self.members = flat[order], order // BANDS

    def of(self, bands: np.ndarray) -> np.ndarray:
        """Members that share a bucket with a text of these bands."""
        low, high = np.searchsorted(self.values, bands), np.searchsorted(self.values, bands, side="right")
        parts = [self.members[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True) if a < b]
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)

    def groups(self) -> list[np.ndarray]:
        """Members of each bucket of two or more."""
        cuts = np.flatnonzero(np.concatenate(([True], self.values[1:] != self.values[:-1], [True])))
        return [self.members[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b - a > 1]


def inner_links(sets: Sets, threshold: float) -> list[tuple]:
    """Links that connect the texts of a chunk: bucket by bucket, until the bucket is one component or all its pairs are compared."""
    label_of, out = np.arange(len(sets.ids)), []
    for group in Buckets(sets.bands).groups():
        for k, i in enumerate(group[:-1].tolist()):
            label = label_of[group]
            if (label == label[0]).all():
                break
            rest = group[k + 1 :][label[k + 1 :] != label[k]]
            bounds = sets.bounds(rest, sets, i)
            for j in rest[np.argsort(-bounds, kind="stable")[: np.count_nonzero(bounds >= threshold - 1e-9)]].tolist():
                if label_of[j] != label_of[i] and sets.similarity(sets, i, j) >= threshold - 1e-9:
                    label_of[label_of == label_of[j]] = label_of[i]
                    out.append((int(sets.ids[j]), int(sets.ids[i])))
    return out


def asked_links(members: Sets, buckets: Buckets, own: Components, asked: Sets, names: list, threshold: float) -> list[tuple]:
    """Links that connect asked texts with members of other components that share a bucket with them."""
    out = []
    for i in range(len(asked.ids)):
        mine = own.find(names[i])
        near = buckets.of(asked.bands[i])
        near = near[own.of[near] != mine]
        bounds = members.bounds(near, asked, i)
        for j in near[np.argsort(-bounds, kind="stable")[: np.count_nonzero(bounds >= threshold - 1e-9)]].tolist():
            if own.of[j] != mine and members.similarity(asked, i, j) >= threshold - 1e-9:
                mine = own.join(names[i], int(own.of[j]))
                out.append((int(members.ids[j]), int(asked.ids[i])))
    return out


def chunk_links(rows: DataFrame, weighted: bool, threshold: float) -> DataFrame:
    """Links (a, b) inside each chunk of rows(cluster, chunk, asked, id, component, bands, shingles, times).

    Rows with asked = 1 are compared with the chunk's rows with asked = 0; a chunk without any is compared with itself.
    Members of a chunk are held in memory, at most about CHUNK shingles or TEXTS texts; asked texts stream past them.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, members, buckets, names = None, [], None, None, None

        def result(links):
            return pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        def inner():
            return result(inner_links(Sets(pa.concat_tables(held), weighted), threshold))

        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("cluster", "chunk", "asked")])
            cuts = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True) if batch.num_rows else ():
                cluster, chunk, asked = (int(x) for x in keys[:, a])
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if (cluster, chunk) != key:
                    if held and members is None:
                        yield inner()
                    key, held, members = (cluster, chunk), [], None
                if asked == 0:
                    held.append(part)
                elif held:
                    if members is None:
                        table = pa.concat_tables(held)
                        members, names = Sets(table, weighted), Components(table["component"].to_pylist())
                        buckets = Buckets(members.bands)
                    yield result(asked_links(members, buckets, names, Sets(part, weighted), part["component"].to_pylist(), threshold))
        if held and members is None:
            yield inner()

    dealt = rows.repartition("cluster", "chunk").sortWithinPartitions("cluster", "chunk", "asked")
    return dealt.mapInArrow(compare, "a long, b long")


ROWS_OF_LINKS = ("cluster", "chunk", "asked", "id", "component", "bands", "shingles", "times")


def _first_rows(sets: DataFrame) -> DataFrame:
    """Every text in one chunk. Clusters of several chunks are dealt by head, and the head goes to all chunks of its group."""
    whole = sets.filter("chunks = 1").withColumn("first", F.lit(0).cast("long"))
    wide = sets.filter("chunks > 1")
    groups = wide.groupBy("head").agg(_chunks().alias("parts"))
    dealt = wide.join(groups, "head").withColumn("first", F.xxhash64("head", F.pmod(F.xxhash64("id"), F.col("parts"))))
    heads = wide.drop("head").join(groups.withColumnRenamed("head", "id"), "id").withColumn("head", F.col("id"))
    heads = heads.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    heads = heads.withColumn("first", F.xxhash64("head", "part")).filter((F.col("parts") > 1) | (F.col("own_head") != F.col("id")))
    heads = heads.filter((F.col("own_head") != F.col("id")) | (F.pmod(F.xxhash64("id"), F.col("parts")) != F.col("part")))
    rows = [x.withColumns({"asked": F.lit(0), "component": F.col("id"), "chunk": F.col("first")}).select(*ROWS_OF_LINKS) for x in (whole, dealt, heads)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _chunks():
    """Number of chunks of a group of texts."""
    return F.greatest(F.ceil(F.sum("n") / CHUNK), F.ceil(F.count("*") / TEXTS)).cast("long")


def _open_rows(sets: DataFrame, labels: DataFrame) -> DataFrame | None:
    """What is left to compare in clusters of several chunks: the texts of open buckets once, and those of them outside
    the main component once more for every chunk that holds texts of the same open buckets."""
    many = sets.filter("chunks > 1").select("id", "cluster", "chunks", "bands")
    named = many.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = named.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    cells = named.select("cluster", "id", "component", "chunk", F.explode("bands").alias("bucket"))
    mixed = cells.groupBy("cluster", "bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("cluster", "bucket")
    cells = written(cells.join(mixed, ["cluster", "bucket"]), "open-buckets")
    if cells.isEmpty():
        return None
    sizes = named.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    # a row a cluster of several chunks: read again, small enough to leave the cells where they are
    main = written(sizes.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main")), "main-components")
    outside = cells.join(main, "cluster").filter("component <> main").select("cluster", "bucket", "id", "component")
    places = cells.select("cluster", "bucket", "chunk").distinct()
    asked = outside.join(places, ["cluster", "bucket"]).select("id", "component", "chunk").distinct().withColumn("asked", F.lit(1))
    own = cells.select("id", "component", "chunk").distinct().withColumn("asked", F.lit(0))
    return sets.join(own.unionByName(asked), "id").select(*ROWS_OF_LINKS)


def near_deduplicated(docs: DataFrame, weighted: bool = False, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with one document of each class: that with the least doc_id (the least digest among equal ids, and a text without
    any id where no text of the class has one). Rows without words stay; rows equal in doc_id and text are one document, so they
    stay or go together; of equal texts without an id one row stays."""
    _, named = _text_classes(docs, weighted, threshold, text)
    kept = named.filter("first").select(F.col("digest").alias("_kept"), F.col("doc_id").alias("_of"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), _digest(text).alias("_digest"), F.col("doc_id").cast("long").alias("_id"), F.col(text).rlike(WORD).alias("_worded"))
    judged = rows.join(kept, (F.col("_digest") == F.col("_kept")) & F.col("_id").eqNullSafe(F.col("_of")), "left").filter("_kept is not null or not coalesce(_worded, false)")
    nameless = "_id is null and coalesce(_worded, false)"
    out = judged.filter(f"not ({nameless})").select("_doc").unionByName(judged.filter(nameless).groupBy("_digest").agg(F.first("_doc").alias("_doc")).select("_doc"))
    return out.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def near_classes(docs: DataFrame, weighted: bool = False, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """(doc_id, class_id) for every row of docs(doc_id, text); class_id is the least doc_id of its class."""
    rows, named = _text_classes(docs, weighted, threshold, text)
    alone = rows.filter("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"))
    worded = rows.filter("n_shingles > 0").select("doc_id", "digest")
    return worded.join(named.select("digest", "class_id"), "digest").select("doc_id", "class_id").unionByName(alone)


def _text_classes(docs: DataFrame, weighted: bool, threshold: float, text: str) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (digest, doc_id, class_id, first) of every text with words: its least doc_id, its class, and
    whether it is the first text of the class."""
    rows = written(signed(docs, weighted, text), "signed")
    texts = rows.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("n_shingles", "bands")).alias("one"))
    texts = written(texts.select(F.monotonically_increasing_id().alias("id"), "digest", "doc_id", F.col("one.n_shingles").alias("n"), "one.bands"), "texts")
    heads = bucket_heads(texts.select(F.explode("bands").alias("bucket"), "id"))
    clusters = components(candidate_edges(heads)).toDF("id", "cluster")
    members = texts.join(clusters, "id").join(heads.select("id", F.array_min("heads").alias("head")), "id").withColumn("own_head", F.col("head"))
    # few clusters have several chunks; read again, their table is small enough to leave the members where they are
    many = written(members.groupBy("cluster").agg(_chunks().alias("chunks")).filter("chunks > 1"), "wide-clusters")
    members = members.join(many, "cluster", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    sets = written(shingle_sets(docs, members, text), "shingle-sets")
    links = written(chunk_links(_first_rows(sets), weighted, threshold), "links")
    labels = components(links)
    rest = _open_rows(sets, labels)
    if rest is not None:
        links = links.unionByName(written(chunk_links(rest, weighted, threshold), "links"))
        labels = components(links)
    named = texts.select("id", "digest", "doc_id").join(labels.toDF("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = written(named, "text-classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    classes = named.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.min(order).alias("least"))
    named = named.join(classes, "component").select("digest", "doc_id", "class_id", (F.col("digest") == F.col("least.digest")).alias("first"))
    return rows, named
