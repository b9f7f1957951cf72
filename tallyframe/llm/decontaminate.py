"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are partitioned by their number of shingles into classes [2**c, 2**(c+1)). For a class, documents
are read as overlapping stretches of 2**(c+2) shingles, so that a whole item of the class lies inside some
stretch, and a containment of T becomes a Jaccard similarity of at least T / (4 + 1 - T). The number of rows
a band needs follows from that bound (`tuned`). Item signatures form the index; documents are the queries.
A stretch whose band equals an item's makes a candidate; candidates are verified by the containment of the item's
shingles in the whole document, first by hash and then word by word.

Items of fewer than SHINGLE words are a size class each: such an item is one shingle of all its words, looked up among
the documents' runs of as many words.

A stretch can only share a minimum with an item if it holds the shingle that gives the item's minimum, so
signatures are computed just for documents that hold one of those shingles.

Items go to the tasks in blocks of at most BLOCK_SHINGLES shingles (8 bytes each, and as much again for
signatures), every block against all documents; one block serves any usual benchmark.

Cases: null and blank items are contained in nothing; an item of fewer than 5 words is found wherever those words
follow each other; equal items are all reported; null ids are kept; every row is judged by its own text, and
`contained_items` has one row for a doc_id and item, with the most shingles that a row of that doc_id shares; empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import small_batches
from tallyframe.llm.hashing import distinct_shingles, mix, slice_hashes, stretches, word_places, word_windows, words

SHINGLE, THRESHOLD, HASHES = 5, 0.8, 64
BLOCK_SHINGLES = 2_000_000
SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def tuned(jaccard: float, hashes: int = HASHES, missed: float = 1e-5) -> int:
    """Most rows a band may have so that a pair at this similarity is missed with at most the given probability."""
    best = 1
    for rows in range(1, 9):
        if (1 - jaccard**rows) ** (hashes // rows) <= missed:
            best = rows
    return best


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per seed, the minimum of seeded hashes over values[starts[i]:starts[i+1]]."""
    return np.stack([np.minimum.reduceat(mix(values ^ seed), starts) for seed in SEEDS], axis=1)


def band_keys(signature: np.ndarray, rows: int, kind: int) -> np.ndarray:
    """Hashes of bands of `rows` values; the band's number and the size class are part of them."""
    n = signature.shape[1] // rows
    out = np.broadcast_to(mix(np.arange(n, dtype=np.uint64) + np.uint64(1000 * (kind + 1))), (len(signature), n)).copy()
    for j in range(rows):
        out = mix(out + signature[:, j : n * rows : rows])
    return out


class ItemIndex:
    """Signatures and shingles of one block of items."""

    def __init__(self, texts: list, threshold: float = THRESHOLD):
        element, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short: dict[int, list] = {}
        self.words = [(t or "").encode().split() for t in texts]  # bytes are split at the six ASCII blanks
        for a, _, data, offsets in stretches(pa.array(texts, pa.string())):
            e, r, _ = distinct_shingles(data, offsets, SHINGLE)
            whole = np.array([len(self.words[a + i]) >= SHINGLE for i in r.tolist()], bool)
            element, row = np.concatenate((element, e[whole])), np.concatenate((row, r[whole] + a))
            word, own = words(data, offsets)
            for n in range(1, SHINGLE):
                key, at = word_windows(word, own, n)
                short.setdefault(n, []).extend((k, a + i) for k, i in zip(key.tolist(), own[at].tolist(), strict=True) if len(self.words[a + i]) == n)
        self.short = {n: (np.array([k for k, _ in sorted(found)], np.uint64), np.array([i for _, i in sorted(found)])) for n, found in short.items() if found}
        self.threshold = threshold
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
        self.items = row[starts]
        self.shingles, self.ends = element, np.append(starts, len(element))
        sizes = np.diff(self.ends)
        self.classes, keys, owners, telling = {}, [], [], []
        if len(starts):
            signature = minima(element, starts)
            of = np.floor(np.log2(sizes)).astype(int)
            for kind in np.unique(of):
                rows = tuned(threshold / (5 - threshold))
                self.classes[int(kind)] = rows
                mine = np.flatnonzero(of == kind)
                found = band_keys(signature[mine], rows, int(kind))
                keys.append(found.ravel())
                owners.append(np.repeat(mine, found.shape[1]))
            for seed, column in zip(SEEDS, signature.T, strict=True):
                hashed = mix(element ^ seed)
                telling.append(np.unique(element[hashed == column[np.searchsorted(starts, np.arange(len(element)), side="right") - 1]]))
        order = np.argsort(np.concatenate(keys), kind="stable") if keys else np.zeros(0, np.int64)
        self.keys = np.concatenate(keys)[order] if keys else np.zeros(0, np.uint64)
        self.owners = np.concatenate(owners)[order] if keys else np.zeros(0, np.int64)
        self.telling = np.unique(np.concatenate(telling)) if telling else np.zeros(0, np.uint64)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.telling >> np.uint64(42)).astype(np.int64)] = True

    def hints(self, element: np.ndarray) -> np.ndarray:
        """Which shingles give some item a minimum."""
        maybe = self.bits[(element >> np.uint64(42)).astype(np.int64)]
        at = np.flatnonzero(maybe)
        if len(at):
            near = np.minimum(np.searchsorted(self.telling, element[at]), len(self.telling) - 1)
            maybe[at] = self.telling[near] == element[at]
        return maybe

    def candidates(self, element: np.ndarray) -> list[int]:
        """Places in `items` of those that may be contained in a document given by its shingles in order."""
        found = set()
        for kind, rows in self.classes.items():
            step = 2 ** (kind + 1)
            blocks = minima(element, np.arange(0, len(element), step))
            stretch = np.minimum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks
            keys = np.unique(band_keys(stretch, rows, kind))
            low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
            for a, b in zip(low[low < high], high[low < high], strict=True):
                found.update(self.owners[a:b].tolist())
        out, whole = [], np.unique(element)
        for i in sorted(found):
            own = self.shingles[self.ends[i] : self.ends[i + 1]]
            near = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
            if (whole[near] == own).sum() >= self.threshold * len(own) - 1e-9:
                out.append(i)
        return out

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, its shingles, shared) of the items contained in the texts of a column."""
        for a, _, data, offsets in stretches(column):
            start, stop, row = word_places(data, offsets)
            word = slice_hashes(data, start, stop)
            spelled = lambda p, n: b" ".join(data[start[q] : stop[q]].tobytes() for q in range(p, p + n))
            for n, (keys, owners) in self.short.items():
                element, at = word_windows(word, row, n)
                hit = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, element), len(keys) - 1)] == element)
                held: set[tuple[int, int]] = set()
                for h in hit.tolist():
                    here, text = int(row[at[h]]), spelled(int(at[h]), n)
                    for k in range(int(np.searchsorted(keys, element[h])), int(np.searchsorted(keys, element[h], side="right"))):
                        i = int(owners[k])
                        if (here, i) not in held and text == b" ".join(self.words[i]):
                            held.add((here, i))
                            yield a + here, i, 1, 1
            element, at = word_windows(word, row, SHINGLE)
            own = row[at]
            hit = np.unique(own[self.hints(element)])
            low, high = np.searchsorted(own, hit), np.searchsorted(own, hit, side="right")
            for r, x, y in zip(hit.tolist(), low.tolist(), high.tolist(), strict=True):
                for i in self.candidates(element[x:y]):
                    item = self.words[self.items[i]]
                    mine = {b" ".join(item[j : j + SHINGLE]) for j in range(len(item) - SHINGLE + 1)}
                    met = np.flatnonzero(np.isin(element[x:y], self.shingles[self.ends[i] : self.ends[i + 1]]))
                    shared = len(mine & {spelled(int(at[x + m]), SHINGLE) for m in met})
                    if shared >= self.threshold * len(mine) - 1e-9:
                        yield a + r, int(self.items[i]), len(mine), shared


def item_blocks(items: DataFrame):
    """Blocks of (item_id, text), each of at most about BLOCK_SHINGLES shingles, collected one at a time."""
    size = F.coalesce(F.regexp_count("text", F.lit("[^ \\x09-\\x0D]+")), F.lit(0))
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_SHINGLES))
    for k in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [tuple(r) for r in block.select("item_id", "text").collect()]


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) for items(item_id, text) of which docs(doc_id, text) hold at least the
    threshold share of shingles."""
    spark = small_batches(docs).sparkSession
    out = None
    for rows in item_blocks(items):
        shared = spark.sparkContext.broadcast((ItemIndex([r[1] for r in rows], threshold), [r[0] for r in rows]))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, ids = shared.value
            for batch in batches:
                docs = batch.column("doc_id")
                found = [(docs[r].as_py(), ids[i], n, m) for r, i, n, m in index.search(batch.column("text"))]
                if found:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "item_id", "n_shingles", "n_shared"])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
        part = rows.mapInArrow(search, "doc_id long, item_id long, n_shingles long, n_shared long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_shared").alias("n_shared"))


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs that contain no item; rows are judged one by one, so a repeated doc_id goes only with its own text."""
    spark = small_batches(docs).sparkSession
    out = docs
    for rows in item_blocks(items):
        shared = spark.sparkContext.broadcast(ItemIndex([r[1] for r in rows], threshold))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for r, *_ in index.search(batch.column(text)):
                    good[r] = False
                yield batch.filter(pa.array(good))

        out = out.mapInArrow(keep, docs.schema)
    return out
