"""How far the word use of each source differs from the other sources of its language, in exact whole numbers.

1. Tasks read texts as one UTF-8 buffer: a lookup table over bytes marks the bytes of terms, runs of them are slices, and
   vectorised xxhash groups equal slices, whose bytes are then compared (slices of one hash and other bytes are parted).
2. Counts go through the shuffle as sparse matrices (terms x sources, rows compressed), one a task and bucket of terms, so
   each pair of term and source is a few bytes. The task of a bucket adds its matrices up and keeps the terms that
   enough documents of a language hold.
3. Shares come from exact decimal arithmetic. Kept cells are dealt by language and block of terms; a block is a sparse
   matrix again (sources x terms), and sums of differences are taken with reduceat over its rows. Blocks hold a
   bounded number of cells, and blocks of many sources are dealt by slices of these.

Cases: null text, language and source are ''; a text without terms still makes its source occur; repeated rows count each;
sources whose kept terms are none have the shares of a count of 0; a language without kept terms has pairs of value 0
and no terms; ties go by item in bytewise order; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import small_batches, written
from tallyframe.llm.hashing import slice_hashes

MIN_DOCUMENTS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Cells of a block, sources of a slice, and entries that a task gathers before it hands its matrices on.
BLOCK_CELLS, SLICE, GATHERED = 200_000, 256, 1_000_000
#: Groups (language and source) that are broadcast at most; more are joined by key.
BROADCAST_GROUPS = 50_000

#: Bytes of terms: ASCII letters and all bytes of other characters; A-Z become a-z.
TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
SMALL = np.arange(256, dtype=np.uint8)
SMALL[0x41:0x5B] += 0x20

def _flat(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all bytes of the slices, one slice after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def group_slices(data: np.ndarray, start: np.ndarray, stop: np.ndarray, hashes=slice_hashes) -> tuple[np.ndarray, np.ndarray]:
    """(id of every slice, first slice of every id): slices of equal bytes have one id, others never."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, ids = np.unique(hashes(data, start, stop), return_index=True, return_inverse=True)
    length, twin = stop - start, first[ids]
    same = length == length[twin]
    near = np.flatnonzero(same)
    equal_bytes = data[_flat(start[near], length[near])] == data[_flat(start[twin[near]], length[near])]
    begins = np.cumsum(length[near]) - length[near]
    same[near] = np.logical_and.reduceat(equal_bytes, begins)
    odd: dict[bytes, int] = {}
    for i in np.flatnonzero(~same):  # one hash, other bytes
        word = data[start[i] : stop[i]].tobytes()
        if word not in odd:
            odd[word] = len(first)
            first = np.append(first, i)
        ids[i] = odd[word]
    return ids, first


class Counts:
    """Sparse counts: terms (bytes end to end), groups (language, source) and entries (term, group, times, documents)."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, groups: list[tuple[str, str]], entries: np.ndarray):
        self.terms, self.ends, self.groups, self.entries = terms, ends, groups, entries

    @classmethod
    def summed(cls, many: list[Counts]) -> Counts:
        """One matrix of several; equal terms meet by hash and bytes."""
        groups: dict[tuple[str, str], int] = {}
        columns = [np.array([groups.setdefault(g, len(groups)) for g in c.groups], np.int64) for c in many]
        data = np.concatenate([c.terms for c in many])
        shift = np.cumsum([0, *[len(c.terms) for c in many]])
        stop = np.concatenate([c.ends + s for c, s in zip(many, shift, strict=False)])
        start = np.concatenate([np.concatenate(([0], c.ends[:-1]))[: len(c.ends)] + s for c, s in zip(many, shift, strict=False)])
        ids, first = group_slices(data, start, stop)
        before = np.cumsum([0, *[len(c.ends) for c in many]])
        term = np.concatenate([ids[c.entries[0] + b] for c, b in zip(many, before, strict=False)])
        group = np.concatenate([col[c.entries[1]] if len(col) else c.entries[1] for c, col in zip(many, columns, strict=True)])
        values = np.concatenate([c.entries[2:] for c in many], axis=1)
        order = np.lexsort((group, term))
        term, group, values = term[order], group[order], values[:, order]
        begin = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (group[1:] != group[:-1])))) if len(term) else np.zeros(0, np.int64)
        sums = np.add.reduceat(values, begin, axis=1) if len(begin) else values
        length = (stop - start)[first]
        return cls(data[_flat(start[first], length)], np.cumsum(length), list(groups), np.vstack([term[begin], group[begin], sums]))

    def bucketed(self, buckets: int) -> Iterator[tuple[int, Counts]]:
        """The matrix in parts by a hash of the term."""
        start = np.concatenate(([0], self.ends[:-1]))[: len(self.ends)]
        length = self.ends - start
        bucket = (slice_hashes(self.terms, start, self.ends) >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1).astype(np.uint64))
        entries = self.entries[:, np.argsort(place[self.entries[0]], kind="stable")]
        cuts = np.searchsorted(place[entries[0]], edges)
        for b in np.flatnonzero(np.diff(edges)):
            own, part = order[edges[b] : edges[b + 1]], entries[:, cuts[b] : cuts[b + 1]]
            used, group = np.unique(part[1], return_inverse=True)
            rows = np.vstack([place[part[0]] - edges[b], group, part[2:]])
            yield int(b), Counts(self.terms[_flat(start[own], length[own])], np.cumsum(length[own]), [self.groups[g] for g in used], rows)

    def packed(self) -> dict:
        """As columns of a row: numbers in the fewest bytes that hold them, terms' entries as a number a term."""
        small = lambda a: np.min_scalar_type(int(a.max()) if len(a) else 0).char.encode() + a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)).tobytes()
        return {
            "terms": self.terms.tobytes(), "lengths": small(np.diff(self.ends, prepend=0)), "groups": [{"lang": a, "source": b} for a, b in self.groups],
            "row_sizes": small(np.bincount(self.entries[0], minlength=len(self.ends))), "columns": small(self.entries[1]), "times": small(self.entries[2]), "documents": small(self.entries[3]),
        }

    @classmethod
    def unpacked(cls, row: dict) -> Counts:
        wide = lambda x: np.frombuffer(x[1:], np.dtype(x[:1].decode())).astype(np.int64)
        sizes = wide(row["row_sizes"])
        entries = np.vstack([np.repeat(np.arange(len(sizes)), sizes), wide(row["columns"]), wide(row["times"]), wide(row["documents"])])
        return cls(np.frombuffer(row["terms"], np.uint8), np.cumsum(wide(row["lengths"])), [(g["lang"], g["source"]) for g in row["groups"]], entries)


PACKED = "terms binary, lengths binary, groups array<struct<lang: string, source: string>>, row_sizes binary, columns binary, times binary, documents binary"
_PACKED_ARROW = pa.schema([
    ("bucket", pa.int32()), ("terms", pa.binary()), ("lengths", pa.binary()), ("groups", pa.list_(pa.struct([("lang", pa.string()), ("source", pa.string())]))),
    ("row_sizes", pa.binary()), ("columns", pa.binary()), ("times", pa.binary()), ("documents", pa.binary()),
])


def text_counts(texts: pa.Array, langs: list[str], sources: list[str]) -> Counts:
    """Counts of the terms of whole texts; no term reaches from one text into the next."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = SMALL[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | cut[:-1])) if len(data) else np.zeros(0, np.int64)
    stop = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | cut[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, start, side="right") - 1
    ids, first = group_slices(data, start, stop)
    groups: dict[tuple[str, str], int] = {}
    group_of = np.array([groups.setdefault(g, len(groups)) for g in zip(langs, sources, strict=True)], np.int64)
    pair, times = np.unique(row * max(len(first), 1) + ids, return_counts=True)  # (text, term)
    term, group = pair % max(len(first), 1), group_of[pair // max(len(first), 1)] if len(pair) else pair
    order = np.lexsort((group, term))
    term, group, times = term[order], group[order], times[order]
    begin = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (group[1:] != group[:-1])))) if len(term) else np.zeros(0, np.int64)
    held = np.diff(np.append(begin, len(term)))
    length = (stop - start)[first]
    entries = np.vstack([term[begin], group[begin], np.add.reduceat(times, begin) if len(begin) else times, held])
    return Counts(data[_flat(start[first], length)], np.cumsum(length), list(groups), entries)


def _counting(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0

        def handed_on():
            for bucket, part in Counts.summed(gathered).bucketed(buckets):
                yield pa.RecordBatch.from_pylist([{"bucket": bucket} | part.packed()], _PACKED_ARROW)

        for batch in batches:
            found = text_counts(batch["text"], batch["lang"].to_pylist(), batch["source"].to_pylist())
            gathered.append(found)
            size += found.entries.shape[1]
            if size >= GATHERED:
                if len(gathered) > 1:
                    gathered[:] = [Counts.summed(gathered)]
                size = gathered[0].entries.shape[1]
                if size >= GATHERED:
                    yield from handed_on()
                    gathered, size = [], 0
        if gathered:
            yield from handed_on()

    return run


def _bucket_sums(min_documents: int):
    def run(rows: pa.Table) -> pa.Table:
        """All matrices of a bucket in one: its terms with enough documents in a language, a row a source."""
        total = Counts.summed([Counts.unpacked(r) for r in rows.to_pylist()])
        langs, sources = np.array([g[0] for g in total.groups], object), np.array([g[1] for g in total.groups], object)
        _, lang_of = np.unique(langs.astype(str), return_inverse=True) if len(langs) else (None, np.zeros(0, np.int64))
        term, group, times, documents = total.entries
        key = term * (lang_of.max(initial=0) + 1) + lang_of[group]
        _, first, ids = np.unique(key, return_index=True, return_inverse=True)
        held, all_times = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        np.add.at(held, ids, documents)
        np.add.at(all_times, ids, times)
        keep = held[ids] >= min_documents
        leads = np.zeros(len(term), np.int64)
        leads[first] = 1
        begin = np.concatenate(([0], total.ends[:-1]))[: len(total.ends)]
        names = {t: total.terms[begin[t] : total.ends[t]].tobytes().decode() for t in np.unique(term[keep])}
        texts = (langs[group[keep]], sources[group[keep]], [names[t] for t in term[keep]])
        return pa.table([*[pa.array(t, pa.string()) for t in texts], times[keep], all_times[ids][keep], leads[keep]], ["lang", "source", "term", "times", "lang_times", "leads"])

    return run


def term_cells(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, source, term, times, lang_times, leads): occurrences of every kept term in every source that holds it, in its whole
    language, and 1 in one of the term's rows."""
    spark = docs.sparkSession
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = small_batches(text).mapInArrow(_counting(buckets), f"bucket int, {PACKED}")
    return packed.groupBy("bucket").applyInArrow(_bucket_sums(min_documents), "lang string, source string, term string, times long, lang_times long, leads long")


def share(times: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (times + ADDED) / (total + ADDED * terms)), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    over = F.lit(SCALE).cast("decimal(10,0)") * wide(times + ADDED)
    return F.call_function("div", over, wide(total + ADDED * terms)) + 1


def block_differences(rows: pa.Table) -> pa.Table:
    """(lang, a, b, value): sums of the differences of shares over the terms of a block, for the sources a of a slice and those after.

    A row without a term stands for a source and its share of an absent term. With x the shares of source a in full, the sum
    against b is, over b's own terms, |its share - x|, and over all others |its absent share - x|; the latter is the sum over
    all terms, from sorted prefix sums, less that over b's own terms. Both sums over own terms are reduceat."""
    rows = rows.sort_by("source").combine_chunks()
    lang, at = rows["lang"][0].as_py(), rows["slice"][0].as_py()
    whole = rows["term"].is_null()
    names, absent = rows["source"].filter(whole), rows["p"].filter(whole).to_numpy()
    cells = rows.filter(pc.invert(whole))
    source, p = pc.index_in(cells["source"], names).to_numpy().astype(np.int64), cells["p"].to_numpy()
    words = cells["term"].unique()
    column = pc.index_in(cells["term"], words).to_numpy().astype(np.int64)
    indptr = np.searchsorted(source, np.arange(len(names) + 1))
    full_rows = np.flatnonzero(np.diff(indptr))
    own = absent[source]  # the absent share of each cell's source
    out_a, out_b, out = [], [], []
    for a in range(at * SLICE, min((at + 1) * SLICE, len(names))):
        x = np.full(len(words), absent[a], np.int64)
        x[column[indptr[a] : indptr[a + 1]]] = p[indptr[a] : indptr[a + 1]]
        rest = slice(a + 1, len(names))
        ordered = np.sort(x)
        below = np.concatenate(([0], np.cumsum(ordered)))
        k = np.searchsorted(ordered, absent[rest])
        value = absent[rest] * (2 * k - len(x)) - 2 * below[k] + below[-1]
        change = np.zeros(len(names), np.int64)
        if len(full_rows):
            change[full_rows] = np.add.reduceat(np.abs(p - x[column]) - np.abs(own - x[column]), indptr[full_rows])
        out_a.append(np.full(len(names) - a - 1, a))
        out_b.append(np.arange(a + 1, len(names)))
        out.append(value + change[rest])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    a, b = (names.take(pa.array(join(x))) for x in (out_a, out_b))
    return pa.table([pa.array([lang] * len(a), pa.string()), a, b, join(out)], ["lang", "a", "b", "value"])


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, q, p, value, rank): part "pair" for every other source of the language, part "term" for the
    `top` terms that a source uses most beyond its language."""
    cells = written(term_cells(docs, min_documents), "divergence-cells")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = cells.groupBy("lang", "source").agg(F.sum("times").alias("total"))
    whole = cells.groupBy("lang").agg(F.sum("times").alias("lang_total"), F.sum("leads").alias("terms"), F.count(F.lit(1)).alias("cells"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    facts = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").select("lang", "source", *map(zero, ("total", "lang_total", "terms", "cells")))
    sizes = Window.partitionBy("lang")
    facts = facts.withColumns({"blocks": F.ceil(F.greatest("cells", F.lit(1)) / BLOCK_CELLS).cast("int"), "slices": F.ceil(F.count(F.lit(1)).over(sizes) / SLICE).cast("int")})
    facts = facts.withColumn("absent", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(F.lit(1)))
    facts = written(facts, "divergence-groups")
    looked_up = F.broadcast(facts) if facts.count() <= BROADCAST_GROUPS else facts
    known = cells.join(looked_up, ["lang", "source"]).withColumn("p", share(F.col("times"), F.col("total"), F.col("terms")))

    some = known.select("lang", "source", "term", "p", "slices", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    lone = facts.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("absent").alias("p"), "slices", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = some.unionByName(lone).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    sums = dealt.groupBy("lang", "block", "slice").applyInArrow(block_differences, "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    q = share(F.col("lang_times"), F.col("lang_total"), F.col("terms"))
    terms = known.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - q).alias("value")).filter("value > 0")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", place).unionByName(terms.select("*", place).filter(F.col("rank") <= top))
