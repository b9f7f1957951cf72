"""Removal of long byte strings that occur more than once, found by suffix sorting.

1. Every window of LENGTH bytes has an anchor (its least GRAM-gram). The windows of one anchor are a run,
   and the bytes under a run are its context. Equal windows meet under equal anchor grams. Equal runs of one
   text are one row.
2. Grams that occur once are dropped. Equal contexts of the others become one string with its number of copies,
   so that a passage in a third of all texts is sorted once.
3. These strings are cut into 32-byte symbols, to the right of the anchor and, reversed, to its left. Suffix sorting
   by linear grouping (gsaca) orders the strings of a gram both ways; common prefixes of neighbours then give the
   classes of equal windows, and a window is repeated if its class holds two strings or more. A string that stands for
   several contexts is sorted as two, so its repeats are found by comparison as all others are. Whatever is removed
   was found here. Spans of a string with several copies go to all of its runs.
4. Grams with more than GROUP strings do not go to one task: their windows are dealt by longer grams first. A
   range of RANGE distances from the anchor has LENGTH - RANGE + 1 bytes in common, by which its windows are grouped and
   sorted as above. Where even those are shared by more than GROUP strings, windows are dealt by all of their
   bytes: of the windows of one hash the least and the greatest are sorted, and stand for the others.

Matches never cross documents; strings are judged on the input. Documents are known by doc_id and a digest of
their text (128 bits), so different texts under one doc_id, or under null, are kept apart.

Cases: null and empty texts and texts under LENGTH bytes have nothing to remove; equal rows are repeats of
each other, and each loses what repeats; texts of any length are handled in whole; an empty table gives an
empty result; other columns pass through `deduplicated`, but for columns named as those it adds, and are ignored by
`repeated_spans`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyframe.llm.anchors import window_anchors
from tallyframe.llm.common import small_batches, written
from tallyframe.llm.gsaca import suffix_array
from tallyframe.llm.hashing import prefix_hash, stretch_hash, stretches
from tallyframe.llm.packing import packed_documents, unpacked

LENGTH, GRAM, GROUP, RANGE, SYMBOL = 200, 50, 4_000, 19, 32
#: Distinct contexts that are suffix-sorted together (whole grams at a time).
BLOCK = 1_000
#: A document's key: its doc_id and the two halves of its text's digest.
KEY = ["doc", "digest1", "digest2"]
KEYS = [(k, pa.int64()) for k in KEY]
KEY_TYPE = ", ".join(f"{k} long" for k in KEY)
RUNS = pa.schema(
    [("gram", pa.int64()), ("context", pa.int64()), *KEYS, ("place", pa.int64()), ("copies", pa.int64()), ("spans", pa.list_(pa.int64()))]
)
BYTES = pa.schema(
    [("cell", pa.int64()), ("gram", pa.int64()), ("context", pa.int64()), ("copies", pa.int64()), *KEYS, ("place", pa.int64()), ("raw", pa.binary())]
)
SPANS = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("copies", pa.int64()), *KEYS, ("span", pa.int64())])
SPANS_TYPE = f"gram long, context long, copies long, {KEY_TYPE}, span long"
ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
NO_ID = -(1 << 63)
SIZE_BITS = 31  # of a packed span


def pack(low, width, offset):
    """A run's place in one integer: first start, last start - first, anchor - first."""
    return (low << 16) | (width << 8) | offset


def unpack(place):
    return place >> 16, (place >> 8) & 0xFF, place & 0xFF


def _keyed(docs: DataFrame, text: str, *more: str) -> DataFrame:
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    halves = [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(k) for at, k in ((1, "digest1"), (17, "digest2"))]
    return small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), *halves, F.col(text).alias("text"), *more)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each text. Equal contexts of one text make one row, with their number and their merged spans, so a text that
    repeats itself a thousand times does not make a thousand rows."""
    for batch in batches:
        key = [batch.column(c).to_numpy() for c in KEY]
        for a, b, data, offsets in stretches(batch.column("text")):
            row, low, high, place, gram, context = window_anchors(data, offsets, LENGTH, GRAM)
            if not len(row):
                continue
            order = np.lexsort((low, context, gram, row))
            row, low, high, place, gram, context = (x[order] for x in (row, low, high, place, gram, context))
            start, stop = low - offsets[row], high - offsets[row] + LENGTH
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
            heads = np.flatnonzero(fresh)
            copies = np.diff(np.append(heads, len(row)))
            parted = fresh.copy()
            parted[1:] |= start[1:] > stop[:-1]
            begins = np.flatnonzero(parted)
            ends = np.append(begins[1:], len(row)) - 1
            group = np.cumsum(fresh)[begins] - 1
            many = copies[group] > 1
            spans = span(start[begins], stop[ends] - start[begins])[many]
            cuts = np.concatenate(([0], np.cumsum(np.bincount(group[many], minlength=len(heads))))).astype(np.int32)
            where = pack(start, high - low, place - low)[heads]
            columns = [gram[heads].view(np.int64), context[heads].view(np.int64), *(k[a:b][row[heads]] for k in key), where, copies, pa.ListArray.from_arrays(pa.array(cuts), pa.array(spans, pa.int64()))]
            yield pa.record_batch(columns, schema=RUNS)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for runs in _runs(batches):
        yield runs.select(["gram", "copies"])


def _context_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {n: [] for n in BYTES.names}
        for *key, blob, size, wanted in zip(*(batch.column(c).to_pylist() for c in (*KEY, "text", "n_bytes", "wanted")), strict=True):
            text = unpacked(blob, size)
            for w in wanted:
                low, width, _ = unpack(w["place"])
                for name, value in zip(BYTES.names, (w["gram"], w["gram"], w["context"], w["copies"], *key, w["place"], text[low : low + width + LENGTH]), strict=True):
                    rows[name].append(value)
        yield pa.record_batch(rows, schema=BYTES)


def _reach(raw: list[bytes], group: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings, group by group, by suffix sorting over symbols of SYMBOL bytes, and the bytes that each
    shares with the one before it (-1 at the head of a group)."""
    m, parts = len(raw), -(-longest // SYMBOL)
    sizes = np.minimum(np.array([len(x) for x in raw]), longest)
    cells = np.zeros((m, parts * SYMBOL), np.uint8)
    flat = np.frombuffer(b"".join(x[:longest] for x in raw), np.uint8)
    at = np.repeat(np.arange(m), sizes)
    cells[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    # symbols in order of their bytes; a symbol that is cut short ranks by its length among equals
    used = np.clip(sizes[:, None] - np.arange(parts) * SYMBOL, 0, SYMBOL)
    wide = cells.reshape(m, parts, SYMBOL // 8, 8)[:, :, :, ::-1].copy().view(np.uint64).reshape(m * parts, SYMBOL // 8)
    full = used.ravel() > 0
    order = np.lexsort((used.ravel()[full], *wide[full].T[::-1]))
    ranked = np.column_stack((wide[full], used.ravel()[full].astype(np.uint64)))[order]
    fresh = np.concatenate(([0], np.any(ranked[1:] != ranked[:-1], axis=1)))
    symbol = np.empty(len(order), np.int64)
    symbol[order] = np.cumsum(fresh) + 1
    n_symbols = full.reshape(m, parts).sum(1)
    first = np.cumsum(n_symbols + 1) - (n_symbols + 1)  # a 0 ends every string
    sequence = np.zeros(len(symbol) + m, np.int64)
    sequence[np.arange(len(symbol)) + np.repeat(np.arange(m), n_symbols)] = symbol
    owner = np.full(len(sequence) + 1, -1)
    owner[first] = np.arange(m)
    sorted_ = owner[np.array(suffix_array(sequence.tolist()), np.int64)]
    sorted_ = sorted_[sorted_ >= 0]
    sorted_ = sorted_[np.argsort(group[sorted_], kind="stable")]
    a, b = cells[sorted_[:-1]], cells[sorted_[1:]]
    differs = a != b
    shared = np.where(differs.any(1), differs.argmax(1), parts * SYMBOL)
    shared = np.minimum(shared, np.minimum(sizes[sorted_[:-1]], sizes[sorted_[1:]]))
    shared = np.where(group[sorted_[:-1]] == group[sorted_[1:]], shared, -1)
    return sorted_, np.concatenate(([-1], shared))


def repeated_starts(raw: list[bytes], group: np.ndarray, width: np.ndarray, offset: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """(string, start) of the windows of LENGTH bytes that occur twice or more among the strings of their group, at the same
    distance from their anchors. String i has windows at 0..width[i], its anchor at offset[i], and stands for copies[i] strings;
    for two or more, two of it are sorted."""
    n = len(raw)
    own = np.concatenate((np.arange(n), np.flatnonzero(copies > 1)))
    return _twin_starts([raw[i] for i in own], group[own], width[own], offset[own], n)


def _same(order: np.ndarray, shared: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each string, equal for strings that share all of their bytes with their neighbours in order."""
    size = size[order]
    parted = np.ones(len(order), bool)
    parted[1:] = (shared[1:] < size[1:]) | (size[1:] != size[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(parted)
    return out


def _twin_starts(raw: list[bytes], group: np.ndarray, width: np.ndarray, offset: np.ndarray, n: int) -> np.ndarray:
    """(string, start) of the repeated windows of the first n strings; those after them are the second ones of some."""
    m = len(raw)
    right, right_shared = _reach([x[o:] for x, o in zip(raw, offset, strict=True)], group, LENGTH)
    most = int(offset.max(initial=0))
    left, left_shared = _reach([x[:o][::-1] for x, o in zip(raw, offset, strict=True)], group, max(most, 1))
    # strings that are equal on both sides repeat as a whole; only one of them need go on
    both = _same(left, left_shared, offset) * (m + 1) + _same(right, right_shared, np.array([len(x) for x in raw]) - offset)
    _, ids, times = np.unique(both, return_inverse=True, return_counts=True)
    whole = times[ids] > 1
    left_class, right_class = np.empty(m, np.int64), np.empty(m, np.int64)
    found = []
    for d in range(most + 1):
        live = np.flatnonzero((offset[:n] >= d) & (offset[:n] - width[:n] <= d))
        if not len(live):
            continue
        left_class[left] = np.cumsum(left_shared < d)
        right_class[right] = np.cumsum(right_shared < LENGTH - d)
        both = left_class[live] * (m + 1) + right_class[live]
        order = np.argsort(both, kind="stable")
        same = both[order[1:]] == both[order[:-1]]
        twin = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        hit = live[order[twin | whole[live[order]]]]
        found.append(np.column_stack((hit, offset[hit] - d)))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _spans_of(starts: np.ndarray, place: np.ndarray, key: list[np.ndarray]) -> pa.RecordBatch:
    """Maximal runs of repeated starts as spans of their documents; key: the columns of SPANS but the last."""
    starts = starts[np.lexsort((starts[:, 1], starts[:, 0]))]
    string, at = starts[:, 0], starts[:, 1]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (string[1:] != string[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(starts)) - 1 if len(head) else head
    low, _, _ = unpack(place[string[head]])
    return pa.record_batch([*(k[string[head]] for k in key), span(low + at[head], at[tail] - at[head] + LENGTH)], schema=SPANS)


def span(start, size):
    """Start and size of a span in one integer, ordered by start."""
    return (start << SIZE_BITS) | size


def _sorted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by cell; whole cells are gathered into blocks."""
    held: list[pa.Table] = []
    count = 0

    def solve(table: pa.Table) -> pa.RecordBatch:
        cell, place, *key = (table[c].to_numpy() for c in ("cell", "place", *SPANS.names[:-1]))
        _, width, offset = unpack(place)
        group = np.cumsum(np.concatenate(([0], cell[1:] != cell[:-1])))
        return _spans_of(repeated_starts(table["raw"].to_pylist(), group, width, offset, key[2]), place, key)

    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        ends = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell))
        a = 0
        for b in ends:
            # a full block is closed where the next cell begins
            begins = not held or held[-1]["cell"][-1].as_py() != int(cell[a])
            if begins and count >= BLOCK:
                yield solve(pa.concat_tables(held))
                held, count = [], 0
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
            count += b - a
            a = b
    if held:
        yield solve(pa.concat_tables(held))


def _by_longer_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings cut to the windows of RANGE distances from the anchor, with the hash of the bytes these share as their cell."""
    for batch in batches:
        rows: dict[str, list] = {n: [] for n in BYTES.names}
        for gram, context, copies, *key, place, raw in zip(*(batch.column(n).to_pylist() for n in BYTES.names[1:]), strict=True):
            low, width, offset = unpack(place)
            prefix = prefix_hash(np.frombuffer(raw, np.uint8))
            for near in range(0, LENGTH - GRAM + 1, RANGE):
                far = min(near + RANGE - 1, LENGTH - GRAM)
                first, last = max(offset - far, 0), min(offset - near, width)  # starts of the range's windows
                if first > last:
                    continue
                core = stretch_hash(prefix, np.array([offset - near]), np.array([offset - far + LENGTH])) + np.uint64(near)
                cut = (int(core.view(np.int64)[0]), gram, context, copies, *key, pack(low + first, last - first, offset - first), raw[first : last + LENGTH])
                for name, value in zip(BYTES.names, cut, strict=True):
                    rows[name].append(value)
        yield pa.record_batch(rows, schema=BYTES)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of strings, each a string of its own, with its hash as its cell."""
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column("raw")[i].as_py()
            low, width, _ = unpack(batch.column("place")[i].as_py())
            at = np.arange(width + 1)
            cell = stretch_hash(prefix_hash(np.frombuffer(text, np.uint8)), at, at + LENGTH).view(np.int64)
            same = [np.full(len(at), batch.column(k)[i].as_py()) for k in SPANS.names[:-1]]
            yield pa.record_batch([cell, *same, pack(low + at, 0, 0), pa.array([text[k : k + LENGTH] for k in at.tolist()], pa.binary())], schema=BYTES)


def _repeated_windows(windows: DataFrame) -> DataFrame:
    """Spans of the windows(BYTES) whose bytes occur twice or more. Of a cell, the least and the greatest window are sorted (one with
    several copies stands for two); where they are equal, so are all."""
    ends = windows.groupBy("cell").agg(F.sum("copies").alias("n"), F.min("raw").alias("a"), F.max("raw").alias("b")).filter("n > 1")
    pair = ends.select("cell", F.explode(F.array("a", "b")).alias("raw"))
    zero = F.lit(0).cast("long")
    rows = pair.select("cell", *[zero.alias(k) for k in ("gram", "context")], F.lit(1).cast("long").alias("copies"), F.col("cell").alias(KEY[0]), *[zero.alias(k) for k in KEY[1:]], zero.alias("place"), "raw")
    found = _sorted_cells(rows).select(F.col(KEY[0]).alias("cell")).distinct()
    packed = F.shiftleft(F.shiftright("place", 16), SIZE_BITS).bitwiseOR(F.lit(LENGTH)).alias("span")
    return windows.join(found, "cell").select(*SPANS.names[:-1], packed)


def _sorted_cells(raw: DataFrame) -> DataFrame:
    return raw.repartition("cell").sortWithinPartitions("cell").mapInArrow(_sorted_spans, SPANS_TYPE)


def _wide_cells(raw: DataFrame) -> DataFrame:
    return written(raw.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("cell"), "wide-cells")


def _found(raw: DataFrame) -> DataFrame:
    """Repeated spans of the strings raw(BYTES), in the text of the run that stands for each string."""
    wide = _wide_cells(raw)
    found = _sorted_cells(raw.join(wide, "cell", "left_anti"))
    if wide.isEmpty():
        return found
    names = ", ".join(f"{f.name} {'binary' if f.name == 'raw' else 'long'}" for f in BYTES)
    longer = written(raw.join(wide, "cell", "left_semi").select(*BYTES.names).mapInArrow(_by_longer_grams, names), "longer-grams")
    wide = _wide_cells(longer)
    found = found.unionByName(_sorted_cells(longer.join(wide, "cell", "left_anti")))
    if wide.isEmpty():
        return found
    windows = longer.join(wide, "cell", "left_semi").select(*BYTES.names).mapInArrow(_windows, names)
    return found.unionByName(_repeated_windows(written(windows, "wide-windows")))


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, digest1, digest2, span) of everything in docs(doc_id, text) that a repeated LENGTH-byte string covers; spans may overlap."""
    keyed = _keyed(docs, text)
    grams = keyed.mapInArrow(_grams, "gram long, copies long")
    repeated = grams.groupBy("gram").agg(F.sum("copies").alias("n")).filter("n > 1").select("gram")
    repeated = written(repeated, "repeated-grams")  # read again, it leaves Spark free to split hot grams in the join
    runs = keyed.mapInArrow(_runs, f"gram long, context long, {KEY_TYPE}, place long, copies long, spans array<bigint>")
    runs = written(runs.join(repeated, "gram"), "runs")
    strings = runs.groupBy("gram", "context").agg(F.sum("copies").alias("copies"), F.min(F.struct(*KEY, "place")).alias("one"))
    wanted = strings.groupBy(*[F.col(f"one.{k}").alias(k) for k in KEY]).agg(F.collect_list(F.struct("gram", "context", "copies", "one.place")).alias("wanted"))
    raw = packed_documents(keyed).join(wanted, KEY).select(*KEY, "text", "n_bytes", "wanted")
    raw = raw.mapInArrow(_context_bytes, f"cell long, gram long, context long, copies long, {KEY_TYPE}, place long, raw binary")
    found = written(_found(written(raw, "context-bytes")), "found-spans")

    # a string with copies is repeated as a whole, and so are all runs that it stands for
    low, size = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(0xFF)) + LENGTH
    own = F.array(F.shiftleft(low, SIZE_BITS).bitwiseOR(size))
    whole = runs.join(written(found.filter("copies > 1").select("gram", "context").distinct(), "found-strings"), ["gram", "context"])
    whole = whole.select(*KEY, F.explode(F.concat(own, "spans")).alias("span"))
    return whole.unionByName(found.filter("copies = 1").select(*KEY, "span"))


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint (start, stop) of packed spans; touching spans become one."""
    spans = np.sort(spans)
    start = spans >> SIZE_BITS
    stop = start + (spans & ((1 << SIZE_BITS) - 1))
    reach = np.maximum.accumulate(stop)
    fresh = np.concatenate(([True], start[1:] > reach[:-1]))
    head = np.flatnonzero(fresh)
    return np.column_stack((start[head], reach[np.append(head[1:], len(spans)) - 1]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes spans; adds n_removed, n_spans, kept_sha256 and the kept text (bytes of cut characters are dropped from it)."""
    for batch in batches:
        kept, removed, count, digest = [], [], [], []
        for blob, size, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "n_bytes", "spans")), strict=True):
            text = unpacked(blob, size)
            runs = merged(np.array(spans, np.int64)) if spans else np.zeros((0, 2), np.int64)
            edges = [0, *runs.ravel().tolist(), size]
            rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            kept.append(rest.decode("utf-8", "ignore"))
            removed.append(size - len(rest))
            count.append(len(runs))
            digest.append(hashlib.sha256(rest).hexdigest())
        rest = [n for n in batch.schema.names if n not in ("text", "spans", "n_bytes")]
        columns = [*(batch.column(n) for n in rest), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest), pa.array(kept)]
        yield pa.record_batch(columns, names=[*rest, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns ADDED (columns of these names are replaced); kept_text is null only where the text was null."""
    others = [c for c in docs.columns if c != text and c not in ADDED]
    aside = docs.select(F.struct(*[F.col(f"`{c}`") for c in others], F.col(text).isNull().alias("_null")).alias("_row"), "doc_id", text)
    spans = repeated_spans(docs, text).groupBy(*KEY).agg(F.collect_set("span").alias("spans"))
    texts = packed_documents(_keyed(aside, text, "_row"))
    rows = texts.join(spans, KEY, "left")
    types = [LongType(), LongType(), LongType(), StringType(), StringType()]
    cut = StructType([rows.schema["_row"], *(StructField(n, t) for n, t in zip(ADDED, types, strict=True))])
    out = rows.select("_row", "text", "n_bytes", "spans").mapInArrow(_cut, cut)
    text_out = F.when(~F.col("_row._null"), F.col("kept_text")).alias("kept_text")
    return out.select(*[F.col(f"_row.`{c}`") for c in others], "n_bytes", "n_removed", "n_spans", "kept_sha256", text_out)
