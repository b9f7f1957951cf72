"""Plain Python versions of the operators, and hostile documents."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if text else []


def plain_words(text):
    return [w for w in words(text) if w]


def shingle_set(text):
    w = plain_words(text)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def near_classes(rows, threshold=0.8):
    """{doc_id: least doc_id of its class} by comparing all texts that share a shingle."""
    sets = {d: shingle_set(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    held = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            held[x].append(d)
    shared = Counter((a, b) for ds in held.values() for i, a in enumerate(ds) for b in ds[i + 1 :])
    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {d: root(d) for d in up}


def weighted_classes(rows, threshold=0.8):
    """near_classes by weighted similarity: shingles count as often as they occur."""
    sets = {}
    for d, t in rows:
        w = plain_words(t)
        sets[d] = Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = (sets[a] & sets[b]).total()
            if both and both >= threshold * (sets[a].total() + sets[b].total() - both) - 1e-9:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in up}


def repeated_bytes(rows, length=200):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) by counting every window."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def contained(docs, items, threshold=0.8):
    """{(doc_id, item_id, shingles, shared)}: the most that a row of a doc_id shares; short items are one run of their words."""
    best = {}
    for i, t in items:
        own = shingle_set(t)
        size = len(min(own, default=()))
        for d, text in docs:
            w = plain_words(text)
            n = len(own & {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}) if own else 0
            if own and n >= threshold * len(own) - 1e-9:
                best[d, i, len(own)] = max(best.get((d, i, len(own)), 0), n)
    return {(*key, n) for key, n in best.items()}


def documents(spark, rows, extra=True):
    """documents with nulls in the other columns and columns whose names operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(d, t, None, f"s{(d or 0) % 3}" if (d or 0) % 4 else None, len(t) if t is not None else None) for d, t in rows]
    df = spark.createDataFrame(full, schema)
    if extra:
        from pyspark.sql import functions as F

        for name in ("key", "id", "tag", "doc", "span", "shard", "copy", "score", "n_words", "digest", "bucket", "parts"):
            df = df.withColumn(name, F.lit("x"))
    return df


def hostile():
    base = " ".join(f"word{i}" for i in range(120))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, base), (7, base), (8, base.replace("word50", "other")), (9, "x" * 30_000),
        (10, "ab " * 9_000), (11, "é" * 150), (12, "é" * 150), (13, base + " tail " + " ".join(f"more{i}" for i in range(40))), (6, base), (None, base), (None, None),
        (14, "!!! ### *** &&&\n" * 20), (15, "\U0001f600 ﻿ \x00 end"), (16, "<|im_end|> <|endoftext|>"),
    ]
