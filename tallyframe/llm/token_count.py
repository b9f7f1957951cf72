"""Token counts by heap-and-linked-list byte-pair merging.

The count of a word is its number of initial symbols less the merges made: the lowest-rank adjacent
pair is popped from a heap, its two symbols are joined in a linked list, and the pairs that arise are
pushed. No token identifiers are produced. Texts are cut at blanks and each distinct chunk is counted
once per worker, in a cache of fixed size; a chunk of n symbols costs O(n log n), so one very long
word does not stall a task.

The library's letters and digits are those of Unicode 16 (the regex package knows later ones, LATER_CHARACTERS); its
lower case is later than Python's (LATER_CASES).

Cases: null and empty texts count 0. Every text is read whole. Rows stay rows, so ties, repeats and
empty tables need no special handling, and all other columns pass through.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import small_batches

#: Unicode White_Space.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Code points that are letters or digits for the regex package only, in hexadecimal.
LATER_CHARACTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 "
    "187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
# Capitals that came after Unicode 15.1, first and last of a run, and the small letter of the first.
LATER_CASES = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
CACHE_ENTRIES = 1 << 18
CACHED_CHARS = 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """What counting needs from a tokenizer file with byte-level symbols and word ends: a small, bounded table."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    return {
        "ranks": {tuple(pair): rank for rank, pair in enumerate(model["merges"])},
        "symbols": {s for s in model["vocab"] if len(s.removesuffix(model["end_of_word_suffix"])) == 1},
        "suffix": model["end_of_word_suffix"],
        "pattern": spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
        "special": [t["content"] for t in spec["added_tokens"]],
    }


def merged_count(symbols: list[str], ranks: dict) -> int:
    """How many symbols remain when every merge, lowest rank first and leftmost among equals, is made."""
    n = len(symbols)
    if n < 2:
        return n
    sym, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[p], i, sym[i] + sym[i + 1]) for i in range(n - 1) if (p := (sym[i], sym[i + 1])) in ranks]
    heapify(heap)
    left = n
    while heap:
        _, i, joined = heappop(heap)
        j = after[i]
        if sym[i] is None or j >= n or sym[i] + sym[j] != joined or (sym[i], sym[j]) not in ranks:
            continue
        sym[i], sym[j] = joined, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks.get((joined, sym[k]))) is not None:
                heappush(heap, (rank, i, joined + sym[k]))
        h = before[i]
        if h >= 0 and (rank := ranks.get((sym[h], joined))) is not None:
            heappush(heap, (rank, h, sym[h] + joined))
        left -= 1
    return left


def text_counter(vocabulary: dict):
    """A function from a text to its number of tokens."""
    import unicodedata

    import regex

    ranks, suffix, base = vocabulary["ranks"], vocabulary["suffix"], byte_symbols()
    symbols = vocabulary["symbols"]
    pattern = vocabulary["pattern"].replace("\\s", SPACES)
    pieces = regex.compile(pattern)
    later = regex.compile(f"[{regex.sub('[0-9A-F]+', lambda m: chr(int(m[0], 16)), LATER_CHARACTERS).replace(' ', '')}]")
    lower = {a + i: chr(small + i) for a, b, small in LATER_CASES for i in range(b - a + 1)}
    special = regex.compile("|".join(map(regex.escape, vocabulary["special"])) or "(?!)")
    separators = regex.compile("[\\x1c-\\x1f]")
    blanks = regex.compile(f"[{SPACES}]+")

    @lru_cache(CACHE_ENTRIES)
    def of_short(word: str) -> int:
        return of_long(word)

    def of_word(word: str) -> int:
        return of_short(word) if len(word) <= CACHED_CHARS else of_long(word)

    def of_long(word: str) -> int:
        shown = [base[b] for b in word.encode("utf-8", "replace")]
        shown[-1] += suffix
        return merged_count([s for s in shown if s in symbols], ranks)

    def of_plain(text: str) -> int:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if text.isascii():
            return sum(map(of_word, pieces.findall(text)))
        text = text.translate(lower)
        if not later.search(text):
            return sum(map(of_word, pieces.findall(text)))
        # cut where an unassigned character of the same length stands in their place, count what stands there
        return sum(of_word(text[m.start() : m.end()]) for m in pieces.finditer(later.sub("\U0003fffd", text)))

    def of_chunk(chunk: str) -> int:
        if "<|" not in chunk:
            return of_plain(chunk)
        return len(special.findall(chunk)) + sum(of_plain(x) for x in special.split(chunk) if x)

    cached = lru_cache(CACHE_ENTRIES)(of_chunk)

    def of_text(text: str | None) -> int:
        if not text:
            return 0
        chunks = blanks.split(text) if separators.search(text) else text.split()
        return sum([cached(c) if len(c) <= CACHED_CHARS else of_chunk(c) for c in chunks if c])

    return of_text


def with_token_count(df: DataFrame, vocabulary_path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """df with the token count of its text column. The vocabulary is read once, on the driver, and broadcast
    (its size is that of the vocabulary file, whatever the data)."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of_text = text_counter(shared.value)
        for texts in batches:
            yield pd.Series([of_text(t) for t in texts], dtype="int64")

    return small_batches(df).withColumn(into, counted(F.col(text)))
