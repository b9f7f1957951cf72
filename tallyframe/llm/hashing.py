"""Hashes of words, shingles and byte windows, computed over the buffers of whole Arrow columns.

Texts are UTF-8 bytes laid end to end. Words are hashed by xxhash. A prefix sum of bytes times powers of an odd number gives
the polynomial hash of any stretch in O(1), mixed to 64 bits; it serves stretches of a few hundred bytes only, as longer ones
can be made to collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
#: Texts are worked on in stretches of about so many bytes; a longer text makes a stretch of its own.
STRETCH_BYTES = 1 << 18
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (splitmix64's finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of MULTIPLIER and of its inverse."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((MULTIPLIER, INVERSE)):
            steps = np.full(max(n, STRETCH_BYTES * 2) + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of data[start:stop], equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def slice_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """xxhash (64 bits, seed 0) of every slice data[start:stop]; slices of one length are hashed together, eight bytes at a time."""
    out, length = np.zeros(len(start), np.uint64), stop - start
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight, four = (np.ndarray(len(data) + 1, kind, padded, strides=(1,)) for kind in ("<u8", "<u4"))  # a number at every byte
    order = np.argsort(np.minimum(length, 32).astype(np.uint8), kind="stable")
    ends = np.searchsorted(np.minimum(length, 32)[order], np.arange(33)) if len(order) else np.zeros(33, np.int64)
    for n in range(32):
        own = order[ends[n] : ends[n + 1]]
        if len(own):
            out[own] = _hash_at(padded, eight, four, start[own], n)
    for i in order[ends[32] :]:
        out[i] = xxhash.xxh64_intdigest(data[start[i] : stop[i]].tobytes())
    return out


def _hash_at(data: np.ndarray, eight: np.ndarray, four: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """xxhash of the stretches of one length, under 32 bytes, that start at the given places."""
    h, end = np.full(len(at), _P5 + np.uint64(length), np.uint64), at + length
    for _ in range(length // 8):
        h = _turn(h ^ (_turn(eight[at] * _P2, 31) * _P1), 27) * _P1 + _P4
        at = at + 8
    if length % 8 >= 4:
        h = _turn(h ^ (four[at].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at = at + 4
    for k in range(length % 4, 0, -1):
        h = _turn(h ^ (data[end - k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def stretches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into bytes) of a string column, about STRETCH_BYTES at a time; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    empty = b"" if pa.types.is_large_binary(column.type) else ""
    column = column.fill_null(empty).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STRETCH_BYTES, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, row) of every word; words are runs of anything but ASCII blanks, cut at row ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate((inside[1:], [False]))
    stop = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, stop, np.searchsorted(offsets, start, side="right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word."""
    start, stop, row = word_places(data, offsets)
    return slice_hashes(data, start, stop), row


def word_windows(word: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every run of `size` words of one row."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out, step = word[:n], np.uint64(0xA24BAED4963EE407)
    for k in range(1, size):
        out = mix(out * step + word[k : n + k])
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return out[at], at


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word shingle in order; a text of fewer words than `size` has one shingle of them all."""
    word, row = words(data, offsets)
    per_row = np.bincount(row, minlength=len(offsets) - 1) if len(row) else np.zeros(len(offsets) - 1, np.int64)
    step = np.uint64(0xA24BAED4963EE407)
    out, at = word_windows(word, row, size)
    own = row[at]
    first = np.concatenate(([0], np.cumsum(per_row)))[:-1]
    short, short_rows = [], np.flatnonzero((per_row > 0) & (per_row < size))
    for r in short_rows:
        x = word[first[r] : first[r] + 1]
        for k in range(1, per_row[r]):
            x = mix(x * step + word[first[r] + k : first[r] + k + 1])
        short.append(x + np.uint64(per_row[r]))
    if short:
        out, own = np.concatenate([out, *short]), np.concatenate([own, short_rows])
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, times) of the distinct shingles of each row, ordered by row and hash."""
    out, own = shingles(data, offsets, size)
    if not len(out):
        return out, own, np.zeros(0, np.int64)
    order = np.lexsort((out, own))
    out, own = out[order], own[order]
    first = np.flatnonzero(np.concatenate(([True], (out[1:] != out[:-1]) | (own[1:] != own[:-1]))))
    return out[first], own[first], np.diff(np.append(first, len(out)))
