"""Anchors: for every window of `length` bytes, the place of its least k-gram.

Equal windows have the same anchor at the same distance, and the starts of the windows that share an
anchor form one run. So any two equal windows meet under the hash of their anchor's k-gram, while only
about one place in (length - k) / 2 is an anchor.
"""

from __future__ import annotations

import numpy as np

from tallyframe.llm.hashing import prefix_hash, stretch_hash

ORDER_BITS = np.uint64(24)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i, by minima running forth and back within blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def window_anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """(row, first start, last start, anchor, hash of the k-gram, hash of all bytes of the run's windows).

    Places are offsets into data. Rows shorter than `length` have no windows.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    prefix = prefix_hash(data)
    at = np.arange(len(data) - k + 1)
    grams = stretch_hash(prefix, at, at + k)
    # least hash first, and among equal hashes the last place; places are unique within a stretch
    rank = (grams & ~np.uint64((1 << 24) - 1)) | (np.uint64((1 << 24) - 1) - (at.astype(np.uint64) & np.uint64((1 << 24) - 1)))
    least = sliding_min(rank, length - k + 1)
    n = len(least)
    rows = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - length + 1, 0))
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    first = np.cumsum(sizes) - sizes
    starts = np.arange(len(rows)) - first[rows] + offsets[rows]  # windows that lie inside a row
    if not len(starts):
        return empty, empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    assert starts[-1] < n
    value = least[starts]
    fresh = np.concatenate(([True], (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)))
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(starts)) - 1
    low, high = starts[heads], starts[tails]
    low_bits = np.uint64((1 << 24) - 1)
    place = (low_bits - (value[heads] & low_bits)).astype(np.int64)
    place += ((low - place + (1 << 24) - 1) >> 24) << 24  # the place at or after `low` with these low bits
    return rows[heads], low, high, place, grams[place], stretch_hash(prefix, low, high + length) + (place - low).astype(np.uint64)
