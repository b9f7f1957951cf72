"""DartMinHash: weighted minwise signatures by throwing darts.

The plane over one element is its weight axis times a rank axis. It is tiled by fixed cells; the element's
hash and the cell decide how many darts fall there (Poisson, mean the cell's area) and where. A set keeps
the darts under its weights and below a rank at which about k ln k + 2 k of them are expected; each dart
names one of k coordinates, and the earliest dart of a coordinate is the signature's value there. Two sets
agree at a coordinate with probability their weighted Jaccard similarity. The cost is that of the darts
kept, plus a few cells an element, however large k times the set would be. Sets that miss a coordinate
throw again with the rank limit doubled, which changes no coordinate that was found.
"""

from __future__ import annotations

import math

import numpy as np

from tallyframe.llm.hashing import mix

#: Rank cells below 1; above it every cell is one wide.
FINE = np.array([0.0, 2.0**-12, 2.0**-6, 2.0**-2, 1.0])
_MOST = 24  # darts in a cell of area 1, beyond which the chance is under 1e-24


def _poisson_cdf(mean: float) -> np.ndarray:
    terms = [math.exp(-mean) * mean**j / math.factorial(j) for j in range(_MOST)]
    return np.cumsum(terms)


_CDF = np.array([_poisson_cdf(w) for w in [*np.diff(FINE), 1.0]])
_LOW32 = np.uint64(0xFFFFFFFF)


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def throw(element: np.ndarray, weight: np.ndarray, limit: np.ndarray):
    """(element index, rank, dart hash) of all darts under each element's weight and rank limit."""
    levels = np.ceil(weight).astype(np.int64)
    cells = np.where(limit > 1, 4 + np.ceil(limit - 1), np.searchsorted(FINE[:-1], limit)).astype(np.int64)
    per = levels * cells
    own = np.repeat(np.arange(len(element)), per)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per)
    level, cell = nth // cells[own], nth % cells[own]
    seed = mix(element[own] + level.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    seed = mix(seed + cell.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    kind = np.minimum(cell, 4)
    u, count = _uniform(seed), np.zeros(len(own), np.int64)
    alive = np.flatnonzero(u >= _CDF[kind, 0])
    j = 0
    while len(alive):
        count[alive] += 1
        j += 1
        alive = alive[u[alive] >= _CDF[kind[alive], j]] if j < _MOST else alive[:0]
    at = np.repeat(np.arange(len(own)), count)
    j = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    dart = mix(seed[at] ^ mix((j + 1).astype(np.uint64) * np.uint64(0x165667B19E3779F9)))
    where = mix(dart + np.uint64(0x27D4EB2F165667C5))
    low = np.where(cell[at] < 4, FINE[kind[at]], cell[at] - 3.0)
    width = np.where(cell[at] < 4, np.diff(np.append(FINE, 2.0))[kind[at]], 1.0)
    height = level[at] + (where >> np.uint64(32)).astype(np.float64) * 2.0**-32
    rank = low + width * ((where & _LOW32).astype(np.float64) + 0.5) * 2.0**-32
    kept = np.flatnonzero((height < weight[own[at]]) & (rank < limit[own[at]]))
    return own[at[kept]], rank[kept], dart[kept]


#: Sets that are signed at once; each throws some k ln k darts, however small it is.
SETS = 256


def signatures(element: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """(n_rows, k) signature values of weighted sets given as (row, element, weight) in order of rows; 0 for rows without
    elements."""
    out = np.zeros((n_rows, k), np.uint64)
    for a in range(0, n_rows, SETS):
        b = min(a + SETS, n_rows)
        part = slice(*np.searchsorted(row, (a, b)))
        out[a:b] = _signed(element[part], row[part] - a, weight[part], b - a, k)
    return out


def _signed(element: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    mass = np.bincount(row, weight, n_rows)
    expected = k * math.log(k) + 2 * k
    limit = np.divide(expected, mass, out=np.zeros(n_rows), where=mass > 0)
    best = np.full(n_rows * k, np.inf)
    todo = mass > 0
    while todo.any():
        live = np.flatnonzero(todo[row])
        who, rank, dart = throw(element[live], weight[live], limit[row[live]])
        slot = row[live][who] * k + (dart % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, slot, rank)
        todo &= np.isinf(best.reshape(n_rows, k)).any(1)
        limit = np.where(todo, 2 * limit, limit)
    best[np.isinf(best)] = 0.0
    return best.view(np.uint64).reshape(n_rows, k)


def bands(signature: np.ndarray, n_bands: int) -> np.ndarray:
    """(n_rows, n_bands) hashes of equal stretches of each signature; the band's number is part of the hash."""
    n, k = signature.shape
    parts = signature.reshape(n, n_bands, k // n_bands)
    out = np.broadcast_to(mix(np.arange(1, n_bands + 1, dtype=np.uint64)), (n, n_bands)).copy()
    for j in range(parts.shape[2]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return out
