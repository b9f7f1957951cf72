"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Boosting cycles over the features; each turn fits a shallow tree to the
gradient of one feature's bins and adds it, damped, to that feature's lookup table. Then the pairs whose
2 x 2 cuts best explain what is left get tables of their own, boosted in the same cyclic way. A score is a
sum of table entries, so scoring is a vectorised addition of looked-up bins.

Fitting uses at most `max_rows` labelled rows (the rows with the smallest hashed doc_id, so reruns agree);
this bound is the documented parameter that keeps the fit, on the driver, at a fixed size. Features and
scores are computed for every row and whole texts by Spark tasks.

Cases: null text counts as empty, and empty texts get features and a score as any other; documents without a
label are scored alike; several labels of a document count as their smallest; null labels are ignored; with no label at
all, or only one class, the score is the smoothed share of ones. Labels, lang, source and doc_id are not
features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import small_batches

FEATURES = (
    "words", "word_length", "symbols", "exclamations", "pipes", "upper", "digits", "distinct_words", "distinct_lines",
    "words_per_line", "stops", "commas", "longest_word", "beyond_ascii", "repeated_pairs", "brackets", "top_word", "links",
)
_STOP = re.compile(r"[.!?](?=\s|$)")


def text_features(text: str | None) -> list[float]:
    """Shape of one whole text; rates are per word or per character, counts are logarithmic."""
    text = text or ""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    of = lambda s: int(counts[list(s.encode())].sum())
    lines = [x for x in text.split("\n") if x.strip()]
    lowered = [w.strip(".,!?;:").lower() for w in words]
    pairs = len(set(zip(lowered, lowered[1:], strict=False)))
    distinct = set(lowered)
    top = max(Counter(lowered).values(), default=0)
    return [
        np.log1p(len(words)), sum(map(len, words)) / n, of("#*$%&<>") / chars, of("!") / n, of("|") / n,
        int(counts[65:91].sum()) / chars, int(counts[48:58].sum()) / chars, len(distinct) / n, len(set(lines)) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)), len(_STOP.findall(text)) / n, of(",") / n, np.log1p(max(map(len, words), default=0)),
        int(counts[128:192].sum()) / chars, pairs / max(n - 1, 1), of("[]{}()=_\\/") / chars, top / n, text.count("http") / n,
    ]


def features_of(texts) -> np.ndarray:
    return np.array([text_features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def best_cut(gain: np.ndarray, weight: np.ndarray, least: float) -> tuple[float, int]:
    """Best place to cut ordered bins in two: (gain over no cut, first bin of the right side)."""
    g, w = np.cumsum(gain)[:-1], np.cumsum(weight)[:-1]
    total, mass = gain.sum(), weight.sum()
    ok = (w >= least) & (mass - w >= least)
    if not ok.any():
        return 0.0, 0
    value = np.where(ok, g**2 / np.maximum(w, 1e-9) + (total - g) ** 2 / np.maximum(mass - w, 1e-9), -np.inf)
    at = int(value.argmax())
    return float(value[at] - total**2 / max(mass, 1e-9)), at + 1


@dataclass
class AdditiveModel:
    """Lookup tables of a fitted model."""

    bins: int = 32
    rounds: int = 120
    rate: float = 0.1
    leaves: int = 3
    n_pairs: int = 6
    pair_rounds: int = 40
    least: float = 2.0
    intercept: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)
    pair_tables: list = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        share = (y.sum() + 1) / (len(y) + 2)
        self.intercept = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.array([]) for k in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if len(np.unique(y)) < 2:
            return self
        b = self.binned(x)
        raw = np.full(len(y), self.intercept)
        for _ in range(self.rounds):
            for k in range(x.shape[1]):
                raw += self._boost(self.tables[k], b[:, k], y, raw)
        self._choose_pairs(b, y, raw)
        self.pair_tables = [np.zeros((len(self.tables[i]), len(self.tables[j]))) for i, j in self.pairs]
        for _ in range(self.pair_rounds):
            for (i, j), cells in zip(self.pairs, self.pair_tables, strict=True):
                raw += self._boost_pair(cells, b[:, i], b[:, j], y, raw)
        return self

    @staticmethod
    def _gradient(y, raw):
        p = 1 / (1 + np.exp(-raw))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    def _boost(self, table, bins, y, raw) -> np.ndarray:
        g, h = (np.bincount(bins, v, len(table)) for v in self._gradient(y, raw))
        spans = [(0, len(table))]
        while len(spans) < self.leaves:
            cuts = [(*best_cut(g[a:b], h[a:b], self.least), a, b) for a, b in spans if b - a > 1]
            gain, at, a, b = max(cuts, default=(0, 0, 0, 0))
            if gain <= 1e-9:
                break
            spans.remove((a, b))
            spans += [(a, a + at), (a + at, b)]
        step = np.zeros(len(table))
        for a, b in spans:
            step[a:b] = self.rate * np.clip(g[a:b].sum() / (h[a:b].sum() + 1.0), -4, 4)
        table += step
        return step[bins]

    def _cells(self, i, j, shape, y, raw):
        at = i * shape[1] + j
        return (np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in self._gradient(y, raw))

    def _cut_pair(self, g, h):
        """A tree of depth two: rows are cut once, then each side's columns."""
        _, row = best_cut(g.sum(1), h.sum(1), self.least)
        best = (0.0, row, 0, 0)
        for row in {row, *range(1, g.shape[0], max(1, g.shape[0] // 8))} - {0}:
            cuts = [best_cut(g[s].sum(0), h[s].sum(0), self.least) for s in (slice(0, row), slice(row, None))]
            across = [g[s].sum() ** 2 / (h[s].sum() + 1) for s in (slice(0, row), slice(row, None))]
            best = max(best, (cuts[0][0] + cuts[1][0] + sum(across) - g.sum() ** 2 / (h.sum() + 1), row, cuts[0][1], cuts[1][1]))
        return best

    def _boost_pair(self, cells, i, j, y, raw) -> np.ndarray:
        g, h = self._cells(i, j, cells.shape, y, raw)
        gain, row, low, high = self._cut_pair(g, h)
        step = np.zeros(cells.shape)
        if gain > 1e-9:
            for s, cut in ((slice(0, row), low), (slice(row, None), high)):
                for t in (slice(0, cut), slice(cut, None)):
                    if h[s, t].size:
                        step[s, t] = self.rate * np.clip(g[s, t].sum() / (h[s, t].sum() + 1.0), -4, 4)
        cells += step
        return step[i, j]

    def _choose_pairs(self, b, y, raw) -> None:
        ranked = []
        for i in range(b.shape[1]):
            for j in range(i + 1, b.shape[1]):
                shape = (len(self.tables[i]), len(self.tables[j]))
                if min(shape) > 1:
                    ranked.append((-self._cut_pair(*self._cells(b[:, i], b[:, j], shape, y, raw))[0], i, j))
        self.pairs = [(i, j) for gain, i, j in sorted(ranked)[: self.n_pairs] if gain < 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self.binned(x)
        raw = np.full(len(x), self.intercept)
        for k, t in enumerate(self.tables):
            raw += t[b[:, k]]
        for (i, j), cells in zip(self.pairs, self.pair_tables, strict=True):
            raw += cells[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    @F.pandas_udf("array<double>")
    def shape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(features_of(texts)))

    return small_batches(df).withColumn("features", shape(F.col(text)))


def fit_quality(documents: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> AdditiveModel:
    """A model fitted to documents(doc_id, text) joined with labels(doc_id, label).

    At most max_rows labelled ids, and of their rows (an id may be repeated) at most max_rows, are used, so the ids may be
    broadcast and the features collected: some 20 bytes and 150 bytes a row, whatever the size of the corpus. Each of several
    rows of a labelled id has its label.
    """
    labels = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    shaped = with_features(rows).select("features", "label", F.xxhash64("doc_id", "text").alias("k"))
    got = shaped.orderBy("k", "label", "features").limit(max_rows).toPandas()
    x = np.array(got["features"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return AdditiveModel().fit(x, got["label"].to_numpy(dtype=np.float64))


def with_score(df: DataFrame, model: AdditiveModel, text: str = "text", into: str = "score") -> DataFrame:
    """df with the model's score of every whole text."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(features_of(texts)), dtype="float64")

    return small_batches(df).withColumn(into, scored(F.col(text)))
