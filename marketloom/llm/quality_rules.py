"""Quality rules: gradient-boosted trees over document statistics (operator 3).

Trees are grown level by level on histograms of logistic-loss gradients. Chosen statistics carry monotonic constraints:
a split on one is taken only if the child on its better side gets the larger value, and the midpoint of both bounds every
value further down, so more symbols, repeats or shouting can never raise a score. All trees lie in flat numpy node arrays
(feature, threshold, left, right, value); scoring walks all documents of a batch through a tree level by level.

The model is fitted on at most ``SAMPLE`` labelled rows outside the held-out fold; statistics and verdicts cover all rows.

Defined results: null and empty texts have no words and fail the base rule; repeated rows are judged row by row; labels that
are null, differ for one doc_id or have no document are not learned from; without labels of both kinds the verdict is the base rule's; an empty table
gives an empty table; other columns are not read; long texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts
from .document_stats import NAMES, statistics
from .training import agreed, bounded, label_is, samples

SAMPLE = 12_000
TREES, DEPTH, RATE, BINS, L2 = 40, 3, 0.2, 48, 2.0
#: A document is kept unless its score, the estimated probability of label 1, is below this.
KEEP = 0.3
MONOTONE = {"symbols_per_word": -1, "repeat_share": -1, "dup_line_share": -1, "upper_share": -1, "exclaim_per_word": -1, "same_neighbour_share": -1}
LEARNED = tuple(n for n in NAMES if n not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


@dataclass
class Forest:
    """Nodes of all trees in one set of arrays; ``left`` is -1 at a leaf."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.left[node] >= 0).any():
                at = node[inner]
                low = x[rows[inner], self.feature[at]] <= self.threshold[at]
                node[inner] = np.where(low, self.left[at], self.right[at])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, l2: float = L2) -> Forest:
    """Boosted trees for y in {0, 1}; ``signs`` is 1, 0 or -1 per feature."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    raw = np.full(n, np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        for a, b in ((feature, 0), (threshold, 0.0), (left, -1), (right, -1), (value, v)):
            a.append(b)
        return len(feature) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, deep: int) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        own = float(np.clip(-total_g / (total_h + l2), low, high))
        best = None
        if deep and len(rows) >= 20:
            for f in range(m):
                size = len(cuts[f]) + 1
                hg = np.bincount(binned[rows, f], g[rows], size).cumsum()[:-1]
                hh = np.bincount(binned[rows, f], h[rows], size).cumsum()[:-1]
                if not len(hg):
                    continue
                a = np.clip(-hg / (hh + l2), low, high)
                b = np.clip(-(total_g - hg) / (total_h - hh + l2), low, high)
                # second-order loss of both children at their (bounded) values
                gain = -(hg * a + (hh + l2) * a * a / 2) - ((total_g - hg) * b + (total_h - hh + l2) * b * b / 2)
                ok = (hh > 1) & (total_h - hh > 1)
                if signs[f]:
                    ok &= (b - a) * signs[f] >= 0
                if ok.any():
                    k = int(np.argmax(np.where(ok, gain, -np.inf)))
                    if best is None or gain[k] > best[0]:
                        best = (gain[k], f, k, a[k], b[k])
        if best is None or best[0] <= -(total_g * own + (total_h + l2) * own * own / 2) + 1e-6:
            return leaf(own * rate)
        _, f, k, a, b = best
        node = leaf(0.0)
        goes = binned[rows, f] <= k
        mid = (a + b) / 2
        bounds = ((low, mid), (mid, high)) if signs[f] > 0 else ((mid, high), (low, mid)) if signs[f] < 0 else ((low, high), (low, high))
        feature[node], threshold[node] = f, float(cuts[f][k])
        left[node] = grow(rows[goes], g, h, *bounds[0], deep - 1)
        right[node] = grow(rows[~goes], g, h, *bounds[1], deep - 1)
        return node

    forest = None
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), -4.0, 4.0, depth))
        forest = Forest(0.0, np.array(roots[-1:]), *map(np.array, (feature, threshold, left, right, value)))
        raw += forest.raw(x)
    return Forest(float(np.log(share / (1 - share))), np.array(roots), *map(np.array, (feature, threshold, left, right, value)))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Forest | None:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    known = agreed(labels)
    # each kind of label gets its share of the bound at least
    roles = {"0": bounded(known.filter(label_is(0)), most // 4), "1": bounded(known.filter(label_is(1)), most - most // 4)}

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [statistics(t)[0] for t in texts(b)]
        return pa.RecordBatch.from_pydict({"y": pa.array([int("1" in r) for r in b.column(2).to_pylist()], pa.int32()), "x": pa.array(x, pa.list_(pa.float64()))})

    got = map_rows(samples(docs, roles), work, "y int, x array<double>").toArrow()
    y = np.asarray(got.column("y")).astype(float)
    if len(set(y.tolist())) < 2:
        return None
    x = np.array(got.column("x").to_pylist())
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows came in
    at = [NAMES.index(n) for n in LEARNED]
    return fit(x[order][:, at], y[order], np.array([MONOTONE.get(n, 0) for n in LEARNED]))


def judge(docs: DataFrame, forest: Forest | None, keep: float = KEEP) -> DataFrame:
    """Per row: doc_id, the counted statistics, base_failed, kept, score."""
    at = [NAMES.index(n) for n in LEARNED]

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t)[0] for t in texts(b)]).reshape(-1, len(NAMES))
        failed = (x[:, 0] < 50) | (100 * x[:, 4] > 50 * x[:, 0])
        score = forest.score(x[:, at]) if forest else np.where(failed, 0.0, 1.0)
        whole = {n: pa.array(x[:, k].astype(np.int64), pa.int64()) for k, n in enumerate(NAMES[:5])}
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), **whole, "base_failed": pa.array(failed), "kept": pa.array(~failed & (score >= keep)), "score": pa.array(score)})

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, work, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def quality_rules(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    return judge(docs, train(docs, labels, most), keep).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 9).alias("score"))
