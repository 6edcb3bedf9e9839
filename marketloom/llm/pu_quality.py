"""Quality classifier by positive-unlabelled learning (operator 5).

Trusted positives are documents labelled 1; the unlabelled text is a sample of the corpus itself, whatever its labels. No
document labelled 0 is ever used as such. With the class prior pi, the non-negative risk

    pi * E_p[l(f)] + max(0, E_u[l(-f)] - pi * E_p[l(-f)])

is minimised by mini-batches of Adam; where the second part turns negative, the step goes up its gradient instead, which keeps
the model from fitting the unlabelled sample too closely. The model is linear over text statistics and byte frequencies, and
with the logistic loss its output is the log-odds of a positive.

The prior comes from the same two samples. Whatever part of the texts one looks at, the unlabelled sample has at least pi times
as much of it as the positives have, so that the ratio of the two shares bounds pi from above. A first model, fitted on one half
of both samples, orders the other half, and the bin of highest scores with the least upper confidence bound on that ratio gives
an estimate (best-bin estimation); the least of ``SPLITS`` splits, both halves in turn, is the tightest bound.

Everything is fitted on bounded samples (``SAMPLE`` rows each) outside the held-out fold; scores cover all rows.

Defined results: null and empty texts get the score of their (empty) features; repeated rows are scored row by row; a null
doc_id is never held out and never learned from, nor is a doc_id with labels that differ; without positives every score is
0.5, and below ``LEAST`` rows of either sample the prior is taken as 0.5; an empty table gives an empty table; labels, lang, source and doc_id never enter a score; long texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out_column, map_rows, texts
from .document_stats import NAMES, statistics
from .training import agreed, bounded, label_is, learnable, samples

SAMPLE = 6_000
PREDICT = 0.3
EPOCHS, BATCH, RATE, DECAY, SMOOTH = 30, 512, 0.02, 1e-4, 40
SPLITS, FIRST_PRIORS, LEAST, DELTA = 3, (0.5, 0.7), 20, 0.1
SHARES = [n for n in NAMES if n not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
_AT = [NAMES.index(n) for n in SHARES]
#: Letters are folded by case and other bytes kept, so that no single language has features of its own beyond its letters.
WIDTH = len(SHARES) + 128 + 1


def features(text: str) -> np.ndarray:
    stats, seen = statistics(text)
    low = seen[:128].astype(np.float64)
    share = np.sqrt(low / (seen.sum() + SMOOTH))
    return np.concatenate([np.asarray(stats)[_AT], share, [np.sqrt(seen[128:].sum() / (seen.sum() + SMOOTH))]]).astype(np.float32)


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 7) -> Scorer:
    """Minimise the non-negative risk with the logistic loss l(z) = log(1 + exp(-z))."""
    every = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    p, u = (np.clip((a - mean) / scale, -6, 6) for a in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    p, u = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]
    step = 0
    for _ in range(epochs):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        rounds = max(1, min(len(u), len(p)) // BATCH)
        for a, b in zip(np.array_split(order_p, rounds), np.array_split(order_u, rounds), strict=True):
            xp, xu = p[a], u[b]
            zp, zu = xp @ w, xu @ w
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            of_negative = xu.T @ _sigmoid(zu) / len(zu) - prior * (xp.T @ _sigmoid(zp)) / len(zp)
            of_positive = -prior * (xp.T @ _sigmoid(-zp)) / len(zp)
            g = of_positive + of_negative if negative >= 0 else -of_negative
            g = g + DECAY * np.r_[w[:-1], 0]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Scorer(mean, scale, w[:-1], float(w[-1]))


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, delta: float = DELTA) -> float:
    """The share of positives among unlabelled scores, from the bin of highest scores that bounds it best."""
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    of_p, of_u = (1 - np.searchsorted(np.sort(x), cuts) / len(x) for x in (positive, unlabelled))
    slack = np.sqrt(np.log(4 / delta) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    there = of_p > 0
    k = np.argmin((of_u[there] + slack) / of_p[there])
    return float(of_u[there][k] / of_p[there][k])


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, splits: int = SPLITS, seed: int = 11) -> float:
    """The class prior of the unlabelled sample, kept away from 0 and 1."""
    if min(len(positive), len(unlabelled)) < LEAST:
        return 0.5
    rng, found = np.random.default_rng(seed), []
    for _ in range(splits):
        p, u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for half in (0, 1):
            for first in FIRST_PRIORS:
                model = fit(positive[p[half::2]], unlabelled[u[half::2]], first, EPOCHS // 2)
                found.append(best_bin(model.margin(positive[p[1 - half :: 2]]), model.margin(unlabelled[u[1 - half :: 2]])))
    return float(np.clip(min(found), 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Scorer | None:
    """The model of two bounded samples: positives, and texts whatever their labels."""
    roles = {"positive": bounded(agreed(labels).filter(label_is(1)), most), "unlabelled": bounded(learnable(docs), most)}

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t) for t in texts(b)]
        return pa.RecordBatch.from_pydict({"roles": b.column(2), "x": pa.array(x, pa.list_(pa.float32()))})

    got = map_rows(samples(docs, roles), work, "roles array<string>, x array<float>").toArrow()
    roles_of = got.column("roles").to_pylist()
    x = np.array(got.column("x").to_pylist(), np.float32).reshape(-1, WIDTH)
    order = np.lexsort(x.T[:40]) if len(x) else np.array([], int)  # the same model whatever order the rows came in
    x, roles_of = x[order], [roles_of[k] for k in order]
    positive, unlabelled = (x[np.array([r in s for s in roles_of], bool)] for r in ("positive", "unlabelled"))
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, estimated_prior(positive, unlabelled))


def _scores(model: Scorer | None, all_texts: list[str]) -> np.ndarray:
    if model is None:
        return np.full(len(all_texts), 0.5)
    return model.score(np.array([features(t) for t in all_texts], np.float32).reshape(-1, WIDTH))


def score(docs: DataFrame, model: Scorer | None, least: float = PREDICT) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(_scores(model, texts(b)), pa.float64())})

    rows = docs.select("doc_id", "text")
    out = map_rows(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out_column().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, most))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, least: float = PREDICT) -> DataFrame:
    """The input's rows that the classifier doesn't reject; all columns stay as they are."""
    model = train(docs, labels, most)
    at = docs.columns.index("text")

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(_scores(model, [t or "" for t in b.column(at).to_pylist()]) >= least))

    return map_rows(docs, work, T.StructType(docs.schema.fields))
