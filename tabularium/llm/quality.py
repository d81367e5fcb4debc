"""Quality by positive-unlabelled learning.

Trusted positives (``labels.quality`` = 1, training folds) and documents without a label give a non-negative unbiased risk,
prior * R+(g) + max(0, Ru-(g) - prior * R-(g)) with logistic losses, minimised by a small network over surface features of
whole texts. The class prior is estimated from a first positive-against-unlabelled classifier: where there are no
negatives the unlabelled density is the prior times the positives' density, so the median of that ratio over positives that it has not seen is the
prior. The sigmoid of the network is the probability of quality.

The fit reads a bounded sample: about SAMPLE documents of the training folds, drawn by a hash of the id. Scoring reads every row.

Edge cases: null and empty texts are scored like any other (all features zero). Without positives or without unlabelled
texts every score is the prior 0.5. A document labelled twice counts by its lower label; null labels are
none. Repeated rows get the same score; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, blocks, fold

SAMPLE = 12_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 60, 512, 5e-3, 1e-4, 11
THRESHOLD = 0.3

_UPPER, _LOWER = np.arange(65, 91), np.arange(97, 123)
_DIGIT = np.arange(48, 58)
_SYMBOL = np.frombuffer(b"#$%&*@^~<>{}[]=+_\\/", dtype=np.uint8)


def features(text: bytes | None) -> list[float]:
    """Surface measures of a text, each of a bounded range."""
    if not text:
        return [0.0] * N_FEATURES
    h = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256).astype(np.float64)
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    n, m, size = max(1, len(words)), max(1, len(lines)), len(text)
    counts = Counter(words)
    upper, lower, digits, symbols = h[_UPPER].sum(), h[_LOWER].sum(), h[_DIGIT].sum(), h[_SYMBOL].sum()
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    top = counts.most_common(3)
    return [
        np.log1p(len(words)) / 10,
        np.log1p(size / n),
        upper / (upper + lower + 1),
        digits / size,
        min(2, symbols / n),
        min(2, h[124] / n),
        min(2, h[33] / n),
        min(2, h[63] / n),
        min(2, h[46] / n),
        min(2, h[44] / n),
        min(2, (h[34] + h[39] + h[40] + h[41] + h[58] + h[59] + h[45]) / n),
        h[128:].sum() / size,
        len(counts) / n,
        len(counts) / n**0.8,
        top[0][1] / n if top else 0.0,
        sum(x[1] for x in top) / n,
        again / n,
        len(set(lines)) / m,
        np.log1p(n / m) / 10,
        sum(map(len, counts)) / max(1, len(counts)) / 20,
        sum(c for w, c in counts.items() if len(w) <= 2) / n,
        sum(c for w, c in counts.items() if len(w) > 14) / n,
        sum(c for w, c in counts.items() if w[-1:] in b".!?") / n,
        1.0,
    ]


N_FEATURES = 24


def _adam(parts: list[np.ndarray], grads: list[np.ndarray], state: list, step: int) -> None:
    for p, g, s in zip(parts, grads, state, strict=True):
        g = g + DECAY * p
        s[0] = 0.9 * s[0] + 0.1 * g
        s[1] = 0.999 * s[1] + 0.001 * g * g
        p -= RATE * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """One hidden layer over standardised features."""

    def __init__(self, x: np.ndarray, hidden: int = HIDDEN):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.parts = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return z, np.tanh(z @ self.parts[0] + self.parts[1])

    def value(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x)[1] @ self.parts[2] + self.parts[3][0]

    def gradients(self, x: np.ndarray, outer: np.ndarray) -> list[np.ndarray]:
        """Of a loss whose derivative by the value is ``outer``."""
        z, h = self.hidden(x)
        back = outer[:, None] * self.parts[2] * (1 - h * h)
        return [z.T @ back, back.sum(axis=0), h.T @ outer, np.array([outer.sum()])]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> None:
        """By the non-negative risk; without a prior, as an ordinary classifier of positive against unlabelled."""
        rng = np.random.default_rng(SEED + 1)
        state, step = [[np.zeros_like(p), np.zeros_like(p)] for p in self.parts], 0
        rounds = max(1, -(-max(len(positive), len(unlabelled)) // BATCH))
        for _ in range(EPOCHS):
            for _ in range(rounds):
                step += 1
                p = positive[rng.integers(0, len(positive), min(BATCH, len(positive)))]
                u = unlabelled[rng.integers(0, len(unlabelled), min(BATCH, len(unlabelled)))]
                sp, su = _sigmoid(self.value(p)), _sigmoid(self.value(u))
                if prior is None:
                    outer_p, outer_u = (sp - 1) / len(p), su / len(u)
                else:
                    negative = -np.log(1 - su + 1e-12).mean() - prior * -np.log(1 - sp + 1e-12).mean()
                    if negative >= 0:
                        outer_p, outer_u = prior * (sp - 1) / len(p) - prior * sp / len(p), su / len(u)
                    else:  # the negative part overfits: its risk goes back up
                        outer_p, outer_u = prior * sp / len(p), -su / len(u)
                grads = [a + b for a, b in zip(self.gradients(p, outer_p), self.gradients(u, outer_u), strict=True)]
                _adam(self.parts, grads, state, step)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled."""
    if len(positive) < 4:
        return 0.5
    half = len(positive) // 2
    first = Network(np.concatenate([positive, unlabelled]), 8)
    first.fit(positive[:half], unlabelled, None)
    odds = np.exp(-np.clip(first.value(positive[half:]), -30, 30))  # balanced batches: unlabelled against positive density
    return float(np.clip(np.median(odds), 0.05, 0.98))


def learn(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[Network, float] | None:
    if not len(positive) or not len(unlabelled):
        return None
    prior = estimate_prior(positive, unlabelled)
    net = Network(np.concatenate([positive, unlabelled]))
    net.fit(positive, unlabelled, prior)
    return net, prior


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, features`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole):
                rows = [features(t) for t in as_bytes(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, size: int = SAMPLE) -> tuple[Network, float] | None:
    """The network and the prior, from a sample of the training folds of bounded size; None if it can't be learned."""
    n = docs.select("doc_id").count()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("quality sample")), F.lit(1 << 40))
    some = draw < F.lit(int(min(1.0, size / max(1, n)) * (1 << 40)))
    chosen = docs.select("doc_id", "text").where(some & (fold("doc_id", folds) != 0))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(some & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = measured(chosen).join(marks, "doc_id", "left").where("quality is null or quality = 1").orderBy("doc_id").limit(2 * size).collect()
    positive = np.array([r["features"] for r in rows if r["quality"] == 1]).reshape(-1, N_FEATURES)
    unlabelled = np.array([r["features"] for r in rows if r["quality"] is None]).reshape(-1, N_FEATURES)
    rng = np.random.default_rng(SEED)
    return learn(positive[rng.permutation(len(positive))], unlabelled)


def score_all(docs: DataFrame, model: tuple[Network, float] | None) -> DataFrame:
    """``doc_id, score, predicted`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole):
                x = np.array([features(t) for t in as_bytes(batch.column("text"))]).reshape(-1, N_FEATURES)
                score = np.full(len(x), 0.5) if model is None else _sigmoid(model[0].value(x))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
