"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed words is shared by all grades; ordered thresholds cut its scale, so that
P(grade <= k) = logistic(threshold_k - w.x). Fitted in numpy by maximum likelihood; the thresholds stay
ordered because each is the one before plus an exponential.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, holdout_bucket
from tidemark.llm.features import N_SHAPE, Sample, bounded_rows, collect_features, score_rows

SLOTS = 1 << 15
#: Bound of the labelled sample the model is fitted on (rows).
MAX_TRAIN = 3_000
HELD_OUT_MOD = 5


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class OrdinalModel:
    def __init__(self, grades: int, size: int = SLOTS):
        self.grades = grades
        self.weights, self.shape = np.zeros(size), np.zeros(N_SHAPE)
        self.cuts = np.linspace(-1, 1, grades - 1) if grades > 1 else np.zeros(0)

    @staticmethod
    def _scaled(row, value, n):
        return value / np.sqrt(np.maximum(1.0, np.bincount(row, value * value, n)))[row]

    def decision(self, row, slot, value, shape):
        return np.bincount(row, self.weights[slot] * self._scaled(row, value, len(shape)), len(shape)) + shape @ self.shape

    def tails(self, *features):
        """P(grade >= k) for k = 1 .. grades - 1."""
        return _sigmoid(self.decision(*features)[:, None] - self.cuts[None, :])

    def fit(self, sample: Sample, grade, epochs: int = 50, rate: float = 0.03, l2: float = 1e-4, seed: int = 11):
        if self.grades < 2 or not len(grade):
            return self
        rng = np.random.default_rng(seed)
        size, k = len(self.weights), self.grades - 1
        share = np.array([np.clip((grade > i).mean(), 1e-3, 1 - 1e-3) for i in range(k)])
        start = np.maximum.accumulate(np.log((1 - share) / share) + np.arange(k) * 1e-3)
        gaps = np.log(np.maximum(np.diff(start), 1e-3))
        theta = np.concatenate((self.weights, self.shape, start[:1], gaps))
        first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
        n_batches = max(1, len(grade) // 512)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(grade)), n_batches):
                row, slot, value, x = sample.batch(part)
                y, n = grade[part], len(part)
                value = self._scaled(row, value, n)
                f = np.bincount(row, theta[slot] * value, n) + x @ theta[size : size + N_SHAPE]
                steps = np.exp(theta[size + N_SHAPE + 1 :])
                cuts = theta[size + N_SHAPE] + np.concatenate(([0.0], np.cumsum(steps)))
                edges = np.concatenate(([-np.inf], cuts, [np.inf]))
                upper, lower = edges[y + 1] - f, edges[y] - f
                p_up, p_low = np.where(np.isinf(upper), 1.0, _sigmoid(upper)), np.where(np.isinf(lower), 0.0, _sigmoid(lower))
                d_up, d_low = p_up * (1 - p_up), p_low * (1 - p_low)
                p = np.maximum(p_up - p_low, 1e-9)
                g_f = (d_up - d_low) / p / n  # gradient of -log p by f
                grad = np.bincount(slot, g_f[row] * value, len(theta))
                grad[size : size + N_SHAPE] = g_f @ x
                g_cut = np.array([-((d_up / p)[y == i].sum() - (d_low / p)[y == i + 1].sum()) / n for i in range(k)])
                grad[size + N_SHAPE] = g_cut.sum()
                for i in range(1, k):
                    grad[size + N_SHAPE + i] = g_cut[i:].sum() * steps[i - 1]
                grad[: size + N_SHAPE] += l2 * theta[: size + N_SHAPE]
                step += 1
                first = 0.9 * first + 0.1 * grad
                second = 0.999 * second + 0.001 * grad * grad
                theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        self.weights, self.shape = theta[:size], theta[size : size + N_SHAPE]
        self.cuts = theta[size + N_SHAPE] + np.concatenate(([0.0], np.cumsum(np.exp(theta[size + N_SHAPE + 1 :]))))
        return self


def train(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """``ratings``: (doc_id, grade 0 .. grades-1). Fits on at most ``MAX_TRAIN`` rows outside the held-out bucket.

    Null grades say nothing; of conflicting grades of one id the least counts; null and empty texts have form only;
    texts are read whole; repeated documents count each. Without rated rows all weights are nought.
    """
    rated = ratings.where(holdout_bucket("doc_id", HELD_OUT_MOD) != 0).where("grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = bounded_rows(rated, "doc_id", MAX_TRAIN)
    texts = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    sample = collect_features(texts.join(chosen, "doc_id"), "text", ["doc_id", "grade"], SLOTS)
    return OrdinalModel(grades).fit(sample, sample.kept["grade"].to_numpy(dtype=np.int64))


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bucket, expected_grade, tails), one row for each of ``docs``.

    Null and empty texts are scored as a text without words, whole texts of any length are read, equal texts score
    alike, a null id is kept (bucket 0), other columns are ignored, an empty table gives an empty one.
    """
    k = model.grades - 1

    def link(*found):
        tails = model.tails(*found)
        return [tails.sum(axis=1), *(np.ascontiguousarray(tails[:, i]) for i in range(k))]

    fields = "expected_grade double, " + ", ".join(f"tail_{i + 1} double" for i in range(k))
    return score_rows(docs, id_col, text_col, SLOTS, link, fields, HELD_OUT_MOD)
