"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is read whole. The network runs over its bytes forward and backward and gives every position a distribution
over the languages from both states; a document's distribution is the mean over all its positions. A text longer
than a window is read in windows that overlap by ``CONTEXT`` bytes on either side, within which the states settle;
the positions there are counted once, in the window that sees them from further in. Training is backpropagation
through time on stretches drawn from anywhere in the whole texts of a bounded labelled sample.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, frugal, holdout_bucket

#: Bytes of a window and of what it shares with its neighbours on either side.
WINDOW, CONTEXT = 1024, 64
#: Bytes of a training stretch.
STRETCH = 96
HIDDEN = 12
#: Bounds of the labelled rows the network is fitted on: documents of each language, bytes of a document that may be one of them.
DOCS_PER_LANGUAGE, LONGEST_TRAIN = 200, 1 << 20
HELD_OUT_MOD, HELD_OUT = 4, 2
_LETTER = re.compile(r"[^\W\d_]")


def _gate(x):
    """The hard sigmoid, which has the logistic function's value and slope at zero."""
    return np.clip(0.25 * x + 0.5, 0, 1)


class ByteGRU:
    """Both directions hold an input table (256 x 3H), a recurrent matrix (H x 3H) and share one output layer."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(hidden)).astype(np.float32)
        self.p = {f"{k}{d}": draw(*s) for d in "fb" for k, s in (("E", (256, 3 * hidden)), ("U", (hidden, 3 * hidden)))}
        self.p["W"] = draw(2 * hidden, max(1, len(languages)))
        self.p["c"] = np.zeros(max(1, len(languages)), np.float32)

    def _pass(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: (steps, batch) bytes. The states after each step; ``keep`` gathers what the way back needs."""
        h_n, table, u = self.hidden, self.p["E" + d], self.p["U" + d]
        h = np.zeros((x.shape[1], h_n), np.float32)
        out = np.empty((*x.shape, h_n), np.float32)
        for t in range(len(x)):
            a, g = table[x[t]], h @ u
            zr = _gate(a[:, : 2 * h_n] + g[:, : 2 * h_n])
            z, r = zr[:, :h_n], zr[:, h_n:]
            n = np.tanh(a[:, 2 * h_n :] + r * g[:, 2 * h_n :])
            if keep is not None:
                keep.append((h, z, r, n, g[:, 2 * h_n :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def _back(self, x, d: str, kept, grad_out) -> dict[str, np.ndarray]:
        h_n, u = self.hidden, self.p["U" + d]
        g_u = np.zeros_like(u)
        carry = np.zeros_like(grad_out[0])
        inputs = np.empty((*x.shape, 3 * h_n), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, g = kept[t]
            dh = grad_out[t] + carry
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * 0.25 * ((z > 0) & (z < 1))
            dr = dn * g * 0.25 * ((r > 0) & (r < 1))
            d_in = np.concatenate((dz, dr, dn), axis=1)
            d_rec = np.concatenate((dz, dr, dn * r), axis=1)
            inputs[t] = d_in
            g_u += h.T @ d_rec
            carry = dh * z + d_rec @ u.T
        g_e = np.zeros_like(self.p["E" + d])
        order = np.argsort(x, axis=None, kind="stable")
        byte = x.ravel()[order]
        starts = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
        g_e[byte[starts]] = np.add.reduceat(inputs.reshape(-1, 3 * h_n)[order], starts)
        return {"E" + d: g_e, "U" + d: g_u}

    def _states(self, x: np.ndarray, d: str, begin: np.ndarray) -> np.ndarray:
        """States (steps, hidden, batch) for prediction: in place, a feature's batch being contiguous.

        A sequence starts at step ``begin``; what lies before it leaves no state. The gates' slope and offset are
        folded into the tables.
        """
        n, u = self.hidden, self.p["U" + d].T.copy()
        table = self.p["E" + d].T.copy()
        u[: 2 * n] *= 0.25
        table[: 2 * n] *= 0.25
        table[: 2 * n] += 0.5
        steps, batch = x.shape
        last = int(begin.max())
        out = np.empty((steps, n, batch), np.float32)
        h, a, g = np.zeros((n, batch), np.float32), np.empty((3 * n, batch), np.float32), np.empty((3 * n, batch), np.float32)
        gates, z, r, new = a[: 2 * n], a[:n], a[n : 2 * n], a[2 * n :]
        for t in range(steps):
            np.take(table, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=g)
            gates += g[: 2 * n]
            np.clip(gates, 0, 1, out=gates)
            r *= g[2 * n :]
            new += r
            np.tanh(new, out=new)
            h -= new
            h *= z
            h += new
            if t < last:
                h *= begin <= t
            out[t] = h
        return out

    def position_sums(self, x: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(steps, batch) bytes, ``size`` of each sequence being its own, to (batch, languages): the sum of the
        distributions of its positions low .. high."""
        n, w = self.hidden, np.ascontiguousarray(self.p["W"].T)
        forward, backward = self._states(x, "f", np.zeros(len(size), np.int64)), self._states(x[::-1], "b", len(x) - size)[::-1]
        total = np.zeros((w.shape[0], x.shape[1]), np.float32)
        at = np.arange(len(x))[:, None]
        counted = (low <= at) & (at < high)
        for t in range(0, len(x), 64):
            p = np.matmul(w[:, :n], forward[t : t + 64])
            p += np.matmul(w[:, n:], backward[t : t + 64])
            p += self.p["c"][:, None]
            p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            p *= (counted[t : t + 64] / p.sum(axis=1))[:, None, :]
            total += p.sum(axis=0)
        return total.T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy at all positions of (steps, batch) bytes, y being a language for each of the batch."""
        kept_f, kept_b = [], []
        states = np.concatenate((self._pass(x, "f", kept_f), self._pass(x[::-1], "b", kept_b)[::-1]), axis=2)
        logits = states @ self.p["W"] + self.p["c"]
        prob = np.exp(logits - logits.max(axis=2, keepdims=True))
        prob /= prob.sum(axis=2, keepdims=True)
        prob[:, np.arange(len(y)), y] -= 1
        prob /= x.size
        back = prob @ self.p["W"].T
        grad = {"W": np.einsum("tbh,tbc->hc", states, prob), "c": prob.sum(axis=(0, 1))}
        grad |= self._back(x, "f", kept_f, back[:, :, : self.hidden])
        return grad | self._back(x[::-1], "b", kept_b, back[::-1, :, self.hidden :])

    def fit(self, texts: list[bytes], label: np.ndarray, steps: int = 300, batch: int = 128, rate: float = 0.02, seed: int = 5):
        """Adam on stretches of the texts, each language and each of its texts as often as the others.

        A stretch begins anywhere in its text; texts shorter than a stretch are followed by spaces.
        """
        if len(self.languages) < 2 or not texts:
            return self
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        padded = [t + b" " * max(0, STRETCH - len(t)) for t in texts]
        begin = np.cumsum([0] + [len(t) for t in padded])
        data, room = np.frombuffer(b"".join(padded), np.uint8), np.diff(begin) - STRETCH
        by = [b for i in range(len(self.languages)) if len(b := np.flatnonzero(label == i))]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(b, -(-batch // len(by))) for b in by])
            at = begin[pick] + rng.integers(0, room[pick] + 1)
            for k, g in self.gradients(data[at[None, :] + np.arange(STRETCH)[:, None]], label[pick]).items():
                np.clip(g, -1, 1, out=g)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= (rate * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def document_probabilities(self, texts: pa.Array, at_once: int = 512) -> np.ndarray:
        """Mean position distribution of each text, every byte read and labelled; zeros for an empty text."""
        column = texts.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b" ", np.uint8)
        size = np.diff(offsets)
        stride = WINDOW - 2 * CONTEXT
        windows = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // stride)), 0)
        owner = np.repeat(np.arange(len(size)), windows)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = number * stride
        length = np.minimum(WINDOW, size[owner] - begin)
        low = np.where(number > 0, CONTEXT, 0)
        high = np.where(number + 1 < windows[owner], WINDOW - CONTEXT, length)
        sums = np.zeros((len(size), max(1, len(self.languages))))
        # Windows of like length go through together.
        order = np.argsort(length, kind="stable")
        for i in range(0, len(order), at_once):
            part = order[i : i + at_once]
            at = np.minimum(np.arange(length[part[-1]])[:, None], length[part][None, :] - 1)
            x = data[(offsets[owner[part]] + begin[part])[None, :] + at]
            np.add.at(sums, owner[part], self.position_sums(x, length[part], low[part], high[part]))
        return sums / np.maximum(1, size)[:, None]


def train(docs: DataFrame) -> ByteGRU:
    """Learns from text and language of documents outside the held-out bucket.

    About ``DOCS_PER_LANGUAGE`` documents of each language are drawn by a hash of the id, their whole texts are read.
    Rows without text, language or (if of over ``LONGEST_TRAIN`` bytes) room are not drawn; repeated rows are drawn
    together; without rows every text is ``und``.
    """
    usable = docs.where(holdout_bucket("doc_id", HELD_OUT_MOD) != HELD_OUT).where("lang is not null and octet_length(text) between 1 and {0}".format(LONGEST_TRAIN))
    usable = usable.select("doc_id", "text", "lang")
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return ByteGRU([])
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, DOCS_PER_LANGUAGE / counts[k])))])
    draw = (F.xxhash64("doc_id", F.lit(1)).bitwiseAND(F.lit(2**31 - 1)) / float(2**31)) < share[F.col("lang")]
    found = sorted((bytes(r[0]), r[1]) for r in usable.where(draw).select(F.col("text").cast("binary"), "lang").collect())
    number = {k: i for i, k in enumerate(languages)}
    return ByteGRU(languages).fit([t for t, _ in found], np.array([number[lang] for _, lang in found], np.int64))


def predict(docs: DataFrame, model: ByteGRU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score), one row for each of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything for a model without languages.
    Texts of any length are read whole, in bounded memory; repeated rows get equal results; a null id is kept; other
    columns are ignored; an empty table gives an empty one.
    """

    @frugal
    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, 2500) for at in range(0, batch.num_rows, 2500)):
                letters = [bool(t and _LETTER.search(t)) for t in part.column(2).to_pylist()]
                known = np.array(letters, bool) & bool(model.languages)
                read = pc.if_else(pa.array(known), part.column(2), pa.scalar("", part.column(2).type))
                prob = model.document_probabilities(read)
                tags = [model.languages[b] if ok else "und" for b, ok in zip(prob.argmax(axis=1).tolist(), known.tolist())]
                score = np.where(known, np.clip(prob.max(axis=1).round(6), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(tags, pa.string()), pa.array(score, pa.float64())], ["id", "held_out", "lang_pred", "score"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(col(id_col).alias("id"), (holdout_bucket(id_col, HELD_OUT_MOD) == HELD_OUT).alias("held_out"), col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double")
