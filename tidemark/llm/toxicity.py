"""Toxicity by non-negative positive-unlabelled learning, trained in numpy on the executors.

Confirmed toxic rows are the positives; every document, labelled or not, is unlabelled text. The risk of the
negatives is estimated as the unlabelled risk less the class prior times the positives' share of it, and where that
estimate falls below zero it counts as zero (the non-negative correction). The model is linear in distinct
hashed words and six measures of form.

All rows outside the held-out bucket take part. A first pass counts in how many rows each hashed word occurs, a
second keeps the words whose counts differ between the two kinds as compact rows, and each step of the descent sums
the whole gradient over them on the executors. Only counts and sums of a fixed size reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checked_broadcast, col, frugal, holdout_bucket, materialise, shuffle_partitions
from tidemark.llm.features import N_SHAPE, Slots, features, score_rows

SLOTS = 1 << 18
#: A slot is used if its share of the positives differs from that of the unlabelled rows by so many standard errors.
EVIDENCE = 4.0
#: Slots of the model, those of most evidence.
USED = 4096
#: Rows to a compact row, and tasks that add up what the others found.
ROWS, ADDERS = 2000, 16
#: Tasks whose sums (100 KB each) the driver adds itself.
FEW_TASKS = 64
HELD_OUT_MOD = 5
_BLOCK = 1 << 13


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class PUModel:
    """Linear scores over hashed words; ``weights`` then ``shape`` then ``bias``."""

    def __init__(self, size: int = SLOTS):
        self.weights, self.shape, self.bias = np.zeros(size), np.zeros(N_SHAPE), 0.0

    def decision(self, row, slot, value, shape):
        return np.bincount(row, self.weights[slot] * value, len(shape)) + shape @ self.shape + self.bias


def risk_parts(theta: np.ndarray, ptr, slot, value, shape, positive) -> np.ndarray:
    """Sums over some rows: the positives' and unlabelled rows' number, risk as negatives and gradients.

    A row is [n, risk, *gradient]: of the positives as positives, of the positives as negatives, of all as negatives.
    Every row is unlabelled text, the positives are counted as such too.
    """
    n, k = len(shape), len(theta) - N_SHAPE - 1
    row = np.repeat(np.arange(n), np.diff(ptr))
    f = np.bincount(row, theta[slot] * value, n) + shape @ theta[k:-1] + theta[-1]
    s, loss = _sigmoid(f), np.logaddexp(0, f)
    out = np.empty((3, 2 + len(theta)))
    for i, (weight, risk) in enumerate(((positive * (s - 1), positive * (loss - f)), (positive * s, positive * loss), (s, loss))):
        out[i, 0], out[i, 1] = (n if i == 2 else positive.sum()), risk.sum()
        out[i, 2 : 2 + k] = np.bincount(slot, weight[row] * value, k)
        out[i, 2 + k : -1], out[i, -1] = weight @ shape, weight.sum()
    return out


def descent_gradient(parts: np.ndarray, prior: float) -> np.ndarray:
    """The gradient of the non-negative risk, to which the negatives' part adds nothing where it is below zero.

    Steps back from there, which suit the noise of small batches, would keep the whole sum from ever getting further.
    """
    n_pos, n_all = max(parts[0, 0], 1.0), max(parts[2, 0], 1.0)
    negative = parts[2, 1] / n_all - prior * parts[1, 1] / n_pos
    of_negative = parts[2, 2:] / n_all - prior * parts[1, 2:] / n_pos
    return prior * parts[0, 2:] / n_pos + (of_negative if negative >= 0 else 0)


def _summed(rows: DataFrame) -> list:
    """(block, sums) added up by block, in a fixed number of tasks."""

    @frugal
    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(sums, np.float64)
                total[block] = total[block] + part if block in total else part
        for block, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["block", "sums"])

    return rows.repartition(min(ADDERS, shuffle_partitions(rows.sparkSession)), "block").mapInArrow(add, "block bigint, sums binary").collect()


def _presence(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """In how many positives and in how many rows each slot occurs, and the number of both."""

    @frugal
    def count(batches):
        seen, n = np.zeros((2, SLOTS)), np.zeros(2)
        slots = Slots(SLOTS)
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                row, slot, _, _ = features(part.column(0).to_pylist(), slots)
                positive = part.column(1).to_numpy(zero_copy_only=False)
                seen[0] += np.bincount(slot[positive[row]], minlength=SLOTS)
                seen[1] += np.bincount(slot, minlength=SLOTS)
                n += (positive.sum(), len(positive))
        blocks = [-1, *range(0, SLOTS // _BLOCK)]
        sums = [n, *(seen[:, b * _BLOCK : (b + 1) * _BLOCK] for b in blocks[1:])]
        if n[1]:
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([x.tobytes() for x in sums], pa.binary())], ["block", "sums"])

    seen, n = np.zeros((2, SLOTS)), np.zeros(2)
    for block, sums in _summed(rows.mapInArrow(count, "block bigint, sums binary")):
        part = np.frombuffer(bytes(sums), np.float64)
        if block < 0:
            n = part
        else:
            seen[:, block * _BLOCK : (block + 1) * _BLOCK] = part.reshape(2, -1)
    return seen[0], seen[1], int(n[0]), int(n[1])


def used_slots(in_pos: np.ndarray, in_all: np.ndarray, n_pos: int, n_all: int) -> np.ndarray:
    """The slots of most evidence, ascending. Without evidence, a slot of few positives would only fit noise."""
    pooled = (in_pos + in_all) / (n_pos + n_all)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n_pos + 1 / n_all))
    evidence = np.where(in_pos >= 3, np.abs(in_pos / n_pos - in_all / n_all) / error, 0)
    best = np.argsort(-evidence, kind="stable")[:USED]
    return np.sort(best[evidence[best] >= EVIDENCE])


def _compact(rows: DataFrame, used: np.ndarray) -> DataFrame:
    """The rows' used features, ``ROWS`` to one: ptr, slot, value, shape and positive as bytes."""
    place = np.full(SLOTS, -1, np.int32)
    place[used] = np.arange(len(used))

    @frugal
    def run(batches):
        slots = Slots(SLOTS)
        for batch in batches:
            for part in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                held = [features(part.column(0).slice(at, 500).to_pylist(), slots) for at in range(0, len(part), 500)]
                row = np.concatenate([x[0] + 500 * i for i, x in enumerate(held)])
                slot, value = place[np.concatenate([x[1] for x in held])], np.concatenate([x[2] for x in held])
                keep = slot >= 0
                ptr = np.searchsorted(row[keep], np.arange(len(part) + 1))
                parts = [ptr.astype(np.int32), slot[keep].astype(np.uint16), value[keep].astype(np.float32), np.concatenate([x[3] for x in held]).astype(np.float32)]
                parts.append(part.column(1).to_numpy(zero_copy_only=False).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["ptr", "slot", "value", "shape", "positive"])

    return rows.mapInArrow(run, "ptr binary, slot binary, value binary, shape binary, positive binary")


def _parts(compact: DataFrame, theta: np.ndarray) -> np.ndarray:
    @frugal
    def run(batches):
        total = np.zeros((3, 2 + len(theta)))
        for batch in batches:
            for columns in zip(*(c.to_pylist() for c in batch.columns)):
                ptr, slot, value, shape, positive = (np.frombuffer(c, t) for c, t in zip(columns, (np.int32, np.uint16, np.float32, np.float32, np.uint8)))
                total += risk_parts(theta, ptr, slot, value, shape.reshape(-1, N_SHAPE), positive)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["block", "sums"])

    found = compact.mapInArrow(run, "block bigint, sums binary")
    if compact.rdd.getNumPartitions() > FEW_TASKS:
        # Each adder first takes a share of the tasks; what they found is added on the driver.
        rows = _summed(found.withColumn("block", F.pmod(F.spark_partition_id(), F.lit(ADDERS)).cast("bigint")))
    else:
        rows = found.collect()
    return sum((np.frombuffer(bytes(r[1]), np.float64) for r in rows), np.zeros(3 * (2 + len(theta)))).reshape(3, -1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: int = 50, rate: float = 0.04, l2: float = 5e-4) -> PUModel:
    """Fits on all rows outside the held-out bucket, by Adam on the whole non-negative risk with the logistic loss.

    A document is positive if any label of its id says so; null labels say nothing, null and empty texts have form
    only. Without a single positive every score is the prior's: the model keeps its bias only. Repeated rows count
    each; columns other than the two named may have any name.
    """
    open_labels = labels.where(holdout_bucket("doc_id", HELD_OUT_MOD) != 0).where("toxic is not null").select("doc_id", "toxic")
    prior = min(0.9, max(0.01, open_labels.agg(F.avg("toxic")).first()[0] or 0.01))
    toxic = open_labels.where("toxic = 1").select("doc_id").distinct().withColumn("positive", F.lit(True))
    open_docs = docs.where(holdout_bucket(id_col, HELD_OUT_MOD) != 0).select(col(id_col).alias("doc_id"), col(text_col).cast("binary").alias("text"))
    rows = open_docs.join(checked_broadcast(toxic), "doc_id", "left").select("text", F.coalesce("positive", F.lit(False)).alias("positive"))
    model = PUModel()
    model.bias = float(np.log(prior / (1 - prior)))
    in_pos, in_all, n_pos, n_all = _presence(rows)
    if not n_pos:
        return model
    used = used_slots(in_pos, in_all, n_pos, n_all)
    compact = materialise(_compact(rows, used), "compact")
    theta = np.zeros(len(used) + N_SHAPE + 1)
    theta[-1] = model.bias
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = descent_gradient(_parts(compact, theta), prior)
        grad[:-1] += l2 * theta[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta -= rate * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    model.weights[used], model.shape, model.bias = theta[: len(used)], theta[len(used) : -1], float(theta[-1])
    return model


def score(docs: DataFrame, model: PUModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bucket, score), one row for each of ``docs``.

    Null and empty texts get what form and bias say, whole texts of any length are read, equal texts score alike, a
    null id is kept (bucket 0), other columns are ignored, an empty table gives an empty one.
    """
    return score_rows(docs, id_col, text_col, SLOTS, lambda *x: [_sigmoid(model.decision(*x))], "score double", HELD_OUT_MOD)


def clean_rows(docs: DataFrame, model: PUModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below ``threshold``, all columns as they were, whatever their names.

    Null and empty texts are scored by form; rows with equal texts stay or go together; an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    @frugal
    def run(batches):
        slots = Slots(SLOTS)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                low = _sigmoid(model.decision(*features(part.column(at).cast(pa.binary()).to_pylist(), slots))) < threshold
                yield part.filter(pa.array(low))

    return docs.mapInArrow(run, docs.schema)
