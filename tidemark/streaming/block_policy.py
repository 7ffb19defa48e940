"""Scoring in blocks under a policy that each completed block moves: polarity, cutoff and the side of the margin.

A key's rows go in time order, ``BLOCK`` at a time. A block is scored before its outcomes are looked at; then they are added to the
state. One definition serves a table, folded in one sorted pass, and a stream, whose open rows and history are kept as state.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BLOCK = 20
AUC_FLOOR, NEUTRAL = 0.48, 0.5
#: Margins that differ in the last bits alone are the same.
PLACES = 12
#: Hundredths that a cutoff may take.
CUTOFFS = range(30, 71)
QUANTILES, COST, LEAST_ACCURACY, NET_CLIP, NET_WEIGHT = {True: 0.2, False: 0.8}, 0.002, 0.6, 0.01, 5.0
IN = "key string, event_id string, at bigint, p double, y int, ret double"
OUT = (
    "key string, event_id string, block int, raw_probability double, oriented_probability double, probability double, prediction boolean, margin double, high_conf boolean, "
    "confidence_signal double, polarity_reversed boolean, direction_cutoff double, low_margin boolean, confidence_threshold double, prior_rows bigint, prior_auc double"
)
_LAST, _OPEN = {"oriented_probability": "double", "prediction": "boolean", "margin": "double", "y": "double", "ret": "double"}, {"event_id": "string", "at": "bigint", "p": "double", "y": "double", "ret": "double"}
STATE = "done int, positives array<double>, negatives array<double>, area double, " + ", ".join([*(f"last_{n} array<{t}>" for n, t in _LAST.items()), *(f"open_{n} array<{t}>" for n, t in _OPEN.items())])


@dataclass
class Policy:
    """What completed blocks have left: sorted raw scores by class, the area under their curve, the last block."""

    done: int = 0
    positives: list[float] = field(default_factory=list)
    negatives: list[float] = field(default_factory=list)
    area: float = 0.0  # pairs in which the positive row scores higher, ties by half
    last: pd.DataFrame | None = None

    def auc(self) -> float | None:
        pairs = len(self.positives) * len(self.negatives)
        return self.area / pairs if pairs else None

    def score(self, key: str, rows: pd.DataFrame) -> pd.DataFrame:
        """Scores a block without its outcomes."""
        auc = self.auc()
        flip = auc is not None and auc < AUC_FLOOR
        cutoff = NEUTRAL if self.last is None else best_cutoff(self.last)
        low = self.last is not None and side_score(self.last, True) > side_score(self.last, False)
        p = rows["p"].to_numpy(float)
        oriented = 1.0 - p if flip else p
        probability = np.clip(0.5 + oriented - cutoff, 0.0, 1.0)
        margin = np.round(np.abs(probability - NEUTRAL), PLACES)
        threshold = edge_of(margin, low)
        return pd.DataFrame({
            "key": key, "event_id": rows["event_id"].to_numpy(), "block": self.done + 1, "raw_probability": p, "oriented_probability": oriented, "probability": probability,
            "prediction": probability >= NEUTRAL, "margin": margin, "high_conf": margin <= threshold if low else margin >= threshold, "confidence_signal": -margin if low else margin,
            "polarity_reversed": flip, "direction_cutoff": cutoff, "low_margin": low, "confidence_threshold": threshold, "prior_rows": len(self.positives) + len(self.negatives), "prior_auc": auc,
        })

    def complete(self, scored: pd.DataFrame, y: list[int], ret: list[float]) -> None:
        """Adds the outcomes of the block that was scored last."""
        for p, label in zip(scored["raw_probability"], y):
            if label == 1:
                self.area += (bisect_left(self.negatives, p) + bisect_right(self.negatives, p)) / 2
                insort(self.positives, p)
            else:
                self.area += len(self.positives) - (bisect_left(self.positives, p) + bisect_right(self.positives, p)) / 2
                insort(self.negatives, p)
        self.last = scored[["oriented_probability", "prediction", "margin"]].assign(y=y, ret=ret)
        self.done += 1


def best_cutoff(last: pd.DataFrame) -> float:
    """The cutoff that was right most often in the last block; ties go to the nearest to one half, then the larger."""
    oriented, y = last["oriented_probability"].to_numpy(), last["y"].to_numpy() == 1
    return max((int(((oriented >= c / 100) == y).sum()), -abs(c - 50), c) for c in CUTOFFS)[2] / 100


def edge_of(margin: np.ndarray, low: bool) -> float:
    return round(float(np.quantile(margin, QUANTILES[low])), PLACES)


def side_score(last: pd.DataFrame, low: bool) -> tuple[int, float]:
    """How the rows of least (greatest) margin did in the last block: checks passed, then accuracy and clipped net return."""
    margin = last["margin"].to_numpy()
    edge = edge_of(margin, low)
    rows = last[margin <= edge if low else margin >= edge]
    accuracy = float((rows["prediction"] == (rows["y"] == 1)).mean())
    # Sides that tie but for the last bits of a sum do tie.
    net = round(float((np.where(rows["prediction"], 1.0, -1.0) * rows["ret"] - COST).mean()), PLACES)
    return int(accuracy >= LEAST_ACCURACY) + int(net > 0), round(accuracy + NET_WEIGHT * float(np.clip(net, -NET_CLIP, NET_CLIP)), PLACES)


def _advance(key: str, policy: Policy, rows: pd.DataFrame) -> tuple[list[pd.DataFrame], pd.DataFrame]:
    """Full blocks of ``rows`` scored in turn, and the rows left over."""
    out = []
    while len(rows) >= BLOCK:
        block, rows = rows.iloc[:BLOCK], rows.iloc[BLOCK:]
        scored = policy.score(key, block.drop(columns=["y", "ret"]))
        if block["y"].isna().any() or block["ret"].isna().any() or not block["y"].isin([0, 1]).all():
            raise ValueError(f"a block of {key} lacks an outcome or has a label other than 0 and 1")
        policy.complete(scored, block["y"].astype(int).tolist(), block["ret"].tolist())
        out.append(scored)
    return out, rows


def block_policy(rows: DataFrame, key: str, event_id: str, time: str, prob: str, label: str, ret: str) -> DataFrame:
    """One scored row per row of a full block. ``time`` is a whole number or timestamp; ties go by id.

    Rows without key, time or probability are left out; a last block that is not full stays open. A missing or other outcome in a full block raises.
    As a table, keys are sorted within their partition and folded as they pass; memory holds one block and two numbers per earlier row of a key. As
    a stream, rows must arrive in time order; within a micro-batch they are sorted.
    """
    at = F.col(time).cast("bigint") if dict(rows.dtypes)[time] != "timestamp" else F.unix_micros(F.col(time))
    own = rows.select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("string").alias("event_id"), at.alias("at"), F.col(prob).cast("double").alias("p"), F.col(label).cast("int").alias("y"), F.col(ret).cast("double").alias("ret"))
    own = own.where("key IS NOT NULL AND at IS NOT NULL AND p IS NOT NULL")
    if not rows.isStreaming:

        def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, policy, left = None, Policy(), None
            for frame in frames:
                for name, part in frame.groupby("key", sort=False):
                    if name != now:
                        now, policy, left = name, Policy(), part.iloc[:0]
                    out, left = _advance(name, policy, pd.concat([left, part]) if len(left) else part)
                    yield from out

        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return own.repartition(parts, "key").sortWithinPartitions("key", "at", "event_id").mapInPandas(fold, OUT)

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState):
        policy, left = Policy(), None
        if state.exists:
            policy.done, positives, negatives, policy.area, *kept = state.get
            policy.positives, policy.negatives = list(positives), list(negatives)
            last, open_ = kept[: len(_LAST)], kept[len(_LAST) :]
            policy.last = pd.DataFrame(dict(zip(_LAST, map(list, last)))) if policy.done else None
            left = pd.DataFrame(dict(zip(_OPEN, map(list, open_))))
        new = pd.concat(list(frames)).sort_values(["at", "event_id"], kind="stable")[list(_OPEN)]
        out, left = _advance(k[0], policy, pd.concat([left, new]) if left is not None and len(left) else new)
        arrays = lambda f, names: [f[n].astype({"double": float, "boolean": bool, "bigint": int}.get(names[n], object)).tolist() if f is not None else [] for n in names]
        state.update((policy.done, policy.positives, policy.negatives, policy.area, *arrays(policy.last, _LAST), *arrays(left, _OPEN)))
        yield pd.concat(out) if out else pd.DataFrame(columns=[f.split()[0] for f in OUT.split(", ")])

    return own.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
