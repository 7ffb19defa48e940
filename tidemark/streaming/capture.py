"""Structured Streaming forms of the capture track: late-data flag, first-seen rows, retry schedule, count blocks."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def flag_usable(rows: DataFrame, published: str = "published_at", captured: str = "captured_at", minutes: int = 2) -> DataFrame:
    """Decision cutoff and whether the row was captured by it. Late rows stay and are marked; null times are not usable."""
    cutoff = F.col(published) + F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return rows.withColumn("decision_cutoff", cutoff).withColumn("usable", F.coalesce(F.col(captured) <= cutoff, F.lit(False)))


def first_seen(rows: DataFrame, key: str, captured: str = "captured_at", horizon: str = "7 days") -> DataFrame:
    """One row per key within the horizon; the watermark bounds the state. On a batch table: the earliest row of each key,
    of rows captured at one time the least. A stream keeps what arrives first."""
    if rows.isStreaming:
        return rows.withWatermark(captured, horizon).dropDuplicatesWithinWatermark([key])
    best = rows.groupBy(key).agg(F.min(F.struct(F.col(captured).alias("_at"), F.struct(*rows.columns).alias("_row"))).alias("_r"))
    return best.select("_r._row.*")


#: Fixed values of the retry rule: minutes of the first delay, its ceiling, equal deterministic failures to quarantine.
FIRST_DELAY, LONGEST_DELAY, QUARANTINE_AT = 5, 480, 3


def retry_step(state: tuple, at: datetime, error: str | None, deterministic: bool, cadence_s: int) -> tuple[tuple, str, datetime | None]:
    """(failures, fingerprint, repeats), one attempt -> the new state, status and next due time (none in quarantine)."""
    failures, fingerprint, repeats = state
    if fingerprint == "QUARANTINED":
        return state, "QUARANTINED", None
    if not error:
        return (0, "", 0), "READY", at + timedelta(seconds=int(cadence_s))
    failures += 1
    repeats = (repeats + 1 if fingerprint == error else 1) if deterministic else 0
    fingerprint = error if deterministic else ""
    if repeats >= QUARANTINE_AT:
        return (failures, "QUARANTINED", repeats), "QUARANTINED", None
    delay = min(LONGEST_DELAY, FIRST_DELAY * 2 ** min(failures - 1, 7))
    return (failures, fingerprint, repeats), "BACKOFF", at + timedelta(minutes=delay)


RETRY_OUT = "query_id string, attempt_at timestamp, status string, failures int, next_due timestamp"


def _fold(key: str, state: tuple, attempts: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    out = []
    for r in attempts.sort_values("attempt_at", kind="stable").itertuples(index=False):
        error = None if pd.isna(r.error) else str(r.error)
        state, status, due = retry_step(state, r.attempt_at, error, bool(r.deterministic), r.cadence_s)
        out.append((key, r.attempt_at, status, state[0], due))
    frame = pd.DataFrame(out, columns=["query_id", "attempt_at", "status", "failures", "next_due"])
    frame["next_due"] = pd.to_datetime(frame["next_due"])
    return state, frame


def retry_schedule(attempts: DataFrame) -> DataFrame:
    """(query_id, attempt_at, error, deterministic, cadence_s) to the status after each attempt; batch or stream."""
    cols = attempts.select("query_id", "attempt_at", "error", "deterministic", "cadence_s").where("query_id IS NOT NULL AND attempt_at IS NOT NULL")
    cols = cols.fillna({"deterministic": False, "cadence_s": 3600})
    if not attempts.isStreaming:
        return cols.groupBy("query_id").applyInPandas(lambda k, pdf: _fold(k[0], (0, "", 0), pdf)[1], RETRY_OUT)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        now = state.get if state.exists else (0, "", 0)
        now, out = _fold(key[0], now, pd.concat(list(frames)))
        state.update(now)
        yield out

    return cols.groupBy("query_id").applyInPandasWithState(step, RETRY_OUT, "failures int, fingerprint string, repeats int", "append", GroupStateTimeout.NoTimeout)


def circuit_opens(attempted: int, failed: int, consecutive: int, run: int, least: int, ratio: float) -> bool:
    """Open after ``run`` failures in a row, or where ``ratio`` of at least ``least`` attempts failed."""
    return consecutive >= run or (attempted >= least and failed / attempted >= ratio)


def _auc(scores, labels) -> float | None:
    ranks = pd.Series(scores).rank()
    y = pd.Series(labels)
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    return float((ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)) if pos and neg else None


BLOCK_OUT = "key string, block int, n int, auc double, flipped boolean"


def polarity_blocks(rows: DataFrame, key: str, score: str, label: str, order: str, block: int = 20, floor: float = 0.5) -> DataFrame:
    """Blocks of ``block`` rows in time order per key: each is flipped if the block before had an AUC under ``floor``.

    As a stream, rows are ordered within a micro-batch and blocks close as they fill; as a batch, whole keys at once
    (a last block that is not full is left open in both).
    """
    cols = rows.select(F.col(key).cast("string").alias("key"), F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"), F.col(order).alias("t")).dropna()

    def close(name, done, before, s, y):
        out = []
        while len(s) >= block:
            auc = _auc(s[:block], y[:block])
            out.append((name, done, block, auc, before is not None and before < floor))
            before, done, s, y = auc, done + 1, s[block:], y[block:]
        return pd.DataFrame(out, columns=["key", "block", "n", "auc", "flipped"]), done, before, s, y

    if not rows.isStreaming:

        def whole(k, pdf):
            pdf = pdf.sort_values(["t", "s"], kind="stable")
            return close(k[0], 0, None, pdf["s"].tolist(), pdf["y"].tolist())[0]

        return cols.groupBy("key").applyInPandas(whole, BLOCK_OUT)

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState):
        done, before, s, y = state.get if state.exists else (0, None, [], [])
        pdf = pd.concat(list(frames)).sort_values(["t", "s"], kind="stable")
        out, done, before, s, y = close(k[0], done, before, list(s) + pdf["s"].tolist(), list(y) + pdf["y"].tolist())
        state.update((done, before, s, y))
        yield out

    return cols.groupBy("key").applyInPandasWithState(step, BLOCK_OUT, "done int, before double, s array<double>, y array<int>", "append", GroupStateTimeout.NoTimeout)
