"""Calibration by fold and the block policy against plain versions; batch against stream."""

import math
import random

import numpy as np
import pytest
from test_streaming import _stream

from tidemark.operators import calibration
from tidemark.streaming import block_policy as bp


def plain_newton(rows):
    """Both coefficients by full Newton steps on numpy arrays, classes balanced by their counts."""
    p, y, w = (np.array(c, float) for c in zip(*rows))
    p = np.clip(p, 1e-5, 1 - 1e-5)
    x = np.stack((np.log(p / (1 - p)), np.ones(len(p))), 1)
    w = w * len(y) / (2 * np.where(y == 1, y.sum(), len(y) - y.sum()))
    theta = np.zeros(2)
    for _ in range(40):
        q = 1 / (1 + np.exp(-x @ theta))
        theta -= np.linalg.solve(np.eye(2) + 0.25 * (x.T * (w * q * (1 - q))) @ x, theta + 0.25 * x.T @ (w * (q - y)))
    return theta


def test_prequential_calibration(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1400):
        fold, group = 1 + i % 4, rng.choice(["a", "a", "a", "b", None])
        p = rng.random()
        rows.append((i, fold, group, p, int(rng.random() < 0.2 + 0.4 * p), 1 + rng.random()))
    rows += [(9000, 3, "a", None, 1, 1.0), (9001, 2, "a", 0.4, None, 1.0), (9002, 4, "one", 0.3, 1, 1.0), (9003, 4, "a", 0.0, 1, 1.0), (9004, 4, "a", 1.0, 0, 1.0)]
    df = spark.createDataFrame(rows, "id int, fold int, grp string, p double, y int, w double").repartition(5)
    got = {r["id"]: r for r in calibration.prequential_calibration(df, "p", "y", "fold", "grp", "w").collect()}
    assert len(got) == len(rows)
    for i, fold, group, p, y, w in rows:
        past = [(r[3], r[4], r[5]) for r in rows if r[1] < fold and r[2] == group and r[3] is not None and r[4] is not None]
        assert got[i]["history_n"] == len(past)
        if len(past) < 150:
            assert got[i]["identity"] and got[i]["calibrated"] == p
        elif p is None:
            assert got[i]["calibrated"] is None
        else:
            slope, constant = plain_newton(past)
            q = min(max(p, 1e-5), 1 - 1e-5)
            assert not got[i]["identity"] and math.isclose(got[i]["calibrated"], 1 / (1 + math.exp(-(slope * math.log(q / (1 - q)) + constant))), rel_tol=1e-8)
    assert any(not r["identity"] for r in got.values()) and any(r["identity"] for r in got.values())


def test_calibration_without_history(spark):
    df = spark.createDataFrame([(1, 1, 0.3, 1)], "id int, fold int, p double, y int")
    row = calibration.prequential_calibration(df, "p", "y", "fold").first()
    assert (row["calibrated"], row["identity"], row["history_n"]) == (0.3, True, 0)
    assert calibration.prequential_calibration(df.limit(0), "p", "y", "fold").count() == 0


COLS = "k string, id int, t bigint, p double, y int, ret double"


def made(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = rng.random()
        rows.append(("abc"[i % 3], i, 10 * i, p, int(rng.random() < (1 - p if i % 3 == 0 else 0.3 + 0.4 * p)), rng.uniform(-0.02, 0.02)))
    return rows


def build(df):
    return bp.block_policy(df, "k", "id", "t", "p", "y", "ret")


def plain_auc(rows):
    pos, neg = [r[3] for r in rows if r[4] == 1], [r[3] for r in rows if r[4] == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_block_policy_parts(spark):
    rows = made(330)
    got = [r for r in build(spark.createDataFrame(rows, COLS).repartition(4)).collect()]
    assert len(got) == 3 * 100
    by_id = {r[1]: r for r in rows}
    flips = set()
    for key in "abc":
        own = [r for r in rows if r[0] == key]
        scored = {b: sorted((r for r in got if r["key"] == key and r["block"] == b), key=lambda r: int(r["event_id"])) for b in range(1, 6)}
        for b in range(1, 6):
            first = scored[b][0]
            assert [int(r["event_id"]) for r in scored[b]] == [r[1] for r in own[20 * (b - 1) : 20 * b]]
            auc = plain_auc(own[: 20 * (b - 1)])
            assert first["prior_auc"] == pytest.approx(auc) if auc is not None else first["prior_auc"] is None
            assert first["polarity_reversed"] == (auc is not None and auc < 0.48)
            flips.add(first["polarity_reversed"])
            if b > 1:
                right = {c: sum((r["oriented_probability"] >= c / 100) == (by_id[int(r["event_id"])][4] == 1) for r in scored[b - 1]) for c in range(30, 71)}
                best = [c for c in right if right[c] == max(right.values())]
                near = min(abs(c - 50) for c in best)
                assert first["direction_cutoff"] == max(c for c in best if abs(c - 50) == near) / 100
            else:
                assert first["direction_cutoff"] == 0.5 and not first["low_margin"]
            margins = [r["margin"] for r in scored[b]]
            edge = np.quantile(margins, 0.2 if first["low_margin"] else 0.8)
            assert [r["high_conf"] for r in scored[b]] == [m <= edge + 1e-12 if first["low_margin"] else m >= edge - 1e-12 for m in margins]
    assert flips == {True, False} and {r["low_margin"] for r in got} == {True, False}


def test_block_is_scored_before_its_outcomes(spark):
    rows = made(180)
    other = [(*r[:4], 1 - r[4], -r[5]) if r[1] >= 120 else r for r in rows]
    show = lambda x: sorted(tuple(r) for r in build(spark.createDataFrame(x, COLS)).collect())
    assert [r for r in show(rows) if r[2] <= 3] == [r for r in show(other) if r[2] <= 3]
    assert len(show(rows)) == 180


def test_block_policy_stream_equals_batch(spark, tmp_path):
    rows = made(330)
    whole = spark.createDataFrame(rows, COLS)
    frames = [spark.createDataFrame(rows[a:b], COLS) for a, b in ((0, 25), (25, 26), (26, 200), (200, 330))]
    got = _stream(spark, tmp_path, frames, "policy", build)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in build(whole).collect())


def test_block_policy_of_odd_rows(spark):
    rows = [("a", i, 5, 0.5, 1, 0.0) for i in range(20)] + [(None, 1, 1, 0.5, 1, 0.0), ("b", 1, None, 0.5, 1, 0.0), ("a", 99, 9, None, 1, 0.0)]
    got = build(spark.createDataFrame(rows, COLS)).collect()
    assert len(got) == 20 and all(r["prior_auc"] is None and r["high_conf"] for r in got)
    assert build(spark.createDataFrame([], COLS)).count() == 0
    with pytest.raises(Exception, match="lacks an outcome"):
        build(spark.createDataFrame([("a", i, i, 0.5, None if i == 3 else 1, 0.0) for i in range(20)], COLS)).collect()
