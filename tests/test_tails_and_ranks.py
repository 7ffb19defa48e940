"""Frames over blocks and ranks against a reference, by plain pandas and numpy."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import rank_policy, tails
from tidemark.plans import legacy_labels

MINUTE = 60_000_000


@pytest.fixture(scope="module")
def bars():
    rng = np.random.default_rng(3)
    n = 700
    close = rng.uniform(1, 9, n).round(2)
    close[200:215] = 4.0  # no move at all
    close[300] = 0.0
    volume = rng.integers(0, 5, n)
    volume[400:440] = 0
    return pd.DataFrame({"bt": np.cumsum(rng.integers(1, 4, n)) * MINUTE, "open": rng.uniform(1, 9, n), "high": close + 1, "low": np.maximum(close - 1, 0), "close": close, "volume": volume})


def test_bar_tails_equal_frames_over_the_whole_series(spark, bars):
    got = tails.bar_tails(spark.createDataFrame(bars), block=150).orderBy("rn").toPandas()
    assert got["rn"].tolist() == list(range(1, 701))
    r = bars["close"].pct_change().where(bars["close"].shift() != 0)
    for at in [0, 1, 4, 6, 11, 31, 149, 150, 151, 210, 214, 215, 299, 301, 330, 420, 439, 440, 599, 699]:
        pre, own, row = bars.iloc[max(0, at - 125) : at], got.iloc[at], bars.iloc[at]
        moves = r.iloc[max(1, at - 124) : at] if at > 1 else r.iloc[:0]
        assert own["n_pre"] == len(pre)
        want = {"pre_vol_10": moves.tail(10).std() if len(moves) >= 5 else np.nan, "up_fraction_30": (moves.tail(30).dropna() > 0).mean() if len(moves) >= 10 else np.nan}
        if len(pre):
            want["volume_ratio_5_30"] = pre["volume"].tail(5).mean() / max(pre["volume"].tail(30).mean(), 1)
            want["range_60m"] = (pre["high"].tail(60).max() - pre["low"].tail(60).min()) / row["close"] if row["close"] else np.nan
            w = pre.tail(30)
            vwap = np.average(w["close"], weights=w["volume"]) if w["volume"].sum() else w["close"].mean()
            want["vwap_distance_30"] = row["close"] / vwap - 1
        t = pre["close"].tail(60)
        want["trend_slope_60"] = np.polyfit(np.arange(len(t)), np.log(t), 1)[0] if len(t) >= 5 and (t > 0).all() else np.nan
        m = moves.tail(30)
        if len(moves) >= 10 and m.notna().all() and m.iloc[1:].std() > 0 and m.iloc[:-1].std() > 0:
            want["return_autocorr_30"] = m.autocorr(1)
        for name, value in want.items():
            assert own[name] == pytest.approx(value, abs=1e-9, nan_ok=True), (at, name)
    assert tails.bar_tails(spark.createDataFrame(bars).limit(0)).count() == 0
    with pytest.raises(ValueError):
        tails.in_blocks(spark.createDataFrame(bars), ["bt"], 20, block=10)


def test_ladder_of_the_older_row(spark):
    noon = 1_704_729_600_000_000  # Monday 2024-01-08 16:00 UTC, 11:00 in New York
    day = 1440 * MINUTE
    bars = [(noon + m * MINUTE, 1.0 + m % 7, 2.0 + m % 5, 9.0, 1.0, 3) for m in range(-60, 61)] + [(noon + day + 30 * MINUTE, 1.0, 1.0, 1.0, 1.0, 1)]
    bars = spark.createDataFrame(bars, "bt bigint, open double, close double, high double, low double, volume bigint")
    news = [(1, noon), (2, noon - 200 * MINUTE), (3, noon + 268 * MINUTE), (4, noon + 58 * MINUTE), (5, noon + 100 * MINUTE), (6, noon + 2 * day), (7, None), (8, noon - 60 * MINUTE), (9, noon)]
    rows = {r["event_id"]: r for r in legacy_labels.label(spark.createDataFrame([(*n, "US") for n in news], "event_id bigint, t bigint, market string"), bars).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {
        1: "OK", 2: "OFF_HOURS", 3: "TOO_LATE", 4: "CROSSES_SESSION", 5: "BAR_MISSING", 6: "BAR_MISSING", 7: "OFF_HOURS", 8: "NO_PREHISTORY", 9: "OK",
    }
    one = rows[1]
    close = lambda m: 2.0 + m % 5
    assert one["fwd_ret_30m"] == pytest.approx(close(32) / close(2) - 1, abs=1e-6) and one["up"] == (close(32) > close(2))
    assert one["pre_ret_5"] == pytest.approx(close(2) / close(-3) - 1, abs=1e-6) and one["pre_ret_60"] == pytest.approx(close(2) / close(-58) - 1, abs=1e-6)
    assert one["minutes_from_open"] == 90 and rows[2]["up"] is None


def _plain_rank(reference, values, middle):
    reference = np.sort(reference[np.isfinite(reference)])
    left, right = (np.searchsorted(reference, values, side=s) for s in ("left", "right"))
    ranks = (left + right + 1) / (2 * len(reference)) if middle else right / len(reference)
    return np.where(np.isfinite(values), ranks, 0.5)


@pytest.mark.parametrize("middle", [False, True])
def test_ranks_against_fitted_rows(spark, middle):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"k": range(400), "fitted": rng.random(400) < 0.6, "a": rng.integers(0, 40, 400) / 4.0, "b": rng.normal(size=400)})
    frame.loc[3, "a"], frame.loc[5, "b"], frame.loc[7, "b"] = np.inf, np.nan, -np.inf
    rows = spark.createDataFrame(frame)
    got = rank_policy.reference_ranks(rows, "k", ["a", "b"], middle=middle).orderBy("k").toPandas()
    for v in "ab":
        np.testing.assert_allclose(got[f"{v}_rank"], _plain_rank(frame.loc[frame["fitted"], v].to_numpy(), frame[v].to_numpy(), middle))
    empty = rank_policy.reference_ranks(rows.withColumn("fitted", F.lit(None).cast("boolean")), "k", ["a"], middle=middle)
    assert empty.select("a_rank").distinct().collect() == [(0.5,)]
    assert rank_policy.reference_ranks(rows.limit(0), "k", ["a"], middle=middle).count() == 0


def test_gate_without_opportunities(spark):
    rows = spark.createDataFrame([(i, True, i / 10, None) for i in range(10)], "k bigint, fitted boolean, raw double, o double")
    got = rank_policy.confidence_gate(rows, "k", "raw", "o", cutoff=0.5, sign=1.0, margin_weight=1.0, gate=0.8).orderBy("k").collect()
    margin = np.abs(np.arange(10) / 10 - 0.5)
    blend = _plain_rank(margin, margin, True)
    np.testing.assert_allclose([r["margin"] for r in got], blend)
    assert [r["gated"] for r in got] == (_plain_rank(blend, blend, True) >= 0.8).tolist()


def test_time_frames_hold_minutes_and_hours(spark, tmp_path):
    """Frames of 1 to 60 minutes and of 1 to 60 hours before each event, against counting them one by one."""
    from tidemark.plans import catalog

    start, seconds = datetime(2024, 3, 1), [0, 30, 59, 60, 3000, 3600, 3601, 7300, 90000, 216000, 216060]
    rows = [(i, 7 + i % 2, float(i * i), start + timedelta(seconds=s)) for i, s in enumerate(seconds * 2)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r for r in catalog.QUERIES["time_frames_six"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, user, _, t in rows:
        for m in (1, 2, 5, 10, 30, 60):
            for name, length in ((f"{m}", timedelta(minutes=m)), (f"{m}h", timedelta(hours=m))):
                frame = [v for _, u, v, s in rows if u == user and t - length <= s < t]
                assert got[i][f"n_{name}"] == len(frame)
                assert got[i][f"mean_{name}"] == (round(sum(frame) / len(frame), 6) if frame else None)
                assert got[i][f"range_{name}"] == (max(frame) - min(frame) if frame else None)
