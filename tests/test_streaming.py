"""Streaming operators against their batch forms."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import articles, text as tx
from tidemark.streaming import capture

T0 = datetime(2026, 1, 5, 10, 0)


def _stream(spark, tmp_path, frames, name, build):
    """Each frame lands as its own file and micro-batch; the rows that the query built on the stream appends."""
    src = tmp_path / name
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_usable_flag_keeps_late_rows(spark):
    rows = spark.createDataFrame([(1, T0, T0 + timedelta(minutes=2)), (2, T0, T0 + timedelta(minutes=3)), (3, None, T0)], "id int, published_at timestamp, captured_at timestamp")
    assert sorted((r.id, r.usable) for r in capture.flag_usable(rows).collect()) == [(1, True), (2, False), (3, False)]


def test_first_seen_stream_equals_batch(spark, tmp_path):
    cols = "k string, captured_at timestamp, v int"
    frames = [spark.createDataFrame([("a", T0, 1), ("b", T0, 2)], cols), spark.createDataFrame([("a", T0 + timedelta(hours=1), 3), ("c", T0, 4)], cols)]
    got = _stream(spark, tmp_path, frames, "seen", lambda s: capture.first_seen(s, "k"))
    assert sorted((r.k) for r in got.collect()) == ["a", "b", "c"]
    whole = capture.first_seen(frames[0].union(frames[1]), "k")
    assert sorted((r.k, r.v) for r in whole.collect()) == [("a", 1), ("b", 2), ("c", 4)]


def test_retry_schedule(spark, tmp_path):
    cols = "query_id string, attempt_at timestamp, error string, deterministic boolean, cadence_s int"
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [("q", at(0), "E1", True, 60), ("q", at(1), "E1", True, 60), ("q", at(2), None, None, 60), ("q", at(3), "E1", True, 60), ("q", at(4), "E2", True, 60), ("q", at(5), "E2", True, 60), ("q", at(6), "E2", True, 60), ("q", at(7), None, False, 60), ("r", at(0), "T", False, 60)]
    want = [("q", "BACKOFF", 1, 5), ("q", "BACKOFF", 2, 11), ("q", "READY", 0, 3), ("q", "BACKOFF", 1, 8), ("q", "BACKOFF", 2, 14), ("q", "BACKOFF", 3, 25), ("q", "QUARANTINED", 4, None), ("q", "QUARANTINED", 4, None), ("r", "BACKOFF", 1, 5)]
    show = lambda df: [(r.query_id, r.status, r.failures, None if r.next_due is None else (r.next_due - T0).total_seconds() / 60) for r in sorted(df.collect(), key=lambda r: (r.query_id, r.attempt_at))]
    assert show(capture.retry_schedule(spark.createDataFrame(rows, cols))) == want
    frames = [spark.createDataFrame(rows[:4], cols), spark.createDataFrame(rows[4:], cols)]
    assert show(_stream(spark, tmp_path, frames, "retry", capture.retry_schedule)) == want
    assert capture.circuit_opens(4, 1, 3, 3, 10, 0.5) and capture.circuit_opens(10, 5, 0, 3, 10, 0.5) and not capture.circuit_opens(4, 4, 2, 3, 10, 0.5)


def test_polarity_blocks(spark, tmp_path):
    cols = "k string, t int, s double, y int"
    rows = [("a", i, float(i % 4), int((i % 4 < 2) == (i < 4))) for i in range(10)]
    build = lambda s: capture.polarity_blocks(s, "k", "s", "y", "t", block=4)
    want = [("a", 0, 4, 0.0, False), ("a", 1, 4, 1.0, True)]
    assert sorted(tuple(r) for r in build(spark.createDataFrame(rows, cols)).collect()) == want
    frames = [spark.createDataFrame(rows[:3], cols), spark.createDataFrame(rows[3:], cols)]
    assert sorted(tuple(r) for r in _stream(spark, tmp_path, frames, "blocks", build).collect()) == want


def test_article_rules(spark):
    body = "the quick brown fox jumps over the lazy dog again and again " * 2
    rows = [(body + body, "abcd", "http://10.0.0.1/x", "2026-01-05T10:00:00Z"), ("사진=연합 재판매 금지", "abcx", "https://example.com/", "Mon, 05 Jan 2026 10:00:00 EST"), (None, None, None, None), ("plain", "", "http://u:p@a.com", "2026-01-05")]
    df = spark.createDataFrame(rows, "b string, a string, u string, p string")
    p = articles.published(F.col("p"))
    out = df.select(articles.nonarticle_reason(F.col("b")), F.round(articles.matching_blocks_ratio(F.lit("abcd"), F.col("a")), 6), articles.safe_public_url("u"), F.date_format(p["at"], "HH:mm"), p["precision"], p["confidence"], p["zone_inferred"]).collect()
    assert [tuple(r) for r in out] == [
        ("SHORT_REPEATED_CAPTION", 1.0, False, "10:00", "EXACT_SECOND", "HIGH", False),
        ("SHORT_PHOTO_CAPTION", 0.75, True, "15:00", "EXACT_SECOND", "HIGH", False),
        ("", 0.0, False, None, "UNKNOWN", "UNKNOWN", False),
        ("", 0.0, False, "00:00", "DATE_ONLY", "LOW", True),
    ]


def test_sessions_events_and_shift(spark):
    df = spark.createDataFrame([(datetime(2026, 7, 6, 14, 0), "US", "trial merger"), (datetime(2026, 7, 6, 1, 0), "KR", None)], "t timestamp, m string, x string")
    b = articles.session_bounds(F.col("t"), F.col("m"))
    kind = articles.best_event_type(F.col("x"), {"REG": ["approval"], "CLINICAL": ["trial"], "DEAL": ["merger"]}, F.lit("OTHER"))
    out = df.select(*[F.date_format(b[c], "HH:mm") for c in ("local", "open", "close")], kind, F.round(articles.shift_probability(F.lit(0.5), 1.0), 6)).collect()
    assert [tuple(r) for r in out] == [("10:00", "09:30", "16:00", "CLINICAL", 0.731059), ("10:00", "09:00", "15:30", "OTHER", 0.731059)]
