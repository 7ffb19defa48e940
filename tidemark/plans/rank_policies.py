"""Two rank policies on the labelled rows of ``legacy_labels``: fitted on the first twenty days, scored on all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import rank_policy
from tidemark.plans import legacy_labels
from tidemark.session import load
from tidemark.storage import materialise

FIRST_DAYS = "ts < TIMESTAMP '2024-01-21 00:00:00'"
HALF_HOURS = "CAST(hour(ts) * 2 + floor(minute(ts) / 30) AS INT)"
GATE = dict(cutoff=0.52, sign=-1.0, margin_weight=0.6, gate=0.8)


def _rows(spark: SparkSession, sf_dir: str, market: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", F.expr(f"{FIRST_DAYS}").alias("fitted"), F.expr(HALF_HOURS).alias("half_hour"))
    texts = load(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("event_id")).agg(F.max("n_chars").alias("n_chars"))
    rows = legacy_labels.legacy_label_rows(spark, sf_dir).where((F.col("status") == "OK") & (F.col("market") == market))
    return materialise(rows.join(events, "event_id").join(texts, "event_id", "left"), "policy_rows")


def rank_blend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blend of ranks for one market. The text's score is the share its length has of itself and a thousand."""
    rows = _rows(spark, sf_dir, "KR")
    rows = rows.select(
        "event_id", "fitted", "half_hour", "up", "pre_ret_15", (1 - F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("s_text"), (-F.coalesce("pre_ret_5", F.lit(0.0))).alias("s_5"),
        (-F.coalesce("pre_ret_30", F.lit(0.0))).alias("s_30"), F.coalesce("pre_vol_10", F.lit(0.0)).alias("s_vol"), F.coalesce("volume_ratio_5_30", F.lit(0.0)).alias("s_volume"),
    )
    rows = rows.withColumn("up", F.col("up").cast("int"))
    got = rank_policy.rank_blend(rows, "event_id", ["s_text", "s_5", "s_30", "s_vol", "s_volume"], "half_hour", "up", "pre_ret_15")
    return got.select("event_id", *[F.round(c, 6).alias(c) for c in ("direction", "confidence", "probability")])


def confidence_gate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate for the other market; the raw probability leans against the last five minutes' move."""
    move = F.col("pre_ret_5")
    rows = _rows(spark, sf_dir, "US").select("event_id", "fitted", "volume_ratio_5_30", (0.5 - 0.5 * F.coalesce(move / (1 + F.abs(move)), F.lit(0.0))).alias("raw"))
    got = rank_policy.confidence_gate(rows, "event_id", "raw", "volume_ratio_5_30", **GATE)
    return got.select("event_id", "gated", F.round("margin", 6).alias("margin"), F.round("probability", 6).alias("probability"))


_BASE = f"""l AS ({legacy_labels.ORACLES['legacy_label_rows']}), x AS (SELECT doc_id, max(n_chars) AS n_chars FROM documents GROUP BY doc_id),
    o AS (SELECT l.*, {FIRST_DAYS} AS fitted, {HALF_HOURS.replace('floor(minute(ts) / 30)', 'minute(ts) // 30')} AS half_hour, n_chars FROM l JOIN events e ON e.event_id = l.event_id LEFT JOIN x ON x.doc_id = l.event_id WHERE status = 'OK')"""


def _rank(table: str, v: str) -> str:
    return f"CASE WHEN r.{v} IS NULL THEN 0.5 ELSE coalesce((SELECT count(*) FROM {table} f WHERE f.fitted AND f.{v} <= r.{v}) / nullif((SELECT count({v}) FROM {table} f WHERE f.fitted), 0), 0.5) END AS {v}_rank"


def _middle(table: str, v: str) -> str:
    both = f"(SELECT count(*) FROM {table} f WHERE f.fitted AND f.{v} <= r.{v}) + (SELECT count(*) FROM {table} f WHERE f.fitted AND f.{v} < r.{v})"
    return f"coalesce(({both} + 1) / nullif(2 * (SELECT count({v}) FROM {table} f WHERE f.fitted), 0), 0.5) AS {v}_rank"


BLEND_SQL = f"""WITH {_BASE}, k AS (SELECT * FROM o WHERE market = 'KR'), p AS (SELECT avg(up::INT) AS prior FROM k WHERE fitted),
    h AS (SELECT half_hour, (sum(up::INT) + 20 * any_value(prior)) / (count(*) + 20) AS mean FROM k, p WHERE fitted GROUP BY half_hour),
    a AS (SELECT k.event_id, fitted, 1 - n_chars / (n_chars + 1000.0::DOUBLE) AS s0, -coalesce(pre_ret_5, 0) AS s1, -coalesce(pre_ret_30, 0) AS s2, coalesce(pre_vol_10, 0) AS s3, coalesce(volume_ratio_5_30, 0) AS s4,
        1 - coalesce(h.mean, prior) AS c, abs(pre_ret_15) AS b FROM k LEFT JOIN h ON h.half_hour = k.half_hour, p),
    r1 AS (SELECT r.event_id, r.fitted, {', '.join(_rank('a', v) for v in ('s0', 's1', 's2', 's3', 's4', 'c', 'b'))} FROM a r),
    d AS (SELECT *, (1 - 0.4::DOUBLE) * ((s0_rank + s1_rank + s2_rank + s3_rank + s4_rank) / 5) + 0.4::DOUBLE * c_rank AS direction FROM r1), g AS (SELECT *, abs(direction - 0.64::DOUBLE) AS far FROM d),
    r2 AS (SELECT r.*, {_rank('g', 'far')} FROM g r), q AS (SELECT *, far_rank + 1.4::DOUBLE * b_rank - 0.4::DOUBLE * (direction >= 0.64::DOUBLE)::INT AS raw FROM r2), r3 AS (SELECT r.*, {_rank('q', 'raw')} FROM q r)
    SELECT event_id, round(direction, 6) AS direction, round(raw_rank, 6) AS confidence, round(CASE WHEN direction >= 0.64::DOUBLE THEN 0.51 + 0.49 * raw_rank ELSE 0.49 - 0.49 * raw_rank END, 6) AS probability FROM r3"""
GATE_SQL = f"""WITH {_BASE}, k AS (SELECT * FROM o WHERE market = 'US'), p AS (SELECT median(volume_ratio_5_30) AS mid FROM k WHERE fitted),
    a AS (SELECT event_id, fitted, 0.5::DOUBLE - 0.5::DOUBLE * coalesce(pre_ret_5 / (1 + abs(pre_ret_5)), 0) AS raw, -coalesce(volume_ratio_5_30, mid, 0) AS opp FROM k, p), m AS (SELECT *, abs(raw - 0.52::DOUBLE) AS margin FROM a),
    r1 AS (SELECT r.*, {_middle('m', 'margin')}, {_middle('m', 'opp')} FROM m r), b AS (SELECT *, 0.6::DOUBLE * margin_rank + (1 - 0.6::DOUBLE) * opp_rank AS blend FROM r1), r2 AS (SELECT r.*, {_middle('b', 'blend')} FROM b r),
    c AS (SELECT *, CASE WHEN blend_rank >= 0.8::DOUBLE THEN 0.86 + 0.14 * margin_rank ELSE 0.84 * margin_rank END AS conf FROM r2)
    SELECT event_id, blend_rank >= 0.8::DOUBLE AS gated, round(margin_rank, 6) AS margin, round(least(greatest(CASE WHEN raw >= 0.52::DOUBLE THEN 0.5 + 0.5 * conf ELSE 0.5 - 0.5 * conf END, 1e-6), 1 - 1e-6), 6) AS probability FROM c"""

QUERIES = {"rank_blend_rows": rank_blend_rows, "confidence_gate_rows": confidence_gate_rows}
ORACLES = {"rank_blend_rows": BLEND_SQL, "confidence_gate_rows": GATE_SQL}
