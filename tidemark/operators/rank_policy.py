"""Scores from ranks against the rows a policy was fitted on, and confidence from ranks of those scores.

A rank is the share of the fitted rows' values that are no greater. Distinct fitted values are counted first; counts and
rows then go through one global order, so no reference is collected, broadcast or held by a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import exact_quantiles, ordered
from tidemark.storage import materialise


def _finite(name: str) -> Column:
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def reference_ranks(rows: DataFrame, key: str, values: list[str], fitted: str = "fitted", middle: bool = False) -> DataFrame:
    """``rows`` with ``{value}_rank`` for each of ``values``; the reference are the rows whose ``fitted`` is true.

    Null, infinite and NaN values are no part of a reference and have rank one half, as have all where a reference is empty.
    With ``middle`` a rank is half of one more than the smaller and the no greater values together: it can pass one.
    ``key`` tells rows apart; all values are ranked in one pass over rows that are computed once.
    """
    rows = materialise(rows, "ranked")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), _finite(v).alias("v")) for i, v in enumerate(values)])).alias("x")
    long = rows.select(F.col(key).alias("_key"), F.coalesce(F.col(fitted), F.lit(False)).alias("_fit"), cells).select("_key", "_fit", "x.c", "x.v").where("v IS NOT NULL")
    counts = long.where("_fit").groupBy("c", "v").agg(F.count("*").alias("n")).withColumn("_asks", F.lit(False))
    asks = long.select("c", "v", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("_asks"), "_key")
    # At equal values the counted ones come first: they are no greater.
    placed = ordered(counts.unionByName(asks, allowMissingColumns=True), ["c", "v", "_asks"], {"upto": "n"}).where("_asks")
    every = counts.groupBy("c").agg(F.sum("n").alias("whole"))
    before = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)  # a row for each of ``values``
    starts = every.select("c", "whole", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("start"))
    placed = placed.join(F.broadcast(starts), "c").withColumn("upto", F.col("upto") - F.col("start"))
    share = F.col("upto") / F.col("whole")
    if middle:
        placed = placed.join(counts.select("c", "v", F.col("n").alias("same")), ["c", "v"], "left")
        share = (2 * F.col("upto") - F.coalesce("same", F.lit(0)) + 1) / (2 * F.col("whole"))
    ranked = placed.select("_key", "c", share.alias("share"))
    wide = ranked.groupBy("_key").agg(*[F.max(F.when(F.col("c") == i, F.col("share"))).alias(f"_{v}") for i, v in enumerate(values)])
    joined = rows.join(wide, F.col(key) == F.col("_key"), "left")
    return joined.select(*[rows[c] for c in rows.columns], *[F.coalesce(F.col(f"_{v}"), F.lit(0.5)).alias(f"{v}_rank") for v in values])


def rank_blend(
    rows: DataFrame, key: str, scores: list[str], kind: str, label: str, benchmark: str, fitted: str = "fitted", cutoff: float = 0.64, kind_weight: float = 0.4, strength: float = 20.0
) -> DataFrame:
    """(key, direction, confidence, probability) of a blend of ranks.

    Direction is the mean rank of ``scores``, blended with the rank of one minus the smoothed label mean of a row's ``kind``. Confidence
    is the rank of: the rank of the direction's distance from ``cutoff``, plus 1.4 ranks of the size of ``benchmark``, less
    0.4 above the cutoff. Kinds that no fitted row has take the overall mean; without fitted rows that is unknown and ranks one half.
    """
    known = rows.where(F.col(fitted))
    prior = known.agg(F.avg(F.col(label).cast("double")).alias("_prior"))
    kinds = known.groupBy(F.col(kind).alias("_kind")).agg(F.sum(F.col(label).cast("double")).alias("_sum"), F.count(label).alias("_count"))
    wide = rows.join(F.broadcast(prior)).join(kinds, F.col(kind).eqNullSafe(F.col("_kind")), "left")
    smooth = (F.col("_sum") + strength * F.col("_prior")) / (F.col("_count") + strength)
    wide = wide.select(key, fitted, *scores, (1 - F.coalesce(smooth, F.col("_prior"))).alias("_of_kind"), F.abs(benchmark).alias("_bench"))
    first = reference_ranks(wide, key, [*scores, "_of_kind", "_bench"], fitted)
    total = F.col(f"{scores[0]}_rank")
    for s in scores[1:]:
        total = total + F.col(f"{s}_rank")
    directed = first.withColumn("direction", (1 - kind_weight) * (total / len(scores)) + kind_weight * F.col("_of_kind_rank"))
    second = reference_ranks(directed.withColumn("_distance", F.abs(F.col("direction") - cutoff)), key, ["_distance"], fitted)
    above = F.col("direction") >= cutoff
    raw = F.col("_distance_rank") + 1.4 * F.col("_bench_rank") - 0.4 * above.cast("double")
    third = reference_ranks(second.withColumn("_raw", raw), key, ["_raw"], fitted)
    confidence = F.col("_raw_rank")
    return third.select(key, "direction", confidence.alias("confidence"), F.when(above, 0.51 + 0.49 * confidence).otherwise(0.49 - 0.49 * confidence).alias("probability"))


def confidence_gate(
    rows: DataFrame, key: str, raw: str, opportunity: str, cutoff: float, sign: float, margin_weight: float, gate: float, fitted: str = "fitted"
) -> DataFrame:
    """(key, margin, gated, probability): a raw probability's margin and an opportunity, both as middle ranks, decide who passes the gate.

    Rows whose blended rank is at least ``gate`` have a confidence of 0.86 or more, others of at most 0.84. An opportunity that is
    missing or not finite counts as the fitted median (0 without one).
    """
    seen = rows.where(F.col(fitted)).select(_finite(opportunity).alias("_o"))
    median = exact_quantiles(seen, "_o", [0.5]).agg(F.max("quantile").alias("_median"))
    filled = sign * F.coalesce(_finite(opportunity), F.col("_median"), F.lit(0.0))
    wide = rows.join(F.broadcast(median)).select(key, fitted, raw, F.abs(F.col(raw) - cutoff).alias("_margin"), filled.alias("_opportunity"))
    first = reference_ranks(wide, key, ["_margin", "_opportunity"], fitted, middle=True)
    blended = first.withColumn("_blend", margin_weight * F.col("_margin_rank") + (1 - margin_weight) * F.col("_opportunity_rank"))
    done = reference_ranks(blended, key, ["_blend"], fitted, middle=True).withColumn("gated", F.col("_blend_rank") >= gate)
    confidence = F.when(F.col("gated"), 0.86 + 0.14 * F.col("_margin_rank")).otherwise(0.84 * F.col("_margin_rank"))
    p = F.when(F.col(raw) >= cutoff, 0.5 + 0.5 * confidence).otherwise(0.5 - 0.5 * confidence)
    return done.select(key, F.col("_margin_rank").alias("margin"), "gated", F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)).alias("probability"))
