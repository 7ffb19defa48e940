"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import materialise

#: Tasks that the links of one node are dealt to when they meet its least neighbour.
SALTS = 8


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """Links (u, v) with ``m`` of u; the few rows of ``least`` are repeated so that a hub's links are dealt out."""
    dealt = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS).cast("bigint")))
    spread = least.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return dealt.join(spread, ["u", "salt"]).drop("salt")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node each linked node can reach. Rounds grow with the log of the longest chain."""
    now = materialise(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = _with_least(large, floor).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = materialise(hung.union(floor.select("u", F.col("m").alias("v"))).distinct(), "stars")
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state or not new[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new
