"""Evaluation metrics as aggregates: exact, weighted, and free of driver-side loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import ordered


def roc_auc(df: DataFrame, score: str, label: str, weight: str | None = None, keys: list[str] = ()) -> DataFrame:
    """Weighted Mann-Whitney AUC with half credit for ties; null where a class is missing.

    Rows are first counted per distinct score, so that the running sum only sees distinct scores.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    y = F.col(label)
    by_score = df.groupBy(*keys, score).agg(F.sum(F.when(y == 1, w).otherwise(0.0)).alias("_p"), F.sum(F.when(y == 0, w).otherwise(0.0)).alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    parts = by_score.withColumn("_area", F.col("_p") * (below + F.col("_n") / 2))
    total = F.sum("_p") * F.sum("_n")
    return parts.groupBy(*keys).agg(F.when(total > 0, F.sum("_area") / total).alias("auc"))


def expected_calibration_error(df: DataFrame, prob: str, label: str, bins: int = 10) -> DataFrame:
    """One row: the weighted gap between confidence and accuracy over equal-width bins, the last one closed."""
    cut = df.withColumn("_bin", F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)))
    by_bin = cut.groupBy("_bin").agg(F.count("*").alias("n"), F.avg(prob).alias("p"), F.avg(label).alias("y"))
    return by_bin.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def risk_coverage(df: DataFrame, confidence: str, correct: str, order: str, coverages: list[float]) -> DataFrame:
    """Accuracy of the ``ceil(n * c)`` most confident rows for each coverage c; ties by ``order``."""
    ranked = ordered(df, [F.desc(confidence), order])
    wanted = ranked.withColumn("coverage", F.explode(F.array(*[F.lit(float(c)) for c in coverages])))
    return wanted.where(F.col("rn") <= F.ceil(F.col("n_rows") * F.col("coverage"))).groupBy("coverage").agg(F.count("*").alias("n"), F.avg(correct).alias("accuracy"))
