"""Calibration of scores by fold: a logistic fit on earlier folds only, as aggregates per fold and group.

A target (fold, group) learns from all rows of its group in earlier folds. The two coefficients of every target move together, one Newton step a
pass: rows are summed to a gradient and a curvature per target, so that a hot group is summed up before it is shuffled, and coefficients stay
in a table of one row a target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import materialise

#: Probabilities are kept this far from 0 and 1 before their logit is taken.
EDGE = 1e-5
LEAST_ROWS = 150
#: Of the loss against half the squared coefficients (both of them, the constant too).
LOSS_WEIGHT = 0.25
MOST_STEPS = 50


def log_odds(p: Column) -> Column:
    x = F.when(p < EDGE, EDGE).when(p > 1 - EDGE, 1 - EDGE).otherwise(p)  # a null stays null
    return F.log(x / (1 - x))


def training_rows(rows: DataFrame, prob: str, label: str, fold: str, group: str, weight: str | None = None) -> DataFrame:
    """(target, grp, x, y, w) of every earlier row for each later fold; classes weigh the same within a target."""
    folds = rows.select(F.col(fold).alias("target")).distinct()
    own = rows.where(F.col(label).isNotNull() & F.col(prob).isNotNull())
    own = own.select(F.col(fold).alias("fold"), F.col(group).alias("grp"), log_odds(F.col(prob).cast("double")).alias("x"), F.col(label).cast("int").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    # A fold number is one of a few: every row goes to the later ones of them.
    every = folds.agg(F.array_sort(F.collect_set("target")).alias("targets"))
    spread = own.join(F.broadcast(every)).select("grp", "x", "y", "w", F.explode(F.filter("targets", lambda t: t > F.col("fold"))).alias("target"))
    sizes = spread.groupBy("target", "grp").agg(F.count("*").alias("n"), F.sum("y").alias("n1")).where(f"n >= {LEAST_ROWS} AND n1 > 0 AND n1 < n")
    return spread.join(sizes, ["target", "grp"]).select("target", "grp", "x", "y", (F.col("w") * F.col("n") / (2 * F.when(F.col("y") == 1, F.col("n1")).otherwise(F.col("n") - F.col("n1")))).alias("w"))


def fit_logistic(train: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(target, grp, slope, constant) that minimise half the squared coefficients plus ``LOSS_WEIGHT`` times the weighted loss."""
    coefficients = materialise(train.select("target", "grp").distinct().select("*", F.lit(0.0).alias("slope"), F.lit(0.0).alias("constant")), "coefficients")
    for _ in range(MOST_STEPS):
        p = 1 / (1 + F.exp(-(F.col("slope") * F.col("x") + F.col("constant"))))
        with_p = train.join(coefficients, ["target", "grp"]).withColumn("p", p)
        miss, bend = F.col("w") * (F.col("p") - F.col("y")), F.col("w") * F.col("p") * (1 - F.col("p"))
        sums = with_p.groupBy("target", "grp").agg(
            F.first("slope").alias("slope"), F.first("constant").alias("constant"),
            F.sum(miss * F.col("x")).alias("g1"), F.sum(miss).alias("g0"),
            F.sum(bend * F.col("x") * F.col("x")).alias("h11"), F.sum(bend * F.col("x")).alias("h10"), F.sum(bend).alias("h00"),
        )
        c = F.lit(LOSS_WEIGHT)
        g1, g0 = F.col("slope") + c * F.col("g1"), F.col("constant") + c * F.col("g0")
        h11, h10, h00 = 1 + c * F.col("h11"), c * F.col("h10"), 1 + c * F.col("h00")
        det = h11 * h00 - h10 * h10
        moved = sums.select("target", "grp", "slope", "constant", ((h00 * g1 - h10 * g0) / det).alias("d1"), ((h11 * g0 - h10 * g1) / det).alias("d0"))
        moved = materialise(moved.select("target", "grp", (F.col("slope") - F.col("d1")).alias("slope"), (F.col("constant") - F.col("d0")).alias("constant"), F.greatest(F.abs("d1"), F.abs("d0")).alias("step")), "coefficients")
        coefficients = moved.drop("step")
        far = moved.agg(F.max("step")).first()[0]
        if far is None or far < tolerance:
            return coefficients
    raise RuntimeError(f"the logistic fit has not settled in {MOST_STEPS} steps: last step {far}")


def prequential_calibration(rows: DataFrame, prob: str, label: str, fold: str, group: str | None = None, weight: str | None = None) -> DataFrame:
    """``rows`` with ``calibrated``, ``identity`` and ``history_n``: the probability by a fit on earlier folds (of the same group).

    Fewer than 150 earlier rows or rows of one class leave the probability as it is. Rows without label or probability teach
    nothing; a null probability stays null. A null group is a group of its own. Folds are few whole numbers; labels 0 or 1.
    """
    keyed = rows.withColumn("_fold", F.col(fold)).withColumn("_grp", F.coalesce(F.col(group).cast("string"), F.lit("\x00none")) if group else F.lit("ALL"))
    train = materialise(training_rows(keyed, prob, label, "_fold", "_grp", weight), "calibration")
    fitted = fit_logistic(train).withColumnRenamed("target", "_fold").withColumnRenamed("grp", "_grp")
    per = keyed.where(F.col(label).isNotNull() & F.col(prob).isNotNull()).groupBy("_fold", "_grp").agg(F.count("*").alias("_n"))
    targets = keyed.select("_fold", "_grp").distinct()
    # Few rows, one for each fold and group: those of earlier folds are counted by a join on the group.
    seen = targets.join(per.withColumnRenamed("_fold", "_earlier"), "_grp", "left").groupBy("_fold", "_grp").agg(F.coalesce(F.sum(F.when(F.col("_earlier") < F.col("_fold"), F.col("_n"))), F.lit(0)).alias("history_n"))
    out = keyed.join(seen.join(fitted, ["_fold", "_grp"], "left"), ["_fold", "_grp"], "left")
    x = log_odds(F.col(prob).cast("double"))
    fit = 1 / (1 + F.exp(-(F.col("slope") * x + F.col("constant"))))
    return out.select(*rows.columns, F.when(F.col("slope").isNull(), F.col(prob).cast("double")).otherwise(fit).alias("calibrated"), F.col("slope").isNull().alias("identity"), "history_n")
