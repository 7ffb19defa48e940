"""Folds that keep groups whole and classes balanced, and models that score each row without having seen it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.feature_pipeline import balanced
from tidemark.operators.ordered import exact_quantiles, ordered
from tidemark.storage import materialise


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """(group, fold): every group whole in one of folds 1 .. k, classes 0 and 1 spread evenly.

    Groups of the same class counts are interchangeable: in an order by hash, each fold takes as many of them. What a number not divisible
    by k leaves over, at most k - 1 groups for each pair of counts, is dealt greedily, the most uneven first, each to the fold that
    keeps the folds' class shares closest; that pass reads rows of three numbers in order and holds 2 k sums. Null groups are one group;
    rows with another label count for neither class.
    """
    y = F.col(label)
    counts = df.groupBy(F.col(group).alias("grp")).agg(F.count(F.when(y == 0, 1)).alias("n0"), F.count(F.when(y == 1, 1)).alias("n1"))
    mixed = F.xxhash64(F.coalesce(F.col("grp").cast("string"), F.lit("\x00none")), F.lit(seed))
    placed = ordered(counts.withColumn("h", mixed), [F.desc(F.abs(F.col("n0") - F.col("n1"))), F.desc("n0"), "h", "grp"])
    kinds = placed.groupBy("n0", "n1").agg(F.min("rn").alias("first"), F.count("*").alias("m"))
    within = placed.join(kinds, ["n0", "n1"]).withColumn("at", F.col("rn") - F.col("first"))
    whole = F.floor(F.col("m") / k) * k
    even = within.where(F.col("at") < whole).select("grp", (F.col("at") % k + 1).cast("int").alias("fold"))
    rest = within.where(F.col("at") >= whole).select("grp", "n0", "n1", "rn")
    totals = counts.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if held is None:
                held, whole_ = np.zeros((k, 2)), np.maximum(frame[["t0", "t1"]].iloc[0].to_numpy(float), 1)
            folds = []
            for own in frame[["n0", "n1"]].to_numpy(float):
                # What the spread of each class would be if a fold took the group; then the fold with fewer rows.
                tried = [((np.where(np.arange(k)[:, None] == f, held + own, held) / whole_).std(axis=0).mean().round(12), held[f].sum(), f) for f in range(k)]
                best = min(tried)[2]
                held[best] += own
                folds.append(best + 1)
            yield frame[["grp"]].assign(fold=np.array(folds, np.int32))

    # One pass in order over the few rows that are left.
    dealt = rest.join(F.broadcast(totals)).repartition(1).sortWithinPartitions("rn").mapInPandas(deal, f"grp {counts.schema['grp'].dataType.simpleString()}, fold int")
    return even.union(dealt).withColumnRenamed("grp", group)


def shift_probability(p: Column, cutoff: float) -> Column:
    """The probability whose odds are those of ``p`` against the cutoff's: one half where p is the cutoff."""
    x = F.when(p < 1e-6, 1e-6).when(p > 1 - 1e-6, 1 - 1e-6).otherwise(p)
    return 1 / (1 + F.exp(-(F.log(x / (1 - x)) - float(np.log(cutoff / (1 - cutoff))))))


@dataclass
class TreeModel:
    """Boosted trees over imputed numbers and one-hot categories, with the medians of their training rows."""

    numbers: list[str]
    medians: dict[str, float]
    stages: PipelineModel

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        scored = self.stages.transform(_filled(df, self.numbers, self.medians))
        return scored.select(*df.columns, vector_to_array("_probability")[1].alias(name))


def _filled(df: DataFrame, numbers: list[str], medians: dict[str, float]) -> DataFrame:
    cols = [c for n in numbers for c in (F.coalesce(F.col(n).cast("double"), F.lit(medians.get(n, 0.0))).alias(f"_x_{n}"), F.col(n).isNull().cast("double").alias(f"_missing_{n}"))]
    return df.select("*", *cols)


def fit_trees(train: DataFrame, label: str, numbers: list[str], categories: list[str], trees: int = 20, depth: int = 3, step: float = 0.1, seed: int = 17) -> TreeModel:
    """Both classes weigh the same. Numbers are imputed by the exact medians of ``train``, with an indicator; unknown categories are ignored."""
    tall = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in numbers])).alias("s")).select("s.*")
    medians = {r["column"]: r["quantile"] for r in exact_quantiles(tall, "x", [0.5], ["column"]).collect()}  # one row a column
    rows = materialise(_filled(balanced(train.withColumn("_y", F.col(label).cast("double")), "_y"), numbers, medians), "tree_rows")
    indexers = [StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categories]
    encoders = [OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_o_{c}", handleInvalid="keep") for c in categories]
    assemble = VectorAssembler(inputCols=[c for n in numbers for c in (f"_x_{n}", f"_missing_{n}")] + [f"_o_{c}" for c in categories], outputCol="_features")
    boost = GBTClassifier(featuresCol="_features", labelCol="_y", weightCol="_weight", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed)
    boost = boost.setRawPredictionCol("_margin").setPredictionCol("_class").setProbabilityCol("_probability")
    return TreeModel(numbers, medians, Pipeline(stages=[*indexers, *encoders, assemble, boost]).fit(rows))


@dataclass
class MarketPolicy:
    """One model per market, its cutoff, and whether its probability is turned round."""

    models: dict[str, TreeModel] = field(default_factory=dict)
    cutoffs: dict[str, float] = field(default_factory=dict)
    turned: set[str] = field(default_factory=set)

    def predict(self, df: DataFrame, market: str = "market") -> DataFrame:
        """``df`` with ``prob``; a row of a market without a model raises."""
        strange = df.where(F.col(market).isNull() | ~F.col(market).isin(*self.models)).limit(1).collect()
        if strange:
            raise ValueError(f"no model for market {strange[0][market]}")
        out = None
        for name, model in self.models.items():
            scored = model.score(df.where(F.col(market) == name), "_raw")
            raw = 1 - F.col("_raw") if name in self.turned else F.col("_raw")
            part = scored.select(*df.columns, shift_probability(raw, self.cutoffs.get(name, 0.5)).alias("prob"))
            out = part if out is None else out.unionByName(part)
        return out


def cross_fit(df: DataFrame, market: str, group: str, label: str, numbers: list[str], categories: list[str], k: int = 5, cutoffs: dict[str, float] | None = None, turned: set[str] = frozenset(), **trees) -> DataFrame:
    """``df`` with ``fold`` and ``prob``: each row scored by a model of its market that was fitted on the other folds.

    Folds keep groups whole within a market and spread classes evenly. Markets are few; a market whose training rows of some
    fold show one class raises. Rows without market or label are left out.
    """
    known = df.where(F.col(market).isNotNull() & F.col(label).isin(0, 1))
    out = None
    for name in sorted(r[0] for r in known.select(market).distinct().collect()):
        own = known.where(F.col(market) == name)
        folds = stratified_group_folds(own, group, label, k).withColumnRenamed(group, "_g")
        own = materialise(own.join(folds, own[group].eqNullSafe(folds["_g"])).drop("_g"), "folds")
        for fold in range(1, k + 1):
            train, held = own.where(F.col("fold") != fold), own.where(F.col("fold") == fold)
            if train.select(label).distinct().count() < 2:
                raise ValueError(f"market {name}: the rows outside fold {fold} show one class")
            policy = MarketPolicy({name: fit_trees(train, label, numbers, categories, **trees)}, cutoffs or {}, set(turned))
            part = policy.predict(held, market)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else known.withColumn("fold", F.lit(1)).withColumn("prob", F.lit(0.5))
