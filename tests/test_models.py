"""Exact quantiles, the feature pipeline, folds by group and cross-fitted models."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.operators import crossfit, feature_pipeline, ordered
from tidemark.plans import models


def test_exact_quantiles(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.gauss(0, 1), float(rng.randrange(4))])) for g in ("a", "b", "b", None) for _ in range(157)] + [("one", 5.0), ("none", None), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = [0.0, 0.05, 0.5, 0.913, 1.0]
    got = {(r["g"], r["share"]): (r["quantile"], r["n"]) for r in ordered.exact_quantiles(df, "v", shares, ["g"]).collect()}
    assert {g for g, _ in got} == {"a", "b", None, "one", "same"}
    for (g, share), (q, n) in got.items():
        own = [v for k, v in rows if k == g and v is not None]
        assert n == len(own) and q == pytest.approx(np.quantile(own, share), abs=1e-12)
    every = [v for _, v in rows if v is not None]
    assert {r["share"]: r["quantile"] for r in ordered.exact_quantiles(df, "v", shares).collect()} == pytest.approx({s: np.quantile(every, s) for s in shares})
    assert ordered.exact_quantiles(df.limit(0), "v", shares, ["g"]).count() == 0


def test_features_by_hand(spark):
    rows = [(1, "The cat sat", 1.0, "x"), (2, "the cat; THE dog", 3.0, "y"), (3, "Café a b", None, "x"), (4, None, 5.0, None)]
    train = spark.createDataFrame(rows, "id int, t string, n double, c string")
    fitted = feature_pipeline.fit_features(train, "id", "t", ["n"], ["c"])
    idf = {r["term"]: r["idf"] for r in fitted.vocabulary.collect()}
    assert idf == pytest.approx({w: math.log(5 / 3) + 1 for w in ("the", "cat", "the cat")})  # terms of one document alone are left out
    scale = fitted.scales.first()
    assert (scale["median"], scale["missing"]) == (3.0, 0.25) and scale["deviation"] == pytest.approx(np.std([1, 3, 3, 5]))
    new = spark.createDataFrame([(7, "the cafe THE cat the cat", None, "z"), (8, "nothing", 0.0, "y")], "id int, t string, n double, c string")
    got = {(r["id"], r["feature"]): r["value"] for r in fitted.long(new).collect()}
    own = {"text:the": (1 + math.log(3)), "text:cat": 1 + math.log(2), "text:the cat": 1 + math.log(2)}
    norm = math.sqrt(sum(v * v for v in own.values()))
    want = {(7, k): v / norm for k, v in own.items()} | {(7, "num:n"): 3 / scale["deviation"], (7, "missing:n"): 1 / math.sqrt(0.25 * 0.75), (8, "cat:c=y"): 1.0}
    assert got == pytest.approx(want)
    index = fitted.index()
    assert index.count() == 3 + 1 + 1 + 2
    vectors = {r["id"]: r["features"] for r in fitted.vectors(new.union(spark.createDataFrame([(9, "", 0.0, None)], new.schema)), index).collect()}
    at = {r["feature"]: r["idx"] for r in index.collect()}
    assert vectors[7][at["missing:n"]] == pytest.approx(1 / math.sqrt(0.1875)) and vectors[9].numNonzeros() == 0 and vectors[8].size == 7


def test_linear_scores_tell_unseen_rows(spark):
    rng = random.Random(5)
    say = lambda y: " ".join(rng.choice(["good fine best", "bad poor worst"][y ^ (rng.random() < 0.1)].split() + ["and", "the", "of"]) for _ in range(12))
    rows = [(i, say(i % 3 == 0), rng.random() if i % 7 else None, "c", int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, t string, n double, c string, y int")
    scored = {r["id"]: r["score"] for r in feature_pipeline.linear_scores(df.where("id < 200"), df, "y", "id", "t", ["n"], ["c"]).collect()}
    assert len(scored) == 300 and np.mean([(scored[i] >= 0.5) == y for i, *_, y in rows[200:]]) > 0.9



def test_folds_keep_groups_whole_and_classes_even(spark):
    rng = random.Random(6)
    rows = []
    for g in range(400):
        size, share = rng.choice([1, 1, 2, 3, 8, 40]), rng.random()
        rows += [(f"g{g}" if g else None, int(rng.random() < share)) for _ in range(size)]
    df = spark.createDataFrame(rows, "g string, y int").repartition(5)
    got = {r["g"]: r["fold"] for r in crossfit.stratified_group_folds(df, "g", "y", 5).collect()}
    assert set(got) == {g for g, _ in rows} and set(got.values()) == set(range(1, 6))
    held = defaultdict(Counter)
    for g, y in rows:
        held[got[g]][y] += 1
    for y in (0, 1):
        share = [held[f][y] / sum(r[1] == y for r in rows) for f in range(1, 6)]
        assert max(share) - min(share) < 0.02
    other = {r["g"]: r["fold"] for r in crossfit.stratified_group_folds(df, "g", "y", 5, seed=1).collect()}
    assert other != got and {r["g"]: r["fold"] for r in crossfit.stratified_group_folds(df.repartition(2), "g", "y", 5).collect()} == got


def test_folds_of_many_like_groups_are_exact(spark):
    df = spark.range(1000).selectExpr("id div 2 AS g", "CAST(id % 2 AS INT) AS y")
    folds = crossfit.stratified_group_folds(df, "g", "y", 5)
    assert {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()} == {f: 100 for f in range(1, 6)}
    assert crossfit.stratified_group_folds(df.limit(0), "g", "y", 5).count() == 0


def test_no_row_is_scored_by_a_model_that_saw_it(spark, monkeypatch):
    rows = [(i, "US" if i % 2 else "KR", i // 4, float(i % 9) if i % 10 else None, "abc"[i % 3], int(i % 9 > 4)) for i in range(240)] + [(999, None, 1, 1.0, "a", 1), (998, "US", 7, 1.0, "a", None)]
    df = spark.createDataFrame(rows, "id int, market string, g int, x double, c string, y int")
    seen, fit = [], crossfit.fit_trees

    def spy(train, *args, **kw):
        seen.append({(r["market"], r["g"]) for r in train.select("market", "g").collect()})
        return fit(train, *args, **kw)

    monkeypatch.setattr(crossfit, "fit_trees", spy)
    got = crossfit.cross_fit(df, "market", "g", "y", ["x"], ["c"], k=2, trees=3).collect()
    assert len(got) == 240 and len(seen) == 4
    for k, (market, fold) in enumerate((m, f) for m in ("KR", "US") for f in (1, 2)):
        scored = {(r["market"], r["g"]) for r in got if r["market"] == market and r["fold"] == fold}
        assert scored and not scored & seen[k] and {m for m, _ in seen[k]} == {market}
    assert np.mean([(r["prob"] >= 0.5) == (r["y"] == 1) for r in got if r["x"] is not None]) > 0.95


def test_frozen_policy(spark):
    df = spark.createDataFrame([(i, "US", float(i % 2), "a", i % 2) for i in range(40)], "id int, market string, x double, c string, y int")
    model = crossfit.fit_trees(df, "y", ["x"], ["c"], trees=2)
    plain = {r["id"]: r["prob"] for r in crossfit.MarketPolicy({"US": model}).predict(df).collect()}
    turned = {r["id"]: r["prob"] for r in crossfit.MarketPolicy({"US": model}, {"US": 0.6}, {"US"}).predict(df).collect()}
    for i, p in plain.items():
        odds = (1 - p) / p / (0.6 / 0.4)
        assert turned[i] == pytest.approx(odds / (1 + odds))
    with pytest.raises(ValueError, match="no model for market KR"):
        crossfit.MarketPolicy({"US": model}).predict(df.selectExpr("id", "'KR' AS market", "x", "c", "y"))


def test_held_out_quality(spark):
    """The registered text model tells labelled documents that it has not seen better than chance (an area of 0.68 when written)."""
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [(r["score"], labels[r["doc_id"]]) for r in models.QUERIES["text_model_scores"](spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels]
    pos, neg = [s for s, y in got if y == 1], [s for s, y in got if y == 0]
    assert pos and neg and sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) > 0.6
