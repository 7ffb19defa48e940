"""Seals that open once and checkpoints that never change, with a driver that dies on the way."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources.seal import SealError, SealGuard, write_checkpoints


@pytest.fixture
def guard(spark, tmp_path):
    made = SealGuard(spark, f"file://{tmp_path}/seal")
    made.commit_members(spark.range(12).select("id", (100 - F.col("id")).alias("event_time")), 4)
    return made


def ids(spark, block):
    """Times descend with the id: block 1 has ids 8 to 11."""
    return spark.range(12 - 4 * block, 16 - 4 * block)


def outcomes(spark):
    return spark.range(20).select("id", (F.col("id") % 2).alias("y"))


def test_blocks_open_in_order_and_once(spark, guard):
    with pytest.raises(SealError, match="not frozen"):
        guard.open_block(1, lambda: outcomes(spark))
    guard.freeze_predictions(1, ids(spark, 1).withColumn("p", F.lit(0.5)))
    guard.freeze_predictions(2, ids(spark, 2).withColumn("p", F.lit(0.5)))
    with pytest.raises(SealError, match="block 1 is not complete"):
        guard.open_block(2, lambda: outcomes(spark))
    opened = guard.open_block(1, lambda: outcomes(spark))
    assert sorted((r["id"], r["y"]) for r in opened.collect()) == [("10", 0), ("11", 1), ("8", 0), ("9", 1)]
    with pytest.raises(SealError, match="no replay"):
        guard.open_block(1, lambda: outcomes(spark))
    assert guard.state() == {"blocks": 3, "attempted": 1, "completed": 1}
    assert guard.open_block(2, lambda: outcomes(spark)).count() == 4


def test_predictions_must_be_those_of_the_block_and_stay(spark, guard):
    with pytest.raises(SealError, match="not those of block 1"):
        guard.freeze_predictions(1, ids(spark, 2).withColumn("p", F.lit(0.5)))
    with pytest.raises(SealError, match="not those of block 1"):
        guard.freeze_predictions(1, ids(spark, 1).union(ids(spark, 1)).withColumn("p", F.lit(0.5)))
    guard.freeze_predictions(1, ids(spark, 1).withColumn("p", F.lit(0.5)))
    guard.freeze_predictions(1, ids(spark, 1).withColumn("p", F.lit(0.5)))  # the same again is nothing new
    with pytest.raises(ValueError, match="other rows"):
        guard.freeze_predictions(1, ids(spark, 1).withColumn("p", F.lit(0.6)))


def test_changed_members_close_the_seal(spark, guard, tmp_path):
    guard.freeze_predictions(1, ids(spark, 1).withColumn("p", F.lit(0.5)))
    spark.read.parquet(f"{tmp_path}/seal/members").limit(1).write.mode("append").parquet(f"{tmp_path}/seal/members")
    with pytest.raises(SealError, match="members have changed"):
        guard.open_block(1, lambda: outcomes(spark))
    assert guard.state()["attempted"] == 0


@pytest.mark.parametrize("dies", ["while reading", "before the result"])
def test_death_after_the_intent_is_never_replayed(spark, guard, tmp_path, monkeypatch, dies):
    guard.freeze_predictions(1, ids(spark, 1).withColumn("p", F.lit(0.5)))
    asked = []

    def read():
        asked.append(1)
        if dies == "while reading":
            raise KeyboardInterrupt
        return outcomes(spark)

    if dies == "before the result":
        create = guard._records.create

        def fail(name, **record):
            if name.startswith("result"):
                raise KeyboardInterrupt
            create(name, **record)

        monkeypatch.setattr(guard._records, "create", fail)
    with pytest.raises(KeyboardInterrupt):
        guard.open_block(1, read)
    again = SealGuard(spark, f"file://{tmp_path}/seal")
    with pytest.raises(SealError, match="no replay"):
        again.open_block(1, read)
    assert asked == [1] and again.state() == {"blocks": 3, "attempted": 1, "completed": 0}


def test_intent_is_durable_before_outcomes_are_asked_for(spark, guard):
    guard.freeze_predictions(1, ids(spark, 1).withColumn("p", F.lit(0.5)))
    seen = []
    guard.open_block(1, lambda: seen.append(guard.state()["attempted"]) or outcomes(spark))
    assert seen == [1]


def test_missing_outcomes_count_as_an_opening(spark, guard):
    guard.freeze_predictions(1, ids(spark, 1).withColumn("p", F.lit(0.5)))
    with pytest.raises(SealError, match="without one outcome"):
        guard.open_block(1, lambda: outcomes(spark).where("id <> 9"))
    with pytest.raises(SealError, match="no replay"):
        guard.open_block(1, lambda: outcomes(spark))


@pytest.mark.parametrize("rows", [[], [("a", 1), ("a", 2)], [("a", None), ("b", 1)], [("a", 1)]])
def test_bad_members(spark, tmp_path, rows):
    with pytest.raises(SealError, match="members need"):
        SealGuard(spark, f"file://{tmp_path}/bad").commit_members(spark.createDataFrame(rows, "id string, event_time int"), 2)


def test_checkpoints(spark, tmp_path):
    where = f"file://{tmp_path}/cp"
    rows = spark.range(50).select((F.col("id") * 7 % 50).alias("id"), F.lit("x").alias("v"))
    first = write_checkpoints(rows.where("id < 45"), where, ["id"], [20, 40, 60], 20, "p1")
    assert [(r["cumulative_rows"], r["first"], r["action"]) for r in first] == [(20, 1, "CREATED"), (40, 21, "CREATED")]
    later = write_checkpoints(rows.repartition(3), where, ["id"], [20, 40, 60], 20, "p1")
    assert [r["action"] for r in later] == ["VERIFIED", "VERIFIED"] and {k: v for k, v in later[1].items() if k != "action"} == {k: v for k, v in first[1].items() if k != "action"}
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/cp/block=000040").collect()) == list(range(20, 40))
    with pytest.raises(SealError, match="checkpoint 40 has changed"):
        write_checkpoints(rows.withColumn("v", F.when(F.col("id") == 30, "y").otherwise(F.col("v"))), where, ["id"], [20, 40], 20, "p1")
    with pytest.raises(SealError, match="checkpoint 20 has changed"):
        write_checkpoints(rows, where, ["id"], [20], 20, "p2")
