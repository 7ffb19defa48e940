"""One-shot reading of sealed outcomes, and checkpoints that never change.

All records are files in a folder that driver and executors share, created once and never overwritten. The order is the
safeguard: membership, then frozen predictions of a block, then the intent to read its outcomes, then the reading, then its result. A driver
that dies between intent and result leaves a seal that cannot be opened again without a decision of its own.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordered import ordered
from tidemark.sources.sinks import table_digest, write_once


class SealError(RuntimeError):
    """What was asked for breaks the order or the integrity of a seal."""


class RecordFolder:
    """Small JSON records by name, each created once; any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.json")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._spark, self._folder = spark, folder

    def create(self, name: str, **record) -> None:
        """Writes a record durably; SealError if one of that name is there."""
        if self._fs.exists(self._path(name)):
            raise SealError(f"record {name} exists")
        out = self._fs.create(self._path(name), False)  # fails where another writer was first
        out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        out.hsync()
        out.close()

    def read(self, name: str) -> dict | None:
        if not self._fs.exists(self._path(name)):
            return None
        text = self._spark.read.text(f"{self._folder}/{name}.json", wholetext=True).first()
        # A writer that died while writing leaves a record that says that much.
        try:
            return json.loads(text[0]) if text else {"broken": True}
        except ValueError:
            return {"broken": True}


def _digest(df: DataFrame) -> str:
    n, digest = table_digest(df)
    return f"{n}:{digest}"


class SealGuard:
    """Opens the outcomes of committed members, block after block, each once."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder, self._records = spark, folder, RecordFolder(spark, f"{folder}/records")

    def commit_members(self, members: DataFrame, block_rows: int) -> None:
        """``members`` (id, event_time): numbered in time order (ties by id) and cut into blocks of ``block_rows``, which must come out even.

        Committing the same members again does nothing; others raise, as do repeated or null ids and null times.
        """
        own = members.select(F.col("id").cast("string").alias("id"), F.col("event_time"))
        n, distinct, timed = own.agg(F.count("*"), F.count_distinct("id"), F.count("event_time")).first()
        if not n or n != distinct or n != timed or n % block_rows:
            raise SealError("members need ids that differ, times, and whole blocks")
        placed = ordered(own, ["event_time", "id"]).select("id", "event_time", F.col("rn").alias("place"), F.expr(f"CAST((rn - 1) div {block_rows} + 1 AS INT)").alias("block"))
        write_once(placed, f"{self._folder}/members")
        if self._records.read("members") is None:
            self._records.create("members", digest=_digest(placed), blocks=n // block_rows)

    def members(self) -> DataFrame:
        """The committed members; SealError where they are not what was committed."""
        record = self._records.read("members")
        if record is None:
            raise SealError("no members are committed")
        rows = self._spark.read.parquet(f"{self._folder}/members")
        if _digest(rows) != record.get("digest"):
            raise SealError("members have changed")
        return rows

    def freeze_predictions(self, block: int, predictions: DataFrame) -> None:
        """Writes the predictions (id, ...) of exactly the members of a block, before its outcomes may be opened."""
        own = self.members().where(F.col("block") == block).select("id")
        given = predictions.withColumn("id", F.col("id").cast("string"))
        strange = given.select("id").exceptAll(own).limit(1).count() + own.exceptAll(given.select("id")).limit(1).count()
        if strange or not own.limit(1).count():
            raise SealError(f"predictions are not those of block {block}")
        write_once(given, f"{self._folder}/predictions/block={block}")
        if self._records.read(f"frozen-{block}") is None:
            self._records.create(f"frozen-{block}", predictions=_digest(given))

    def open_block(self, block: int, outcomes) -> DataFrame:
        """The outcomes of a block's members: ``outcomes()`` gives the sealed table (id, ...), which is first asked for after the intent is durable.

        Blocks go in order. An intent without a result, even one's own of an earlier run, is never replayed. Members without an outcome or with
        several raise after the intent: that opening counts.
        """
        members, record = self.members(), self._records.read("members")
        if not 1 <= block <= record["blocks"]:
            raise SealError(f"there is no block {block}")
        if block > 1 and self._records.read(f"result-{block - 1}") is None:
            raise SealError(f"block {block - 1} is not complete")
        if self._records.read(f"intent-{block}") is not None:
            raise SealError(f"block {block} was opened before: no replay")
        frozen = self._records.read(f"frozen-{block}")
        if frozen is None or _digest(self._spark.read.parquet(f"{self._folder}/predictions/block={block}")) != frozen.get("predictions"):
            raise SealError(f"predictions of block {block} are not frozen, or have changed")
        self._records.create(f"intent-{block}", members=record["digest"], predictions=frozen["predictions"])
        own = members.where(F.col("block") == block).select("id")
        opened = outcomes().withColumn("id", F.col("id").cast("string")).join(own, "id", "left_semi")
        write_once(opened, f"{self._folder}/outcomes/block={block}")
        opened = self._spark.read.parquet(f"{self._folder}/outcomes/block={block}")
        n, distinct = opened.agg(F.count("*"), F.count_distinct("id")).first()
        if n != distinct or n != own.count():
            raise SealError(f"block {block} has members without one outcome")
        self._records.create(f"result-{block}", rows=n, outcomes=_digest(opened))
        return opened

    def state(self) -> dict[str, int]:
        """How many blocks there are, were attempted and are complete."""
        blocks = (self._records.read("members") or {}).get("blocks", 0)
        count = lambda kind: sum(self._records.read(f"{kind}-{b}") is not None for b in range(1, blocks + 1))
        return {"blocks": blocks, "attempted": count("intent"), "completed": count("result")}


def write_checkpoints(rows: DataFrame, folder: str, order: list[str], thresholds: list[int], block_rows: int, policy: str = "") -> list[dict]:
    """For each threshold that ``rows`` have reached: the block of rows up to it, written once, and the digest of all rows up to it.

    Rows are numbered by ``order`` (which must tell all apart). A checkpoint that is there must say the same about block, prefix and
    policy, or SealError is raised: earlier rows have changed. Returns one record per threshold reached, with its action.
    """
    spark = rows.sparkSession
    records = RecordFolder(spark, f"{folder}/records")
    placed = ordered(rows, order, number="observation", total="_rows").drop("_rows")
    reached, done = placed.count(), []
    for at in sorted(thresholds):
        if reached < at:
            break
        prefix = placed.where(F.col("observation") <= at)
        block = prefix.where(F.col("observation") > at - block_rows)
        record = {"rows": block_rows, "cumulative_rows": at, "first": at - block_rows + 1, "policy": policy, "prefix": _digest(prefix), "block": _digest(block)}
        there = records.read(f"checkpoint-{at:06d}")
        try:
            write_once(block, f"{folder}/block={at:06d}")
        except ValueError as error:
            raise SealError(f"checkpoint {at} has changed") from error
        if there is None:
            records.create(f"checkpoint-{at:06d}", **record)
        elif there != record:
            raise SealError(f"checkpoint {at} has changed")
        done.append(record | {"action": "CREATED" if there is None else "VERIFIED"})
    return done
