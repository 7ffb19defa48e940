"""Sinks: write-once tables, keyed upserts, append-only ledgers and content manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.storage import materialise


def row_hash(df: DataFrame, columns: list[str] | None = None):
    """SHA-256 of a row's canonical JSON: columns by name, nulls kept."""
    names = sorted(columns or df.columns)
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}), 256)


def table_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) that do not depend on row order: a sum of the rows' hashes, merged on the executors."""
    h = row_hash(df)
    halves = [F.sum(F.conv(F.substring(h, at, 14), 16, 10).cast("decimal(38,0)")) for at in (1, 15, 29, 43)]
    n, *sums = df.agg(F.count("*"), *halves).first()
    return n, "-".join(f"{int(s or 0) % (1 << 64):016x}" for s in sums)


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where there is no such folder."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_once(df: DataFrame, path: str) -> bool:
    """Write a table that must never change. True if written; False if an equal one is there; ValueError if another is."""
    spark = df.sparkSession
    there = _there(spark, path)
    if there is None:
        df.write.mode("errorifexists").parquet(path)
        return True
    if sorted(there.columns) != sorted(df.columns) or table_digest(there) != table_digest(df):
        raise ValueError(f"{path} holds other rows")
    return False


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The version of an upserted table that was committed last, or None."""
    commits = _there(spark, f"{path}/commits")
    newest = None if commits is None else commits.agg(F.max("version")).first()[0]
    return None if newest is None else spark.read.parquet(f"{path}/version={newest}")


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: str) -> None:
    """Old and new rows, the latest of each key by ``order`` kept; new rows win ties.

    Each call writes a version of its own beside the others and then a row that commits it: whoever reads, or a driver
    lost on the way, sees the version before or the whole new one. There is one writer at a time.
    """
    rows, old = new.withColumn("_new", F.lit(1)), latest(spark, path)
    if old is not None:
        rows = old.withColumn("_new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    best = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    kept = rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "_new")
    commits = _there(spark, f"{path}/commits")
    version = 1 + (0 if commits is None else commits.agg(F.max("version")).first()[0])
    kept.write.mode("overwrite").parquet(f"{path}/version={version}")
    spark.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{path}/commits")


#: Parts of a ledger by a hash of the key; an append reads only the parts that its keys fall in.
LEDGER_PARTS = 64


def _part(key: str):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(LEDGER_PARTS)).cast("int").alias("part")


def append_ledger(spark: SparkSession, path: str, new: DataFrame, key: str) -> None:
    """Append JSON lines whose key the ledger lacks; running it again adds nothing, as ``foreachBatch`` needs.

    Two writers at once could both add a key; ``read_ledger`` keeps one row of each.
    """
    fresh = new.dropDuplicates([key]).withColumn("part", _part(key))
    try:
        known = spark.read.schema(new.schema).json(path)
    except AnalysisException:
        known = None
    if known is not None:
        touched = [r[0] for r in fresh.select("part").distinct().collect()]  # at most LEDGER_PARTS
        fresh = materialise(fresh.join(known.where(F.col("part").isin(touched)).select(key), key, "left_anti"), "ledger")
    fresh.write.mode("append").partitionBy("part").json(path)


def read_ledger(spark: SparkSession, path: str, schema, key: str) -> DataFrame:
    return spark.read.schema(schema).json(path).drop("part").dropDuplicates([key])


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, sha256) of every file under a folder, by its path below the folder, hashed where it is read.

    A file is one row while it is hashed, so files are limited to 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/").split("/")[-1]
    return files.select(F.substring_index("path", f"/{root}/", -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))
