"""Helpers shared by the training-data operators.

Nothing here keeps state on a single machine: intermediate results are Parquet tables in the folder
the cluster shares (``spark.checkpoint.dir``), so a lost executor costs a re-read and no more.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.storage import materialise, shared_dir  # noqa: F401

#: What a table may hold at most to be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its plain name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def holdout_bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id falls in bucket 0."""
    return F.coalesce(F.crc32(col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_integral(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, IntegralType)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, data, row): a unique number of every row, ascending with the id, the text's bytes, all other columns.

    The number is the id itself where ids are whole numbers, unique and not null. Otherwise rows are ranked by id
    (null first), then by a hash of the text, over range partitions.
    """
    others = [c for c in docs.columns if c != text_col]
    own = docs.select(F.struct(*map(col, others)).alias("row"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("data"))
    if is_integral(docs, id_col):
        n, distinct, missing = docs.agg(F.count("*"), F.count_distinct(col(id_col)), F.count(F.when(col(id_col).isNull(), 1))).first()
        if not missing and n == distinct:
            return own.select(own["row"][id_col].cast("bigint").alias("doc"), "data", "row")
    order = [own["row"][id_col].asc_nulls_first(), F.xxhash64("data")]
    ranged = own.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    # Within a partition the numbers ascend, and partitions ascend in the order.
    return materialise(ranged.select(F.monotonically_increasing_id().alias("doc"), "data", "row"), "numbered")


def checked_broadcast(df: DataFrame) -> DataFrame:
    """``df``, broadcast where its rows and bytes are few enough; a larger table is left to be shuffled."""
    size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(df) if size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES else df


def frugal(run):
    """``run`` over Arrow batches; what a worker has freed goes back to the machine when a task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def release_memory() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
