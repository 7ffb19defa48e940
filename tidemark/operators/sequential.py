"""Order-sensitive operators whose state is the last accepted row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def greedy_spacing(df: DataFrame, keys: list[str], time: str, order: str, gap: int, strict: bool = True) -> DataFrame:
    """Rows that are kept when each must follow the last *kept* row of its key by more than ``gap`` (or at least, if not strict).

    Rows are sorted within their partition and folded as they pass, the state being the last kept time: a key of any
    size is read in bounded memory, and the fold jumps from one kept row to the next. Null times are left out.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last = None, None
        for frame in frames:
            own = frame[keys]
            starts = np.flatnonzero((own.ne(own.shift()) & ~(own.isna() & own.shift().isna())).any(axis=1).to_numpy())
            starts = starts if len(starts) and starts[0] == 0 else np.concatenate(([0], starts))
            times, kept = frame[time].to_numpy(np.int64), []
            for a, b in zip(starts, np.append(starts[1:], len(frame))):
                key = tuple(None if pd.isna(x) else x for x in own.iloc[a])
                at = a
                if key == last_key:
                    at = a + int(np.searchsorted(times[a:b], last + gap, side="right" if strict else "left"))
                while at < b:
                    kept.append(at)
                    last = int(times[at])
                    at = a + int(np.searchsorted(times[a:b], last + gap, side="right" if strict else "left"))
                last_key = key
            yield frame.iloc[kept]

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*keys, time, order).where(F.col(time).isNotNull()).repartition(parts, *keys).sortWithinPartitions(*keys, time, order)
    return rows.mapInPandas(fold, rows.schema)


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Disjoint islands (island, start, end, n) of overlapping or touching intervals."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("island", F.sum(F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)).over(w))
    return marked.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))
