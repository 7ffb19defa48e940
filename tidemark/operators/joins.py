"""Equi-joins whose cardinality is checked before they are made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_unique(df: DataFrame, keys: list[str], side: str = "table") -> None:
    """Raises where a key without nulls occurs twice; names one such key."""
    known = df.dropna(subset=keys)
    twice = known.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the {side} side is not unique on {keys}: {twice[0].asDict()}")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """A join on equal keys. ``validate``: ``1:1``, ``1:m`` or ``m:1``; a side that must be unique and is not raises."""
    if validate not in ("1:1", "1:m", "m:1"):
        raise ValueError(f"unknown cardinality {validate}")
    if validate.startswith("1"):
        require_unique(left, keys, "left")
    if validate.endswith("1"):
        require_unique(right, keys, "right")
    return left.join(right, keys, how)
