"""Frames of time over a long series: count, mean, least and greatest of the rows before a row by at most a span.

Rows of one key, time and value are counted first; then each key is cut into cells of a few spans, which begin with the last span of the
cell before. Within a cell sums are differences of running totals in whole numbers, extremes come from runs of doubled length: time grows with the rows and
the logarithm of a frame, not with their product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spans of a cell.
CELL = 4


def _sums(x: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of x n over [low, high): the greater part of each number as a whole one, so that differences of totals are exact."""
    odd = ~np.isfinite(x)
    plain = np.where(odd, 0.0, x)
    most = float(np.abs(plain).max(initial=0.0)) or 1.0
    scale = 62 - int(np.ceil(np.log2(most) + np.log2(n.sum() + 1.0)))
    whole = np.floor(np.ldexp(plain, scale))
    total = lambda a: np.concatenate(([0], np.cumsum(a)))
    part = lambda a: (lambda t: t[high] - t[low])(total(a))
    out = np.ldexp(part(whole.astype(np.int64) * n).astype(np.longdouble), -scale) + part((plain - np.ldexp(whole, -scale)) * n)
    out = out.astype(np.float64)
    if odd.any():
        none, up, down = (part(c.astype(np.int64)) > 0 for c in (np.isnan(x), x == np.inf, x == -np.inf))
        out = np.where(none | up & down, np.nan, np.where(up, np.inf, np.where(down, -np.inf, out)))
    return out


def _extremes(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest of x over [low, high), none of them empty; what is not a number is greater than all."""
    least, most = np.full(len(low), np.nan), np.full(len(low), np.nan)
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    a, b, size = x, x, 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        i, j = low[at], high[at] - size
        least[at], most[at] = np.fmin(a[i], a[j]), np.maximum(b[i], b[j])
        a, b, size = np.fmin(a[:-size], a[size:]), np.maximum(b[:-size], b[size:]), 2 * size
    return least, most


def _framed(t: np.ndarray, x: np.ndarray, n: np.ndarray, asked: np.ndarray, span: int) -> pd.DataFrame:
    """For each of the times ``asked`` what the rows (t, x, n times) say that are earlier by at most ``span``."""
    order = np.argsort(t, kind="stable")
    t, x, n = t[order], x[order], n[order]
    low, high = np.searchsorted(t, asked - span), np.searchsorted(t, asked)
    count = np.concatenate(([0], np.cumsum(n)))
    out = pd.DataFrame({"t": asked, "n": count[high] - count[low], "mean": np.nan, "low": np.nan, "high": np.nan})
    some = high > low
    if some.any():
        l, h = low[some], high[some]
        out.loc[some, "mean"] = _sums(x, n, l, h) / out.loc[some, "n"].to_numpy()
        out.loc[some, "low"], out.loc[some, "high"] = _extremes(x, l, h)
    return out


def time_frames(rows: DataFrame, key: str, time: str, value: str, span: int) -> DataFrame:
    """``rows`` with n, mean, low and high of the values of the same key that are earlier by one at least and by ``span`` at most.

    ``time`` is a whole number. Null values do not count; without a value the count is 0 and the rest null. A null key is a key; rows
    without a time stand in one frame of their own, as in a window of SQL.
    """
    own = rows.select(F.col(key).alias("key"), F.col(time).cast("bigint").alias("t"), F.col(value).cast("double").alias("x"))
    known = F.count("x").alias("n")
    counted = own.where("t IS NOT NULL").groupBy("key", "t", "x").agg(known)
    wide = CELL * span
    cell = F.floor(F.col("t") / wide)
    cells = F.when(F.pmod("t", F.lit(wide)) >= wide - span, F.array(cell, cell + 1)).otherwise(F.array(cell))
    dealt = counted.select("key", "t", F.coalesce("x", F.lit(0.0)).alias("x"), "n", F.explode(cells).alias("cell"))

    def run(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        t, n = part["t"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
        asked = np.unique(t[t >= int(group[1]) * wide])
        has = n > 0
        out = _framed(t[has], part["x"].to_numpy(np.float64)[has], n[has], asked, span)
        return out.assign(key=group[0])[["key", "t", "n", "mean", "low", "high"]]

    kind = own.schema["key"].dataType.simpleString()
    framed = dealt.groupBy("key", "cell").applyInPandas(run, f"key {kind}, t bigint, n bigint, mean double, low double, high double")
    # Pandas has one mark for null and for what is not a number; where there are values nothing is null.
    real = lambda c: F.when(F.col("n") > 0, F.coalesce(c, F.lit(float("nan")))).alias(c)
    framed = framed.select("key", "t", "n", real("mean"), real("low"), real("high"))
    timeless = own.where("t IS NULL").groupBy("key").agg(known, F.avg("x").alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"))
    every = framed.unionByName(timeless.select("key", F.lit(None).cast("bigint").alias("t"), "n", "mean", "low", "high"))
    every = every.select(F.col("key").alias("_key"), F.col("t").alias("_t"), "n", "mean", "low", "high")
    return rows.join(every, F.col(key).eqNullSafe(F.col("_key")) & F.col(time).cast("bigint").eqNullSafe(F.col("_t"))).drop("_key", "_t")
