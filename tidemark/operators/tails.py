"""Frames of the last n rows of one long series, without a window that puts the series in one task.

The series is numbered over ranges and dealt out in blocks of consecutive rows; a block begins with copies of the few
rows before it, so that every frame of up to that many rows lies within one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.ordered import ordered

#: Rows of a block.
BLOCK = 1 << 15


def in_blocks(series: DataFrame, order: list, reach: int, block: int = BLOCK) -> DataFrame:
    """``series`` with its row number ``rn`` and ``_block``; a row that the next block can reach is there too, as ``_copy``."""
    if reach > block:
        raise ValueError("a frame reaches over more than one block")
    placed = ordered(series, order).drop("n_rows")
    home = F.floor((F.col("rn") - 1) / block)
    last = F.floor((F.col("rn") - 1 + reach) / block)
    return placed.withColumn("_block", F.explode(F.sequence(home, last))).withColumn("_copy", F.col("_block") > home)


class Tails:
    """Frames that end at the row before the current one."""

    def __init__(self):
        self._order: WindowSpec = Window.partitionBy("_block").orderBy("rn")

    def last(self, n: int) -> WindowSpec:
        return self._order.rowsBetween(-n, -1)

    def previous(self, value: Column | str) -> Column:
        return F.lag(value).over(self._order)


def bar_tails(bars: DataFrame, reach: int = 125, block: int = BLOCK) -> DataFrame:
    """Each bar of ``bars`` (bt, open, high, low, close, volume) with what the bars before it say, by count and not by time.

    Moves are relative changes between neighbouring bars; the first bar of the series has none. A figure of too few bars is
    null, and so is the slope of closes that are not all positive. Times must be distinct; an empty table gives an empty one.
    """
    t = Tails()
    rows = in_blocks(bars, ["bt"], reach + 3, block)
    before = t.previous("close")
    rows = rows.withColumn("r", F.when(before != 0, F.col("close") / before - 1)).withColumn("_log", F.when(F.col("close") > 0, F.ln("close")))
    rows = rows.withColumn("pr", t.previous("r")).withColumn("n_pre", F.least(F.lit(reach), F.col("rn") - 1))
    moves = F.col("n_pre") - 1
    of = lambda agg, n: agg.over(t.last(n))
    high, low = (lambda n: of(F.max("high"), n)), (lambda n: of(F.min("low"), n))
    out = {f"pre_vol_{n}": F.when(moves >= least, of(F.stddev_samp("r"), n)) for n, least in ((5, 3), (10, 5), (30, 10), (60, 20))}
    out |= {f"volume_ratio_{a}_{b}": of(F.avg("volume"), a) / F.greatest(of(F.avg("volume"), b), F.lit(1.0)) for a, b in ((1, 30), (2, 30), (5, 30), (10, 60))}
    out |= {f"range_{n}m": (high(n) - low(n)) / F.nullif("close", F.lit(0.0)) for n in (5, 10, 30, 60)}
    out |= {f"close_position_{n}": F.when(high(n) > low(n), (F.col("close") - low(n)) / (high(n) - low(n))).when(high(n).isNotNull(), 0.5) for n in (10, 30, 60)}
    out |= {f"up_fraction_{n}": F.when(moves >= least, of(F.avg((F.col("r") > 0).cast("double")), n)) for n, least in ((10, 5), (30, 10))}
    paired = t.last(29)  # the first of thirty moves has no partner within them
    spread = (F.stddev_samp("r").over(paired) > 0) & (F.stddev_samp("pr").over(paired) > 0)
    out["return_autocorr_30"] = F.when((moves >= 10) & spread, F.corr("r", "pr").over(paired))
    for n in (30, 60):
        whole = (F.least(F.lit(n), F.col("n_pre")) >= 5) & (of(F.count("_log"), n) == F.least(F.lit(n), F.col("n_pre")))
        out[f"trend_slope_{n}"] = F.when(whole, of(F.regr_slope("_log", F.col("rn").cast("double")), n))
    weight = of(F.sum("volume"), 30)
    vwap = F.when(weight > 0, of(F.sum(F.col("close") * F.col("volume")), 30) / weight).otherwise(of(F.avg("close"), 30))
    out["vwap_distance_30"] = F.when(vwap > 0, F.col("close") / vwap - 1)
    out["entry_bar_ret"] = F.when(F.col("open") > 0, F.col("close") / F.col("open") - 1)
    out["entry_bar_range"] = F.when(F.col("close") > 0, (F.col("high") - F.col("low")) / F.col("close"))
    framed = rows.select("*", *[c.alias(n) for n, c in out.items()])
    return framed.where(~F.col("_copy")).select(*bars.columns, "rn", "n_pre", *out)
