"""Positions and running totals over one global order, without a window that puts the whole table in one task.

Rows are dealt out by ranges of the order and sorted within them; the ranges' sizes and sums make a table of one row
a range, whose running totals are added to those within the ranges. Ties of the order must be broken by its last
columns, or rows that tie change places from run to run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import materialise


def ordered(df: DataFrame, order: list, sums: dict[str, Column | str] | None = None, number: str = "rn", total: str = "n_rows") -> DataFrame:
    """``df`` with its row number (from 1) in ``order``, the number of rows and, for each of ``sums``, the running
    total up to and with the row (``name``) and over all rows (``name_all``). An empty table gives an empty one."""
    spark, sums = df.sparkSession, {k: F.expr(v) if isinstance(v, str) else v for k, v in (sums or {}).items()}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.expr(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # The identifier ascends along a partition: its high bits name the range, its low bits the place within.
    placed = ranged.withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("_range", F.shiftright("_at", 33)), "ordered")
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = ["n", *sums]
    whole = Window.partitionBy()
    starts = sizes.select(
        "_range",
        *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}_before") for k in names],
        *[F.sum(f"_{k}").over(whole).alias(f"_{k}_all") for k in names],
    )
    out = placed
    if sums:
        within = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        out = out.select("*", *[F.sum(c).over(within).alias(f"_{k}_within") for k, c in sums.items()])
    out = out.join(F.broadcast(starts), "_range")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_n_before") + 1
    running = [x for k in sums for x in ((F.col(f"_{k}_within") + F.col(f"_{k}_before")).alias(k), F.col(f"_{k}_all").alias(f"{k}_all"))]
    return out.select(*df.columns, place.alias(number), F.col("_n_all").alias(total), *running)


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, same, upto, n_rows): of each distinct value the rows that have it, those up to and with it, and all rows.

    Rows are counted per value first, so that only distinct values are put in order.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("same"))
    return ordered(counts, [value], {"upto": "same"}).select(value, "same", "upto", F.col("upto_all").alias("n_rows"))


def equal_parts(k: int, number: str = "rn", total: str = "n_rows") -> Column:
    """The part (from 1) of ``k`` parts of equal size, the first ones taking the remainder."""
    size, more = F.floor(F.col(total) / k), F.col(total) % k
    r = F.col(number) - 1
    return F.when(r < more * (size + 1), F.floor(r / (size + 1))).otherwise(more + F.floor((r - more * (size + 1)) / F.greatest(size, F.lit(1)))).cast("int") + 1


def quantile_bins(k: int, number: str = "rn", total: str = "n_rows") -> Column:
    """The bin (from 1) of ranks 1 .. n cut at their k-quantiles with linear interpolation, each bin closed above."""
    return F.greatest(F.lit(1), F.expr(f"({number} - 1) * {k} div greatest({total} - 1, 1) + CAST(({number} - 1) * {k} % greatest({total} - 1, 1) > 0 AS BIGINT)")).cast("int")


def _between(low: Column, high: Column, part: Column) -> Column:
    """(1 - part) low + part high, the first product added without a rounding of its own: neighbours of one unit in the
    last place have nothing between them, and which of the two it is decides what a cut there lets through."""

    def halves(x: Column) -> tuple[Column, Column]:
        wide = x * 134217729.0
        top = wide - (wide - x)
        return top, x - top

    rest = 1 - part
    product, added = low * rest, high * part
    (a, b), (c, d) = halves(low), halves(rest)
    error = ((a * c - product) + a * d + b * c) + b * d
    both = product + added
    moved = both - product
    exact = both + (((product - (both - moved)) + (added - moved)) + error)
    # Infinities and what is not a number have no halves.
    return F.when(F.isnan(exact), both).otherwise(exact)


def exact_quantiles(df: DataFrame, value: str, shares: list[float], keys: list[str] = ()) -> DataFrame:
    """(keys, share, quantile, n): exact quantiles with linear interpolation, per group, of the values that are not null.

    Values are counted first, then put in order over ranges and found by their rank: no task and no aggregate holds a group's
    values, however large the group. Null keys are a group; a group without a value has no row.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*[F.col(k) for k in keys], F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_same"))
    placed = ordered(counts, [*keys, "_v"], {"_upto": "_same"}).select(*keys, "_v", "_same", "_upto")
    groups = placed.groupBy(*keys).agg(F.sum("_same").alias("n"), F.min(F.col("_upto") - F.col("_same")).alias("_start"))
    if keys:
        named = groups.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", "_start")
        own = placed.join(named, [placed[k].eqNullSafe(named[f"_k{i}"]) for i, k in enumerate(keys)])
    else:
        own = placed.join(F.broadcast(groups))  # one row
    upto = F.col("_upto") - F.col("_start")
    holds = lambda rank: (rank >= upto - F.col("_same")) & (rank < upto)
    wanted = []
    for share in shares:
        at = F.lit(float(share)) * (F.col("n") - 1)
        low, high = holds(F.floor(at)), holds(F.ceil(at))
        wanted.append(F.when(low | high, F.struct(F.lit(float(share)).alias("share"), (at - F.floor(at)).alias("part"), F.when(low, F.col("_v")).alias("low"), F.when(high, F.col("_v")).alias("high"))))
    hits = own.select(*keys, "n", F.explode(F.array_compact(F.array(*wanted))).alias("w")).select(*keys, "n", "w.*")
    ends = hits.groupBy(*keys, "share").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.max("part").alias("part"), F.max("n").alias("n"))
    return ends.select(*keys, "share", _between(F.col("low"), F.col("high"), F.col("part")).alias("quantile"), "n")
