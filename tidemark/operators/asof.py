"""As-of joins: the first row at or after, or the last row at or before, a point in time.

Both sides are unioned and filled by one window, so a join costs one shuffle and one sort per key and
never a quadratic step. A series that all keys share, or a hot key, is first cut into time buckets: a
bucket then needs only its own rows and the one row that is carried over its border.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    value: str,
    keys: list[str] = (),
    direction: str = "forward",
    tolerance: int | None = None,
    bucket: int | None = None,
    prefix: str = "asof",
) -> DataFrame:
    """Adds ``{prefix}_time`` and ``{prefix}_value`` to ``left``. Times are integers of one unit.

    ``direction``: ``forward`` finds the first right time >= the left one, ``backward`` the last <= it.
    Further away than ``tolerance`` is null. Ties of right times take the greatest value. ``bucket`` (at
    least the tolerance) cuts time into parts that are filled apart; rows near a border go to both. Without
    keys and bucket all rows meet in one task, which is warned of.
    """
    keys = list(keys)
    if not keys and bucket is None:
        warnings.warn("an as-of join without keys and bucket puts both tables in one task", stacklevel=2)
    ahead = direction == "forward"
    series = right.where(F.col(right_time).isNotNull()).groupBy(*keys, F.col(right_time).alias("_t")).agg(F.max(value).alias("_v"))
    if bucket is not None:
        if tolerance is None or tolerance > bucket:
            raise ValueError("buckets need a tolerance no longer than they are")
        left = left.withColumn("_bucket", F.floor(F.col(left_time) / bucket))
        # A left row looks at most one tolerance away: into its own bucket or the next in that direction.
        home = F.floor(F.col("_t") / bucket)
        series = series.withColumn("_bucket", F.explode(F.array(home, home - 1 if ahead else home + 1)))
        keys = [*keys, "_bucket"]
    row = left.select(*[F.col(k) for k in keys], F.col(left_time).alias("_t"), F.lit(None).cast(series.schema["_v"].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    both = row.unionByName(series, allowMissingColumns=True)
    own = F.when(F.col("_row").isNull(), F.struct("_t", "_v"))
    # Looking ahead is looking back along descending time; at equal times the series comes first, where it can be seen.
    # A frame that only grows is filled in one pass, one that begins at the current row would be read anew for every row.
    time = F.desc("_t") if ahead else F.asc("_t")
    order = Window.partitionBy(*keys).orderBy(time, F.col("_row").isNotNull())
    found = F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    joined = both.withColumn("_hit", found).where(F.col("_row").isNotNull())
    far = F.abs(F.col("_hit._t") - F.col("_t"))
    near = F.lit(True) if tolerance is None else far <= tolerance
    out = joined.select("_row.*", F.when(near, F.col("_hit._t")).alias(f"{prefix}_time"), F.when(near, F.col("_hit._v")).alias(f"{prefix}_value"))
    return out.drop("_bucket")


def embargo_anti(left: DataFrame, right: DataFrame, time: str, keys: list[str], within: int) -> DataFrame:
    """Rows of ``left`` with no row of ``right`` of the same key within ``within`` time units either way."""
    seen = right.select(*keys, F.col(time).alias("_other"))
    cell = F.floor(F.col("_other") / within)
    seen = seen.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1))).distinct()
    near = left.withColumn("_cell", F.floor(F.col(time) / within))
    return near.join(seen, [F.abs(F.col(time) - F.col("_other")) <= within, *[near[k] == seen[k] for k in [*keys, "_cell"]]], "left_anti").drop("_cell")
