"""As-of joins by union and last-value windows.

The right side is first reduced to one row per key and day, so a window holds
at most the panel dates plus the event days of one key, whatever the number
of raw events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalar import col


def last_per_day(events: DataFrame, keys, day: str, order, cols) -> DataFrame:
    """Keep, for every key and day, the record with the highest ``order``."""
    order = [order] if isinstance(order, str) else list(order)
    best = F.max_by(F.struct(*cols), F.struct(*order))
    return events.groupBy(*keys, day).agg(best.alias("_v")).select(*keys, day, "_v.*")


def last_field_per_day(events: DataFrame, keys, day: str, order: str, cols) -> DataFrame:
    """Like ``last_per_day`` but every column keeps its own last non-missing value."""
    return events.groupBy(*keys, day).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def asof(left: DataFrame, right: DataFrame, keys, left_on: str, right_on: str, cols,
         strict: bool = False, per_column: bool = False) -> DataFrame:
    """Backward as-of join; ``right`` has one row per key and ``right_on`` value.

    ``strict`` hides records dated on the left row's own date.  The matched
    record arrives whole, or with ``per_column`` each column carries its own
    last non-missing value.  ``<right_on>`` of the matched record is kept.
    """
    keys = list(keys)
    payload = [right_on, *[c for c in cols if c != right_on]]
    rest = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(left_on).alias("_t"), F.lit(1).alias("_left"),
                    F.struct(*rest).alias("_row"))
    b = right.select(*keys, F.col(right_on).alias("_t"), F.lit(0).alias("_left"),
                     F.struct(*payload).alias("_rec"))
    both = a.unionByName(b, allowMissingColumns=True)
    # A strict join reads the panel row before the records of the same moment.
    side = F.col("_left").desc() if strict else F.col("_left").asc()
    past = Window.partitionBy(*keys).orderBy("_t", side).rowsBetween(Window.unboundedPreceding, 0)
    if per_column:
        found = {c: F.last(F.col(f"_rec.{c}"), ignorenulls=True).over(past) for c in payload}
        d = both.withColumns({f"_m_{c}": v for c, v in found.items()}).where("_left = 1")
        return d.select(*keys, "_row.*", *[F.col(f"_m_{c}").alias(c) for c in payload])
    d = both.withColumn("_m", F.last("_rec", ignorenulls=True).over(past)).where("_left = 1")
    return d.select(*keys, "_row.*", *[F.col(f"_m.{c}").alias(c) for c in payload])


def asof_unkeyed(dates: DataFrame, series: DataFrame, on: str, stamp: str, cols,
                 cutoff: Column | None = None) -> DataFrame:
    """As-of of a date-only series onto a calendar (both bounded by their dates)."""
    moment = cutoff if cutoff is not None else F.col(on).cast("timestamp")
    left = dates.withColumn("_k", F.lit(0)).withColumn("_at", moment)
    right = series.withColumn("_k", F.lit(0))
    return asof(left, right, ["_k"], "_at", stamp, cols).drop("_k", "_at")


def unexpired(value, today, stamp, days: int = 450) -> Column:
    """Drop a carried value whose record is older than ``days``."""
    age = F.datediff(col(today), col(stamp))
    return F.when(age.between(0, days), col(value))


def at_offset(df: DataFrame, cols: dict[str, str], offset: int, keys=("code",)) -> DataFrame:
    """Attach the same code's values at calendar position ``ord + offset``.

    Rows may be absent, so it is a frame of that very position (one row at
    most) and never a lead; the layout by code needs no further shuffle.
    """
    there = Window.partitionBy(*keys).orderBy("ord").rangeBetween(offset, offset)
    return df.withColumns({new: F.max(c).over(there) for c, new in cols.items()})
