"""Exchange calendar, ordinals and listing segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.scale import Scale

GAP = 20


def calendar(df: DataFrame) -> DataFrame:
    """Sorted distinct dates with a zero-based ordinal (one row per date)."""
    return df.select("date").distinct().select(
        "date", (F.row_number().over(Window.orderBy("date")) - 1).alias("ord")
    )


def with_ordinal(df: DataFrame, scale: Scale) -> DataFrame:
    return df.join(scale.per_date(calendar(df)), "date")


def with_segment(df: DataFrame, gap: int = GAP) -> DataFrame:
    """Listing segment: a code absent for more than ``gap`` dates starts anew."""
    w = Window.partitionBy("code").orderBy("date")
    jump = F.when(F.col("ord") - F.lag("ord").over(w) > gap, 1).otherwise(0)
    return df.withColumn("_jump", jump).withColumn(
        "seg", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    ).drop("_jump")


def duplicate_keys(df: DataFrame, keys=("date", "code")) -> DataFrame:
    """Keys that occur more than once; empty for a valid panel."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")

