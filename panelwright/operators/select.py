"""Row selection by calendar, membership and deterministic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_window(df: DataFrame, start: str, end: str, purge: int = 2) -> DataFrame:
    """Dates in ``[start, end)`` without the last ``purge`` calendar dates of the window.

    Their labels would mature after the window.  The calendar is the whole
    input's, found from one row per date.
    """
    last = df.where(F.col("date") < F.lit(end).cast("date")).agg((F.max("ord") - purge).alias("_last"))
    return (
        df.where(F.col("date") >= F.lit(start).cast("date"))
        .join(F.broadcast(last), F.col("ord") <= F.col("_last"))
        .drop("_last")
    )


def mature_rows(df: DataFrame, fold_start: str, horizon: int = 1) -> DataFrame:
    """Rows whose label of ``horizon`` steps is known before the fold begins."""
    first = df.where(F.col("date") >= F.lit(fold_start).cast("date")).agg(F.min("ord").alias("_k"))
    return df.join(F.broadcast(first), F.col("ord") < F.col("_k") - (horizon + 1)).drop("_k")


def every_kth_date(df: DataFrame, k: int = 5) -> DataFrame:
    return df.where(F.col("ord") % k == 0)
