"""Books as sets: overlap, folds, day-to-day flow and event origins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators import timeseries as ts


def overlap(df: DataFrame, a: Column, b: Column, by=("date",)) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    return df.groupBy(*by).agg(
        n(a).alias("base"), n(b).alias("other"), n(a & b).alias("both"),
        (n(a & b) / F.nullif(n(a), F.lit(0))).alias("share"))


def union_folds(folds: list[DataFrame], keys=("date", "code")) -> DataFrame:
    """Concatenate fold results; a key present in two folds is an error."""
    out = reduce(DataFrame.unionByName, folds)
    if out.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError("folds overlap")
    return out


def flow(book: DataFrame) -> DataFrame:
    """Retained members, entrants and exits at every calendar position."""
    today = book.select("code", "ord", F.lit(1).alias("_now"))
    before = book.select("code", (F.col("ord") + 1).alias("ord"), F.lit(1).alias("_was"))
    d = today.join(before, ["code", "ord"], "full")
    now, was = F.col("_now").isNotNull(), F.col("_was").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    return d.groupBy("ord").agg(n(now & was).alias("retained"), n(now & ~was).alias("entrants"),
                                n(was & ~now).alias("exits"))


def origin_value(df: DataFrame, event: str, value: str, out: str) -> DataFrame:
    """Date and value of the latest event a row descends from.

    The event's value travels with its date through one window, so no self-join
    is needed.
    """
    at = F.when(F.col(event), F.struct(F.col("date").alias("d"), F.col(value).alias("v")))
    carried = F.last(at, ignorenulls=True).over(ts.history().rowsBetween(ts.UNBOUNDED, 0))
    return df.withColumn("_o", carried).withColumn("origin", F.col("_o.d")).withColumn(out, F.col("_o.v")).drop("_o")
