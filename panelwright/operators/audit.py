"""Data-quality and causality audits, run as Spark jobs.

A build is causal when changing or removing later inputs leaves every earlier
output as it was.  Comparisons are keyed full joins that end in counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType

from panelwright.operators import timeseries as ts


def contract(labels: DataFrame, scores: DataFrame, score: str = "score", keys=("date", "code")) -> DataFrame:
    """Counts of duplicate keys, non-finite scores, uncovered labels and surplus scores."""
    keys = list(keys)
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    per_key = scores.groupBy(*keys).agg(F.count("*").alias("_n"), F.count(F.when(~finite, 1)).alias("_bad"))
    j = per_key.join(labels.select(*keys, F.lit(1).alias("_label")), keys, "full")
    n = lambda c: F.count(F.when(c, 1))
    return j.agg(n(F.col("_n") > 1).alias("duplicates"), n(F.col("_bad") > 0).alias("non_finite"),
                 n(F.col("_n").isNull()).alias("uncovered"), n(F.col("_label").isNull()).alias("surplus"))


def mutate(df: DataFrame, when, kind: str = "affine", skip=("date", "code", "ord", "seg")) -> DataFrame:
    """Alter every input column on the selected rows, dispatching on its type.

    ``affine`` maps values one to one (a shift for numbers and dates, a suffix
    for text), ``constant`` makes all of them equal; flags are turned over.
    """
    changed = {}
    for f in df.schema.fields:
        if f.name in skip:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, NumericType):
            new = (c * 1.7 + 3) if kind == "affine" else F.lit(5)
            new = new.cast(f.dataType)
        elif isinstance(f.dataType, BooleanType):
            new = ~c
        elif isinstance(f.dataType, DateType):
            new = F.date_add(c, 7) if kind == "affine" else F.lit("1970-01-01").cast("date")
        elif isinstance(f.dataType, StringType):
            new = F.concat(F.coalesce(c, F.lit("")), F.lit(" changed")) if kind == "affine" else F.lit("changed")
        else:
            continue
        changed[f.name] = F.when(when, new).otherwise(c)
    return df.withColumns(changed)


def first_day_split(df: DataFrame, cutoff, factor: float = 0.25) -> DataFrame:
    """A corporate action on the first date after the cutoff."""
    first = df.where(F.col("date") > cutoff).agg(F.min("date").alias("_d"))
    d = df.join(F.broadcast(first), how="cross")
    return d.withColumn("factor", F.when(F.col("date") == F.col("_d"), F.lit(factor)).otherwise(F.col("factor"))).drop("_d")


def difference(a: DataFrame, b: DataFrame, columns, keys=("date", "code"), tolerance: float = 1e-9) -> DataFrame:
    """Rows compared, and rows where any column differs or a key is missing."""
    keys, columns = list(keys), list(columns)
    left = a.select(*keys, *columns, F.lit(1).alias("_a"))
    right = b.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(1).alias("_b"))
    j = left.join(right, keys, "full")

    def same(c):
        near = F.abs(F.col(c).cast("double") - F.col(f"_n_{c}").cast("double")) <= tolerance
        return (F.col(c).isNull() & F.col(f"_n_{c}").isNull()) | F.coalesce(near, F.lit(False))

    ok = reduce(lambda x, y: x & y, [same(c) for c in columns], F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return j.agg(F.count("*").alias("rows"), F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias("changed"))


def future_mutation(inputs: DataFrame, build: Callable[[DataFrame], DataFrame], cutoff: str, columns,
                    kinds=("affine", "constant")) -> DataFrame:
    """Rebuild from inputs altered after the cutoff; earlier outputs must not change."""
    cut = F.lit(cutoff).cast("date")
    base, out = build(inputs).where(F.col("date") <= cut), None
    for kind in kinds:
        again = build(mutate(inputs, F.col("date") > cut, kind)).where(F.col("date") <= cut)
        one = difference(base, again, columns).withColumn("mutation", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def mutated_copy(spark, tables: dict[str, tuple[DataFrame, str | None, tuple]], cut, folder: str, kind: str = "affine") -> str:
    """Write every table to ``folder`` with all values after ``cut`` altered; keys and dates stay.

    ``tables`` maps a name to its rows, its date column (None: copied as it is)
    and the columns that must keep their values.  Whatever is then built from
    the copy has had no honest look at anything later.
    """
    for name, (df, date, keep) in tables.items():
        d = df if date is None else mutate(df, F.col(date) >= cut, kind, skip=(date, *keep))
        d.write.option("compression", "zstd").parquet(f"{folder}/{name}.parquet")
    return folder


def early(df: DataFrame, cut: str) -> DataFrame:
    """Rows up to a day."""
    return df.where(F.col("date").cast("date") <= F.lit(cut).cast("date"))


def rebuilt_difference(before: DataFrame, after: DataFrame, cut: str, keys=("date", "code"), planted: str | None = None, tolerance: float = 1e-6) -> DataFrame:
    """``rows, changed`` of an output up to ``cut`` against the same output of altered inputs.

    Numbers may differ by ``tolerance`` (outputs are rounded), everything else
    must be equal.  ``planted`` names a column that looks ahead on purpose; it
    is counted apart, as ``caught``, to show that the audit would see a leak.
    """
    keys = list(keys)
    values = [f for f in before.schema.fields if f.name not in keys]
    right = early(after, cut).select(*keys, *[F.col(f.name).alias(f"_n_{f.name}") for f in values], F.lit(1).alias("_b"))
    j = early(before, cut).withColumn("_a", F.lit(1)).join(right, keys, "full")

    def same(f):
        equal = F.col(f.name).eqNullSafe(F.col(f"_n_{f.name}"))
        if isinstance(f.dataType, NumericType):
            equal = equal | F.coalesce(F.abs(F.col(f.name) - F.col(f"_n_{f.name}")) <= tolerance, F.lit(False))
        return equal

    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    ok = reduce(lambda x, f: x & same(f), [f for f in values if f.name != planted], both)
    counts = [F.count(F.lit(1)).alias("rows"), F.count(F.when(~ok, 1)).alias("changed")]
    if planted:
        counts.append(F.count(F.when(~(both & reduce(lambda x, f: x & same(f), [f for f in values if f.name == planted], F.lit(True))), 1)).alias("caught"))
    return j.agg(*counts)


def truncation(inputs: DataFrame, build, cutoff: str, columns) -> DataFrame:
    """Rebuild without any input after the cutoff."""
    cut = F.lit(cutoff).cast("date")
    return difference(build(inputs).where(F.col("date") <= cut), build(inputs.where(F.col("date") <= cut)), columns)


def row_order(inputs: DataFrame, build, columns, parts: int = 11) -> DataFrame:
    return difference(build(inputs), build(inputs.repartition(parts)), columns)


def reconcile(df: DataFrame, identities: dict, tolerance: float = 1e-9) -> DataFrame:
    """Broken rows and largest gap of accounting identities that should be zero."""
    rows = [
        F.struct(F.lit(name).alias("identity"), F.count(F.when(F.abs(gap) > tolerance, 1)).alias("broken"), F.count(gap).alias("rows"))
        for name, gap in identities.items()
    ]
    return df.agg(F.array(*rows).alias("_r")).select(F.inline("_r"))


def reset_audit(df: DataFrame, limit: int, state: str, raw: str) -> DataFrame:
    """Rows by gap class, and whether the smooth restarts at the raw value after a reset."""
    gap = F.col("ord") - ts.shift("ord", keys=("code",))
    cls = (F.when(gap.isNull(), "first").when(gap == 1, "next").when(gap < limit, "inside")
           .when(gap == limit, "limit").otherwise("reset"))
    restart = F.abs(F.col(state) - F.col(raw)) <= 1e-12
    d = df.withColumn("gap_class", cls).withColumn("_restart", restart)
    return d.groupBy("gap_class").agg(F.count("*").alias("rows"), F.count(F.when(F.col("_restart"), 1)).alias("equal_raw"))
