"""Operators over one date's cross-section.

``CrossSection`` has two exact plans for each primitive.  While a whole date
fits one task (``Scale.wide`` is false) it is a window partitioned by date, so
any number of ranks share one shuffle.  Beyond that bound ordered primitives
range-partition the rows on (group, order), number them inside each range and
add the sizes of the preceding ranges; unordered statistics are map-side
combined and joined back.  No date is then ever gathered in one task and ties
of any size are split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalar import clip, col
from panelwright.scale import Scale, durable

DATE = ("date",)


def _key_match(a: DataFrame, b: DataFrame, keys, how="left") -> DataFrame:
    """Equi-join on keys that may be NULL, keeping one copy of each key."""
    renamed = b.select(*[F.col(k).alias(f"__{k}") for k in keys],
                       *[c for c in b.columns if c not in keys])
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return a.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


class CrossSection:
    def __init__(self, scale: Scale):
        self.scale = scale

    # -- primitives ---------------------------------------------------------
    def by_date(self, df: DataFrame) -> DataFrame:
        """Rows laid out by date, so that ranks by date and by parts of a date share one shuffle."""
        return df if self.scale.wide else df.repartition("date")

    def attach(self, df: DataFrame, by=DATE, **aggs: Column) -> DataFrame:
        """Add per-group aggregates to every row."""
        by = list(by)
        if not self.scale.wide:
            w = Window.partitionBy(*by)
            return df.withColumns({name: agg.over(w) for name, agg in aggs.items()})
        stats = df.groupBy(*by).agg(*[agg.alias(name) for name, agg in aggs.items()])
        return _key_match(df, self.scale.per_date(stats) if by == ["date"] else stats, by)

    def running(self, df: DataFrame, order, out: str, weight=None, by=DATE) -> DataFrame:
        """Sum of ``weight`` over the rows of the group up to and including this one.

        ``order`` must be unique inside a group.  Without a weight this is the
        row's position.
        """
        by = list(by)
        order = [F.col(o) if isinstance(o, str) else o for o in order]
        weight = F.lit(1) if weight is None else weight
        if not self.scale.wide:
            w = Window.partitionBy(*by).orderBy(*order)
            if weight is None:
                return df.withColumn(out, F.row_number().over(w))
            return df.withColumn(out, F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        ranged = durable(
            df.withColumn("_w", weight)
            .repartitionByRange(*[F.col(b) for b in by], *order)
            .withColumn("_part", F.spark_partition_id())
        )
        before = (
            ranged.groupBy(*by, "_part").agg(F.sum("_w").alias("_sum"))
            .withColumn("_before", F.coalesce(F.sum("_sum").over(
                Window.partitionBy(*by).orderBy("_part")
                .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .drop("_sum")
        )
        inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(
            Window.unboundedPreceding, 0)
        local = ranged.withColumn("_local", F.sum("_w").over(inside))
        return (
            _key_match(local, before, [*by, "_part"], "inner")
            .withColumn(out, F.col("_local") + F.col("_before"))
            .drop("_w", "_part", "_local", "_before")
        )

    def position(self, df: DataFrame, order, out: str, by=DATE) -> DataFrame:
        """1-based position of every row inside its group."""
        if not self.scale.wide:
            order = [F.col(o) if isinstance(o, str) else o for o in order]
            w = Window.partitionBy(*by).orderBy(*order)
            return df.withColumn(out, F.row_number().over(w))
        return self.running(df, order, out, by=by)

    def average_rank(self, df: DataFrame, x: str, out: str, by=DATE, count: str | None = None) -> DataFrame:
        """Average rank of the non-missing values, ties sharing their mean rank."""
        n = count or "__n"
        by = list(by)
        if not self.scale.wide:
            w = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
            d = df.withColumns({
                out: F.when(F.col(x).isNotNull(), (F.rank().over(w) + F.count(x).over(w)) / 2),
                n: F.count(x).over(Window.partitionBy(*by)),
            })
        else:
            ties = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_ties"))
            upto = self.running(ties, [x], "_upto", F.col("_ties"), by)
            ranks = upto.select(*by, x, (F.col("_upto") - (F.col("_ties") - 1) / 2).alias(out))
            d = _key_match(df, ranks, [*by, x])
            d = self.attach(d, by, **{n: F.count(x)})
        return d if count else d.drop(n)

    def quantile_table(self, df: DataFrame, x: str, qs: dict[str, float], by=DATE) -> DataFrame:
        """One row per group with linearly interpolated exact quantiles of ``x``."""
        by = list(by)
        if not self.scale.wide:
            return df.groupBy(*by).agg(
                *[F.percentile(x, F.lit(q)).alias(name) for name, q in qs.items()])
        d = df.where(F.col(x).isNotNull())
        d = d.groupBy(*by, x).agg(F.count("*").alias("_ties"))
        d = self.running(d, [x], "_upto", F.col("_ties"), by)
        d = self.attach(d, by, _n=F.sum("_ties"))
        picks = []
        for name, q in qs.items():
            at = (F.col("_n") - 1) * F.lit(q)
            for side, pos in (("lo", F.floor(at) + 1), ("hi", F.ceil(at) + 1)):
                hit = (F.col("_upto") >= pos) & (F.col("_upto") - F.col("_ties") < pos)
                picks.append(F.max(F.when(hit, F.col(x))).alias(f"_{name}_{side}"))
            picks.append(F.max(at - F.floor(at)).alias(f"_{name}_f"))
        groups = df.select(*by).distinct()  # groups without any value keep a missing quantile
        g = _key_match(groups, d.groupBy(*by).agg(*picks), by)
        return g.select(*by, *[
            (F.col(f"_{k}_lo") + F.col(f"_{k}_f") * (F.col(f"_{k}_hi") - F.col(f"_{k}_lo"))).alias(k)
            for k in qs])

    def median(self, df: DataFrame, x: str, out: str, by=DATE) -> DataFrame:
        """Attach the group's median to each row."""
        if not self.scale.wide:
            return self.attach(df, by, **{out: F.percentile(x, F.lit(0.5))})
        return _key_match(df, self.quantile_table(df, x, {out: 0.5}, by), list(by))

    # -- ranks --------------------------------------------------------------
    def first_rank(self, df, x: str, out: str, by=DATE, tie=("code",), descending=False):
        """Unique rank; ties are broken by ``tie``, missing values come last."""
        lead = F.col(x).desc_nulls_last() if descending else F.col(x).asc_nulls_last()
        return self.position(df, [lead, *tie], out, by)

    def pct_rank(self, df, x: str, out: str, by=DATE, missing=None):
        """Average rank over the number of non-missing values."""
        d = self.average_rank(df, x, "__r", by, "__n").withColumn(out, F.col("__r") / F.col("__n"))
        if missing is not None:
            d = d.withColumn(out, F.coalesce(out, F.lit(float(missing))))
        return d.drop("__r", "__n")

    def centered_rank(self, df, x: str, out: str, by=DATE, missing: float | None = 0.0):
        """Percentile rank around its own mean, scaled to (-1, 1).

        The mean of the average ranks 1..n is (n+1)/2, so no second pass is needed.
        """
        d = self.average_rank(df, x, "__r", by, "__n")
        d = d.withColumn(out, (2 * F.col("__r") - F.col("__n") - 1) / F.col("__n"))
        if missing is not None:
            d = d.withColumn(out, F.coalesce(out, F.lit(float(missing))))
        return d.drop("__r", "__n")

    def active_percentile(self, df, x: str, active: Column, out: str, missing: float = 0.0):
        """``0.5 + 0.5 * percentile`` among active rows, ``missing`` elsewhere."""
        d = df.withColumn("__a", F.when(active, F.col(x)))
        d = self.pct_rank(d, "__a", "__p")
        return d.withColumn(out, F.coalesce(0.5 + 0.5 * F.col("__p"), F.lit(missing))).drop("__a", "__p")

    # -- standardisation ----------------------------------------------------
    def zscore(self, df, x: str, out: str, by=DATE, bound: float = 3.0):
        d = self.attach(df, by, __m=F.avg(x), __s=F.stddev_samp(x))
        z = (F.col(x) - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s"))
        return d.withColumn("__z", z).withColumn(out, clip("__z", -bound, bound)).drop("__m", "__s", "__z")

    def fill_median(self, df, x: str, out: str, by=DATE, default: float = 0.0):
        d = self.median(df, x, "__med", by)
        return d.withColumn(out, F.coalesce(x, "__med", F.lit(default))).drop("__med")

    def demean(self, df, x: str, out: str, by):
        d = self.attach(df, by, __m=F.avg(x))
        return d.withColumn(out, F.col(x) - F.col("__m")).drop("__m")

    # -- portfolio groups ---------------------------------------------------
    def quintile(self, df, score: str, q: str = "q", weight: str = "w", tie=("code",), by=DATE):
        """Official five groups and weights; dates with fewer than five rows have none."""
        d = df.withColumn("__s", F.coalesce(F.col(score), F.lit(0.0)))
        d = self.first_rank(d, "__s", "__r", by=by, tie=tie)
        d = self.attach(d, by, __n=F.count(F.lit(1)))
        return groups_from_rank(d, "__r", "__n", q, weight).drop("__s", "__r", "__n")


def groups_from_rank(df, rank: str, n: str, q: str = "q", weight: str = "w") -> DataFrame:
    """Quintile 0..4 in integer arithmetic, and its long/short weight."""
    group = F.expr(f"greatest(0, (5 * (`{rank}` - 1) + `{n}` - 2) div (`{n}` - 1) - 1)")
    d = df.withColumn(q, F.when(F.col(n) >= 5, group).cast("int"))
    return d.withColumn(weight, (F.col(q) - 2) / F.col(n) / 1.2)


def rank_bins(pct, kind: str) -> Column:
    """Quintile or decile by floor, tercile by ceiling, of a percentile rank."""
    p = col(pct)
    if kind == "quintile":
        return F.least(F.lit(4), F.floor(5 * p)).cast("int")
    if kind == "decile":
        return F.least(F.lit(9), F.floor(10 * p)).cast("int")
    if kind == "tercile":
        return F.ceil(3 * p).cast("int")
    raise ValueError(kind)
