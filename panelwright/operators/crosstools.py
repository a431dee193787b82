"""Tail masks, tie diagnostics and deterministic reorderings of cross-sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalar import day_text, rounded
from panelwright.operators.xsection import CrossSection, _key_match


def keyed_order(*parts, seed: int = 0) -> Column:
    """Pseudo-random but reproducible order of keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def tail_masks(df: DataFrame, x: str, xs: CrossSection, tail: float = 0.1, cut: float = 0.2) -> DataFrame:
    """Exact-size tails by unique rank, and tie-inclusive tails by percentile."""
    d = xs.pct_rank(xs.first_rank(df, x, "_r"), x, "_p")
    d = xs.attach(d, _n=F.count(F.lit(1)))
    if xs.scale.wide:
        d = _key_match(d, xs.quantile_table(d, "_p", {"_lo": cut, "_hi": 1 - cut}), ["date"])
    else:
        d = xs.attach(d, _lo=F.percentile("_p", F.lit(cut)), _hi=F.percentile("_p", F.lit(1 - cut)))
    return d.withColumns({
        "low_tail": F.col("_r") / F.col("_n") <= tail,
        "high_tail": F.col("_r") / F.col("_n") > 1 - tail,
        "low_quintile": F.col("_p") <= F.col("_lo"),
        "high_quintile": F.col("_p") >= F.col("_hi"),
    }).drop("_r", "_p", "_n", "_lo", "_hi")


def tie_diagnostics(df: DataFrame, score: str, q: str, by=("date",)) -> DataFrame:
    """Tied rows, ties across a group boundary and the share of distinct scores."""
    g = df.groupBy(*by, score).agg(F.count("*").alias("_n"), F.min(q).alias("_lo"), F.max(q).alias("_hi"))
    n = F.col("_n")
    return g.groupBy(*by).agg(
        F.sum(n).alias("rows"), F.count("*").alias("distinct_scores"),
        F.sum(F.when(n > 1, n).otherwise(0)).alias("duplicated"),
        F.sum(F.when(F.col("_lo") != F.col("_hi"), n).otherwise(0)).alias("crossing"),
        (F.count("*") / F.sum(n)).alias("unique_ratio"),
    )


def dispersion(df: DataFrame, score: str, by=("date",)) -> DataFrame:
    """Standard deviation, mean size over it and distinct values, from one pre-aggregated pass per value."""
    values = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("_n"))
    std = F.stddev_samp(score)
    stats = df.groupBy(*by).agg(std.alias("std"), F.try_divide(F.avg(F.abs(score)), F.nullif(std, F.lit(0.0))).alias("size_ratio"))
    uniq = values.groupBy(*by).agg(F.count("*").alias("uniq"))
    return stats.join(uniq, list(by), "left").fillna(0, ["uniq"]).withColumn("constant", F.col("uniq") <= 1)


def weak_positive(df: DataFrame, score: str, xs: CrossSection) -> DataFrame:
    """Positive scores at or below the same date's median positive score."""
    d = df.withColumn("_p", F.when(F.col(score) > 0, F.col(score)))
    d = xs.median(d, "_p", "_med")
    return d.withColumn("weak", F.coalesce(F.col("_p") <= F.col("_med"), F.lit(False))).drop("_p", "_med")


def reverse_some_dates(df: DataFrame, x: str, out: str, xs: CrossSection, seed: int) -> DataFrame:
    """Reverse the code order of ``x`` on a seeded half of the dates."""
    flip = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), day_text())), 1, 4), 16, 10).cast("long") % 2 == 0
    d = xs.attach(xs.position(df, ["code"], "_rn"), _n=F.count(F.lit(1)))
    mirror = d.select("date", (F.col("_n") + 1 - F.col("_rn")).alias("_rn"), F.col(x).alias("_other"))
    return (
        d.join(mirror, ["date", "_rn"])
        .withColumn(out, F.when(flip, F.col("_other")).otherwise(F.col(x)))
        .drop("_rn", "_n", "_other")
    )


def canonical_position(df: DataFrame, xs: CrossSection) -> DataFrame:
    """Position in (date, code) order over the whole panel.

    The position inside the date plus the rows of all earlier dates, so no
    global sort into one task is needed.
    """
    from pyspark.sql import Window

    sizes = df.groupBy("date").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = xs.position(df, ["code"], "_rn").join(xs.scale.per_date(sizes.drop("_n")), "date")
    return d.withColumn("position", F.col("_rn") + F.col("_before")).drop("_rn", "_before")


def audit_sample(df: DataFrame, cls: str, rows: int, seed: int) -> DataFrame:
    """First member of every class and a reproducible random sample of ``rows`` rows."""
    first = df.groupBy(cls).agg(F.min(F.struct("date", "code")).alias("_k")).select("_k.*", cls)
    picked = df.orderBy(keyed_order(day_text(), "code", seed=seed), "date", "code").limit(rows)
    return first.select("date", "code", cls).union(picked.select("date", "code", cls)).distinct()


def condition_tables(df: DataFrame, dimensions: dict[str, Column], w: str = "w", dw: str = "dw", target: str = "target", one_way: float = 0.001) -> DataFrame:
    """Counts, returns, cost and legs of a book by each level of several dimensions, in one pass over unpivoted levels."""
    level = F.array(*[F.struct(F.lit(k).alias("dimension"), v.cast("string").alias("level")) for k, v in dimensions.items()])
    d = df.select("date", w, dw, target, F.inline(level))
    pl = F.col(w) * F.col(target)
    rounded_sum = lambda c, k: rounded(F.sum(c), k)
    return d.groupBy("dimension", "level").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("date").alias("days"), rounded(F.avg(target), 6).alias("target"), rounded_sum(pl, 5).alias("gross"),
        rounded_sum(F.when(F.col(target).isNotNull(), one_way * F.col(dw)), 6).alias("cost"), rounded_sum(F.when(F.col(w) > 0, pl), 5).alias("long"),
        rounded_sum(F.when(F.col(w) < 0, pl), 5).alias("short"), rounded(F.avg(F.abs(w))).alias("held"))
