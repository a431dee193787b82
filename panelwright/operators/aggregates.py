"""Group reductions, monthly rows, forward windows and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalar import col
from panelwright.operators.asof import at_offset
from panelwright.scale import Scale

UNBOUNDED = Window.unboundedPreceding


def sum_min_count(x, need: int) -> Column:
    """Sum that is missing with fewer than ``need`` values."""
    return F.when(F.count(col(x)) >= need, F.sum(col(x)))


def share(cond) -> Column:
    return F.avg(cond.cast("double"))


def weighted_mean(x, w) -> Column:
    both = F.when(col(x).isNotNull(), col(w))
    return F.sum(col(x) * col(w)) / F.sum(both)


def correlation(x, y) -> Column:
    """Pearson correlation; NULL when either side is constant (``corr`` would fail)."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def moments(x) -> list[Column]:
    """Count, unbiased skewness and unbiased non-excess kurtosis of a column."""
    x = col(x)
    n, g1, g2 = F.count(x), F.skewness(x), F.kurtosis(x)
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n - 1) / ((n - 2) * (n - 3))) * ((n + 1) * g2 + 6) + 3)
    return [n.alias("n"), skew.alias("skew"), kurt.alias("kurtosis")]


def sample_skewness(x, need: int) -> Column:
    """Third central moment over the cubed sample deviation."""
    x = col(x)
    n = F.count(x)
    # population skewness rescaled from the ddof=0 to the ddof=1 deviation
    return F.when((n >= need) & (F.stddev_samp(x) > 0), F.skewness(x) * F.pow((n - 1) / n, 1.5))


def monthly(df: DataFrame, x: str, need: int = 15) -> DataFrame:
    """Month rows of a listing segment with the statistics of its daily values."""
    v = F.col(x)
    return df.groupBy("code", "seg", F.trunc("date", "month").alias("month")).agg(
        F.count(v).alias("month_n"), F.max("date").alias("last_date"),
        sample_skewness(v, need).alias("month_skew"),
        F.when(F.count(v) >= need, F.stddev_samp(v)).alias("month_std"),
        sum_min_count(v, need).alias("month_sum"),
    )


def lagged_month_sum(m: DataFrame, x: str, out: str, months: int = 11, lag: int = 2) -> DataFrame:
    f = Window.partitionBy("code", "seg").orderBy("month").rowsBetween(-(months + lag - 1), -lag)
    return m.withColumn(out, F.when(F.count(x).over(f) >= months, F.sum(x).over(f)))


def drawdowns(daily: DataFrame, net: str, keys=()) -> DataFrame:
    """Additive and compound drawdown of a dated series (one row per date)."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date").rowsBetween(UNBOUNDED, 0)
    d = daily.withColumn("_a", F.sum(net).over(w)).withColumn("_w", F.product(1 + F.col(net)).over(w))
    return (
        d.withColumn("dd_additive", F.col("_a") - F.greatest(F.lit(0.0), F.max("_a").over(w)))
        .withColumn("dd_compound", F.col("_w") / F.greatest(F.lit(1.0), F.max("_w").over(w)) - 1)
        .drop("_a", "_w")
    )


def forward_compound(df: DataFrame, x: str, horizon: int, out: str, scale: Scale, start: int = 2) -> DataFrame:
    """Compounded ``x`` over calendar positions ``start .. start+horizon-1`` ahead.

    Missing if any step is absent, missing or at most -100 %.  A range frame on
    the calendar ordinal looks ahead by position, not by observed row, so no
    grid has to be materialised.
    """
    f = Window.partitionBy("code").orderBy("ord").rangeBetween(start, start + horizon - 1)
    ok = F.when(F.col(x) > -1, F.log1p(F.col(x)))
    return df.withColumn(out, F.when(F.count(ok).over(f) == horizon, F.exp(F.sum(ok).over(f)) - 1))


def survival(df: DataFrame, state: str, offsets) -> DataFrame:
    """Does the code hold the same state ``k`` calendar positions later?"""
    d = df
    for k in offsets:
        d = at_offset(d, {state: f"_s{k}"}, k)
        d = d.withColumn(f"same{k}", F.col(f"_s{k}") == F.col(state)).drop(f"_s{k}")
    return d


def transitions(df: DataFrame, state: str) -> DataFrame:
    """Counts and row probabilities of the state on adjacent calendar positions."""
    d = at_offset(df.select("code", "ord", state), {state: "next_state"}, 1).where("next_state is not null")
    c = d.groupBy(state, "next_state").agg(F.count("*").alias("n"))
    return c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(state)))


def concentration(df: DataFrame, by, group: str, x: str) -> DataFrame:
    """Largest share, Herfindahl index and effective number of groups per key."""
    by = list(by)
    g = df.groupBy(*by, group).agg(F.sum(x).alias("_x"))
    # sum of squares over squared sum needs no second pass over the shares
    total, squares = F.sum("_x"), F.sum(F.col("_x") * F.col("_x"))
    return g.groupBy(*by).agg(
        (F.max("_x") / F.nullif(total, F.lit(0.0))).alias("max_share"),
        (squares / F.nullif(total * total, F.lit(0.0))).alias("hhi"),
        (total * total / F.nullif(squares, F.lit(0.0))).alias("effective"),
    )


def densify(dates: DataFrame, labels: DataFrame, facts: DataFrame, label: str, zero) -> DataFrame:
    """Every (date, label) cell, absent measures as zero.

    The label set is folded into one array and exploded on the date rows, so the
    grid is as large as the report and no pair join runs.
    """
    everything = labels.agg(F.array_sort(F.collect_set(label)).alias("_labels"))  # one row
    grid = dates.crossJoin(F.broadcast(everything)).select("date", F.explode("_labels").alias(label))
    return grid.join(facts, ["date", label], "left").fillna(0, subset=list(zero))


def unpivot(df: DataFrame, ids, columns, name="metric", value="value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def worst_days(daily: DataFrame, x: str, fraction: float, few: int, by) -> DataFrame:
    """Mean of the worst share of days, of the ``few`` worst days, and the worst day.

    ``daily`` has one row per date, so ranking inside a group is bounded.
    """
    by = list(by)
    w = Window.partitionBy(*by)
    d = daily.withColumn("_r", F.row_number().over(w.orderBy(x, "date"))).withColumn("_n", F.count("*").over(w))
    return d.groupBy(*by).agg(
        F.avg(F.when(F.col("_r") <= F.ceil(fraction * F.col("_n")), F.col(x))).alias("tail_mean"),
        F.avg(F.when(F.col("_r") <= few, F.col(x))).alias("few_mean"), F.min(x).alias("worst"))
