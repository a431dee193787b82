"""Diagnostics of scores, holdings and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators import aggregates as agg
from panelwright.operators.asof import at_offset
from panelwright.operators.crosstools import tie_diagnostics
from panelwright.operators.evaluation import hac_t, rank_ic
from panelwright.operators.xsection import CrossSection


def regulation(df: DataFrame, score: str, q: str, w: str) -> DataFrame:
    """Per date: zero, duplicate and boundary-tie rates, group counts, exposures."""
    ties = tie_diagnostics(df, score, q)
    side = df.groupBy("date").agg(
        agg.share(F.col(score) == 0).alias("zero_rate"),
        *[F.count(F.when(F.col(q) == k, 1)).alias(f"n_q{k + 1}") for k in (0, 4)],
        F.sum(F.greatest(F.col(w), F.lit(0.0))).alias("long_exposure"),
        F.sum(F.least(F.col(w), F.lit(0.0))).alias("short_exposure"))
    return ties.join(side, "date").withColumn("duplicate_rate", F.col("duplicated") / F.col("rows"))


def group_summary(df: DataFrame, keys, n_dates: Column | int, xs: CrossSection, periods: int = 252) -> DataFrame:
    """Exposure, contribution and rank correlation of any grouping of held rows.

    A group without rows on a date earns zero there, so annual figures divide
    sums by the number of account dates instead of filling a grid.
    """
    keys = list(keys)
    g = df.groupBy(*keys).agg(
        F.count("*").alias("stock_days"), F.sum(F.abs("w")).alias("exposure"), F.avg("w").alias("mean_weight"),
        (F.sum("gross") / n_dates * periods).alias("annual_gross"), (F.sum("net") / n_dates * periods).alias("annual_net"),
        (F.sum("dw") / n_dates * periods).alias("annual_turnover"))
    ic = rank_ic(df, "score", "target", xs, [*keys, "date"]).groupBy(*keys).agg(F.avg("rankic").alias("mean_ic"))
    total = Window.partitionBy(F.lit(0))  # one row per group of the report
    return g.join(ic, keys, "left").withColumn("weight_share", F.col("exposure") / F.sum("exposure").over(total))


def tail_composition(df: DataFrame, group: str, q: str, w: str, score: str) -> DataFrame:
    """Group shares inside the bottom and top quintile of each date."""
    t = df.where(F.col(q).isin(0, 4)).groupBy("date", q, group).agg(
        F.count("*").alias("stock_days"), F.sum(F.abs(w)).alias("weight"), F.count(F.when(F.col(score) == 0, 1)).alias("zero_days"))
    tot = t.groupBy("date", q).agg(F.sum("weight").alias("_t"))
    return t.join(tot, ["date", q]).withColumn("weight_share", F.try_divide(F.col("weight"), F.col("_t"))).drop("_t")


def zero_bias(df: DataFrame, group: str, q: str, w: str, score: str, tail: int) -> DataFrame:
    """Group share among the zero scores of a tail against the whole zero pool.

    Shares are averaged over the tail's dates with absent cells as zero; the
    division by the number of dates replaces the dense grid.
    """
    z = df.where(F.col(score) == 0)
    pool = z.groupBy("date", group).agg(F.count("*").alias("p"), F.count(F.when(F.col(q) == tail, 1)).alias("t"))
    tot = pool.groupBy("date").agg(F.sum("p").alias("_p"), F.sum("t").alias("_t")).where("_t > 0")
    n = tot.agg(F.count("*").alias("_n"))
    s = pool.join(tot, "date").groupBy(group).agg(
        F.sum("p").alias("pool_days"), F.sum("t").alias("tail_days"),
        F.sum(F.col("p") / F.col("_p")).alias("_ps"), F.sum(F.col("t") / F.col("_t")).alias("_ts"))
    return s.crossJoin(F.broadcast(n)).select(
        group, "pool_days", "tail_days", (F.col("_ps") / F.col("_n")).alias("pool_share"), (F.col("_ts") / F.col("_n")).alias("tail_share"))


def churn(df: DataFrame, score: str, q: str, xs: CrossSection) -> DataFrame:
    """Rank correlation and quintile changes against the previous calendar position."""
    d = at_offset(df.select("date", "code", "ord", score, q), {score: "_s", q: "_q"}, -1).where("_q is not null")
    ic = rank_ic(d, score, "_s", xs, out="rank_autocorrelation")
    n = d.groupBy("date").agg(
        F.count("*").alias("common"), F.count(F.when(F.col(q) != F.col("_q"), 1)).alias("changed"),
        F.try_divide(F.count(F.when((F.col(q) == 4) & (F.col("_q") == 4), 1)), F.count(F.when(F.col("_q") == 4, 1))).alias("top_retention"))
    return n.join(ic, "date", "left")


def decay_profile(df: DataFrame, state: str, origin: str, age: str, alpha: float, longest: int | None = None) -> DataFrame:
    """Observed state over its event-day value by age (up to ``longest``), beside the theoretical decay."""
    d = df.where(F.col(age) >= 0 if longest is None else F.col(age).between(0, longest)).withColumn("_r", F.try_divide(F.col(state), F.col(origin)))
    return d.groupBy(F.col(age).cast("long").alias("age")).agg(F.avg("_r").alias("observed"), F.count("*").alias("rows")).withColumn(
        "theory", F.pow(F.lit(1 - alpha), F.col("age")))


def recurrence(df: DataFrame, state: str, event: Column, alpha: float, tolerance: float = 1e-9) -> DataFrame:
    """On adjacent event-free rows a live state must shrink by exactly ``1 - alpha``."""
    w = Window.partitionBy("code", "seg").orderBy("date")
    prev = F.lag(state).over(w)
    ratio = F.try_divide(F.col(state), prev)
    ok = (F.lag("ord").over(w) == F.col("ord") - 1) & ~event & (F.abs(prev) > 1e-6)
    d = df.withColumn("_ratio", F.when(ok, ratio)).where("_ratio is not null")
    return d.agg(F.count("*").alias("pairs"), F.avg("_ratio").alias("mean_ratio"),
                 F.count(F.when(F.abs(F.col("_ratio") - (1 - alpha)) > tolerance, 1)).alias("broken"))


def assignment_difference(df: DataFrame, qa: str, wa: str, qb: str, wb: str) -> DataFrame:
    """Rows whose quintile, weight or side differs between two scores, by date."""
    return df.groupBy("date").agg(
        F.count(F.when(F.col(qa) != F.col(qb), 1)).alias("quintile_changed"),
        F.count(F.when(F.abs(F.col(wa) - F.col(wb)) > 1e-12, 1)).alias("weight_changed"),
        F.count(F.when(F.signum(wa) != F.signum(wb), 1)).alias("side_changed"),
        F.sum(F.abs(F.col(wa) - F.col(wb))).alias("weight_distance"))


def common_unique(df: DataFrame, wa: str, wb: str, target: str) -> DataFrame:
    """Split two books' gross returns into shared and unique holdings per date."""
    same = F.when(F.signum(wa) == F.signum(wb), F.signum(wa) * F.least(F.abs(wa), F.abs(wb))).otherwise(0.0)
    d = df.withColumn("_c", same)
    z = lambda e, n: F.coalesce(F.sum(e * F.col(target)), F.lit(0.0)).alias(n)
    return d.groupBy("date").agg(z(F.col("_c"), "shared"), z(F.col(wa) - F.col("_c"), "base_only"), z(F.col(wb) - F.col("_c"), "candidate_only"))


def matched_control(df: DataFrame, group_a: Column, group_b: Column, x: str, lag: int = 5) -> DataFrame:
    """Mean daily difference between two groups on dates that hold both, with a HAC t-value."""
    daily = df.groupBy("date").agg(F.avg(F.when(group_a, F.col(x))).alias("_a"), F.avg(F.when(group_b, F.col(x))).alias("_b"))
    return hac_t(daily.withColumn("diff", F.col("_a") - F.col("_b")), "diff", lag)


def lag_quality(df: DataFrame, side_state: str, origin: str, age: str, target: str, lags, xs: CrossSection) -> DataFrame:
    """Rank correlation of the entry score and of the carried state, by event age."""
    d = df.where(F.col(age).isin(list(lags))).withColumn("lag", F.col(age).cast("long"))
    out = None
    for kind, x in (("entry", origin), ("state", side_state)):
        ic = rank_ic(d, x, target, xs, ("lag", "date")).groupBy("lag").agg(
            F.avg("rankic").alias("mean_ic"), F.count("rankic").alias("days")).withColumn("kind", F.lit(kind))
        out = ic if out is None else out.unionByName(ic)
    return out


def action_follow_up(df: DataFrame, value: str, days: int = 180) -> DataFrame:
    """Does ``value`` change within ``days`` after a corporate action?

    Values change rarely, so they are reduced to their change dates; the
    interval join pairs each action with the next change of its code only.
    """
    w = Window.partitionBy("code").orderBy("date")
    d = df.withColumn("_before", F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    changed = F.col(value).isNotNull() & (F.col(value) != F.lag("_before").over(w))
    d = d.withColumn("_change", F.when(changed, F.struct("date", value)))
    back = Window.partitionBy("code").orderBy(F.col("date").desc())  # a running frame: one step per row
    d = d.withColumn("_next", F.last("_change", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    near = F.datediff(F.col("_next.date"), F.col("date")) <= days
    return d.where("factor <> 1").select("date", "code", "factor", F.col("_before").alias("before"),
                                         F.when(near, F.col(f"_next.{value}")).alias("after"))


def feature_difference(a: DataFrame, b: DataFrame, columns, keys=("date", "code")) -> DataFrame:
    """Changed rows and largest change of each feature between two builds."""
    old = agg.unpivot(a, keys, columns, "feature", "old")
    new = agg.unpivot(b, keys, columns, "feature", "new")
    j = old.join(new, [*keys, "feature"], "full")
    diff = F.abs(F.col("new") - F.col("old"))
    return j.groupBy("feature").agg(
        F.count("*").alias("rows"), F.count(F.when(~F.col("old").eqNullSafe(F.col("new")), 1)).alias("changed"),
        F.max(diff).alias("max_change"), F.avg(diff).alias("mean_change"))


def zero_order_relation(df: DataFrame, score: str, q: str, xs: CrossSection) -> DataFrame:
    """Rank correlation between code order and quintile among zero scores, per date."""
    z = xs.position(df.where(F.col(score) == 0), ["code"], "_order")
    n = z.groupBy("date").agg(F.count("*").alias("_n"))
    return rank_ic(z, "_order", q, xs, out="rho").join(n.where("_n >= 3").drop("_n"), "date").where("rho is not null")
