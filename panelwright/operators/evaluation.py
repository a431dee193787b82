"""Statistics of scores and daily accounts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalar import col, normal_cdf, normal_quantile
from panelwright.operators import aggregates as agg
from panelwright.operators.asof import at_offset
from panelwright.operators.xsection import CrossSection

UNBOUNDED = Window.unboundedPreceding


def rank_ic(df: DataFrame, score: str, target: str, xs: CrossSection, by=("date",), out="rankic") -> DataFrame:
    """Spearman correlation per group on the rows where both values are present."""
    by = list(by)
    d = df.select(*by, F.col(score).alias("_x"), F.col(target).alias("_y")).where("_x is not null and _y is not null")
    d = xs.average_rank(xs.average_rank(d, "_x", "_rx", by), "_y", "_ry", by)
    return d.groupBy(*by).agg(agg.correlation("_rx", "_ry").alias(out))


def hac_t(daily: DataFrame, x: str, lag: int = 5, by=()) -> DataFrame:
    """Mean over its Bartlett-weighted long-run standard error, per series.

    ``daily`` has one row per date, so the ordered windows stay bounded.
    """
    keys = list(by)
    part = keys or [F.lit(0)]
    d = daily.where(F.col(x).isNotNull())
    d = d.withColumn("_e", F.col(x) - F.avg(x).over(Window.partitionBy(*part)))
    w = Window.partitionBy(*part).orderBy("date")
    prods = {f"_p{k}": F.col("_e") * F.lag("_e", k).over(w) for k in range(1, lag + 1)}
    d = d.withColumns(prods)
    n = F.count(x)
    var = F.sum(F.col("_e") * F.col("_e"))
    for k in range(1, lag + 1):
        var = var + 2 * (1 - k / (lag + 1)) * F.coalesce(F.sum(f"_p{k}"), F.lit(0.0))
    var = F.greatest(var / n, F.lit(1e-30))
    t = F.when(n >= 3, F.avg(x) / F.sqrt(var / n))
    g = d.groupBy(*keys) if keys else d.groupBy()
    return g.agg(n.alias("days"), F.avg(x).alias("mean"), t.alias("t_hac"))


def five_point_spearman(columns) -> Column:
    """Rank correlation of five group means with their order 1..5 (average ranks)."""
    a = [col(c) for c in columns]
    ranks = []
    for x in a:
        below = sum((F.when(y < x, 1.0).otherwise(0.0) for y in a), F.lit(0.0))
        same = sum((F.when(y == x, 1.0).otherwise(0.0) for y in a), F.lit(0.0))
        ranks.append(below + (same + 1) / 2)
    sxy = sum(((k - 2) * (r - 3) for k, r in enumerate(ranks)), F.lit(0.0))
    syy = sum(((r - 3) * (r - 3) for r in ranks), F.lit(0.0))
    return F.when(syy > 0, sxy / F.sqrt(10 * syy)).otherwise(0.0)


def metric_bundle(daily: DataFrame, by=(), periods: int = 252) -> DataFrame:
    """Annual returns, Sharpe ratios, rank correlation, drawdowns and group shape."""
    from panelwright.operators.account import sharpe

    keys = list(by)
    d = agg.drawdowns(daily, "net", keys)
    g = d.groupBy(*keys) if keys else d.groupBy()
    m = g.agg(
        F.count("*").alias("days"), sharpe("gross").alias("gross_sharpe"), sharpe("net").alias("net_sharpe"),
        sharpe("net_all_cost").alias("net_all_cost_sharpe"), F.avg("rankic").alias("rankic"),
        F.avg(F.when(F.col("rankic").isNotNull(), (F.col("rankic") > 0).cast("double"))).alias("rankic_hit"),
        *[(F.avg(c) * periods).alias(f"annual_{c}") for c in ("gross", "net", "cost", "long", "short")],
        F.avg("turnover").alias("turnover"), F.min("dd_additive").alias("max_drawdown_additive"),
        F.min("dd_compound").alias("max_drawdown_compound"), F.avg("label_coverage").alias("label_coverage"),
        *[F.avg(f"q{k}").alias(f"q{k}_mean") for k in range(1, 6)],
    )
    m = m.withColumn("q_monotonicity", five_point_spearman([f"q{k}_mean" for k in range(1, 6)]))
    t = hac_t(daily, "rankic", 5, keys).select(*keys, F.col("t_hac").alias("rankic_t_hac5"))
    return m.join(t, keys, "left") if keys else m.crossJoin(t)


def group_spread(df: DataFrame, q: str, target: str, by=("date",), min_rows: int = 5) -> DataFrame:
    """Top minus bottom group mean of the target, on dates with enough rows."""
    n = F.count(target)
    return df.groupBy(*by).agg(
        F.when(n >= min_rows, F.avg(F.when(F.col(q) == 4, F.col(target))) - F.avg(F.when(F.col(q) == 0, F.col(target)))
               ).alias("spread"), n.alias("rows"))


def bootstrap_paired(daily: DataFrame, base: str, other: str, reps: int = 1000, block: int = 20, seed: int = 104729,
                     periods: int = 252) -> DataFrame:
    """Circular block bootstrap of the difference in Sharpe ratio and annual return.

    Block starts come from a keyed hash.  The replicate plan is generated on the
    executors and joined to the dated series, which is bounded by the calendar.
    """
    w = Window.orderBy("date")
    series = daily.select((F.row_number().over(w) - 1).cast("long").alias("i"),
                          F.col(base).alias("a"), F.col(other).alias("b"))
    size = daily.agg(F.count("*").alias("n"))
    spark = daily.sparkSession
    plan = spark.range(reps).withColumnRenamed("id", "rep").crossJoin(F.broadcast(size))
    plan = plan.withColumn("blk", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) - 1).cast("int"))))
    word = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "rep", "blk")), 1, 8), 16, 10).cast("long")
    plan = plan.withColumn("start", word % F.col("n")).withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    plan = plan.where(F.col("blk") * block + F.col("off") < F.col("n"))
    draws = plan.select("rep", ((F.col("start") + F.col("off")) % F.col("n")).alias("i")).join(series, "i")
    root = F.sqrt(F.lit(float(periods)))
    per = draws.groupBy("rep").agg(
        (root * (F.try_divide(F.avg("b"), F.stddev_samp("b")) - F.try_divide(F.avg("a"), F.stddev_samp("a")))).alias("d_sharpe"),
        (periods * (F.avg("b") - F.avg("a"))).alias("d_annual"))
    qs = {"low": 0.025, "high": 0.975}
    return per.agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{k}") for c in ("d_sharpe", "d_annual") for k, q in qs.items()],
                   F.avg((F.col("d_sharpe") > 0).cast("double")).alias("positive_fraction"), F.count("*").alias("reps"))


def deflated_sharpe(daily: DataFrame, x: str, variance, trials, by=()) -> DataFrame:
    """Probability that the Sharpe ratio of a series beats the best of ``trials`` null trials.

    ``variance`` (of Sharpe ratios over the trials) and ``trials`` are numbers
    or columns; one aggregate of moments per series, the normal distribution as
    columns.
    """
    number = lambda v: F.lit(float(v)) if isinstance(v, (int, float)) else col(v)
    one, many = number(variance), number(trials)
    gamma = 0.5772156649015329  # Euler's constant
    d = daily.groupBy(*by).agg((F.avg(x) / F.stddev_samp(x)).alias("daily_sr"), *agg.moments(x), F.max(one).alias("_variance"), F.max(many).alias("_trials"))
    many = F.col("_trials")
    highest = (1 - gamma) * normal_quantile(1 - 1 / many) + gamma * normal_quantile(1 - 1 / (many * math.e))
    d = d.withColumn("threshold", F.sqrt(F.greatest(F.col("_variance"), F.lit(0.0))) * highest)
    sr = F.col("daily_sr")
    spread = F.sqrt(F.greatest(1 - F.col("skew") * sr + (F.col("kurtosis") - 1) * sr * sr / 4, F.lit(1e-30)))
    dsr = normal_cdf((sr - F.col("threshold")) * F.sqrt(F.col("n") - 1) / spread)
    return d.select(*by, dsr.alias("dsr"), "daily_sr", "threshold", "n", "skew", "kurtosis")


def fold_deltas(metrics: DataFrame, reference: str, key="strategy", fold="year", value="net_sharpe") -> DataFrame:
    """Candidates against a reference: improved folds, median and worst difference."""
    ref = metrics.where(F.col(key) == reference).select(fold, F.col(value).alias("_ref"))
    d = metrics.where(F.col(key) != reference).join(ref, fold).withColumn("_d", F.col(value) - F.col("_ref"))
    return d.groupBy(key).agg(
        F.count("*").alias("folds"), F.count(F.when(F.col("_d") > 0, 1)).alias("improved"),
        F.percentile("_d", F.lit(0.5)).alias("median_delta"), F.min("_d").alias("worst_delta"))


def decide(candidates: DataFrame, rules: dict[str, Column], order) -> DataFrame:
    """Evaluate preregistered rules and mark the first accepted candidate in ``order``."""
    d = candidates.withColumns(rules)
    accepted = F.lit(True)
    for name in rules:
        accepted = accepted & F.coalesce(F.col(name), F.lit(False))
    d = d.withColumn("accepted", accepted)
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("accepted").desc(), *order)
    return d.withColumn("selected", F.col("accepted") & (F.row_number().over(w) == 1))


def conditional_ic(df: DataFrame, states: dict[str, Column], score: str, target: str, xs: CrossSection) -> DataFrame:
    """Mean daily rank correlation and signed target of every state and year.

    Each row is exploded into the states it satisfies, so one pass serves all.
    """
    tags = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in states.items()]), lambda t: t.isNotNull())
    d = df.withColumn("state", F.explode(tags))
    ic = rank_ic(d, score, target, xs, ("date", "state"))
    signed = d.groupBy("date", "state").agg(F.avg(F.signum(score) * F.col(target)).alias("signed"), F.count("*").alias("n"))
    return signed.join(ic, ["date", "state"], "left").groupBy("state", F.year("date").cast("long").alias("year")).agg(
        F.avg("rankic").alias("rankic"), F.avg("signed").alias("signed_target"), F.sum("n").alias("rows"))


def event_quintiles(df: DataFrame, score: str, target: str, xs: CrossSection, least: int = 5) -> DataFrame:
    """Mean target per date and fifth of the score's average rank, on dates with enough rows and distinct scores."""
    d = xs.average_rank(df, score, "_r")
    d = xs.attach(d, _n=F.count(F.lit(1)))
    values = df.groupBy("date", score).agg(F.lit(1).alias("_one")).groupBy("date").agg(F.count(F.lit(1)).alias("_u")).where(F.col("_u") >= least)
    d = d.where(F.col("_n") >= least).join(values, "date", "left_semi")
    q = F.least(F.lit(4), F.floor(5 * (F.col("_r") - 1) / (F.col("_n") - 1)))
    return d.groupBy("date", q.alias("q5")).agg(F.count(F.lit(1)).alias("rows"), F.avg(target).alias("mean_target"))


def lag_persistence(df: DataFrame, x: str, lags, xs: CrossSection) -> DataFrame:
    """Daily rank correlation of a factor with its own value ``k`` positions earlier.

    All lags are frames over the same layout and are ranked side by side.
    """
    d = df.select("date", "code", "ord", x)
    for k in lags:
        d = at_offset(d, {x: f"_past_{k}"}, -k)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_past_{k}").alias("past")) for k in lags])).alias("_p")
    d = d.where(F.col(x).isNotNull()).select("date", x, pairs).where("_p.past is not null").select("date", x, "_p.lag", "_p.past")
    out = rank_ic(d, x, "past", xs, by=("lag", "date"))
    return out.groupBy("lag").agg(F.avg("rankic").alias("mean_ic"), F.count("rankic").alias("days"))
