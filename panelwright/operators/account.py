"""Weights to daily accounts.

All sums are per-date aggregations with map-side combine; only the change of a
weight needs a window, over one code's own history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalar import col
from panelwright.operators.aggregates import unpivot
from panelwright.operators.asof import at_offset
from panelwright.operators.evaluation import rank_ic
from panelwright.operators.xsection import CrossSection

COST = 0.001
PERIODS_PER_YEAR = 252


def zero(x) -> Column:
    return F.coalesce(x, F.lit(0.0))


def weight_change(w) -> Column:
    """Absolute change of a code's weight; the first row pays its whole weight."""
    w = col(w)
    before = F.lag(w).over(Window.partitionBy("code").orderBy("date"))
    return F.coalesce(F.abs(w - before), F.abs(w))


def row_pl(df: DataFrame, w="w", dw="dw", target="target", cost: float = COST) -> DataFrame:
    """Per-row gross, cost and net; a row without label has none of them."""
    gross = F.col(w) * F.col(target)
    charge = F.when(F.col(target).isNotNull(), cost * F.col(dw))
    return df.withColumns({"gross": gross, "cost": charge, "net": gross - charge})


def daily_account(df: DataFrame, xs: CrossSection, score="score", w="w", dw="dw", q="q",
                  target="target", cost: float = COST, by=("date",)) -> DataFrame:
    """One row per date: returns, costs, turnover, sides, rank correlation and groups."""
    by = list(by)
    gross = F.col(w) * F.col(target)
    acc = df.groupBy(*by).agg(
        zero(F.sum(gross)).alias("gross"),
        zero(F.sum(gross - cost * F.col(dw))).alias("net"),
        zero(F.sum(dw)).alias("turnover"),
        zero(F.sum(F.when(F.col(w) > 0, gross))).alias("long"),
        zero(F.sum(F.when(F.col(w) < 0, gross))).alias("short"),
        F.avg(F.col(target).isNotNull().cast("double")).alias("label_coverage"),
        *[F.avg(F.when(F.col(q) == k, F.col(target))).alias(f"q{k + 1}") for k in range(5)],
    )
    acc = acc.withColumns({
        "cost_all": cost * F.col("turnover"), "cost": F.col("gross") - F.col("net"),
        "net_all_cost": F.col("gross") - cost * F.col("turnover"),
    })
    return acc.join(rank_ic(df, score, target, xs, by), by, "left")


def leg_weights(df: DataFrame, w="w") -> DataFrame:
    """Long and short sleeves with their own weight changes."""
    d = df.withColumns({"w_long": F.greatest(F.col(w), F.lit(0.0)), "w_short": F.least(F.col(w), F.lit(0.0))})
    return d.withColumns({"dw_long": weight_change("w_long"), "dw_short": weight_change("w_short")})


def leg_account(df: DataFrame, target="target", cost: float = COST, by=("date",)) -> DataFrame:
    """Gross, cost, net and turnover of each sleeve; they add up to the total."""
    valid = F.col(target).isNotNull()
    aggs = []
    for side in ("long", "short"):
        w, dw = F.col(f"w_{side}"), F.col(f"dw_{side}")
        g, c = F.sum(w * F.col(target)), F.sum(F.when(valid, cost * dw))
        aggs += [zero(g).alias(f"{side}_gross"), zero(c).alias(f"{side}_cost"),
                 (zero(g) - zero(c)).alias(f"{side}_net"), zero(F.sum(dw)).alias(f"{side}_turnover")]
    return df.groupBy(*by).agg(*aggs)


def full_account(df: DataFrame, target="target", cost: float = COST) -> DataFrame:
    """Sleeves, exposures and the split into market-wide and selection parts."""
    legs = leg_account(df, target, cost)
    valid = F.col(target).isNotNull()
    extra = df.groupBy("date").agg(
        zero(F.sum(F.abs("w"))).alias("gross_exposure"), zero(F.sum("w")).alias("net_exposure"),
        zero(F.sum(F.when(valid, F.col("w_long")))).alias("_el"),
        zero(F.sum(F.when(valid, F.col("w_short")))).alias("_es"),
        F.avg(target).alias("universe_mean"),
    )
    d = legs.join(extra, "date")
    m = zero(F.col("universe_mean"))
    return d.withColumns({
        "common": (F.col("_el") + F.col("_es")) * m,
        "selection": F.col("long_gross") + F.col("short_gross") - (F.col("_el") + F.col("_es")) * m,
    }).drop("_el", "_es")


def holding_split(df: DataFrame, xs: CrossSection, share: float) -> DataFrame:
    """Split the holding return ``t+1 open -> t+2 open`` into night and day parts.

    The day part runs open to close, the night part close to next open, their
    product is a cross term shared half each, and the market adjustment is
    charged to the night by ``share``.  The parts add up to the label.
    """
    entry = at_offset(df, {"open": "_o1", "close": "_c1"}, 1)
    exit_ = at_offset(entry, {"open": "_o2", "beta": "_b2", "mkt": "_m2"}, 2)
    day, night = F.col("_c1") / F.col("_o1") - 1, F.col("_o2") / F.col("_c1") - 1
    adjust = F.col("_b2") * F.col("_m2")
    return exit_.withColumns({
        "day_part": day + day * night / 2 - (1 - share) * adjust,
        "night_part": night + day * night / 2 - share * adjust,
        "held": F.col("_o2") / F.col("_o1") - 1 - adjust,
    }).drop("_o1", "_c1", "_o2", "_b2", "_m2")


def side_by_session(df: DataFrame) -> DataFrame:
    """Four cells (long/short x day/night) of gross return per date."""
    side = F.when(F.col("w") > 0, "long").when(F.col("w") < 0, "short")
    d = df.where("w <> 0 and held is not null").select(
        "date", side.alias("side"), (F.col("w") * F.col("day_part")).alias("day"),
        (F.col("w") * F.col("night_part")).alias("night"))
    return unpivot(d, ["date", "side"], ["day", "night"], "session", "gross").groupBy(
        "date", "side", "session").agg(F.sum("gross").alias("gross"))


def cost_stress(daily: DataFrame, bps=(5, 10, 20, 30)) -> DataFrame:
    """Annual net return, Sharpe and gross retention under other cost rates."""
    rates = F.explode(F.array(*[F.lit(b) for b in bps]))
    d = daily.withColumn("bps", rates).withColumn("_net", F.col("gross") - F.col("bps") / 10000 * F.col("turnover"))
    return d.groupBy("bps").agg(
        (F.avg("_net") * PERIODS_PER_YEAR).alias("annual_net"),
        sharpe("_net").alias("net_sharpe"),
        (F.avg("_net") / F.nullif(F.avg("gross"), F.lit(0.0))).alias("retention"),
        (F.avg("gross") / F.nullif(F.avg("turnover"), F.lit(0.0)) * 10000).alias("breakeven_bps"),
    )


def sharpe(x, ddof: int = 1, periods: int = PERIODS_PER_YEAR) -> Column:
    sd = F.stddev_samp(col(x)) if ddof == 1 else F.stddev_pop(col(x))
    return F.when(sd > 0, F.avg(col(x)) / sd * F.sqrt(F.lit(float(periods)))).otherwise(0.0)


def leave_one_year_out(daily: DataFrame) -> DataFrame:
    """Sharpe and mean of the dates outside each year.

    Built from yearly sums: everything but a year is the total minus that year.
    """
    y = daily.groupBy(F.year("date").cast("long").alias("year")).agg(
        F.count("net").alias("_n"), F.sum("net").alias("_s"), F.sum(F.col("net") * F.col("net")).alias("_ss"))
    everything = Window.partitionBy(F.lit(0))
    for c in ("_n", "_s", "_ss"):
        y = y.withColumn(f"{c}x", F.sum(c).over(everything) - F.col(c))
    mean = F.col("_sx") / F.col("_nx")
    var = (F.col("_ssx") - F.col("_nx") * mean * mean) / (F.col("_nx") - 1)
    return y.select(F.col("year").alias("excluded"), F.col("_nx").alias("days"),
                    (mean * PERIODS_PER_YEAR).alias("annual_net"),
                    (mean / F.sqrt(var) * F.sqrt(F.lit(float(PERIODS_PER_YEAR)))).alias("net_sharpe"))


def align_prediction(labels: DataFrame, prediction: DataFrame, score: str = "score") -> DataFrame:
    """Check the prediction contract, then attach scores to the label rows."""
    bad = prediction.groupBy("date", "code").agg(
        F.count("*").alias("_n"), F.count(F.when(~(F.abs(score) < float("inf")) | F.isnan(score) | F.col(score).isNull(), 1)).alias("_x")
    ).where("_n > 1 or _x > 0")
    missing = labels.join(prediction, ["date", "code"], "left_anti")
    problems = bad.select(F.lit("duplicate or non-finite").alias("why")).union(
        missing.select(F.lit("label row without prediction"))).limit(1).collect()
    if problems:
        raise ValueError(problems[0].why)
    return labels.join(prediction, ["date", "code"])
