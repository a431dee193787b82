"""Feature compositions: panel in, panel with feature columns out.

Only windows over (code, seg), statistics over date and row arithmetic are
used.  History windows come first and ranks last, so that a feature set needs
one layout by code and one by date.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalar import all_present, clip, finite, positive, ratio
from panelwright.operators import timeseries as ts
from panelwright.operators.xsection import CrossSection

RESIDUAL_WINDOWS = (5, 10, 20, 60)


def relative_strength(df: DataFrame, xs: CrossSection, window: int, skip: int = 1, x: str = "resid",
                      out: str | None = None) -> DataFrame:
    """Centered rank of a lagged rolling sum of residual returns."""
    out = out or f"res{window}s{skip}"
    d = df.withColumn(f"{out}_sum", ts.roll_sum(x, window, skip=skip))
    return xs.centered_rank(d, f"{out}_sum", out)


def momentum_family(df: DataFrame, xs: CrossSection, windows=RESIDUAL_WINDOWS, mid: int = 20) -> DataFrame:
    """Residual momentum by window and skip, unadjusted and sector-neutral variants, and their mean."""
    d = xs.demean(df, "resid", "_sector_resid", ("date", "sector17"))
    specs = [(f"res{w}s1", "resid", w, 1) for w in windows]
    specs += [(f"res{mid}s0", "resid", mid, 0), (f"res{mid}s2", "resid", mid, 2),
              (f"raw{mid}s1", "ret", mid, 1), (f"sector{mid}s1", "_sector_resid", mid, 1)]
    d = d.withColumns({f"{name}_sum": ts.roll_sum(x, w, skip=s) for name, x, w, s in specs})
    for name, *_ in specs:
        d = xs.centered_rank(d, f"{name}_sum", name)
    three = [f"res{w}s1" for w in (windows[0], windows[2], windows[3])]
    return d.withColumn("equal_mean", (F.col(three[0]) + F.col(three[1]) + F.col(three[2])) / 3).drop("_sector_resid")


def liquidity_state(df: DataFrame, window: int = 60, short: int = 5) -> DataFrame:
    """Log median turnover, its short-run shock and the volume shock."""
    d = df.withColumns({"_v": positive("turnover"), "_q": positive("volume")})
    long_med = ts.roll_median("_v", window)
    return d.withColumns({
        "liq_level": F.log(long_med),
        "liq_shock": F.log(ratio(ts.roll_median("_v", short), long_med)),
        "vol_shock": F.log(ratio(F.col("_q"), ts.roll_median("_q", window))),
    }).drop("_v", "_q")


def impact_inputs(df: DataFrame, window: int = 60, short: int = 5) -> DataFrame:
    """Observed |residual| and yesterday's state that explains it."""
    d = liquidity_state(df, window, short)
    d = d.withColumn("_volat", ts.roll_std("resid", window))
    return d.withColumns({
        "observed": F.abs("resid"),
        "historical": ts.roll_mean(F.abs("resid"), window, skip=1),
        "x_value": ts.shift(F.log(positive("turnover"))), "x_liquidity": ts.shift("liq_level"),
        "x_volume": ts.shift("vol_shock"), "x_volatility": ts.shift(F.log(positive("_volat"))),
        "x_size": ts.shift("size"),
    }).drop("_volat")


IMPACT_INPUTS = ["x_value", "x_liquidity", "x_volume", "x_volatility", "x_size"]


def impact_ranks(df: DataFrame, xs: CrossSection, expected: str, suffix: str = "") -> DataFrame:
    """Ranks of price moves above (pwv) and below (vwp) what the state explains."""
    gap = F.col("observed") - F.col(expected)
    d = df.withColumns({"_up": clip(gap, lo=0), "_down": clip(-gap, lo=0)})
    d = xs.centered_rank(d, "_up", f"pwv{suffix}")
    return xs.centered_rank(d, "_down", f"vwp{suffix}").drop("_up", "_down")


def intraday(df: DataFrame) -> DataFrame:
    """Morning and afternoon returns, range and volume ratio."""
    return df.withColumns({
        "am_ret": ratio("am_close", positive("am_open")) - 1,
        "pm_ret": ratio("pm_close", positive("pm_open")) - 1,
        "range_ratio": ratio(F.col("high") - F.col("low"), positive("open")),
        "volume_log_ratio": F.log(ratio(positive("pm_volume"), positive("am_volume"))),
    })


def interactions(df: DataFrame, m: str = "mom") -> DataFrame:
    """Momentum times state, and volume-without-price times the intraday drift."""
    return df.withColumns({
        "m_pwv": F.col(m) * F.col("pwv"), "m_vwp": F.col(m) * F.col("vwp"),
        "m_liq": F.col(m) * F.col("liq"), "m_vol": F.col(m) * F.col("vol"),
        "vwp_intraday": F.col("vwp") * (F.col("pm") - F.col("am")),
    })


def split_safe(df: DataFrame) -> DataFrame:
    """Prices over, volume times the cumulative corporate-action factor of the segment."""
    bad = F.col("factor").isNull() | ~(finite("factor") > 0)
    factor = F.when(bad, F.raise_error(F.lit("corporate-action factor must be finite and positive"))).otherwise(
        F.when(F.abs(F.col("factor") - 1) <= 2e-12, F.lit(1.0)).otherwise(F.col("factor")))
    d = df.withColumn("_f", factor.cast("double"))
    d = d.withColumn("cum_factor", ts.cumulative(F.product, "_f"))
    return d.withColumns({
        **{f"s_{c}": positive(c) / F.col("cum_factor") for c in ("open", "high", "low", "close")},
        "s_volume": positive("volume") * F.col("cum_factor"),
    }).drop("_f")


def high_proximity(df: DataFrame, windows: dict[str, tuple[int, int]], close="close", high="high") -> DataFrame:
    """Close over its trailing high for several (window, minimum history) pairs."""
    return df.withColumns({
        name: ratio(positive(close), ts.roll_max(positive(high), w, need)) for name, (w, need) in windows.items()})


def breakout(df: DataFrame, window: int = 250) -> DataFrame:
    """Excess over the prior high / under the prior low, with availability flags."""
    d = df.withColumns({"prior_high": ts.roll_max("s_high", window, skip=1), "prior_low": ts.roll_min("s_low", window, skip=1)})
    return d.withColumns({
        "new_high_excess": clip(ratio("s_close", "prior_high") - 1, lo=0),
        "new_low_excess": clip(ratio("prior_low", "s_close") - 1, lo=0),
        "high_available": all_present("prior_high", "s_close"),
        "low_available": all_present("prior_low", "s_close"),
    })


def true_range(df: DataFrame, window: int = 20, legacy: bool = False) -> DataFrame:
    """True range and its prior mean on split-safe prices.

    ``legacy`` divides the previous close once more by the date's own factor,
    to replay scores that were stored with that definition.
    """
    prev = ts.shift("s_close")
    d = df.withColumn("_prev", prev / F.col("factor") if legacy else prev)
    parts = [F.col("s_high") - F.col("s_low"), F.abs(F.col("s_high") - F.col("_prev")), F.abs(F.col("s_low") - F.col("_prev"))]
    d = d.withColumn("tr", F.when(all_present("s_high", "s_low", "_prev"), F.greatest(*parts)))
    return d.withColumn("atr", ts.roll_mean("tr", window, skip=1)).drop("_prev")


def boxes(df: DataFrame, longest: int = 120, step: int = 5, limit: float = 3.0, skip: int = 1, root: bool = False) -> DataFrame:
    """Longest look-back whose high-low range stays below ``limit`` ATRs.

    Every look-back is a multiple of ``step``: extremes of ``step``-row blocks
    are computed once and combined from lagged blocks, so the cost does not
    grow with the sum of all window lengths.  The range widens with the
    look-back, but the ``root`` variant divides by sqrt(length), so the longest
    qualifying one is searched explicitly.
    """
    k = longest // step
    d = df.withColumn("_row", ts.row_in_segment())
    gap = F.when(F.col("s_high").isNull() | F.col("s_low").isNull(), F.col("_row"))
    past = ts.history().rowsBetween(ts.UNBOUNDED, -skip)
    d = d.withColumns({
        "_run": F.col("_row") - skip - F.coalesce(F.max(gap).over(past), F.lit(0)),
        "_bh": F.max("s_high").over(ts.trailing(step, skip)), "_bl": F.min("s_low").over(ts.trailing(step, skip)),
    })
    w = ts.history()
    d = d.withColumns({f"_{side}{i}": F.lag(f"_b{side}", step * i).over(w) for side in "hl" for i in range(k)})
    for i in range(1, k):  # running extremes; one projection each, so nothing is computed twice
        d = d.withColumns({f"_h{i}": F.greatest(f"_h{i - 1}", f"_h{i}"), f"_l{i}": F.least(f"_l{i - 1}", f"_l{i}")})
    d = d.withColumns({f"_w{i}": F.try_divide(
        F.col(f"_h{i}") - F.col(f"_l{i}"), F.col("atr") * (math.sqrt((i + 1) * step) if root else 1.0)) for i in range(k)})
    box = F.coalesce(*[
        F.when((F.col("_run") >= (i + 1) * step) & (F.col(f"_w{i}") < limit),
               F.struct(F.lit(float((i + 1) * step)).alias("length"), F.col(f"_w{i}").alias("width"),
                        F.col(f"_h{i}").alias("upper"), F.col(f"_l{i}").alias("lower")))
        for i in reversed(range(k))])
    d = d.withColumn("_box", box)
    return d.withColumns({
        "box_duration": F.coalesce(F.col("_box.length"), F.lit(0.0)),
        "box_width": F.col("_box.width"), "box_upper": F.col("_box.upper"), "box_lower": F.col("_box.lower"),
    }).drop("_row", "_run", "_bh", "_bl", "_box", *[f"_{c}{i}" for c in "hlw" for i in range(k)])


def box_position(df: DataFrame, window: int = 250) -> DataFrame:
    """Yesterday's close inside the box and its distance to earlier extremes."""
    prev = ts.shift("s_close")
    d = df.withColumns({"_prev": prev, "_ph": ts.roll_max("s_high", window, skip=2), "_pl": ts.roll_min("s_low", window, skip=2)})
    width = F.col("box_upper") - F.col("box_lower")
    return d.withColumns({
        "close_position": F.when(width > 0, (F.col("_prev") - F.col("box_lower")) / width),
        "distance_to_high": ratio("_prev", "_ph") - 1, "distance_to_low": ratio("_pl", "_prev") - 1,
    }).drop("_prev", "_ph", "_pl")


def channel_position(df: DataFrame, window: int = 250) -> DataFrame:
    """Previous close in its trailing channel, scaled to -1 .. 1 but not bounded."""
    hi, lo = ts.roll_max("s_high", window, skip=1), ts.roll_min("s_low", window, skip=1)
    d = df.withColumns({"_h": hi, "_l": lo, "_c": ts.shift("s_close")})
    return d.withColumn("channel", 2 * ratio(F.col("_c") - F.col("_l"), F.col("_h") - F.col("_l")) - 1).drop("_h", "_l", "_c")


def volume_features(df: DataFrame, window: int = 60, base: int = 20) -> DataFrame:
    """One-day change, z-score of the previous volume and change against a prior median."""
    d = df.withColumns({
        "volume_change": ratio("s_volume", ts.shift("s_volume")) - 1,
        "_m": ts.roll_mean("s_volume", window, skip=2), "_s": ts.roll_std("s_volume", window, skip=2, ddof=0),
        "_pv": ts.shift("s_volume"),
        "relative_volume": F.log(ratio("s_volume", ts.roll_median("s_volume", base, skip=1))),
    })
    return d.withColumn("volume_z", ratio(F.col("_pv") - F.col("_m"), F.col("_s"))).drop("_m", "_s", "_pv")


def price_slope(df: DataFrame, window: int = 60) -> DataFrame:
    """Slope of the log price in basis points per row."""
    d = df.withColumns({"_row": ts.row_in_segment().cast("double"), "_lp": F.log("s_close")})
    return d.withColumn("slope_bps", ts.rolling_slope("_lp", window) * 10000).drop("_row", "_lp")


def illiquidity(df: DataFrame, xs: CrossSection, window: int = 60, need: int = 40) -> DataFrame:
    """Mean of |return| over turnover per code (across relistings) and its z-score."""
    d = df.withColumn("_i", F.abs("ret") / positive("turnover"))
    d = d.withColumn("illiquidity", ts.roll_mean("_i", window, need, keys=("code",)))
    return xs.zscore(d, "illiquidity", "illiquidity_z").drop("_i")


def lottery(df: DataFrame, window: int = 20) -> DataFrame:
    """Largest and dispersion of lagged residual returns."""
    return df.withColumns({"max_resid": ts.roll_max("resid", window, skip=1), "idio_vol": ts.roll_std("resid", window, skip=1)})


def recent_crash(df: DataFrame, xs: CrossSection, window: int = 5, cut: float = 0.2) -> DataFrame:
    """Rows in the lowest fifth of the recent residual sum."""
    d = df.withColumn("_s", ts.roll_sum("resid", window, skip=1))
    d = xs.pct_rank(d, "_s", "_p", missing=0)
    return d.withColumn("crash", (F.col("_s").isNotNull() & (F.col("_p") <= cut)).cast("int")).drop("_s", "_p")


def regime_weight(series: DataFrame, x: str, window: int = 750, need: int = 250, bound: float = 2.0) -> DataFrame:
    """Counter-cyclical weight from a rolling z-score of a date-only series."""
    from pyspark.sql import Window

    f = Window.orderBy("date").rowsBetween(-(window - 1), 0)
    z = F.when(F.count(x).over(f) >= need, F.try_divide(F.col(x) - F.avg(x).over(f), F.stddev_samp(x).over(f)))
    d = series.withColumn("_z", z)
    return d.withColumn("regime", clip(-clip("_z", -bound, bound) / 2, -1, 1)).drop("_z")


def information_vectors(df: DataFrame, columns: dict[str, str], length: int = 21) -> DataFrame:
    """Chronological and ascending vectors of the last rows of each column."""
    d = df.withColumns({f"{name}_time": ts.lag_vector(x, length) for name, x in columns.items()})
    return d.withColumns({f"{name}_sorted": F.array_sort(f"{name}_time") for name in columns})


def abnormal_turnover(df: DataFrame, rate: str, window: int = 60, eps: float = 1e-12) -> DataFrame:
    """Turnover against its own strictly prior median, signed and conditioned by the residual."""
    d = df.withColumn("log_rate", F.log(F.col(rate) + eps))
    d = d.withColumn("abnormal", F.col("log_rate") - ts.roll_median("log_rate", window, skip=1))
    a, r = F.col("abnormal"), F.col("resid")
    return d.withColumns({
        "signed_abnormal": a * F.signum(r),
        "up_abnormal": F.when(r.isNotNull(), F.when(r > 0, a).otherwise(0.0)),
        "down_abnormal": F.when(r.isNotNull(), F.when(r < 0, a).otherwise(0.0)),
        "conditioned_abnormal": a * r,
    })


def intraday_momentum(df: DataFrame, xs: CrossSection, window: int = 60, alpha: float = 0.25) -> DataFrame:
    """Negated smooth of the ranked sum of open-to-close returns."""
    d = df.withColumn("_oc", ratio(positive("close"), positive("open")) - 1)
    d = d.withColumn("day_sum", ts.roll_sum("_oc", window))
    d = xs.pct_rank(d, "day_sum", "_p")
    d = d.withColumn("day_rank", F.coalesce(2 * F.col("_p") - 1, F.lit(0.0)))
    d = ts.ewma(d, "day_rank", alpha, "_y")
    return d.withColumn("intraday_risk", -F.col("_y")).drop("_oc", "_p", "_y")


def directional(df: DataFrame, side: str) -> DataFrame:
    """Event inputs oriented so that larger means closer to continuation."""
    high = side == "high"
    event = F.col(f"{side}_available") & (F.col(f"new_{side}_excess") > 0)
    return df.withColumns({
        "event": F.coalesce(event, F.lit(False)),
        "o_duration": F.col("box_duration"), "o_width": F.col("box_width"),
        "o_position": F.col("close_position") if high else 1 - F.col("close_position"),
        "o_strength": F.col("strength") if high else -F.col("strength"),
        "o_distance": F.col("distance_to_high") if high else F.col("distance_to_low"),
    })


def eligible_box(df: DataFrame, limit: float = 3.0) -> DataFrame:
    return df.withColumn("eligible", (F.col("box_duration") > 0) & F.coalesce(F.col("box_width") < limit, F.lit(False)))


#: Ratios of a factor block: each is standardised per date, the sum is filled and standardised again.
BLOCKS = {
    "quality": ("cfo_assets", "profit_equity", "equity_ratio"),
    "value": ("book_price", "forecast_price"),
}


def factor_blocks(df: DataFrame, xs: CrossSection, window: int = 60, need: int = 40) -> DataFrame:
    """Size and liquidity, quality and value blocks and their sum ``factor_score``.

    Needs the as-of fields cfo, assets, profit, equity, shares and forecast_eps
    beside close, ret, turnover and size.  A ratio that is missing makes its
    block's sum missing; sums are filled with the date's median, then 0.
    """
    cap = F.col("close") * positive("shares")
    f = history_by_code().rowsBetween(-(window - 1), 0)
    day = ratio(F.abs("ret"), positive("turnover"))
    d = df.withColumns({
        "_cap": F.when(cap > 0, -F.log(cap)), "_band": -F.col("size"),
        "_illiquid": F.when(F.count(day).over(f) >= need, F.avg(day).over(f)),
        "cfo_assets": ratio("cfo", "assets"), "profit_equity": ratio("profit", "equity"), "equity_ratio": ratio("equity", "assets"),
        "book_price": ratio(ratio("equity", positive("shares")), "close"), "forecast_price": ratio("forecast_eps", "close"),
    })
    for c in ("_cap", "_band", "_illiquid", *BLOCKS["quality"], *BLOCKS["value"]):
        d = xs.zscore(d, c, f"{c}_z")
    d = d.withColumn("_size", F.coalesce("_cap_z", "_band_z"))
    for name, ratios in BLOCKS.items():
        d = d.withColumn(f"_{name}", sum((F.col(f"{r}_z") for r in ratios[1:]), F.col(f"{ratios[0]}_z")))
    for c in ("_size", "_illiquid_z", "_quality", "_value"):
        d = xs.fill_median(d, c, f"{c}_f")
    d = d.withColumn("_sl", F.col("_size_f") + F.col("_illiquid_z_f"))
    for src, out in (("_sl", "block_size_liquidity"), ("_quality_f", "block_quality"), ("_value_f", "block_value")):
        d = xs.zscore(d, src, out)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    d = d.withColumn("factor_score", z("block_size_liquidity") + z("block_quality") + z("block_value"))
    return d.drop(*[c for c in d.columns if c not in df.columns and (c.startswith("_") or c.endswith("_z"))])


def history_by_code():
    return ts.history(("code",))


def risk_composites(d: DataFrame, xs: CrossSection, profits=("op", "ordinary", "profit"), balances=("equity", "cash"), keep=()) -> DataFrame:
    """Profit, balance and overall risk of metric columns (``<metric>_value, <metric>_yoy, <metric>_period``) and ``fd_equal``.

    Falling profits are ranked among reports of the same period, low balances
    among all; a missing one is neutral.  All ranks share one layout by date.
    """
    for k in profits:
        d = xs.pct_rank(d.withColumn("_x", -F.col(f"{k}_yoy")), "_x", f"_p_{k}", ("date", f"{k}_period"), 0.5)
    for k in balances:
        d = xs.pct_rank(d.withColumn("_x", -F.col(f"{k}_value")), "_x", f"_p_{k}", missing=0.5)
    mean = lambda names: reduce(lambda a, b: a + b, [F.col(f"_p_{k}") for k in names]) / len(names)
    d = d.select("date", "code", *keep, "fd_equal", mean(profits).alias("profit_risk"), mean(balances).alias("balance_risk"))
    return d.withColumn("multi_risk", (F.col("fd_equal") + F.col("profit_risk") + F.col("balance_risk")) / 3)