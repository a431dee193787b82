"""Scores built from features: blends, toggles, stitching and event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalar import clip, col
from panelwright.operators import timeseries as ts
from panelwright.operators.xsection import CrossSection

HIGH_ALPHA, LOW_ALPHA = 0.25, 0.5


def smooth_all(df: DataFrame, columns, alpha: float = 0.25) -> DataFrame:
    """Replace several raw scores by their smooths."""
    d = df
    for c in columns:
        d = ts.ewma(d, c, alpha, f"_y_{c}").drop(c).withColumnRenamed(f"_y_{c}", c)
    return d


# Weights of momentum, the proximities over the short, middle and long
# range, the split-safe proximity, and momentum times middle proximity.
BLENDS = {
    "momentum": (1, 0, 0, 0, 0, 0),
    "middle": (0, 0, 1, 0, 0, 0),
    "long": (0, 0, 0, 1, 0, 0),
    "even_short": (0.5, 0.5, 0, 0, 0, 0),
    "even_middle": (0.5, 0, 0.5, 0, 0, 0),
    "even_long": (0.5, 0, 0, 0.5, 0, 0),
    "even_safe": (0.5, 0, 0, 0, 0.5, 0),
    "tilt": (1, 0, 0.25, 0, 0, 0),
    "product": (1, 0, 0, 0, 0, 0.5),
    "three": (0.5, 0, 0.25, 0.25, 0, 0),
}


def blends(m: str, short: str, mid: str, long: str, safe: str) -> dict[str, Column]:
    """Weighted sums of momentum and high proximities, one per row of ``BLENDS``."""
    inputs = [F.col(m), F.col(short), F.col(mid), F.col(long), F.col(safe), F.col(m) * F.col(mid)]
    total = lambda ws: sum((w * x for w, x in zip(ws, inputs) if w), F.lit(0.0))
    return {name: total(ws) for name, ws in BLENDS.items()}


def is_event(side: str) -> Column:
    return F.coalesce(F.col(f"{side}_available") & (F.col(f"new_{side}_excess") > 0), F.lit(False))


def one_sided(first: Column, second: Column, side: str, when: Column) -> Column:
    """Mean of two scores cut at zero to the side's sign where ``when`` holds, else NULL."""
    mean = (first + second) / 2
    return F.when(when, clip(mean, lo=0) if side == "high" else clip(mean, hi=0))


def sided_momentum(m: str, high_rank: str, low_rank: str) -> dict[str, Column]:
    """Momentum with a side's breakout rank mixed in where momentum points to that side."""
    x = F.col(m)
    high = one_sided(x, F.col(high_rank), "high", (x > 0) & F.col("high_available"))
    low = one_sided(x, -F.col(low_rank), "low", (x < 0) & F.col("low_available"))
    return {"high": F.coalesce(high, x), "low": F.coalesce(low, x), "both": F.coalesce(high, low, x)}


def event_percentiles(df: DataFrame, xs: CrossSection) -> DataFrame:
    """``high_pct`` and ``low_pct`` of the rows with an event, ranked among their date's events of the side."""
    d = df.select("date", "code", *[F.when(is_event(side), F.col(f"new_{side}_excess")).alias(f"_{side}") for side in ("high", "low")])
    d = d.where("_high is not null or _low is not null")
    for side in ("high", "low"):
        d = xs.active_percentile(d, f"_{side}", F.col(f"_{side}").isNotNull(), f"{side}_pct")
    return d.drop("_high", "_low")


def side_streams(df: DataFrame, stable) -> DataFrame:
    """``raw``: high less low percentile of today's breakouts (zero without), its two parts and their events."""
    pct = lambda side: F.coalesce(F.col(f"{side}_pct"), F.lit(0.0))
    d = df.withColumn("raw", stable(pct("high") - pct("low")))
    d = d.withColumns({"high_raw": clip("raw", lo=0), "low_raw": clip("raw", hi=0)})
    return d.withColumns({"high_event": F.col("high_raw") > 0, "low_event": F.col("low_raw") < 0})


def mixed_breakouts(df: DataFrame, m: str) -> DataFrame:
    """``breakout``: high less low percentile of today's breakouts (zero without); ``breakout_<side>``
    with momentum mixed into that side's events."""
    d, plain, mixed = df.withColumns({f"{side}_pct": F.coalesce(f"{side}_pct", F.lit(0.0)) for side in ("high", "low")}), {}, {}
    for side, sign in (("high", 1), ("low", -1)):
        plain[side] = sign * F.col(f"{side}_pct")
        mixed[side] = F.coalesce(one_sided(plain[side], F.col(m), side, is_event(side)), plain[side])
    return d.withColumns({
        "breakout": plain["high"] + plain["low"], "breakout_high": mixed["high"] + plain["low"],
        "breakout_low": plain["high"] + mixed["low"], "breakout_both": mixed["high"] + mixed["low"]})


def breakout_scores(df: DataFrame, xs: CrossSection, m: str) -> DataFrame:
    """``breakout`` and its mixtures with momentum, ranked in the rows' own layout."""
    d = df
    for side in ("high", "low"):
        d = xs.active_percentile(d, f"new_{side}_excess", is_event(side), f"{side}_pct")
    return mixed_breakouts(d, m)


def contrarian_replacement(df: DataFrame, xs: CrossSection, strength: str, base: str) -> DataFrame:
    """Inside new-high events the base is replaced by a contrarian strength percentile."""
    d = df.withColumn("_c", F.when(is_event("high"), -F.col(strength)))
    d = xs.pct_rank(d, "_c", "event_rank").drop("_c")
    return d.withColumn("combined", F.when(is_event("high"), 0.5 + 0.5 * F.col("event_rank")).otherwise(F.col(base)))


def stitch(df: DataFrame, xs: CrossSection, long_score: str, risk: str, out: str, crash: str | None = None) -> DataFrame:
    """Keep the top 40 % of the long ranking; order the other 60 % by risk.

    The riskiest rows take the lowest ranks.  With ``crash`` the crashed rows
    are used as shorts only after all others, and the neutral middle keeps its
    long order.  Two positions per date and an offset; no per-date Python.
    """
    d = xs.first_rank(df, long_score, "_rl")
    d = xs.attach(d, _n=F.count(F.lit(1)))
    top = F.floor(0.6 * (F.col("_n") - 1) + 1)
    shorts = F.floor(0.4 * (F.col("_n") - 1) + 1)
    d = d.withColumn("_rest", F.col("_rl") <= top)
    crashed = F.coalesce(F.col(crash), F.lit(0)) if crash else F.lit(0)
    d = d.withColumn("_crash", crashed)
    d = xs.position(d, ["_crash", F.col(risk).desc_nulls_last(), "_rl", "code"], "_pos", ("date", "_rest"))
    if crash:
        d = d.withColumn("_mid", F.col("_rest") & (F.col("_pos") > shorts))
        d = xs.position(d, ["_rl", "code"], "_mpos", ("date", "_mid"))
        d = d.withColumn("_pos", F.when(F.col("_mid"), F.col("_mpos") + shorts).otherwise(F.col("_pos")))
        d = d.drop("_mid", "_mpos")
    final = F.when(F.col("_rest"), F.col("_pos")).otherwise(F.col("_rl"))
    return d.withColumn(out, F.try_divide(final - 1, F.col("_n") - 1)).drop("_rl", "_n", "_rest", "_crash", "_pos")


def signed_event_score(df: DataFrame, xs: CrossSection, predictions: dict[str, str], out: str) -> DataFrame:
    """Active percentile of each side's prediction, negative for lows, zero off-event."""
    d = df
    for side, p in predictions.items():
        active = is_event(side) & F.col(p).isNotNull()
        d = xs.active_percentile(d, p, active, f"_{side}")
    return d.withColumn(out, F.col("_high") - F.col("_low")).drop("_high", "_low")


def event_blend(base: str, event_rank: str, active: Column, share: float) -> Column:
    return F.when(active, (1 - share) * F.col(base) + share * F.col(event_rank)).otherwise(F.col(base))


def side_states(df: DataFrame, raw: str, high_alpha: float = HIGH_ALPHA, low_alpha: float = LOW_ALPHA) -> DataFrame:
    """Smooth the positive and the negative part of a signed event stream separately."""
    d = df.withColumns({"high_raw": clip(raw, lo=0), "low_raw": clip(raw, hi=0)})
    d = ts.ewma(d, "high_raw", high_alpha, "high_state")
    return ts.ewma(d, "low_raw", low_alpha, "low_state")


def side_separation(high="high_state", low="low_state") -> Column:
    """A live low state decides; a pure high state comes next; else their sum."""
    h, lo = col(high), col(low)
    return F.when(lo < 0, lo).when((lo == 0) & (h > 0), h).otherwise(h + lo)


def low_without_carry(df: DataFrame, alpha: float = HIGH_ALPHA) -> DataFrame:
    """Smoothed highs plus the low's event-day share only."""
    first = ts.row_in_segment() == 1
    d = df.withColumn("_day", F.when(first, F.col("low_raw")).otherwise(alpha * F.col("low_raw")))
    d = ts.ewma(d, "high_raw", alpha, "_h")
    return d.withColumn("no_carry", F.col("_h") + F.col("_day")).drop("_h", "_day")


def expire_low(low: str, age: str, limit: int = 60) -> Column:
    return F.when((F.col(low) < 0) & (F.col(age) > limit), 0.0).otherwise(F.col(low))


def scale_short(w: str, gamma: float) -> Column:
    return F.when(F.col(w) < 0, gamma * F.col(w)).otherwise(F.col(w))


def fixed_long_path(df: DataFrame, xs: CrossSection, w: str, base: str, risk: str, out: str) -> DataFrame:
    """Keep every long weight and hand the short weights out in risk order.

    The k-th riskiest non-long row receives the k-th smallest short weight; a
    join on (date, k) does the hand-out.
    """
    d = df.withColumn("_long", F.col(w) > 0)
    d = xs.position(d, [F.col(risk).desc_nulls_last(), base, "code"], "_k", ("date", "_long"))
    slots = xs.position(df.where(F.col(w) < 0).select("date", "code", F.col(w).alias("_slot")), ["_slot", "code"], "_k")
    d = d.join(slots.select("date", "_k", F.lit(False).alias("_long"), "_slot"), ["date", "_k", "_long"], "left")
    return d.withColumn(out, F.when(F.col("_long"), F.col(w)).otherwise(F.coalesce("_slot", F.lit(0.0)))).drop("_long", "_k", "_slot")


def rule_gate(m: str, state: Column, factor: float = 0.5) -> Column:
    """Shrink momentum while a state holds."""
    return F.when(state, factor * F.col(m)).otherwise(F.col(m))


def model_gate(m: str, p: str, rank: str, weight: float) -> dict[str, Column]:
    """Gate, sign gate, additive correction and replacement of momentum by a model."""
    m, p, k = F.col(m), F.col(p), F.col(rank)
    return {"gate": m * p, "sign_gate": m * (2 * p - 1), "correction": m + weight * k, "replacement": k}


def short_risk(fd: str, weak: str, vacuum: str, participation: str, gamma: float, delta: float, event: str) -> dict[str, Column]:
    """Deterioration times weak price, damped by vacuum and raised by participation; event variant."""
    a = F.col(fd) * F.col(weak)
    b = a * (1 - gamma * F.col(vacuum))
    return {"A": a, "B": b, "C": b * (1 + delta * F.col(participation)), "Event": F.col(event) * F.col(weak)}
