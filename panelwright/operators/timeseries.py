"""Windows over the history of one listing segment.

Every expression uses the same partition and order, so Spark evaluates any
number of them behind a single shuffle by code.  A partition holds at most one
row per calendar date.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalar import all_present, col

UNBOUNDED = Window.unboundedPreceding


def history(keys=("code", "seg")):
    return Window.partitionBy(*keys).orderBy("date")


def shift(x, k: int = 1, keys=("code", "seg")) -> Column:
    return F.lag(col(x), k).over(history(keys))


def trailing(window: int, skip: int = 0, keys=("code", "seg")):
    """Frame of ``window`` observed rows ending ``skip`` rows before the current one."""
    return history(keys).rowsBetween(-(window - 1 + skip), -skip)


def rolling(fn, x, window: int, min_periods: int | None = None, skip: int = 0,
            keys=("code", "seg")) -> Column:
    """Aggregate ``fn`` over a trailing frame, missing below ``min_periods`` values."""
    x = col(x)
    f = trailing(window, skip, keys)
    need = window if min_periods is None else min_periods
    return F.when(F.count(x).over(f) >= need, fn(x).over(f))


def roll_sum(x, window, min_periods=None, skip=0, **kw):
    return rolling(F.sum, x, window, min_periods, skip, **kw)


def roll_mean(x, window, min_periods=None, skip=0, **kw):
    return rolling(F.avg, x, window, min_periods, skip, **kw)


def roll_std(x, window, min_periods=None, skip=0, ddof=1, **kw):
    fn = F.stddev_samp if ddof == 1 else F.stddev_pop
    return rolling(fn, x, window, min_periods, skip, **kw)


def roll_max(x, window, min_periods=None, skip=0, **kw):
    return rolling(F.max, x, window, min_periods, skip, **kw)


def roll_min(x, window, min_periods=None, skip=0, **kw):
    return rolling(F.min, x, window, min_periods, skip, **kw)


def roll_median(x, window, min_periods=None, skip=0, **kw):
    """Exact rolling median from the sorted values of the frame.

    Sorting a short primitive array is several times faster than the general
    percentile aggregate, which keeps a hash map of counts per frame.
    """
    f = trailing(window, skip, **kw)
    need = window if min_periods is None else min_periods
    values = F.sort_array(F.collect_list(col(x)).over(f))
    n = F.size(values)
    low, high = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
    return F.when(n >= need, low + (high - low) / 2)


def rolling_quantile(df: DataFrame, x: str, window: int, out: str, q: float = 0.5, min_periods: int | None = None, skip: int = 0,
                     keys=("code", "seg")) -> DataFrame:
    """Exact rolling quantile, linearly interpolated, for windows of hundreds of rows.

    ``roll_median`` sorts every frame anew, which is the faster way while frames
    are short.  Here a sorted structure of one segment's values follows the
    window, so a row costs the logarithm of its length and a segment holds each
    value once.  Spark has no frame aggregate that can drop rows, so segments
    (at most one row per calendar date) go through Arrow with the value only.
    """
    keys, need = list(keys), window if min_periods is None else min_periods

    def run(pdf):
        pdf = pdf.sort_values("date")
        pdf[out] = pdf["_x"].shift(skip).rolling(window, min_periods=max(1, need)).quantile(q)
        return pdf[[*keys, "date", out]]

    slim = df.select(*keys, "date", F.col(x).cast("double").alias("_x"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    found = slim.groupBy(*keys).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "date"]) + f", `{out}` double")
    found = found.withColumn(out, F.when(~F.isnan(out), F.col(out)))
    return df.join(found, [*keys, "date"])


def cumulative(fn, x, keys=("code", "seg")) -> Column:
    return fn(col(x)).over(history(keys).rowsBetween(UNBOUNDED, 0))


def row_in_segment(keys=("code", "seg")) -> Column:
    return F.row_number().over(history(keys))


def forward_fill(x, keys=("code", "seg")) -> Column:
    return F.last(col(x), ignorenulls=True).over(history(keys).rowsBetween(UNBOUNDED, 0))


def rolling_slope(y, window: int) -> Column:
    """Least-squares slope of ``y`` on the row index over a full window."""
    f = trailing(window)
    return F.when(F.count(col(y)).over(f) >= window, F.regr_slope(col(y), F.col("_row")).over(f))


def rolling_beta(y, x, window: int) -> Column:
    """Sample covariance over sample variance on a full window of complete pairs."""
    f = trailing(window)
    both = all_present(y, x)
    yy, xx = F.when(both, col(y)), F.when(both, col(x))
    return F.when(
        F.count(xx).over(f) >= window, F.try_divide(F.covar_samp(yy, xx).over(f), F.var_samp(xx).over(f))
    )


def ewma(df: DataFrame, x: str, alpha: float, out: str, keys=("code", "seg"), block: int = 64) -> DataFrame:
    """Exponential smoothing ``y0 = x0, y = a*x + (1-a)*y_prev`` without Python.

    The history is cut into blocks.  Inside a block the smooth is a running sum
    of rescaled inputs.  The state that enters a block folds the ends of all
    earlier blocks by the same recurrence, so nothing is cut off: a decayed
    state is zero only where the row-by-row recurrence is.
    """
    if alpha == 1.0:
        return df.withColumn(out, F.col(x))
    r = 1.0 - alpha
    block = max(1, min(block, int(200 * math.log(10) / -math.log(r))))  # rescaled inputs stay in range
    w = history(keys)
    d = df.withColumn("_i", F.row_number().over(w) - 1)
    d = d.withColumn("_b", F.floor(F.col("_i") / block)).withColumn("_o", F.col("_i") % block)
    z = F.when(F.col("_i") == 0, F.col(x)).otherwise(alpha * F.col(x))
    wb = Window.partitionBy(*keys, "_b").orderBy("date").rowsBetween(UNBOUNDED, 0)
    scaled = F.sum(z * F.pow(F.lit(r), -F.col("_o"))).over(wb)
    d = d.withColumn("_l", F.pow(F.lit(r), F.col("_o")) * scaled)
    end = F.when(F.col("_o") == block - 1, F.coalesce("_l", F.lit(0.0)))
    # one value per earlier block: a calendar of dates has few
    d = d.withColumn("_e", F.collect_list(end).over(w.rowsBetween(UNBOUNDED, -1)))
    carry = F.aggregate("_e", F.lit(0.0), lambda state, e: state * (r ** block) + e)
    y = F.col("_l") + F.pow(F.lit(r), F.col("_o") + 1) * carry
    return d.withColumn(out, y).drop("_i", "_b", "_o", "_l", "_e")


def inverse_ewma(score, alpha: float, floor: float = 1e-12) -> Column:
    """Input stream of a smoothed score; magnitudes below the noise floor are zero."""
    s = col(score)
    raw = F.when(row_in_segment() == 1, s).otherwise((s - (1 - alpha) * shift(s)) / alpha)
    return F.when(F.abs(raw) >= floor, raw).otherwise(0.0)


def lag_vector(x, length: int) -> Column:
    """Current-to-oldest values of the last rows; NULL unless every one is present."""
    f = trailing(length)
    values = F.collect_list(col(x)).over(f)  # skips missing values, so the size shows gaps
    return F.when(F.size(values) == length, F.reverse(values))


def event_ages(df: DataFrame, event: str) -> DataFrame:
    """Age of the latest event in calendar positions and in observed rows."""
    past = history().rowsBetween(UNBOUNDED, 0)
    d = df.withColumn("_rn", row_in_segment())
    hit = F.col(event)
    return (
        d.withColumn("age_calendar", F.col("ord") - F.last(F.when(hit, F.col("ord")), True).over(past))
        .withColumn("age_rows", F.col("_rn") - F.last(F.when(hit, F.col("_rn")), True).over(past))
        .drop("_rn")
    )


def spells(df: DataFrame, state: str, keys=("code",)) -> DataFrame:
    """Unbroken runs of one state on adjacent calendar dates.

    Adds ``spell`` (id inside the code), ``spell_age`` (1 on the first date),
    ``spell_start`` and ``spell_length``.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    same = (F.lag(state).over(w).eqNullSafe(F.col(state))) & (F.col("ord") - F.lag("ord").over(w) == 1)
    d = df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    d = d.withColumn("spell", F.sum("_new").over(w.rowsBetween(UNBOUNDED, 0)))
    ws = Window.partitionBy(*keys, "spell")
    return (
        d.withColumn("spell_age", F.row_number().over(ws.orderBy("date")))
        .withColumn("spell_start", F.min("date").over(ws))
        .withColumn("spell_length", F.count("*").over(ws))
        .drop("_new")
    )


def affine_scan(df: DataFrame, a: str, b: str, out: str, keys=("code", "seg"), span: float = 200.0) -> DataFrame:
    """Recurrence ``y = a * y_before + b`` over a history, for ``0 <= a <= 1``.

    Affine maps compose to affine maps, so the history is cut into blocks whose
    composed map is a running product and a rescaled running sum; a block ends
    before its product falls below ``exp(-span)``, so neither leaves the range
    of doubles.  Blocks are then composed over their last rows alone.  What
    lies five blocks back has decayed by more than ``exp(-4 * span)``, which is
    no double any more, so five compositions give the state of every block and
    nothing is cut off that the row-by-row recurrence keeps.  Rows with
    ``a = 0`` start anew; ``a = 1, b = 0`` leaves the state as it is.
    """
    w = history(keys)
    past = w.rowsBetween(UNBOUNDED, 0)
    d = df.withColumn("_z", F.sum(F.when(F.col(a) > 0, 0).otherwise(1)).over(past))
    d = d.withColumn("_g", F.floor(F.sum(F.when(F.col(a) > 0, -F.log(a)).otherwise(0.0)).over(past) / span))
    block = Window.partitionBy(*keys, "_z", "_g").orderBy("date")
    inside = block.rowsBetween(UNBOUNDED, 0)
    # the first map of a block stays apart, so that a long decay into it does not scale its own rows
    d = d.withColumn("_n", F.row_number().over(block))
    d = d.withColumn("_q", F.product(F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.col(a))).over(inside))
    d = d.withColumns({"_b": F.col("_q") * F.sum(F.col(b) / F.col("_q")).over(inside), "_a": F.col("_q") * F.first(a).over(inside)})
    after = F.lead(F.struct("_z", "_g")).over(w)
    d = d.withColumn("_end", F.coalesce(after != F.struct("_z", "_g"), F.lit(True)))
    before = w.rowsBetween(UNBOUNDED, -1)
    carry = lambda c: F.coalesce(F.last(F.when(F.col("_end"), F.col(c)), ignorenulls=True).over(before), F.lit(0.0))
    d = d.withColumn("_s", F.col("_b"))
    for _ in range(4):
        d = d.withColumn("_s", F.col("_b") + F.col("_a") * carry("_s"))
    y = F.col("_b") + F.col("_a") * carry("_s")
    return d.withColumn(out, y).drop("_z", "_g", "_n", "_q", "_a", "_b", "_s", "_end")


def ewma_with_gaps(df: DataFrame, x: str, available: str, alpha: float, out: str,
                   keys=("code", "seg")) -> DataFrame:
    """Smoothing that skips unavailable rows and is zero on them.

    After ``g`` skipped rows the old state has decayed ``g + 1`` times against a
    new weight of ``alpha``; both are renormalised.  Every available row is one
    affine map of the state, every other row leaves it.
    """
    w = history(keys)
    d = df.withColumn("_ok", F.coalesce(F.col(available), F.lit(False)) & F.col(x).isNotNull())
    d = d.withColumn("_i", F.row_number().over(w))
    last = F.last(F.when(F.col("_ok"), F.col("_i")), ignorenulls=True).over(w.rowsBetween(UNBOUNDED, -1))
    d = d.withColumn("_old", F.pow(F.lit(1.0 - alpha), F.col("_i") - last))
    first = F.col("_old").isNull()
    d = d.withColumn("_ca", F.when(~F.col("_ok"), 1.0).when(first, 0.0).otherwise(F.col("_old") / (F.col("_old") + alpha)))
    d = d.withColumn("_cb", F.when(~F.col("_ok"), 0.0).when(first, F.col(x)).otherwise(alpha * F.col(x) / (F.col("_old") + alpha)))
    d = affine_scan(d, "_ca", "_cb", "_y", keys)
    return d.withColumn(out, F.when(F.col("_ok"), F.col("_y")).otherwise(0.0)).drop("_ok", "_i", "_old", "_ca", "_cb", "_y")
