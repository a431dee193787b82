"""Where a held weight, its turnover and its return come from.

A side's smooth is parted by how old the contributing events are; each row's
position is then credited to the parts in proportion to their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalar import rounded
from panelwright.operators import timeseries as ts

ALPHAS = {"high": 0.25, "low": 0.5}
#: Rows after which an event counts as old.
OLD_ROWS = 5
# Categories of credit: parts of the two smooths by age, then rows without any part.
PARTS = [f"{age}_{side}" for side in ALPHAS for age in ("fresh", "young", "old")]
SOURCES = [*PARTS, "flat_outer", "flat_inner", "unexplained"]
MEASURES = ("gross", "cost", "turnover", "held", "weight")


def parts_by_age(df: DataFrame, alphas=ALPHAS) -> DataFrame:
    """Part each ``<side>_state`` into fresh, young and old; the three add up to it.

    What is old now is the state of ``OLD_ROWS`` rows ago, decayed since.  In
    the first rows of a segment there is no such state: only the surplus
    weight of the segment's first value is old there.
    """
    n = ts.row_in_segment()
    out: dict[str, Column] = {}
    for side, alpha in alphas.items():
        raw, state, keep = F.col(f"{side}_raw"), F.col(f"{side}_state"), 1 - alpha
        start = F.first(raw).over(ts.history().rowsBetween(ts.UNBOUNDED, 0))
        fresh = F.when(n == 1, raw).otherwise(alpha * raw)
        old = (F.when(n == 1, F.lit(0.0)).when(n <= OLD_ROWS, start * F.pow(F.lit(keep), n))
               .otherwise(keep ** OLD_ROWS * ts.shift(state, OLD_ROWS)))
        out |= {f"fresh_{side}": fresh, f"old_{side}": old, f"young_{side}": state - fresh - old}
    return df.withColumns(out)


def source_shares(df: DataFrame, score: str, q: str, digits: int = 10) -> DataFrame:
    """``shares``: credit of each of ``SOURCES``, in their order; they add up to one.

    Parts are rounded first, so that cancelled remainders carry no credit.
    Rows with a zero score are flat, outer or inner by their quintile.
    """
    flat = F.col(score) == 0
    sizes = F.array(*[F.abs(rounded(c, digits)) for c in PARTS])
    whole = F.aggregate(sizes, F.lit(0.0), lambda a, b: a + b)
    parts = F.transform(sizes, lambda s: F.when(flat | (whole == 0), 0.0).otherwise(s / whole))
    outer = F.col(q).isin(0, 4)
    rest = [flat & outer, flat & ~outer, ~flat & (whole == 0)]
    return df.withColumn("shares", F.concat(parts, F.array(*[F.coalesce(c, F.lit(False)).cast("double") for c in rest])))


def share(source: str) -> Column:
    return F.col("shares")[SOURCES.index(source)]


def source_daily(df: DataFrame, w: str = "w") -> DataFrame:
    """One row per date, side and source: credited return, cost, turnover, days and weight.

    A change inside one side is split evenly between the old and the new
    shares; an exit belongs to the old ones, an entry to the new ones, a flip
    to both sides.  A row is unpivoted to the sources that it has or had, few
    of all, and every date has a row for each side and source.
    """
    seg = Window.partitionBy("code", "seg").orderBy("date")
    d = df.select("date", F.col(w).alias("_w"), "target", "shares",
                  F.coalesce(F.lag(w).over(seg), F.lit(0.0)).alias("_b"), F.lag("shares").over(seg).alias("_old"))
    names = F.array(*map(F.lit, SOURCES))
    none = F.array_repeat(F.lit(0.0), len(SOURCES))
    parts = F.arrays_zip(names.alias("source"), F.col("shares").alias("new"), F.coalesce("_old", none).alias("old"))
    parts = F.filter(parts, lambda p: (p["new"] > 0) | (p["old"] > 0))
    # the sides a row stands on, now or before
    sides = F.filter(F.array(F.struct(F.lit("long").alias("side"), F.lit(1).alias("sign")), F.struct(F.lit("short").alias("side"), F.lit(-1).alias("sign"))),
                     lambda s: (F.col("_b") * s["sign"] > 0) | (F.col("_w") * s["sign"] > 0))
    d = d.withColumn("_s", F.explode(sides)).select("date", "_w", "_b", "target", "_s.side", "_s.sign", F.inline(parts))
    was, now = F.col("_b") * F.col("sign") > 0, F.col("_w") * F.col("sign") > 0
    old, new = F.col("old"), F.col("new")
    turn = (F.when(was & now, F.abs(F.col("_w") - F.col("_b")) * (old + new) / 2)
            .when(was, F.abs("_b") * old).when(now, F.abs("_w") * new).otherwise(0.0))
    each = {"gross": F.when(now, F.col("_w") * F.col("target") * new), "cost": F.when(F.col("target").isNotNull(), 0.001 * turn),
            "turnover": turn, "held": F.when(now, new), "weight": F.when(now, F.abs("_w") * new)}
    sums = d.groupBy("date", "side", "source").agg(*[F.sum(each[m]).alias(m) for m in MEASURES])
    grid = df.select("date").distinct().select("date", F.explode(F.array(F.lit("long"), F.lit("short"))).alias("side")).select("*", F.explode(names).alias("source"))
    return grid.join(sums, ["date", "side", "source"], "left").select("date", "side", "source", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in MEASURES])


def source_summary(daily: DataFrame, by=(), periods: int = 252) -> DataFrame:
    """Annual contributions and shares of each side's sources."""
    by = list(by)
    s = daily.groupBy(*by, "side", "source").agg(
        (F.avg("gross") * periods).alias("annual_gross"), (F.avg("cost") * periods).alias("annual_cost"),
        (F.avg(F.col("gross") - F.col("cost")) * periods).alias("annual_net"),
        F.sum("turnover").alias("_t"), F.sum("held").alias("stock_days"), F.sum("weight").alias("_w"))
    side = Window.partitionBy(*by, "side")  # one row per source
    return s.withColumns({
        "turnover_share": F.try_divide(F.col("_t"), F.sum("_t").over(side)),
        "weight_share": F.try_divide(F.col("_w"), F.sum("_w").over(side)),
    }).drop("_t", "_w")
