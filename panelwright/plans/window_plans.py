"""Windows over a listing segment's history."""

from pyspark.sql import functions as F

from panelwright.functions.scalar import day_text, rounded
from panelwright.operators import aggregates as agg
from panelwright.operators import timeseries as ts
from panelwright.plans.common import KS, keyed, keyed_sql
from panelwright.plans.registry import query
from panelwright.plans.sql import day, ewma, on_panel, quintile, r
from panelwright.sources.panels import cross_section, panel, scale_of

W = "PARTITION BY code, seg ORDER BY date"


def _frame(lo, hi=0):
    end = "CURRENT ROW" if hi == 0 else f"{hi} PRECEDING"
    return f"({W} ROWS BETWEEN {lo} PRECEDING AND {end})"


def _roll(fn, x, w, need=None, skip=0):
    f = _frame(w - 1 + skip, skip)
    return f"CASE WHEN count({x}) OVER {f} >= {need or w} THEN {fn.format(x=x)} OVER {f} END"


def _simple(name, spark_col, sql_expr, digits=8):
    """A query that adds one window column to the panel."""
    @query(name, on_panel(keyed_sql("pan", digits, x=sql_expr)))
    def _(spark, sf):
        d = panel(spark, sf)
        return keyed(d.withColumn("x", spark_col()), digits, x="x")


@query("w_01_segments", on_panel(f"""
SELECT code, CAST(seg AS BIGINT) AS seg, {day('min(date)')} AS first_date, {day('max(date)')} AS last_date, count(*) AS rows
FROM q3 GROUP BY code, seg"""))
def _(spark, sf):
    return panel(spark, sf).groupBy("code", F.col("seg").cast("long").alias("seg")).agg(
        day_text(F.min("date")).alias("first_date"), day_text(F.max("date")).alias("last_date"),
        F.count("*").alias("rows"))


_simple("w_02_shift", lambda: ts.shift("close", 3), f"lag(close, 3) OVER ({W})")
_simple("w_03_rolling_sum", lambda: ts.roll_sum("ret", 20), _roll("sum({x})", "ret", 20))
_simple("w_04_rolling_mean", lambda: ts.roll_mean("ret", 20), _roll("avg({x})", "ret", 20))
_simple("w_04_rolling_std", lambda: ts.roll_std("ret", 20), _roll("stddev_samp({x})", "ret", 20))
_simple("w_04_rolling_std_pop", lambda: ts.roll_std("volume", 20, ddof=0), _roll("stddev_pop({x})", "volume", 20), 6)
_simple("w_05_rolling_max", lambda: ts.roll_max("high", 30), _roll("max({x})", "high", 30))
_simple("w_05_rolling_min", lambda: ts.roll_min("low", 30), _roll("min({x})", "low", 30))
_simple("w_06_rolling_median", lambda: ts.roll_median("volume", 21), _roll("quantile_cont({x}, 0.5)", "volume", 21))


@query("w_06_long_quantiles", on_panel(keyed_sql("pan", median=_roll("quantile_cont({x}, 0.5)", "volume", 150, 100), upper=_roll("quantile_cont({x}, 0.9)", "volume", 150, 100, skip=1))))
def _(spark, sf):
    """Median and ninth decile over three years of weeks, two of them at least."""
    d = ts.rolling_quantile(panel(spark, sf), "volume", 150, "median", 0.5, 100)
    return keyed(ts.rolling_quantile(d, "volume", 150, "upper", 0.9, 100, skip=1), median="median", upper="upper")


_simple("w_07_partial_history", lambda: ts.roll_mean("resid", 60, 40), _roll("avg({x})", "resid", 60, 40))
_simple("w_08_prior_only", lambda: ts.roll_max("high", 26, skip=1), _roll("max({x})", "high", 26, skip=1))
_simple("w_08_prior_two", lambda: ts.roll_mean("volume", 26, skip=2), _roll("avg({x})", "volume", 26, skip=2))


@query("w_09_rolling_slope", on_panel(f"""
SELECT {KS}, {r(_roll('regr_slope({x}, rn)', 'lp', 30))} AS x
FROM (SELECT *, ln(close) AS lp, CAST(row_number() OVER ({W}) AS DOUBLE) AS rn FROM pan)"""))
def _(spark, sf):
    d = panel(spark, sf).withColumn("lp", F.log("close")).withColumn("_row", ts.row_in_segment().cast("double"))
    return keyed(d.withColumn("x", ts.rolling_slope("lp", 30)), x="x")


for _name, _alpha in (("", 0.25), ("_fast", 0.5), ("_slow", 0.15)):
    def _make(name, alpha):
        @query(f"w_10_ewma{name}", on_panel(keyed_sql(ewma("coalesce(ret, 0)", alpha, "pan", "y"), x="y")))
        def _(spark, sf):
            d = panel(spark, sf).withColumn("r0", F.coalesce("ret", F.lit(0.0)))
            return keyed(ts.ewma(d, "r0", alpha, "x"), x="x")

    _make(_name, _alpha)


@query("w_11_ewma_gaps", on_panel(f"""
SELECT {KS}, {r('CASE WHEN ok THEN y ELSE 0 END')} AS x FROM gap_y""",
    f"""g0 AS (SELECT code, seg, date, ret, volume > 60 AND ret IS NOT NULL AS ok,
                 row_number() OVER ({W}) AS i FROM pan)""",
    f"""g1 AS (SELECT *, row_number() OVER (PARTITION BY code, seg ORDER BY i) AS j,
                 i - lag(i) OVER (PARTITION BY code, seg ORDER BY i) AS step FROM g0 WHERE ok)""",
    """g2 AS (WITH RECURSIVE walk AS (
        SELECT code, seg, j, i, ret AS y FROM g1 WHERE j = 1
        UNION ALL
        SELECT g1.code, g1.seg, g1.j, g1.i,
               (pow(0.75::DOUBLE, g1.step) * walk.y + 0.25::DOUBLE * g1.ret) / (pow(0.75::DOUBLE, g1.step) + 0.25::DOUBLE)
        FROM walk JOIN g1 ON g1.code = walk.code AND g1.seg = walk.seg AND g1.j = walk.j + 1)
      SELECT * FROM walk)""",
    """gap_y AS (SELECT g0.date, g0.code, g0.ok, g2.y FROM g0 LEFT JOIN g2 ON g0.code = g2.code AND g0.seg = g2.seg AND g0.i = g2.i)"""))
def _(spark, sf):
    d = panel(spark, sf).withColumn("ok", (F.col("volume") > 60) & F.col("ret").isNotNull())
    return keyed(ts.ewma_with_gaps(d, "ret", "ok", 0.25, "x"), x="x")


@query("w_12_inverse_ewma", on_panel(keyed_sql("pan", x="CASE WHEN abs(coalesce(ret, 0)) >= 1e-12 THEN coalesce(ret, 0) ELSE 0 END")))
def _(spark, sf):
    d = panel(spark, sf).withColumn("r0", F.coalesce("ret", F.lit(0.0)))
    d = ts.ewma(d, "r0", 0.25, "y")
    return keyed(d.withColumn("x", ts.inverse_ewma("y", 0.25)), x="x")


_simple("w_13_cumulative_product", lambda: ts.cumulative(F.product, "factor"),
        f"product(factor) OVER ({W} ROWS UNBOUNDED PRECEDING)")


@query("w_14_running_counts", on_panel(f"""
SELECT {KS}, row_number() OVER ({W}) AS n, CAST(sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END) OVER ({W}) AS BIGINT) AS ups FROM pan"""))
def _(spark, sf):
    up = F.when(F.col("ret") > 0, 1).otherwise(0)
    d = panel(spark, sf).withColumn("n", ts.row_in_segment().cast("long")).withColumn("ups", ts.cumulative(F.sum, up))
    return keyed(d, keep=["n", "ups"])


_simple("w_15_forward_fill", lambda: ts.forward_fill(F.when(F.col("volume") > 80, F.col("close"))),
        f"last_value(CASE WHEN volume > 80 THEN close END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING)")

_V = f"(SELECT *, list(ret) OVER {_frame(20)} AS l, count(ret) OVER {_frame(20)} AS c FROM pan)"


@query("w_16_lag_vector", on_panel(f"""
SELECT {KS}, CASE WHEN c = 21 THEN list_aggregate(list_transform(list_reverse(l), lambda v: printf('%.6f', v + 0.0)), 'string_agg', ',') END AS v FROM {_V}"""))
def _(spark, sf):
    d = panel(spark, sf).withColumn("v", ts.lag_vector("ret", 21))
    return keyed(d.withColumn("v", _joined("v")), keep=["v"])


def _joined(c):
    # format_string rounds the shortest decimal form of a double, format_number its exact value, as SQL does
    text = F.concat_ws(",", F.transform(c, lambda v: F.call_function("format_number", v + F.lit(0.0), F.lit("0.000000"))))
    return F.when(F.col(c).isNotNull(), text)


@query("w_17_sorted_vector", on_panel(f"""
SELECT {KS}, {r('l[1]')} AS smallest, {r('l[11]')} AS middle, {r('l[21]')} AS largest FROM (
  SELECT date, code, CASE WHEN c = 21 THEN list_sort(l) END AS l FROM {_V})"""))
def _(spark, sf):
    d = panel(spark, sf).withColumn("v", F.array_sort(ts.lag_vector("ret", 21)))
    return keyed(d, smallest=F.get("v", F.lit(0)), middle=F.get("v", F.lit(10)), largest=F.get("v", F.lit(20)))


@query("w_18_rolling_beta", on_panel(keyed_sql("pan", x="beta")))
def _(spark, sf):
    return keyed(panel(spark, sf), x="beta")


@query("w_19_open_return", on_panel(keyed_sql("pan", x="ret")))
def _(spark, sf):
    return keyed(panel(spark, sf), x="ret")


@query("w_20_event_age", on_panel(f"""
SELECT {KS}, ord - max(CASE WHEN ev THEN ord END) OVER ({W}) AS age_calendar,
       rn - max(CASE WHEN ev THEN rn END) OVER ({W}) AS age_rows
FROM (SELECT *, coalesce(ret > 0.8, false) AS ev, row_number() OVER ({W}) AS rn FROM pan)"""))
def _(spark, sf):
    d = panel(spark, sf).withColumn("ev", F.coalesce(F.col("ret") > 0.8, F.lit(False)))
    d = ts.event_ages(d, "ev")
    return keyed(d, keep=[F.col(c).cast("long").alias(c) for c in ("age_calendar", "age_rows")])


@query("w_21_trailing_events", on_panel(f"""
SELECT {KS}, CAST(sum(ev) OVER {_frame(19)} AS BIGINT) AS n20, CAST(sum(ev) OVER {_frame(59)} AS BIGINT) AS n60,
       CAST(sum(ev) OVER {_frame(119)} AS BIGINT) AS n120
FROM (SELECT *, CASE WHEN ret > 0.8 THEN 1 ELSE 0 END AS ev FROM pan)"""))
def _(spark, sf):
    ev = F.when(F.col("ret") > 0.8, 1).otherwise(0)
    d = panel(spark, sf).withColumns({f"n{k}": F.sum(ev).over(ts.trailing(k)) for k in (20, 60, 120)})
    return keyed(d, keep=["n20", "n60", "n120"])


_SPELL = f"""sp0 AS (SELECT date, code, ord, CAST(ret > mkt AS INTEGER) AS st FROM pan WHERE ret IS NOT NULL),
sp1 AS (SELECT *, CASE WHEN lag(st) OVER (PARTITION BY code ORDER BY date) = st
                        AND ord - lag(ord) OVER (PARTITION BY code ORDER BY date) = 1 THEN 0 ELSE 1 END AS nw FROM sp0),
sp2 AS (SELECT *, sum(nw) OVER (PARTITION BY code ORDER BY date) AS spell FROM sp1)"""


@query("w_22_spells", on_panel(f"""
SELECT {KS}, row_number() OVER (PARTITION BY code, spell ORDER BY date) AS spell_age,
       {day('min(date) OVER (PARTITION BY code, spell)')} AS spell_start, count(*) OVER (PARTITION BY code, spell) AS spell_length
FROM sp2""", _SPELL))
def _(spark, sf):
    d = panel(spark, sf).where("ret is not null").withColumn("st", (F.col("ret") > F.col("mkt")).cast("int"))
    d = ts.spells(d, "st")
    return keyed(d, keep=[F.col("spell_age").cast("long").alias("spell_age"),
                          day_text("spell_start").alias("spell_start"), "spell_length"])


@query("w_23_drawdowns", on_panel(f"""
SELECT {day()} AS date, {r('add_curve - greatest(0, max(add_curve) OVER o)')} AS additive,
       {r('w / greatest(1, max(w) OVER o) - 1')} AS compound
FROM (SELECT date, sum(mkt) OVER (ORDER BY date) AS add_curve, product(1 + mkt) OVER (ORDER BY date) AS w
      FROM mk WHERE mkt IS NOT NULL) WINDOW o AS (ORDER BY date ROWS UNBOUNDED PRECEDING)"""))
def _(spark, sf):
    d = panel(spark, sf).where("mkt is not null").groupBy("date").agg(F.max("mkt").alias("net"))
    d = agg.drawdowns(d, "net")
    return d.select(day_text().alias("date"), rounded("dd_additive").alias("additive"),
                    rounded("dd_compound").alias("compound"))


@query("w_24_weight_change", on_panel(f"""
SELECT {KS}, {r('coalesce(abs(w - lag(w) OVER (PARTITION BY code ORDER BY date)), abs(w))')} AS x
FROM (SELECT *, (q - 2) / n / 1.2::DOUBLE AS w FROM (SELECT *, {quintile('ret')} AS q,
      count(*) OVER (PARTITION BY date) AS n FROM pan)) WHERE w IS NOT NULL"""))
def _(spark, sf):
    from panelwright.operators.account import weight_change

    d = cross_section(spark, sf).quintile(panel(spark, sf), "ret").where("w is not null")
    return keyed(d.withColumn("x", weight_change("w")), x="x")


_simple("w_25_prior_with_gap_rule", lambda: F.when(
    F.col("ord") - ts.shift("ord", keys=("code",)) <= 2, ts.shift("close", keys=("code",))),
    "CASE WHEN ord - lag(ord) OVER (PARTITION BY code ORDER BY date) <= 2 THEN lag(close) OVER (PARTITION BY code ORDER BY date) END")


@query("w_26_forward_compound", on_panel(f"""
SELECT {day('p.date')} AS date, p.code, {r('CASE WHEN count(f.resid) = 3 AND min(f.resid) > -1 THEN exp(sum(CASE WHEN f.resid > -1 THEN ln(1 + f.resid) END)) - 1 END')} AS x
FROM pan p LEFT JOIN pan f ON f.code = p.code AND f.ord BETWEEN p.ord + 2 AND p.ord + 4 GROUP BY p.date, p.code"""))
def _(spark, sf):
    d = agg.forward_compound(panel(spark, sf), "resid", 3, "x", scale_of(spark, sf))
    return keyed(d, x="x")


@query("w_27_survival", on_panel(f"""
SELECT {day('p.date')} AS date, p.code, p.st, f5.st = p.st AS same5, f20.st = p.st AS same20
FROM sp0 p LEFT JOIN sp0 f5 ON f5.code = p.code AND f5.ord = p.ord + 5
           LEFT JOIN sp0 f20 ON f20.code = p.code AND f20.ord = p.ord + 20""", _SPELL))
def _(spark, sf):
    d = panel(spark, sf).where("ret is not null").withColumn("st", (F.col("ret") > F.col("mkt")).cast("int"))
    d = agg.survival(d.select("date", "code", "ord", "st"), "st", (5, 20))
    return keyed(d, keep=["st", "same5", "same20"])


@query("w_28_lag2_month_sum", on_panel(f"""
SELECT code, {day('month')} AS month, {r('CASE WHEN count(s) OVER f >= 11 THEN sum(s) OVER f END')} AS x
FROM (SELECT code, seg, CAST(date_trunc('month', date) AS DATE) AS month, CASE WHEN count(ret) >= 2 THEN sum(ret) END AS s
      FROM pan GROUP BY 1, 2, 3) WINDOW f AS (PARTITION BY code, seg ORDER BY month ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING)"""))
def _(spark, sf):
    m = agg.monthly(panel(spark, sf), "ret", 2)
    return agg.lagged_month_sum(m, "month_sum", "x").select("code", day_text("month").alias("month"), rounded("x").alias("x"))
