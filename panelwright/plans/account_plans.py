"""Portfolio accounts and evaluation statistics of the scored panel."""

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from panelwright.functions.scalar import day_text, rounded
from panelwright.operators import account as P
from panelwright.operators import aggregates as agg
from panelwright.operators import evaluation as E
from panelwright.operators.asof import at_offset
from panelwright.operators.xsection import rank_bins
from panelwright.plans.common import keyed, keyed_sql
from panelwright.plans.registry import query
from panelwright.plans.sql import avg_rank, day, on_account, on_events, on_scored, pct_rank, r, scorr
from panelwright.sources.panels import cross_section, events, scale_of, scored

D = f"{day()} AS date"
YEAR = "CAST(year(date) AS BIGINT)"


def _daily(spark, sf):
    return P.daily_account(scored(spark, sf), cross_section(spark, sf))


def _legs(spark, sf):
    return P.leg_weights(scored(spark, sf).where("w is not null"))


def _cols(df, names, digits=8):
    return [rounded(c, digits).alias(c) for c in names]


def _dated(df, names, digits=8, keep=()):
    return df.select(day_text().alias("date"), *keep, *_cols(df, names, digits))


def _sql(names, digits=8):
    return ", ".join(f"{r(c, digits)} AS {c}" for c in names)


@query("p_01_row_pl", on_scored(keyed_sql("sc", 10, w="w", dw="dw", pl="w * target - 0.001 * dw")))
def _(spark, sf):
    return keyed(P.row_pl(scored(spark, sf)), 10, w="w", dw="dw", pl="net")


def _sharpe(x, dd="samp"):
    return f"avg({x}) / stddev_{dd}({x}) * sqrt(252)"


@query("p_02_sharpe", on_account(f"SELECT {r(_sharpe('net'), 6)} AS sharpe, {r(_sharpe('net', 'pop'), 6)} AS sharpe_pop, {r(_sharpe('gross'), 6)} AS gross_sharpe FROM daily"))
def _(spark, sf):
    return _daily(spark, sf).agg(rounded(P.sharpe("net"), 6).alias("sharpe"), rounded(P.sharpe("net", 0), 6).alias("sharpe_pop"),
                                 rounded(P.sharpe("gross"), 6).alias("gross_sharpe"))


_ACC = ["gross", "net", "turnover", "cost", "cost_all", "net_all_cost", "long", "short", "rankic", "label_coverage",
        "q1", "q2", "q3", "q4", "q5"]


@query("p_03_daily_account", on_account(f"SELECT {D}, {_sql(_ACC)} FROM daily"))
def _(spark, sf):
    return _dated(_daily(spark, sf), _ACC)


_LEG_CTES = """lg0 AS (SELECT *, greatest(w, 0) AS wl, least(w, 0) AS ws FROM sc WHERE w IS NOT NULL),
lg AS (SELECT *, coalesce(abs(wl - lag(wl) OVER k), abs(wl)) AS dl, coalesce(abs(ws - lag(ws) OVER k), abs(ws)) AS ds FROM lg0 WINDOW k AS (PARTITION BY code ORDER BY date)),
la AS (SELECT date, coalesce(sum(wl * target), 0) AS long_gross, coalesce(sum(CASE WHEN target IS NOT NULL THEN 0.001::DOUBLE * dl END), 0) AS long_cost, sum(dl) AS long_turnover,
       coalesce(sum(ws * target), 0) AS short_gross, coalesce(sum(CASE WHEN target IS NOT NULL THEN 0.001::DOUBLE * ds END), 0) AS short_cost, sum(ds) AS short_turnover,
       sum(abs(w)) AS gross_exposure, sum(w) AS net_exposure, coalesce(sum(CASE WHEN target IS NOT NULL THEN w END), 0) AS lab, coalesce(avg(target), 0) AS um
       FROM lg GROUP BY date)"""
_LEGS = ["long_gross", "long_cost", "long_turnover", "short_gross", "short_cost", "short_turnover"]


@query("p_04_leg_account", on_scored(f"SELECT {D}, {_sql(_LEGS)}, {r('long_gross - long_cost')} AS long_net, {r('short_gross - short_cost')} AS short_net FROM la", _LEG_CTES))
def _(spark, sf):
    return _dated(P.leg_account(_legs(spark, sf)), [*_LEGS, "long_net", "short_net"])


@query("p_05_full_account", on_scored(f"""
SELECT {D}, {_sql(['gross_exposure', 'net_exposure'])}, {r('lab * um')} AS common, {r('long_gross + short_gross - lab * um')} AS selection FROM la""", _LEG_CTES))
def _(spark, sf):
    return _dated(P.full_account(_legs(spark, sf)), ["gross_exposure", "net_exposure", "common", "selection"])


@query("p_06_row_contribution", on_scored(keyed_sql("sc WHERE target IS NOT NULL", 10, gross="w * target", cost="0.001 * dw", net="w * target - 0.001 * dw")))
def _(spark, sf):
    return keyed(P.row_pl(scored(spark, sf)).where("target is not null"), 10, gross="gross", cost="cost", net="net")


_DN = """dn AS (SELECT a.date, a.code, a.w, a.ord, b.close / b.open - 1 AS dy, c.open / b.close - 1 AS ng, c.beta * c.mkt AS adj, c.open / b.open - 1 - c.beta * c.mkt AS held
 FROM sc a LEFT JOIN sc b ON a.code = b.code AND b.ord = a.ord + 1 LEFT JOIN sc c ON a.code = c.code AND c.ord = a.ord + 2)"""


@query("p_07_day_night", on_scored(f"""
SELECT {D}, side, session, {r('sum(g)')} AS gross FROM (
  SELECT date, CASE WHEN w > 0 THEN 'long' ELSE 'short' END AS side, 'day' AS session, w * (dy + dy * ng / 2 - 0.5 * adj) AS g FROM dn WHERE w <> 0 AND held IS NOT NULL
  UNION ALL SELECT date, CASE WHEN w > 0 THEN 'long' ELSE 'short' END, 'night', w * (ng + dy * ng / 2 - 0.5 * adj) FROM dn WHERE w <> 0 AND held IS NOT NULL)
GROUP BY date, side, session""", _DN))
def _(spark, sf):
    d = P.holding_split(scored(spark, sf), cross_section(spark, sf), 0.5)
    return _dated(P.side_by_session(d), ["gross"], keep=["side", "session"])


@query("p_07_day_night_reconciles", on_scored(f"""
SELECT share, count(*) AS rows, CAST(0 AS BIGINT) AS broken, {r('sum(w * (ng + dy * ng / 2 - share * adj))', 6)} AS night FROM dn
CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS share) WHERE w <> 0 AND held IS NOT NULL GROUP BY share""", _DN))
def _(spark, sf):
    out = None
    for s in (0.0, 0.5, 1.0):
        d = P.holding_split(scored(spark, sf), cross_section(spark, sf), s).where("w <> 0 and held is not null")
        gap = F.abs(F.col("day_part") + F.col("night_part") - F.col("held")) > 1e-9
        one = d.agg(F.count("*").alias("rows"), F.count(F.when(gap, 1)).alias("broken"),
                    rounded(F.sum(F.col("w") * F.col("night_part")), 6).alias("night")).withColumn("share", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


@query("p_08_cost_stress", on_account(f"""
SELECT CAST(bps AS BIGINT) AS bps, {r('avg(x) * 252', 6)} AS annual_net, {r(_sharpe('x'), 6)} AS net_sharpe, {r('avg(x) / avg(gross)', 6)} AS retention,
       {r('avg(gross) / avg(turnover) * 10000', 6)} AS breakeven_bps
FROM (SELECT *, gross - bps / 10000.0::DOUBLE * turnover AS x FROM daily CROSS JOIN (SELECT unnest([5, 10, 20, 30]) AS bps)) GROUP BY bps"""))
def _(spark, sf):
    d = P.cost_stress(_daily(spark, sf))
    return d.select(F.col("bps").cast("long").alias("bps"), *_cols(d, ["annual_net", "net_sharpe", "retention", "breakeven_bps"], 6))


@query("p_09_leave_one_year_out", on_account(f"""
SELECT y.year AS excluded, count(*) AS days, {r('avg(net) * 252', 6)} AS annual_net, {r(_sharpe('net'), 6)} AS net_sharpe
FROM daily JOIN (SELECT DISTINCT {YEAR} AS year FROM daily) y ON year(daily.date) <> y.year GROUP BY y.year"""))
def _(spark, sf):
    d = P.leave_one_year_out(_daily(spark, sf))
    return d.select("excluded", "days", *_cols(d, ["annual_net", "net_sharpe"], 6))


@query("p_10_prediction_contract", on_scored(f"SELECT count(*) AS rows, {r('avg(score)')} AS mean_score FROM sc WHERE target IS NOT NULL"))
def _(spark, sf):
    d = scored(spark, sf)
    labels = d.where("target is not null").select("date", "code", "target")
    return P.align_prediction(labels, d.select("date", "code", "score")).agg(
        F.count("*").alias("rows"), rounded(F.avg("score")).alias("mean_score"))


# -- evaluation ---------------------------------------------------------------
@query("e_01_rank_ic", on_account(f"SELECT {D}, {r('rankic')} AS rankic FROM ic"))
def _(spark, sf):
    return _dated(E.rank_ic(scored(spark, sf), "score", "target", cross_section(spark, sf)), ["rankic"])


def _hac_sql(source, x, lag=5):
    prods = ", ".join(f"sum(e * l{k}) AS s{k}" for k in range(1, lag + 1))
    lags = ", ".join(f"lag(e, {k}) OVER (ORDER BY date) AS l{k}" for k in range(1, lag + 1))
    var = "ee" + "".join(f" + 2 * (1 - {k} / {lag + 1}.0::DOUBLE) * coalesce(s{k}, 0)" for k in range(1, lag + 1))
    return f"""(SELECT n AS days, m AS mean, CASE WHEN n >= 3 THEN m / sqrt(greatest(({var}) / n, 1e-30) / n) END AS t FROM (
      SELECT count(*) AS n, max(mm) AS m, sum(e * e) AS ee, {prods} FROM (
        SELECT *, {lags} FROM (SELECT date, {x} - avg({x}) OVER () AS e, avg({x}) OVER () AS mm FROM {source} WHERE {x} IS NOT NULL))))"""


@query("e_02_hac_t", on_account(f"SELECT days, {r('mean')} AS mean, {r('t', 6)} AS t_hac FROM {_hac_sql('daily', 'rankic')}"))
def _(spark, sf):
    d = E.hac_t(_daily(spark, sf), "rankic")
    return d.select("days", rounded("mean").alias("mean"), rounded("t_hac", 6).alias("t_hac"))


_MB = ["gross_sharpe", "net_sharpe", "net_all_cost_sharpe", "rankic", "rankic_hit", "annual_gross", "annual_net", "annual_cost",
       "annual_long", "annual_short", "turnover", "max_drawdown_additive", "max_drawdown_compound", "label_coverage"]
_DD = """dd AS (SELECT *, a - greatest(0, max(a) OVER (ORDER BY date)) AS da, v / greatest(1, max(v) OVER (ORDER BY date)) - 1 AS dc FROM
 (SELECT *, sum(net * 0.01::DOUBLE) OVER (ORDER BY date) AS a, product(1 + net * 0.01::DOUBLE) OVER (ORDER BY date) AS v FROM daily))"""


@query("e_03_metric_bundle", on_account(f"""
SELECT count(*) AS days, {r(_sharpe('gross'), 6)} AS gross_sharpe, {r(_sharpe('net'), 6)} AS net_sharpe, {r(_sharpe('net_all_cost'), 6)} AS net_all_cost_sharpe,
 {r('avg(rankic)', 6)} AS rankic, {r('avg(CASE WHEN rankic > 0 THEN 1.0::DOUBLE WHEN rankic <= 0 THEN 0 END)', 6)} AS rankic_hit,
 {', '.join(f"{r(f'avg({c}) * 0.01::DOUBLE * 252', 6)} AS annual_{c}" for c in ('gross', 'net', 'cost', 'long', 'short'))}, {r('avg(turnover)', 6)} AS turnover,
 {r('min(da)', 6)} AS max_drawdown_additive, {r('min(dc)', 6)} AS max_drawdown_compound, {r('avg(label_coverage)', 6)} AS label_coverage,
 {r("(SELECT corr(k, rk) FROM (SELECT k, rank() OVER (ORDER BY v) AS rk FROM (SELECT unnest([1,2,3,4,5]) AS k, unnest([avg(q1), avg(q2), avg(q3), avg(q4), avg(q5)]) AS v FROM daily)))", 6)} AS q_monotonicity,
 {r(f"(SELECT t FROM {_hac_sql('daily', 'rankic')})", 6)} AS rankic_t_hac5
FROM dd""", _DD))
def _(spark, sf):
    # One hundredth of the capital at risk, so that the compound curve stays positive.
    pl = ("gross", "net", "cost", "net_all_cost", "long", "short")
    m = E.metric_bundle(_daily(spark, sf).withColumns({c: F.col(c) * 0.01 for c in pl}))
    return m.select("days", *_cols(m, [*_MB, "q_monotonicity", "rankic_t_hac5"], 6))


@query("e_04_year_metrics", on_account(f"""
SELECT {YEAR} AS year, count(*) AS days, {r(_sharpe('net'), 6)} AS net_sharpe, {r('avg(gross) * 252', 6)} AS annual_gross, {r('avg(rankic)', 6)} AS rankic,
       {r('avg(turnover)', 6)} AS turnover FROM daily GROUP BY GROUPING SETS ((year(date)), ())"""))
def _(spark, sf):
    d = _daily(spark, sf).withColumn("year", F.year("date").cast("long"))
    return d.groupingSets([[F.col("year")], []], "year").agg(
        F.count("*").alias("days"), rounded(P.sharpe("net"), 6).alias("net_sharpe"),
        rounded(F.avg("gross") * 252, 6).alias("annual_gross"), rounded(F.avg("rankic"), 6).alias("rankic"),
        rounded(F.avg("turnover"), 6).alias("turnover"))


@query("e_05_side_metrics", on_scored(f"""
SELECT {r('avg(long_gross) * 252', 6)} AS long_annual, {r('avg(short_gross) * 252', 6)} AS short_annual, {r(_sharpe('(long_gross - long_cost)'), 6)} AS long_sharpe,
       {r(_sharpe('(short_gross - short_cost)'), 6)} AS short_sharpe, {r('corr(long_gross - long_cost, short_gross - short_cost)', 6)} AS leg_corr FROM la""", _LEG_CTES))
def _(spark, sf):
    d = P.leg_account(_legs(spark, sf))
    return d.agg(rounded(F.avg("long_gross") * 252, 6).alias("long_annual"), rounded(F.avg("short_gross") * 252, 6).alias("short_annual"),
                 rounded(P.sharpe("long_net"), 6).alias("long_sharpe"), rounded(P.sharpe("short_net"), 6).alias("short_sharpe"),
                 rounded(agg.correlation("long_net", "short_net"), 6).alias("leg_corr"))


@query("e_06_bootstrap", on_account(f"""
SELECT {r('quantile_cont(ds, 0.025)', 6)} AS d_sharpe_low, {r('quantile_cont(ds, 0.975)', 6)} AS d_sharpe_high, {r('quantile_cont(da, 0.025)', 6)} AS d_annual_low,
       {r('quantile_cont(da, 0.975)', 6)} AS d_annual_high, {r('avg(CASE WHEN ds > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS positive_fraction, count(*) AS reps FROM (
 SELECT rep, sqrt(252) * (avg(gross) / stddev_samp(gross) - avg(net) / stddev_samp(net)) AS ds, 252 * (avg(gross) - avg(net)) AS da
 FROM (SELECT p.rep, (p.start + o.off) % p.n AS i FROM (
         SELECT rep, blk, n, CAST('0x' || substr(md5('104729|' || rep || '|' || blk), 1, 8) AS BIGINT) % n AS start
         FROM (SELECT unnest(range(1000)) AS rep), (SELECT count(*) AS n FROM daily), (SELECT unnest(range((SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) FROM daily))) AS blk)) p,
       (SELECT unnest(range(20)) AS off) o WHERE p.blk * 20 + o.off < p.n) d
 JOIN (SELECT row_number() OVER (ORDER BY date) - 1 AS i, gross, net FROM daily) s USING (i) GROUP BY rep)"""))
def _(spark, sf):
    b = E.bootstrap_paired(_daily(spark, sf), "net", "gross")
    return b.select(*_cols(b, ["d_sharpe_low", "d_sharpe_high", "d_annual_low", "d_annual_high"], 6),
                    rounded("positive_fraction").alias("positive_fraction"), "reps")


def _horner(x, values):
    out = str(values[0])
    for v in values[1:]:
        out = f"({out} * {x} + {v})"
    return out


# Numerator and denominator of the published rational form of the normal distribution function.
_UP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_DOWN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_TRIALS = (5, 20, 100)


def _threshold(trials, variance=0.0005):
    nd, g = NormalDist(), 0.5772156649015329
    return math.sqrt(variance) * ((1 - g) * nd.inv_cdf(1 - 1 / trials) + g * nd.inv_cdf(1 - 1 / (trials * math.e)))


@query("e_07_deflated_sharpe", on_account(f"""
SELECT trials, CAST(n AS BIGINT) AS n, {r('CASE WHEN z > 0 THEN 1 - tail ELSE tail END')} AS dsr, {r('sr')} AS daily_sr, {r('best')} AS threshold, {r('sk', 6)} AS skew, {r('ku', 6)} AS kurtosis
FROM (SELECT *, exp(-z * z / 2) * {_horner('abs(z)', _UP)} / {_horner('abs(z)', _DOWN)} AS tail FROM (
  SELECT *, (sr - best) * sqrt(n - 1) / sqrt(greatest(1 - sk * sr + (ku - 1) * sr * sr / 4, 1e-30)) AS z FROM (
    SELECT count(net) AS n, avg(net) / stddev_samp(net) AS sr, skewness(net) AS sk, kurtosis(net) + 3 AS ku FROM daily)
  CROSS JOIN (VALUES {', '.join(f'({t}, {_threshold(t)!r}::DOUBLE)' for t in _TRIALS)}) v(trials, best)))"""))
def _(spark, sf):
    """For three numbers of trials; all are columns, so one aggregate serves them."""
    d = _daily(spark, sf).select("net", F.explode(F.array(*map(F.lit, _TRIALS))).alias("trials"))
    e = E.deflated_sharpe(d, "net", 0.0005, "trials", by=["trials"])
    return e.select("trials", "n", *_cols(e, ["dsr", "daily_sr", "threshold"], 8), *_cols(e, ["skew", "kurtosis"], 6))


# Three strategies accounted in one pass: the score, its negative and the raw momentum.
_STRAT = f"""st0 AS (SELECT 'score' AS strategy, date, code, score AS s, target FROM sc UNION ALL SELECT 'reverse', date, code, -score, target FROM sc
 UNION ALL SELECT 'raw', date, code, {r('mom', 10)}, target FROM sc),
st1 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY strategy, date) >= 5 THEN least(4, greatest(0, ceil(5.0::DOUBLE * (row_number() OVER (PARTITION BY strategy, date ORDER BY s, code) - 1)
  / (count(*) OVER (PARTITION BY strategy, date) - 1)) - 1)) END AS q, count(*) OVER (PARTITION BY strategy, date) AS n FROM st0),
st2 AS (SELECT *, (q - 2) / n / 1.2::DOUBLE AS w FROM st1),
st3 AS (SELECT *, coalesce(abs(w - lag(w) OVER (PARTITION BY strategy, code ORDER BY date)), abs(w)) AS dw FROM st2),
st4 AS (SELECT strategy, date, coalesce(sum(w * target - 0.001::DOUBLE * dw), 0) AS net FROM st3 GROUP BY 1, 2),
st AS (SELECT strategy, CAST(year(date) AS BIGINT) AS year, avg(net) / stddev_samp(net) * sqrt(252) AS net_sharpe, avg(net) * 252 AS annual_net FROM st4 GROUP BY 1, 2)"""


def _strategies(spark, sf):
    from pyspark.sql import Window

    from panelwright.operators.xsection import groups_from_rank
    from panelwright.sources.panels import stable

    xs = cross_section(spark, sf)
    d = scored(spark, sf).select("date", "code", "target", F.col("score").alias("score"), (-F.col("score")).alias("reverse"),
                                 stable(F.col("mom")).alias("raw"))
    d = agg.unpivot(d, ["date", "code", "target"], ["score", "reverse", "raw"], "strategy", "s")
    d = xs.first_rank(d, "s", "rk", ("strategy", "date"))
    d = groups_from_rank(xs.attach(d, ("strategy", "date"), n=F.count(F.lit(1))), "rk", "n")
    before = F.lag("w").over(Window.partitionBy("strategy", "code").orderBy("date"))
    d = d.withColumn("dw", F.coalesce(F.abs(F.col("w") - before), F.abs("w")))
    net = P.row_pl(d).groupBy("strategy", "date").agg(P.zero(F.sum("net")).alias("net"))
    return net.groupBy("strategy", F.year("date").cast("long").alias("year")).agg(
        P.sharpe("net").alias("net_sharpe"), (F.avg("net") * 252).alias("annual_net"))


@query("e_08_fold_deltas", on_scored(f"""
SELECT a.strategy, count(*) AS folds, count(*) FILTER (WHERE a.net_sharpe > b.net_sharpe) AS improved,
       {r('quantile_cont(a.net_sharpe - b.net_sharpe, 0.5)', 6)} AS median_delta, {r('min(a.net_sharpe - b.net_sharpe)', 6)} AS worst_delta
FROM st a JOIN st b ON a.year = b.year AND b.strategy = 'score' WHERE a.strategy <> 'score' GROUP BY a.strategy""", _STRAT))
def _(spark, sf):
    d = E.fold_deltas(_strategies(spark, sf), "score")
    return d.select("strategy", "folds", "improved", *_cols(d, ["median_delta", "worst_delta"], 6))


@query("e_09_decision_rules", on_scored(f"""
SELECT strategy, {r('mean_sharpe', 6)} AS mean_sharpe, enough, stable, enough AND stable AS accepted,
       enough AND stable AND row_number() OVER (ORDER BY enough AND stable DESC, mean_sharpe DESC, strategy) = 1 AS selected
FROM (SELECT strategy, avg(net_sharpe) AS mean_sharpe, avg(net_sharpe) > -5 AS enough, min(net_sharpe) > -12 AS stable FROM st GROUP BY 1)""", _STRAT))
def _(spark, sf):
    m = _strategies(spark, sf).groupBy("strategy").agg(F.avg("net_sharpe").alias("mean_sharpe"), F.min("net_sharpe").alias("low"))
    d = E.decide(m, {"enough": F.col("mean_sharpe") > -5, "stable": F.col("low") > -12}, [F.col("mean_sharpe").desc(), "strategy"])
    return d.select("strategy", rounded("mean_sharpe", 6).alias("mean_sharpe"), "enough", "stable", "accepted", "selected")


@query("e_10_group_spread", on_scored(f"""
SELECT {D}, CASE WHEN count(target) >= 5 THEN {r('avg(target) FILTER (WHERE q = 4) - avg(target) FILTER (WHERE q = 0)')} END AS spread, count(target) AS rows FROM sc GROUP BY date"""))
def _(spark, sf):
    d = E.group_spread(scored(spark, sf), "q", "target")
    return _dated(d, ["spread"], keep=["rows"])


@query("e_10_event_quintiles", on_events(f"""
SELECT {D}, q5, count(*) AS rows, {r('avg(target)')} AS mean_target FROM (
 SELECT *, least(4, CAST(floor(5 * (({avg_rank('mom')}) - 1) / (n - 1)) AS BIGINT)) AS q5 FROM (
  SELECT *, count(*) OVER (PARTITION BY date) AS n, (SELECT count(DISTINCT mom) FROM ev0 y WHERE y.date = x.date) AS u FROM ev0 x) WHERE n >= 5 AND u >= 5) GROUP BY date, q5""",
    "ev0 AS (SELECT date, code, mom, target FROM en WHERE (he OR le) AND mom IS NOT NULL AND target IS NOT NULL)"))
def _(spark, sf):
    """Quintiles among the rows with an event only; dates with too few or too equal rows are left out."""
    d = events(spark, sf).where("(high_event or low_event) and mom is not null and target is not null").select("date", "code", "mom", "target")
    d = E.event_quintiles(d, "mom", "target", cross_section(spark, sf))
    return d.select(day_text().alias("date"), F.col("q5").cast("long").alias("q5"), "rows", rounded("mean_target").alias("mean_target"))


# Market and name states under which a score is judged.
STATES = {
    "busy": "volume > 60", "quiet": "volume <= 60", "rising": "mkt > 0.15", "falling": "mkt <= 0.15", "crash": "mkt < -0.1", "rebound": "mkt > 0.3",
    "large": "size >= 4", "small": "size <= 2", "high beta": "beta > 1", "low beta": "beta < 1", "up day": "ret > 0", "down day": "ret < 0",
    "strong": "mom > 0.2", "weak": "mom < -0.2",
}


@query("e_11_conditional_states", on_scored(f"""
SELECT state, {YEAR} AS year, {r('avg(c)', 6)} AS rankic, {r('avg(s)', 6)} AS signed_target, CAST(sum(n) AS BIGINT) AS rows FROM (
  SELECT date, state, {scorr('rx', 'ry', ' FILTER (WHERE target IS NOT NULL)')} AS c, max(sg) AS s, max(n) AS n FROM (
    SELECT date, state, {avg_rank('score', 'date, state, target IS NULL')} AS rx, {avg_rank('target', 'date, state')} AS ry, target,
           avg(sign(score) * target) OVER (PARTITION BY date, state) AS sg, count(*) OVER (PARTITION BY date, state) AS n
    FROM cs) GROUP BY date, state) GROUP BY state, year(date)""",
    "cs AS (" + " UNION ALL ".join(f"SELECT *, '{n}' AS state FROM sc WHERE {c}" for n, c in STATES.items()) + ")"))
def _(spark, sf):
    d = E.conditional_ic(scored(spark, sf), {n: F.expr(c) for n, c in STATES.items()}, "score", "target", cross_section(spark, sf))
    return d.select("state", "year", "rows", *_cols(d, ["rankic", "signed_target"], 6))


@query("e_12_feature_decay", on_scored(f"""
SELECT {YEAR} AS year, {r('avg(c1)', 6)} AS near_ic, {r('avg(c2)', 6)} AS far_ic FROM (
 SELECT date, (SELECT 1) AS one, {scorr('a1', 'b1')} AS c1 FROM (SELECT date, {avg_rank('score')} AS a1, {avg_rank('near')} AS b1 FROM fd WHERE near IS NOT NULL) GROUP BY date) x
FULL JOIN (SELECT date, {scorr('a2', 'b2')} AS c2 FROM (SELECT date, {avg_rank('score')} AS a2, {avg_rank('far')} AS b2 FROM fd WHERE far IS NOT NULL) GROUP BY date) y USING (date) GROUP BY 1""",
    """fd AS (SELECT a.*, b.open / a.close - 1 AS near, c.open / b.open - 1 AS far FROM sc a LEFT JOIN sc b ON a.code = b.code AND b.ord = a.ord + 1
 LEFT JOIN sc c ON a.code = c.code AND c.ord = a.ord + 2)"""))
def _(spark, sf):
    xs, d = cross_section(spark, sf), scored(spark, sf).select("date", "code", "ord", "open", "close", "score")
    e = at_offset(at_offset(d, {"open": "o1"}, 1), {"open": "o2"}, 2)
    e = e.withColumns({"near": F.col("o1") / F.col("close") - 1, "far": F.col("o2") / F.col("o1") - 1})
    ic = E.rank_ic(e, "score", "near", xs, out="c1").join(E.rank_ic(e, "score", "far", xs, out="c2"), "date", "full")
    g = ic.groupBy(F.year("date").cast("long").alias("year")).agg(F.avg("c1").alias("near_ic"), F.avg("c2").alias("far_ic"))
    return g.select("year", *_cols(g, ["near_ic", "far_ic"], 6))


@query("e_13_grid_table", on_scored(f"""
SELECT CAST(a AS BIGINT) AS score_third, CAST(b AS BIGINT) AS volume_third, count(*) AS rows, {r('avg(target)', 6)} AS target, {r('avg(w)', 8)} AS weight FROM (
  SELECT *, ceil(3 * ({pct_rank('score')})) AS a, ceil(3 * ({pct_rank('volume')})) AS b FROM sc) GROUP BY a, b"""))
def _(spark, sf):
    xs = cross_section(spark, sf)
    d = xs.pct_rank(xs.pct_rank(scored(spark, sf), "score", "ps"), "volume", "pv")
    return d.groupBy(rank_bins("ps", "tercile").cast("long").alias("score_third"), rank_bins("pv", "tercile").cast("long").alias("volume_third")).agg(
        F.count("*").alias("rows"), rounded(F.avg("target"), 6).alias("target"), rounded(F.avg("w")).alias("weight"))


@query("e_14_horizon_quality", on_scored(f"""
SELECT {YEAR} AS year, {r('avg(c)', 6)} AS rankic, count(c) AS days FROM (
  SELECT date, {scorr('a', 'b')} AS c FROM (SELECT date, {avg_rank('score')} AS a, {avg_rank('y')} AS b FROM hz WHERE y IS NOT NULL) GROUP BY date) GROUP BY 1""",
    """hz AS (SELECT p.date, p.code, p.score, CASE WHEN count(f.resid) = 5 AND min(f.resid) > -1 THEN exp(sum(CASE WHEN f.resid > -1 THEN ln(1 + f.resid) END)) - 1 END AS y
 FROM sc p LEFT JOIN sc f ON f.code = p.code AND f.ord BETWEEN p.ord + 2 AND p.ord + 6 GROUP BY p.date, p.code, p.score)"""))
def _(spark, sf):
    d = agg.forward_compound(scored(spark, sf), "resid", 5, "y", scale_of(spark, sf))
    ic = E.rank_ic(d, "score", "y", cross_section(spark, sf))
    return ic.groupBy(F.year("date").cast("long").alias("year")).agg(
        rounded(F.avg("rankic"), 6).alias("rankic"), F.count("rankic").alias("days"))


# First and last calendar position of each horizon, counted from the score's date.
HORIZONS = {"day 1": (2, 2), "days 1-5": (2, 6), "days 6-20": (7, 21), "days 21-40": (22, 41)}


def _horizon_sql(name, first, last):
    n = last - first + 1
    return f"""SELECT '{name}' AS horizon, p.date, p.code, p.score, CASE WHEN count(f.resid) = {n} AND min(f.resid) > -1 THEN exp(sum(CASE WHEN f.resid > -1 THEN ln(1 + f.resid) END)) - 1 END AS y
 FROM sc p LEFT JOIN sc f ON f.code = p.code AND f.ord BETWEEN p.ord + {first} AND p.ord + {last} GROUP BY p.date, p.code, p.score"""


@query("e_14_horizon_table", on_scored(f"""
SELECT horizon, {r('avg(c)', 6)} AS rankic, count(c) AS days FROM (
  SELECT horizon, date, {scorr('a', 'b')} AS c FROM (SELECT horizon, date, {avg_rank('score', 'horizon, date')} AS a, {avg_rank('y', 'horizon, date')} AS b FROM hz WHERE y IS NOT NULL) GROUP BY horizon, date) GROUP BY horizon""",
    "hz AS (" + " UNION ALL ".join(_horizon_sql(n, a, b) for n, (a, b) in HORIZONS.items()) + ")"))
def _(spark, sf):
    """All horizons' labels as frames over one layout, then one unpivoted rank."""
    d, names = scored(spark, sf), list(HORIZONS)
    for i, (first, last) in enumerate(HORIZONS.values()):
        d = agg.forward_compound(d, "resid", last - first + 1, f"y{i}", scale_of(spark, sf), start=first)
    d = d.select("date", "code", "score", F.inline(F.array(*[F.struct(F.lit(n).alias("horizon"), F.col(f"y{i}").alias("y")) for i, n in enumerate(names)])))
    ic = E.rank_ic(d, "score", "y", cross_section(spark, sf), ("horizon", "date"))
    return ic.groupBy("horizon").agg(rounded(F.avg("rankic"), 6).alias("rankic"), F.count("rankic").alias("days"))


@query("e_16_short_tail", on_scored(f"""
SELECT {YEAR} AS year, {', '.join(f"{r(f'quantile_cont(target, {p / 100})', 6)} AS p{p}" for p in (50, 90, 95, 99))}, count(*) FILTER (WHERE target > 1) AS disasters
FROM sc WHERE w < 0 AND target IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    d = scored(spark, sf).where("w < 0 and target is not null").withColumn("year", F.year("date").cast("long"))
    from panelwright.operators.xsection import CrossSection

    # A year pools every code of its dates, so the exact quantiles use the split plan.
    xs = CrossSection(scale_of(spark, sf).pooled())
    qs = {f"p{p}": p / 100 for p in (50, 90, 95, 99)}
    t = xs.quantile_table(d, "target", qs, ["year"])
    n = d.groupBy("year").agg(F.count(F.when(F.col("target") > 1, 1)).alias("disasters"))
    return t.join(n, "year").select("year", "disasters", *_cols(t, list(qs), 6))


@query("e_17_lag_persistence", on_scored(f"""
SELECT CAST(k AS BIGINT) AS lag, {r('avg(c)', 6)} AS mean_ic, count(c) AS days FROM (
  SELECT k, date, {scorr('a', 'b')} AS c FROM (SELECT k, date, {avg_rank('score', 'k, date')} AS a, {avg_rank('past', 'k, date')} AS b FROM lp) GROUP BY k, date) GROUP BY k""",
    "lp AS (SELECT k, a.date, a.score, b.score AS past FROM sc a CROSS JOIN (SELECT unnest([1, 5, 20]) AS k) JOIN sc b ON a.code = b.code AND b.ord = a.ord - k)"))
def _(spark, sf):
    d = E.lag_persistence(scored(spark, sf), "score", (1, 5, 20), cross_section(spark, sf))
    return d.select(F.col("lag").cast("long").alias("lag"), rounded("mean_ic", 6).alias("mean_ic"), "days")
