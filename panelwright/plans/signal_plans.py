"""Signals: blends, toggles, stitching, event streams and side states."""

from pyspark.sql import functions as F

from panelwright.operators import features as X
from panelwright.operators import signals as G
from panelwright.operators import timeseries as ts
from panelwright.operators.attribution import PARTS, parts_by_age
from panelwright.plans import feature_plans as FP
from panelwright.plans.common import KS, keyed, keyed_sql
from panelwright.plans.registry import query
from panelwright.plans.sql import FINS_CTES, day, ewma, on_events, on_scored, pct_rank, r
from panelwright.plans.window_plans import W, _roll
from panelwright.sources.panels import cross_section, events, scored, stable

CR = FP.CR


@query("g_01_smoothed_momentum", on_scored(keyed_sql("sc", score="score")))
def _(spark, sf):
    return keyed(scored(spark, sf), score="score")


_G2 = {"momentum": "mom", "middle": "p60", "long": "p250", "even_short": "(mom + p20) / 2", "even_middle": "(mom + p60) / 2", "even_long": "(mom + p250) / 2",
       "even_safe": "(mom + ps) / 2", "tilt": "mom + p60 / 4", "product": "mom * (1 + p60 / 2)", "three": "mom / 2 + p60 / 4 + p250 / 4"}
_PROX = f"""g1 AS (SELECT *, product(factor) OVER ({W} ROWS UNBOUNDED PRECEDING) AS cf FROM sc),
g2 AS (SELECT *, high / cf AS sh, close / cf AS scl FROM g1),
g3 AS (SELECT *, close / ({_roll('max({x})', 'high', 20)}) AS a, close / ({_roll('max({x})', 'high', 60)}) AS b, close / ({_roll('max({x})', 'high', 104, 52)}) AS c, scl / ({_roll('max({x})', 'sh', 104)}) AS s FROM g2),
g4 AS (SELECT *, {CR('a')} AS p20, {CR('b')} AS p60, {CR('c')} AS p250, {CR('s')} AS ps FROM g3)"""


@query("g_02_blend_family", on_scored("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {KS}, '{k}' AS trial, {r('y')} AS score FROM {ewma(v, 0.25, 'g4')}" for k, v in _G2.items()) + ")", _PROX))
def _(spark, sf):
    xs = cross_section(spark, sf)
    d = X.high_proximity(X.split_safe(scored(spark, sf)), {"p20": (20, 20), "p60": (60, 60), "p250": (104, 52)})
    d = X.high_proximity(d, {"ps": (104, 104)}, "s_close", "s_high")
    for c in ("p20", "p60", "p250", "ps"):
        d = xs.centered_rank(d, c, f"{c}_r")
    trials = G.blends("mom", "p20_r", "p60_r", "p250_r", "ps_r")
    d = d.withColumns({f"t_{k}": trials[k] for k in _G2})
    d = G.smooth_all(d, [f"t_{k}" for k in _G2])
    d = d.unpivot(["date", "code"], [f"t_{k}" for k in _G2], "trial", "score")
    return keyed(d.withColumn("trial", F.substring("trial", 3, 20)), keep=["trial"], score="score")


_TOG = f"""t0 AS (SELECT *, ph IS NOT NULL AS ha, pl IS NOT NULL AS la, CASE WHEN ph IS NOT NULL THEN greatest(scl / ph - 1, 0) END AS hxx, CASE WHEN pl IS NOT NULL THEN greatest(pl / scl - 1, 0) END AS lxx FROM en),
t1 AS (SELECT *, {CR('hxx')} AS hk, {CR('lxx')} AS lk FROM t0),
t2 AS (SELECT *, CASE WHEN mom > 0 AND ha THEN greatest(0.5 * mom + 0.5 * hk, 0) ELSE mom END AS high_side, CASE WHEN mom < 0 AND la THEN least(0.5 * mom - 0.5 * lk, 0) ELSE mom END AS low_side,
  CASE WHEN mom > 0 AND ha THEN greatest(0.5 * mom + 0.5 * hk, 0) WHEN mom < 0 AND la THEN least(0.5 * mom - 0.5 * lk, 0) ELSE mom END AS both_sides FROM t1)"""


@query("g_03_breakout_toggles", on_events(keyed_sql("t2", high_side="high_side", low_side="low_side", both_sides="both_sides"), _TOG))
def _(spark, sf):
    xs, d = cross_section(spark, sf), events(spark, sf)
    d = xs.centered_rank(xs.centered_rank(d, "new_high_excess", "hk"), "new_low_excess", "lk")
    t = G.sided_momentum("mom", "hk", "lk")
    return keyed(d, high_side=t["high"], low_side=t["low"], both_sides=t["both"])


@query("g_04_breakout_base", on_events(keyed_sql("en", plain="hp - lp",
    high_side="CASE WHEN he THEN greatest(0.5 * hp + 0.5 * mom, 0) ELSE hp END - lp", low_side="hp + CASE WHEN le THEN least(-0.5 * lp + 0.5 * mom, 0) ELSE -lp END",
    both_sides="CASE WHEN he THEN greatest(0.5 * hp + 0.5 * mom, 0) ELSE hp END + CASE WHEN le THEN least(-0.5 * lp + 0.5 * mom, 0) ELSE -lp END")))
def _(spark, sf):
    return keyed(events(spark, sf), plain="breakout", high_side="breakout_high", low_side="breakout_low", both_sides="breakout_both")


_NH = f"""nh0 AS (SELECT *, CASE WHEN he THEN -mom END AS c FROM en),
nh AS (SELECT *, {pct_rank('c')} AS er FROM nh0), nh2 AS (SELECT *, CASE WHEN he THEN 0.5 + 0.5 * er ELSE hp - lp END AS comb FROM nh)"""


@query("g_05_contrarian_replacement", on_events(f"""
SELECT n.d AS date, n.c AS code, {r('n.er')} AS event_rank, {r('n.comb')} AS combined, {r('y.y')} AS score FROM (SELECT {day()} AS d, code AS c, date AS dd, er, comb FROM nh2) n
JOIN {ewma('comb', 0.25, 'nh2')} y ON y.date = n.dd AND y.code = n.c""", _NH))
def _(spark, sf):
    d = G.contrarian_replacement(events(spark, sf), cross_section(spark, sf), "mom", "breakout")
    d = ts.ewma(d, "combined", 0.25, "y")
    return keyed(d, event_rank="event_rank", combined="combined", score="y")


@query("g_06_channel_score", on_events(f"SELECT {KS}, {r('y')} AS score, {r('abs(y)')} AS absolute FROM {ewma('ch', 0.25, 'chn')}",
    f"chn AS (SELECT date, code, seg, coalesce(2 * (lag(scl) OVER ({W}) - pl) / (ph - pl) - 1, 0) AS ch FROM en)"))
def _(spark, sf):
    d = X.channel_position(events(spark, sf), 8).withColumn("ch", F.coalesce("channel", F.lit(0.0)))
    return keyed(ts.ewma(d, "ch", 0.25, "y"), score="y", absolute=F.abs("y"))


_STITCH = f"""w0 AS (SELECT s.*, {r('(f.D + f.W + f.F) / 3', 10)} AS fd, CASE WHEN s.mom_sum IS NOT NULL THEN -s.mom END AS nm FROM sc s JOIN dwf f ON f.date = s.date AND f.code = s.code),
w1 AS (SELECT *, {r(f"fd * coalesce({pct_rank('nm')}, 0)", 10)} AS risk2, CASE WHEN mom_sum IS NOT NULL AND {pct_rank('mom_sum')} <= 0.2 THEN 1 ELSE 0 END AS crash,
  row_number() OVER (PARTITION BY date ORDER BY score, code) AS rl, count(*) OVER (PARTITION BY date) AS n FROM w0),
w2 AS (SELECT *, rl <= floor(0.6::DOUBLE * (n - 1) + 1) AS rest, floor(0.4::DOUBLE * (n - 1) + 1) AS ks FROM w1),
w3 AS (SELECT *, row_number() OVER (PARTITION BY date, rest ORDER BY fd DESC, rl, code) AS p1, row_number() OVER (PARTITION BY date, rest ORDER BY risk2 DESC, rl, code) AS p2,
  row_number() OVER (PARTITION BY date, rest ORDER BY crash, risk2 DESC, rl, code) AS p3 FROM w2),
w4 AS (SELECT *, row_number() OVER (PARTITION BY date, rest AND p3 > ks ORDER BY rl, code) AS pm FROM w3)"""


def _stitch_inputs(spark, sf):
    xs = cross_section(spark, sf)
    base = FP._base(spark, sf, scored(spark, sf), ("mom", "mom_sum", "score"))
    d = FP.deterioration(spark, sf, base).select("date", "code", "mom", "mom_sum", "score", stable(F.col("fd_equal")).alias("fd"))
    d = d.withColumn("_nm", F.when(F.col("mom_sum").isNotNull(), -F.col("mom")))
    d = xs.pct_rank(d, "_nm", "weak", missing=0).withColumn("risk2", stable(F.col("fd") * F.col("weak")))
    d = xs.pct_rank(d, "mom_sum", "_mp")
    return d.withColumn("crash", (F.coalesce(F.col("_mp") <= 0.2, F.lit(False))).cast("int"))


@query("g_10_score_stitching", on_scored(f"""
SELECT {KS}, {r('((CASE WHEN rest THEN p1 ELSE rl END) - 1) / (n - 1)')} AS t1, {r('((CASE WHEN rest THEN p2 ELSE rl END) - 1) / (n - 1)')} AS t2,
 {r('((CASE WHEN NOT rest THEN rl WHEN p3 <= ks THEN p3 ELSE pm + ks END) - 1) / (n - 1)')} AS t3 FROM w4 WHERE n > 1""",
    FINS_CTES, FP._SEEN, FP._state("cf", FP._CFO), FP._state("n", FP._NC), FP._DWF, _STITCH))
def _(spark, sf):
    xs, d = cross_section(spark, sf), _stitch_inputs(spark, sf)
    d = G.stitch(d, xs, "score", "fd", "t1")
    d = G.stitch(d, xs, "score", "risk2", "t2")
    d = G.stitch(d, xs, "score", "risk2", "t3", crash="crash")
    return keyed(d, t1="t1", t2="t2", t3="t3")


_RISK_NAMES = ("profit_risk", "balance_risk", "multi_risk")
_RISK_STITCH = f"""rs0 AS (SELECT s.date, s.code, {', '.join(f'{r(c, 10)} AS {n}' for n, c in zip(_RISK_NAMES, ('x.pr', 'x.br', '(x.fde + x.pr + x.br) / 3')))},
  row_number() OVER (PARTITION BY s.date ORDER BY s.score, s.code) AS rl, count(*) OVER (PARTITION BY s.date) AS n FROM sc s JOIN ({FP._RISK_SQL}) x ON x.date = s.date AND x.code = s.code),
rs1 AS (SELECT *, rl <= floor(0.6::DOUBLE * (n - 1) + 1) AS rest FROM rs0),
rs AS (SELECT *, {', '.join(f'row_number() OVER (PARTITION BY date, rest ORDER BY {n} DESC, rl, code) AS p_{n}' for n in _RISK_NAMES)} FROM rs1)"""


@query("g_10_risk_stitching", on_scored(f"SELECT {KS}, {', '.join(f'{r(f'((CASE WHEN rest THEN p_{n} ELSE rl END) - 1) / (n - 1)')} AS {n}' for n in _RISK_NAMES)} FROM rs WHERE n > 1",
    FINS_CTES, FP._SEEN, *[FP._state(f"{k}_", f"CASE WHEN assets > 0 THEN {c} / assets END") for k, c in FP._METRICS.items()],
    FP._state("cf", FP._CFO), FP._state("n", FP._NC), FP._DWF, FP._RISKS, _RISK_STITCH))
def _(spark, sf):
    """The long ranking kept on top, the rest ordered by each of the three composite risks."""
    xs, base = cross_section(spark, sf), FP._base(spark, sf, scored(spark, sf), ("score",))
    d = FP.risk_composites(spark, sf, base, ["score"]).withColumns({n: stable(F.col(n)) for n in _RISK_NAMES})
    for n in _RISK_NAMES:
        d = G.stitch(d, xs, "score", n, f"t_{n}")
    return keyed(d, **{n: f"t_{n}" for n in _RISK_NAMES})


@query("g_11_signed_event_score", on_events(keyed_sql("(SELECT *, CASE WHEN he THEN mom END AS hm, CASE WHEN le THEN -mom END AS lm FROM en)",
    x=f"coalesce(0.5 + 0.5 * {pct_rank('hm')}, 0) - coalesce(0.5 + 0.5 * {pct_rank('lm')}, 0)")))
def _(spark, sf):
    d = events(spark, sf).withColumn("neg_mom", -F.col("mom"))
    return keyed(G.signed_event_score(d, cross_section(spark, sf), {"high": "mom", "low": "neg_mom"}, "x"), x="x")


@query("g_12_event_blend", on_events(keyed_sql("nh", half="CASE WHEN he THEN 0.5 * (hp - lp) + 0.5 * (0.5 + 0.5 * er) ELSE hp - lp END", full="CASE WHEN he THEN 0.5 + 0.5 * er ELSE hp - lp END"), _NH.split(", nh2")[0]))
def _(spark, sf):
    d = G.contrarian_replacement(events(spark, sf), cross_section(spark, sf), "mom", "breakout")
    d = d.withColumn("er", 0.5 + 0.5 * F.col("event_rank"))
    return keyed(d, half=G.event_blend("breakout", "er", G.is_event("high"), 0.5), full=G.event_blend("breakout", "er", G.is_event("high"), 1.0))


@query("g_12_two_sided_blend", on_events(keyed_sql(f"""(SELECT *, CASE WHEN he THEN 0.5 + 0.5 * coalesce({pct_rank('hq')}, 0) WHEN le THEN -(0.5 + 0.5 * coalesce({pct_rank('lq')}, 0)) ELSE hp - lp END AS er
 FROM (SELECT *, CASE WHEN he THEN mom END AS hq, CASE WHEN le THEN -mom END AS lq FROM en))""",
    **{f"share_{s}": f"CASE WHEN he OR le THEN {1 - s / 100} * (hp - lp) + {s / 100} * er ELSE hp - lp END" for s in (0, 50, 100)})))
def _(spark, sf):
    """Both sides' events blended with the signed percentile of a prediction, at three shares."""
    d = events(spark, sf).withColumn("neg_mom", -F.col("mom"))
    d = G.signed_event_score(d, cross_section(spark, sf), {"high": "mom", "low": "neg_mom"}, "er")
    active = G.is_event("high") | G.is_event("low")
    return keyed(d, **{f"share_{s}": G.event_blend("breakout", "er", active, s / 100) for s in (0, 50, 100)})


@query("g_13_side_separation", on_events(keyed_sql("en", high_state="hs", low_state="ls", d_score="dsc", side_score="sn")))
def _(spark, sf):
    return keyed(events(spark, sf), high_state="high_state", low_state="low_state", d_score="sum_score", side_score="side_score")


@query("g_13_rebuild_from_base", on_events(f"SELECT {day('n.date')} AS date, n.code, {r('CASE WHEN n.ls < 0 THEN n.ls WHEN n.ls = 0 AND n.hs > 0 THEN n.hs ELSE n.hs + n.ls END')} AS score FROM en n"))
def _(spark, sf):
    """Recover the event stream from the stored smooth, then rebuild the side score."""
    d = ts.ewma(events(spark, sf).select("date", "code", "seg", "ord", "raw"), "raw", 0.25, "base")
    d = d.withColumn("raw2", ts.inverse_ewma("base", 0.25))
    return keyed(G.side_states(d, "raw2"), score=G.side_separation())


@query("g_14_low_no_carry", on_events(f"SELECT {day('n.date')} AS date, n.code, {r('n.hs + CASE WHEN i = 0 THEN n.lr ELSE 0.25 * n.lr END')} AS score FROM (SELECT *, row_number() OVER ({W}) - 1 AS i FROM en) n"))
def _(spark, sf):
    return keyed(G.low_without_carry(events(spark, sf)), score="no_carry")


AGE = """ag0 AS (SELECT *, row_number() OVER ({w}) = 1 AS first FROM en),
ag1 AS (SELECT *, CASE WHEN first THEN hr ELSE 0.25 * hr END AS h0, {h} AS h14, CASE WHEN first THEN lr ELSE 0.5 * lr END AS l0, {l} AS l14 FROM ag0),
ag AS (SELECT *, hs - h0 - h14 AS h5, ls - l0 - l14 AS l5 FROM ag1)""".format(
    w=W, h=" + ".join(f"coalesce(0.25 * pow(0.75::DOUBLE, {k}) * lag(hr, {k}) OVER ({W}), 0)" for k in range(1, 5)),
    l=" + ".join(f"coalesce(0.5 * pow(0.5::DOUBLE, {k}) * lag(lr, {k}) OVER ({W}), 0)" for k in range(1, 5)))


@query("g_15_high_age_veto", on_events(f"""
SELECT {KS}, row_number() OVER (PARTITION BY date ORDER BY veto, dsc, code) AS score FROM (
 SELECT *, r5 > greatest(abs(round(h0, 10)), abs(round(h14, 10)), abs(round(l0, 10)), abs(round(l14, 10)), abs(round(l5, 10))) AS veto FROM (SELECT *, abs(round(h5, 10)) AS r5 FROM ag))""", AGE))
def _(spark, sf):
    d = parts_by_age(events(spark, sf))
    size = lambda part: F.abs(F.round(part, 10))
    veto = size("old_high") > F.greatest(*[size(p) for p in PARTS if p != "old_high"])
    d = cross_section(spark, sf).position(d.withColumn("veto", veto), ["veto", "sum_score", "code"], "score")
    return keyed(d, keep=[F.col("score").cast("long").alias("score")])


@query("g_16_state_expiry", on_events(keyed_sql("(SELECT *, CASE WHEN ls < 0 AND lage > 20 THEN 0 ELSE ls END AS l2 FROM en)", score="CASE WHEN l2 < 0 THEN l2 WHEN l2 = 0 AND hs > 0 THEN hs ELSE hs + l2 END")))
def _(spark, sf):
    d = events(spark, sf).withColumn("l2", G.expire_low("low_state", "low_age", 20))
    return keyed(d, score=G.side_separation("high_state", "l2"))


@query("g_17_short_scaling", on_scored(keyed_sql("sc", 10, half="CASE WHEN w < 0 THEN 0.5 * w ELSE w END", none="CASE WHEN w < 0 THEN 0 ELSE w END")))
def _(spark, sf):
    return keyed(scored(spark, sf), 10, half=G.scale_short("w", 0.5), none=G.scale_short("w", 0.0))


@query("g_18_fixed_long_path", on_scored(f"""
SELECT {day('a.date')} AS date, a.code, {r('CASE WHEN a.w > 0 THEN a.w ELSE coalesce(s.w, 0) END', 10)} AS weight FROM
 (SELECT *, row_number() OVER (PARTITION BY date, w > 0 ORDER BY volume DESC, score, code) AS k FROM sc WHERE w IS NOT NULL) a
 LEFT JOIN (SELECT date, w, row_number() OVER (PARTITION BY date ORDER BY w, code) AS k FROM sc WHERE w < 0) s ON s.date = a.date AND s.k = a.k AND a.w <= 0"""))
def _(spark, sf):
    d = G.fixed_long_path(scored(spark, sf).where("w is not null"), cross_section(spark, sf), "w", "score", "volume", "weight")
    return keyed(d, 10, weight="weight")
