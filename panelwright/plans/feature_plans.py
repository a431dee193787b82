"""Feature compositions over the panel."""

from pyspark.sql import functions as F

from panelwright.functions.scalar import day_text, positive, ratio, rounded
from panelwright.operators import asof as A
from panelwright.operators import disclosures as DS
from panelwright.operators import features as X
from panelwright.operators import timeseries as ts
from panelwright.plans.common import KS, keyed, keyed_sql
from panelwright.plans.registry import query
from panelwright.plans.sql import (ATTR_CTES, FINS_CTES, MACRO_CTES, centered, day, ewma, on_panel, pct_rank, r)
from panelwright.plans.window_plans import W, _frame, _roll
from panelwright.sources.panels import (cross_section, disclosures, macro_series, panel, scale_of, stage, with_attributes)

CR = lambda x, by="date": f"coalesce({centered(x, by)}, 0)"


def _pa(spark, sf):
    return with_attributes(panel(spark, sf), spark, sf)


def _safe(spark, sf):
    return X.split_safe(panel(spark, sf))


@query("f_01_market_residual", on_panel(keyed_sql("pan", x="ret - beta * mkt")))
def _(spark, sf):
    return keyed(panel(spark, sf), x="resid")


_WINS = (5, 10, 20, 60)


@query("f_02_residual_momentum", on_panel(keyed_sql("m1", **{f"res{w}s1": CR(f"s{w}") for w in _WINS}),
    "m1 AS (SELECT *, " + ", ".join(f"{_roll('sum({x})', 'resid', w, skip=1)} AS s{w}" for w in _WINS) + " FROM pan)"))
def _(spark, sf):
    d = X.momentum_family(_pa(spark, sf), cross_section(spark, sf))
    return keyed(d, **{f"res{w}s1": f"res{w}s1" for w in _WINS})


_VAR = {"res20s0": ("resid", 20, 0), "res20s2": ("resid", 20, 2), "raw20s1": ("ret", 20, 1), "sector20s1": ("sr", 20, 1)}


@query("f_03_momentum_variants", on_panel(keyed_sql("m2", **{k: CR(f"v_{k}") for k in _VAR}), ATTR_CTES,
    "m1 AS (SELECT *, resid - avg(resid) OVER (PARTITION BY date, sector17) AS sr FROM pa)",
    "m2 AS (SELECT *, " + ", ".join(f"{_roll('sum({x})', x, w, skip=s)} AS v_{k}" for k, (x, w, s) in _VAR.items()) + " FROM m1)"))
def _(spark, sf):
    d = X.momentum_family(_pa(spark, sf), cross_section(spark, sf))
    return keyed(d, **{k: k for k in _VAR})


@query("f_04_equal_mean", on_panel(keyed_sql("m1", x=f"({CR('s5')} + {CR('s20')} + {CR('s60')}) / 3"),
    "m1 AS (SELECT *, " + ", ".join(f"{_roll('sum({x})', 'resid', w, skip=1)} AS s{w}" for w in _WINS) + " FROM pan)"))
def _(spark, sf):
    return keyed(X.momentum_family(_pa(spark, sf), cross_section(spark, sf)), x="equal_mean")


_MED = "quantile_cont({x}, 0.5)"
_LIQ = f"""lq AS (SELECT *, ln({_roll(_MED, 'turnover', 60)}) AS liq_level, ln(({_roll(_MED, 'turnover', 5)}) / ({_roll(_MED, 'turnover', 60)})) AS liq_shock,
 ln(volume / ({_roll(_MED, 'volume', 60)})) AS vol_shock FROM pan)"""


@query("f_05_liquidity", on_panel(keyed_sql("lq", liq_level="liq_level", liq_shock="liq_shock", vol_shock="vol_shock",
                                            level_rank=CR("liq_level"), shock_rank=CR("liq_shock"), volume_rank=CR("vol_shock")), _LIQ))
def _(spark, sf):
    xs, d = cross_section(spark, sf), X.liquidity_state(panel(spark, sf))
    for src, out in (("liq_level", "level_rank"), ("liq_shock", "shock_rank"), ("vol_shock", "volume_rank")):
        d = xs.centered_rank(d, src, out)
    names = ["liq_level", "liq_shock", "vol_shock", "level_rank", "shock_rank", "volume_rank"]
    return keyed(d, **{c: c for c in names})


@query("f_07_impact_historical", on_panel(keyed_sql("im", pwv=CR("u"), vwp=CR("v")),
    f"im0 AS (SELECT *, abs(resid) AS o, {_roll('avg(abs({x}))', 'resid', 60, skip=1)} AS h FROM pan)",
    "im AS (SELECT *, CASE WHEN o - h IS NOT NULL THEN greatest(o - h, 0) END AS u, CASE WHEN o - h IS NOT NULL THEN greatest(h - o, 0) END AS v FROM im0)"))
def _(spark, sf):
    d = X.impact_inputs(_pa(spark, sf))
    d = X.impact_ranks(d, cross_section(spark, sf), "historical")
    return keyed(d, pwv="pwv", vwp="vwp")


_INTRA = "it AS (SELECT *, am_close / am_open - 1 AS am, pm_close / pm_open - 1 AS pm, (high - low) / open AS rg, ln(pm_volume / am_volume) AS vr FROM pan)"


@query("f_08_intraday", on_panel(keyed_sql("it", am=CR("am"), pm=CR("pm"), range_rank=CR("rg"), ratio_rank=CR("vr")), _INTRA))
def _(spark, sf):
    xs, d = cross_section(spark, sf), X.intraday(panel(spark, sf))
    for src, out in (("am_ret", "am"), ("pm_ret", "pm"), ("range_ratio", "range_rank"), ("volume_log_ratio", "ratio_rank")):
        d = xs.centered_rank(d, src, out)
    return keyed(d, am="am", pm="pm", range_rank="range_rank", ratio_rank="ratio_rank")


@query("f_09_interactions", on_panel(keyed_sql("it2", 10, m_pwv="m * u", m_vwp="m * v", m_liq="m * l", m_vol="m * vl", vwp_intraday="v * (p0 - a0)"),
    _INTRA, _LIQ.replace("FROM pan", "FROM it"),
    f"im0 AS (SELECT *, abs(resid) AS o, {_roll('avg(abs({x}))', 'resid', 60, skip=1)} AS h, {_roll('sum({x})', 'resid', 4, skip=1)} AS s4 FROM lq)",
    "im AS (SELECT *, CASE WHEN o - h IS NOT NULL THEN greatest(o - h, 0) END AS uu, CASE WHEN o - h IS NOT NULL THEN greatest(h - o, 0) END AS vv FROM im0)",
    f"it2 AS (SELECT date, code, {CR('s4')} AS m, {CR('uu')} AS u, {CR('vv')} AS v, {CR('liq_shock')} AS l, {CR('vol_shock')} AS vl, {CR('am')} AS a0, {CR('pm')} AS p0 FROM im)"))
def _(spark, sf):
    xs = cross_section(spark, sf)
    d = X.intraday(X.impact_inputs(_pa(spark, sf)))
    d = X.relative_strength(d, xs, 4, out="mom")
    d = X.impact_ranks(d, xs, "historical")
    for src, out in (("liq_shock", "liq"), ("vol_shock", "vol"), ("am_ret", "am"), ("pm_ret", "pm")):
        d = xs.centered_rank(d, src, out)
    names = ["m_pwv", "m_vwp", "m_liq", "m_vol", "vwp_intraday"]
    return keyed(X.interactions(d), 10, **{c: c for c in names})


_SAFE = f"""ss0 AS (SELECT *, product(factor) OVER ({W} ROWS UNBOUNDED PRECEDING) AS cf FROM pan),
ss AS (SELECT *, open / cf AS so, high / cf AS sh, low / cf AS sl, close / cf AS scl, volume * cf AS sv FROM ss0)"""


@query("f_10_split_safe_prices", on_panel(keyed_sql("ss", cum_factor="cf", high="sh", low="sl", close="scl"), _SAFE))
def _(spark, sf):
    return keyed(_safe(spark, sf), cum_factor="cum_factor", high="s_high", low="s_low", close="s_close")


@query("f_11_split_safe_volume", on_panel(keyed_sql("ss", volume="sv"), _SAFE))
def _(spark, sf):
    return keyed(_safe(spark, sf), volume="s_volume")


_PX = {"prox20": (20, 20), "prox60": (60, 60), "prox120": (120, 60)}


@query("f_12_high_proximity", on_panel(keyed_sql("px", **{k: f"{k}" for k in _PX}, **{f"{k}_rank": CR(k) for k in _PX}, safe="safe", safe_rank=CR("safe")), _SAFE,
    "px AS (SELECT *, " + ", ".join(f"close / ({_roll('max({x})', 'high', w, n)}) AS {k}" for k, (w, n) in _PX.items()) + f", scl / ({_roll('max({x})', 'sh', 60)}) AS safe FROM ss)"))
def _(spark, sf):
    xs, d = cross_section(spark, sf), X.high_proximity(_safe(spark, sf), _PX)
    d = X.high_proximity(d, {"safe": (60, 60)}, "s_close", "s_high")
    for k in (*_PX, "safe"):
        d = xs.centered_rank(d, k, f"{k}_rank")
    return keyed(d, **{c: c for k in (*_PX, "safe") for c in (k, f"{k}_rank")})


BW = 52
_BRK = _SAFE + f""", bk0 AS (SELECT *, {_roll('max({x})', 'sh', BW, skip=1)} AS ph, {_roll('min({x})', 'sl', BW, skip=1)} AS pl FROM ss),
bk AS (SELECT *, CASE WHEN ph IS NOT NULL THEN greatest(0, scl / ph - 1) END AS he, CASE WHEN pl IS NOT NULL THEN greatest(0, pl / scl - 1) END AS le,
       ph IS NOT NULL AS ha, pl IS NOT NULL AS la FROM bk0)"""


@query("f_13_breakout", on_panel(keyed_sql("bk", keep=["ha", "la"], he="he", le="le", he_rank=CR("he"), le_rank=CR("le")), _BRK))
def _(spark, sf):
    xs, d = cross_section(spark, sf), X.breakout(_safe(spark, sf), BW)
    d = xs.centered_rank(xs.centered_rank(d, "new_high_excess", "he_rank"), "new_low_excess", "le_rank")
    return keyed(d, keep=[F.col("high_available").alias("ha"), F.col("low_available").alias("la")],
                 he="new_high_excess", le="new_low_excess", he_rank="he_rank", le_rank="le_rank")


def _tr(prev):
    return f"""tr0 AS (SELECT *, {prev} AS pc FROM ss),
tr1 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(sh - sl, abs(sh - pc), abs(sl - pc)) END AS tr FROM tr0),
trr AS (SELECT *, {_roll('avg({x})', 'tr', 20, skip=1)} AS atr FROM tr1)"""


_TR = _SAFE + ", " + _tr(f"lag(scl) OVER ({W})")


@query("f_14_true_range", on_panel(keyed_sql("trr", tr="tr", atr="atr / 1000"), _TR))
def _(spark, sf):
    return keyed(X.true_range(_safe(spark, sf)), tr="tr", atr=F.col("atr") / 1000)


_LENS = range(5, 125, 5)


def _box(root=False, skip=1):
    scale = (lambda w: f"* sqrt({w})") if root else (lambda w: "")
    parts = ",\n".join(f"{_roll('max({x})', 'sh', w, skip=skip)} AS h{w}, {_roll('min({x})', 'sl', w, skip=skip)} AS l{w}" for w in _LENS)
    pick = " ".join(f"WHEN (h{w} - l{w}) / (atr {scale(w)}) < 3 THEN {w}" for w in reversed(_LENS))
    val = lambda e: "CASE dur " + " ".join(f"WHEN {w} THEN {e.format(w=w, s=scale(w))}" for w in _LENS) + " END"
    return f"""bx0 AS (SELECT *, {parts} FROM trr),
bx1 AS (SELECT *, CASE {pick} ELSE 0 END AS dur FROM bx0),
bx AS (SELECT *, {val('(h{w} - l{w}) / (atr {s})')} AS width, {val('h{w}')} AS up, {val('l{w}')} AS lo FROM bx1)"""


@query("f_15_box", on_panel(keyed_sql("bx", duration="dur", width="width", upper="up", lower="lo"), _TR, _box()))
def _(spark, sf):
    d = X.boxes(X.true_range(_safe(spark, sf)))
    return keyed(d, duration="box_duration", width="box_width", upper="box_upper", lower="box_lower")


_BPOS = f"""bp AS (SELECT *, CASE WHEN up - lo > 0 THEN (pc - lo) / (up - lo) END AS pos, pc / ({_roll('max({x})', 'sh', BW, skip=2)}) - 1 AS dh,
 ({_roll('min({x})', 'sl', BW, skip=2)}) / pc - 1 AS dl FROM bx)"""


@query("f_16_box_position", on_panel(keyed_sql("bp", position="pos", dh="dh", dl="dl"), _TR, _box(), _BPOS))
def _(spark, sf):
    d = X.box_position(X.boxes(X.true_range(_safe(spark, sf))), BW)
    return keyed(d, position="close_position", dh="distance_to_high", dl="distance_to_low")


@query("f_17_box_root", on_panel(keyed_sql("bx", duration="dur", width="width"), _TR, _box(root=True)))
def _(spark, sf):
    d = X.boxes(X.true_range(_safe(spark, sf)), root=True)
    return keyed(d, duration="box_duration", width="box_width")


@query("f_18_box_diagnostics", on_panel(keyed_sql("bd", keep=["touches"], volume_ratio="vr", through="dur"), _TR, _box(skip=0),
    f"bd AS (SELECT *, sv / ({_roll(_MED, 'sv', 20, skip=1)}) AS vr, CAST(sum(CASE WHEN sh >= 0.9::DOUBLE * h20 THEN 1 ELSE 0 END) OVER {_frame(19)} AS BIGINT) AS touches FROM bx)"))
def _(spark, sf):
    d = X.true_range(_safe(spark, sf)).withColumns({
        "vr": ratio("s_volume", ts.roll_median("s_volume", 20, skip=1)), "_top": ts.roll_max("s_high", 20)})
    near = F.when(F.col("s_high") >= 0.9 * F.col("_top"), 1).otherwise(0)
    d = X.boxes(d.withColumn("touches", F.sum(near).over(ts.trailing(20))), skip=0)
    return keyed(d, keep=["touches"], volume_ratio="vr", through="box_duration")


@query("f_19_channel", on_panel(keyed_sql(f"(SELECT *, lag(scl) OVER ({W}) AS pc FROM bk0)", x="2 * (pc - pl) / (ph - pl) - 1"), _BRK))
def _(spark, sf):
    return keyed(X.channel_position(_safe(spark, sf), BW), x="channel")


@query("f_20_volume_change", on_panel(keyed_sql("ss", x=f"sv / lag(sv) OVER ({W}) - 1"), _SAFE))
def _(spark, sf):
    return keyed(X.volume_features(_safe(spark, sf)), x="volume_change")


@query("f_21_price_slope", on_panel(keyed_sql(f"(SELECT *, ln(scl) AS lp, CAST(row_number() OVER ({W}) AS DOUBLE) AS rn FROM ss)", x=f"10000 * ({_roll('regr_slope({x}, rn)', 'lp', 60)})"), _SAFE))
def _(spark, sf):
    return keyed(X.price_slope(_safe(spark, sf)), x="slope_bps")


@query("f_22_volume_z", on_panel(keyed_sql(f"(SELECT *, lag(sv) OVER ({W}) AS pv FROM ss)",
    x=f"(pv - ({_roll('avg({x})', 'sv', 60, skip=2)})) / nullif({_roll('stddev_pop({x})', 'sv', 60, skip=2)}, 0)"), _SAFE))
def _(spark, sf):
    return keyed(X.volume_features(_safe(spark, sf)), x="volume_z")


@query("f_23_relative_volume", on_panel(keyed_sql(f"(SELECT *, ln(sv / ({_roll(_MED, 'sv', 20, skip=1)})) AS rv FROM ss)", x="rv", rank=centered("rv")), _SAFE))
def _(spark, sf):
    d = cross_section(spark, sf).centered_rank(X.volume_features(_safe(spark, sf)), "relative_volume", "rank", missing=None)
    return keyed(d, x="relative_volume", rank="rank")


def _z(x, by="date"):
    return f"({x} - avg({x}) OVER (PARTITION BY {by})) / nullif(stddev_samp({x}) OVER (PARTITION BY {by}), 0)"


def _clip3(z):
    return f"CASE WHEN {z} IS NOT NULL THEN least(3, greatest(-3, {z})) END"


_SHARES = """ls AS (SELECT code, disclosed, arg_max(shares, number) AS shares FROM fins WHERE shares IS NOT NULL GROUP BY ALL),
sz0 AS (SELECT p.*, s.shares, -ln(p.close * s.shares) AS raw FROM pa p ASOF LEFT JOIN ls s ON p.code = s.code AND p.date >= s.disclosed),
sz1 AS (SELECT *, coalesce(raw, -size) AS filled FROM sz0)"""


@query("f_24_size", on_panel(keyed_sql(f"(SELECT *, {_z('filled')} AS z FROM sz1)",
    x=f"coalesce({_clip3('z')}, quantile_cont({_clip3('z')}, 0.5) OVER (PARTITION BY date), 0)"), ATTR_CTES, FINS_CTES, _SHARES))
def _(spark, sf):
    xs = cross_section(spark, sf)
    right = A.last_field_per_day(disclosures(spark, sf), ["code"], "disclosed", "number", ["shares"])
    d = A.asof(_pa(spark, sf), right, ["code"], "date", "disclosed", ["shares"], per_column=True)
    d = d.withColumn("raw", F.coalesce(-F.log(F.col("close") * F.col("shares")), -F.col("size")))
    return keyed(xs.fill_median(xs.zscore(d, "raw", "z"), "z", "x"), x="x")


@query("f_25_illiquidity", on_panel(keyed_sql(f"(SELECT *, {_z('il')} AS z FROM il)", x="il * 1e6", z=_clip3("z")),
    "il0 AS (SELECT *, abs(ret) / turnover AS i FROM pan)",
    "il AS (SELECT *, CASE WHEN count(i) OVER f >= 40 THEN avg(i) OVER f END AS il FROM il0 WINDOW f AS (PARTITION BY code ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"))
def _(spark, sf):
    d = X.illiquidity(panel(spark, sf), cross_section(spark, sf))
    return keyed(d, x=F.col("illiquidity") * 1e6, z="illiquidity_z")


_QV = """fq AS (SELECT code, disclosed, arg_max(cfo / assets, number) FILTER (WHERE assets IS NOT NULL) AS q1, arg_max(profit / equity, number) FILTER (WHERE equity IS NOT NULL) AS q2,
  arg_max(equity / shares, number) FILTER (WHERE equity IS NOT NULL AND shares IS NOT NULL) AS bps FROM fins GROUP BY ALL),
qv0 AS (SELECT p.date, p.code, p.close, a.q1, b.q2, c.bps / p.close AS bp FROM pan p
 ASOF LEFT JOIN (SELECT * FROM fq WHERE q1 IS NOT NULL) a ON p.code = a.code AND p.date >= a.disclosed
 ASOF LEFT JOIN (SELECT * FROM fq WHERE q2 IS NOT NULL) b ON p.code = b.code AND p.date >= b.disclosed
 ASOF LEFT JOIN (SELECT * FROM fq WHERE bps IS NOT NULL) c ON p.code = c.code AND p.date >= c.disclosed)"""
_QV += f""", qv1 AS (SELECT *, {_z('q1')} AS z1, {_z('q2')} AS z2, {_z('bp')} AS z3 FROM qv0),
qv AS (SELECT *, {_clip3('z1')} AS c1, {_clip3('z2')} AS c2, {_clip3('z3')} AS c3 FROM qv1)"""


def _quality_value(spark, sf):
    f = disclosures(spark, sf).withColumns({
        "q1": ratio("cfo", "assets"), "q2": ratio("profit", "equity"), "bps": ratio("equity", "shares")})
    right = A.last_field_per_day(f, ["code"], "disclosed", "number", ["q1", "q2", "bps"])
    d = A.asof(panel(spark, sf).select("date", "code", "close", "ret"), right, ["code"], "date", "disclosed", ["q1", "q2", "bps"], per_column=True)
    xs, d = cross_section(spark, sf), d.withColumn("bp", ratio("bps", "close"))
    for src, out in (("q1", "c1"), ("q2", "c2"), ("bp", "c3")):
        d = xs.zscore(d, src, out)
    return d


@query("f_26_quality_value", on_panel(keyed_sql("qv", c1="c1", c2="c2", c3="c3"), FINS_CTES, _QV))
def _(spark, sf):
    return keyed(_quality_value(spark, sf), c1="c1", c2="c2", c3="c3")


@query("f_27_multi_factor", on_panel(keyed_sql(
    f"(SELECT *, {_z('b1')} AS y1, {_z('c3')} AS y3 FROM (SELECT *, coalesce(c1, 0) + coalesce(c2, 0) AS b1 FROM qv))", x=f"coalesce({_clip3('y1')}, 0) + coalesce({_clip3('y3')}, 0)"), FINS_CTES, _QV))
def _(spark, sf):
    xs, d = cross_section(spark, sf), _quality_value(spark, sf)
    d = d.withColumn("b1", F.coalesce("c1", F.lit(0.0)) + F.coalesce("c2", F.lit(0.0)))
    d = xs.zscore(xs.zscore(d, "b1", "y1"), "c3", "y3")
    return keyed(d, x=F.coalesce("y1", F.lit(0.0)) + F.coalesce("y3", F.lit(0.0)))


_FIELDS = ("cfo", "assets", "profit", "equity", "shares", "forecast_eps")
_ASOF = ",\n".join(f"fb_{c} AS (SELECT code, disclosed, arg_max({c}, number) FILTER (WHERE {c} IS NOT NULL) AS {c} FROM fins GROUP BY ALL HAVING count({c}) > 0)" for c in _FIELDS)
_MEDIAN = "coalesce({x}, quantile_cont({x}, 0.5) OVER (PARTITION BY date), 0)"
_RATIOS = {"z_cap": "cap", "z_band": "band", "z_ill": "ill", "z_ca": "cfo / assets", "z_pe": "profit / equity", "z_er": "equity / assets", "z_bp": "bp", "z_fp": "forecast_eps / close"}
_FACTORS = f"""{_ASOF},
fb0 AS (SELECT p.*, {', '.join(f'j_{c}.{c}' for c in _FIELDS)}, CASE WHEN count(i) OVER f >= 40 THEN avg(i) OVER f END AS ill
  FROM (SELECT *, abs(ret) / turnover AS i FROM pa) p {' '.join(f'ASOF LEFT JOIN fb_{c} j_{c} ON p.code = j_{c}.code AND p.date >= j_{c}.disclosed' for c in _FIELDS)}
  WINDOW f AS (PARTITION BY p.code ORDER BY p.date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
fb1 AS (SELECT *, -ln(close * shares) AS cap, -size AS band, equity / shares / close AS bp FROM fb0),
fb2 AS (SELECT *, {', '.join(f'{_z(x)} AS {k}' for k, x in _RATIOS.items())} FROM fb1),
fb3 AS (SELECT date, code, {', '.join(f'{_clip3(k)} AS {k}' for k in _RATIOS)} FROM fb2),
fb4 AS (SELECT *, coalesce(z_cap, z_band) AS sz, z_ca + z_pe + z_er AS qu, z_bp + z_fp AS va FROM fb3),
fb5 AS (SELECT *, {_MEDIAN.format(x='sz')} + {_MEDIAN.format(x='z_ill')} AS sl, {_MEDIAN.format(x='qu')} AS qf, {_MEDIAN.format(x='va')} AS vf FROM fb4),
fb6 AS (SELECT *, {_z('sl')} AS y1, {_z('qf')} AS y2, {_z('vf')} AS y3 FROM fb5),
fb AS (SELECT *, {_clip3('y1')} AS b1, {_clip3('y2')} AS b2, {_clip3('y3')} AS b3 FROM fb6)"""


def _factors(spark, sf):
    right = A.last_field_per_day(disclosures(spark, sf), ["code"], "disclosed", "number", list(_FIELDS))
    d = A.asof(_pa(spark, sf).select("date", "code", "close", "ret", "turnover", "size"), right, ["code"], "date", "disclosed", list(_FIELDS), per_column=True)
    return X.factor_blocks(d, cross_section(spark, sf))


@query("f_26_all_ratios", on_panel(keyed_sql("fb1", 6, cfo_assets="cfo / assets", profit_equity="profit / equity", equity_ratio="equity / assets", book_price="bp", forecast_price="forecast_eps / close"),
    ATTR_CTES, FINS_CTES, _FACTORS))
def _(spark, sf):
    names = [*X.BLOCKS["quality"], *X.BLOCKS["value"]]
    return keyed(_factors(spark, sf), 6, **{c: c for c in names})


@query("f_27_factor_blocks", on_panel(keyed_sql("fb", 7, size_liquidity="b1", quality="b2", value="b3", score="coalesce(b1, 0) + coalesce(b2, 0) + coalesce(b3, 0)"), ATTR_CTES, FINS_CTES, _FACTORS))
def _(spark, sf):
    """Size and liquidity, quality with the equity ratio, value with the forecast yield, and their sum."""
    return keyed(_factors(spark, sf), 7, size_liquidity="block_size_liquidity", quality="block_quality", value="block_value", score="factor_score")


_REG = """rg0 AS (SELECT c.date, m.macro FROM cal c ASOF LEFT JOIN macro m ON CAST(c.date AS TIMESTAMP) >= m.available),
rg1 AS (SELECT date, CASE WHEN count(macro) OVER f >= 26 THEN (macro - avg(macro) OVER f) / nullif(stddev_samp(macro) OVER f, 0) END AS z FROM rg0
 WINDOW f AS (ORDER BY date ROWS BETWEEN 103 PRECEDING AND CURRENT ROW)),
rg AS (SELECT date, CASE WHEN z IS NOT NULL THEN least(1, greatest(-1, -least(2, greatest(-2, z)) / 2)) END AS wt FROM rg1)"""


@query("f_28_regime_blend", on_panel(f"""
SELECT {day('q.date')} AS date, q.code, {r('rg.wt')} AS regime, {r('(1 + coalesce(rg.wt, 0)) * coalesce(c1, 0) + (1 - coalesce(rg.wt, 0)) * coalesce(c3, 0)')} AS x
FROM qv q LEFT JOIN rg USING (date)""", FINS_CTES, _QV, MACRO_CTES, _REG))
def _(spark, sf):
    dates = panel(spark, sf).select("date").distinct()
    m = A.asof_unkeyed(dates, macro_series(spark, sf), "date", "available", ["macro"])
    reg = X.regime_weight(m, "macro", 104, 26).select("date", "regime")
    d = _quality_value(spark, sf).join(scale_of(spark, sf).per_date(reg), "date", "left")
    w, z = F.coalesce("regime", F.lit(0.0)), lambda c: F.coalesce(c, F.lit(0.0))
    return keyed(d, regime="regime", x=(1 + w) * z("c1") + (1 - w) * z("c3"))


@query("f_29_reversal", on_panel(keyed_sql("pan", x="coalesce(-resid, quantile_cont(-resid, 0.5) OVER (PARTITION BY date), 0)")))
def _(spark, sf):
    d = panel(spark, sf).withColumn("_neg", -F.col("resid"))
    return keyed(cross_section(spark, sf).fill_median(d, "_neg", "x"), x="x")


# -- disclosure states --------------------------------------------------------
_SEEN = """ver AS (SELECT *, split_part(document, 'FinancialStatements_', 2) AS basis, "end" - "start" AS dur FROM fins
 WHERE contains(document, 'FinancialStatements_') AND CASE period WHEN '1Q' THEN "end" - "start" BETWEEN 80 AND 100
   WHEN '2Q' THEN "end" - "start" BETWEEN 170 AND 195 WHEN '3Q' THEN "end" - "start" BETWEEN 260 AND 285 ELSE "end" - "start" BETWEEN 350 AND 380 END),
sp AS (SELECT code, seg, min(date) AS f, max(date) AS l FROM pan GROUP BY code, seg),
ev AS (SELECT ver.*, sp.seg FROM ver JOIN sp USING (code) WHERE disclosed < l AND (seg = 0 OR disclosed >= f)),
dy AS (SELECT DISTINCT code, seg, disclosed AS day FROM ev)"""


def _state(p, value, extra=""):
    """State after each disclosure day, by comparing every version with every day."""
    ex = f", arg_max({extra}, number) AS {extra}" if extra else ""
    exc = f", {extra}" if extra else ""
    key = 'code, seg, "start", "end", period, basis'
    return f"""{p}v AS (SELECT {key}, dur, disclosed, arg_max(val, number) AS val, min(number) AS nn{ex}
   FROM (SELECT *, {value} AS val FROM ev) WHERE val IS NOT NULL GROUP BY {key}, dur, disclosed),
{p}f AS (SELECT *, min(disclosed) OVER k AS fd, first_value(nn) OVER (k ORDER BY disclosed) AS fn FROM {p}v WINDOW k AS (PARTITION BY {key})),
{p}l AS (SELECT * FROM (SELECT dy.day, x.*, row_number() OVER (PARTITION BY x.code, x.seg, dy.day, x."start", x."end", x.period, x.basis ORDER BY x.disclosed DESC) AS rk
   FROM dy JOIN {p}f x ON x.code = dy.code AND x.seg = dy.seg AND x.disclosed <= dy.day) WHERE rk = 1),
{p}c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, seg, day ORDER BY "end" DESC, disclosed DESC, period DESC, fd, fn) AS pos FROM {p}l) WHERE pos = 1),
{p}p AS (SELECT * FROM (SELECT c.code, c.seg, c.day, o.val AS prev, row_number() OVER (PARTITION BY c.code, c.seg, c.day ORDER BY o."end" DESC, o.disclosed DESC, o.fd, o.fn) AS pos
   FROM {p}c c JOIN {p}l o ON o.code = c.code AND o.seg = c.seg AND o.day = c.day AND o.period = c.period AND o.basis = c.basis
    AND abs(o."start" - CAST(c."start" - INTERVAL 1 YEAR AS DATE)) <= 7 AND abs(o."end" - CAST(c."end" - INTERVAL 1 YEAR AS DATE)) <= 7 AND abs(o.dur - c.dur) <= 7) WHERE pos = 1),
{p}s AS (SELECT dy.code, dy.seg, dy.day, c.val, c.val - q.prev AS yoy, q.prev, c.disclosed AS sd, c.period, c.basis, c."start", c."end", c.disclosed = dy.day AS updated{exc and ', c.' + extra}
   FROM dy LEFT JOIN {p}c c USING (code, seg, day) LEFT JOIN {p}p q USING (code, seg, day)),
{p}j AS (SELECT p.*, s.val, s.yoy, s.sd, s.period, s.basis{exc and ', s.' + extra} FROM pan p ASOF LEFT JOIN {p}s s ON p.code = s.code AND p.seg = s.seg AND p.date > s.day)"""


_CFO = "CASE WHEN assets > 0 THEN cfo / assets END"
_NC = "CASE WHEN assets > 0 THEN (cash - (assets - equity)) / assets END"


def _live(c, sd="sd", n=450):
    return f"CASE WHEN date - {sd} BETWEEN 0 AND {n} THEN {c} END"


def _reports(spark, sf):
    return DS.report_versions(disclosures(spark, sf))


def _base(spark, sf, source=None, extra=()):
    return (panel(spark, sf) if source is None else source).select("date", "code", "ord", "seg", "close", "volume", "resid", *extra)


def _sp_cfo():
    return F.when(F.col("assets") > 0, F.col("cfo") / F.col("assets"))


def _sp_net_cash():
    return F.when(F.col("assets") > 0, (F.col("cash") - (F.col("assets") - F.col("equity"))) / F.col("assets"))


@query("f_30_cfo_state", on_panel(f"""
SELECT {KS}, {r(_live('val'))} AS cfo_assets, {r(_live('yoy'))} AS cfo_yoy, {day('sd')} AS cfo_date, coalesce(period, 'missing') AS period, coalesce(basis, 'missing') AS basis FROM cfj""",
    FINS_CTES, _SEEN, _state("cf", _CFO)))
def _(spark, sf):
    """Read from the kept states of the deterioration score, which has the same figure."""
    d = DS.metric_columns(_base(spark, sf), _metric_days(spark, sf, _CASH), ("cfo",), extra=("basis",))
    return keyed(d, keep=[day_text("cfo_date").alias("cfo_date"), F.col("cfo_period").alias("period"), F.col("cfo_basis").alias("basis")],
                 cfo_assets="cfo_value", cfo_yoy="cfo_yoy")


@query("f_31_legacy_atr", on_panel(keyed_sql("trr", atr="atr / 1000"), _SAFE, _tr(f"lag(scl) OVER ({W}) / factor")))
def _(spark, sf):
    return keyed(X.true_range(_safe(spark, sf), legacy=True), atr=F.col("atr") / 1000)


_EVT = """eb AS (SELECT *, updated AND prev IS NOT NULL AS judged, val < 0 AND prev >= 0 AS bad FROM cfs),
ef AS (SELECT *, min(CASE WHEN judged AND bad THEN day END) OVER (PARTITION BY code, seg, "start", "end", period, basis ORDER BY day) AS fb FROM eb),
eg AS (SELECT *, max(CASE WHEN judged THEN day END) OVER (PARTITION BY code, seg ORDER BY day) AS jd FROM ef),
eh AS (SELECT g.code, g.seg, g.day, CASE WHEN k.bad THEN k.fb END AS event_date FROM eg g LEFT JOIN eg k ON k.code = g.code AND k.seg = g.seg AND k.day = g.jd AND k.judged),
ei AS (SELECT p.date, p.code, p.ord, e.event_date, p.ord - (SELECT count(*) FROM cal WHERE cal.date <= e.event_date) AS age
 FROM pan p ASOF LEFT JOIN eh e ON p.code = e.code AND p.seg = e.seg AND p.date > e.day)"""


def cfo_turn_events(spark, sf):
    base, reports = _base(spark, sf), _reports(spark, sf)
    d = DS.turn_negative_events(base, reports, _sp_cfo())
    days = reports.select(F.col("disclosed").alias("event_date")).distinct()
    return DS.calendar_age(d, "event_date", "age", base.select("date", "ord").distinct(), days)


@query("f_32_cfo_turn_event", on_panel(f"""
SELECT {KS}, {day('event_date')} AS event_date, CASE WHEN event_date IS NOT NULL THEN age END AS age,
  {r('CASE WHEN event_date IS NULL THEN 0 WHEN age BETWEEN 0 AND 20 THEN 1 WHEN age > 20 AND age <= 40 THEN 0.5 WHEN age > 40 AND age <= 60 THEN 0.25 ELSE 0 END')} AS event FROM ei""",
    FINS_CTES, _SEEN, _state("cf", _CFO), _EVT))
def _(spark, sf):
    d = cfo_turn_events(spark, sf)
    return keyed(d, keep=[day_text("event_date").alias("event_date"), F.col("age").cast("long").alias("age")],
                 event=F.when(F.col("age").isNotNull(), DS.decay_steps("age")).otherwise(0.0))


_DWF = f"""dw AS (SELECT a.date, a.code, {_live('a.val', 'a.sd').replace('date -', 'a.date -')} AS v, {_live('a.yoy', 'a.sd').replace('date -', 'a.date -')} AS y, coalesce(a.period, 'missing') AS per,
  {_live('n.val', 'n.sd').replace('date -', 'a.date -')} AS nc FROM cfj a JOIN nj n ON a.date = n.date AND a.code = n.code),
dwf AS (SELECT *, coalesce({pct_rank('ny', 'date, per')}, 0) AS D, coalesce({pct_rank('nv', 'date, per')}, 0) AS W, coalesce({pct_rank('nn', 'date')}, 0) AS F
 FROM (SELECT *, -y AS ny, -v AS nv, -nc AS nn FROM dw))"""


_METRICS = {"op": "op", "ordinary": "ordinary", "profit": "profit", "equity": "equity", "cash": "cash"}
#: Both cash figures of the deterioration score, beside the metrics.
_CASH = ("cfo", "net_cash")


def _metric_days(spark, sf, names=None):
    """States of all or the named metrics and cash figures after every reporting day, kept in the panel's layout by code; named ones with their basis."""
    over = {k: F.when(F.col("assets") > 0, F.col(c) / F.col("assets")) for k, c in _METRICS.items()} | {"cfo": _sp_cfo(), "net_cash": _sp_net_cash()}
    over = {k: v for k, v in over.items() if names is None or k in names}
    wide = lambda: scale_of(spark, sf).by_code(DS.metric_reports(_reports(spark, sf), over))
    name = "metric_days" if names is None else "_".join(names) + "_days"
    return stage(spark, sf, name, lambda: DS.metric_days(_base(spark, sf), wide(), over, () if names is None else ("basis",)), ("code", "seg", "day"))


def _cash_columns(d):
    return d.withColumnsRenamed({"cfo_value": "cfo", "net_cash_value": "net_cash"})


def _cash_ranks(d, xs):
    d = d.withColumns({"_y": -F.col("cfo_yoy"), "_v": -F.col("cfo"), "_c": -F.col("net_cash")})
    d = xs.pct_rank(d, "_y", "D", ("date", "cfo_period"), 0)
    d = xs.pct_rank(d, "_v", "W", ("date", "cfo_period"), 0)
    d = xs.pct_rank(d, "_c", "F", missing=0)
    return d.withColumns({
        "fd_heavy": 0.5 * F.col("D") + 0.3 * F.col("W") + 0.2 * F.col("F"),
        "fd_equal": (1 / 3) * F.col("D") + (1 / 3) * F.col("W") + (1 / 3) * F.col("F"),
    }).drop("_y", "_v", "_c")


def deterioration(spark, sf, base=None):
    """D (change), W (level) and F (net cash) percentiles and their weighted sums, laid out by date."""
    xs = cross_section(spark, sf)
    return _cash_ranks(xs.by_date(_cash_columns(DS.metric_columns(_base(spark, sf) if base is None else base, _metric_days(spark, sf, _CASH), _CASH))), xs)


@query("f_33_deterioration", on_panel(keyed_sql("dwf", d="D", w="W", f="F", fd_heavy="0.5 * D + 0.3 * W + 0.2 * F", fd_equal="(D + W + F) / 3"),
    FINS_CTES, _SEEN, _state("cf", _CFO), _state("n", _NC), _DWF))
def _(spark, sf):
    return keyed(deterioration(spark, sf), d="D", w="W", f="F", fd_heavy="fd_heavy", fd_equal="fd_equal")


@query("f_35_recent_crash", on_panel(f"""
SELECT {KS}, CASE WHEN s IS NOT NULL AND coalesce({pct_rank('s')}, 0) <= 0.2 THEN 1 ELSE 0 END AS crash FROM (SELECT *, {_roll('sum({x})', 'resid', 5, skip=1)} AS s FROM pan)"""))
def _(spark, sf):
    return keyed(X.recent_crash(panel(spark, sf), cross_section(spark, sf)), keep=["crash"])


@query("f_36_weakness", on_panel(" UNION ALL ".join(
    f"SELECT {KS}, '{k}' AS metric, {r(_live('val'))} AS value, {r(_live('yoy'))} AS yoy, coalesce(period, 'missing') AS period FROM {k}_j" for k in _METRICS),
    FINS_CTES, _SEEN, *[_state(f"{k}_", f"CASE WHEN assets > 0 THEN {c} / assets END") for k, c in _METRICS.items()]))
def _(spark, sf):
    d = DS.metric_states(_base(spark, sf), _metric_days(spark, sf), _METRICS)
    return keyed(d, keep=["metric", "period"], value="value", yoy="yoy")


_PROFITS, _BALANCES = ("op", "ordinary", "profit"), ("equity", "cash")
_RISKS = ",\n".join(f"rk_{k} AS (SELECT date, code, -({_live('yoy')}) AS v, coalesce(period, 'missing') AS per FROM {k}_j)" for k in _PROFITS) + ",\n" + ",\n".join(
    f"rk_{k} AS (SELECT date, code, -({_live('val')}) AS v FROM {k}_j)" for k in _BALANCES) + ",\n" + ",\n".join(
    f"rp_{k} AS (SELECT date, code, coalesce({pct_rank('v', 'date, per' if k in _PROFITS else 'date')}, 0.5) AS p FROM rk_{k})" for k in _METRICS)
_RISK_SQL = "SELECT d.date, d.code, (op.p + ordinary.p + profit.p) / 3 AS pr, (equity.p + cash.p) / 2 AS br, (D + W + F) / 3 AS fde FROM dwf d " + " ".join(
    f"JOIN rp_{k} {k} ON {k}.date = d.date AND {k}.code = d.code" for k in _METRICS)


def risk_composites(spark, sf, base=None, keep=()):
    """All states where the panel lies, one shuffle to the layout by date, all ranks there."""
    xs = cross_section(spark, sf)
    d = DS.metric_columns(_base(spark, sf) if base is None else base, _metric_days(spark, sf), (*_METRICS, *_CASH))
    return X.risk_composites(_cash_ranks(xs.by_date(_cash_columns(d)), xs), xs, _PROFITS, _BALANCES, keep)


@query("f_36_risk_composites", on_panel(keyed_sql(f"({_RISK_SQL})", profit_risk="pr", balance_risk="br", multi_risk="(fde + pr + br) / 3"),
    FINS_CTES, _SEEN, *[_state(f"{k}_", f"CASE WHEN assets > 0 THEN {c} / assets END") for k, c in _METRICS.items()], _state("cf", _CFO), _state("n", _NC), _DWF, _RISKS))
def _(spark, sf):
    """Falling profits within a period, low balances, and their mean with the deterioration score."""
    d = risk_composites(spark, sf)
    return keyed(d, profit_risk="profit_risk", balance_risk="balance_risk", multi_risk="multi_risk")


@query("f_37_yield_accrual", on_panel(f"""
SELECT {day('y.date')} AS date, y.code, {r(_live('y.val / (y.close * y.shares)', 'y.sd').replace('date -', 'y.date -'), 10)} AS cfo_yield, {r(_live('a.val', 'a.sd').replace('date -', 'a.date -'), 10)} AS accrual
FROM yj y JOIN acj a ON y.date = a.date AND y.code = a.code""", FINS_CTES, _SEEN,
    _state("y", "CASE WHEN shares > 0 THEN cfo * 365.0::DOUBLE / dur END", "shares"), _state("ac", "CASE WHEN assets > 0 THEN (profit - cfo) / assets END")))
def _(spark, sf):
    reports = _reports(spark, sf)
    annual = F.when(F.col("shares") > 0, F.col("cfo") * 365.0 / F.col("days"))
    accrual = F.when(F.col("assets") > 0, (F.col("profit") - F.col("cfo")) / F.col("assets"))
    d = DS.report_state(_base(spark, sf), reports, annual, "annual_cfo", previous=False, extra=("shares",))
    d = DS.report_state(d, reports, accrual, "accrual", previous=False)
    return keyed(d, 10, cfo_yield=ratio("annual_cfo", F.col("close") * F.col("annual_cfo_shares")), accrual="accrual")


@query("f_38_lottery", on_panel(keyed_sql("pan", max20=_roll("max({x})", "resid", 20, skip=1), vol20=_roll("stddev_samp({x})", "resid", 20, skip=1))))
def _(spark, sf):
    return keyed(X.lottery(panel(spark, sf)), max20="max_resid", vol20="idio_vol")


_RATE = """shv AS (SELECT f.code, sp.seg, f.disclosed, arg_max(f.shares, f.number) AS shares FROM fins f JOIN (SELECT code, seg, min(date) AS f, max(date) AS l FROM pan GROUP BY 1, 2) sp ON sp.code = f.code
  WHERE contains(document, 'FinancialStatements_') AND shares > 0 AND f.disclosed < sp.l AND (sp.seg = 0 OR f.disclosed >= sp.f) GROUP BY ALL),
tor AS (SELECT p.*, CASE WHEN p.date - s.disclosed BETWEEN 0 AND 450 THEN p.volume / s.shares END AS rate FROM pan p ASOF LEFT JOIN shv s ON p.code = s.code AND p.seg = s.seg AND p.date > s.disclosed)"""


def turnover_rate(spark, sf):
    d = DS.disclosed_shares(panel(spark, sf).select("date", "code", "ord", "seg", "volume", "ret", "resid", "target"), disclosures(spark, sf))
    return d.withColumn("rate", ratio(positive("volume"), "shares"))


@query("f_39_turnover_rate", on_panel(keyed_sql("tor", 12, rate="rate"), FINS_CTES, _RATE))
def _(spark, sf):
    return keyed(turnover_rate(spark, sf), 12, rate="rate")


@query("f_40_information_vectors", on_panel(keyed_sql(
    f"(SELECT *, list(rate) OVER {_frame(20)} AS a, count(rate) OVER {_frame(20)} AS ca, list(ret) OVER {_frame(20)} AS b, count(ret) OVER {_frame(20)} AS cb FROM tor)",
    rate_0="CASE WHEN ca = 21 THEN a[21] END * 1000", rate_20="CASE WHEN ca = 21 THEN a[1] END * 1000", rate_low="CASE WHEN ca = 21 THEN list_sort(a)[1] END * 1000",
    raw_0="CASE WHEN cb = 21 THEN b[21] END", raw_mean="CASE WHEN cb = 21 THEN list_avg(b) END", raw_high="CASE WHEN cb = 21 THEN list_sort(b)[21] END"), FINS_CTES, _RATE))
def _(spark, sf):
    d = X.information_vectors(turnover_rate(spark, sf), {"rate": "rate", "raw": "ret"})
    at = lambda c, i: F.get(c, F.lit(i))
    mean = F.aggregate("raw_time", F.lit(0.0), lambda s, v: s + v) / 21
    return keyed(d, rate_0=at("rate_time", 0) * 1000, rate_20=at("rate_time", 20) * 1000, rate_low=at("rate_sorted", 0) * 1000,
                 raw_0=at("raw_time", 0), raw_mean=mean, raw_high=at("raw_sorted", 20))


@query("f_41_abnormal_turnover", on_panel(keyed_sql(
    f"(SELECT *, lr - ({_roll(_MED, 'lr', 60, skip=1)}) AS ab FROM (SELECT *, ln(rate + 1e-12) AS lr FROM tor))",
    abnormal="ab", signed="ab * sign(resid)", up="CASE WHEN resid > 0 THEN ab WHEN resid IS NOT NULL THEN 0 END",
    down="CASE WHEN resid < 0 THEN ab WHEN resid IS NOT NULL THEN 0 END", conditioned="ab * resid"), FINS_CTES, _RATE))
def _(spark, sf):
    d = X.abnormal_turnover(turnover_rate(spark, sf), "rate")
    return keyed(d, abnormal="abnormal", signed="signed_abnormal", up="up_abnormal", down="down_abnormal", conditioned="conditioned_abnormal")


_IDM = f"""idm0 AS (SELECT *, {_roll('sum({x})', 'oc', 20)} AS ds FROM (SELECT *, close / open - 1 AS oc FROM pan)),
idm AS (SELECT *, coalesce(2 * {pct_rank('ds')} - 1, 0) AS dr FROM idm0)"""


@query("f_42_intraday_momentum", on_panel(keyed_sql(ewma("dr", 0.25, "idm"), x="-y"), _IDM))
def _(spark, sf):
    return keyed(X.intraday_momentum(panel(spark, sf), cross_section(spark, sf), 20), x="intraday_risk")


_STR = f"""bpx AS (SELECT *, coalesce({centered('s10')}, 0) AS strength FROM (SELECT *, {_roll('sum({x})', 'resid', 10, skip=1)} AS s10 FROM bp)),
evx AS (SELECT *, CASE WHEN ph IS NOT NULL THEN greatest(0, scl / ph - 1) END AS he, CASE WHEN pl IS NOT NULL THEN greatest(0, pl / scl - 1) END AS le FROM
 (SELECT *, {_roll('max({x})', 'sh', BW, skip=1)} AS ph, {_roll('min({x})', 'sl', BW, skip=1)} AS pl FROM bpx))"""


def event_panel(spark, sf):
    """Boxes, breakouts and strength of every panel row."""
    d = X.true_range(X.breakout(_safe(spark, sf), BW))
    d = X.box_position(X.boxes(d), BW)
    return X.relative_strength(d, cross_section(spark, sf), 10, out="strength")


@query("f_44_directional_events", on_panel(f"""
SELECT {KS}, side, {r('dur')} AS duration, {r('width')} AS width, {r("CASE side WHEN 'high' THEN pos ELSE 1 - pos END")} AS position,
  {r("CASE side WHEN 'high' THEN strength ELSE -strength END")} AS strength, {r("CASE side WHEN 'high' THEN dh ELSE dl END")} AS distance
FROM evx CROSS JOIN (SELECT unnest(['high', 'low']) AS side) WHERE CASE side WHEN 'high' THEN he > 0 ELSE le > 0 END""", _TR, _box(), _BPOS, _STR))
def _(spark, sf):
    d = event_panel(spark, sf)
    both = None
    for side in ("high", "low"):
        one = X.directional(d, side).where("event").withColumn("side", F.lit(side))
        both = one if both is None else both.unionByName(one)
    return keyed(both, keep=["side"], duration="o_duration", width="o_width", position="o_position", strength="o_strength", distance="o_distance")


@query("f_45_eligible_box", on_panel(f"SELECT {KS}, dur > 0 AND coalesce(width < 3, false) AS eligible FROM bx", _TR, _box()))
def _(spark, sf):
    return keyed(X.eligible_box(X.boxes(X.true_range(_safe(spark, sf)))), keep=["eligible"])


@query("f_46_valuation_snapshot", on_panel(f"""
SELECT p.code, {r('p.close / (e.equity / e.shares)', 8)} AS pbr, {r('p.close / (e.profit / e.shares)', 8)} AS per
FROM (SELECT * FROM pan WHERE date = (SELECT max(date) FROM pan)) p JOIN (SELECT code, arg_max(equity, (disclosed, number)) FILTER (WHERE equity IS NOT NULL) AS equity,
  arg_max(shares, (disclosed, number)) FILTER (WHERE shares IS NOT NULL) AS shares, arg_max(profit, (disclosed, number)) AS profit FROM fins GROUP BY code) e USING (code)
WHERE e.profit > 0""", FINS_CTES))
def _(spark, sf):
    from panelwright.sources.io import latest_snapshot

    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("disclosed", "number"))).alias(c)
    e = disclosures(spark, sf).groupBy("code").agg(last("equity"), last("shares"), last("profit")).where("profit > 0")
    d = latest_snapshot(panel(spark, sf).select("date", "code", "close")).join(e, "code")
    return d.select("code", rounded(ratio("close", ratio("equity", "shares"))).alias("pbr"), rounded(ratio("close", ratio("profit", "shares"))).alias("per"))


@query("f_47_growth_series", on_panel(f"""
SELECT {day()} AS date, {r('product(1 + mkt * 0.001::DOUBLE) OVER (ORDER BY date)')} AS growth, {r('lvl / first_value(lvl) OVER (ORDER BY date)')} AS normalised
FROM (SELECT date, avg(mkt) AS mkt, avg(close) AS lvl FROM pan GROUP BY date) WHERE mkt IS NOT NULL"""))
def _(spark, sf):
    from pyspark.sql import Window

    d = panel(spark, sf).groupBy("date").agg(F.max("mkt").alias("mkt"), F.avg("close").alias("lvl")).where("mkt is not null")
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    d = d.select("date", F.product(1 + F.col("mkt") * 0.001).over(w).alias("growth"),
                 (F.col("lvl") / F.first("lvl", ignorenulls=True).over(w)).alias("normalised"))
    return d.select(day_text().alias("date"), rounded("growth").alias("growth"), rounded("normalised").alias("normalised"))


@query("f_48_composite_market", on_panel(f"""
SELECT {day('p.date')} AS date, p.code, {r('m.comp')} AS composite, {r('p.raw_target')} AS raw_target FROM pan p LEFT JOIN (
 SELECT date, 0.6 * o + 0.4 * lag(c) OVER (ORDER BY date) AS comp FROM (SELECT date, avg(ret) AS o, avg(cr) AS c FROM
  (SELECT *, close / lag(close) OVER ({W}) - 1 AS cr FROM pan) GROUP BY date)) m USING (date)"""))
def _(spark, sf):
    from pyspark.sql import Window

    d = panel(spark, sf).withColumn("cr", ratio("close", ts.shift("close")) - 1)
    m = d.groupBy("date").agg(F.avg("ret").alias("o"), F.avg("cr").alias("c"))
    m = m.select("date", (0.6 * F.col("o") + 0.4 * F.lag("c").over(Window.orderBy("date"))).alias("composite"))
    return keyed(d.join(scale_of(spark, sf).per_date(m), "date", "left"), composite="composite", raw_target="raw_target")
