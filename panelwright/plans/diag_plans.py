"""Diagnostics and attribution."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions.scalar import day_text, fixed_bins, rounded
from panelwright.operators import account as P
from panelwright.operators import aggregates as agg
from panelwright.operators import attribution as AT
from panelwright.operators import crosstools as ct
from panelwright.operators import diagnostics as DG
from panelwright.operators import features as X
from panelwright.operators import models as M
from panelwright.operators import signals as G
from panelwright.operators import timeseries as ts
from panelwright.operators.asof import at_offset
from panelwright.operators.xsection import rank_bins
from panelwright.plans import feature_plans as FP
from panelwright.plans.common import KS, keyed, keyed_sql
from panelwright.plans.registry import query
from panelwright.plans.signal_plans import AGE
from panelwright.plans.sql import (FINS_CTES, avg_rank, centered, day, on_events, on_panel, on_scored, pct_rank, quintile, r, ridge_ctes, ridge_score, scorr)
from panelwright.plans.window_plans import W
from panelwright.sources.panels import cross_section, events, panel, scale_of, scored, stage

D = f"{day()} AS date"
YEAR = "CAST(year(date) AS BIGINT)"


def _cols(names, digits=8):
    return [rounded(c, digits).alias(c) for c in names]


def _held(spark, sf, d=None):
    """Event panel with the side score's own quintile, weight and weight change."""
    d = (events(spark, sf) if d is None else d).drop("q", "w", "dw")
    return d.withColumnsRenamed({f"side_{c}": c for c in ("q", "w", "dw")})


_SQ = f"""sq0 AS (SELECT * EXCLUDE (q, w, dw), {quintile('sn')} AS q FROM en), sq1 AS (SELECT *, (q - 2) / n_day / 1.2::DOUBLE AS w FROM sq0),
sq AS (SELECT *, coalesce(abs(w - lag(w) OVER (PARTITION BY code ORDER BY date)), abs(w)) AS dw FROM sq1)"""
_AGES = [("fresh_high", "h0"), ("young_high", "h14"), ("old_high", "h5"), ("fresh_low", "l0"), ("young_low", "l14"), ("old_low", "l5")]
_FR = AGE.replace("FROM en)", "FROM sq)") + f""",
fr0 AS (SELECT *, {', '.join(f"abs({r(c, 10)}) AS a_{n}" for n, c in _AGES)} FROM ag), fr1 AS (SELECT *, {' + '.join(f'a_{n}' for n, _ in _AGES)} AS tot FROM fr0),
fr AS (SELECT *, {', '.join(f"CASE WHEN sn <> 0 AND tot > 0 THEN a_{n} / tot ELSE 0 END AS f_{n}" for n, _ in _AGES)},
  CASE WHEN sn = 0 AND q IN (0, 4) THEN 1.0::DOUBLE ELSE 0 END AS f_flat_outer, CASE WHEN sn = 0 AND q NOT IN (0, 4) THEN 1.0::DOUBLE ELSE 0 END AS f_flat_inner,
  CASE WHEN sn <> 0 AND tot = 0 THEN 1.0::DOUBLE ELSE 0 END AS f_unexplained FROM fr1)"""
_SRC = AT.SOURCES


def _fractions(spark, sf, d=None):
    return AT.source_shares(AT.parts_by_age(_held(spark, sf, d)), "side_score", "q")


def _alloc_sql(source="fr"):
    rows = " UNION ALL ".join(f"SELECT date, code, seg, w, target, '{s}' AS source, f_{s} AS new, coalesce(lag(f_{s}) OVER ({W}), 0) AS old, coalesce(lag(w) OVER ({W}), 0) AS b FROM {source}" for s in _SRC)
    return f"""al0 AS ({rows}), al1 AS (SELECT *, unnest(['long', 'short']) AS side FROM al0),
al2 AS (SELECT *, CASE side WHEN 'long' THEN b > 0 ELSE b < 0 END AS was, CASE side WHEN 'long' THEN w > 0 ELSE w < 0 END AS isn FROM al1),
al AS (SELECT *, CASE WHEN was AND isn THEN abs(w - b) * 0.5 * (old + new) WHEN was THEN abs(b) * old WHEN isn THEN abs(w) * new ELSE 0 END AS turn FROM al2),
sd AS (SELECT date, side, source, coalesce(sum(CASE WHEN isn THEN w * target * new ELSE 0 END), 0) AS gross, coalesce(sum(CASE WHEN target IS NOT NULL THEN 0.001::DOUBLE * turn END), 0) AS cost,
  sum(turn) AS turnover, sum(CASE WHEN isn THEN new ELSE 0 END) AS held, sum(CASE WHEN isn THEN abs(w) * new ELSE 0 END) AS weight FROM al GROUP BY date, side, source)"""


@query("d_01_score_regulation", on_scored(f"""
SELECT a.*, {r('b.z')} AS zero_rate, b.n_q1, b.n_q5, {r('b.lx')} AS long_exposure, {r('b.sx')} AS short_exposure FROM (
 SELECT {day('date')} AS date, CAST(sum(n) AS BIGINT) AS rows, {r('sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n)')} AS duplicate_rate, CAST(sum(CASE WHEN lo <> hi THEN n ELSE 0 END) AS BIGINT) AS crossing
 FROM (SELECT date, score, count(*) AS n, min(q) AS lo, max(q) AS hi FROM sc GROUP BY 1, 2) GROUP BY date) a
JOIN (SELECT {day('date')} AS date, avg(CASE WHEN score = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS z, count(*) FILTER (WHERE q = 0) AS n_q1, count(*) FILTER (WHERE q = 4) AS n_q5,
  sum(greatest(w, 0)) AS lx, sum(least(w, 0)) AS sx FROM sc GROUP BY sc.date) b USING (date)"""))
def _(spark, sf):
    d = DG.regulation(scored(spark, sf), "score", "q", "w")
    return d.select(day_text().alias("date"), "rows", "crossing", "n_q1", "n_q5", *_cols(["duplicate_rate", "zero_rate", "long_exposure", "short_exposure"]))


@query("d_02_event_age_components", on_events(keyed_sql("ag", **{n: c for n, c in _AGES}), AGE))
def _(spark, sf):
    return keyed(AT.parts_by_age(events(spark, sf)), **{n: n for n, _ in _AGES})


@query("d_03_source_fractions", on_events(keyed_sql("fr", 7, **{f"f_{s}": f"f_{s}" for s in _SRC}), _SQ, _FR))
def _(spark, sf):
    return keyed(_fractions(spark, sf), 7, **{f"f_{s}": AT.share(s) for s in _SRC})


@query("d_04_turnover_allocation", on_events(f"SELECT {D}, side, source, {r('turnover', 7)} AS turnover FROM sd", _SQ, _FR, _alloc_sql()))
def _(spark, sf):
    d = AT.source_daily(_fractions(spark, sf))
    return d.select(day_text().alias("date"), "side", "source", rounded("turnover", 7).alias("turnover"))


_SUM = """{year} side, source, {g} AS annual_gross, {c} AS annual_cost, {n} AS annual_net, {d} AS stock_days, {t} AS turnover_share, {w} AS weight_share""".format(
    year="{year}", g=r("avg(gross) * 252", 5), c=r("avg(cost) * 252", 5), n=r("avg(gross - cost) * 252", 5), d=r("sum(held)", 4),
    t=r("sum(turnover) / nullif(sum(sum(turnover)) OVER (PARTITION BY {part} side), 0)", 6), w=r("sum(weight) / nullif(sum(sum(weight)) OVER (PARTITION BY {part} side), 0)", 6))
_SUMCOLS = ["annual_gross", "annual_cost", "annual_net"]


@query("d_05_source_attribution", on_events("SELECT " + _SUM.replace("{year}", "").replace("{part}", "") + " FROM sd GROUP BY side, source", _SQ, _FR, _alloc_sql()))
def _(spark, sf):
    s = AT.source_summary(AT.source_daily(_fractions(spark, sf)))
    return s.select("side", "source", *_cols(_SUMCOLS, 5), rounded("stock_days", 4).alias("stock_days"), *_cols(["turnover_share", "weight_share"], 6))


@query("d_05_yearly_attribution", on_events("SELECT " + _SUM.replace("{year}", f"{YEAR} AS year,").replace("{part}", "year(date),") + " FROM sd GROUP BY year(date), side, source", _SQ, _FR, _alloc_sql()))
def _(spark, sf):
    daily = AT.source_daily(_fractions(spark, sf)).withColumn("year", F.year("date").cast("long"))
    s = AT.source_summary(daily, ["year"])
    return s.select("year", "side", "source", *_cols(_SUMCOLS, 5), rounded("stock_days", 4).alias("stock_days"), *_cols(["turnover_share", "weight_share"], 6))


@query("d_06_short_night_sources", on_events(f"""
SELECT source, {r('sum(g) / (SELECT count(*) FROM cal) * 252', 5)} AS annual_gross, count(*) FILTER (WHERE fs > 0) AS stock_days FROM (
 SELECT f.date, s.source, least(f.w, 0) * (n.ng + n.dy * n.ng / 2 - 0.5 * n.adj) * s.fs AS g, CASE WHEN f.w < 0 THEN s.fs ELSE 0 END AS fs FROM fr f
 JOIN (SELECT a.date, a.code, b.close / b.open - 1 AS dy, c.open / b.close - 1 AS ng, c.beta * c.mkt AS adj FROM sc a LEFT JOIN sc b ON a.code = b.code AND b.ord = a.ord + 1 LEFT JOIN sc c ON a.code = c.code AND c.ord = a.ord + 2) n
   ON n.date = f.date AND n.code = f.code
 JOIN ({' UNION ALL '.join(f"SELECT date, code, '{s}' AS source, f_{s} AS fs FROM fr" for s in _SRC)}) s ON s.date = f.date AND s.code = f.code) GROUP BY source""", _SQ, _FR))
def _(spark, sf):
    xs = cross_section(spark, sf)
    d = _fractions(spark, sf, P.holding_split(events(spark, sf), xs, 0.5))  # split where the events lie by code
    d = agg.unpivot(d.select("date", "code", "w", "night_part", *[AT.share(s).alias(s) for s in _SRC]), ["date", "code", "w", "night_part"], _SRC, "source", "fs")
    short = F.least(F.col("w"), F.lit(0.0))
    return d.groupBy("source").agg(
        rounded(F.sum(short * F.col("night_part") * F.col("fs")) / scale_of(spark, sf).dates * 252, 5).alias("annual_gross"),
        F.count(F.when((F.col("w") < 0) & (F.col("fs") > 0), 1)).alias("stock_days"))


@query("d_07_group_summary", on_scored(f"""
SELECT sector17, q, count(*) AS stock_days, {r('sum(abs(w))', 6)} AS exposure, {r('avg(w)')} AS mean_weight, {r('coalesce(sum(w * target), 0) / (SELECT count(*) FROM cal) * 252', 5)} AS annual_gross,
 {r('coalesce(sum(w * target - 0.001 * dw), 0) / (SELECT count(*) FROM cal) * 252', 5)} AS annual_net, {r('sum(dw) / (SELECT count(*) FROM cal) * 252', 5)} AS annual_turnover,
 {r('sum(abs(w)) / sum(sum(abs(w))) OVER ()', 6)} AS weight_share, {r('max(ic)', 6)} AS mean_ic
FROM sc LEFT JOIN (SELECT sector17 AS s2, q AS q2, avg(c) AS ic FROM (SELECT sector17, q, date, {scorr('a', 'b')} AS c FROM
  (SELECT sector17, q, date, {avg_rank('score', 'sector17, q, date')} AS a, {avg_rank('target', 'sector17, q, date')} AS b FROM sc WHERE target IS NOT NULL AND q IS NOT NULL) GROUP BY 1, 2, 3) GROUP BY 1, 2)
 ON s2 = sector17 AND q2 = q WHERE q IS NOT NULL GROUP BY sector17, q"""))
def _(spark, sf):
    d = P.row_pl(scored(spark, sf).where("q is not null"))
    g = DG.group_summary(d, ["sector17", "q"], scale_of(spark, sf).dates, cross_section(spark, sf))
    g = g.fillna(0.0, ["annual_gross", "annual_net"])
    return g.select("sector17", "q", "stock_days", *_cols(["exposure"], 6), *_cols(["mean_weight"]), *_cols(["annual_gross", "annual_net", "annual_turnover"], 5),
                    *_cols(["weight_share", "mean_ic"], 6))


@query("d_07_spread_renewal", on_scored(f"""
SELECT sector17, {r('avg(spread)', 6)} AS spread, count(spread) AS days, {r('sum(entered) / sum(held)::DOUBLE', 6)} AS renewal FROM (
 SELECT sector17, date, CASE WHEN count(target) >= 5 THEN avg(target) FILTER (WHERE q = 4) - avg(target) FILTER (WHERE q = 0) END AS spread,
  count(*) FILTER (WHERE q IN (0, 4) AND q IS DISTINCT FROM q0) AS entered, count(*) FILTER (WHERE q IN (0, 4)) AS held
 FROM (SELECT *, lag(q) OVER (PARTITION BY code ORDER BY date) AS q0 FROM sc WHERE q IS NOT NULL) GROUP BY sector17, date) GROUP BY sector17 HAVING sum(held) > 0"""))
def _(spark, sf):
    """Outer-quintile return spread inside each group, and the share of outer positions that are new."""
    before = F.lag("q").over(Window.partitionBy("code").orderBy("date"))
    d = scored(spark, sf).where("q is not null").withColumn("_q0", before)
    outer = F.col("q").isin(0, 4)
    mean = lambda q: F.avg(F.when(F.col("q") == q, F.col("target")))
    daily = d.groupBy("sector17", "date").agg(
        F.when(F.count("target") >= 5, mean(4) - mean(0)).alias("spread"), F.count(F.when(outer, 1)).alias("held"),
        F.count(F.when(outer & ~F.col("q").eqNullSafe(F.col("_q0")), 1)).alias("entered"))
    g = daily.groupBy("sector17").agg(F.avg("spread").alias("spread"), F.count("spread").alias("days"), F.sum("entered").alias("e"), F.sum("held").alias("h"))
    return g.where("h > 0").select("sector17", rounded("spread", 6).alias("spread"), "days", rounded(F.col("e") / F.col("h"), 6).alias("renewal"))


@query("d_08_tail_composition", on_events(f"""
SELECT {D}, q, sector33, count(*) AS stock_days, count(*) FILTER (WHERE sn = 0) AS zero_days, {r('sum(abs(w)) / sum(sum(abs(w))) OVER (PARTITION BY date, q)')} AS weight_share
FROM sq WHERE q IN (0, 4) GROUP BY date, q, sector33""", _SQ))
def _(spark, sf):
    d = DG.tail_composition(_held(spark, sf), "sector33", "q", "w", "side_score")
    return d.select(day_text().alias("date"), "q", "sector33", "stock_days", "zero_days", rounded("weight_share").alias("weight_share"))


@query("d_08_zero_bias", on_events(f"""
SELECT sector33, CAST(sum(p) AS BIGINT) AS pool_days, CAST(sum(t) AS BIGINT) AS tail_days, {r('sum(p / pt::DOUBLE) / max(nd)')} AS pool_share, {r('sum(t / tt::DOUBLE) / max(nd)')} AS tail_share FROM (
 SELECT *, count(DISTINCT date) OVER () AS nd FROM (
 SELECT date, sector33, p, t, sum(p) OVER (PARTITION BY date) AS pt, sum(t) OVER (PARTITION BY date) AS tt FROM (
  SELECT date, sector33, count(*) AS p, count(*) FILTER (WHERE q = 4) AS t FROM sq WHERE sn = 0 GROUP BY 1, 2)) WHERE tt > 0) GROUP BY sector33""", _SQ))
def _(spark, sf):
    d = DG.zero_bias(_held(spark, sf), "sector33", "q", "w", "side_score", 4)
    return d.select("sector33", "pool_days", "tail_days", *_cols(["pool_share", "tail_share"]))


@query("d_09_short_structure", on_events(f"""
SELECT q, primary_source, count(*) AS stock_days, {r('avg(sn)')} AS mean_score, {r('avg(w)')} AS mean_weight, {r('avg(target)', 6)} AS mean_target FROM (
 SELECT *, CASE {' '.join(f"WHEN f_{s} = greatest({', '.join('f_' + x for x in _SRC)}) THEN '{s}'" for s in _SRC)} END AS primary_source FROM fr WHERE w < 0) GROUP BY q, primary_source""", _SQ, _FR))
def _(spark, sf):
    d = _fractions(spark, sf).where("w < 0")
    d = d.withColumn("primary_source", F.element_at(F.array(*map(F.lit, _SRC)), F.array_position("shares", F.array_max("shares")).cast("int")))
    return d.groupBy("q", "primary_source").agg(F.count("*").alias("stock_days"), rounded(F.avg("side_score")).alias("mean_score"),
                                                rounded(F.avg("w")).alias("mean_weight"), rounded(F.avg("target"), 6).alias("mean_target"))


@query("d_10_churn", on_scored(f"""
SELECT {D}, count(*) AS common, count(*) FILTER (WHERE q <> q0) AS changed, {r('count(*) FILTER (WHERE q = 4 AND q0 = 4) / nullif(count(*) FILTER (WHERE q0 = 4), 0)::DOUBLE')} AS top_retention, {r(scorr('a', 'b'))} AS rank_autocorrelation
FROM (SELECT x.date, x.q, y.q AS q0, {avg_rank('x.score', 'x.date')} AS a, {avg_rank('y.score', 'x.date')} AS b FROM sc x JOIN sc y ON x.code = y.code AND y.ord = x.ord - 1 WHERE y.q IS NOT NULL) GROUP BY date"""))
def _(spark, sf):
    d = DG.churn(scored(spark, sf), "score", "q", cross_section(spark, sf))
    return d.select(day_text().alias("date"), "common", "changed", *_cols(["top_retention", "rank_autocorrelation"]))


@query("d_11_state_table", on_events(f"""
SELECT {KS}, CASE WHEN date < DATE '1999-01-01' THEN 'train' ELSE 'later' END AS split, CASE WHEN ls < 0 THEN 'low_state' WHEN hs > 0 THEN 'high_state' ELSE 'fallback' END AS source,
 {r('sn')} AS score, hage AS high_age, lage AS low_age, q, sector17, size_band FROM sq""", _SQ))
def _(spark, sf):
    source = F.when(F.col("low_state") < 0, "low_state").when(F.col("high_state") > 0, "high_state").otherwise("fallback")
    split = F.when(F.col("date") < F.lit("1999-01-01").cast("date"), "train").otherwise("later")
    return keyed(_held(spark, sf), keep=[split.alias("split"), source.alias("source"), F.col("high_age").cast("long").alias("high_age"),
                                         F.col("low_age").cast("long").alias("low_age"), "q", "sector17", "size_band"], score="side_score")


_SPELLS = f"""{_SQ},
sl0 AS (SELECT *, CASE WHEN q <= 1 THEN -1 WHEN q >= 3 THEN 1 ELSE 0 END AS pside, {pct_rank('sn')} AS pct, CASE WHEN ls < 0 THEN 'low_state' WHEN ls = 0 AND hs > 0 THEN 'high_state' ELSE 'fallback' END AS source,
  CAST(sum(CASE WHEN hr > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY code, seg ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) AS high20,
  CAST(sum(CASE WHEN lr < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY code, seg ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) AS low20 FROM sq),
sl1 AS (SELECT *, CASE WHEN lag(pside) OVER (PARTITION BY code ORDER BY date) = pside AND ord - lag(ord) OVER (PARTITION BY code ORDER BY date) = 1 THEN 0 ELSE 1 END AS nw FROM sl0),
sl2 AS (SELECT *, sum(nw) OVER (PARTITION BY code ORDER BY date) AS spell FROM sl1),
sl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY code, spell ORDER BY date) AS spell_age, count(*) OVER (PARTITION BY code, spell) AS spell_length,
  CASE WHEN pside > 0 THEN high20 WHEN pside < 0 THEN low20 ELSE 0 END AS reinforcing, CASE WHEN pside > 0 THEN hage WHEN pside < 0 THEN lage END AS side_age,
  abs(ls) / nullif(abs(hs) + abs(ls), 0) AS low_share, CASE WHEN date < DATE '1999-01-01' THEN 'train' ELSE 'later' END AS split FROM sl2)"""


def _state_spells(spark, sf):
    """Held rows with their side's spell, its renewing events and the shares of both states."""
    xs = cross_section(spark, sf)
    d = _held(spark, sf).withColumn("pside", F.when(F.col("q") <= 1, -1).when(F.col("q") >= 3, 1).otherwise(0))
    d = xs.pct_rank(d, "side_score", "pct")
    d = d.withColumns({
        "source": F.when(F.col("low_state") < 0, "low_state").when((F.col("low_state") == 0) & (F.col("high_state") > 0), "high_state").otherwise("fallback"),
        "high20": F.sum(F.when(F.col("high_raw") > 0, 1).otherwise(0)).over(ts.trailing(20)), "low20": F.sum(F.when(F.col("low_raw") < 0, 1).otherwise(0)).over(ts.trailing(20)),
        "split": F.when(F.col("date") < F.lit("1999-01-01").cast("date"), "train").otherwise("later")})
    d = ts.spells(d, "pside")
    up, down = F.col("pside") > 0, F.col("pside") < 0
    return d.withColumns({
        "reinforcing": F.when(up, F.col("high20")).when(down, F.col("low20")).otherwise(0), "side_age": F.when(up, F.col("high_age")).when(down, F.col("low_age")),
        "low_share": F.try_divide(F.abs("low_state"), F.abs("high_state") + F.abs("low_state"))})


@query("d_11_spells", on_events(f"""
SELECT {KS}, pside AS side, source, spell_age, spell_length, reinforcing, side_age, {r('pct')} AS percentile, {r('low_share')} AS low_share FROM sl""", _SPELLS))
def _(spark, sf):
    d = _state_spells(spark, sf)
    return keyed(d, keep=[F.col("pside").alias("side"), "source", *[F.col(c).cast("long").alias(c) for c in ("spell_age", "spell_length", "reinforcing", "side_age")]],
                 percentile="pct", low_share="low_share")


@query("d_11_state_summary", on_events(f"""
SELECT split, source, pside AS side, count(*) AS rows, count(DISTINCT code) AS codes, count(*) FILTER (WHERE spell_age = 1) AS spells, {r('avg(spell_age)', 6)} AS spell_age,
  {r('avg(side_age)', 6)} AS side_age, {r('avg(reinforcing)', 6)} AS reinforcing, {r('avg(abs(sn))', 6)} AS score_size, {r('avg(low_share)', 6)} AS low_share,
  count(*) FILTER (WHERE ls < 0 AND hs > 0) AS both_states, count(*) FILTER (WHERE abs(sn) < 1e-12) AS near_zero FROM sl GROUP BY ALL""", _SPELLS))
def _(spark, sf):
    """Rows, codes, new spells and mean ages, renewals and shares of every split, source and side."""
    n = lambda c: F.count(F.when(c, 1))
    g = _state_spells(spark, sf).groupBy("split", "source", F.col("pside").alias("side")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("code").alias("codes"), n(F.col("spell_age") == 1).alias("spells"),
        *[rounded(F.avg(c), 6).alias(c) for c in ("spell_age", "side_age", "reinforcing")], rounded(F.avg(F.abs("side_score")), 6).alias("score_size"),
        rounded(F.avg("low_share"), 6).alias("low_share"), n((F.col("low_state") < 0) & (F.col("high_state") > 0)).alias("both_states"),
        n(F.abs("side_score") < 1e-12).alias("near_zero"))
    return g


_COND = f"""ct0 AS (SELECT s.date, s.code, s.target, s.w, s.dw, s.score, s.sector17, s.size_band, c.period, c.basis, s.date - c.sd AS age FROM sc s JOIN cfj c ON c.date = s.date AND c.code = s.code),
ct1 AS (SELECT *, {avg_rank('score')} AS rs FROM ct0), ct AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS dimension, {v} AS level, * FROM ct1" for k, v in {
    "year": "CAST(year(date) AS VARCHAR)", "period": "coalesce(period, 'missing')", "basis": "coalesce(basis, 'missing')", "sector": "sector17", "size": "size_band",
    "age": "CASE WHEN age IS NULL THEN 'none' WHEN age <= 90 THEN '0-90' WHEN age <= 180 THEN '91-180' WHEN age <= 450 THEN '181-450' ELSE 'expired' END"}.items()) + ")"


@query("e_13_condition_tables", on_scored(f"""
SELECT dimension, level, count(*) AS rows, count(DISTINCT date) AS days, {r('avg(target)', 6)} AS target, {r('sum(w * target)', 5)} AS gross, {r('sum(CASE WHEN target IS NOT NULL THEN 0.001::DOUBLE * dw END)', 6)} AS cost,
  {r('sum(CASE WHEN w > 0 THEN w * target END)', 5)} AS long, {r('sum(CASE WHEN w < 0 THEN w * target END)', 5)} AS short, {r('avg(abs(w))')} AS held FROM ct GROUP BY 1, 2""",
    FINS_CTES, FP._SEEN, FP._state("cf", FP._CFO), _COND))
def _(spark, sf):
    """Returns, cost and both sides of the book by year, report period, accounting basis, sector, size and age of the report."""
    state = FP.DS.report_state(FP._base(spark, sf), FP._reports(spark, sf), FP._sp_cfo(), "cfo").select("date", "code", "cfo_date", "cfo_period", "cfo_basis")
    d = scored(spark, sf).join(state, ["date", "code"])
    age = F.datediff("date", "cfo_date")
    band = F.when(age.isNull(), "none").when(age <= 90, "0-90").when(age <= 180, "91-180").when(age <= 450, "181-450").otherwise("expired")
    return ct.condition_tables(d, {"year": F.year("date").cast("string"), "period": F.col("cfo_period"), "basis": F.col("cfo_basis"), "sector": F.col("sector17"),
                                   "size": F.col("size_band"), "age": band})


_ORI = f"""oe AS (SELECT *, max(CASE WHEN lr < 0 THEN date END) OVER ({W}) AS ldate, max(CASE WHEN hr > 0 THEN date END) OVER ({W}) AS hdate, row_number() OVER ({W}) AS rn FROM en),
od AS (SELECT a.*, b.ls AS l0, b.lr AS lentry, a.rn - b.rn AS lrows, c.hr AS hentry, c.hs AS h0, a.rn - c.rn AS hrows FROM oe a LEFT JOIN oe b ON b.code = a.code AND b.date = a.ldate LEFT JOIN oe c ON c.code = a.code AND c.date = a.hdate)"""


def _origins(spark, sf):
    d = events(spark, sf)
    d = d.withColumns({"high_origin": F.when(F.col("high_event"), F.struct("high_raw", "high_state")), "low_origin": F.when(F.col("low_event"), F.struct("low_raw", "low_state"))})
    past = ts.history().rowsBetween(ts.UNBOUNDED, 0)
    d = d.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in ("high_origin", "low_origin")})
    return d.withColumns({"high_entry": F.col("high_origin.high_raw"), "high_start": F.col("high_origin.high_state"),
                          "low_entry": F.col("low_origin.low_raw"), "low_start": F.col("low_origin.low_state")})


@query("d_12_decay_curve", on_events(f"""
SELECT lrows AS age, {r('avg(ls / l0)')} AS observed, count(*) AS rows, {r('pow(0.5, lrows)')} AS theory FROM od WHERE lrows BETWEEN 0 AND 20 GROUP BY lrows""", _ORI))
def _(spark, sf):
    d = DG.decay_profile(_origins(spark, sf), "low_state", "low_start", "low_rows", 0.5, 20)
    return d.select("age", "rows", *_cols(["observed", "theory"]))


@query("d_12_all_ages", on_events(f"""
SELECT lrows AS age, {r('avg(ls / l0)')} AS observed, count(*) AS rows, {r('pow(0.5, lrows)')} AS theory FROM od WHERE lrows >= 0 GROUP BY lrows""", _ORI))
def _(spark, sf):
    d = DG.decay_profile(_origins(spark, sf), "low_state", "low_start", "low_rows", 0.5)
    return d.select("age", "rows", *_cols(["observed", "theory"]))


@query("d_13_recurrence", on_events(f"""
SELECT count(*) AS pairs, {r('avg(ls / p)')} AS mean_ratio, count(*) FILTER (WHERE abs(ls / p - 0.5) > 1e-9) AS broken
FROM (SELECT *, lag(ls) OVER ({W}) AS p, lag(ord) OVER ({W}) AS po FROM en) WHERE po = ord - 1 AND lr = 0 AND abs(p) > 1e-6"""))
def _(spark, sf):
    d = DG.recurrence(events(spark, sf), "low_state", F.col("low_event"), 0.5)
    return d.select("pairs", "broken", rounded("mean_ratio").alias("mean_ratio"))


@query("d_14_entry_vs_state", on_events(f"""
SELECT kind, lag, {r('avg(c)', 6)} AS mean_ic, count(c) AS days FROM (
 SELECT 'entry' AS kind, lag, date, {scorr('a', 'b')} AS c FROM (SELECT hrows AS lag, date, {avg_rank('hentry', 'hrows, date')} AS a, {avg_rank('target', 'hrows, date')} AS b FROM od WHERE hrows IN (1, 5, 20) AND target IS NOT NULL) GROUP BY 1, 2, 3
 UNION ALL SELECT 'state', lag, date, {scorr('a', 'b')} FROM (SELECT hrows AS lag, date, {avg_rank('hz', 'hrows, date')} AS a, {avg_rank('target', 'hrows, date')} AS b FROM (SELECT *, {r('hs', 10)} AS hz FROM od) WHERE hrows IN (1, 5, 20) AND target IS NOT NULL) GROUP BY 1, 2, 3)
GROUP BY kind, lag""", _ORI))
def _(spark, sf):
    from panelwright.sources.panels import stable

    d = _origins(spark, sf).withColumn("hz", stable(F.col("high_state")))
    d = DG.lag_quality(d, "hz", "high_entry", "high_rows", "target", (1, 5, 20), cross_section(spark, sf))
    return d.select("kind", "lag", rounded("mean_ic", 6).alias("mean_ic"), "days")


def _quality_sql(side, rows_, entry, state):
    lags = "1, 5, 20, 40, 60"
    one = lambda kind, x, src: (
        f"SELECT '{side}' AS side, '{kind}' AS kind, lag, date, {scorr('a', 'b')} AS c FROM (SELECT {rows_} AS lag, date, {avg_rank(x, f'{rows_}, date')} AS a, "
        f"{avg_rank('target', f'{rows_}, date')} AS b FROM {src} WHERE {rows_} IN ({lags}) AND target IS NOT NULL AND {x} IS NOT NULL) GROUP BY 1, 2, 3, 4")
    return one("entry", entry, "od") + " UNION ALL " + one("state", "z", f"(SELECT *, {r(state, 10)} AS z FROM od)")


@query("d_14_quality_by_side", on_events(f"""
SELECT side, kind, CAST(lag AS BIGINT) AS lag, {r('avg(c)', 6)} AS mean_ic, count(c) AS days FROM (
 {_quality_sql('high', 'hrows', 'hentry', 'hs')} UNION ALL {_quality_sql('low', 'lrows', 'lentry', 'ls')}) GROUP BY side, kind, lag""", _ORI))
def _(spark, sf):
    from panelwright.sources.panels import stable

    d, out = _origins(spark, sf), None
    for side in ("high", "low"):
        one = d.withColumn("z", stable(F.col(f"{side}_state"))).where(F.col(f"{side}_entry").isNotNull())
        one = DG.lag_quality(one, "z", f"{side}_entry", f"{side}_rows", "target", (1, 5, 20, 40, 60), cross_section(spark, sf)).withColumn("side", F.lit(side))
        out = one if out is None else out.unionByName(one)
    return out.select("side", "kind", F.col("lag").cast("long").alias("lag"), rounded("mean_ic", 6).alias("mean_ic"), "days")


@query("d_15_survival_by_age", on_events(f"""
SELECT CASE WHEN a.lage > -1 AND a.lage <= 4 THEN '0-4' WHEN a.lage > 4 AND a.lage <= 20 THEN '5-20' WHEN a.lage > 20 AND a.lage <= 60 THEN '21-60' END AS band, count(*) AS rows,
 {r('avg(CASE WHEN b5.q = a.q THEN 1.0::DOUBLE WHEN b5.q IS NOT NULL THEN 0 END)')} AS same5, {r('avg(CASE WHEN b20.q = a.q THEN 1.0::DOUBLE WHEN b20.q IS NOT NULL THEN 0 END)')} AS same20
FROM sq a LEFT JOIN sq b5 ON b5.code = a.code AND b5.ord = a.ord + 5 LEFT JOIN sq b20 ON b20.code = a.code AND b20.ord = a.ord + 20 WHERE a.q = 0 GROUP BY 1""", _SQ))
def _(spark, sf):
    d = agg.survival(_held(spark, sf).select("date", "code", "ord", "q", "low_age"), "q", (5, 20)).where("q = 0")
    band = fixed_bins("low_age", [-1, 4, 20, 60], ["0-4", "5-20", "21-60"])
    return d.groupBy(band.alias("band")).agg(F.count("*").alias("rows"), *[rounded(F.avg(F.col(f"same{k}").cast("double"))).alias(f"same{k}") for k in (5, 20)])


_TWOQ = f"""tq0 AS (SELECT *, {quintile('dsc')} AS qb FROM sq), tq AS (SELECT *, (qb - 2) / n_day / 1.2::DOUBLE AS wb FROM tq0)"""


def _two(spark, sf):
    return cross_section(spark, sf).quintile(_held(spark, sf), "sum_score", "qb", "wb").where("q is not null")


@query("d_16_assignment_difference", on_events(f"""
SELECT {D}, count(*) FILTER (WHERE q <> qb) AS quintile_changed, count(*) FILTER (WHERE abs(w - wb) > 1e-12) AS weight_changed, count(*) FILTER (WHERE sign(w) <> sign(wb)) AS side_changed, {r('sum(abs(w - wb))')} AS weight_distance
FROM tq GROUP BY date""", _SQ, _TWOQ))
def _(spark, sf):
    d = DG.assignment_difference(_two(spark, sf), "q", "w", "qb", "wb")
    return d.select(day_text().alias("date"), "quintile_changed", "weight_changed", "side_changed", rounded("weight_distance").alias("weight_distance"))


@query("d_17_common_unique", on_events(f"""
SELECT {D}, {r('coalesce(sum(c * target), 0)')} AS shared, {r('coalesce(sum((w - c) * target), 0)')} AS base_only, {r('coalesce(sum((wb - c) * target), 0)')} AS candidate_only
FROM (SELECT *, CASE WHEN sign(w) = sign(wb) THEN sign(w) * least(abs(w), abs(wb)) ELSE 0 END AS c FROM tq) GROUP BY date""", _SQ, _TWOQ))
def _(spark, sf):
    d = DG.common_unique(_two(spark, sf), "w", "wb", "target")
    return d.select(day_text().alias("date"), *_cols(["shared", "base_only", "candidate_only"]))


@query("d_18_long_preservation", on_scored(f"""
SELECT {D}, count(*) FILTER (WHERE w > 0) AS longs, count(*) FILTER (WHERE w > 0 AND w = wt) AS kept, count(*) FILTER (WHERE w <= 0 AND abs(w - wt) > 1e-12) AS moved_shorts FROM (
 SELECT a.date, a.code, a.w, CASE WHEN a.w > 0 THEN a.w ELSE coalesce(s.w, 0) END AS wt FROM (SELECT *, row_number() OVER (PARTITION BY date, w > 0 ORDER BY volume DESC, score, code) AS k FROM sc WHERE w IS NOT NULL) a
 LEFT JOIN (SELECT date, w, row_number() OVER (PARTITION BY date ORDER BY w, code) AS k FROM sc WHERE w < 0) s ON s.date = a.date AND s.k = a.k AND a.w <= 0) GROUP BY date"""))
def _(spark, sf):
    d = G.fixed_long_path(scored(spark, sf).where("w is not null"), cross_section(spark, sf), "w", "score", "volume", "wt")
    n = lambda c: F.count(F.when(c, 1))
    long = F.col("w") > 0
    return d.groupBy(day_text().alias("date")).agg(n(long).alias("longs"), n(long & (F.col("w") == F.col("wt"))).alias("kept"),
                                                   n(~long & (F.abs(F.col("w") - F.col("wt")) > 1e-12)).alias("moved_shorts"))


@query("d_19_matched_control", on_events(f"""
SELECT n AS days, {r('m', 6)} AS mean, {r("m / sqrt(greatest((ee + 2 * (5/6.0::DOUBLE) * s1 + 2 * (4/6.0::DOUBLE) * s2 + 2 * (3/6.0::DOUBLE) * s3 + 2 * (2/6.0::DOUBLE) * s4 + 2 * (1/6.0::DOUBLE) * s5) / n, 1e-30) / n)", 5)} AS t_hac FROM (
 SELECT count(*) AS n, max(mm) AS m, sum(e * e) AS ee, {', '.join(f'sum(e * l{k}) AS s{k}' for k in range(1, 6))} FROM (
  SELECT *, {', '.join(f'lag(e, {k}) OVER (ORDER BY date) AS l{k}' for k in range(1, 6))} FROM (SELECT date, x - avg(x) OVER () AS e, avg(x) OVER () AS mm FROM
   (SELECT date, avg(CASE WHEN he THEN target END) - avg(CASE WHEN le THEN target END) AS x FROM en GROUP BY date) WHERE x IS NOT NULL)))"""))
def _(spark, sf):
    d = DG.matched_control(events(spark, sf), F.col("high_event"), F.col("low_event"), "target")
    return d.select("days", rounded("mean", 6).alias("mean"), rounded("t_hac", 5).alias("t_hac"))


@query("d_20_box_tables", on_panel(f"""
SELECT {YEAR} AS year, CAST(dur AS BIGINT) AS duration, count(*) AS rows, {r('avg(width)', 6)} AS mean_width FROM bx WHERE dur > 0 GROUP BY GROUPING SETS ((year(date), dur), (dur))""".replace(f"{YEAR} AS year", "CAST(year(date) AS BIGINT) AS year"), FP._TR, FP._box()))
def _(spark, sf):
    d = X.boxes(X.true_range(FP._safe(spark, sf))).where("box_duration > 0")
    d = d.withColumns({"year": F.year("date").cast("long"), "duration": F.col("box_duration").cast("long")})
    y, b = F.col("year"), F.col("duration")
    return d.groupingSets([[y, b], [b]], y, b).agg(F.count("*").alias("rows"), rounded(F.avg("box_width"), 6).alias("mean_width"))


@query("d_20_box_quantiles", on_panel(f"""
SELECT {YEAR} AS year, {', '.join(f"{r(f'quantile_cont(dur, {p / 100})', 6)} AS p{p}" for p in (10, 50, 90))}, max(CAST(dur AS BIGINT)) AS longest FROM bx WHERE dur > 0 GROUP BY 1""", FP._TR, FP._box()))
def _(spark, sf):
    """A duration is a number of dates, so a year's counts per value are few and combine before the shuffle."""
    d = X.boxes(X.true_range(FP._safe(spark, sf))).where("box_duration > 0")
    n = F.col("box_duration")
    return d.groupBy(F.year("date").cast("long").alias("year")).agg(
        *[rounded(F.percentile(n, F.lit(p / 100)), 6).alias(f"p{p}") for p in (10, 50, 90)], F.max(n).cast("long").alias("longest"))


@query("d_20_box_histogram", on_panel("""
SELECT CASE WHEN dur <= 2 THEN '1-2' WHEN dur <= 5 THEN '3-5' WHEN dur <= 10 THEN '6-10' WHEN dur <= 20 THEN '11-20' ELSE '21+' END AS band, count(*) AS rows,
 round(count(*) / sum(count(*)) OVER ()::DOUBLE, 8) + 0.0::DOUBLE AS share FROM bx WHERE dur > 0 GROUP BY 1""", FP._TR, FP._box()))
def _(spark, sf):
    d = X.boxes(X.true_range(FP._safe(spark, sf))).where("box_duration > 0")
    n = F.col("box_duration")
    band = F.when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 10, "6-10").when(n <= 20, "11-20").otherwise("21+")
    d = d.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("rows"))
    total = Window.partitionBy(F.lit(0))  # one row per band
    return d.select("band", "rows", rounded(F.col("rows") / F.sum("rows").over(total)).alias("share"))


@query("d_21_stage_transmission", on_events(f"""
SELECT {r('corr(raw, sn)')} AS raw_score, {r('corr(raw, w)')} AS raw_weight, {r('corr(sn, w)')} AS score_weight, {r('avg(abs(w - wb))')} AS mean_change, {r('max(abs(w - wb))')} AS max_change FROM tq WHERE q IS NOT NULL AND raw <> 0""", _SQ, _TWOQ))
def _(spark, sf):
    d = _two(spark, sf).where("raw <> 0")
    gap = F.abs(F.col("w") - F.col("wb"))
    return d.agg(rounded(agg.correlation("raw", "side_score")).alias("raw_score"), rounded(agg.correlation("raw", "w")).alias("raw_weight"),
                 rounded(agg.correlation("side_score", "w")).alias("score_weight"), rounded(F.avg(gap)).alias("mean_change"), rounded(F.max(gap)).alias("max_change"))


@query("d_22_risk_exposure", on_scored(f"""
SELECT {YEAR} AS year, sector17, size_band, CASE WHEN w > 0 THEN 'long' ELSE 'short' END AS side, {r('sum(abs(w))', 6)} AS exposure, {r('sum(w * beta)', 6)} AS beta_load, count(*) AS rows
FROM sc WHERE w <> 0 GROUP BY GROUPING SETS ((year(date), sector17, CASE WHEN w > 0 THEN 'long' ELSE 'short' END), (year(date), size_band, CASE WHEN w > 0 THEN 'long' ELSE 'short' END), (CASE WHEN w > 0 THEN 'long' ELSE 'short' END))"""))
def _(spark, sf):
    d = scored(spark, sf).where("w <> 0").withColumns({"year": F.year("date").cast("long"), "side": F.when(F.col("w") > 0, "long").otherwise("short")})
    y, s, b, side = (F.col(c) for c in ("year", "sector17", "size_band", "side"))
    return d.groupingSets([[y, s, side], [y, b, side], [side]], y, s, b, side).agg(
        rounded(F.sum(F.abs("w")), 6).alias("exposure"), rounded(F.sum(F.col("w") * F.col("beta")), 6).alias("beta_load"), F.count("*").alias("rows"))


_PERSIST = f"""ps AS (SELECT *, CASE WHEN w > 0 THEN 'long' ELSE 'short' END AS side,
 CASE WHEN lag(sign(w)) OVER (PARTITION BY code ORDER BY date) = sign(w) THEN 'kept' ELSE 'new' END AS persistence FROM sc WHERE w IS NOT NULL)"""


@query("d_22_risk_by_persistence", on_scored(f"""
SELECT {YEAR} AS year, sector17, side, persistence, {r('sum(abs(w))', 6)} AS exposure, {r('sum(w * beta)', 6)} AS beta_load, {r('sum(dw)', 6)} AS turnover, count(*) AS rows
FROM ps WHERE w <> 0 GROUP BY 1, 2, 3, 4""", _PERSIST))
def _(spark, sf):
    """Exposure of positions that kept their side since the last row, and of those that are new on it."""
    before = F.lag(F.signum("w")).over(Window.partitionBy("code").orderBy("date"))
    d = scored(spark, sf).where("w is not null").withColumn("persistence", F.when(before == F.signum("w"), "kept").otherwise("new")).where("w <> 0")
    side = F.when(F.col("w") > 0, "long").otherwise("short")
    return d.groupBy(F.year("date").cast("long").alias("year"), "sector17", side.alias("side"), "persistence").agg(
        rounded(F.sum(F.abs("w")), 6).alias("exposure"), rounded(F.sum(F.col("w") * F.col("beta")), 6).alias("beta_load"),
        rounded(F.sum("dw"), 6).alias("turnover"), F.count(F.lit(1)).alias("rows"))


_TIES = " UNION ALL ".join(f"""SELECT '{n}' AS tie, bps, {r('avg(g - bps / 10000.0::DOUBLE * t) * 252', 5)} AS annual_net, {r('avg(t)', 6)} AS turnover FROM (
 SELECT date, coalesce(sum(w * target), 0) AS g, sum(dw) AS t FROM (SELECT *, coalesce(abs(w - lag(w) OVER (PARTITION BY code ORDER BY date)), abs(w)) AS dw FROM (
  SELECT *, (q9 - 2) / n_day / 1.2::DOUBLE AS w FROM (SELECT * EXCLUDE (w, dw), {quintile('sn').replace('coalesce(sn, 0), code', f'sn, {o}')} AS q9 FROM sq))) GROUP BY date)
 CROSS JOIN (SELECT unnest([5, 10, 20]) AS bps) GROUP BY bps""" for n, o in (("code", "code"), ("reverse", "code DESC"), ("hash", "md5('3|' || code), code")))


@query("d_23_tie_cost_robustness", on_events(f"SELECT tie, CAST(bps AS BIGINT) AS bps, annual_net, turnover FROM ({_TIES})", _SQ))
def _(spark, sf):
    xs, base, out = cross_section(spark, sf), events(spark, sf).drop("q", "w", "dw"), None
    orders = {"code": ("code",), "reverse": (F.col("code").desc(),), "hash": (ct.keyed_order("code", seed=3), "code")}
    for name, tie in orders.items():
        d = xs.quintile(base, "side_score", tie=tie).withColumn("dw", P.weight_change("w"))
        daily = d.groupBy("date").agg(P.zero(F.sum(F.col("w") * F.col("target"))).alias("gross"), P.zero(F.sum("dw")).alias("turnover"))
        daily = daily.withColumn("tie", F.lit(name))
        out = daily if out is None else out.unionByName(daily)
    out = out.withColumn("bps", F.explode(F.array(*[F.lit(b) for b in (5, 10, 20)])))
    return out.groupBy("tie", F.col("bps").cast("long").alias("bps")).agg(
        rounded(F.avg(F.col("gross") - F.col("bps") / 10000 * F.col("turnover")) * 252, 5).alias("annual_net"), rounded(F.avg("turnover"), 6).alias("turnover"))


@query("d_24_event_deciles", on_events(f"""
SELECT CAST(least(9, floor(10 * {pct_rank('raw')})) AS BIGINT) AS decile_key, date, target FROM en WHERE raw <> 0""").replace("\nSELECT CAST(least", "\nSELECT decile_key AS decile, count(*) AS rows, " + r("avg(target)", 6) + " AS mean_target FROM (SELECT CAST(least") + ") GROUP BY decile_key")
def _(spark, sf):
    d = cross_section(spark, sf).pct_rank(events(spark, sf).where("raw <> 0"), "raw", "p")
    return d.groupBy(rank_bins("p", "decile").cast("long").alias("decile")).agg(F.count("*").alias("rows"), rounded(F.avg("target"), 6).alias("mean_target"))


@query("d_25_trace", on_scored(f"""
SELECT {day('a.date')} AS date, a.code, {day('c1.date')} AS entry_date, {day('c2.date')} AS exit_date, {r('b.ret - b.beta * b.mkt')} AS rebuilt, {r('b.ret - b.beta * b.mkt - a.target')} AS delta
FROM sc a LEFT JOIN cal c1 ON c1.ord = a.ord + 1 LEFT JOIN cal c2 ON c2.ord = a.ord + 2 LEFT JOIN sc b ON b.code = a.code AND b.ord = a.ord + 2 WHERE a.w <> 0"""))
def _(spark, sf):
    d, scale = scored(spark, sf), scale_of(spark, sf)
    dates = d.select("date", "ord").distinct()
    t = at_offset(d.select("date", "code", "ord", "w", "target", "ret", "beta", "mkt"), {"ret": "r2", "beta": "b2", "mkt": "m2"}, 2).where("w <> 0")
    for k, name in ((1, "entry_date"), (2, "exit_date")):
        t = t.join(scale.per_date(dates.select((F.col("ord") - k).alias("ord"), day_text().alias(name))), "ord", "left")
    rebuilt = F.col("r2") - F.col("b2") * F.col("m2")
    return keyed(t, keep=["entry_date", "exit_date"], rebuilt=rebuilt, delta=rebuilt - F.col("target"))


@query("d_26_coverage", on_panel(f"""
SELECT {YEAR} AS year, count(*) AS rows, {r('avg(CASE WHEN rate IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS coverage FROM tor GROUP BY 1""", FINS_CTES, FP._RATE))
def _(spark, sf):
    return FP.turnover_rate(spark, sf).groupBy(F.year("date").cast("long").alias("year")).agg(
        F.count("*").alias("rows"), rounded(agg.share(F.col("rate").isNotNull())).alias("coverage"))


@query("d_26_action_follow_up", on_panel(f"""
SELECT {day('e.date')} AS date, e.code, {r('e.before', 4)} AS before, {r('(SELECT arg_min(c.shares, c.date) FROM ch c WHERE c.code = e.code AND c.date > e.date AND c.date <= e.date + 180 AND c.date = (SELECT min(c2.date) FROM ch c2 WHERE c2.code = e.code AND c2.date > e.date))', 4)} AS after
FROM t2 e WHERE e.factor <> 1""", FINS_CTES, FP._RATE, "t1 AS (SELECT *, CASE WHEN volume / rate IS NOT NULL THEN round(volume / rate) END AS shares FROM tor)",
    "t2 AS (SELECT *, last_value(shares IGNORE NULLS) OVER (PARTITION BY code ORDER BY date) AS before FROM t1)",
    "t3 AS (SELECT *, lag(before) OVER (PARTITION BY code ORDER BY date) AS pb FROM t2)", "ch AS (SELECT * FROM t3 WHERE shares IS NOT NULL AND shares <> pb)"))
def _(spark, sf):
    from panelwright.operators.disclosures import disclosed_shares
    from panelwright.sources.panels import disclosures

    base = panel(spark, sf).select("date", "code", "ord", "seg", "factor")
    d = DG.action_follow_up(disclosed_shares(base, disclosures(spark, sf)).drop("shares_date"), "shares")
    return keyed(d, 4, before="before", after="after")


@query("d_27_feature_difference", on_panel(f"""
SELECT feature, count(*) AS rows, count(*) FILTER (WHERE o IS DISTINCT FROM n) AS changed, {r('max(abs(n - o)) / 1000', 6)} AS max_change FROM (
 SELECT 'atr' AS feature, a.atr AS o, b.atr AS n FROM trr a JOIN trl b ON a.date = b.date AND a.code = b.code
 UNION ALL SELECT 'tr', a.tr, b.tr FROM trr a JOIN trl b ON a.date = b.date AND a.code = b.code) GROUP BY feature""", FP._TR,
    FP._tr(f"lag(scl) OVER ({W}) / factor").replace("tr0", "tl0").replace("tr1", "tl1").replace("trr AS", "trl AS")))
def _(spark, sf):
    base = FP._safe(spark, sf).select("date", "code", "seg", "factor", "s_high", "s_low", "s_close")
    d = DG.feature_difference(X.true_range(base), X.true_range(base, legacy=True), ["atr", "tr"])
    return d.select("feature", "rows", "changed", rounded(F.col("max_change") / 1000, 6).alias("max_change"))


@query("d_28_zero_code_order", on_events(f"""
SELECT {D}, {r(scorr('a', 'b'))} AS rho FROM (SELECT date, row_number() OVER (PARTITION BY date ORDER BY code) AS a, {avg_rank('q', 'date')} AS b FROM sq WHERE sn = 0 AND q IS NOT NULL)
GROUP BY date HAVING count(*) >= 3 AND {scorr('a', 'b')} IS NOT NULL""", _SQ))
def _(spark, sf):
    d = DG.zero_order_relation(_held(spark, sf).where("q is not null"), "side_score", "q", cross_section(spark, sf))
    return d.select(day_text().alias("date"), rounded("rho").alias("rho"))


TRACE = ["o_duration", "o_width", "o_position", "o_strength", "o_distance"]
_TRACE = f"""fc AS MATERIALIZED (SELECT date AS fd, (SELECT min(y) FROM (SELECT year(date) AS y, min(ord) AS k FROM cal GROUP BY 1) s WHERE cal.ord < s.k - 2) AS fold FROM cal),
trc0 AS (SELECT evx.*, year(date) AS yr, fc.fold, {centered('target')} AS yc FROM evx JOIN fc ON fd = date),
trc1 AS MATERIALIZED (SELECT date, code, yr, fold, 'high' AS side, 1 AS sign, dur AS o_duration, width AS o_width, pos AS o_position, strength AS o_strength, dh AS o_distance, yc AS ys FROM trc0 WHERE he > 0
 UNION ALL SELECT date, code, yr, fold, 'low', -1, dur, width, 1 - pos, -strength, dl, -yc FROM trc0 WHERE le > 0),
{ridge_ctes('rg', 'trc1', 'fold', TRACE, 'ys', min_rows=60, extra='side')},
trc2 AS (SELECT trc1.*, {ridge_score('rg', TRACE)} AS pr, rg.grp FROM trc1 LEFT JOIN rg ON rg.grp = yr AND rg.side = trc1.side),
trc3 AS (SELECT *, CASE WHEN grp IS NOT NULL THEN pr END AS prediction FROM trc2)"""


@query("d_29_event_trace", on_panel(f"""
SELECT {KS}, side, {', '.join(f'{r(c, 6)} AS {c}' for c in [*TRACE, 'prediction'])}, {r(f"sign * coalesce(0.5 + 0.5 * {pct_rank('prediction', 'date, side')}, 0)", 6)} AS signed FROM trc3""",
    FP._TR, FP._box(), FP._BPOS, FP._STR, _TRACE))
def _(spark, sf):
    """Inputs, prediction, percentile and signed score of every event on both sides.

    A side's model of a year is fitted on labels known before the year, and is
    oriented like its inputs; years without one have no prediction.
    """
    xs, scale = cross_section(spark, sf), scale_of(spark, sf)
    return _event_trace(stage(spark, sf, "traces", lambda: _event_rows(FP.event_panel(spark, sf), xs, scale)), xs)


def _event_rows(panel_, xs, scale):
    """Rows with an event on either side, the label ranked among all rows: few, and read for both fits and both scores."""
    d = M.with_fold(xs.centered_rank(panel_, "target", "y", missing=None), scale)
    d = d.where(G.is_event("high") | G.is_event("low"))
    return d.select("date", "code", "seg", "year", "fold", "y", "box_duration", "box_width", "close_position", "strength",
                    *[c for side in ("high", "low") for c in (f"{side}_available", f"new_{side}_excess", f"distance_to_{side}")])


def _event_trace(base, xs):
    names = TRACE
    out = None
    for side, sign in (("high", 1), ("low", -1)):
        d = X.directional(base, side).where("event").withColumn("y", sign * F.col("y"))
        models = M.fit_ridge(d, names, "y", "fold", len(names), min_rows=60)
        d = M.score_linear(d, models, names, F.col("year"), "prediction")
        d = xs.active_percentile(d, "prediction", F.col("prediction").isNotNull(), "signed").withColumn("signed", sign * F.col("signed"))
        d = d.withColumn("side", F.lit(side))
        out = d if out is None else out.unionByName(d)
    return keyed(out, 6, keep=["side"], **{c: c for c in [*names, "prediction", "signed"]})


@query("d_30_event_forward", on_events(f"""
SELECT side, count(y) AS events, {r('avg(y)', 6)} AS mean_event, {r('quantile_cont(y, 0.5)', 6)} AS median_event, {r('avg(CASE WHEN y > 0 THEN 1.0::DOUBLE WHEN y <= 0 THEN 0 END)', 6)} AS positive,
 {r('(SELECT avg(m) FROM (SELECT avg(y) AS m FROM fw f2 WHERE f2.side = fw.side GROUP BY f2.date))', 6)} AS mean_date FROM fw GROUP BY side""",
    f"""fw0 AS (SELECT p.date, p.code, p.he, p.le, CASE WHEN count(f.resid) = 5 AND min(f.resid) > -1 THEN exp(sum(CASE WHEN f.resid > -1 THEN ln(1 + f.resid) END)) - 1 END AS y
  FROM en p LEFT JOIN en f ON f.code = p.code AND f.ord BETWEEN p.ord + 2 AND p.ord + 6 WHERE p.he OR p.le GROUP BY ALL),
fw AS (SELECT date, code, CASE WHEN he THEN 'high' ELSE 'low' END AS side, CASE WHEN he THEN y ELSE -y END AS y FROM fw0)"""))
def _(spark, sf):
    d = agg.forward_compound(events(spark, sf), "resid", 5, "y", scale_of(spark, sf))
    d = d.where("high_event or low_event").withColumn("side", F.when(F.col("high_event"), "high").otherwise("low"))
    d = d.withColumn("y", F.when(F.col("side") == "high", F.col("y")).otherwise(-F.col("y")))
    from panelwright.operators.xsection import CrossSection

    per = d.groupBy("side", "date").agg(F.avg("y").alias("m")).groupBy("side").agg(rounded(F.avg("m"), 6).alias("mean_date"))
    med = CrossSection(scale_of(spark, sf).pooled()).quantile_table(d, "y", {"median_event": 0.5}, ["side"])
    g = d.groupBy("side").agg(F.count("y").alias("events"), rounded(F.avg("y"), 6).alias("mean_event"), rounded(agg.share(F.col("y") > 0), 6).alias("positive"))
    return g.join(per, "side").join(med, "side").select("side", "events", "mean_event", "positive", "mean_date", rounded("median_event", 6).alias("median_event"))
