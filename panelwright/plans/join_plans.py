"""Joins and set operations."""

from pyspark.sql import functions as F

from panelwright.functions.scalar import day_text, rounded
from panelwright.operators import aggregates as agg
from panelwright.operators import asof as A
from panelwright.operators import membership as M
from panelwright.operators.disclosures import comparable_pairs, report_versions
from panelwright.plans.common import KS, keyed, keyed_sql
from panelwright.plans.registry import query
from panelwright.plans.sql import ATTR_CTES, FINS_CTES, MACRO_CTES, day, on_panel, quintile, r
from panelwright.sources.panels import (cross_section, disclosures, macro_series, panel, scale_of, with_attributes)

def _asof_sql(op, out):
    return on_panel(f"""
SELECT {day('p.date')} AS date, p.code, {out}
FROM pan p ASOF LEFT JOIN last_day f ON p.code = f.code AND p.date {op} f.disclosed""", FINS_CTES,
                    "last_day AS (SELECT code, disclosed, max(number) AS number, arg_max(cfo, number) AS cfo FROM fins GROUP BY ALL)")


def _last_day(spark, sf):
    return A.last_per_day(disclosures(spark, sf), ["code"], "disclosed", "number", ["number", "cfo"])


def _keys(spark, sf):
    return panel(spark, sf).select("date", "code", "ord", "seg", "ret")


@query("j_01_one_to_one", on_panel(keyed_sql("pan JOIN (SELECT date AS d2, code AS c2, volume AS v2 FROM pan WHERE volume > 50) ON d2 = date AND c2 = code", x="ret", v="v2")))
def _(spark, sf):
    d = panel(spark, sf)
    right = d.where("volume > 50").select("date", "code", F.col("volume").alias("v2"))
    return keyed(d.select("date", "code", "ret").join(right, ["date", "code"]), x="ret", v="v2")


@query("j_02_many_to_one", on_panel(f"""
SELECT {KS}, {r('s')} AS month_sum FROM pan LEFT JOIN (SELECT code AS c2, seg AS s2, date_trunc('month', date) AS m2,
  CASE WHEN count(ret) >= 2 THEN sum(ret) END AS s FROM pan GROUP BY 1, 2, 3) ON c2 = code AND s2 = seg AND m2 = date_trunc('month', date)"""))
def _(spark, sf):
    d = _keys(spark, sf)
    m = agg.monthly(d, "ret", 2).select("code", "seg", "month", "month_sum")
    return keyed(d.withColumn("month", F.trunc("date", "month")).join(m, ["code", "seg", "month"], "left"), month_sum="month_sum")


@query("j_03_date_join", on_panel(keyed_sql("pan", x="mkt")))
def _(spark, sf):
    d = panel(spark, sf)
    market = d.groupBy("date").agg(F.avg("ret").alias("m2"))
    return keyed(d.select("date", "code").join(scale_of(spark, sf).per_date(market), "date", "left"), x="m2")


@query("j_04_asof_inclusive", _asof_sql(">=", f"f.number, {r('f.cfo', 4)} AS cfo"))
def _(spark, sf):
    d = A.asof(_keys(spark, sf), _last_day(spark, sf), ["code"], "date", "disclosed", ["number", "cfo"])
    return keyed(d, 4, ["number"], cfo="cfo")


@query("j_05_asof_strict", _asof_sql(">", f"f.number, {r('f.cfo', 4)} AS cfo"))
def _(spark, sf):
    d = A.asof(_keys(spark, sf), _last_day(spark, sf), ["code"], "date", "disclosed", ["number", "cfo"], strict=True)
    return keyed(d, 4, ["number"], cfo="cfo")


@query("j_06_asof_unkeyed", on_panel(f"""
SELECT {day('c.date')} AS date, {r('m.macro', 4)} AS macro FROM cal c ASOF LEFT JOIN macro m ON CAST(c.date AS TIMESTAMP) >= m.available""", MACRO_CTES))
def _(spark, sf):
    dates = panel(spark, sf).select("date").distinct()
    d = A.asof_unkeyed(dates, macro_series(spark, sf), "date", "available", ["macro"])
    return d.select(day_text().alias("date"), rounded("macro", 4).alias("macro"))


@query("j_07_fieldwise_asof", on_panel(f"""
SELECT {day('p.date')} AS date, p.code, {r('a.assets', 4)} AS assets, {r('s.shares', 2)} AS shares
FROM pan p ASOF LEFT JOIN la a ON p.code = a.code AND p.date >= a.disclosed
ASOF LEFT JOIN ls s ON p.code = s.code AND p.date >= s.disclosed""", FINS_CTES,
    "la AS (SELECT code, disclosed, arg_max(assets, number) AS assets FROM fins WHERE assets IS NOT NULL GROUP BY ALL)",
    "ls AS (SELECT code, disclosed, arg_max(shares, number) AS shares FROM fins WHERE shares IS NOT NULL GROUP BY ALL)"))
def _(spark, sf):
    right = A.last_field_per_day(disclosures(spark, sf), ["code"], "disclosed", "number", ["assets", "shares"])
    d = A.asof(_keys(spark, sf), right, ["code"], "date", "disclosed", ["assets", "shares"], per_column=True)
    return d.select(day_text().alias("date"), "code", rounded("assets", 4).alias("assets"), rounded("shares", 2).alias("shares"))


@query("j_08_asof_expiry", _asof_sql(">", f"{r('CASE WHEN p.date - f.disclosed BETWEEN 0 AND 20 THEN f.cfo END', 4)} AS cfo"))
def _(spark, sf):
    d = A.asof(_keys(spark, sf), _last_day(spark, sf), ["code"], "date", "disclosed", ["cfo"], strict=True)
    return keyed(d, 4, cfo=A.unexpired("cfo", "date", "disclosed", 20))


@query("j_09_calendar_offset", on_panel(f"""
SELECT {day('a.date')} AS date, a.code, {r('b.close')} AS ahead FROM pan a LEFT JOIN pan b ON a.code = b.code AND b.ord = a.ord + 5"""))
def _(spark, sf):
    return keyed(A.at_offset(panel(spark, sf).select("date", "code", "ord", "close"), {"close": "ahead"}, 5), ahead="ahead")


_VERSIONS = """ver AS (SELECT *, split_part(document, 'FinancialStatements_', 2) AS basis, "end" - "start" AS dur FROM fins
 WHERE contains(document, 'FinancialStatements_') AND CASE period WHEN '1Q' THEN "end" - "start" BETWEEN 80 AND 100
   WHEN '2Q' THEN "end" - "start" BETWEEN 170 AND 195 WHEN '3Q' THEN "end" - "start" BETWEEN 260 AND 285 ELSE "end" - "start" BETWEEN 350 AND 380 END)"""


@query("j_10_comparable_report", "WITH " + FINS_CTES + "," + _VERSIONS + f"""
SELECT DISTINCT a.code, a.period, a.basis, {day('a."end"')} AS "end", {day('b."end"')} AS old_end
FROM (SELECT DISTINCT code, period, basis, "start", "end", dur FROM ver) a JOIN (SELECT DISTINCT code, period, basis, "start", "end", dur FROM ver) b
  ON a.code = b.code AND a.period = b.period AND a.basis = b.basis
 AND abs(b."start" - CAST(a."start" - INTERVAL 1 YEAR AS DATE)) <= 7 AND abs(b."end" - CAST(a."end" - INTERVAL 1 YEAR AS DATE)) <= 7
 AND abs(a.dur - b.dur) <= 7""")
def _(spark, sf):
    d = comparable_pairs(report_versions(disclosures(spark, sf)), ["code"])
    return d.select("code", "period", "basis", day_text("end").alias("end"), day_text("old_end").alias("old_end"))


@query("j_11_dense_grid", on_panel(f"""
SELECT {day('c.date')} AS date, s.sector33, coalesce(n, 0) AS n, {r('coalesce(v, 0)', 4)} AS v FROM cal c CROSS JOIN (SELECT DISTINCT sector33 FROM attr) s
LEFT JOIN (SELECT date, sector33, count(*) AS n, sum(volume) AS v FROM pa WHERE ret > 1 GROUP BY 1, 2) f ON f.date = c.date AND f.sector33 = s.sector33""", ATTR_CTES))
def _(spark, sf):
    d = with_attributes(panel(spark, sf), spark, sf)
    facts = d.where("ret > 1").groupBy("date", "sector33").agg(F.count("*").alias("n"), F.sum("volume").alias("v"))
    from panelwright.sources.panels import attributes

    g = agg.densify(d.select("date").distinct(), attributes(spark, sf), facts, "sector33", ["n", "v"])
    return g.select(day_text().alias("date"), "sector33", "n", rounded("v", 4).alias("v"))


@query("j_12_anti_join", on_panel(f"SELECT {KS} FROM pan WHERE target IS NOT NULL AND beta IS NULL"))
def _(spark, sf):
    d = panel(spark, sf)
    target, scored = d.where("target is not null"), d.where("beta is not null")
    return keyed(target.join(scored.select("date", "code"), ["date", "code"], "left_anti"))


@query("j_13_semi_join", on_panel(keyed_sql("pan WHERE date IN (SELECT date FROM mk WHERE mkt > 0.2)", x="ret")))
def _(spark, sf):
    d = panel(spark, sf)
    dates = d.where("mkt > 0.2").select("date").distinct()
    return keyed(d.join(scale_of(spark, sf).per_date(dates), "date", "left_semi"), x="ret")


@query("j_14_index_intersection", on_panel(keyed_sql("pan WHERE target IS NOT NULL AND resid IS NOT NULL", x="resid", y="target")))
def _(spark, sf):
    d = panel(spark, sf)
    x = d.where("resid is not null").select("date", "code", "resid")
    y = d.where("target is not null").select("date", "code", "target")
    return keyed(x.join(y, ["date", "code"]), x="resid", y="target")


_EVENTS = """ev AS (SELECT date, code, seg, ret, coalesce(ret > 0.8, false) AS hit FROM pan),
org AS (SELECT *, max(CASE WHEN hit THEN date END) OVER (PARTITION BY code, seg ORDER BY date) AS origin FROM ev)"""


@query("j_15_origin_lookup", on_panel(f"""
SELECT {day('o.date')} AS date, o.code, {day('o.origin')} AS origin, {r('s.ret')} AS origin_score
FROM org o JOIN ev s ON s.code = o.code AND s.date = o.origin""", _EVENTS))
def _(spark, sf):
    d = _keys(spark, sf).withColumn("hit", F.coalesce(F.col("ret") > 0.8, F.lit(False)))
    d = M.origin_value(d, "hit", "ret", "origin_score").where("origin is not null")
    return d.select(day_text().alias("date"), "code", day_text("origin").alias("origin"),
                    rounded("origin_score").alias("origin_score"))


_TWO = f"""bk AS (SELECT date, code, ord, {quintile('ret')} AS qa, {quintile('volume')} AS qb FROM pan)"""


def _two_books(spark, sf):
    xs = cross_section(spark, sf)
    d = xs.quintile(panel(spark, sf), "ret", "qa", "wa")
    return xs.quintile(d, "volume", "qb", "wb").select("date", "code", "ord", "qa", "qb")


@query("j_16_book_overlap", on_panel(f"""
SELECT {day()} AS date, count(*) FILTER (WHERE qa = 4) AS base, count(*) FILTER (WHERE qb = 4) AS other,
       count(*) FILTER (WHERE qa = 4 AND qb = 4) AS both, {r('count(*) FILTER (WHERE qa = 4 AND qb = 4) / nullif(count(*) FILTER (WHERE qa = 4), 0)')} AS share
FROM bk GROUP BY date""", _TWO))
def _(spark, sf):
    d = M.overlap(_two_books(spark, sf), F.col("qa") == 4, F.col("qb") == 4)
    return d.select(day_text().alias("date"), "base", "other", "both", rounded("share").alias("share"))


# -- set operations -----------------------------------------------------------
@query("so_01_union_folds", on_panel(f"SELECT CAST(year(date) AS BIGINT) AS year, count(*) AS rows FROM pan GROUP BY 1"))
def _(spark, sf):
    d = _keys(spark, sf)
    first, last = d.agg(F.min(F.year("date")), F.max(F.year("date"))).first()
    folds = [d.where(F.year("date") == y) for y in range(first, last + 1)]
    return M.union_folds(folds).groupBy(F.year("date").cast("long").alias("year")).agg(F.count("*").alias("rows"))


@query("so_02_intersect", on_panel(f"SELECT {KS} FROM bk WHERE qa = 4 INTERSECT SELECT {KS} FROM bk WHERE qb = 4", _TWO))
def _(spark, sf):
    d = _two_books(spark, sf)
    return keyed(d.where("qa = 4").select("date", "code").intersect(d.where("qb = 4").select("date", "code")))


@query("so_03_difference", on_panel(f"SELECT {KS} FROM bk WHERE qa = 4 EXCEPT SELECT {KS} FROM bk WHERE qb = 4", _TWO))
def _(spark, sf):
    d = _two_books(spark, sf)
    return keyed(d.where("qa = 4").select("date", "code").exceptAll(d.where("qb = 4").select("date", "code")))


@query("so_04_membership_flow", on_panel(f"""
SELECT {day('c.date')} AS date, count(*) FILTER (WHERE a AND b) AS retained, count(*) FILTER (WHERE a AND NOT b) AS entrants,
       count(*) FILTER (WHERE b AND NOT a) AS exits
FROM (SELECT coalesce(x.ord, y.ord + 1) AS ord, x.code IS NOT NULL AS a, y.code IS NOT NULL AS b
      FROM (SELECT * FROM bk WHERE qa = 4) x FULL JOIN (SELECT * FROM bk WHERE qa = 4) y ON x.code = y.code AND x.ord = y.ord + 1) z
JOIN cal c ON c.ord = z.ord GROUP BY c.date""", _TWO))
def _(spark, sf):
    d = _two_books(spark, sf)
    flow = M.flow(d.where("qa = 4"))
    dates = d.select("date", "ord").distinct()
    return flow.join(scale_of(spark, sf).per_date(dates), "ord").select(day_text().alias("date"), "retained", "entrants", "exits")
