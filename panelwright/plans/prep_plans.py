"""Projection, alignment, filtering and scalar cleaning."""

from pyspark.sql import functions as F

from panelwright.functions import scalar as S
from panelwright.functions.scalar import day_text, rounded
from panelwright.operators.asof import last_per_day
from panelwright.plans.common import KS
from panelwright.plans.registry import query
from panelwright.plans.sql import ATTR_CTES, FINS_CTES, MACRO_CTES, day, on_panel, r
from panelwright.sources.panels import (disclosures, macro_series, panel, table, with_attributes)



def K():
    return [day_text().alias("date"), "code"]


@query("pf_01_finite", on_panel(f"""
SELECT {KS}, {r('CASE WHEN volume <> 100 THEN turnover / (volume - 100) END')} AS x FROM pan"""))
def _(spark, sf):
    d = panel(spark, sf)
    # Division by zero yields an infinity under IEEE rules; it must come out missing.
    raw = F.when(F.col("volume") == 100, F.lit(float("inf"))).otherwise(
        F.col("turnover") / F.nullif(F.col("volume") - 100, F.lit(0.0)))
    return d.select(*K(), rounded(S.finite(raw)).alias("x"))


@query("pf_02_positive", on_panel(f"SELECT {KS}, {r('CASE WHEN ret > 0 THEN ret END')} AS x FROM pan"))
def _(spark, sf):
    return panel(spark, sf).select(*K(), rounded(S.positive("ret")).alias("x"))


@query("pf_03_reindex", on_panel(f"""
SELECT {day('p.date')} AS date, p.code, {r('q.pm_open')} AS x
FROM pan p LEFT JOIN (SELECT * FROM qt WHERE pm_open IS NOT NULL) q ON p.date = q.date AND p.code = q.code"""))
def _(spark, sf):
    d = panel(spark, sf)
    other = d.where("pm_open is not null").select("date", "code", "pm_open")
    return d.select("date", "code").join(other, ["date", "code"], "left").select(*K(), rounded("pm_open").alias("x"))


@query("pf_04_clip", on_panel(f"""
SELECT {KS}, {r('CASE WHEN ret IS NOT NULL THEN least(0.5::DOUBLE, greatest(-0.25::DOUBLE, ret)) END')} AS x FROM pan"""))
def _(spark, sf):
    return panel(spark, sf).select(*K(), rounded(S.clip("ret", -0.25, 0.5)).alias("x"))


@query("pf_05_strict_max", on_panel(f"""
SELECT {KS}, {r('CASE WHEN am_open IS NOT NULL AND pm_open IS NOT NULL THEN greatest(am_open, pm_open, open) END')} AS x FROM pan"""))
def _(spark, sf):
    return panel(spark, sf).select(*K(), rounded(S.strict_max("am_open", "pm_open", "open")).alias("x"))


@query("pf_06_select", on_panel(f"""
SELECT {KS}, {r("CASE WHEN ret > 0.5 THEN 1.0 WHEN ret > 0 THEN 0.5 WHEN ret IS NULL THEN NULL ELSE -ret END")} AS x FROM pan"""))
def _(spark, sf):
    x = F.when(F.col("ret") > 0.5, 1.0).when(F.col("ret") > 0, 0.5).when(
        F.col("ret").isNull(), None).otherwise(-F.col("ret"))
    return panel(spark, sf).select(*K(), rounded(x).alias("x"))


@query("pf_07_category_code", on_panel("""
SELECT code, size_band, size FROM (SELECT DISTINCT code, size_band, size FROM pa)""", ATTR_CTES))
def _(spark, sf):
    return with_attributes(panel(spark, sf).select("code").distinct(), spark, sf).select("code", "size_band", "size")


@query("pf_08_document_parse", "WITH " + FINS_CTES + """
SELECT number, CASE WHEN contains(document, 'FinancialStatements_') THEN split_part(document, 'FinancialStatements_', 2) END AS basis,
       regexp_extract(document, '_([A-Z]+)$', 1) AS suffix FROM fins""")
def _(spark, sf):
    return disclosures(spark, sf).select("number", S.accounting_basis("document").alias("basis"),
                                         F.regexp_extract("document", "_([A-Z]+)$", 1).alias("suffix"))


@query("pf_09_lenient_cast", f"""
SELECT o_orderkey, {r("TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE)")} AS num,
       {r("TRY_CAST(o_orderpriority AS DOUBLE)")} AS bad,
       {day("TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderstatus END AS DATE)")} AS d
FROM orders""")
def _(spark, sf):
    text = F.when(F.col("o_orderstatus") == "F", day_text("o_orderdate")).otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders").select(
        "o_orderkey", rounded(S.to_number(F.split("o_orderpriority", "-")[0])).alias("num"),
        rounded(S.to_number("o_orderpriority")).alias("bad"), day_text(S.to_day(text)).alias("d"))


@query("pf_10_zone_day", f"""
SELECT event_id, {day("ts + INTERVAL 9 HOUR")} AS local_day FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", day_text(S.local_day("ts")).alias("local_day"))


@query("pf_10_macro_stamp", "WITH " + MACRO_CTES + f"""
SELECT {day('month')} AS month, strftime(available, '%Y-%m-%d %H:%M:%S') AS available, {r('macro', 4)} AS macro FROM macro""")
def _(spark, sf):
    return macro_series(spark, sf).select(
        day_text("month").alias("month"), F.date_format("available", "yyyy-MM-dd HH:mm:ss").alias("available"),
        rounded("macro", 4).alias("macro"))


@query("pf_11_default_label", on_panel("""
SELECT coalesce(CASE WHEN sector33 <> '3' THEN sector33 END, 'unknown') AS sector, count(*) AS rows FROM pa GROUP BY 1""", ATTR_CTES))
def _(spark, sf):
    d = with_attributes(panel(spark, sf).select("code"), spark, sf)
    s = S.label_or(F.when(F.col("sector33") != "3", F.col("sector33")))
    return d.groupBy(s.alias("sector")).agg(F.count("*").alias("rows"))


@query("pf_12_period_window", on_panel(f"""
SELECT {day()} AS date, count(*) AS rows FROM pan
WHERE date >= DATE '1997-01-01' AND ord <= (SELECT max(ord) - 2 FROM cal WHERE date < DATE '2000-01-01') GROUP BY 1"""))
def _(spark, sf):
    from panelwright.operators.select import select_window

    return select_window(panel(spark, sf), "1997-01-01", "2000-01-01").groupBy(
        day_text().alias("date")).agg(F.count("*").alias("rows"))


@query("pf_13_year_filter", on_panel(f"SELECT {KS}, {r('close')} AS close FROM pan WHERE year(date) = 1998"))
def _(spark, sf):
    return panel(spark, sf).where(F.year("date") == 1998).select(*K(), rounded("close").alias("close"))


@query("pf_14_last_event_per_day", "WITH " + FINS_CTES + f"""
SELECT code, {day('disclosed')} AS disclosed, max(number) AS number, {r('arg_max(cfo, number)', 4)} AS cfo
FROM fins GROUP BY code, disclosed""")
def _(spark, sf):
    d = last_per_day(disclosures(spark, sf), ["code"], "disclosed", "number", ["number", "cfo"])
    return d.select("code", day_text("disclosed").alias("disclosed"), "number", rounded("cfo", 4).alias("cfo"))
