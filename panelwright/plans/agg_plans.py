"""Aggregations over the panel."""

from pyspark.sql import functions as F

from panelwright.functions.scalar import day_text, first_argmax, fixed_bins, rounded
from panelwright.operators import aggregates as agg
from panelwright.operators.evaluation import rank_ic
from panelwright.plans.registry import query
from panelwright.plans.sql import ATTR_CTES, avg_rank, day, on_panel, on_scored, r
from panelwright.sources.panels import cross_section, panel, scored, with_attributes

D = f"{day()} AS date"


def _by_date(df, **cols):
    return df.select(day_text().alias("date"), *[rounded(c).alias(k) for k, c in cols.items()])


@query("a_01_per_date_stats", on_panel(f"""
SELECT {D}, {r('sum(volume)', 4)} AS total, {r('avg(ret)')} AS mean, count(ret) AS n, count(*) AS size, {r('stddev_samp(ret)')} AS std,
       {r('min(ret)')} AS lo, {r('max(ret)')} AS hi, {r('quantile_cont(ret, 0.5)')} AS med, count(DISTINCT volume) AS uniq FROM pan GROUP BY date"""))
def _(spark, sf):
    d, xs = panel(spark, sf), cross_section(spark, sf)
    s = d.groupBy("date").agg(
        F.sum("volume").alias("total"), F.avg("ret").alias("mean"), F.count("ret").alias("n"), F.count("*").alias("size"),
        F.stddev_samp("ret").alias("std"), F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    u = d.groupBy("date", "volume").agg(F.lit(1).alias("one")).groupBy("date").agg(F.count("*").alias("uniq"))
    s = s.join(u, "date").join(xs.quantile_table(d, "ret", {"med": 0.5}), "date")
    return s.select(day_text().alias("date"), rounded("total", 4).alias("total"), "n", "size", "uniq",
                    *[rounded(c).alias(c) for c in ("mean", "std", "lo", "hi", "med")])


@query("a_02_sum_min_count", on_panel(f"SELECT {D}, {r('CASE WHEN count(resid) >= 60 THEN sum(resid) END')} AS x FROM pan GROUP BY date"))
def _(spark, sf):
    return _by_date(panel(spark, sf).groupBy("date").agg(agg.sum_min_count("resid", 60).alias("x")), x="x")


@query("a_03_conditional_mean", on_panel(f"""
SELECT {D}, {r('avg(CASE WHEN volume > 60 THEN ret END)')} AS busy, {r('avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE WHEN ret <= 0 THEN 0 END)')} AS up FROM pan GROUP BY date"""))
def _(spark, sf):
    g = panel(spark, sf).groupBy("date").agg(
        F.avg(F.when(F.col("volume") > 60, F.col("ret"))).alias("busy"), agg.share(F.col("ret") > 0).alias("up"))
    return _by_date(g, busy="busy", up="up")


@query("a_04_weighted_mean", on_panel(f"""
SELECT code, {r('sum(n * m) / sum(n)')} AS x FROM (SELECT code, year(date) AS y, count(ret) AS n, avg(ret) AS m FROM pan GROUP BY 1, 2) WHERE m IS NOT NULL GROUP BY code"""))
def _(spark, sf):
    f = panel(spark, sf).groupBy("code", F.year("date").alias("year")).agg(F.count("ret").alias("n"), F.avg("ret").alias("m"))
    return f.groupBy("code").agg(rounded(agg.weighted_mean("m", "n")).alias("x"))


@query("a_05_multi_key", on_panel(f"""
SELECT CAST(year(date) AS BIGINT) AS year, sector17, size_band, count(*) AS rows, {r('avg(ret)')} AS ret, {r('max(volume)', 4)} AS volume
FROM pa GROUP BY 1, 2, 3""", ATTR_CTES))
def _(spark, sf):
    d = with_attributes(panel(spark, sf), spark, sf)
    return d.groupBy(F.year("date").cast("long").alias("year"), "sector17", "size_band").agg(
        F.count("*").alias("rows"), rounded(F.avg("ret")).alias("ret"), rounded(F.max("volume"), 4).alias("volume"))


@query("a_06_grouping_sets", on_panel(f"""
SELECT year, sector17, size_band, count(*) AS rows, {r('avg(ret)')} AS ret FROM (SELECT *, CAST(year(date) AS BIGINT) AS year FROM pa)
GROUP BY GROUPING SETS ((year), (year, sector17), (year, size_band), ())""", ATTR_CTES))
def _(spark, sf):
    d = with_attributes(panel(spark, sf), spark, sf).withColumn("year", F.year("date").cast("long"))
    y, s, b = F.col("year"), F.col("sector17"), F.col("size_band")
    return d.groupingSets([[y], [y, s], [y, b], []], y, s, b).agg(
        F.count("*").alias("rows"), rounded(F.avg("ret")).alias("ret"))


@query("a_07_quantiles", on_panel(f"""
SELECT {D}, {', '.join(f"{r(f'quantile_cont(ret, {p / 100})')} AS p{p:02d}" for p in (1, 5, 25, 50, 75, 95, 99))} FROM pan GROUP BY date"""))
def _(spark, sf):
    qs = {f"p{p:02d}": p / 100 for p in (1, 5, 25, 50, 75, 95, 99)}
    d = panel(spark, sf)
    t = cross_section(spark, sf).quantile_table(d, "ret", qs)
    return _by_date(t, **{k: k for k in qs})


@query("a_08_histogram", on_panel("SELECT CAST(floor(volume / 10) AS BIGINT) AS bin, count(*) AS n FROM pan GROUP BY 1"))
def _(spark, sf):
    return panel(spark, sf).groupBy(F.floor(F.col("volume") / 10).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("a_09_pivot", on_scored(f"""
SELECT CAST(year(date) AS BIGINT) AS year, {', '.join(f"{r(f'avg(target) FILTER (WHERE q = {k})')} AS q{k}" for k in range(5))} FROM sc GROUP BY 1"""))
def _(spark, sf):
    p = scored(spark, sf).groupBy(F.year("date").cast("long").alias("year")).pivot("q", list(range(5))).agg(F.avg("target"))
    return p.select("year", *[rounded(F.col(f"`{k}`")).alias(f"q{k}") for k in range(5)])


@query("a_10_correlation", on_panel(f"SELECT {D}, {r('corr(volume, turnover)')} AS c FROM pan GROUP BY date"))
def _(spark, sf):
    return _by_date(panel(spark, sf).groupBy("date").agg(agg.correlation("volume", "turnover").alias("c")), c="c")


@query("a_11_spearman", on_panel(f"""
SELECT {D}, {r('corr(a, b)')} AS c FROM (SELECT date, {avg_rank('resid')} AS a, {avg_rank('volume')} AS b FROM pan WHERE resid IS NOT NULL AND volume IS NOT NULL) GROUP BY date"""))
def _(spark, sf):
    return _by_date(rank_ic(panel(spark, sf), "resid", "volume", cross_section(spark, sf), out="c"), c="c")


@query("a_12_moments", on_panel(f"""
SELECT code, n, {r('m3 / pow(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2)', 6)} AS skew,
       {r('(n - 1) / ((n - 2) * (n - 3))::DOUBLE * ((n + 1) * (m4 / (m2 * m2) - 3) + 6) + 3', 6)} AS kurtosis
FROM (SELECT code, count(*) AS n, avg(pow(ret - m, 2)) AS m2, avg(pow(ret - m, 3)) AS m3, avg(pow(ret - m, 4)) AS m4
      FROM (SELECT code, ret, avg(ret) OVER (PARTITION BY code) AS m FROM pan WHERE ret IS NOT NULL) GROUP BY code)"""))
def _(spark, sf):
    return panel(spark, sf).where("ret is not null").groupBy("code").agg(*agg.moments("ret")).select(
        "code", "n", rounded("skew", 6).alias("skew"), rounded("kurtosis", 6).alias("kurtosis"))


_MONTH = """mo AS (SELECT code, seg, CAST(date_trunc('month', date) AS DATE) AS month, ret, avg(ret) OVER g AS m, stddev_samp(ret) OVER g AS s, count(ret) OVER g AS n
 FROM pan WINDOW g AS (PARTITION BY code, seg, date_trunc('month', date)))"""


@query("a_13_month_skewness", on_panel(f"""
SELECT code, CAST(seg AS BIGINT) AS seg, {day('month')} AS month, {r('CASE WHEN max(n) >= 4 AND max(s) > 0 THEN avg(pow(ret - m, 3)) / pow(max(s), 3) END')} AS skew
FROM mo GROUP BY code, seg, month""", _MONTH))
def _(spark, sf):
    m = agg.monthly(panel(spark, sf), "ret", 4)
    return m.select("code", F.col("seg").cast("long").alias("seg"), day_text("month").alias("month"), rounded("month_skew").alias("skew"))


@query("a_14_argmax", on_panel(f"""
SELECT {D}, arg_max(code, (ret, code)) AS best, CAST(count(*) FILTER (WHERE part = 'am') AS BIGINT) AS am, count(*) FILTER (WHERE part = 'pm') AS pm
FROM (SELECT *, CASE WHEN coalesce(am_volume, 0) >= coalesce(pm_volume, 0) THEN 'am' ELSE 'pm' END AS part FROM pan WHERE ret IS NOT NULL) GROUP BY date"""))
def _(spark, sf):
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    part = first_argmax(["am", "pm"], [zero("am_volume"), zero("pm_volume")])
    d = panel(spark, sf).where("ret is not null").withColumn("part", part)
    return d.groupBy("date").agg(
        F.max(F.struct("ret", "code")).alias("b"), F.count(F.when(F.col("part") == "am", 1)).alias("am"),
        F.count(F.when(F.col("part") == "pm", 1)).alias("pm")).select(
        day_text().alias("date"), F.col("b.code").alias("best"), "am", "pm")


@query("a_15_first_last", on_panel(f"""
SELECT code, {r('arg_min(pm_open, date) FILTER (WHERE pm_open IS NOT NULL)')} AS first_pm, {r('arg_max(pm_open, date) FILTER (WHERE pm_open IS NOT NULL)')} AS last_pm FROM pan GROUP BY code"""))
def _(spark, sf):
    known = F.when(F.col("pm_open").isNotNull(), F.col("date"))
    return panel(spark, sf).groupBy("code").agg(
        rounded(F.min_by("pm_open", known)).alias("first_pm"), rounded(F.max_by("pm_open", known)).alias("last_pm"))


@query("a_16_transitions", on_scored(f"""
SELECT a.q AS q0, b.q AS q1, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY a.q)')} AS p
FROM sc a JOIN sc b ON a.code = b.code AND b.ord = a.ord + 1 WHERE b.q IS NOT NULL AND a.q IS NOT NULL GROUP BY a.q, b.q"""))
def _(spark, sf):
    t = agg.transitions(scored(spark, sf).where("q is not null"), "q")
    return t.select(F.col("q").alias("q0"), F.col("next_state").alias("q1"), "n", rounded("p").alias("p"))


@query("a_17_concentration", on_panel(f"""
SELECT {D}, {r('max(v) / sum(v)')} AS max_share, {r('sum(v * v) / (sum(v) * sum(v))')} AS hhi, {r('sum(v) * sum(v) / sum(v * v)')} AS effective
FROM (SELECT date, sector33, sum(turnover) AS v FROM pa GROUP BY 1, 2) GROUP BY date""", ATTR_CTES))
def _(spark, sf):
    d = agg.concentration(with_attributes(panel(spark, sf), spark, sf), ["date"], "sector33", "turnover")
    return _by_date(d, max_share="max_share", hhi="hhi", effective="effective")


@query("a_18_fixed_bins", on_panel("""
SELECT CASE WHEN ret > -1 AND ret <= 0 THEN 'down' WHEN ret > 0 AND ret <= 1 THEN 'up' WHEN ret > 1 AND ret <= 1000 THEN 'jump' END AS band, count(*) AS n FROM pan GROUP BY 1"""))
def _(spark, sf):
    band = fixed_bins("ret", [-1.0, 0.0, 1.0, 1000.0], ["down", "up", "jump"])
    return panel(spark, sf).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("a_19_worst_days", on_panel(f"""
SELECT year, {r("avg(CASE WHEN rn <= ceil(0.05 * n) THEN mkt END)")} AS worst5, {r("min(mkt)")} AS worst, {r("avg(CASE WHEN rn <= 3 THEN mkt END)")} AS three
FROM (SELECT CAST(year(date) AS BIGINT) AS year, mkt, row_number() OVER (PARTITION BY year(date) ORDER BY mkt, date) AS rn, count(*) OVER (PARTITION BY year(date)) AS n
      FROM mk WHERE mkt IS NOT NULL) GROUP BY year"""))
def _(spark, sf):
    daily = panel(spark, sf).groupBy("date").agg(F.avg("ret").alias("mkt")).where("mkt is not null")
    d = agg.worst_days(daily.withColumn("year", F.year("date").cast("long")), "mkt", 0.05, 3, ["year"])
    return d.select("year", *[rounded(c).alias(a) for c, a in (("tail_mean", "worst5"), ("worst", "worst"), ("few_mean", "three"))])


@query("a_20_monthly", on_panel(f"""
SELECT code, CAST(seg AS BIGINT) AS seg, {day('month')} AS month, count(ret) AS n, {r('CASE WHEN count(ret) >= 2 THEN sum(ret) END')} AS total,
       {r('CASE WHEN count(ret) >= 2 THEN stddev_samp(ret) END')} AS std FROM mo GROUP BY code, seg, month""", _MONTH))
def _(spark, sf):
    m = agg.monthly(panel(spark, sf), "ret", 2)
    return m.select("code", F.col("seg").cast("long").alias("seg"), day_text("month").alias("month"),
                    F.col("month_n").alias("n"), rounded("month_sum").alias("total"), rounded("month_std").alias("std"))
