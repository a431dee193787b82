"""Operators over one date's cross-section, and ordered selection."""

from pyspark.sql import functions as F

from panelwright.functions.scalar import day_text, rounded
from panelwright.operators import crosstools as ct
from panelwright.operators import select as sel
from panelwright.operators import timeseries as ts
from panelwright.operators.xsection import rank_bins
from panelwright.plans.common import KS, keyed, keyed_sql
from panelwright.plans.registry import query
from panelwright.plans.sql import ATTR_CTES, avg_rank, centered, day, on_panel, pct_rank, quintile, r
from panelwright.sources.panels import cross_section, panel, with_attributes

N = "count(*) OVER (PARTITION BY date)"


@query("cs_01_first_rank", on_panel(f"""
SELECT {KS}, row_number() OVER (PARTITION BY date ORDER BY volume, code) AS rank FROM pan"""))
def _(spark, sf):
    d = cross_section(spark, sf).first_rank(panel(spark, sf), "volume", "rank")
    return keyed(d, keep=[F.col("rank").cast("long").alias("rank")])


@query("cs_02_average_rank", on_panel(f"""
SELECT {KS}, {r(avg_rank('volume'))} AS rank, {r(pct_rank('pm_volume'))} AS pct FROM pan"""))
def _(spark, sf):
    xs = cross_section(spark, sf)
    d = xs.average_rank(panel(spark, sf), "volume", "rank")
    return keyed(xs.pct_rank(d, "pm_volume", "pct"), rank="rank", pct="pct")


@query("cs_03_centered_rank", on_panel(keyed_sql("pan", x=f"coalesce({centered('ret')}, 0)")))
def _(spark, sf):
    return keyed(cross_section(spark, sf).centered_rank(panel(spark, sf), "ret", "x"), x="x")


@query("cs_04_centered_keep_missing", on_panel(keyed_sql("pan", x=centered("target"))))
def _(spark, sf):
    return keyed(cross_section(spark, sf).centered_rank(panel(spark, sf), "target", "x", missing=None), x="x")


@query("cs_05_neutral_percentile", on_panel(keyed_sql("pan", x=f"coalesce({pct_rank('resid')}, 0.5)")))
def _(spark, sf):
    return keyed(cross_section(spark, sf).pct_rank(panel(spark, sf), "resid", "x", missing=0.5), x="x")


@query("cs_06_percentile_by_period", on_panel(keyed_sql("pa", x=f"coalesce({pct_rank('ret', 'date, size_band')}, 0)"), ATTR_CTES))
def _(spark, sf):
    d = with_attributes(panel(spark, sf), spark, sf)
    return keyed(cross_section(spark, sf).pct_rank(d, "ret", "x", ("date", "size_band"), missing=0), x="x")


@query("cs_07_positive_rank", on_panel(keyed_sql("(SELECT *, CASE WHEN ret > 0 THEN ret END AS p FROM pan)", x=f"coalesce({pct_rank('p')}, 0)")))
def _(spark, sf):
    d = panel(spark, sf).withColumn("p", F.when(F.col("ret") > 0, F.col("ret")))
    return keyed(cross_section(spark, sf).pct_rank(d, "p", "x", missing=0), x="x")


@query("cs_08_active_percentile", on_panel(keyed_sql(
    "(SELECT *, CASE WHEN ret > 0.3 THEN volume END AS a FROM pan)", x=f"coalesce(0.5 + 0.5 * {pct_rank('a')}, 0)")))
def _(spark, sf):
    d = cross_section(spark, sf).active_percentile(panel(spark, sf), "volume", F.col("ret") > 0.3, "x")
    return keyed(d, x="x")


@query("cs_09_zscore", on_panel(keyed_sql(
    "(SELECT *, (volume - avg(volume) OVER (PARTITION BY date)) / nullif(stddev_samp(volume) OVER (PARTITION BY date), 0) AS z FROM pan)",
    x="CASE WHEN z IS NOT NULL THEN least(3, greatest(-3, z)) END")))
def _(spark, sf):
    return keyed(cross_section(spark, sf).zscore(panel(spark, sf), "volume", "x"), x="x")


@query("cs_10_fill_median", on_panel(keyed_sql("pan", x="coalesce(pm_volume, quantile_cont(pm_volume, 0.5) OVER (PARTITION BY date), 0)")))
def _(spark, sf):
    return keyed(cross_section(spark, sf).fill_median(panel(spark, sf), "pm_volume", "x"), x="x")


@query("cs_11_group_demean", on_panel(keyed_sql("pa", x="ret - avg(ret) OVER (PARTITION BY date, sector17)"), ATTR_CTES))
def _(spark, sf):
    d = with_attributes(panel(spark, sf), spark, sf)
    return keyed(cross_section(spark, sf).demean(d, "ret", "x", ("date", "sector17")), x="x")


@query("cs_12_quintile", on_panel(f"SELECT {KS}, {quintile('ret')} AS q FROM pan"))
def _(spark, sf):
    return keyed(cross_section(spark, sf).quintile(panel(spark, sf), "ret"), keep=["q"])


@query("cs_13_weight", on_panel(keyed_sql(f"(SELECT *, {quintile('ret')} AS q, {N} AS n FROM pan)", 10, w="(q - 2) / n / 1.2")))
def _(spark, sf):
    return keyed(cross_section(spark, sf).quintile(panel(spark, sf), "ret"), 10, w="w")


@query("cs_14_rank_bins", on_panel(f"""
SELECT {KS}, CAST(least(4, floor(5 * p)) AS INTEGER) AS quintile, CAST(least(9, floor(10 * p)) AS INTEGER) AS decile,
       CAST(ceil(3 * p) AS INTEGER) AS tercile FROM (SELECT *, {pct_rank('volume')} AS p FROM pan)"""))
def _(spark, sf):
    d = cross_section(spark, sf).pct_rank(panel(spark, sf), "volume", "p")
    return keyed(d, keep=[rank_bins("p", k).alias(k) for k in ("quintile", "decile", "tercile")])


@query("cs_15_tail_masks", on_panel(f"""
SELECT {KS}, row_number() OVER (PARTITION BY date ORDER BY volume, code) / {N}::DOUBLE <= 0.1 AS low_tail,
       row_number() OVER (PARTITION BY date ORDER BY volume, code) / {N}::DOUBLE > 0.9 AS high_tail,
       p <= quantile_cont(p, 0.2) OVER (PARTITION BY date) AS low_quintile,
       p >= quantile_cont(p, 0.8) OVER (PARTITION BY date) AS high_quintile
FROM (SELECT *, {pct_rank('volume')} AS p FROM pan)"""))
def _(spark, sf):
    d = ct.tail_masks(panel(spark, sf), "volume", cross_section(spark, sf))
    return keyed(d, keep=["low_tail", "high_tail", "low_quintile", "high_quintile"])


@query("cs_16_tie_orders", on_panel(f"""
SELECT {KS}, row_number() OVER (PARTITION BY date ORDER BY volume, code DESC) AS r_desc,
       row_number() OVER (PARTITION BY date ORDER BY volume, md5('7|' || code), code) AS r_hash FROM pan"""))
def _(spark, sf):
    xs = cross_section(spark, sf)
    d = xs.first_rank(panel(spark, sf), "volume", "r_desc", tie=(F.col("code").desc(),))
    d = xs.first_rank(d, "volume", "r_hash", tie=(ct.keyed_order("code", seed=7), "code"))
    return keyed(d, keep=[F.col(c).cast("long").alias(c) for c in ("r_desc", "r_hash")])


@query("cs_16_permuted_ties", on_panel(f"""
SELECT {KS}, row_number() OVER (PARTITION BY date ORDER BY volume, md5('11|' || {day()} || '|' || code), code) AS r_permuted,
       row_number() OVER (PARTITION BY date ORDER BY volume + 1e-7::DOUBLE * (CAST('0x' || substr(md5('5|' || code), 1, 4) AS BIGINT) / 65536::DOUBLE), code) AS r_perturbed FROM pan"""))
def _(spark, sf):
    """Ties in a permutation of each date's own, and after a perturbation far below the values' grid."""
    xs = cross_section(spark, sf)
    d = xs.first_rank(panel(spark, sf), "volume", "r_permuted", tie=(ct.keyed_order(day_text(), "code", seed=11), "code"))
    noise = F.conv(F.substring(ct.keyed_order("code", seed=5), 1, 4), 16, 10).cast("double") / 65536
    d = xs.first_rank(d.withColumn("v", F.col("volume") + 1e-7 * noise), "v", "r_perturbed")
    return keyed(d, keep=[F.col(c).cast("long").alias(c) for c in ("r_permuted", "r_perturbed")])


@query("cs_17_ties", on_panel(f"""
SELECT {day()} AS date, CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_scores, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicated,
       CAST(sum(CASE WHEN lo <> hi THEN n ELSE 0 END) AS BIGINT) AS crossing, {r('count(*) / sum(n)')} AS unique_ratio
FROM (SELECT date, volume, count(*) AS n, min(q) AS lo, max(q) AS hi FROM (SELECT *, {quintile('volume')} AS q FROM pan) GROUP BY date, volume) GROUP BY date"""))
def _(spark, sf):
    d = cross_section(spark, sf).quintile(panel(spark, sf), "volume")
    d = ct.tie_diagnostics(d, "volume", "q")
    return d.select(day_text().alias("date"), "rows", "distinct_scores", "duplicated", "crossing",
                    rounded("unique_ratio").alias("unique_ratio"))


@query("cs_18_dispersion", on_panel(f"""
SELECT {day()} AS date, {r('stddev_samp(ret)')} AS std, count(DISTINCT ret) AS uniq, count(DISTINCT ret) <= 1 AS constant,
       {r('avg(abs(ret)) / nullif(stddev_samp(ret), 0)')} AS size_ratio FROM pan GROUP BY date"""))
def _(spark, sf):
    d = ct.dispersion(panel(spark, sf), "ret")
    return d.select(day_text().alias("date"), rounded("std").alias("std"), "uniq", "constant", rounded("size_ratio").alias("size_ratio"))


@query("cs_19_weak_positive", on_panel(f"""
SELECT {KS}, coalesce(p <= quantile_cont(p, 0.5) OVER (PARTITION BY date), false) AS weak
FROM (SELECT *, CASE WHEN ret > 0 THEN ret END AS p FROM pan)"""))
def _(spark, sf):
    return keyed(ct.weak_positive(panel(spark, sf), "ret", cross_section(spark, sf)), keep=["weak"])


@query("cs_20_reverse_dates", on_panel(f"""
SELECT {day('a.date')} AS date, a.code, {r('CASE WHEN flip THEN b.volume ELSE a.volume END')} AS x FROM
 (SELECT *, CAST('0x' || substr(md5('11|' || {day()}), 1, 4) AS BIGINT) % 2 = 0 AS flip,
  row_number() OVER (PARTITION BY date ORDER BY code) AS rn, {N} AS n FROM pan) a
JOIN (SELECT date, volume, row_number() OVER (PARTITION BY date ORDER BY code) AS rn FROM pan) b ON a.date = b.date AND b.rn = a.n + 1 - a.rn"""))
def _(spark, sf):
    d = ct.reverse_some_dates(panel(spark, sf).select("date", "code", "volume"), "volume", "x",
                              cross_section(spark, sf), seed=11)
    return keyed(d, x="x")


# -- ordered selection --------------------------------------------------------
@query("sl_01_canonical_order", on_panel(f"""
SELECT {KS}, row_number() OVER (ORDER BY date, code) AS position FROM pan"""))
def _(spark, sf):
    return keyed(ct.canonical_position(panel(spark, sf).repartition(7), cross_section(spark, sf)), keep=["position"])


@query("sl_02_mixed_order", on_panel(f"""
SELECT {KS}, row_number() OVER (PARTITION BY date ORDER BY volume DESC, rr, code) AS position FROM
 (SELECT *, row_number() OVER (PARTITION BY date ORDER BY coalesce(ret, 0), code) AS rr FROM pan)"""))
def _(spark, sf):
    xs = cross_section(spark, sf)
    d = panel(spark, sf).withColumn("r0", F.coalesce("ret", F.lit(0.0)))
    d = xs.position(xs.first_rank(d, "r0", "rr"), [F.col("volume").desc(), "rr", "code"], "position")
    return keyed(d, keep=[F.col("position").cast("long").alias("position")])


@query("sl_03_veto_last", on_panel(f"""
SELECT {KS}, row_number() OVER (PARTITION BY date ORDER BY veto, coalesce(ret, 0), code) AS position
FROM (SELECT *, volume > 100 AS veto FROM pan)"""))
def _(spark, sf):
    d = panel(spark, sf).withColumn("veto", F.col("volume") > 100).withColumn("r0", F.coalesce("ret", F.lit(0.0)))
    d = cross_section(spark, sf).position(d, ["veto", "r0", "code"], "position")
    return keyed(d, keep=[F.col("position").cast("long").alias("position")])


@query("sl_04_top_n", on_panel(keyed_sql("(SELECT * FROM pan WHERE ret IS NOT NULL ORDER BY ret DESC, date, code LIMIT 25)", ret="ret")))
def _(spark, sf):
    d = panel(spark, sf).where("ret is not null").orderBy(F.col("ret").desc(), "date", "code").limit(25)
    return keyed(d, ret="ret")


@query("sl_05_every_fifth_date", on_panel(f"SELECT {day()} AS date, count(*) AS rows FROM pan WHERE ord % 5 = 0 GROUP BY date"))
def _(spark, sf):
    return sel.every_kth_date(panel(spark, sf), 5).groupBy(day_text().alias("date")).agg(F.count("*").alias("rows"))


@query("sl_06_boundary_sample", on_panel(f"""
SELECT {KS}, cls FROM (
 (SELECT date, code, cls FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY date, code) AS rn FROM c) WHERE rn = 1)
 UNION
 (SELECT date, code, cls FROM c ORDER BY md5('5|' || {day()} || '|' || code), date, code LIMIT 100))""",
    """c AS (SELECT date, code, CASE WHEN gap IS NULL THEN 'first' WHEN gap = 1 THEN 'next' WHEN gap <= 3 THEN 'carry' ELSE 'reset' END AS cls
     FROM (SELECT *, ord - lag(ord) OVER (PARTITION BY code ORDER BY date) AS gap FROM pan))"""))
def _(spark, sf):
    gap = F.col("ord") - ts.shift("ord", keys=("code",))
    cls = F.when(gap.isNull(), "first").when(gap == 1, "next").when(gap <= 3, "carry").otherwise("reset")
    d = panel(spark, sf).withColumn("cls", cls).select("date", "code", "cls")
    return keyed(ct.audit_sample(d, "cls", 100, seed=5), keep=["cls"])
