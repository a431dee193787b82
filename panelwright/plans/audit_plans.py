"""Audits of contracts, causality, determinism and accounting."""

from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from panelwright.functions.scalar import day_text, rounded
from panelwright.operators import account as P
from panelwright.operators import audit as Q
from panelwright.operators import models as M
from panelwright.operators import signals as G
from panelwright.operators import timeseries as ts
from panelwright.plans import feature_plans as FP
from panelwright.plans import model_plans as MP
from panelwright.plans.registry import ORACLE, QUERIES, query
from panelwright.plans.sql import on_events, on_panel, on_scored, r
from panelwright.sources import io
from panelwright.sources.panels import cross_section, events, listed_quotes, panel, release, scale_of, score_quotes, scored, stage, table

CUT = "1999-06-28"
COLS = ["resid", "mom", "score"]


def _quotes(spark, sf):
    return stage(spark, sf, "quotes", lambda: listed_quotes(spark, sf))


def _build(spark, sf):
    xs = cross_section(spark, sf)
    return lambda q: score_quotes(q, xs)


@query("q_01_contract", on_scored("""
SELECT CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS non_finite, count(*) FILTER (WHERE target IS NOT NULL AND beta IS NULL) AS uncovered,
       count(*) FILTER (WHERE target IS NULL AND beta IS NOT NULL) AS surplus FROM sc"""))
def _(spark, sf):
    d = scored(spark, sf)
    return Q.contract(d.where("target is not null"), d.where("beta is not null").select("date", "code", "score"))


@query("q_02_future_mutation", on_panel(f"""
SELECT m AS mutation, count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM qt CROSS JOIN (SELECT unnest(['affine', 'constant']) AS m) WHERE date <= DATE '{CUT}' GROUP BY m"""))
def _(spark, sf):
    return Q.future_mutation(_quotes(spark, sf), _build(spark, sf), CUT, COLS)


#: Outputs that are rebuilt from altered inputs, with their keys.
REBUILT = {"f_06_price_impact": ("date", "code"), "f_30_cfo_state": ("date", "code"), "m_09_walk_forward": ("date", "code"),
           "g_10_score_stitching": ("date", "code"), "d_29_event_trace": ("date", "code", "side")}
#: First altered day: the quotes of the week of the cut are whole before it.
ALTERED = "1999-07-05"


def _altered(spark, sf):
    """A copy of all inputs of the panel with every value from ``ALTERED`` on changed."""
    cut = F.lit(ALTERED).cast("timestamp")
    t = lambda n: table(spark, sf, n)
    tables = {
        "lineitem": (t("lineitem"), "l_shipdate", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")),
        "orders": (t("orders"), "o_orderdate", ("o_orderkey", "o_custkey")),
        **{n: (t(n), None, ()) for n in ("supplier", "nation", "region", "customer", "part")}}
    return Q.mutated_copy(spark, tables, cut, io.shared_folder(spark))


def _outputs(spark, sf):
    """Rows up to the cut of every rebuilt output and of the planted look ahead, each written by a job of its own.

    Planned as one query, the outputs would be planned anew whenever a shuffle of
    any of them ends.  The stages that they share come first, one by one, as these
    set the session's layouts; then the driver plans one output while others run.
    """
    FP._metric_days(spark, sf, FP._CASH)
    MP._state_panel(spark, sf)
    root = io.shared_folder(spark)
    builds = {"ahead": lambda: panel(spark, sf).select(day_text().alias("date"), "code", F.lead("close", 2).over(ts.history(("code",))).alias("ahead")),
              **{n: partial(QUERIES[n], spark, sf) for n in REBUILT}}

    def made(name):
        d = Q.early(builds[name](), CUT)
        io.write_parquet(d, f"{root}-{name}")
        return name, spark.read.schema(d.schema).parquet(f"{root}-{name}")

    with ThreadPoolExecutor(len(builds)) as pool:
        return dict(pool.map(inheritable_thread_target(spark)(made), builds))


@query("q_02_all_inputs", " UNION ALL ".join(
    f"SELECT '{n}' AS output, count(*) AS rows, CAST(0 AS BIGINT) AS changed, count(*) > 0 AS leak_caught FROM ({ORACLE[n]}) WHERE date <= '{CUT}'" for n in REBUILT))
def _(spark, sf):
    """Features, models, signals and traces rebuilt from copies of quotes and disclosures altered after the cut.

    No earlier row changes, while a look two dates ahead that is planted in each output is caught.
    """
    other, out = _altered(spark, sf), None
    before, after = _outputs(spark, sf), _outputs(spark, other)
    release(spark, other)
    for name, by in REBUILT.items():
        a, b = (made[name].join(made["ahead"], ["date", "code"]) for made in (before, after))
        one = Q.rebuilt_difference(a, b, CUT, by, "ahead").withColumn("output", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("output", "rows", "changed", (F.col("caught") > 0).alias("leak_caught"))


@query("q_03_truncation", on_panel(f"SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM qt WHERE date <= DATE '{CUT}'"))
def _(spark, sf):
    return Q.truncation(_quotes(spark, sf), _build(spark, sf), CUT, COLS)


@query("q_04_label_mutation", on_scored("""
SELECT count(*) AS folds, CAST(0 AS BIGINT) AS changed FROM (SELECT y FROM (SELECT year(date) AS y, min(ord) AS k FROM cal GROUP BY 1) f
 WHERE y <= 1999 AND (SELECT count(DISTINCT date) FROM sc WHERE target IS NOT NULL AND ord < f.k - 2) >= 60)"""))
def _(spark, sf):
    """Corrupt every label unknown at the start of 1999; models of folds up to 1999 keep their coefficients."""
    d = M.with_fold(scored(spark, sf), scale_of(spark, sf))
    known = F.coalesce(F.col("fold") <= 1999, F.lit(False))
    bad = d.withColumn("target", F.when(known, F.col("target")).otherwise(F.lit(123.0)))
    fit = lambda x: M.univariate_fits(x, "mom", "target").where("fold <= 1999")
    return Q.difference(fit(d), fit(bad), ["coef", "intercept", "n"], keys=["fold"]).withColumnRenamed("rows", "folds")


@query("q_05_determinism", on_panel("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM qt"))
def _(spark, sf):
    """Two builds from the files, dealt over different numbers of partitions; the first is written out."""
    build, first = _build(spark, sf), io.shared_folder(spark)
    again = lambda n: build(listed_quotes(spark, sf).repartition(n, "code", "date"))
    io.write_parquet(again(3).select("date", "code", *COLS), first)
    return Q.difference(spark.read.parquet(first), again(17), COLS)


@query("q_06_reconciliation", on_scored("""
SELECT unnest(['legs equal total', 'parts equal gross', 'exposure is neutral']) AS identity, CAST(0 AS BIGINT) AS broken, (SELECT count(DISTINCT date) FROM sc) AS rows"""))
def _(spark, sf):
    # A date too small for weights holds nothing: it stays, with an account of zeros.
    d = P.leg_weights(scored(spark, sf))
    full = P.full_account(d)
    total = d.groupBy("date").agg(P.zero(F.sum(F.col("w") * F.col("target"))).alias("total"), F.count("*").alias("n"),
                                  P.zero(F.sum(F.col("q") - 2)).alias("imbalance"))
    j = full.join(total, "date")
    legs = F.col("long_gross") + F.col("short_gross")
    return Q.reconcile(j, {
        "legs equal total": legs - F.col("total"), "parts equal gross": F.col("common") + F.col("selection") - legs,
        "exposure is neutral": F.col("net_exposure") - F.col("imbalance") / F.col("n") / 1.2})


@query("q_07_replay", on_scored("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM sc"))
def _(spark, sf):
    """Stored scores, quintiles and weights against a rebuild from the event tables."""
    d = scored(spark, sf).select("date", "code", "score", "q", "w")
    path = io.shared_folder(spark)
    io.write_parquet(d, path)
    saved = spark.read.parquet(path)
    again = cross_section(spark, sf).quintile(saved.select("date", "code", "score"), "score")
    return Q.difference(d, again, ["score", "q", "w"])


@query("q_08_label_rebuild", on_scored("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM sc WHERE target IS NOT NULL"))
def _(spark, sf):
    d = scored(spark, sf)
    src = d.select("code", (F.col("ord") - 2).alias("ord"), (F.col("ret") - F.col("beta") * F.col("mkt")).alias("target"))
    rebuilt = d.select("date", "code", "ord").join(src, ["code", "ord"]).where("target is not null")
    return Q.difference(d.where("target is not null"), rebuilt, ["target"])


@query("q_09_row_order", on_panel("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM qt"))
def _(spark, sf):
    return Q.row_order(_quotes(spark, sf), _build(spark, sf), COLS)


@query("q_10_mutation_helpers", on_panel(f"""
SELECT {r("sum(CASE WHEN date > DATE '1999-06-28' THEN open * 1.7 + 3 ELSE open END) / 1e6", 6)} AS affine, {r("sum(CASE WHEN date > DATE '1999-06-28' THEN 5 ELSE open END) / 1e6", 6)} AS constant,
       {r("sum(CASE WHEN date = (SELECT min(date) FROM qt WHERE date > DATE '1999-06-28') THEN 0.25 ELSE factor END)", 4)} AS split FROM qt"""))
def _(spark, sf):
    q = _quotes(spark, sf).select("date", "code", "open", "factor")
    after = F.col("date") > F.lit(CUT).cast("date")
    a = Q.mutate(q, after).agg(rounded(F.sum("open") / 1e6, 6).alias("affine"))
    c = Q.mutate(q, after, "constant").agg(rounded(F.sum("open") / 1e6, 6).alias("constant"))
    s = Q.first_day_split(q, F.lit(CUT).cast("date")).agg(rounded(F.sum("factor"), 4).alias("split"))
    return a.crossJoin(c).crossJoin(s)


@query("q_10_mutated_kinds", on_scored(f"""
SELECT count(*) FILTER (WHERE date > DATE '{CUT}') AS after_cut, count(*) FILTER (WHERE date > DATE '{CUT}') AS changed_text,
 count(*) FILTER (WHERE date > DATE '{CUT}') AS moved_days, count(*) AS rows FROM sc"""))
def _(spark, sf):
    """Text and date columns of every later row change, earlier ones stay."""
    d = scored(spark, sf).select("date", "code", F.concat_ws("/", "sector17", "code").alias("label"), F.col("date").alias("known"))
    later = F.col("date") > F.lit(CUT).cast("date")
    m = Q.mutate(d, later).select("date", "code", F.col("label").alias("label2"), F.col("known").alias("known2"))
    j = d.join(m, ["date", "code"])
    n = lambda c: F.count(F.when(c, 1))
    return j.agg(n(later).alias("after_cut"), n(F.col("label") != F.col("label2")).alias("changed_text"),
                 n(F.col("known2") == F.date_add("known", 7)).alias("moved_days"), F.count(F.lit(1)).alias("rows"))


@query("q_11_reset_audit", on_events(f"""
SELECT gap_class, count(*) AS rows, count(*) FILTER (WHERE abs(hs - hr) <= 1e-12) AS equal_raw FROM (
 SELECT *, CASE WHEN gap IS NULL THEN 'first' WHEN gap = 1 THEN 'next' WHEN gap < 3 THEN 'inside' WHEN gap = 3 THEN 'limit' ELSE 'reset' END AS gap_class
 FROM (SELECT *, ord - lag(ord) OVER (PARTITION BY code ORDER BY date) AS gap FROM en)) GROUP BY gap_class"""))
def _(spark, sf):
    return Q.reset_audit(events(spark, sf), 3, "high_state", "high_raw")


@query("q_12_stage_contract", on_events("""
SELECT unnest(['zero off event', 'sides disjoint', 'leg not reversed']) AS identity, CAST(0 AS BIGINT) AS broken, (SELECT count(*) FROM en) AS rows"""))
def _(spark, sf):
    d = events(spark, sf)
    event = G.is_event("high") | G.is_event("low")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return Q.reconcile(d, {
        "zero off event": flag(~event & (F.col("raw") != 0)),
        "sides disjoint": flag(G.is_event("high") & G.is_event("low")),
        "leg not reversed": flag((F.col("high_state") < 0) | (F.col("low_state") > 0))})
