"""Scans, sources and sinks."""

from pyspark.sql import functions as F

from panelwright.functions.scalar import day_text, rounded
from panelwright.operators import keys, timeseries as ts
from panelwright.plans.registry import query
from panelwright.plans.sql import day, on_panel, r
from panelwright.sources import io
from panelwright.sources.panels import disclosures, panel, table


@query("io_01_load_panel", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS rows
FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    d = io.read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"])
    return keys.duplicate_keys(d, ["l_orderkey", "l_linenumber"]).withColumn(
        "l_linenumber", F.col("l_linenumber").cast("long"))


@query("io_01_load_split", f"""
SELECT o_orderkey, o_custkey, {day('o_orderdate')} AS day FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01'""")
def _(spark, sf):
    d = io.read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    d = io.load_split(d, ["o_orderkey"], "o_orderdate", "1996-01-01", "1998-01-01")
    return d.select("o_orderkey", "o_custkey", day_text("o_orderdate").alias("day"))


@query("io_02_filtered_scan", f"""
SELECT CAST(l_suppkey AS VARCHAR) AS code, count(*) AS rows, {r('sum(l_quantity)', 4)} AS volume
FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1999-01-01' GROUP BY 1""")
def _(spark, sf):
    d = io.read_table(spark, sf, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity"])
    d = d.where((F.col("l_shipdate") >= "1998-01-01") & (F.col("l_shipdate") < "1999-01-01"))
    return d.groupBy(F.col("l_suppkey").cast("string").alias("code")).agg(
        F.count("*").alias("rows"), rounded(F.sum("l_quantity"), 4).alias("volume"))


@query("io_03_history_union", f"""
SELECT code, count(*) AS rows, {day('min(disclosed)')} AS first_day, {day('max(disclosed)')} AS last_day
FROM (SELECT CAST(o_custkey AS VARCHAR) AS code, o_orderdate AS disclosed FROM orders) GROUP BY code""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("number"), F.col("o_custkey").cast("string").alias("code"),
        F.to_date("o_orderdate").alias("disclosed"))
    cut = F.col("disclosed") < F.lit("1999-01-01").cast("date")
    d = io.union_history(o.where(cut), o.where(~cut), ["number"])
    return d.groupBy("code").agg(F.count("*").alias("rows"), day_text(F.min("disclosed")).alias("first_day"),
                                 day_text(F.max("disclosed")).alias("last_day"))


@query("io_04_warm_up_scan", on_panel(f"""
SELECT {day()} AS date, code, {r('s4')} AS sum4 FROM (
  SELECT *, CASE WHEN count(open) OVER f >= 4 THEN sum(open) OVER f END AS s4 FROM qt
  WHERE date >= (SELECT min(date) FROM (SELECT DISTINCT date FROM qt WHERE date < DATE '2000-01-01' ORDER BY date DESC LIMIT 30))
  WINDOW f AS (PARTITION BY code ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
WHERE date >= DATE '2000-01-01'"""))
def _(spark, sf):
    d = io.warm_up(panel(spark, sf).select("date", "code", "open"), "2000-01-01", 30)
    d = d.withColumn("sum4", ts.roll_sum("open", 4, keys=("code",)))
    return d.where("keep").select(day_text().alias("date"), "code", rounded("sum4").alias("sum4"))


@query("io_05_latest_snapshot", on_panel(f"""
SELECT {day()} AS date, code, {r('close')} AS close FROM qt WHERE date = (SELECT max(date) FROM qt)"""))
def _(spark, sf):
    return io.latest_snapshot(panel(spark, sf).select("date", "code", "close")).select(
        day_text().alias("date"), "code", rounded("close").alias("close"))


_ROUND_TRIP = on_panel(f"SELECT {day()} AS date, code, {r('open')} AS open, {r('volume', 4)} AS volume FROM qt")


def _slim(spark, sf):
    return panel(spark, sf).select("date", "code", "open", "volume")


def _show(d):
    return d.select(day_text().alias("date"), "code", rounded("open").alias("open"),
                    rounded("volume", 4).alias("volume"))


@query("io_06_parquet_sink", _ROUND_TRIP)
def _(spark, sf):
    path = io.shared_folder(spark)
    io.write_parquet(_slim(spark, sf), path)
    return _show(spark.read.parquet(path))


@query("io_07_csv_gz_sink", _ROUND_TRIP)
def _(spark, sf):
    path = io.shared_folder(spark)
    io.write_csv(_slim(spark, sf), path, gz=True)
    return _show(io.read_csv(spark, path, "date date, code string, open double, volume double"))


@query("io_08_csv_source", on_panel(f"""
SELECT CAST(year(date) AS BIGINT) AS year, count(*) AS rows, {r('sum(volume)', 2)} AS volume FROM qt GROUP BY 1"""))
def _(spark, sf):
    path = io.shared_folder(spark)
    io.write_csv(_slim(spark, sf), path)
    d = io.read_csv(spark, path, "date date, code string, open double, volume double")
    return d.groupBy(F.year("date").cast("long").alias("year")).agg(
        F.count("*").alias("rows"), rounded(F.sum("volume"), 2).alias("volume"))


@query("io_09_json_models", on_panel(f"""
SELECT CAST(year(date) AS BIGINT) AS year, 'ret' AS feature, {r('avg(ret)')} AS mean, {r('stddev_pop(ret)')} AS scale
FROM pan GROUP BY 1"""))
def _(spark, sf):
    m = panel(spark, sf).groupBy(F.year("date").cast("long").alias("year")).agg(
        F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("scale")).withColumn("feature", F.lit("ret"))
    path = io.shared_folder(spark)
    io.write_json(m, path)
    d = io.read_json(spark, path, "year long, feature string, mean double, scale double")
    return d.select("year", "feature", rounded("mean").alias("mean"), rounded("scale").alias("scale"))


# Key, date and number of columns of every table.
CATALOG = {
    "region": ("r_regionkey", None, 2), "nation": ("n_nationkey", None, 3), "customer": ("c_custkey", None, 5), "supplier": ("s_suppkey", None, 4),
    "part": ("p_partkey", None, 6), "orders": ("o_custkey", "o_orderdate", 6), "lineitem": ("l_suppkey", "l_shipdate", 11), "events": ("user_id", "ts", 6),
    "documents": ("doc_id", None, 5), "embeddings": ("vec_id", None, 3), "pages": ("page_id", None, 3), "benchmark": ("item_id", None, 2),
    "labels": ("doc_id", None, 3), "conversations": ("conv_id", None, 4),
}


@query("io_10_catalog", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST({n} AS BIGINT) AS columns, count(*) AS rows, count(DISTINCT {k}) AS keys, "
    f"{day(f'min({d})') if d else 'CAST(NULL AS VARCHAR)'} AS first_date, {day(f'max({d})') if d else 'CAST(NULL AS VARCHAR)'} AS last_date FROM {t}"
    for t, (k, d, n) in CATALOG.items()))
def _(spark, sf):
    return io.catalog(spark, {t: (f"{sf}/{t}.parquet", k, d) for t, (k, d, _n) in CATALOG.items()}, distinct=True)


@query("io_10_footers", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST({n} AS BIGINT) AS columns, count(*) AS rows, "
    f"{day(f'min({d})') if d else 'CAST(NULL AS VARCHAR)'} AS first_date, {day(f'max({d})') if d else 'CAST(NULL AS VARCHAR)'} AS last_date FROM {t}"
    for t, (k, d, n) in CATALOG.items()))
def _(spark, sf):
    """The catalog without distinct counts: file footers alone."""
    return io.catalog(spark, {t: (f"{sf}/{t}.parquet", k, d) for t, (k, d, _n) in CATALOG.items()})


@query("io_11_content_manifest", """
SELECT o_orderstatus AS part, count(*) AS rows,
  CAST(sum(CAST('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR),
      strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR))), 1, 8) AS BIGINT)) AS BIGINT) AS digest, true AS matches
FROM orders GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("part"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"),
        day_text("o_orderdate").alias("day"), "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("cents"))
    cols = ["o_orderkey", "o_custkey", "day", "o_orderpriority", "cents"]
    # the manifest is stored, and read again when the rows are checked against it
    stored = io.shared_folder(spark)
    io.write_json(io.content_digest(o.repartition(16), cols, ["part"]), stored)
    recorded = io.read_json(spark, stored, "part string, rows long, digest long")
    return io.check_manifest(io.content_digest(o, cols, ["part"]), recorded, "part").select("part", "rows", "digest", "matches")


_ROW = ["o_orderkey", "o_custkey", "day", "o_orderpriority", "cents"]


def _order_rows(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("part"), "o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), day_text("o_orderdate").alias("day"),
        "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("cents"))


def _leaf_sql(source):
    return f"""SELECT path, count(*) AS rows, sum(CAST('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), cust, day, prio, cents)), 1, 8) AS BIGINT)) AS digest FROM (
  SELECT './' || o_orderstatus || '/' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) || '/' || substr(md5(CAST(o_orderkey AS VARCHAR)), 2, 1) AS path, * FROM {source}) GROUP BY path"""


@query("io_11_changed_parts", f"""
WITH v0 AS (SELECT *, CAST(o_custkey AS VARCHAR) AS cust, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS prio, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS cents FROM orders),
v1 AS (SELECT * REPLACE (CASE WHEN o_orderkey % 499 = 7 THEN cents || '1' ELSE cents END AS cents) FROM v0 WHERE o_orderkey % 1009 <> 11),
a AS ({_leaf_sql('v0')}), b AS ({_leaf_sql('v1')})
SELECT 'edited' AS version, coalesce(a.path, b.path) AS path, coalesce(a.rows, 0) AS rows_before, coalesce(b.rows, 0) AS rows_after
FROM a FULL JOIN b ON a.path = b.path WHERE a.digest IS DISTINCT FROM b.digest OR a.rows IS DISTINCT FROM b.rows""")
def _(spark, sf):
    """A stored digest tree against the same table and against a version with edited and deleted rows: the parts that changed, by descending."""
    rows = _order_rows(spark, sf)
    folder = io.shared_folder(spark)
    recorded = spark.read.parquet(io.store_tree(io.digest_tree(rows, _ROW, "o_orderkey", "part"), folder))
    edited = rows.where("o_orderkey % 1009 <> 11").withColumn("cents", F.when(F.col("o_orderkey") % 499 == 7, F.concat("cents", F.lit("1"))).otherwise(F.col("cents")))
    out = None
    for name, version in (("same", rows.repartition(7)), ("edited", edited)):
        one = io.changed_parts(recorded, io.digest_tree(version, _ROW, "o_orderkey", "part")).withColumn("version", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("io_12_guarded_read")
def _(spark, sf):
    """Rows read from every file that a guarded result depends on."""
    d = io.read_table(spark, sf, "lineitem", ["l_suppkey"]).withColumn("file", F.input_file_name())
    s = io.read_table(spark, sf, "supplier", ["s_suppkey"]).withColumn("file", F.input_file_name())
    return d.select("file").unionByName(s.select("file")).groupBy("file").agg(F.count("*").alias("rows"))


@query("io_12_inputs_by_table", "SELECT 'lineitem' AS input, count(*) AS rows FROM lineitem UNION ALL SELECT 'supplier', count(*) FROM supplier")
def _(spark, sf):
    """The same record by table: every row of a guarded result is traced to an allowed input."""
    d = io.read_table(spark, sf, "lineitem", ["l_suppkey"]).withColumn("file", F.input_file_name())
    s = io.read_table(spark, sf, "supplier", ["s_suppkey"]).withColumn("file", F.input_file_name())
    name = F.regexp_extract("file", "([a-z]+)[.]parquet", 1)
    return d.select("file").unionByName(s.select("file")).groupBy(name.alias("input")).agg(F.count("*").alias("rows"))


@query("io_13_inventory", """
SELECT x.concept, x.column_name, x.present, x.rows, round(x.present / x.rows::DOUBLE, 8) + 0.0::DOUBLE AS coverage FROM (
  SELECT unnest([
    {'concept': 'operating cash', 'column_name': 'cfo', 'present': count(*), 'rows': count(*)},
    {'concept': 'assets', 'column_name': 'assets', 'present': count(*) FILTER (WHERE o_orderkey % 11 <> 0), 'rows': count(*)},
    {'concept': 'shares', 'column_name': 'shares', 'present': count(*) FILTER (WHERE o_orderkey % 7 <> 0), 'rows': count(*)},
    {'concept': 'guidance', 'column_name': NULL, 'present': 0, 'rows': count(*)}]) AS x FROM orders)""")
def _(spark, sf):
    d = io.inventory(disclosures(spark, sf), {
        "operating cash": "cfo", "assets": "assets", "shares": "shares", "guidance": None})
    return d.withColumn("coverage", rounded("coverage"))


@query("io_14_shuffle_round_trip", on_panel("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM qt"))
def _(spark, sf):
    """Segments computed from shuffled, re-read rows equal the original ones."""
    base = panel(spark, sf).select("date", "code", "ord", "seg")
    path = io.shared_folder(spark)
    io.write_parquet(base.drop("seg").repartition(13), path)
    again = keys.with_segment(spark.read.parquet(path), 3).withColumnRenamed("seg", "seg2")
    j = base.join(again.drop("ord"), ["date", "code"], "full")
    return j.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.when(
        F.col("seg").eqNullSafe(F.col("seg2")), 0).otherwise(1)), F.lit(0)).cast("long").alias("changed"))
