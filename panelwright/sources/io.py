"""Guarded reads, catalogs, manifests and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, folder: str, name: str, columns=None, allow=TABLES) -> DataFrame:
    """Projected scan of a table on the allow-list."""
    if name not in allow:
        raise PermissionError(f"{name} is not an allowed input")
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df



def shared_folder(spark: SparkSession) -> str:
    """New folder under the cluster's checkpoint folder, for stage files."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root}/stage-{uuid.uuid4().hex}"


def load_split(df: DataFrame, keys, date: str, since: str | None = None, before: str | None = None) -> DataFrame:
    """Rows of a split in key order; reading a repeated key is an error.

    Dates are pruned in the scan.  The check is part of the plan: it fails the
    job that meets the second row of a key and runs nothing on its own.
    """
    keys = list(keys)
    if since is not None:
        df = df.where(F.col(date) >= F.lit(since).cast("timestamp"))
    if before is not None:
        df = df.where(F.col(date) < F.lit(before).cast("timestamp"))
    again = F.row_number().over(Window.partitionBy(*keys).orderBy(date)) > 1
    d = df.withColumn("_again", again)
    d = d.where(~F.col("_again") | F.raise_error(F.lit(f"repeated key in {', '.join(keys)}")).cast("boolean"))
    return d.drop("_again").sort(*keys)


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", partition_by=()) -> None:
    w = df.write.option("compression", codec)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, gz: bool = False) -> None:
    w = df.write.option("header", True)
    (w.option("compression", "gzip") if gz else w).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def union_history(earlier: DataFrame, later: DataFrame, keys) -> DataFrame:
    """Both splits in one frame; rows whose key is in both splits are rejected."""
    clash = later.join(earlier.select(*keys), list(keys), "left_semi").limit(1)
    if clash.count():
        raise ValueError("the two splits overlap")
    return earlier.unionByName(later)


def warm_up(df: DataFrame, cutoff: str, sessions: int = 300) -> DataFrame:
    """The later split and the last ``sessions`` dates before it, flagged ``keep``."""
    cut = F.lit(cutoff).cast("date")
    recent = (
        df.where(F.col("date") < cut).select("date").distinct()
        .withColumn("_n", F.row_number().over(Window.orderBy(F.col("date").desc())))
        .where(F.col("_n") <= sessions).select("date")
    )
    early = df.where(F.col("date") < cut).join(recent, "date", "left_semi").withColumn("keep", F.lit(False))
    late = df.where(F.col("date") >= cut).withColumn("keep", F.lit(True))
    return early.unionByName(late)


def latest_snapshot(df: DataFrame) -> DataFrame:
    last = df.agg(F.max("date").alias("date"))
    return df.join(F.broadcast(last), "date", "left_semi")


def footer_facts(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    """``rows, first_date, last_date`` of a Parquet table from its file footers.

    Counts and bounds are pushed into the scan, which then reads no column.
    Bounds of time stamps are asked for as the whole numbers they are stored
    as.  The pushing is an option of a session of its own; the caller's stays
    as it is.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    if date is None:
        df = own.read.parquet(path)
        return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(None).cast("string").alias("first_date"), F.lit(None).cast("string").alias("last_date"))
    schema = own.read.parquet(path).schema
    stamps = schema[date].dataType.typeName().startswith("timestamp")
    # footers are read by the place of a column, so all columns are named
    fields = [T.StructField(f.name, T.LongType() if stamps and f.name == date else f.dataType) for f in schema.fields]
    df = own.read.schema(T.StructType(fields)).parquet(path)
    d = df.agg(F.count(F.lit(1)).alias("rows"), F.min(date).alias("first"), F.max(date).alias("last"))
    day = lambda c: F.date_format(F.timestamp_micros(c) if stamps else F.col(c), "yyyy-MM-dd")
    return d.select("rows", day("first").alias("first_date"), day("last").alias("last_date"))


def catalog(spark: SparkSession, tables: dict[str, tuple[str, str, str | None]], distinct: bool = False) -> DataFrame:
    """One row per table (path, key, date): columns, rows, first and last date from footers; distinct keys only on request."""
    out = None
    for name, (path, key, date) in tables.items():
        one = footer_facts(spark, path, date).withColumns({"table_name": F.lit(name), "columns": F.lit(len(spark.read.parquet(path).columns)).cast("long")})
        if distinct:  # the only part that reads a column
            one = one.join(spark.read.parquet(path).agg(F.countDistinct(key).alias("keys")))
        out = one if out is None else out.unionByName(one)
    return out


def content_digest(df: DataFrame, columns, by=None):
    """Order-free content digest, map-side combined: row count and sum of row hashes."""
    word = F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("long")
    aggs = [F.count("*").alias("rows"), F.sum(word).alias("digest")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def check_manifest(actual: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Recorded against actual digests, with a match flag."""
    m = manifest.select(key, F.col("digest").alias("recorded"))
    return actual.join(m, key, "full").withColumn(
        "matches", F.col("digest").eqNullSafe(F.col("recorded")))


def digest_tree(df: DataFrame, columns, key: str, part: str, depth: int = 2) -> DataFrame:
    """``level, path, parent, rows, digest`` of a table's digest tree.

    Level 0 is the whole table, level 1 its parts; below, a part's rows are
    dealt by the hex digits of their key's hash, sixteen children to a node.
    A leaf's digest does not depend on the order of rows; an inner node's is
    that of its children, so equal nodes have equal rows below them.
    """
    digits = F.substring(F.md5(F.col(key).cast("string")), 1, depth)
    leaf = F.concat_ws("/", F.lit("."), F.col(part), *[F.substring(digits, i + 1, 1) for i in range(depth)])
    level = content_digest(df.withColumn("path", leaf), columns, ["path"]).withColumn("digest", F.md5(F.concat_ws(":", "rows", "digest")))
    parent = F.regexp_replace("path", "/[^/]*$", "")
    out = level.select(F.lit(depth + 1).alias("level"), "path", parent.alias("parent"), "rows", "digest")
    for n in range(depth, -1, -1):
        child = F.struct("path", "digest")
        level = level.groupBy(parent.alias("path")).agg(F.sum("rows").alias("rows"), F.array_sort(F.collect_list(child)).alias("c"))
        level = level.select("path", "rows", F.md5(F.concat_ws(",", F.transform("c", lambda x: F.concat_ws(":", x["path"], x["digest"])))).alias("digest"))
        out = out.unionByName(level.select(F.lit(n).alias("level"), "path", F.when(F.lit(n) > 0, parent).alias("parent"), "rows", "digest"))
    return out


def store_tree(tree: DataFrame, folder: str) -> str:
    """Write a digest tree beside its table, under the name of its root digest; returns the place.

    A table that has not changed has the same root, so its tree is found by content."""
    tree = tree.persist()
    place = f"{folder}/{tree.where('level = 0').first().digest}"
    tree.write.mode("overwrite").parquet(place)
    tree.unpersist()
    return place


def changed_parts(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Leaves that differ between two digest trees, found from the root down: only children of differing nodes are compared."""
    depth = actual.agg(F.max("level")).first()[0]
    if depth is None:
        raise ValueError("a digest tree has a root at least")
    side = lambda t, n, s: t.where(F.col("level") == n).select("path", F.col("parent").alias(f"parent_{s}"), F.col("rows").alias(f"rows_{s}"), F.col("digest").alias(f"digest_{s}"))
    open_ = None
    for n in range(depth + 1):
        a, b = side(recorded, n, "before"), side(actual, n, "after")
        if open_ is not None:
            a, b = (t.join(open_, F.col(f"parent_{s}") == F.col("_open"), "left_semi") for t, s in ((a, "before"), (b, "after")))
        both = a.join(b, "path", "full").where(~F.col("digest_before").eqNullSafe(F.col("digest_after")))
        open_ = both.select(F.col("path").alias("_open"))
    return both.select("path", F.coalesce("rows_before", F.lit(0)).alias("rows_before"), F.coalesce("rows_after", F.lit(0)).alias("rows_after"))


def inventory(df: DataFrame, concepts: dict[str, str | None]) -> DataFrame:
    """Coverage of named concepts: the backing column and its share of present values."""
    total = F.count(F.lit(1))
    structs = [
        F.struct(F.lit(c).alias("concept"), F.lit(column).cast("string").alias("column_name"),
                 (F.count(F.col(column)) if column else F.lit(0)).cast("long").alias("present"),
                 total.cast("long").alias("rows"))
        for c, column in concepts.items()
    ]
    return df.agg(F.array(*structs).alias("a")).select(F.inline("a")).withColumn(
        "coverage", F.col("present") / F.col("rows"))
