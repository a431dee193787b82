"""Shared pieces of the text operators: scans, stage tables in the shared folder, Arrow batch helpers."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.sources.io import shared_folder

#: Output rows and text bytes a task keeps in one Arrow batch.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a stage table to the shared folder and read it back.

    The rows then survive the loss of any executor, and later passes read the
    columns they need instead of running the lineage again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}-{name}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_column(name: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches, column: str = "text", most: int = BATCH_ROWS):
    """Cut incoming record batches so that one slice holds a bounded number of rows and bytes."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        n, start = batch.num_rows, 0
        step = max(1, min(most, n if not n else int(BATCH_BYTES * n / max(1, batch.column(i).nbytes))))
        while start < n:
            yield batch.slice(start, step)
            start += step


def apart(df: DataFrame) -> DataFrame:
    """A side of a join that both sides reach by a shuffle, never sent whole to the driver and every executor.

    For tables that grow with the corpus where the planner takes them for small: it
    knows files by their compressed size, and rows that an explode makes of them not at all.
    """
    return df.hint("merge")


def record(schema: pa.Schema, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
