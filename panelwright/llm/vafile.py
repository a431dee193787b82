"""Exact centroid clustering over a vector-approximation file.

Every vector is compressed once to one cell of a few bits per dimension.  A
round turns the centroids into tables of the least and the greatest distance
from a cell to each centroid; summed over the dimensions they bound a vector's
distance to every centroid.  Only where the intervals of several centroids
overlap, or where a vector changes its cluster, the full vector is fetched.
Cluster sums are kept exactly and moved by the vectors that change, so a round
reads cells, not vectors.

Distances are taken less the vector's own distance to the mean of all vectors,
which is the same for all centroids: the intervals then are as wide as a cell
times the centroid's distance from the mean.

The file is one Parquet table bucketed by row number: cells and full vectors
are columns of their own, and fetching shuffles the numbers of the rows that
are wanted, not the vectors.  The driver holds the centroids, their sums and
per-dimension cell bounds.

Defined results: a vector that is null, has another number of components or
a null or non-finite one is left out; repeated vectors are all kept; equal
distances go to the smaller number; with fewer vectors than centroids each
vector is one; rows without an id take part, their id read as empty in the
choice of the first centroids; an empty table gives an empty result; other
columns are not looked at; a component beyond ``LARGEST`` is an error, as
squared distances would leave a long.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import partitions, record, settle
from panelwright.sources.io import shared_folder

#: Bits of a cell, inner cells' reach in standard deviations, largest component after scaling.
BITS, REACH, LARGEST = 8, 3.5, 1 << 26


def scaled(vectors: DataFrame, factor: int, dims: int) -> DataFrame:
    """``vec_id, x`` of the vectors that are kept, with whole components."""
    e = F.col("embedding").cast("array<double>")
    good = (F.size(e) == dims) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(e, lambda c: F.when(F.abs(c * factor) < LARGEST, F.floor(c * factor)).otherwise(
        F.raise_error(F.lit("a component is too large for exact distances"))).cast("int"))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


# ---------------------------------------------------------------- cells

_SPREAD = pa.schema([("at", pa.int32()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("total", pa.int64()), ("squares", pa.float64())])


def spread(kept: DataFrame, dims: int) -> list:
    """Per dimension the count, bounds, sum and sum of squares, combined from one row per task."""

    def run(batches):
        n, total, squares, low, high = 0, np.zeros(dims, np.int64), np.zeros(dims), None, None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dims)
                n, total, squares = n + len(x), total + x.sum(0), squares + (x.astype(float) ** 2).sum(0)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            yield record(_SPREAD, [np.arange(dims), np.full(dims, n), low, high, total, squares])

    parts = kept.select("x").mapInArrow(run, "at int, n long, low long, high long, total long, squares double")
    return parts.groupBy("at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
                                   F.sum("total").alias("total"), F.sum("squares").alias("squares")).orderBy("at").collect()


class Cells:
    """Whole-numbered cell bounds of every dimension."""

    def __init__(self, stats: list, bits: int = BITS, reach: float = REACH):
        if not 1 <= bits <= 8:
            raise ValueError("a cell has one to eight bits")
        self.bits, self.dims, count = bits, len(stats), 1 << bits
        self.edges = np.empty((self.dims, count - 1), np.int64)
        for i, r in enumerate(stats):
            mean = r.total / r.n
            deviation = max(r.squares / r.n - mean * mean, 0.0) ** 0.5
            self.edges[i] = np.clip(np.ceil(mean + deviation * np.linspace(-reach, reach, count - 1)), r.low, r.high + 1)
        low, high = (np.array([getattr(r, c) for r in stats], np.int64)[:, None] for c in ("low", "high"))
        self.low, self.high = np.hstack([low, self.edges]), np.hstack([self.edges - 1, high])
        self.mean = np.array([r.total // r.n for r in stats], np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The vectors' cells, one byte each."""
        return np.stack([np.searchsorted(self.edges[i], x[:, i], side="right") for i in range(self.dims)], axis=1).astype(np.uint8)

    def pack(self, cells: np.ndarray) -> list[bytes]:
        bits = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits:]
        return [r.tobytes() for r in np.packbits(bits.reshape(len(cells), -1), axis=1)]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        rows = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        if self.bits == 8:
            return rows
        bits = np.unpackbits(rows, axis=1)[:, :self.dims * self.bits].reshape(len(packed), self.dims, self.bits)
        return (bits << np.arange(self.bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest share of every dimension's cells in the distance to each centroid."""
        c = centroids - self.mean
        a, b = (c[:, :, None] ** 2 - 2 * c[:, :, None] * (end - self.mean[:, None])[None] for end in (self.low, self.high))
        return np.minimum(a, b), np.maximum(a, b)

    def candidates(self, cells: np.ndarray, tables) -> np.ndarray:
        """Bit mask of the centroids whose interval begins before the earliest end of an interval."""
        least = np.zeros((tables[0].shape[0], len(cells)), np.int64)
        most = np.zeros_like(least)
        for i in range(self.dims):
            at = cells[:, i]
            least += tables[0][:, i, at]
            most += tables[1][:, i, at]
        open_ = least <= most.min(axis=0)
        return (open_ * (np.int64(1) << np.arange(len(least)))[:, None]).sum(axis=0)


def decided(mask: np.ndarray) -> np.ndarray:
    """The only candidate's number, -1 where several are left."""
    only = (mask & (mask - 1)) == 0
    return np.where(only, np.round(np.log2(np.maximum(mask, 1))).astype(np.int64), -1)


def nearest(x: np.ndarray, centroids: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest candidate, ties to the smaller number."""
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), -1, np.int64)
    for k, c in enumerate(centroids):
        rows = np.flatnonzero((mask >> k) & 1)
        d = ((x[rows] - c) ** 2).sum(axis=1)
        closer = d < best[rows]
        best[rows[closer]], at[rows[closer]] = d[closer], k
    return at, best


# ---------------------------------------------------------------- file and rounds

class File:
    """The bucketed table ``key, vec_id, x, cells`` and what is known of its cells."""

    def __init__(self, kept: DataFrame, stats: list, bits: int = BITS):
        self.spark = kept.sparkSession
        self.cells = self.spark.sparkContext.broadcast(Cells(stats, bits))  # dims x cells numbers
        cells, dims, n = self.cells, len(stats), partitions(self.spark)
        self.dims, self.buckets = dims, n

        def run(batches):
            for b in batches:
                packed = cells.value.pack(cells.value.of(_matrix(b.column(2), dims))) if b.num_rows else []
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(packed, pa.binary())], names=["key", "vec_id", "x", "cells"])

        numbered = kept.select(F.monotonically_increasing_id().alias("key"), "vec_id", "x").repartition(n, "key")
        self.name = f"va_{uuid.uuid4().hex}"
        rows = numbered.mapInArrow(run, "key long, vec_id long, x array<int>, cells binary")
        rows.write.bucketBy(n, "key").sortBy("key").option("path", f"{shared_folder(self.spark)}-{self.name}").option("compression", "zstd").saveAsTable(self.name)

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Forget the table's name; its files stay with the other stage files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


_MOVED = pa.schema([("key", pa.int64()), ("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
_WANTED = pa.schema([("key", pa.int64()), ("before", pa.int32()), ("mask", pa.int64())])


def _moves(rows: DataFrame, file: File, centroids: np.ndarray, first: bool) -> DataFrame:
    """Of fetched vectors: the cluster of those with several candidates (``key`` set), and per
    task and cluster the sum and number of the vectors that came less those that left."""
    cells, dims = file.cells, file.dims

    def run(batches):
        tables = cells.value.tables(centroids) if first else None
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), dims)
            if first:
                mask, before = cells.value.candidates(cells.value.unpack(b.column(2).to_pylist()), tables), np.full(len(x), -1)
            else:
                mask, before = b.column(2).to_numpy(), b.column(3).to_numpy()
            at = decided(mask)
            several = at < 0
            at[several] = nearest(x[several], centroids, mask[several])[0]
            for k in range(len(centroids)):
                came, left = (at == k) & (before != k), (before == k) & (at != k)
                n[k] += came.sum() - left.sum()
                sums[k] += x[came].sum(axis=0) - x[left].sum(axis=0)
            keys = b.column(0).to_numpy()[several]
            yield record(_MOVED, [keys, at[several], [None] * len(keys), [None] * len(keys)])
        touched = np.flatnonzero(n.astype(bool) | sums.any(axis=1))
        yield record(_MOVED, [[None] * len(touched), touched, n[touched], sums[touched].tolist()])

    columns = ["key", "x", "cells"] if first else ["key", "x", "mask", "before"]
    return settle(rows.select(*columns).mapInArrow(run, "key long, cluster int, n long, sums array<long>"), "moves")


def _wanted(file: File, older: np.ndarray, newer: np.ndarray) -> DataFrame:
    """Rows whose cluster the cells leave open, now or a round ago, or show to have changed."""
    cells = file.cells

    def run(batches):
        c = cells.value
        then, now = c.tables(older), c.tables(newer)
        for b in batches:
            if b.num_rows:
                own = c.unpack(b.column(1).to_pylist())
                before, mask = decided(c.candidates(own, then)), c.candidates(own, now)
                rows = np.flatnonzero((before < 0) | (before != decided(mask)))
                yield record(_WANTED, [b.column(0).to_numpy()[rows], before[rows], mask[rows]])

    return file.rows.select("key", "cells").mapInArrow(run, "key long, before int, mask long")


def _apply(moves: DataFrame, n: list[int], sums: list[list[int]]) -> None:
    """Add the moves to the clusters' sums; one row per cluster and dimension reaches the driver."""
    parts = moves.where("key is null").select("cluster", "n", F.posexplode("sums").alias("at", "value"))
    for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect():
        sums[r.cluster][r.at] += r.value
        if r.at == 0:
            n[r.cluster] += r.n


def first_centroids(kept: DataFrame, count: int, seed: int = 3) -> np.ndarray:
    """The vectors whose ids come first by a keyed digest; of repeated ids the smaller vector first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in kept.select("x", digest.alias("digest")).orderBy("digest", "x").limit(count).collect()], np.int64)


_FOUND = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def cluster(vectors: DataFrame, count: int = 8, rounds: int = 10, factor: int = 1024, dims: int = 64, bits: int = BITS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector."""
    if not 1 <= count <= 62:
        raise ValueError("candidates are the bits of a long")
    kept = scaled(vectors, factor, dims)
    stats, spark = spread(kept, dims), vectors.sparkSession
    if not stats:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = first_centroids(kept, count)
    file = File(kept, stats, bits)
    n, sums, older, open_ = [0] * len(centroids), [[0] * dims for _ in centroids], None, None
    for turn in range(rounds):
        if turn == 0:
            moves = _moves(file.rows, file, centroids, True)
        else:
            wanted = _wanted(file, older, centroids).join(open_.withColumnRenamed("cluster", "was"), "key", "left")
            before = F.when(F.col("before") < 0, F.col("was")).otherwise(F.col("before")).cast("int")
            wanted = wanted.select("key", "mask", before.alias("before"))
            stays = (F.bit_count("mask") == 1) & (F.col("mask") == F.expr("shiftleft(1L, before)"))
            moves = _moves(wanted.where(~stays).join(file.rows.select("key", "x"), "key"), file, centroids, False)
        _apply(moves, n, sums)
        open_ = moves.where("key is not null").select("key", "cluster")
        older = centroids
        centroids = np.array([[s // n[k] for s in sums[k]] if n[k] else centroids[k].tolist() for k in range(len(centroids))], np.int64)

    cells = file.cells

    def last(batches):
        tables = cells.value.tables(centroids)
        for b in batches:
            if b.num_rows:
                mask = cells.value.candidates(cells.value.unpack(b.column(2).to_pylist()), tables)
                yield record(_FOUND, [b.column(0), *nearest(_matrix(b.column(1), dims), centroids, mask)])

    found = settle(file.rows.select("vec_id", "x", "cells").mapInArrow(last, "vec_id long, cluster int, distance long"), "found")
    file.close()
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    text = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(k, inertia.get(k, 0), sum(inertia.values()), text(c)) for k, c in enumerate(centroids)]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
