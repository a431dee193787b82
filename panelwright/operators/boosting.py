"""Boosted shallow trees for all expanding folds at once, from shared histograms.

Features are binned once.  Rows of equal bins and fold are interchangeable for
trees, so they are first added up to cells (count and label sum); a cell table
has at most bins to the power of features rows per fold, however many rows
there are.  One pass over the cells per tree level yields gradient sums and
counts per bin for the open nodes of *every* fold's tree; rows enter all folds
from their own on, so no fold is scanned by itself.

Trees have depth two and four leaves, so a forest is a sum of functions of two
features: it is kept as one table per pair of features and fold, which makes
the price of a prediction independent of the number of trees and lets scoring
stay in array look-ups.  The driver sees histograms (folds x nodes x features x
bins) and grows the trees.

Splits maximise the gain of squared loss with an L2 penalty on leaf values;
missing values take the side that gains more, and may be a side of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.scale import durable

_TREE_DDL = "grp string, tree int, node int, feature string, missing_left boolean, upper double, rows long, gain double, value double"


@dataclass(frozen=True)
class Settings:
    """Shape of the trees; the defaults are the fixed values of the inventory."""

    rounds: int = 60
    rate: float = 0.05
    l2: float = 10.0
    min_leaf: int = 500
    bins: int = 64


@dataclass
class Forest:
    """Trees of one fold: start value, split rows and one table per pair of features."""

    grp: str
    base: float
    tables: np.ndarray
    nodes: list = field(default_factory=list)
    rows: int = 0


def edges(df: DataFrame, features, bins: int) -> list[list[float]]:
    """Distinct inner quantiles of each feature, missing values left out."""
    at = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), at, 10_000).alias(f) for f in features]).first()
    return [sorted(set(row[f] or [])) for f in features]


def binned(df: DataFrame, features, cuts: list[list[float]]) -> DataFrame:
    """Adds ``_b0, _b1, ...``: 0 for missing, else one more than the number of edges not above the value."""
    from pyspark.ml.feature import Bucketizer

    out = df
    for i, (f, own) in enumerate(zip(features, cuts)):
        present = F.col(f).isNotNull()
        if not own:
            out = out.withColumn(f"_b{i}", F.when(present, 1).otherwise(0))
            continue
        b = Bucketizer(splits=[-float("inf"), *own, float("inf")], inputCol="_x", outputCol="_y", handleInvalid="keep")
        out = b.transform(out.withColumn("_x", F.coalesce(F.col(f).cast("double"), F.lit(0.0))))
        out = out.withColumn(f"_b{i}", F.when(present, F.col("_y").cast("int") + 1).otherwise(0)).drop("_x", "_y")
    return out


_BLOCK = pa.schema([("bins", pa.binary()), ("fold", pa.binary()), ("n", pa.binary()), ("total", pa.binary())])


def blocks(df: DataFrame, features, label: str, fold: str, cuts) -> DataFrame:
    """Cells of equal bins and fold, packed as arrays of a batch each."""
    k = len(features)
    names = [f"_b{i}" for i in range(k)]
    cells = binned(df, features, cuts).groupBy(F.col(fold).cast("int").alias("fold"), *names).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("total"))

    def pack(batches):
        for b in batches:
            if b.num_rows:
                own = np.stack([b.column(1 + i).to_numpy().astype(np.uint8) for i in range(k)])
                parts = (own, b.column(0).to_numpy().astype("<i4"), b.column(1 + k).to_numpy().astype("<f8"), b.column(2 + k).to_numpy().astype("<f8"))
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], schema=_BLOCK)

    return durable(cells.mapInArrow(pack, "bins binary, fold binary, n binary, total binary"))


def pair_places(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


_CELL = pa.schema([("at", pa.int32()), ("n", pa.float64()), ("g", pa.float64())])


def histograms(packed: DataFrame, forests: list[Forest], roots: list, k: int, width: int) -> np.ndarray:
    """Counts and residual sums, indexed fold, node, feature, bin; ``roots`` holds each fold's
    bins on the left of its root, or None while the root itself is open."""
    spark, pairs = packed.sparkSession, pair_places(k)
    nodes = 1 if roots is None else 2
    shared = spark.sparkContext.broadcast([(int(f.grp), f.base, f.tables, None if roots is None else roots[i]) for i, f in enumerate(forests)])
    shape = (len(forests), nodes, k, width)

    def run(batches):
        out = np.zeros((2, *shape))
        for b in batches:
            for bins, fold, n, total in zip(*(c.to_pylist() for c in b.columns)):
                bins, fold = np.frombuffer(bins, np.uint8).reshape(k, -1), np.frombuffer(fold, "<i4")
                n, total = np.frombuffer(n, "<f8"), np.frombuffer(total, "<f8")
                for y, (year, base, tables, left) in enumerate(shared.value):
                    own = np.flatnonzero(fold <= year)
                    if not len(own) or nodes == 2 and left is None:
                        continue
                    x, count = bins[:, own].astype(np.int64), n[own]
                    guess = np.full(len(own), base)
                    for p, (i, j) in enumerate(pairs):
                        guess += tables[p].ravel()[x[i] * width + x[j]]
                    rest = total[own] - count * guess
                    side = 0 if nodes == 1 else np.where(left[1][x[left[0]]], 0, width)
                    for f in range(k):
                        out[0, y, :, f] += np.bincount(side + x[f], count, nodes * width).reshape(nodes, width)
                        out[1, y, :, f] += np.bincount(side + x[f], rest, nodes * width).reshape(nodes, width)
        n, g = out[0].ravel(), out[1].ravel()
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(g[at])], schema=_CELL)

    rows = packed.mapInArrow(run, "at int, n double, g double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).collect()
    out = np.zeros((2, int(np.prod(shape))))
    for r in rows:
        out[:, r.at] = r.n, r.g
    shared.unpersist()
    return out.reshape(2, *shape)


def best_split(n: np.ndarray, g: np.ndarray, s: Settings):
    """``gain, feature, left bins`` of the best split of a node, or None; n and g are by feature and bin."""
    whole_n, whole_g = n[0].sum(), g[0].sum()
    best = None
    for f in range(len(n)):
        right_n, right_g = np.cumsum(n[f, 1:]), np.cumsum(g[f, 1:])
        for missing_left in (False, True):
            if missing_left and not n[f, 0]:
                continue
            left_n, left_g = right_n + missing_left * n[f, 0], right_g + missing_left * g[f, 0]
            ok = (left_n >= s.min_leaf) & (whole_n - left_n >= s.min_leaf)
            gain = np.where(ok, left_g ** 2 / (left_n + s.l2) + (whole_g - left_g) ** 2 / (whole_n - left_n + s.l2) - whole_g ** 2 / (whole_n + s.l2), 0.0)
            at = int(np.argmax(gain))
            # sums differ in their last digits with the order of tasks, so nearly equal gains keep the first
            if gain[at] > 1e-12 and (best is None or gain[at] > best[0] * (1 + 1e-9)):
                left = np.zeros(n.shape[1], bool)
                left[1:at + 2], left[0] = True, missing_left
                best = float(gain[at]), f, left, at
    return best


def _grow(forest: Forest, tree: int, root, n: np.ndarray, g: np.ndarray, s: Settings, cuts, pairs) -> None:
    """Add the tree below a root: both children split once more where that gains."""
    def note(node, split, rows, value):
        upper = None
        if split is not None:
            own = cuts[split[1]]
            upper = float(own[split[3]]) if split[3] < len(own) else float("inf")
        forest.nodes.append((forest.grp, tree, node, None if split is None else split[1], None if split is None else bool(split[2][0]), upper,
                             int(rows), 0.0 if split is None else split[0], None if value is None else float(value)))

    note(0, root, n[0, 0].sum() + n[1, 0].sum(), None)
    for side in (0, 1):
        own = root[2] if side == 0 else ~root[2]
        child = best_split(n[side], g[side], s)
        count, total = n[side, 0].sum(), g[side, 0].sum()
        if child is None:
            value = s.rate * total / (count + s.l2)
            note(1 + side, None, count, value)
            forest.tables[pairs.index((root[1], root[1]))][np.diag_indices(len(own))] += np.where(own, value, 0.0)
            continue
        _gain, f, left, _at = child
        note(1 + side, child, count, None)
        left_n, left_g = n[side, f][left].sum(), g[side, f][left].sum()
        values = s.rate * left_g / (left_n + s.l2), s.rate * (total - left_g) / (count - left_n + s.l2)
        note(3 + 2 * side, None, left_n, values[0])
        note(4 + 2 * side, None, count - left_n, values[1])
        part = np.where(left, *values)
        i, j = sorted((root[1], f))
        if i == j:
            forest.tables[pairs.index((i, i))][np.diag_indices(len(own))] += np.where(own, part, 0.0)
        else:
            block = np.outer(own, part) if root[1] == i else np.outer(part, own)
            forest.tables[pairs.index((i, j))] += block


def fit(df: DataFrame, features, label: str, fold: str = "fold", year: str = "year", min_rows: int = 2_000, settings: Settings = Settings()) -> tuple[list[Forest], list[list[float]]]:
    """One forest per ``year`` of ``df`` whose mature rows (``fold`` up to that year) are enough, and the bin edges.

    Edges are the quantiles of the first forest's training rows, which every
    later one has too, so no forest sees a value of its future.
    """
    train = df.where(F.col(label).isNotNull() & F.col(fold).isNotNull())
    years = sorted(r[0] for r in df.select(F.col(year).cast("int")).distinct().collect() if r[0] is not None)
    known = {r.fold: (r.n, r.total) for r in train.groupBy(F.col(fold).cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("total")).collect()}
    forests, k = [], len(features)
    for y in years:
        n, total = (sum(v[i] for f, v in known.items() if f <= y) for i in (0, 1))
        if n >= max(1, min_rows):
            forests.append(Forest(str(y), total / n, np.zeros(0), rows=n))
    if not forests:
        return [], []
    cuts = edges(train.where(F.col(fold) <= int(forests[0].grp)), features, settings.bins)
    width, pairs = max(map(len, cuts)) + 2, pair_places(k)
    for f in forests:
        f.tables = np.zeros((len(pairs), width, width))
    packed = blocks(train, features, label, fold, cuts)
    open_ = list(forests)
    for tree in range(settings.rounds):
        n, g = histograms(packed, open_, None, k, width)
        roots = [best_split(n[i, 0], g[i, 0], settings) for i in range(len(open_))]
        # a fold without a gain stops, as every later tree would find the same
        open_, roots = [f for f, r in zip(open_, roots) if r is not None], [r for r in roots if r is not None]
        if not open_:
            break
        n, g = histograms(packed, open_, [(r[1], r[2]) for r in roots], k, width)
        for i, (forest, root) in enumerate(zip(open_, roots)):
            _grow(forest, tree, root, n[i], g[i], settings, cuts, pairs)
    return forests, cuts


def tree_table(spark: SparkSession, forests: list[Forest], features) -> DataFrame:
    """Every node of every tree: split feature, upper edge of the left side (exclusive), gain, rows, leaf value."""
    rows = [(g, t, node, None if f is None else features[f], m, u, n, gain, v) for forest in forests for g, t, node, f, m, u, n, gain, v in forest.nodes]
    return spark.createDataFrame(rows, _TREE_DDL)


def score(df: DataFrame, forests: list[Forest], cuts, features, key, out: str = "prediction") -> DataFrame:
    """Adds the prediction of each row's fold; NULL where there is no forest.

    A table of one row per fold stands beside the rows (folds x pairs of
    features x bins squared numbers), so a prediction is a few array look-ups.
    """
    if not forests:
        return df.withColumn(out, F.lit(None).cast("double"))
    width, pairs = forests[0].tables.shape[1], pair_places(len(features))
    tables = df.sparkSession.createDataFrame([(f.grp, f.base, f.tables.reshape(len(pairs), -1).tolist()) for f in forests], "_grp string, _base double, _tables array<array<double>>")
    d = binned(df, features, cuts).withColumn("_grp", key.cast("string")).join(F.broadcast(tables), "_grp", "left")
    y = F.col("_base")
    for p, (i, j) in enumerate(pairs):
        y = y + F.get(F.get("_tables", F.lit(p)), F.col(f"_b{i}") * width + F.col(f"_b{j}"))
    return d.withColumn(out, y).drop("_grp", "_base", "_tables", *[f"_b{i}" for i in range(len(features))])


def gain_importance(trees: DataFrame) -> DataFrame:
    """Per fold and feature the gain, the splits and the share of the fold's gain."""
    from pyspark.sql import Window

    by = trees.where("feature is not null").groupBy("grp", "feature").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("splits"))
    return by.withColumn("share", F.col("gain") / F.sum("gain").over(Window.partitionBy("grp")))
