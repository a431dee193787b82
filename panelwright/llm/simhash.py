"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most four bits have, among three segments, one
that differs in at most one bit.  So every distinct fingerprint is indexed
under its 64 one-wildcard variants (a segment with one bit left out), variants
are joined by equality and the pairs verified inside the join.  A pair is kept
under one of its common variants only.

Equal fingerprints are one point, so copies of a text cost one row, and a
point can have no more than 679,120 neighbours however large the corpus is.
Components come from contracting the links between points, never from pairs
of documents.

Defined results: null text counts as empty; a text of fewer words than a
shingle is one shingle; texts without words have fingerprint zero and are
linked like any other; rows that repeat an id share a component only if their
texts are near; a null id never names a component unless all its members have
none; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import apart, record, settle, slices

#: Bits in which linked fingerprints may differ, and the segments (first bit, length).
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))

def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the shingles of a text, repeats included; 0 without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    n = max(1, len(tokens) - words + 1)
    stops = ends[min(words, len(tokens)) - 1:]
    starts = np.r_[0, ends[:n - 1] + 1]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, n)
    bits = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        bits += np.unpackbits(h[i:i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


_POINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed 64-bit number."""

    def run(batches):
        for b in slices(batches):
            found = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield record(_POINTS, [b.column(0), found.view(np.int64)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _one(bit: int) -> Column:
    """Number with one bit set, as a signed 64-bit literal."""
    n = 1 << bit
    return F.lit(n - (1 << 64) if n >> 63 else n).cast("long")


def _mask(first: int, length: int) -> Column:
    n = ((1 << length) - 1) << first
    return F.lit(n - (1 << 64) if n >> 63 else n).cast("long")


def variants(points: DataFrame) -> DataFrame:
    """``wildcard, rest, fp``: each fingerprint under its one-wildcard segments."""
    all_ = [
        F.struct(F.lit(bit).cast("int").alias("wildcard"),
                 F.col("fp").bitwiseAND(_mask(first, length)).bitwiseAND(F.bitwise_not(_one(bit))).alias("rest"))
        for first, length in SEGMENTS for bit in range(first, first + length)
    ]
    return points.select("fp", F.inline(F.array(*all_)))


def links(points: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``a < b`` of fingerprints that differ in at most ``max_bits`` (at most four) bits."""
    if not 0 < max_bits <= 4:
        raise ValueError("three segments with one wildcard find one to four differing bits")
    v = variants(points)
    x = v.select("wildcard", "rest", F.col("fp").alias("a"))
    y = v.select("wildcard", "rest", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # of a pair's common variants the first counts: of the first segment with at most one
    # differing bit, the variant without that bit, or without the segment's first bit
    home = F.lit(None).cast("int")
    for first, length in reversed(SEGMENTS):
        own = differ.bitwiseAND(_mask(first, length))
        bit = F.when(own == 0, F.lit(first)).otherwise(F.bit_count(F.shiftrightunsigned(own, first) - 1) + first).cast("int")
        home = F.when(F.bit_count(own) <= 1, bit).otherwise(home)
    near = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= max_bits) & (F.col("x.wildcard") == home)
    return apart(x.alias("x")).join(y.alias("y"), (F.col("x.wildcard") == F.col("y.wildcard")) & (F.col("x.rest") == F.col("y.rest")) & near).select("a", "b")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``: the smallest node of its component.

    Each round points every node to the neighbour that comes first in a
    shuffled order of its own, follows the pointers twice and contracts the
    edges to what they join then.  Groups that are densely linked collapse in
    the first round; shuffled orders keep chains of pointers short, so edges
    shrink by a constant factor a round.
    """
    edges = settle(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))
    for turn in range(rounds):
        if edges.isEmpty():
            least = state.groupBy("label").agg(F.min("node").alias("least"))
            return state.join(least, "label").select("node", F.col("least").alias("label"))
        order = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("n"))).alias("m"))
        up = settle(first.select(F.col("a").alias("label"), F.when(F.col("m.o") < order("a"), F.col("m.n")).otherwise(F.col("a")).alias("up")), "pointers")
        for _ in range(2):
            over = up.select(F.col("label").alias("up"), F.col("up").alias("top"))
            up = settle(up.join(over, "up").select("label", F.col("top").alias("up")), "pointers")
        state = settle(state.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        ends = up.select(F.col("label").alias("a"), F.col("up").alias("x"))
        tails = up.select(F.col("label").alias("b"), F.col("up").alias("y"))
        edges = settle(edges.join(ends, "a").join(tails, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    raise RuntimeError("components did not settle")


def groups(docs: DataFrame, words: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest document id reachable over links."""
    known = settle(fingerprints(docs, words), "fingerprints")
    points = settle(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    found = settle(links(points.select("fp"), max_bits), "links")
    label = components(found)
    named = points.join(label, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = named.join(smallest, "label").select("fp", "component_id")
    return known.join(of, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
