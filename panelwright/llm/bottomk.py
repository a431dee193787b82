"""Bottom-k sketches of word-shingle hashes as document fingerprints.

The sketch of a text keeps the ``k`` smallest distinct hashes of its shingles
of five words.  Two sketches merge into the sketch of the union (keep the k
smallest of both), so parts of a corpus or of a long text can be sketched
anywhere.  From sketches follow the distinct shingle count, the resemblance
and the containment.

Defined results: null text counts as empty; a text of fewer than five words is
one shingle, a text without words has an empty sketch; two empty sketches
resemble each other fully, an empty and a filled one not at all.  Equal texts
have equal sketches.  ``edited_pairs`` orders by doc_id descending with null
last and breaks ties of repeated ids by the text, so repeated rows are
neighbours; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import BATCH_ROWS, partitions, record, text_column

WORDS, K = 5, 128
#: Ranges of ids per shuffle partition: several small ones even out the partitions.
RANGES = 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Invertible scrambling of 64-bit words, so that shingle hashes spread evenly."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * _MULTIPLIER
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit hash of every shingle, repeats included; empty without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").split()
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(words, len(h))):
            out = _mix(out * _MULTIPLIER + h[i:i + n])
    return out


def sketch(text: str | None, k: int = K, words: int = WORDS) -> np.ndarray:
    """The k smallest distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, words))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of what two sketches stand for."""
    return np.union1d(a, b)[:k]


def distinct_count(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles: exact below k."""
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[k - 1]) + 1) / 2.0 ** 64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of two shingle sets."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return float(min(1.0, shared / distinct_count(a, k)))


def to_text(s: np.ndarray) -> str:
    """Hex digits of the sketch, 16 a hash, largest first byte."""
    return s.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def sketches(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """``doc_id, fingerprint, n_shingles`` of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()), ("n_shingles", pa.float64())])

    def run(batches):
        for b in batches:
            found = [sketch(t.as_py(), k, words) for t in b.column(1)]
            yield record(schema, [b.column(0), [to_text(s) for s in found], [distinct_count(s, k) for s in found]])

    return docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the start of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_PAIRS = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_shingles", pa.float64()), ("kept_share", pa.float64())])


def _below(cuts: list[int]) -> F.Column:
    """How many of the ascending cuts are less than the id: first among every ``step``-th, then in between."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    numbers = lambda xs: F.array(*[F.lit(c).cast("long") for c in xs])
    less = lambda a: F.size(F.filter(a, lambda c: c < F.col("doc_id")))
    chunks = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    whole = less(numbers([c[0] for c in chunks]))
    return F.when(whole == 0, 0).otherwise((whole - 1) * step + less(F.element_at(F.array(*map(numbers, chunks)), whole)))


def edited_pairs(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Each document against its edited text and the document after it.

    The order is global but no task sees more than its ranges: ids are cut at
    sampled quantiles, each range is sorted and streamed by one task, and the
    first document of a range is also sent to the range before it.  Only the
    range bounds and first ids (a few per partition) reach the driver.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = partitions(spark)
    ranges = RANGES * n
    probe = [i / ranges for i in range(1, ranges)]
    cuts = sorted({int(c) for c in ids.na.drop().approxQuantile("doc_id", probe, max(1e-4, 0.2 / ranges))})
    last = len(cuts) + 1
    place = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.lit(len(cuts)) - _below(cuts)), F.lit(last)).cast("int").alias("part")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).select("doc_id", "text", place)
    firsts = sorted((r.part, r.first) for r in ids.select("doc_id", place).groupBy("part").agg(F.max("doc_id").alias("first")).collect())
    before = {firsts[i][0]: firsts[i - 1][0] for i in range(len(firsts))}
    named = [(first, before[p]) for p, first in firsts if first is not None] or [(0, 0)]
    copies = rows.drop("part").join(F.broadcast(spark.createDataFrame(named, "doc_id long, part int")), "doc_id")
    if last in before:  # rows without an id: their largest text comes first
        one = rows.where(F.col("part") == last).agg(F.max("text").alias("text"))
        copies = copies.unionByName(one.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(before[last]).alias("part")))
    both = rows.withColumn("tail", F.lit(0)).unionByName(copies.withColumn("tail", F.lit(1)))
    dealt = both.repartition(n, "part").sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), F.col("text").desc())

    def pair(a, b):
        (i, text, mine), (_, following, other) = a, b
        changed = edited(text, following)
        new = sketch(changed, k, words)
        return (i, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), to_text(mine), to_text(new),
                resemblance(mine, new, k), resemblance(mine, other, k), distinct_count(mine, k), containment(new, mine, k))

    def run(batches):
        done, held, held_part, closed = [], None, None, True
        for b in batches:
            for i, text, part, tail in zip(*(b.column(c) for c in ("doc_id", "text", "part", "tail"))):
                part, tail = part.as_py(), tail.as_py()
                if part == held_part and closed:  # a further copy of a repeated first id
                    continue
                row = (i.as_py(), text.as_py(), sketch(text.as_py(), k, words))
                if part == held_part:
                    done.append(pair(held, row))
                held, held_part, closed = row, part, bool(tail)
                if len(done) >= BATCH_ROWS:
                    yield record(_PAIRS, list(zip(*done)))
                    done = []
        if done:
            yield record(_PAIRS, list(zip(*done)))

    return dealt.mapInArrow(run, (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, n_shingles double, kept_share double"))
