"""Reversible line dedup: exact reference-count tables behind sharded cuckoo filters.

A line's key is its text without outer white space and with A-Z lower-cased;
keys are carried as 128-bit digests.  The ledger of a corpus has three tables:

* ``refs``   - one row per (key, document) with the number of such lines;
* ``counts`` - documents per key and the largest document id, the keeper;
* ``filters``- per shard a cuckoo filter of the keys at or over the threshold.

Adding documents adds their references, deleting documents takes them away;
keys that cross the threshold enter or leave the filters, so cleaning after a
deletion gives what a build without those documents would have given.  Filters
only save work: a line that may be repeated is always looked up in ``counts``.

Defined results: null text is one empty line; rows with a null id count as one
document with the smallest id; rows that repeat an id count as one document;
all other columns are carried along whatever their names; an empty table gives
an empty result; a key held by its keeper alone is never dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.common import apart, record, settle, slices

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys a filter is sized for, and the most filter bytes sent to every executor.
SHARD_KEYS, BROADCAST_BYTES = 32_768, 64 << 20
#: Parts into which the references of one key are spread for the look-up.
SALTS = 16
_SPACE = b" \t\n\x0b\x0c\r"
_REFS = pa.schema([("line_key", pa.binary()), ("doc", pa.int64()), ("lines", pa.int32())])


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """Digest of a line's key; None for keys that are too short to count."""
    raw = line.encode("utf-8", "surrogatepass").strip(_SPACE).lower()
    if len(raw) < min_chars or len(raw) < 4 * min_chars and len(raw.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(raw)


class CuckooFilter:
    """Set of 128-bit digests with deletion: 16-bit marks, four to a bucket, two buckets to a key.

    When an insertion finds no room the filter turns ``full`` and says yes to
    everything, which costs look-ups and never a result.
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, bits: int, slots: np.ndarray | None = None, full: bool = False):
        self.bits, self.full = bits, full
        self.slots = np.zeros((1 << bits, self.SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def sized(cls, keys: int) -> "CuckooFilter":
        return cls(max(2, int(np.ceil(np.log2(max(1, keys) / (cls.SLOTS * 0.8))))))

    def _places(self, digests: np.ndarray):
        """Mark and both buckets of ``(n, 2)`` 64-bit halves."""
        low, high = digests[:, 0], digests[:, 1]
        mark = (high & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (low & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return mark, first, first ^ self._jump(mark)

    def _jump(self, mark):
        return (mark.astype(np.int64) * 0x5BD1 >> 3) & (1 << self.bits) - 1

    def insert(self, digests: np.ndarray) -> None:
        mark, first, second = self._places(digests)
        for m, a, b in zip(mark, first.tolist(), second.tolist()):
            if self.full:
                return
            for at in (a, b):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = m
                    break
            else:
                at = a
                for turn in range(self.KICKS):
                    slot = (turn + int(m)) % self.SLOTS
                    m, self.slots[at, slot] = self.slots[at, slot], m
                    at ^= int(self._jump(np.array([m]))[0])
                    free = np.flatnonzero(self.slots[at] == 0)
                    if len(free):
                        self.slots[at, free[0]] = m
                        break
                else:
                    self.full = True

    def delete(self, digests: np.ndarray) -> None:
        """Take out keys that were inserted; one mark each."""
        mark, first, second = self._places(digests)
        for m, a, b in zip(mark, first.tolist(), second.tolist()):
            for at in (a, b):
                held = np.flatnonzero(self.slots[at] == m)
                if len(held):
                    self.slots[at, held[0]] = 0
                    break

    def contains(self, digests: np.ndarray) -> np.ndarray:
        if self.full:
            return np.ones(len(digests), bool)
        mark, first, second = self._places(digests)
        return ((self.slots[first] == mark[:, None]) | (self.slots[second] == mark[:, None])).any(axis=1)

    def to_bytes(self) -> bytes:
        return bytes([self.bits, self.full]) + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        return cls(data[0], np.frombuffer(data[2:], np.uint16).reshape(-1, cls.SLOTS).copy(), bool(data[1]))


def halves(keys) -> np.ndarray:
    """Digests as rows of two 64-bit numbers."""
    return np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2)


def shard_of(digests: np.ndarray, shards: int) -> np.ndarray:
    return ((digests[:, 1] >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


@dataclass(frozen=True)
class Ledger:
    """State of a corpus; every table is a DataFrame that can be written and read again."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``line_key, doc, lines``: one row per row of ``docs`` and key in it."""

    def run(batches):
        for b in slices(batches):
            keys, docs_, lines = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own: dict[bytes, int] = {}
                for line in (text or "").split("\n"):
                    k = line_key(line, min_chars) if len(line) >= min_chars else None
                    if k is not None:
                        own[k] = own.get(k, 0) + 1
                keys += own
                docs_ += [i] * len(own)
                lines += own.values()
            yield record(_REFS, [keys, docs_, lines])

    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text")).mapInArrow(run, "line_key binary, doc long, lines int")


def _count(refs: DataFrame) -> DataFrame:
    # a document counts once however many rows have its id; both steps combine before the shuffle
    return refs.groupBy("line_key", "doc").agg(F.lit(1).alias("one")).groupBy("line_key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("keeper"))


_FILTERS = "shard long, filter binary"


def _refilter(filters: DataFrame, added: DataFrame, removed: DataFrame, shards: int) -> DataFrame:
    """Filters after keys entered and left; shards are independent tasks of bounded size."""

    @F.pandas_udf("long")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(shard_of(halves(keys), shards) if len(keys) else [], dtype="int64")

    moves = added.select("line_key", F.lit(True).alias("enters")).unionByName(removed.select("line_key", F.lit(False).alias("enters")))

    def update(key, held, moved):
        f = CuckooFilter.from_bytes(held["filter"].iloc[0]) if len(held) else CuckooFilter.sized(2 * SHARD_KEYS)
        for enters, change in ((False, f.delete), (True, f.insert)):
            keys = moved["line_key"][moved["enters"] == enters].tolist()
            if keys:
                change(halves(keys))
        return pd.DataFrame({"shard": [key[0]], "filter": [f.to_bytes()]})

    return filters.groupBy("shard").cogroup(moves.withColumn("shard", shard("line_key")).groupBy("shard")).applyInPandas(update, _FILTERS)


def build(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> Ledger:
    """Ledger of a corpus; references and counts are stage tables."""
    spark = docs.sparkSession
    refs = settle(references(docs, min_chars), "refs")
    counts = settle(_count(refs), "counts")
    over = counts.where(F.col("docs") >= min_docs)
    shards = max(1, -(-over.count() // SHARD_KEYS))
    none = spark.createDataFrame([], _FILTERS)
    return Ledger(refs, counts, settle(_refilter(none, over, over.limit(0), shards), "filters"), shards, min_chars, min_docs)


def insert(ledger: Ledger, docs: DataFrame) -> Ledger:
    """Ledger with further documents (ids not seen before)."""
    new = settle(references(docs, ledger.min_chars), "refs")
    both = ledger.counts.unionByName(_count(new))
    counts = settle(both.groupBy("line_key").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper")), "counts")
    return _moved(ledger, ledger.refs.unionByName(new), counts)


def delete(ledger: Ledger, ids: DataFrame) -> Ledger:
    """Ledger without the documents in column ``doc_id``; only their keys are counted anew."""
    gone = ids.select(F.col("doc_id").cast("long").alias("doc")).distinct()
    refs = settle(ledger.refs.join(gone, "doc", "left_anti"), "refs")
    touched = ledger.refs.join(gone, "doc", "left_semi").select("line_key").distinct()
    counts = ledger.counts.join(touched, "line_key", "left_anti").unionByName(_count(refs.join(touched, "line_key", "left_semi")))
    return _moved(ledger, refs, settle(counts, "counts"))


def _moved(ledger: Ledger, refs: DataFrame, counts: DataFrame) -> Ledger:
    over = lambda c: c.where(F.col("docs") >= ledger.min_docs).select("line_key")
    added = over(counts).join(over(ledger.counts), "line_key", "left_anti")
    removed = over(ledger.counts).join(over(counts), "line_key", "left_anti")
    filters = settle(_refilter(ledger.filters, added, removed, ledger.shards), "filters")
    return Ledger(refs, counts, filters, ledger.shards, ledger.min_chars, ledger.min_docs)


def _may_repeat(ledger: Ledger, refs: DataFrame) -> DataFrame:
    """References whose key passes its shard's filter.

    Filters up to ``BROADCAST_BYTES`` go to every executor.  Beyond that all
    references go on to the exact look-up, which alone decides in both cases.
    """
    spark = refs.sparkSession
    held = ledger.filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
    if held > BROADCAST_BYTES:
        return refs
    known = spark.sparkContext.broadcast({r.shard: bytes(r.filter) for r in ledger.filters.collect()})
    shards = ledger.shards
    decoded: dict = {}

    def run(batches):
        if not decoded:
            decoded.update({s: CuckooFilter.from_bytes(f) for s, f in known.value.items()})
        for b in batches:
            if not b.num_rows:
                continue
            digests = halves(b.column(0).to_pylist())
            shard = shard_of(digests, shards)
            keep = np.zeros(b.num_rows, bool)
            for s in np.unique(shard):
                own = shard == s
                if int(s) in decoded:
                    keep[own] = decoded[int(s)].contains(digests[own])
            yield b.filter(pa.array(keep))

    return refs.mapInArrow(run, refs.schema)


_KEPT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def clean(ledger: Ledger, docs: DataFrame) -> DataFrame:
    """``docs`` with a last column ``kept``: text without dropped lines, lines before, lines dropped."""
    found = _may_repeat(ledger, ledger.refs.select("line_key", "doc"))
    over = ledger.counts.where(F.col("docs") >= ledger.min_docs).select(
        "line_key", "keeper", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    drops = (
        found.withColumn("salt", F.pmod(F.coalesce("doc", F.lit(0)), F.lit(SALTS)).cast("int")).join(apart(over), ["line_key", "salt"])
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("doc").agg(F.collect_set("line_key").alias("keys"))
    )
    min_chars = ledger.min_chars

    @F.pandas_udf(_KEPT)
    def kept(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, keys):
            lines = (text or "").split("\n")
            if own is None or not len(own):
                out.append((text or "", len(lines), 0))
                continue
            own = {bytes(k) for k in own}
            stay = [x for x in lines if len(x) < min_chars or line_key(x, min_chars) not in own]
            out.append(("\n".join(stay), len(lines), len(lines) - len(stay)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own"), "text")
    joined = whole.join(drops, F.col("own").eqNullSafe(F.col("doc")), "left")
    return joined.select("row", kept("text", "keys").alias("kept"))
