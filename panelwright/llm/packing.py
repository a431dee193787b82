"""Best-fit packing of tokenized documents with certified bin counts.

Documents become token counts; longer ones than a sequence are cut, the first
piece taking the remainder.  Whole pieces are sequences of their own.  The
others are dealt to parts; each part runs best-fit decreasing and compares its
bins with a lower bound from dual-feasible functions.  A part that meets the
bound is certified: no packing of its pieces has fewer bins, and only its least
filled bin may still be joined with others.  Parts with a gap keep their full
bins.  All other bins' pieces are pooled, dealt anew and packed again, until
they fit one part or a round saves no bin.

Defined results: null text counts as empty and is one piece (the end mark
alone); pieces of equal length are ordered by document and place; repeated
rows are packed as documents of their own; other columns are not looked at;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.common import record, settle, slices

CAPACITY = 2048
#: Pieces that one part is sized for, and the most rounds of exchange.
PART_ROWS, ROUNDS = 20_000, 4


# ---------------------------------------------------------------- tokens

_CODERS: dict = {}


def coder(spec: str):
    """Byte-level encoder of a tokenizer file, built once a worker.

    The file's vocabulary is handed to the faster of the two public
    libraries; ids are those of the file, its special strings included.
    """
    key = zlib.crc32(spec.encode())
    if key not in _CODERS:
        import tiktoken

        from panelwright.llm.bpe import byte_letters

        conf = json.loads(spec)
        back = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in conf["model"]["vocab"].items() if t not in special}
        # Fixed value: the word pattern of byte-level tokenizers
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _CODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _CODERS[key]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document, from its whole text."""
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a file of fixed size

    def run(batches):
        c = coder(spec.value)
        for b in slices(batches):
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = c.encode_to_numpy(text or "", allowed_special="all").astype("<u4") if text else np.empty(0, "<u4")
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                rows += [(i, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            yield record(_PIECES, list(zip(*rows)) if rows else [[]] * len(_PIECES))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- packing

def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of pieces given by descending length: each goes where least room is left."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[int] = []  # distinct amounts of room, ascending
    open_: dict[int, list[int]] = {}
    used = 0
    for k, n in enumerate(lengths.tolist()):
        at = bisect_left(rooms, n)
        if at == len(rooms):
            b, room, used = used, capacity, used + 1
        else:
            room = rooms[at]
            b = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
        bins[k], offsets[k] = b, capacity - room
        left = room - n
        if left:
            if left not in open_:
                insort(rooms, left)
                open_[left] = []
            open_[left].append(b)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Least number of bins, by the best of three families of dual-feasible functions.

    For a threshold t at most half the capacity: pieces over C - t count as
    whole bins, pieces under t as nothing, others by size.  For a divisor k:
    sizes are rounded by ``(k + 1) x / C`` to k-ths.  And: pieces over half a
    bin count one half more, by how many of size t fit beside them.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = int(-(-(counts * size).sum() // capacity))
    up, weight = np.cumsum(counts), np.cumsum(counts * size)
    for t in range(1, capacity // 2 + 1):
        whole = up[capacity] - up[capacity - t]
        middle = weight[capacity - t] - weight[t - 1]
        best = max(best, int(whole + -(-middle // capacity)))
    for k in range(1, 51):
        x = (k + 1) * size
        exact = x % capacity == 0
        value = np.where(exact, size * k, (x // capacity) * capacity)  # in units of 1 / (k C)
        best = max(best, int(-(-(counts * value).sum() // (k * capacity))))
    half = capacity // 2
    for t in range(1, half + 1):
        fit = capacity // t
        value = np.where(size > half, 2 * (fit - (capacity - size) // t), 2 * (size // t))
        value = np.where(2 * size == capacity, fit, value)
        best = max(best, int(-(-(counts * value).sum() // (2 * fit))))
    return best


_PACKED = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()),
    ("part", T.LongType()), ("bin", T.LongType()), ("offset", T.LongType()), ("round", T.IntegerType()),
    ("part_bins", T.LongType()), ("part_bound", T.LongType()), ("bin_tokens", T.LongType()), ("least_filled", T.BooleanType()))])
_KEYS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _pack(rows: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    """Deal pieces to parts of equal mix and pack each."""

    def one(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        n = pdf["length"].to_numpy(np.int64)
        b, off = best_fit(n, capacity)
        out = pdf[_KEYS].assign(part=key[0], bin=b, offset=off, round=turn, part_bins=int(b.max()) + 1, part_bound=lower_bound(n, capacity))
        filled = np.bincount(b, weights=n).astype(np.int64)
        return out.assign(bin_tokens=filled[b], least_filled=b == int(filled.argmin()))

    part = F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", "ids_crc32"), F.lit(parts)).alias("part")
    return rows.select(*_KEYS, part).groupBy("part").applyInPandas(one, _PACKED)


def pack(items: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``items`` as from ``pieces``.

    Also returned: the round that placed a piece and its part's bins and bound.
    """
    items = settle(items, "pieces")
    whole = items.where(F.col("length") == capacity)
    todo = items.where(F.col("length") < capacity)
    done, count = [], todo.count()
    held, held_bins = None, 0
    for turn in range(rounds + 1):
        if not count:
            break
        parts = -(-count // part_rows)
        packed = settle(_pack(todo, parts, turn, capacity), f"packed{turn}")
        used = packed.groupBy("part").agg(F.first("part_bins").alias("bins")).agg(F.sum("bins")).first()[0]
        if held is not None and used >= held_bins:  # the exchange saved nothing
            done.append(held)
            break
        if turn == rounds or parts == 1:
            done.append(packed)
            break
        # full bins stay, and of certified parts all but the least filled; the other bins' pieces are exchanged
        certified = F.col("part_bins") == F.col("part_bound")
        stays = (certified & ~F.col("least_filled")) | (F.col("bin_tokens") == capacity)
        done.append(packed.where(stays))
        held = packed.where(~stays)
        held_bins, count = held.agg(F.countDistinct("part", "bin"), F.count(F.lit(1))).first()
        todo = held.select(*_KEYS)
    own = F.col("round").cast("long") * (1 << 56) + F.col("part") * (1 << 24) + F.col("bin")
    out = whole.select(
        *_KEYS, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(-1).alias("round"), F.lit(1).cast("long").alias("part_bins"), F.lit(1).cast("long").alias("part_bound"))
    for d in done:
        out = out.unionByName(d.select(*_KEYS, own.alias("sequence_id"), "offset", "round", "part_bins", "part_bound"))
    return out
