"""Token ids in shards of raw binary payload, addressed by a minimal perfect hash.

Documents are dealt to shards by ranges of their ids and written in ascending
order.  A shard is a run of chunks; a chunk holds the ids of whole documents
as little-endian 32-bit numbers without any separator.  The index maps a
document's key, its id and its number among the rows of that id, to shard,
chunk, place and length.

Keys are spread by hash over buckets of bounded size.  A bucket is a minimal
perfect hash: on each level the keys left fall on twice as many bits; a bit
that one key alone hits is that key's, the others go on to the next level.
The rank of a key's bit among all bits set is its slot, found from a stored
count of every word of bits.  A slot stores a fingerprint of its key, which
tells a foreign key apart, and the address.  Reading a key takes one bucket
row, a constant number of expected probes and one chunk.

Defined results: null text counts as empty and has the end id only; rows of
one id follow each other in an order that is fixed at writing and have keys of
their own; rows without an id come first; other columns are not looked at; an
empty table gives an empty store.  Special-token strings become special ids,
as in the library.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import partitions, slices, text_column
from panelwright.sources.io import shared_folder

#: Bytes and documents of a chunk, expected keys of a bucket, bits per key of a level.
CHUNK_BYTES, CHUNK_ROWS, BUCKET_KEYS, LOAD = 256 << 10, 4096, 32_768, 2
#: Words whose ids a worker remembers, twice as many at most, and the longest word that is remembered.
REMEMBERED, LONGEST = 400_000, 64


# ---------------------------------------------------------------- ids

class Coder:
    """A tokenizer of the library with a memory of words.

    White space ends a token in tokenizers that drop it, so the ids of a text
    are those of its words.  Where it also parts letters from punctuation and
    folds case, words are looked up without closing punctuation and in lower
    case.  Tokenizers that keep white space get whole texts.
    """

    #: ASCII punctuation that is never part of a contraction or a special token.
    CLOSING = ".,;:!?\")]}%&$#*"

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memory: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        # the rules that words are taken apart by, tried on words of several kinds
        words = ["a", "The", "don't", "x1y22", "é", "é", "́", "...", "'s", "ΑΣ", "<|endoftext|>", "日本", "🙂", "﻿", "ﬁ", "́a"]
        one = {w: self.whole(w) for w in words}
        self.by_word = all(self.whole(f"{a}{gap}{b}") == one[a] + one[b] for a in words for b in words for gap in (" ", "\n", "\t\r ", "\x0b", "\f"))
        plain = [w for w in words if w.isascii() and w[-1].isalnum()]
        self.by_part = self.by_word and all(self.whole(f"{w}{m}{n}") == one[w] + self.whole(m + n) for w in plain for m in self.CLOSING for n in ["", *self.CLOSING]) \
            and all(self.whole(w) == self.whole(w.lower()) == self.plain([w.lower()])[0] for w in ("The", "ABC", "mIxEdupWord", "Z"))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, words: list[str]) -> list[bytes]:
        """Ids of words of small ASCII letters, which normalising and splitting leave as they are: the model alone."""
        model = self.tokenizer.model
        found = [[t.id for t in model.tokenize(w)] for w in words]
        buffer, at, out = np.array([i for ids in found for i in ids], "<u4").tobytes(), 0, []
        for ids in found:
            out.append(buffer[at:at + 4 * len(ids)])
            at += 4 * len(ids)
        return out

    def learn(self, texts: list[str]) -> None:
        """Encode new words side by side, as one text, and remember the ids of each."""
        if self.by_part:
            plain = [w for w in texts if w.isascii() and w.isalpha() and w.islower()]
            self.memory.update(zip(plain, self.plain(plain)))
            texts = [w for w in texts if w not in self.memory]
            if not texts:
                return
        e = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.cumsum([0, *map(len, texts[:-1])]) + np.arange(len(texts))
        starts = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.offsets))
        ends = 4 * np.cumsum(np.bincount(np.searchsorted(begins, starts, "right") - 1, minlength=len(texts)))
        buffer, at = np.array(e.ids, "<u4").tobytes(), 0
        for w, end in zip(texts, ends.tolist()):
            self.memory[w], at = buffer[at:end], end

    def split(self, word: str) -> tuple[str, str]:
        """A word without its closing punctuation, in lower case where that is plain, and the punctuation."""
        stem = word.rstrip(self.CLOSING) if self.by_part else word
        if not (stem[-1:].isalnum() and stem[-1:].isascii()):
            return word, ""
        return stem.lower() if self.by_part and stem.isascii() and stem.isalnum() else stem, word[len(stem):]

    def recall(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; what was asked for lately stays in memory."""
        if len(self.memory) > REMEMBERED:
            self.memory, self.older = {"": b""}, self.memory
        memory, older = self.memory, self.older
        found = list(map(memory.get, words))
        new, stems, tails = [], [], []
        for i in [i for i, f in enumerate(found) if f is None]:
            w = words[i]
            if (f := older.get(w)) is not None:
                memory[w] = found[i] = f
            elif len(w) > LONGEST:
                found[i] = self.whole(w)
            else:
                stem, tail = self.split(w)
                new.append(i), stems.append(stem), tails.append(tail)
        fresh = []
        for p in {*stems, *tails} - memory.keys():
            if (f := older.get(p)) is not None:
                memory[p] = f
            else:
                fresh.append(p)
        if fresh:
            self.learn(fresh)
        for i, stem, tail in zip(new, stems, tails):
            found[i] = memory[words[i]] = memory[stem] + memory[tail] if tail else memory[stem]
        return found

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers: distinct words are looked up, all others are array look-ups."""
        import pyarrow.compute as pc

        if not self.by_word:
            return [self.whole(t) for t in texts.to_pylist()]
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        found = self.recall(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        values = np.frombuffer(b"".join(found), "<u4")
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins, at = np.cumsum(lengths) - lengths, coded.indices.to_numpy()
        ends = np.cumsum(lengths[at])
        where = np.repeat(begins[at] - (ends - lengths[at]), lengths[at]) + np.arange(ends[-1] if len(ends) else 0)
        buffer = values[where].tobytes()
        stops = 4 * np.r_[0, ends][split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [buffer[i:j] for i, j in zip(stops.tolist(), stops[1:].tolist())]


_CODERS: dict[int, Coder] = {}


def coder(spec: str) -> Coder:
    if hash(spec) not in _CODERS:
        _CODERS[hash(spec)] = Coder(spec)
    return _CODERS[hash(spec)]


# ---------------------------------------------------------------- minimal perfect hash

def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Well mixed 64-bit numbers of two hashes, one set per level."""
    with np.errstate(over="ignore"):
        h = a + b * np.uint64(2 * level + 1) + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)
        # The finaliser of splitmix64
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def build(a: np.ndarray, b: np.ndarray, load: int = LOAD, levels: int = 64) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes in words, words of bits, and bits set before each word, for distinct keys (a, b)."""
    sizes, words, left = [], [], np.arange(len(a))
    for level in range(levels):
        if not len(left):
            break
        count = -(-len(left) * load // 64)
        at = _mixed(a[left], b[left], level) % np.uint64(count * 64)
        hits = np.bincount(at.astype(np.int64), minlength=count * 64)
        sizes.append(count)
        words.append(np.packbits(hits == 1, bitorder="little").view("<u8"))
        left = left[hits[at.astype(np.int64)] > 1]
    if len(left):
        raise ValueError("keys of an index are repeated")
    bits = np.concatenate(words) if words else np.zeros(0, "<u8")
    return sizes, bits, np.r_[0, np.cumsum(np.bitwise_count(bits))][:len(bits)].astype("<u4")


def slots(a: np.ndarray, b: np.ndarray, sizes: list[int], bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 for a key that hits no bit."""
    out, left, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
    for level, count in enumerate(sizes):
        at = _mixed(a[left], b[left], level) % np.uint64(count * 64)
        word, bit = base + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        own = bits[word] >> bit
        hit = (own & np.uint64(1)).astype(bool)
        below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
        out[left[hit]] = (ranks[word] + np.bitwise_count(below))[hit]
        left, base = left[~hit], base + count
        if not len(left):
            break
    return out


# ---------------------------------------------------------------- store

_ROWS = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()),
                   ("again", pa.int64()), ("at", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
_ROWS_DDL = "shard int, chunk int, payload binary, doc_id long, again long, at long, start long, n long"
#: What a slot stores, in this order.
FIELDS = (("print", "<u4"), ("shard", "<i4"), ("chunk", "<i4"), ("at", "<i8"), ("start", "<i8"), ("n", "<i8"))
_INDEX_DDL = "bucket long, sizes array<long>, bits binary, ranks binary, " + ", ".join(f"{f} binary" for f, _ in FIELDS)
_FOUND_DDL = "id long, none boolean, again long, shard int, chunk int, at long, start long, n long"


def _hash(seed: int) -> Column:
    """A 64-bit hash of a key."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("again"))


def _keyed(rows: DataFrame, buckets: int) -> DataFrame:
    """Hashes and bucket of each key, and its id without nulls, which would turn ids to floats in pandas."""
    return rows.withColumns({"a": _hash(1), "b": _hash(2), "bucket": F.pmod(_hash(3), F.lit(buckets)),
                             "id": F.coalesce("doc_id", F.lit(0)), "none": F.col("doc_id").isNull()}).drop("doc_id")


def _named(found: DataFrame) -> DataFrame:
    return found.withColumn("doc_id", F.when(~F.col("none"), F.col("id"))).select("doc_id", *[c for c in found.columns if c not in ("id", "none")])


def _unsigned(column) -> np.ndarray:
    return np.asarray(column, np.int64).view(np.uint64)


def _prints(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Stored fingerprints; foreign keys of a slot agree once in 2^32."""
    return (_mixed(b, a, 255) >> np.uint64(32)).astype("<u4")


def _index_of(rows):
    """The index row of one bucket."""
    import pandas as pd

    a, b = _unsigned(rows["a"]), _unsigned(rows["b"])
    sizes, bits, ranks = build(a, b)
    order = np.argsort(slots(a, b, sizes, bits, ranks))
    values = {"print": _prints(a, b), **{f: rows[f].to_numpy() for f, _ in FIELDS[1:]}}
    return pd.DataFrame({"bucket": [int(rows["bucket"].iloc[0])], "sizes": [sizes], "bits": [bits.tobytes()], "ranks": [ranks.tobytes()],
                         **{f: [values[f][order].astype(kind).tobytes()] for f, kind in FIELDS}})


def _resolve(keys, index):
    """Addresses of the keys of one bucket that are in the index."""
    import pandas as pd

    if not len(keys) or not len(index):
        return pd.DataFrame({c.split()[0]: [] for c in _FOUND_DDL.split(", ")})
    row, a, b = index.iloc[0], _unsigned(keys["a"]), _unsigned(keys["b"])
    at = slots(a, b, row["sizes"].tolist(), np.frombuffer(row["bits"], "<u8"), np.frombuffer(row["ranks"], "<u4"))
    values = {f: np.frombuffer(row[f], kind) for f, kind in FIELDS}
    ok = (at >= 0) & (values["print"][np.maximum(at, 0)] == _prints(a, b))
    return pd.DataFrame({**{c: keys[c].to_numpy()[ok] for c in ("id", "none", "again")}, **{f: values[f][at[ok]] for f, _ in FIELDS[1:]}})


@dataclass(frozen=True)
class Store:
    """A written store: folders ``data``, ``index`` and ``manifest`` below one path."""

    spark: SparkSession
    path: str

    @property
    def payload(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data").where("payload is not null").select("shard", "chunk", "payload")

    @property
    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")

    @property
    def manifest(self) -> DataFrame:
        """One row per shard: its first id, the earlier rows of that id, tokens before it; and the number of buckets."""
        return self.spark.read.parquet(f"{self.path}/manifest")

    @property
    def keys(self) -> DataFrame:
        """``doc_id, again`` of every document."""
        rows = self.spark.read.parquet(f"{self.path}/data").where("n is not null").select("shard", "doc_id", "again")
        return self._numbered(rows).select("doc_id", "again")

    def _numbered(self, rows: DataFrame) -> DataFrame:
        shards = self.manifest.select("shard", "first_id", "earlier")
        carried = F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("earlier")).otherwise(0)
        return rows.join(F.broadcast(shards), "shard").withColumn("again", F.col("again") + carried)  # a row per shard

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``doc_id, again, shard, chunk, at, start, n`` of distinct keys that the store holds."""
        first = self.manifest.select("buckets").first()
        if first is None:
            return _named(self.spark.createDataFrame([], _FOUND_DDL))
        wanted = _keyed(keys.select("doc_id", "again").distinct(), first.buckets)
        found = _named(wanted.groupBy("bucket").cogroup(self.index.groupBy("bucket")).applyInPandas(_resolve, _FOUND_DDL))
        bases = self.manifest.select("shard", "base")
        return found.join(F.broadcast(bases), "shard").withColumn("start", F.col("start") + F.col("base")).drop("base")

    def read(self, keys: DataFrame) -> DataFrame:
        """``lookup`` with the raw ids of each document, little-endian 32-bit numbers."""
        cut = F.substring(F.col("payload"), (4 * F.col("at") + 1).cast("int"), (4 * F.col("n")).cast("int"))
        return self.lookup(keys).join(self.payload, ["shard", "chunk"]).withColumn("ids", cut).drop("payload")

    def get(self, doc_id: int | None, again: int = 0) -> list[int] | None:
        """Ids of one document by its key: one bucket of the index, one chunk of one shard."""
        first = self.manifest.select("buckets").first()
        if first is None:
            return None
        key = _keyed(self.spark.createDataFrame([(doc_id, again)], "doc_id long, again long"), first.buckets).toPandas()
        found = _resolve(key, self.index.where(F.col("bucket") == int(key["bucket"].iloc[0])).toPandas())
        if not len(found):
            return None
        f = found.iloc[0]
        chunk = self.payload.where((F.col("shard") == int(f["shard"])) & (F.col("chunk") == int(f["chunk"]))).first()
        return np.frombuffer(chunk.payload, "<u4")[int(f["at"]):int(f["at"] + f["n"])].tolist()


def _encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows of the data folder: a chunk's payload, or a document's place."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a file of fixed size
    end = np.array([end_id], "<u4").tobytes()
    order = [F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        c, shard = coder(spec.value), TaskContext.get().partitionId()
        held, size, chunk, start, last, again = [], 0, 0, 0, (False, None), 0
        for b in slices(batches, most=8192):
            out: list[tuple] = []
            for i, own in zip(b.column(0).to_pylist(), c.ids(b.column(1))):
                ids = own + end
                if held and (size + len(ids) > CHUNK_BYTES or len(held) == CHUNK_ROWS):
                    out.append((shard, chunk, b"".join(held), *[None] * 5))
                    held, size, chunk = [], 0, chunk + 1
                again = again + 1 if last == (True, i) else 0
                last = (True, i)
                out.append((shard, chunk, None, i, again, size // 4, start, len(ids) // 4))
                held.append(ids)
                size, start = size + len(ids), start + len(ids) // 4
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), _ROWS)], schema=_ROWS)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip((shard, chunk, b"".join(held), *[None] * 5)), _ROWS)], schema=_ROWS)

    return rows.mapInArrow(run, _ROWS_DDL)


def _manifest(spark: SparkSession, path: str) -> list[tuple]:
    """``shard, base, first_id, earlier, buckets``: sums over the shards before, of one row per shard."""
    data = spark.read.schema(_ROWS_DDL).parquet(f"{path}/data").where("n is not null")
    end = F.struct("doc_id", "again")
    shards = data.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens"), F.min(end).alias("first"), F.max(end).alias("last")).orderBy("shard").collect()
    out, base, earlier, before = [], 0, 0, None
    buckets = max(1, -(-sum(s.rows for s in shards) // BUCKET_KEYS))
    for s in shards:
        if before is None or before.last.doc_id != s.first.doc_id:
            earlier = 0
        else:  # the id goes on from the shard before, and from those before if it fills that one
            earlier = before.last.again + 1 + (earlier if before.first.doc_id == before.last.doc_id else 0)
        out.append((s.shard, base, s.first.doc_id, earlier, buckets))
        base, before = base + s.tokens, s
    return out


def write(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None) -> Store:
    """Encode, write and index all documents; ``path`` is the tokenizer's file."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}-tokens"
    save = lambda df, name: df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    save(_encode(docs, path, end_id), "data")
    shards = _manifest(spark, folder)
    save(spark.createDataFrame(shards, "shard int, base long, first_id long, earlier long, buckets long").coalesce(1), "manifest")
    store = Store(spark, folder)
    entries = store._numbered(spark.read.schema(_ROWS_DDL).parquet(f"{folder}/data").where("n is not null").drop("payload"))
    entries = _keyed(entries, shards[0][4] if shards else 1).select("bucket", "a", "b", "shard", "chunk", "at", "start", "n")
    save(entries.groupBy("bucket").applyInPandas(_index_of, _INDEX_DDL), "index")
    return store


def documents(store: Store) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read by key from the files."""
    return store.read(store.keys).select("doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
