"""Near-duplicates: SimHash finds links first, banded MinHash what it misses, texts decide.

Two texts are linked when the sets of their five-word shingles have a Jaccard
similarity of ``LEAST`` or more.  Each distinct text is one point.  First it
has the component of its fingerprint as a key: fingerprints of the same
shingles that differ in at most ``MAX_BITS`` bits, found by the index of
``simhash``.  Edits of a few words in a hundred change more bits than that, so
then it has ``BANK.bands`` keys of several minima; a pair at 0.8 shares none of
them with a probability below one in ten thousand, closer pairs still less.
Only keys whose points the fingerprints have not joined are looked at.

Points that share a key are not paired.  In a round one point of each key, its
head, is held against the key's points of other components: the one that
shares most keys with others, so that the middle of a group of copies comes
first and most of the group is one component after it.  Where a key still
holds several components after ``ROUNDS`` such rounds, its points outside the
largest one are held against all others inside tasks: both sides are dealt
into blocks of bounded size, and a task compares one block of each, skipping
what its links have joined already.  Rows grow with the points outside, never
with pairs.  Every candidate is verified on the texts themselves, so no pair
below ``LEAST`` is linked, and no pair of different components that shares a
key goes unverified.

Defined results: null text counts as empty; texts without words are equal; a
text of fewer words than a shingle is one shingle; rows are told apart by id
and text, so rows that share an id but not a component all have their own; of
a component the row with the smallest id stays, one without an id only where
none has one, and of equal ids and several texts the one whose digest comes
first; other columns of any type are not looked at, but choose among equal
rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import apart, record, settle, slices, text_column
from panelwright.llm.simhash import components, fingerprints, links

#: Words of a shingle, similarity of linked texts.
WORDS, LEAST = 5, 0.8
#: Rows of a look-up table that is sent to every executor; pairs a copy of a hot text serves.
BROADCAST_ROWS, PAIRS_OF_COPY = 1_000_000, 256


class Bank:
    """Keys of a text: ``bands`` of them, each of ``rows`` minima of a hash family of its own."""

    def __init__(self, bands: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.seed = bands, rows, seed
        self.factors = (rng.integers(0, 1 << 31, (bands * rows, 1)) * 2 + 1).astype(np.uint32)
        self.offsets = rng.integers(0, 1 << 32, (bands * rows, 1)).astype(np.uint32)

    def keys(self, text: str | None) -> list[int]:
        """One signed key per band."""
        h = np.fromiter(map(xxhash.xxh32_intdigest, shingles(text)), np.uint32)
        least = np.full(self.bands * self.rows, np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(h), 4096):
            least = np.minimum(least, (h[i:i + 4096] * self.factors + self.offsets).min(axis=1))
        own = least.reshape(self.bands, self.rows)
        return np.array([xxhash.xxh64_intdigest(own[b].tobytes(), self.seed * 1000 + b) for b in range(self.bands)], np.uint64).view(np.int64).tolist()


BANK = Bank(24, 5, 7)
#: Rounds with one head per key; points and text bytes of a block.
ROUNDS, BLOCK_POINTS, BLOCK_BYTES = 2, 512, 8 << 20


def shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    """Distinct shingles of a text, none without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def similarity(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def digest() -> Column:
    """128 bits that stand for a text."""
    return F.md5(text_column())


def points(docs: DataFrame) -> DataFrame:
    """``digest, text, point``: one numbered row per distinct text."""
    texts = docs.select(digest().alias("digest"), text_column().alias("text")).dropDuplicates(["digest"])
    return settle(texts.withColumn("point", F.monotonically_increasing_id()), "texts")


_KEYS = pa.schema([("point", pa.int64()), ("key", pa.int64())])


def members(texts: DataFrame) -> DataFrame:
    """``key, point, n`` of the keys that n > 1 points share."""
    bank = BANK

    def run(batches):
        for b in slices(batches):
            found, keys = b.column(0).to_pylist(), [bank.keys(t) for t in b.column(1).to_pylist()]
            yield record(_KEYS, [np.repeat(np.array(found, np.int64), bank.bands), np.array(keys, np.int64).ravel()])

    return _shared(settle(texts.select("point", "text").mapInArrow(run, "point long, key long"), "keys"))


def clusters(texts: DataFrame) -> DataFrame:
    """``key, point, n`` of the points whose fingerprints are linked to others' or equal; the key is the component's smallest fingerprint."""
    known = settle(fingerprints(texts.select(F.col("point").alias("doc_id"), "text"), WORDS).select(F.col("doc_id").alias("point"), "fp"), "fingerprints")
    label = components(links(settle(known.select("fp").distinct(), "points")))
    named = known.join(label, F.col("fp") == F.col("node"), "left").select("point", F.coalesce("label", "fp").alias("key"))
    return _shared(settle(named, "clusters"))


def _shared(keys: DataFrame) -> DataFrame:
    """``key, point, n`` of the keys that n > 1 points share."""
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return settle(keys.join(several, "key").select("key", "point", "n"), "members")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs ``a, b`` of points whose texts have at least the similarity."""
    load = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_OF_COPY).cast("int").alias("copies")).where("copies > 1")
    load = _small(settle(load, "load"))
    text = lambda n, t: texts.select(F.col("point").alias(n), F.col("text").alias(t))
    copies = F.coalesce("copies", F.lit(1))
    # the copies of a hot text share its pairs
    wanted = pairs.select("a").distinct().join(load, "a", "left")
    first = wanted.join(text("a", "x"), "a").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    dealt = pairs.join(load, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), copies).cast("int").alias("copy"))
    both = dealt.join(text("b", "y"), "b").join(first, ["a", "copy"])

    def run(batches):
        held, of = None, set()
        for b in slices(batches, "y"):
            kept = []
            for i, j, x, y in zip(*(b.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                if held != i:
                    held, of = i, shingles(x)
                if similarity(of, shingles(y)) >= least:
                    kept.append((i, j))
            yield record(_LINKS, list(zip(*kept)) if kept else [[], []])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _named(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``key, point, label`` of rows with a key and a point."""
    if labels is None:
        return rows.select("key", "point", F.col("point").alias("label"))
    return rows.join(labels, "point", "left").select("key", "point", F.coalesce("label", "point").alias("label"))


def _joined(labels: DataFrame | None, near: DataFrame) -> DataFrame:
    """Labels of all linked points after the new links; only components that these join are looked at."""
    if labels is None:
        return components(near).select(F.col("node").alias("point"), "label")
    of = lambda n: labels.select(F.col("point").alias(n), F.col("label").alias(f"of_{n}"))
    ends = near.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    met = settle(components(ends).select(F.col("node").alias("label"), F.col("label").alias("now")), "met")
    old = labels.join(met, "label", "left").select("point", F.coalesce("now", "label").alias("label"))
    fresh = met.join(labels.select(F.col("point").alias("label")), "label", "left_anti").select(F.col("label").alias("point"), F.col("now").alias("label"))
    return settle(old.unionByName(fresh), "labels")


def _within_keys(named: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links between the components of each key, found block by block inside tasks."""
    sized = settle(named.join(texts.select("point", F.octet_length("text").alias("bytes")), "point"), "sized")
    own = sized.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK_POINTS, w / BLOCK_BYTES, F.lit(1))).cast("int")
    largest = F.max(F.struct("n", "label", "bytes"))
    plan = own.groupBy("key").agg(largest.alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("n > top.n")
    plan = plan.select("key", F.col("top.label").alias("most"), blocks(F.col("n"), F.col("bytes")).alias("inner"),
                       blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("outers"))
    rows = settle(sized.join(plan, "key").drop("bytes"), "planned")
    deal = lambda seed, n: F.pmod(F.xxhash64("point", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = rows.where("label <> most").withColumn("i", deal(1, "outers")).select("key", "i", every("inner").alias("j"), F.lit(True).alias("outer"), "point", "label", "most")
    inner = rows.withColumn("j", deal(2, "inner")).select("key", every("outers").alias("i"), "j", F.lit(False).alias("outer"), "point", "label", "most")
    placed = apart(outer.unionByName(inner)).join(texts.select("point", "text"), "point")
    placed = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.col("outer").desc())

    def group(rows):
        """Links of one block pair; components that are joined meanwhile are not compared again."""
        up: dict = {}

        def root(x):
            while x in up:
                x = up[x]
            return x

        heads = [(p, lab, shingles(t)) for o, p, lab, _most, t in rows if o]
        for o, p, lab, most, t in rows:
            if o:
                continue
            of = None
            for q, other, sh in heads:
                # two points outside the largest component meet twice; once is enough
                if q == p or lab != most and q > p or root(lab) == root(other):
                    continue
                of = shingles(t) if of is None else of
                if min(len(sh), len(of)) >= least * max(len(sh), len(of)) and similarity(sh, of) >= least:
                    up[root(other)] = root(lab)
                    yield q, p

    def run(batches):
        held, rows, out = None, [], []
        for b in slices(batches):
            for key, i, j, *row in zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", "outer", "point", "label", "most", "text"))):
                if (key, i, j) != held:
                    out += group(rows)
                    held, rows = (key, i, j), []
                rows.append(row)
            yield record(_LINKS, list(zip(*out)) if out else [[], []])
            out = []
        out += group(rows)
        yield record(_LINKS, list(zip(*out)) if out else [[], []])

    return settle(placed.select("key", "i", "j", "outer", "point", "label", "most", "text").mapInArrow(run, "a long, b long").distinct(), "inside")


def labelled(texts: DataFrame, least: float = LEAST) -> DataFrame:
    """``point, label`` of the points that are linked to others: equal labels, one component."""
    labels = None
    for keys in (clusters, members):
        labels = _met(keys(texts), labels, texts, least)
    return labels if labels is not None else texts.select("point", F.col("point").alias("label")).where("false")


def _met(found: DataFrame, labels: DataFrame | None, texts: DataFrame, least: float) -> DataFrame | None:
    """Labels after all points of a key have been held against those of other components."""
    shared = found.groupBy("point").agg(F.sum("n").alias("shared"))
    open_ = found.join(shared, "point").select("key", "point", "shared")
    open_ = settle(open_, "open") if labels is None else _open(open_, labels)
    for _ in range(ROUNDS):
        if open_.isEmpty():
            break
        named = settle(open_.join(labels, "point", "left").withColumn("label", F.coalesce("label", "point")) if labels is not None
                       else open_.withColumn("label", F.col("point")), "named")
        first = F.max(F.struct("shared", F.xxhash64("point").alias("order"), F.col("point").alias("head"), F.col("label").alias("of")))
        heads = settle(named.groupBy("key").agg(first.alias("m")).select("key", "m.head", "m.of"), "heads")
        pairs = named.join(heads, "key").where("label <> of").select(F.col("head").alias("a"), F.col("point").alias("b")).distinct()
        near = settle(verified(settle(pairs, "pairs"), texts, least), "near")
        if not near.isEmpty():
            labels = _joined(labels, near)
        # the head has met all points of its key; a key of one component is done
        rest = named.join(heads.select("key", F.col("head").alias("point")), ["key", "point"], "left_anti")
        open_ = _open(rest.select("key", "point", "shared"), labels)
    if not open_.isEmpty():
        near = _within_keys(_named(open_, labels), texts, least)
        if not near.isEmpty():
            labels = _joined(labels, near)
    return labels


def _open(rest: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of the keys that hold several components."""
    now = settle(_named(rest, labels), "rest")
    several = now.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    return settle(rest.join(several, "key", "left_semi").select("key", "point", "shared"), "open")


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each component."""
    texts = points(docs)
    labels = labelled(texts, least)
    id_ = F.col("doc_id").cast("long")
    first = docs.groupBy(digest().alias("digest")).agg(F.min(F.struct(id_.isNull().alias("none"), id_.alias("id"))).alias("first"))
    named = texts.select("digest", "point").join(labels, "point", "left").select("digest", F.coalesce("label", "point").alias("label"))
    ranked = first.join(named, "digest").groupBy("label").agg(F.min(F.struct("first.none", "first.id", "digest")).alias("stay"))
    stay = settle(ranked.select(F.col("stay.id").alias("_id"), F.col("stay.digest").alias("_digest")), "stay")
    rows = docs.select(F.struct("*").alias("row"), id_.alias("_id"), digest().alias("_digest"))
    same = lambda t: rows["_id"].eqNullSafe(t["_id"]) & (rows["_digest"] == t["_digest"])
    rows = rows.join(stay, same(stay), "left_semi")
    often = settle(rows.groupBy("_id", "_digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    if often.isEmpty():
        return rows.select("row.*")
    again = rows.join(often, same(often), "left_semi").groupBy("_id", "_digest").agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row"))
    return rows.join(often, same(often), "left_anti").select("row.*").unionByName(again.select("row.*"))
