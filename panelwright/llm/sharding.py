"""Balanced label propagation: shards of equal row counts that keep linked documents together.

Documents start in the shard of their hash.  In each round every linked
document counts, over its links, how many neighbours each shard holds (links
are groups, so neighbours are never paired) and asks to move to the fullest
one that beats its own.  A move from a to b is granted against a move from b to
a, or while b has room; the strongest wishes come first.  Documents without
links are ballast: they fill every shard to its exact quota at the end.

The driver sees counts per pair of shards and wish class only.

Defined results: null text has no bytes and is equal to other null texts only;
rows are told apart by a row number of their own, so repeated or null ids are
fine; equal wishes are told apart by hashes of link and row; other columns are
not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import settle

SHARDS, ROUNDS = 8, 12
#: Wish classes told apart when moves are granted, and rows ranked by one task.
STRENGTHS, MIXES, FINE, RANK_ROWS = 24, 32, 10_000, 50_000
#: A round that moves a smaller share of the linked documents is the last.
LEAST_SHARE = 0.0005
#: Parts of the rows of one link when its counts are looked up.
SALTS = 16


def rank(rows: DataFrame, by: str | None, total: int) -> DataFrame:
    """Column ``rank``: place of each row (``rid``) among those with equal ``by``, from 0, without one task per group."""
    buckets = max(16, -(-total // RANK_ROWS))
    group = F.col(by) if by else F.lit(0)
    dealt = rows.withColumn("_g", group).withColumn("_b", F.pmod(F.xxhash64("rid"), F.lit(buckets)))
    sizes = dealt.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_g", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    inside = Window.partitionBy("_g", "_b").orderBy("rid")
    return dealt.join(starts, ["_g", "_b"]).withColumn("rank", F.col("_s") + F.row_number().over(inside) - 1).drop("_g", "_b", "_s")


def _votes(members: DataFrame, state: DataFrame, shards: int) -> DataFrame:
    """``rid, votes``: neighbours (itself included) in each shard, summed over the document's links."""
    per_link = members.join(state, "rid").groupBy("link").agg(
        F.array(*[F.sum((F.col("shard") == s).cast("long")) for s in range(shards)]).alias("votes"))
    salted = per_link.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    seen = members.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).join(salted, ["link", "salt"])
    return seen.groupBy("rid").agg(
        F.array(*[F.sum(F.col("votes")[s]) for s in range(shards)]).alias("votes"), F.min("link").alias("link"))


def _wishes(votes: DataFrame, state: DataFrame, open_: list[int], shards: int) -> DataFrame:
    """Moves that documents ask for: ``rid, shard, target`` and the class of the wish."""
    taste = lambda s: F.pmod(F.xxhash64("link", F.lit(s)), F.lit(1 << 20))  # noqa: E731  the order of equal shards, one per link
    choice = F.array_max(F.array(*[
        F.struct(F.col("votes")[s].alias("v"), taste(s).alias("t"), F.lit(s).alias("s")) for s in range(shards)
        if s in open_] or [F.struct(F.lit(-1).cast("long").alias("v"), F.lit(0).cast("long").alias("t"), F.lit(-1).alias("s"))]))
    here = F.element_at("votes", F.col("shard") + 1)
    own_taste = F.element_at(F.array(*[taste(s) for s in range(shards)]), F.col("shard") + 1)
    asked = votes.join(state, "rid").withColumn("c", choice).withColumn("gain", F.col("c.v") - here)
    asked = asked.where((F.col("gain") > 0) | ((F.col("gain") == 0) & (F.col("c.t") > own_taste) & (F.col("c.s") != F.col("shard"))))
    strength = F.least(F.lit(STRENGTHS - 1), F.floor(F.log2(F.col("gain") + 1)))
    mix = F.pmod(F.xxhash64("link"), F.lit(MIXES))
    return asked.select(
        "rid", "shard", F.col("c.s").alias("target"), ((STRENGTHS - 1 - strength) * MIXES + mix).cast("int").alias("class"),
        F.pmod(F.xxhash64("rid", F.lit("fine")), F.lit(FINE)).cast("int").alias("fine"))


def _grants(asked: dict[tuple[int, int], list[tuple[int, int]]], load: list[int], cap: list[int]) -> list[tuple[int, int, int, int]]:
    """Per pair of shards the last class granted and how fine a part of it."""
    flow = {k: sum(n for _, n in v) for k, v in asked.items()}
    room = [c - n for c, n in zip(cap, load)]
    out = []
    for (a, b), classes in sorted(asked.items(), key=lambda kv: -flow[kv[0]]):
        swap = min(flow[a, b], flow.get((b, a), 0))
        extra = min(flow[a, b] - swap, max(0, room[b]))
        room[b] -= extra
        left = swap + extra
        for c, n in sorted(classes):
            if n > left:
                out.append((a, b, c, left * FINE // n))
                break
            left -= n
        else:
            out.append((a, b, 1 << 30, 0))
    return out


def propagate(members: DataFrame, state: DataFrame, cap: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``rid, shard`` of linked documents after propagation; ``members`` is ``rid, link``."""
    spark, shards = state.sparkSession, len(cap)
    for _ in range(rounds):
        load = [0] * shards
        for r in state.groupBy("shard").count().collect():
            load[r.shard] = r["count"]
        open_ = [s for s in range(shards) if load[s] < cap[s]] or list(range(shards))
        wishes = settle(_wishes(_votes(members, state, shards), state, open_, shards), "wishes")
        asked: dict = defaultdict(list)
        for r in wishes.groupBy("shard", "target", "class").count().collect():  # at most shards^2 * classes rows
            asked[r.shard, r.target].append((r["class"], r["count"]))
        if not asked:
            break
        granted = spark.createDataFrame(_grants(asked, load, cap), "shard int, target int, last int, part int")
        moved = wishes.join(F.broadcast(granted), ["shard", "target"]).where(
            (F.col("class") < F.col("last")) | ((F.col("class") == F.col("last")) & (F.col("fine") < F.col("part")))
        ).select("rid", "target")
        state = settle(state.join(moved, "rid", "left").select("rid", F.coalesce("target", "shard").cast("int").alias("shard"), F.col("target").isNotNull().alias("moved")), "state")
        share = state.agg(F.avg(F.col("moved").cast("int"))).first()[0] or 0.0
        state = state.select("rid", "shard")
        if share < LEAST_SHARE:
            break
    return state


def fill(base: DataFrame, linked: DataFrame, total: int, shards: int) -> DataFrame:
    """Every row's shard and slot: linked rows up to the quota, all others by rank into what is left."""
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    ranked = settle(rank(linked, "shard", total), "ranked")
    limit = F.element_at(F.array(*map(F.lit, quota)), F.col("shard") + 1)
    placed = ranked.where(F.col("rank") < limit).select("rid", "shard", F.col("rank").cast("long").alias("slot"))
    held = [0] * shards
    for r in placed.groupBy("shard").count().collect():
        held[r.shard] = r["count"]
    rest = settle(rank(base.select("rid").join(placed.select("rid"), "rid", "left_anti"), None, total), "ballast")
    start, bounds = 0, []
    for s in range(shards):
        bounds.append((s, start, start + quota[s] - held[s], held[s]))
        start = bounds[-1][2]
    shard: Column = F.lit(None).cast("int")
    slot: Column = F.lit(None).cast("long")
    for s, a, b, n in bounds:
        inside = (F.col("rank") >= a) & (F.col("rank") < b)
        shard, slot = F.when(inside, F.lit(s)).otherwise(shard), F.when(inside, F.col("rank") - a + n).otherwise(slot)
    return placed.unionByName(rest.select("rid", shard.cast("int").alias("shard"), slot.cast("long").alias("slot")))


def describe(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, size, text_crc32, link``: the row's number, measures and the digest of its text."""
    text = F.col("text")
    return docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"),
        F.unhex(F.coalesce(F.md5(text), F.lit("00"))).alias("link"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` with equal texts as links."""
    base = settle(describe(docs), "documents")
    total = base.count()
    groups = base.groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("link")
    groups = groups.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salted = base.select("rid", "link", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int").alias("salt"))
    members = settle(salted.join(groups, ["link", "salt"], "left_semi").select("rid", "link"), "members")
    start = members.select("rid").distinct().withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int"))
    cap = [total // shards] * shards
    linked = propagate(members, settle(start, "state"), cap, rounds)
    return base.drop("link").join(fill(base, linked, total, shards), "rid").drop("rid")
