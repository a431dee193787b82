"""Text operators against plain versions, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm import bottomk, bpe, langid, line_dedup, matroska, packing, sharding, simhash, style_tree, toxicity
from panelwright.llm.common import settle
from panelwright.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
CLASHES = ["row", "kept", "found", "score", "part", "tail", "fp", "rid", "link", "rank", "own", "doc", "salt", "line_key", "_id", "piece", "shard", "label"]
SHARED = "a line that three documents share"
ODD = [
    (1, "Hello world, this is a text of words."), (2, None), (3, ""), (4, " \t\n "), (5, "Hello world, this is a text of words."),
    (5, "Hello world, this is a text of words."), (None, "a row without an id"), (7, "one"), (8, "12 34 !!"),
    (9, f"{SHARED}\nfirst\n  {SHARED.upper()} "), (10, f"x\n{SHARED}"), (11, f"\n{SHARED}\n\n"), (12, "é" * 25 + "\nÜber ß İ Σ <|endoftext|> x\x00y"),
    (13, "word " * 30_000), (14, " ".join(f"w{i}" for i in range(5000))), (15, "  ﻿"), (-3, "negative id"),
]


def frame(spark, rows, **more):
    """Documents with columns whose names the operators use themselves."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
                          + [T.StructField(c, T.StringType()) for c in CLASHES])
    return spark.createDataFrame([(i, t, "en", *["x"] * len(CLASHES)) for i, t in rows], schema)


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


# ------------------------------------------------------------------ 1

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="no-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="tpl">Share this page now</div>
<article><header><h1>Title %d &amp;amp; more</h1></header><p><b>First &eacute; %s.<br><p>Second
   paragraph&nbsp;%s</p><div class="tpl">Follow us everywhere</div><!-- <p>no</p> --><form><p>mail</p></form>
<section id="comments"><p>nice post</p></section></article><aside><p>side</p></aside><div class="ad"><p>buy</p></div><footer>&copy; x</footer>"""


def test_style_tree_cuts_templates_and_furniture(spark):
    rows = [(i, f"http://a.example/{i}", PAGE % (i, f"text {i}", f"unique {i * 7}")) for i in range(12)]
    rows += [(90, None, PAGE % (90, "a", "b")), (91, "http://a.example/", None), (92, "x", ""), (93, "http://b.example", "<p>open <!-- never closed <p>x"), (0, rows[0][1], rows[0][2])]
    got = {r.page_id: r.text for r in style_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("low", F.lit("x"))).collect()}
    assert got[3] == "Title 3 &amp; more\n\nFirst é text 3.\n\nSecond paragraph unique 21"
    assert "Follow us everywhere" in got[90]  # a page without a host has no tree
    assert (got[91], got[92], got[93]) == ("", "", "open")
    assert style_tree.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_class_names_alone_do_not_empty_a_page():
    text = style_tree.extract
    for page in ("<article class='post related-topic'><p>Body</p></article>", "<div class='story header'><p>Body</p></div>",
                 "<main><div class='search-history'><p>Body</p></div></main>", "<article><div class='legal notice'><p>Body</p></div></article>"):
        assert text(page) == "Body"
    assert text("<article><p>Body</p><section id='comments'><p>many words of a reader</p></section></article><div class='sidebar'><p>x</p></div>") == "Body"
    assert text("<div class='comments'><p>only comments</p></div>") == text("<div class='menu'><ul><li>a</ul></div>") == text("<article class='comment'><p>c</p></article>") == ""
    assert text("<article></article><div class='sidebar'><p>aside</p></div>") == ""
    assert text("<div class='banner'><p>ad</p></div><div class='topic header'><p>the longer text</p></div>") == "the longer text"


def test_words_inside_attribute_values_are_no_attributes():
    page = '<article><p title="a hidden gem, class=ad">one <i data-x="role=search">two</i>three</p><p hidden>no</p><div CLASS=\'Side Nav-Bar\'>no</div><p>4 < 5 &lt; 6'
    assert style_tree.extract(page) == "one twothree\n\n4 < 5 < 6"


def test_style_tree_importance_by_hand(spark):
    # two styles on four pages, 3:1; one text on all pages, one on each alone
    rows = [("h", 7, 0, 1 if p < 3 else 2, [7], p) for p in range(4)] + [("h", 8, 1, 5, [7, 8], p) for p in range(4)] + [("h", 9, 1, 10 + p, [7, 9], p) for p in range(4)]
    rows += [("h", k, 0, 0, [7, k], p) for k in (8, 9) for p in range(4)]
    df = spark.createDataFrame(rows, "host string, path long, kind byte, value long, ancestors array<long>, page long")
    got = {r.branch: r.importance for r in style_tree.importance(df).collect()}
    assert got[8] == pytest.approx(0.0) and got[9] == pytest.approx(1.0)
    looks = -(0.75 * np.log(0.75) + 0.25 * np.log(0.25)) / np.log(4)
    assert got[7] == pytest.approx((4 * looks + 0.9 * 4 * (0 + 1)) / (4 + 0.9 * 8))


def test_style_tree_keeps_an_article_below_thirty_wrappers(spark):
    page = "<body>" + "".join(f'<div class="wrap{chr(97 + k % 26)} level{chr(97 + k // 26)}">' for k in range(30)) + '<div class="story"><p>%s</p><p>%s</p></div><div class="tpl">Same on all pages</div>' + "</div>" * 30
    rows = [(i, f"http://deep.example/{i}", page % (f"first {i}", f"second {i * 7}")) for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert max(len(r.ancestors) for r in style_tree.nodes_of(df).collect()) == 33
    assert {r.page_id: r.text for r in style_tree.main_texts(df).collect()} == {i: f"first {i}\n\nsecond {i * 7}" for i in range(10)}


# ------------------------------------------------------------------ 2, 9

def test_toxicity_grammar_kinds():
    g = toxicity.Grammar({"idiot": 1.0}, {"lowe": 0.8}, toxicity.PRIOR)
    kind = lambda s: [k for part in toxicity._CLAUSE.split(s.lower()) for k, _ in g.clause(toxicity._TOKEN.findall(part), False)]
    assert kind("what an idiot") == ["plain"] and kind("you are an idiot") == ["targeted"] and kind("idiot you") == ["targeted"]
    assert kind("he is not an idiot") == ["negated"] and kind("she said the man was an idiot") == ["reported"]
    assert kind("we will kill you") == ["threat"] and kind("loweqwe") == ["plain"] and kind("low") == []
    assert g.score("you are an idiot") > g.score("an idiot") > g.score("not an idiot") > g.score("")
    assert g.score('"idiot" is a word') < g.score("idiot is a word")
    assert kind("He said: you are an idiot") == ["reported"] and kind("I never said you are an idiot") == ["reported"]
    assert kind("they wrote, \u201cidiot, idiot\u201d") == ["reported"] * 2 and kind("kill the lights") == [] and kind("you will not kill") == ["negated"]
    assert g.sums('"First. An idiot" and idiot')[[0, 4]].tolist() == [1.0, 1.0]  # a quotation over two clauses


def test_composed_grammar_equals_enumeration_of_all_paths():
    import itertools

    from panelwright.llm import wfst

    def through(machine, labels):
        """Every sequence that a machine writes for labels, with its weight."""
        live = [((), 0.0, machine.start)]
        for label in labels:
            live = [((*out, z), w + v, to) for out, w, state in live for z, v, to in machine.arcs(state, label)]
        return [(out, w) for out, w, state in live if machine.final(state)]

    rng = np.random.default_rng(8)
    weights = {x: rng.uniform(0.1, 1) for x in "ihmtnrqo"}
    for quoted in (False, True):
        parts = toxicity.machines(quoted)
        for k in range(150):
            labels = list(rng.choice(list("iihhmtnrqoo"), rng.integers(1, 8)))
            paths = [(tuple(labels), 0.0)]
            for m in parts[:-1]:
                paths = [(out, w + v) for seq, w in paths for out, v in through(m, seq)]
            scales = [weights[x] for x in labels]
            score = lambda seq: sum(toxicity.FACTORS[toxicity.kind_of(x)] * s for x, s in zip(seq, scales) if toxicity.kind_of(x))
            best = max(score(seq) for seq, _ in paths)
            got, changed = toxicity.decoder(quoted).best(labels, scales)
            assert np.isclose(got, best) and np.isclose(sum(toxicity.FACTORS[toxicity.kind_of(x)] * scales[i] for i, x in changed), best)
    # composition is associative, and a machine without a path has none composed
    a, b, c = wfst.behind("t", ["i"], "T", 1), wfst.ahead("t", ["i"], "T", 1), wfst.weigh(lambda x: float(len(x)))
    left, right = wfst.Decoder(wfst.compose(wfst.compose(a, b), c)), wfst.Decoder(wfst.compose(a, wfst.compose(b, c)))
    for labels in itertools.product("ito", repeat=4):
        assert left.best(list(labels), [1.0] * 4)[0] == right.best(list(labels), [1.0] * 4)[0]
    assert wfst.Decoder(wfst.table(0, {(0, "a"): [("a", 1.0, 1)]}, {0})).best(["a"], [1.0]) is None


def test_toxicity_learns_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.remainder(5) == 0
    g = toxicity.fit(docs, labels, ~held)
    got = toxicity.score(docs, g).select("row.doc_id", "score").join(labels, "doc_id").where(held).toPandas()
    assert (got.score.between(0, 1)).all() and ((got.score >= 0.5) == (got.toxic == 1)).mean() > 0.985


def test_toxicity_defined_cases(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    g = toxicity.fit(docs, none, F.lit(True))
    got = toxicity.score(docs, g).select(F.col("score").alias("s"), "row.doc_id").toPandas()
    assert len(got) == len(ODD) and got.s.between(0, 1).all()
    assert toxicity.score(docs.limit(0), g).count() == 0
    nulls = spark.createDataFrame([(1, None), (5, 1), (7, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, nulls, F.lit(True))).count() == len(ODD)


def test_output_codes_are_apart():
    for n in (2, 3, 4, 6, 9, 20):
        c = langid.codewords(n)
        assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= max(1, c.shape[1] // 4)


def test_language_held_out_and_defined_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.remainder(3) == 1
    model = langid.fit(docs, ~held)
    got = langid.predict(docs.where(held), model).select(F.col("row.lang").alias("truth"), "found.*").toPandas()
    assert (got.truth == got.lang).mean() > 0.97 and got.score.between(0, 1).all()
    odd = langid.predict(frame(spark, ODD), model).select("row.doc_id", "row.text", "found.lang").collect()
    assert len(odd) == len(ODD)
    import unicodedata

    assert all((r.lang == "und") == (not any(unicodedata.category(c)[0] == "L" for c in r.text or "")) for r in odd)
    for text in ("\u00bd \u00b2", "\u2460\u2461", "\u2082", "\u2167 \u216b", "\u0301 _ 1", "\u0663"):
        assert model.predict(text)[0] == "und" and not len(langid.buckets(text))
    # vowel signs stay inside their words
    assert len(langid.buckets("\u0939\u093f\u0928\u094d\u0926\u0940")) > len(langid.buckets("\u0939 \u0928 \u0926"))
    one = langid.fit(frame(spark, ODD), F.lit(True))
    assert one.predict("abc") == ("en", 1.0, False) and one.predict("1") == ("und", 0.0, True)
    assert langid.fit(docs.limit(0), F.lit(True)).predict("abc")[0] == "und"


# ------------------------------------------------------------------ 3

def plain_fingerprint(text):
    w = plain_words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def test_simhash_on_odd_rows(spark):
    got = simhash.groups(frame(spark, ODD)).select("doc_id", simhash.hex_digits().alias("f"), "component_id").collect()
    fps = [plain_fingerprint(t) for _, t in ODD]
    label = plain_components(fps)
    least = {v: min((i for (i, _), x in zip(ODD, label) if x == v and i is not None), default=None) for v in label}
    want = sorted(((i, f"{f:016x}", least[v]) for (i, _), f, v in zip(ODD, fps, label)), key=str)
    assert sorted(((r.doc_id, r.f, r.component_id) for r in got), key=str) == want
    assert simhash.groups(frame(spark, [])).count() == 0


def test_simhash_links_find_every_near_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2)
    fps = {int(b) for b in base} | {0, (1 << 64) - 1, 1 << 63}
    for b in base:
        for _ in range(25):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    assert len(got) == len(set(got)) and set(got) == want


def test_variants_of_a_small_file_are_not_broadcast(spark):
    points = settle(spark.range(3000).select(F.xxhash64("id").alias("fp")), "points")
    found = simhash.links(points)
    # 64 rows a fingerprint: the planner takes them for as large as the file
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("bit_count(a ^ b) > 4 or a >= b").isEmpty()


def test_components_of_long_paths(spark):
    rng = np.random.default_rng(1)
    names = rng.permutation(400)
    edges = [(int(names[i]), int(names[i + 1])) for i in range(299)] + [(int(names[i]), int(names[300])) for i in range(301, 399)]
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    first, second = min(names[:300]), min(names[300:399])
    assert got == {int(n): int(first if k < 300 else second) for k, n in enumerate(names[:399])}


# ------------------------------------------------------------------ 4

def plain_lines(rows):
    """Cleaned text per row, by definition."""
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held: dict = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(i)
    top = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in held.items() if len(v) >= 3}
    return sorted(((i, "\n".join(x for x in (t or "").split("\n") if key(x) not in top or top[key(x)] == i)) for i, t in rows), key=str)


def cleaned(ledger, docs):
    return sorted(((r.doc_id, r.text) for r in line_dedup.clean(ledger, docs).select("row.doc_id", "kept.text").collect()), key=str)


def test_salted_keys_of_a_small_file_are_not_broadcast(spark):
    docs = frame(spark, ODD)
    plan = line_dedup.clean(line_dedup.build(docs), docs)._jdf.queryExecution().executedPlan().toString()
    # sixteen rows a key: the planner takes them for as large as the file
    assert "SortMergeJoin [line_key" in plan


def test_line_dedup_and_its_reversal(spark):
    docs = frame(spark, ODD)
    ledger = line_dedup.build(docs)
    assert cleaned(ledger, docs) == plain_lines(ODD)
    more = [(20, f"{SHARED}\nnew line that is long enough"), (21, "new line that is long enough"), (22, "NEW line that is long enough\t")]
    both = line_dedup.insert(ledger, frame(spark, more))
    everything = frame(spark, ODD + more)
    assert cleaned(both, everything) == plain_lines(ODD + more)
    gone = line_dedup.delete(both, spark.createDataFrame([(20,), (11,)], "doc_id long"))
    rest = [r for r in ODD + more if r[0] not in (20, 11)]
    assert cleaned(gone, frame(spark, rest)) == plain_lines(rest)
    back = line_dedup.delete(both, spark.createDataFrame([(i,) for i, _ in more], "doc_id long"))
    counts = lambda x: sorted((bytes(r.line_key), r.docs, r.keeper) for r in x.counts.collect())
    assert counts(back) == counts(ledger)
    none = frame(spark, [])
    assert line_dedup.clean(line_dedup.build(none), none).count() == 0


def test_line_dedup_without_broadcast_filters(spark, monkeypatch):
    docs = frame(spark, ODD)
    ledger = line_dedup.build(docs)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert cleaned(ledger, docs) == plain_lines(ODD)


def test_cuckoo_filter_holds_deletes_and_fills():
    rng = np.random.default_rng(0)
    d = rng.integers(0, 1 << 63, (3000, 2), dtype=np.uint64)
    f = line_dedup.CuckooFilter.sized(3000)
    f.insert(d)
    assert not f.full and f.contains(d).all()
    assert f.contains(rng.integers(0, 1 << 63, (20_000, 2), dtype=np.uint64)).mean() < 0.005
    f.delete(d[:1500])
    assert f.contains(d[1500:]).all() and f.contains(d[:1500]).mean() < 0.01
    g = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert (g.slots == f.slots).all()
    small = line_dedup.CuckooFilter(2)
    small.insert(d)
    assert small.full and small.contains(d).all()


# ------------------------------------------------------------------ 5

def test_sharding_is_exact_and_keeps_copies_together(spark):
    rows = [(i, f"text {i}") for i in range(200)] + [(1000 + i, f"copy {i // 5}") for i in range(100)] + ODD
    got = sharding.shard_documents(frame(spark, rows)).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(rows) and len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    copies = got[got.doc_id.between(1000, 1099)]
    assert (copies.groupby("text_crc32").shard.nunique() == 1).mean() >= 0.9
    assert sorted(got["size"]) == sorted(len((t or "").encode()) + 1 for _, t in rows)
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_sharding_with_a_hot_group(spark):
    rows = [(i, "the same") for i in range(300)] + [(i, f"t{i}") for i in range(300, 600)]
    got = sharding.shard_documents(frame(spark, rows)).toPandas()
    sizes = got.groupby("shard").size()
    assert list(sizes) == [75] * 8
    hot = got[got.doc_id < 300].groupby("shard").size()
    assert (hot >= 60).sum() >= 3  # four shards would hold all of it


# ------------------------------------------------------------------ 6, 7

@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


STRANGE = ["don't I'LL 1234 ½ ① ǅ ẞ é 한국어 日本語 😀👩‍👩‍👧   x\x00\x1c\x1f​﻿ ÿ", "a" * 3000, "!?" * 50, "ﬁ K Å ͅ", "Ⅷ ٣ ΣΊΣΥΦΟΣ ΟΔΟΣ",
           "<|startoftext|>A<|endoftext|><|endoftext|> b <|other|>", "\t\r\n  x  \n\n y", "we've they'll I'm 'tis"]


def test_bpe_matches_library(spark, libraries):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rows = ODD + [(100 + i, t) for i, t in enumerate(STRANGE + texts)]
    lib = libraries["word_bpe_49k.json"]
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in bpe.encode(frame(spark, rows), tokenizer("word_bpe_49k.json")).collect()), key=str)
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, lib.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    assert bpe.digests(frame(spark, []), tokenizer("word_bpe_49k.json")).count() == 0


def test_bpe_repairs_only_what_fails():
    with open(tokenizer("word_bpe_49k.json"), encoding="utf-8") as f:
        e = bpe.Encoder(f.read())
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdehiklmnorstu"), rng.integers(1, 14))) for _ in range(3000)]
    e.learn(sorted(set(words)))
    assert 0 < e.exact < len(set(words))
    for w in set(words):
        assert e.memory[w][1] == " ".join(map(str, e.merge([w.encode()])[0])) if w else True


def test_pieces_match_library_and_pack(spark, libraries):
    lib = libraries["byte_bpe_50k.json"]
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rows = ODD + [(100 + i, t) for i, t in enumerate(STRANGE + texts)]
    items = packing.pieces(frame(spark, rows), tokenizer("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [(0, len(ids))] if len(ids) <= 2048 else [(0, len(ids) % 2048)] * bool(len(ids) % 2048) + [(s, 2048) for s in range(len(ids) % 2048, len(ids), 2048)]
        want += [(i, k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())) for k, (s, n) in enumerate(cuts)]
    got = packing.pack(items, part_rows=60).toPandas()
    keys = lambda rows: sorted((tuple(-99 if v is None or v != v else int(v) for v in r) for r in rows))
    assert keys(got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist()) == keys(want)
    assert_packed(got)
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 3
    assert packing.pack(packing.pieces(frame(spark, []), tokenizer("byte_bpe_50k.json"))).count() == 0


def assert_packed(got, capacity=2048):
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= capacity


def test_lower_bound_never_exceeds_best_packing():
    rng = np.random.default_rng(2)

    def exact(sizes, c):  # fewest bins by search
        best = [len(sizes)]

        def place(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(sizes):
                best[0] = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + sizes[k] <= c:
                    place(k + 1, bins[:i] + [bins[i] + sizes[k]] + bins[i + 1:])
            place(k + 1, bins + [sizes[k]])

        place(0, [])
        return best[0]

    for _ in range(60):
        sizes = sorted(rng.integers(1, 21, rng.integers(1, 8)).tolist(), reverse=True)
        least, bound = exact(sizes, 20), packing.lower_bound(np.array(sizes), 20)
        used = packing.best_fit(np.array(sizes), 20)[0].max() + 1
        assert bound <= least <= used
    assert packing.lower_bound(np.array([1030] * 7), 2048) == 7  # more than the sum of sizes shows


# ------------------------------------------------------------------ 8

def test_matroska_round_trip(spark):
    got = {(r.doc_id, r.payload_sha256): r for r in matroska.features(matroska.encode(frame(spark, ODD))).collect()}
    for i, t in ODD:
        raw = (t or "").encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i, hashlib.sha256(pad).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.problem) == (len(raw), len(pad), zlib.crc32(pad[-64:]), None) and "cues_sound=1" in r.feature
    media = matroska.encode(frame(spark, ODD))
    p = matroska.packets(media).toPandas()
    assert (p.length > 0).all() and p.track.eq(1).all()
    assert matroska.packets(media.limit(0)).count() == 0


@pytest.mark.parametrize("lacing,sizes", [(matroska.NONE, [5]), (matroska.XIPH, [255, 0, 700, 3]), (matroska.FIXED, [9, 9, 9]), (matroska.EBML_LACING, [800, 20, 20, 9000, 1])])
def test_matroska_lacings_groups_and_unknown_sizes(lacing, sizes):
    frames = [bytes([i]) * n for i, n in enumerate(sizes)]
    e, u = matroska._element, matroska._uint
    content = matroska.block(300, -7, frames, lacing)
    cluster = u(matroska.TIMESTAMP, 1000) + e(matroska.BLOCK_GROUP, e(matroska.BLOCK, content) + e(matroska.REFERENCE, b"\xff")) + e(0xEC, b"void")
    open_cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster
    second = e(matroska.CLUSTER, u(matroska.TIMESTAMP, 2000) + e(matroska.SIMPLE_BLOCK, content))
    data = e(matroska.EBML, u(matroska.VERSION, 1)) + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + open_cluster + second
    found = matroska.parse(data)
    assert found["problem"] is None and [p[1] for p in found["packets"]] == [993] * len(sizes) + [1993] * len(sizes)
    assert [data[a:a + n] for *_, a, n in found["packets"]] == frames * 2
    assert [p[3] for p in found["packets"]] == [False] * len(sizes) + [True] * len(sizes)


def test_matroska_damage_is_reported():
    data = matroska.write(b"x" * 64 * 300)
    assert matroska.parse(None)["problem"] and matroska.parse(b"no")["problem"]
    cut = matroska.parse(data[:-50])
    assert cut["problem"]
    rng = np.random.default_rng(4)
    for _ in range(200):
        bad = bytearray(data)
        bad[rng.integers(0, 200)] = rng.integers(0, 256)
        matroska.parse(bytes(bad))  # never raises


# ------------------------------------------------------------------ 10

def test_bottomk_pairs_against_definition(spark):
    rows = [(i, f"text {i} " + " ".join(f"w{(i * j) % 97}" for j in range(i * 3))) for i in range(1, 120)] + [(3000, None), (4000, ""), (5000, "x")]
    got = {r.doc_id: r for r in bottomk.edited_pairs(frame(spark, rows)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        new = t[:len(t) - len(t) // 2] + following[:len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        a, b, c = map(bottomk.sketch, (t, new, following))
        assert (r.fingerprint, r.edited_fingerprint) == (bottomk.to_text(a), bottomk.to_text(b))
        assert (r.near_edited, r.near_next) == (bottomk.resemblance(a, b), bottomk.resemblance(a, c))


def test_bottomk_odd_rows(spark):
    got = bottomk.edited_pairs(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 5)}) == 1
    assert bottomk.edited_pairs(frame(spark, [])).count() == 0
    one = bottomk.edited_pairs(frame(spark, [(4, "abcd")])).collect()
    assert [(r.near_next, r.edited_sha256) for r in one] == [(1.0, hashlib.sha256(b"abab").hexdigest())]


def test_bottomk_estimates():
    rng = np.random.default_rng(7)
    a = [f"w{i}" for i in rng.integers(0, 5000, 3000)]
    b = a[:2400] + [f"v{i}" for i in range(600)]
    sa, sb = bottomk.sketch(" ".join(a)), bottomk.sketch(" ".join(b))
    shingles = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    x, y = shingles(a), shingles(b)
    assert bottomk.resemblance(sa, sb) == pytest.approx(len(x & y) / len(x | y), abs=0.13)
    assert bottomk.containment(sa, sb) == pytest.approx(len(x & y) / len(x), abs=0.2)
    assert bottomk.distinct_count(sa) == pytest.approx(len(x), rel=0.3)
    whole = " ".join(a)
    parts = bottomk.merge(bottomk.sketch(" ".join(a[:1504])), bottomk.sketch(" ".join(a[1500:])))
    assert (parts == bottomk.sketch(whole)).all() and (bottomk.from_text(bottomk.to_text(sa)) == sa).all()
