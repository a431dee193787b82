"""Near-duplicate stage of the pipeline against exact similarities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelwright.llm import near_texts, simhash
from tests.llm.test_operators import ODD, frame, plain_words


def plain_shingles(text):
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := plain_words(text)) else set()


def plain_similarity(a, b):
    a, b = (plain_shingles(t) if isinstance(t, str) or t is None else t for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_kept(rows):
    label, sets = list(range(len(rows))), [plain_shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and plain_similarity(sets[i], sets[j]) >= 0.8:
                label = [label[j] if v == label[i] else v for v in label]
    first: dict = {}
    for v, (i, t) in zip(label, rows):
        first[v] = min(first.get(v, (True, 1 << 62)), (i is None, i or 0))
    return sorted(first.values())


def edited(rng, words, at):
    out = list(words)
    for k in at:
        out[k] = f"new{rng.integers(1 << 40)}"
    return " ".join(out)


def test_stage_finds_copies_with_edits_but_none_below(spark):
    import corpus_pipeline as cp

    rng = np.random.default_rng(1)
    rows, far = [], 0
    for k in range(12):
        words = [f"w{rng.integers(3000)}" for _ in range(200)]
        rows.append((10 * k, " ".join(words)))
        rows.append((10 * k + 1, edited(rng, words, (20, 70, 120, 170))))                     # 0.81
        rows.append((10 * k + 2, edited(rng, words, (15, 50, 85, 120, 155, 190))))            # 0.73
        far += (simhash.fingerprint(rows[-3][1]) ^ simhash.fingerprint(rows[-2][1])).bit_count() > simhash.MAX_BITS
    assert far  # pairs that fingerprints within four bits miss
    got = sorted(r.doc_id for r in cp.dedup_near(spark, frame(spark, rows), "").collect())
    assert got == [i for _, i in plain_kept(rows)] == [10 * k + d for k in range(12) for d in (0, 2)]


def test_rows_of_one_id_and_without_id(spark):
    words = " ".join(f"v{i}" for i in range(60))
    rows = [r for r in ODD if len(r[1] or "") < 9000] + [(5, "quite another text of the same id, which is linked to nothing"), (5, words), (6, words + " end"), (None, words + " end"), (None, "alone " * 9 + "here")]
    got = near_texts.one_of_each(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == plain_kept(rows)
    assert {"quite another text of the same id, which is linked to nothing", words} <= {r.text for r in got if r.doc_id == 5}


def test_chains_beyond_the_first_text_of_a_key(spark):
    # texts that move on by three of 80 words: neighbours are alike, ends are not
    words = [f"c{i}" for i in range(140)]
    rows = [(k, " ".join(words[3 * k:3 * k + 80])) for k in range(20)]
    assert plain_similarity(rows[0][1], rows[-1][1]) < 0.8 and [r.doc_id for r in near_texts.one_of_each(frame(spark, rows)).collect()] == [0]


def test_keys_meet_at_the_least_similarity():
    rng = np.random.default_rng(5)
    for k in range(300):
        words = [f"w{rng.integers(10 ** 6)}" for _ in range(49)]
        other = edited(rng, words, (20,))
        assert plain_similarity(" ".join(words), other) >= 0.8
        assert set(near_texts.BANK.keys(" ".join(words))) & set(near_texts.BANK.keys(other))


def test_keys_shared_by_many_components_are_finished(spark, monkeypatch):
    # short keys, so that texts of half their words in common meet in one key, and drifting groups within
    monkeypatch.setattr(near_texts, "BANK", near_texts.Bank(12, 1, 7))
    monkeypatch.setattr(near_texts, "BLOCK_POINTS", 7)
    rng = np.random.default_rng(9)
    common, rows = [f"k{i}" for i in range(60)], []
    for g in range(25):
        words = common + [f"g{g}x{i}" for i in range(60)]
        for k in range(4):
            rows.append((len(rows), edited(rng, words, rng.choice(120, k, False))))
    got = near_texts.one_of_each(frame(spark, rows)).collect()
    assert sorted((False, r.doc_id) for r in got) == plain_kept(rows)


def test_columns_without_an_order_and_equal_rows(spark):
    rows = [(1, "one two three four five six", {"a": "1"}), (1, "one two three four five six", {"a": "2"}), (None, "x y", None), (None, "x y", None), (3, None, {}), (4, "", {})]
    got = near_texts.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, more map<string,string>")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "x y"), (1, "one two three four five six"), (3, None)]
    assert near_texts.one_of_each(spark.createDataFrame([], "doc_id long, text string, more map<string,string>")).count() == 0


def test_recall_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((False, r.doc_id) for r in near_texts.one_of_each(docs).collect()) == plain_kept(rows)


def test_fingerprints_find_links_before_other_keys(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows, near = [], 0
    for k in range(6):
        words = [f"w{rng.integers(3000)}" for _ in range(400)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, edited(rng, words, (200,)))]
        near += (simhash.fingerprint(rows[-2][1], 5) ^ simhash.fingerprint(rows[-1][1], 5)).bit_count() <= simhash.MAX_BITS
    assert near
    seen = []
    monkeypatch.setattr(near_texts, "members", lambda texts: seen.append(1) or texts.select(F.lit(0).cast("long").alias("key"), "point", F.lit(2).cast("long").alias("n")).where("false"))
    got = near_texts.one_of_each(frame(spark, rows)).count()
    assert seen and got == 12 - near  # without MinHash keys nothing was found before
