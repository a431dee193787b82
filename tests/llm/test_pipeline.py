"""Registered queries, the SQL of those that have it, and the pipeline against a plain version."""

from __future__ import annotations

from panelwright.llm import ORACLE, QUERIES, langid, packing, simhash, toxicity
from panelwright.llm.queries import tokenizer
from tests.llm.test_near_texts import plain_kept
from tests.llm.test_operators import assert_packed, plain_lines
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_names_and_sql(spark):
    import __spark_entry__

    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    for name, sql in ORACLE.items():
        assert compare(spark, connect(SF), name, QUERIES[name], sql, SF).startswith("OK")


def test_stages_against_plain_version(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    from pyspark.sql import functions as F

    one = cp.identify_language(spark, docs, SF)
    model = langid.fit(docs, F.lit(True))
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {i for i, r in rows.items() if model.predict(r.text)[0] != "und"}
    two = cp.drop_toxic(spark, docs, SF)
    grammar = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    assert two.columns == columns and {r.doc_id for r in two.collect()} == {i for i, r in rows.items() if grammar.score(r.text) < 0.5}
    three = cp.dedup_lines(spark, docs, SF)
    assert three.columns == columns
    assert sorted(((r.doc_id, r.text) for r in three.collect()), key=str) == plain_lines([(i, r.text) for i, r in rows.items()])
    assert all(r.n_chars == len(r.text) for r in three.collect())
    four = cp.dedup_near(spark, docs, SF)
    assert four.columns == columns and sorted((False, r.doc_id) for r in four.collect()) == plain_kept(sorted((i, r.text) for i, r in rows.items()))


def test_run_packs_what_the_stages_keep(spark):
    import corpus_pipeline as cp

    got = cp.run(spark, SF).toPandas()
    assert_packed(got)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    want = packing.pieces(docs, tokenizer("byte_bpe_50k.json")).toPandas()
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got[keys].to_numpy().tolist()) == sorted(want[keys].to_numpy().tolist())
    assert simhash.MAX_BITS == 4 and len(cp.STAGES) == 5


def test_language_stage_without_labels_keeps_every_text_with_a_letter(spark):
    import corpus_pipeline as cp

    rows = [(1, "abc", None), (2, "½ ² 12", None), (3, None, None), (4, "", None), (5, "हि", None)]
    got = cp.identify_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert sorted(r.doc_id for r in got) == [1, 5]
