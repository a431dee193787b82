"""Corpus pipeline: raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import langid, line_dedup, near_texts, packing, toxicity
from panelwright.llm.common import settle, table
from panelwright.llm.queries import tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language stay; those without any letter go.  Where nothing can be learned, every text with a letter stays."""
    model = langid.fit(docs, F.lit(True))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    return langid.predict(docs, model).where("found.lang <> 'und'").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is at least one half go."""
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(docs, grammar).where("score < 0.5").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three documents or more stay in the last of them only; every document stays."""
    done = line_dedup.clean(line_dedup.build(docs), docs).withColumn("row", F.col("row").withField("text", F.col("kept.text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("row", F.col("row").withField("n_chars", F.length("kept.text").cast(docs.schema["n_chars"].dataType)))
    return done.select("row.*")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike in four fifths of their five-word shingles the document with the smallest id stays.

    Fingerprints of these shingles find the links first, MinHash keys those that they miss.
    """
    return near_texts.one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, as pieces of sequences."""
    items = packing.pieces(docs, tokenizer("byte_bpe_50k.json"))
    return packing.pack(items).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("best_fit_packing", pack_sequences),
]

# Language, toxicity, fingerprints and tokens have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = settle(stage(spark, out, sf_dir), name)
    return STAGES[-1][1](spark, out, sf_dir)
