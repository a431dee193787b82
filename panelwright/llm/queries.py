"""One thin query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.llm import bottomk, bpe, langid, line_dedup, matroska, packing, sharding, simhash, style_tree, token_store, toxicity, vafile, whitening
from panelwright.llm.common import table
from panelwright.llm.registry import query


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_style_tree")
def op1(spark, folder):
    return style_tree.main_texts(table(spark, folder, "pages"))


@query("op2_toxicity")
def op2(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = toxicity.remainder(5) == 0
    grammar = toxicity.fit(docs, table(spark, folder, "labels"), ~held_out)
    return toxicity.score(docs, grammar).select("row.doc_id", "score").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_simhash")
def op3(spark, folder):
    return simhash.groups(table(spark, folder, "documents")).select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


LINES_SQL = """
WITH lines AS (
  SELECT d.doc_id, u.pos, u.line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM documents d, LATERAL (
    SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(d.text, ''), chr(10))))) AS pos) u
), counts AS (
  SELECT line_key, max(doc_id) AS keeper FROM lines
  WHERE length(line_key) >= 20 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.keeper IS NOT NULL AND c.keeper <> l.doc_id AS dropped
  FROM lines l LEFT JOIN counts c ON l.line_key = c.line_key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op4_line_dedup", LINES_SQL)
def op4(spark, folder):
    docs = table(spark, folder, "documents")
    done = line_dedup.clean(line_dedup.build(docs), docs)
    return done.select("row.doc_id", "kept.n_lines", "kept.n_dropped", F.sha2("kept.text", 256).alias("kept_sha256"))


@query("op5_sharding")
def op5(spark, folder):
    done = sharding.shard_documents(table(spark, folder, "documents"))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op6_bpe")
def op6(spark, folder):
    return bpe.digests(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


@query("op7_packing")
def op7(spark, folder):
    items = packing.pieces(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))
    return packing.pack(items).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op8_matroska")
def op8(spark, folder):
    return matroska.features(matroska.encode(table(spark, folder, "documents")))


@query("op9_langid")
def op9(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = langid.remainder(3) == 1
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs, model).select("row.doc_id", "found.*").select(
        "doc_id", held_out.alias("held_out"), F.col("lang").alias("lang_pred"), "score", "ambiguous")


@query("op10_bottomk")
def op10(spark, folder):
    return bottomk.edited_pairs(table(spark, folder, "documents"))


@query("op11_token_store")
def op11(spark, folder):
    return token_store.documents(token_store.write(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json")))


@query("op12_whitening")
def op12(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


def _clusters_sql(rounds: int = 10) -> str:
    """Rounds written out: distances of all vectors to all centroids, ties to the smaller number."""
    steps = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64
), parts AS MATERIALIZED (SELECT row_id, unnest(x) AS v, unnest(range(64)) AS i FROM kept
), c0 AS MATERIALIZED (
  SELECT k, unnest(x) AS v, unnest(range(64)) AS i FROM (
    SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS k, x FROM kept) WHERE k < 8
)"""
    for r in range(rounds + 1):
        steps += f""", a{r} AS MATERIALIZED (
  SELECT row_id, min(d * 8 + k) % 8 AS k, min(d * 8 + k) // 8 AS d FROM (
    SELECT p.row_id, c.k, sum((p.v - c.v) * (p.v - c.v)) AS d FROM parts p JOIN c{r} c USING (i) GROUP BY 1, 2) GROUP BY 1
)"""
        if r < rounds:
            steps += f""", c{r + 1} AS MATERIALIZED (
  SELECT c.k, c.i, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT a.k, p.i, CAST((sum(p.v) - (sum(p.v) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS v
    FROM a{r} a JOIN parts p USING (row_id) GROUP BY 1, 2) m ON m.k = c.k AND m.i = c.i
)"""
    return steps + f"""
SELECT kept.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, s.centroid_sha256
FROM a{rounds} a JOIN kept USING (row_id)
JOIN (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k) s ON s.k = a.k
"""


@query("op13_vafile", _clusters_sql())
def op13(spark, folder):
    return vafile.cluster(table(spark, folder, "embeddings"))
