"""Token store, whitening and centroid clustering against plain versions."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from panelwright.llm import token_store, vafile, whitening
from panelwright.llm.queries import op11, op12, op13, tokenizer
from tests.llm.test_operators import ODD, SF, frame

WORDS = "word_bpe_49k.json"


# ------------------------------------------------------------------ 11

def plain_ids(rows, path=WORDS, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(path))
    t.no_truncation()
    t.no_padding()
    return [[*t.encode(text or "", add_special_tokens=False).ids, end] for _, text in rows]


def plain_store(rows, **kw):
    """Rows in ascending id order, nulls first; those of one id in any order."""
    out, start = [], 0
    for ids in plain_ids(rows, **kw):
        out.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_of_the_table(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op11(spark, SF).collect()}
    assert list(map(got.get, [i for i, _ in rows])) == plain_store(rows)


def test_store_keeps_odd_rows_and_finds_them_by_key(spark):
    odd = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    store = token_store.write(frame(spark, ODD), tokenizer(WORDS))
    found = store.read(store.keys).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n, zlib.crc32(r.ids)) for r in found) == sorted(
        (i is None, i or 0, n, c) for (i, _), (_, n, c) in zip(odd, plain_store(odd)))
    ends = sorted((r.start, r.start + r.n) for r in found)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))  # gapless
    order = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [i for i, _ in odd]
    ids = dict(zip([i for i, _ in odd], plain_ids(odd)))
    for key in (None, 1, 2, 13, -3):
        assert store.get(key) == ids[key]
    assert sorted(map(str, (store.get(5, 0), store.get(5, 1)))) == sorted(str(v) for (i, _), v in zip(odd, plain_ids(odd)) if i == 5)
    assert store.get(5, 2) is None and store.get(99) is None
    absent = spark.createDataFrame([(i, 0) for i in range(10_000, 10_500)] + [(1, 0)], "doc_id long, again long")
    assert [r.doc_id for r in store.lookup(absent).collect()] == [1]


def test_store_splits_one_id_over_shards(spark):
    big = 1 << 60
    rows = [(i, f"text {i}") for i in range(200)] + [(big + 1, f"copy {k % 3} of many") for k in range(400)] + [(big + 2, "last"), (None, "none")]
    store = token_store.write(frame(spark, rows).repartition(5), tokenizer(WORDS))
    shards = {r.shard for r in store.lookup(store.keys).where(f"doc_id = {big + 1}").collect()}
    found = store.read(store.keys).collect()
    assert len(shards) > 1 and len(found) == len(rows)
    assert sorted(r.again for r in found if r.doc_id == big + 1) == list(range(400))
    assert {r.doc_id for r in found} == {i for i, _ in rows}
    assert sorted(r.start for r in found) == sorted(np.cumsum([0] + [r.n for r in sorted(found, key=lambda r: r.start)])[:-1].tolist())
    assert token_store.write(frame(spark, []), tokenizer(WORDS)).read(spark.createDataFrame([(1, 0)], "doc_id long, again long")).count() == 0


def test_words_remembered_equal_whole_texts():
    c = token_store.Coder(open(tokenizer(WORDS), encoding="utf-8").read())
    assert c.by_word and c.by_part
    texts = ["Don't  STOP\n\tnow", "a b c\x0bd", "é é \u0301x", "x" * 300 + " y", "<|endoftext|> <|startoftext|>a", " ", "", "\ufeff \u1e9e\u0130",
             "a\x00b\x1cc \x00 \x01", "\u0149 \ufb01n \u01f0 \u03a9\u0308 x", "End. END.) it's, don't!? <|ENDOFTEXT|> <|endoftext|>, \u00e9., x.y.z. 12,5% ''. a\x85b\xa0c\u2003d"]
    import pyarrow as pa

    want = [c.whole(t) for t in texts]
    assert c.ids(pa.array(texts)) == want == c.ids(pa.array(["before", *texts]).slice(1)) and c.ids(pa.array([], pa.string())) == []
    assert not token_store.Coder(open(tokenizer("byte_bpe_50k.json"), encoding="utf-8").read()).by_word


def test_perfect_hash_is_minimal_and_rejects_foreign_keys():
    rng = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 65, 5000):
        a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        sizes, bits, ranks = token_store.build(a, b)
        assert sorted(token_store.slots(a, b, sizes, bits, ranks).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        token_store.build(np.array([7, 7], np.uint64), np.array([9, 9], np.uint64))


# ------------------------------------------------------------------ 12

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, label string, n string").withColumnRenamed("label", "component")


def plain_whitened(rows):
    kept = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([v for _, v in kept])).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    e, vec = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, vec = e[::-1], vec[:, ::-1]
    white = (x - s / n) @ vec[:, :4] / np.sqrt(e[:4])
    return n, [(i, int(((n * r - s) ** 2).sum()), w) for (i, _), r, w in zip(kept, x, white)], e / e.sum()


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * [3, 2, 1.5, 1, 0.5, 0.1]).tolist()) for i in range(300)]
    rows += [(7, rows[0][1])] * 150 + [(None, rows[1][1]), (400, None), (401, [1.0] * 5 + [None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (405, [-0.0] * 6)]
    got = whitening.whiten(vectors(spark, [(i, v, "a", "b", "c") for i, v in rows])).toPandas()
    n, want, share = plain_whitened(rows)
    assert len(got) == 4 * len(want) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-12
    assert np.allclose(got.groupby("component")["explained"].first(), share[:4], rtol=1e-12)
    for k in range(1, 5):
        own = got[got["component"] == k]
        mine = sorted((v if v == v else -1, d, abs(w)) for v, d, w in zip(own["vec_id"], own["deviation"], own["whitened"]))
        theirs = sorted((-1 if i is None else i, d, abs(w[k - 1])) for i, d, w in want)
        assert [m[:2] for m in mine] == [t[:2] for t in theirs]
        assert np.allclose([m[2] for m in mine], [t[2] for t in theirs], rtol=1e-8, atol=1e-10)


def test_whitening_of_few_and_constant_rows(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [0.5, 0.25], "", "", ""), (2, [0.5, 0.25], "", "", "")])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, 0.0, 0.0)] * 4
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 1.0], "", "", "") for i in range(5)] + [(9, [1.0], "", "", "")])).toPandas()
    assert len(line) == 15 and line["identity_error"].max() < 1e-12 and (line[line["component"] > 1]["whitened"] == 0).all()


def test_refined_vectors_of_clustered_values():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0].astype(np.longdouble)
    for _ in range(6):  # orthogonal in extended precision
        q = q @ (3 * np.eye(40) - q.T @ q) / 2
    values = np.concatenate([[9, 9 - 1e-9, 9 - 2e-9, 5, 5, 5], np.linspace(1 + 1e-6, 1, 34)])
    lam, x = whitening.eigenvectors(q @ np.diag(values.astype(np.longdouble)) @ q.T)
    assert np.abs(lam - values).max() < 1e-14 and np.abs(x.T @ x - np.eye(40)).max() < 1e-15
    assert np.abs(np.abs((x.T @ q.astype(float)).diagonal())[:3] - 1).max() < 1e-15
    off = x.T @ q.astype(float)
    assert np.abs(off[:3, :3] - np.diag(off[:3, :3].diagonal())).max() < 1e-9  # gaps of 1e-9 are still resolved
    single = np.linalg.eigh((q @ np.diag(values) @ q.T).astype(np.float32))[1]
    assert np.abs(single[:, ::-1].T @ q.astype(float))[:3, :3].min() < 0.9  # the start does not tell them apart


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 30, 0], [0, 0]])
    assert whitening._deviations(x, 10, [1 << 30, 0], 1 << 30) == [None, 1 << 60]
    assert whitening._deviations(x, 2, [1 << 30, 0], 1 << 30) == [1 << 60, 1 << 60]


def test_products_beyond_doubles_are_exact():
    y = np.array([[1 << 39, 3], [-(1 << 39) + 1, 5]])
    assert whitening._products(y, 1 << 39).tolist() == (y.T.astype(object) @ y.astype(object)).tolist()


# ------------------------------------------------------------------ 13

def plain_clusters(rows, count=8, rounds=10, factor=1024, dims=64):
    kept = [(i, [int(np.floor(factor * c)) for c in v]) for i, v in rows if v and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    start = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)[:count]
    x, c = np.array([v for _, v in kept]), np.array([v for _, v in start])
    for turn in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        at = d.argmin(axis=1)
        if turn < rounds:
            c = np.array([x[at == k].sum(axis=0) // (at == k).sum() if (at == k).any() else c[k] for k in range(len(c))])
    best = d.min(axis=1)
    return sorted((-1 if i is None else i, int(k), int(b), int(best[at == k].sum()), int(best.sum()), hashlib.sha256(",".join(map(str, c[k].tolist())).encode()).hexdigest())
                  for (i, _), k, b in zip(kept, at, best))


def found(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("bits", [2, 8])
def test_clusters_of_odd_rows(spark, bits):
    rng = np.random.default_rng(bits)
    rows = [(i, rng.normal(i % 4, 1, 5).tolist()) for i in range(240)]
    rows += [(7, rows[0][1])] * 120 + [(None, rows[1][1]), (300, None), (301, [1.0] * 4), (302, [1.0] * 4 + [None]), (303, [float("nan")] * 5), (304, [-float("inf")] * 5), (305, [900.0] * 5), (306, [])]
    df = vectors(spark, [(i, v, "a", "b", "c") for i, v in rows])
    assert found(vafile.cluster(df, count=5, rounds=4, factor=16, dims=5, bits=bits)) == plain_clusters(rows, 5, 4, 16, 5)


def test_clusters_of_few_equal_and_no_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 5.0])]
    df = vectors(spark, [(i, v, "", "", "") for i, v in rows])
    assert found(vafile.cluster(df, dims=2)) == plain_clusters(rows, dims=2)
    assert vafile.cluster(df.where("false")).count() == 0 and vafile.cluster(df, dims=3).count() == 0


def test_cells_bound_every_distance():
    rng = np.random.default_rng(6)
    x = (rng.standard_t(2, size=(500, 7)) * 100).astype(np.int64)
    stats = [type("R", (), dict(n=500, low=c.min(), high=c.max(), total=int(c.sum()), squares=float((c * c).sum()))) for c in x.T]
    centroids = x[:6]
    for bits in range(1, 9):
        cells = vafile.Cells(stats, bits)
        own = cells.unpack(cells.pack(cells.of(x)))
        assert (own == cells.of(x)).all()
        mask = cells.candidates(own, cells.tables(centroids))
        d = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
        assert (mask >> d.argmin(axis=1) & 1).all()
        assert (vafile.nearest(x, centroids, mask)[0] == d.argmin(axis=1)).all()


def test_queries_cover_their_tables(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert found(op13(spark, SF)) == plain_clusters(rows)
    got = op12(spark, SF).toPandas()
    n, want, share = plain_whitened(rows)
    assert len(got) == 4 * len(want) and dict(zip(got["vec_id"], got["deviation"])) == {i: d for i, d, _ in want}
    one = got[got["component"] == 1].set_index("vec_id")["whitened"]
    assert np.allclose([abs(one[i]) for i, _, _ in want], [abs(w[0]) for _, _, w in want], rtol=1e-7, atol=1e-9)
