"""Language identification by error-correcting output codes.

Every language has a codeword; one binary n-gram classifier per bit tells
languages with the bit from those without.  Decoding takes the codeword with
the least loss over all bits, each weighted by how well its classifier did on
the training texts, so that single wrong bits are outvoted.  A small lead over
the second codeword is flagged as ambiguous.

N-gram counts are gathered by Spark per language; the driver sees one bounded
table (languages x buckets) and one row of margins per training text, of which
there are at most ``SAMPLE``.

Defined results: null texts and texts without a letter (category L) are ``und`` with score
0; without training rows every text is ``und``; a single training language is
predicted with score 1; equal losses go to the first language by name;
repeated rows are predicted alike; other columns are not looked at; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import record, settle, slices

#: Labelled texts that a model is fitted on at most: those with the least hashes.
SAMPLE = 12_000
#: Buckets of hashed n-grams, orders in bytes, and lead in probability below which a text is ambiguous.
BUCKETS, ORDERS, LEAD = 1 << 15, (1, 2, 3, 4), 0.2
#: What lies between words: neither letters nor the marks that belong to them; number-like characters are no letters.
_GAPS, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def buckets(text: str | None) -> np.ndarray:
    """Bucket of every byte n-gram of the text's words, empty without letters."""
    words = _GAPS.sub(" ", (text or "").lower())
    if not _LETTER.search(words):
        return np.empty(0, np.int64)
    b = np.frombuffer(f" {words.strip()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    out = []
    for n in ORDERS:
        h = np.full(max(0, len(b) - n + 1), n, np.uint64)
        for i in range(n):
            h = h * np.uint64(263) + b[i:i + len(h)]
        out.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(BUCKETS))
    return np.concatenate(out).astype(np.int64)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """One row of bits per language: all splits up to six languages, else random columns kept for distance."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:  # every way to part the languages in two, the first always on one side
        cols = [[1] + [int(c >> k & 1) for k in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(cols, np.int8).T
    rng, width = np.random.default_rng(seed), int(np.ceil(8 * np.log2(n)))
    best, most = None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, width), dtype=np.int8)
        gap = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if gap > most and all(0 < c.sum() < n for c in code.T):
            best, most = code, gap
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray      # languages x bits
    weights: np.ndarray   # buckets x bits
    scale: np.ndarray     # bits: slope of a margin
    shift: np.ndarray     # bits: offset of a margin
    trust: np.ndarray     # bits: weight of its loss

    def margins(self, text: str | None) -> np.ndarray | None:
        idx = buckets(text)
        if not len(idx):
            return None
        total = np.zeros(self.weights.shape[1])
        for i in range(0, len(idx), 65_536):
            total += self.weights[idx[i:i + 65_536]].sum(axis=0, dtype=np.float64)
        return total / len(idx)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is ambiguous."""
        m = self.margins(text) if self.languages else None
        if m is None:
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        z = m * self.scale + self.shift
        loss = (np.logaddexp(0.0, -(2 * self.code - 1) * z) * self.trust).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        first, second = np.argsort(-p, kind="stable")[:2]
        return self.languages[first], float(p[first]), bool(p[first] - p[second] < LEAD)


_COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a regularised one-variable logistic regression."""
    spread = x.std() or 1.0
    u = np.c_[x / spread, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        g = u.T @ (p - y) + 1e-2 * w
        h = (u * (p * (1 - p))[:, None]).T @ u + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(h, g)
    return float(w[0] / spread), float(w[1])


def fit(docs: DataFrame, train: Column, sample: int = SAMPLE) -> Model:
    """Model from text and non-null lang of the rows where ``train`` holds, ``sample`` of them at most."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    picked = rows.select(F.xxhash64("doc_id").alias("_h")).orderBy("_h").limit(sample).agg(F.max("_h")).first()[0]
    if picked is None:
        return Model([], np.zeros((0, 1), np.int8), np.zeros((BUCKETS, 1)), np.ones(1), np.zeros(1), np.ones(1))
    texts = settle(rows.where(F.xxhash64("doc_id") <= picked).select(F.col("lang").cast("string").alias("lang"), "text"), "training")

    def count(batches):
        own: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.bincount(buckets(text), minlength=BUCKETS)
                own[lang] = own[lang] + c if lang in own else c
        for lang, c in own.items():
            at = np.flatnonzero(c)
            yield record(_COUNTS, [[lang] * len(at), at.astype(np.int32), c[at]])

    found = texts.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    table = np.zeros((len(languages), BUCKETS))
    for k, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        table[k, own["bucket"]] = own["n"]
    table /= np.maximum(1, table.sum(axis=1, keepdims=True))  # a language counts alike however many texts it has
    code = codewords(len(languages))
    side = lambda bit: (code.T == bit).astype(float)
    share = lambda s: (s @ table / np.maximum(1, s.sum(axis=1, keepdims=True)) + 0.1 / BUCKETS).T
    weights = np.log(share(side(1)) / share(side(0)))
    bits = code.shape[1]
    raw = Model(languages, code, weights, np.ones(bits), np.zeros(bits), np.ones(bits))
    if len(languages) == 1:
        return raw
    margins = pa.schema([("lang", pa.string()), ("m", pa.list_(pa.float64()))])
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def measure(batches):
        for b in slices(batches):
            got = [(lang, m) for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (m := shared.value.margins(text)) is not None]
            yield record(margins, [[g[0] for g in got], [g[1].tolist() for g in got]])

    seen = texts.mapInArrow(measure, "lang string, m array<double>").toPandas()
    x = np.array(seen["m"].tolist()).reshape(-1, bits)
    y = code[[languages.index(v) for v in seen["lang"]]]
    lines = [_logistic(x[:, b], y[:, b]) for b in range(bits)]
    scale, shift = np.array([w for w, _ in lines]), np.array([o for _, o in lines])
    right = (((x * scale + shift) > 0) == (y > 0)).mean(axis=0)
    trust = np.log(np.clip(right, 0.55, 0.999) / (1 - np.clip(right, 0.55, 0.999)))
    return Model(languages, code, weights.astype(np.float32), scale, shift, trust / trust.mean())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a last column ``found``: language, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x bits numbers, a fixed size

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def found(texts):
        import pandas as pd

        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score", "ambiguous"])

    return docs.select(F.struct("*").alias("row"), "text").select("row", found("text").alias("found"))


def remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor
