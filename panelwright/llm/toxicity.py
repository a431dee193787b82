"""Toxicity by a weighted finite-state pattern grammar over clauses.

Tokens become labels: insult (weighted, learned words and stems), threat,
modal, target, negation, report, quotation mark.  Transducers (``wfst``) read
the labels of a clause one after the other: a modal makes a threat word a
threat; a target before or after an insult or threat makes it targeted; a
negation just before makes it negated; a verb of report before it or a
quotation around it makes it reported.  They are composed into one machine
whose last part weighs every match by its kind, and a clause counts by the
heaviest path through it.  A document's score is a logistic function of the
weights summed by kind along those paths, of its heaviest clause and of their
density, so negated and reported matches count as the labels say they do.

Insult terms come from labelled texts: words, and word beginnings that many
different words share, which stand in toxic texts far more often than in
others.  At most ``SAMPLE`` labelled rows are used and ``TERMS`` terms kept, the
best supported first; counting runs in Spark and
the driver sees terms with enough support and one row of sums per labelled text.

Defined results: null or empty texts get the score of a text without matches;
without labels of both kinds the grammar works with its own word list and
weights; labels that are null are left out; repeated rows score alike; other
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import wfst
from panelwright.llm.common import record, settle, slices

#: Labelled texts that a model is fitted on at most: those with the least hashes.
SAMPLE = 24_000
#: Least share of toxic texts, odds against clean ones and number of terms kept.
SUPPORT, ODDS, TERMS = 0.004, 8.0, 400
PREFIXES = range(4, 9)
KINDS = ("plain", "targeted", "threat", "negated", "reported")

# Closed word classes of the grammar, in the corpus languages.
SEEDS = set("idiot idiots moron morons loser losers scum trash stupid worthless pathetic disgusting clown clowns fool dumb imbecile".split())
THREATS = set("kill hurt destroy beat burn shoot stab strangle murder crush töten schlagen tuer frapper matar golpear".split())
MODALS = set("will shall gonna must should would werde werden vais va voy vamos".split())
TARGETS = set("you your yours yourself u he she they them him her those these people everyone du dich dir ihr euch tu toi vous te usted ustedes tú".split())
NEGATIONS = set("not never no isn aren wasn don nicht kein keine nie pas jamais aucun nunca jamás ningún".split())
REPORTS = set("said says say told wrote writes called calls quoted quotes claimed claims according sagte sagt schrieb dit disait écrit dijo dice escribió".split())

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;\n]+")
_TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]")
_QUOTES = frozenset("\"“”„«»")
#: Tokens over which each transducer reaches.
REACH = {"modal": 3, "target": 5, "target after": 2, "negation": 2, "report": 8}
#: Share of a match's weight by its kind, and weight of a threat word.
FACTORS = {"plain": 1.0, "targeted": 1.2, "threat": 1.2, "negated": 0.3, "reported": 0.3}
THREAT_WEIGHT = 0.5

# Labels: i insult, h threat word, m modal, t target, n negation, r report, q quotation mark, o any other.
# Marks are added to i and h: M by a modal, T by a target, N by a negation, R by a report or quotation.
_MATCHES = ["i", "hM"]


def kind_of(label: str) -> str | None:
    """Kind of a written label: what denies or reports it comes before what sharpens it."""
    if label[0] not in "ih" or label[0] == "h" and "M" not in label:
        return None
    return "negated" if "N" in label else "reported" if "R" in label else "threat" if label[0] == "h" else "targeted" if "T" in label else "plain"


def machines(quoted: bool = False) -> list[wfst.Machine]:
    """The grammar's transducers in the order of composition."""
    aimed = [x + t for x in _MATCHES for t in ("", "T")]
    denied = [x + n for x in aimed for n in ("", "N")]
    return [
        wfst.behind("m", ["h"], "M", REACH["modal"]),
        wfst.behind("t", _MATCHES, "T", REACH["target"]),
        wfst.ahead("t", _MATCHES, "T", REACH["target after"]),
        wfst.behind("n", aimed, "N", REACH["negation"]),
        wfst.behind("r", denied, "R", REACH["report"]),
        wfst.between("q", denied, "R", quoted),
        wfst.weigh(lambda label: FACTORS[k] if (k := kind_of(label)) else 0.0),
    ]


_DECODERS: dict[bool, wfst.Decoder] = {}


def decoder(quoted: bool) -> wfst.Decoder:
    """The composed grammar, for clauses that begin outside or inside a quotation."""
    if quoted not in _DECODERS:
        _DECODERS[quoted] = wfst.Decoder(reduce(wfst.compose, machines(quoted)))
    return _DECODERS[quoted]


@dataclass(frozen=True)
class Grammar:
    words: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray  # offset, one per kind, heaviest clause, matched weight per hundred words

    def insult(self, token: str) -> float:
        if token in self.words:
            return self.words[token]
        for n in PREFIXES:
            if len(token) < n:
                break
            if token[:n] in self.stems:
                return self.stems[token[:n]]
        return 0.0

    def label(self, token: str) -> tuple[str, float]:
        """Label of a token and the weight of a match on it."""
        if w := self.insult(token):
            return "i", w
        for label, words in (("h", THREATS), ("n", NEGATIONS), ("t", TARGETS), ("m", MODALS), ("r", REPORTS), ("q", _QUOTES)):
            if token in words:
                return label, THREAT_WEIGHT
        return "o", 0.0

    def clause(self, tokens: list[str], quoted: bool) -> list[tuple[str, float]]:
        """Kind and weight of the matches on the heaviest path through a clause, from left to right."""
        labels, weights = zip(*map(self.label, tokens)) if tokens else ((), ())
        if not {"i", "h"} & set(labels):
            return []
        found = decoder(quoted).best(labels, weights)
        return [(kind_of(written), weights[at]) for at, written in found[1]] if found else []

    def sums(self, text: str | None) -> np.ndarray:
        """Weight per kind of match, that of the heaviest clause, and matched weight per hundred words."""
        out = np.zeros(len(KINDS) + 2)
        low = (text or "").lower()
        words = _WORD.findall(low)
        seen = set(words)
        hits = {t for t in seen if t in THREATS or self.insult(t)}
        if not hits:
            return out
        depth = 0
        for part in _CLAUSE.split(low):
            tokens = _TOKEN.findall(part)
            marks = sum(t in _QUOTES for t in tokens)
            found = self.clause(tokens, bool(depth)) if not hits.isdisjoint(tokens) else []
            depth = (depth + marks) % 2
            for kind, w in found:
                out[KINDS.index(kind)] += w
            if found:
                out[-2] = max(out[-2], max(w * FACTORS[k] for k, w in found))
        out[-1] = 100 * out[:3].sum() / len(words)
        return out

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights @ _inputs(self.sums(text)), -30, 30))))


def _inputs(sums: np.ndarray) -> np.ndarray:
    sums = np.atleast_2d(sums)
    x = np.c_[np.ones(len(sums)), np.log1p(sums[:, :-2]), sums[:, -2], np.log1p(sums[:, -1])]
    return x[0] if len(x) == 1 else x


#: Weights before labels are seen: offset, plain, targeted, threat, negated, reported, heaviest clause, density.
PRIOR = np.array([-3.0, 2.0, 3.0, 3.0, 0.3, 0.5, 3.0, 1.0])


def terms(text: str | None) -> set[str]:
    """Words (marked by a final space) and word beginnings of a text."""
    words = set(_WORD.findall((text or "").lower()))
    return {w + " " for w in words if len(w) > 2} | {w[:n] for w in words for n in PREFIXES if len(w) > n}


_COUNTS = pa.schema([("term", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])


def _choose(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int) -> list[tuple[str, float]]:
    """Terms with their weights: of a word and its beginnings the most specific that loses no support."""
    least = max(3.0, SUPPORT * n_pos)
    good = {}
    for t, a in pos.items():
        odds = ((a + 0.5) / (n_pos + 1)) / ((neg.get(t, 0) + 0.5) / (n_neg + 1))
        if a >= least and odds >= ODDS:
            good[t] = np.log(odds)
    longer: dict[str, int] = {}
    for t in good:
        for n in range(PREFIXES[0], len(t)):
            longer[t[:n]] = max(longer.get(t[:n], 0), pos[t])
    out = []
    for t, w in good.items():
        stem = t.rstrip(" ")
        shorter = [t[:n] for n in PREFIXES if n < len(stem) + (t != stem) and t[:n] in good]
        if longer.get(t, 0) >= 0.98 * pos[t] or any(pos[s] > 1.2 * pos[t] and good[s] >= 0.8 * w for s in shorter):
            continue
        out.append((t, w * np.sqrt(pos[t]), w))
    out.sort(key=lambda x: (-x[1], x[0]))
    most = max((w for _, _, w in out), default=1.0)
    return [(t, float(w / most)) for t, _, w in out[:TERMS]]


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> Grammar:
    """Grammar from ``labels.toxic`` of the rows where ``train`` (over ``doc_id``) holds."""
    spark = docs.sparkSession
    own = labels.where(train & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    picked = own.orderBy(F.xxhash64("_id")).limit(sample)  # bounded, so it may be sent to every executor
    texts = settle(docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(picked), "_id").select("toxic", "text"), "training")
    size = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_pos, n_neg = size.get(1, 0), size.get(0, 0)
    base = Grammar({w: 0.7 for w in SEEDS}, {}, PRIOR)
    if not n_pos or not n_neg:
        return base

    def count(of, wanted=None):
        def run(batches):
            own: dict[str, int] = {}
            for b in slices(batches):
                for text in b.column(1).to_pylist():
                    for t in terms(text) if wanted is None else terms(text) & wanted.value:
                        own[t] = own.get(t, 0) + 1
            yield record(_COUNTS, [list(own), [of] * len(own), list(own.values())])

        return texts.where(F.col("toxic") == of).select("toxic", "text").mapInArrow(run, "term string, toxic int, n long").groupBy("term").agg(F.sum("n").alias("n"))

    pos = {r.term: r.n for r in count(1).where(F.col("n") >= max(3.0, SUPPORT * n_pos)).collect()}
    neg = {r.term: r.n for r in count(0, spark.sparkContext.broadcast(set(pos))).collect()}
    chosen = _choose(pos, neg, n_pos, n_neg)
    words = {w: 0.7 for w in SEEDS} | {t.rstrip(" "): w for t, w in chosen if t.endswith(" ")}
    stems = {t: w for t, w in chosen if not t.endswith(" ")}
    shared = spark.sparkContext.broadcast(Grammar(words, stems, PRIOR))
    schema = pa.schema([("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])

    def measure(batches):
        for b in slices(batches):
            yield record(schema, [b.column(0), [shared.value.sums(t).tolist() for t in b.column(1).to_pylist()]])

    seen = texts.select("toxic", "text").mapInArrow(measure, "toxic int, x array<double>").toPandas()
    x, y = _inputs(np.array(seen["x"].tolist()).reshape(len(seen), -1)).reshape(len(seen), -1), seen["toxic"].to_numpy(float)
    w, pull = PRIOR.copy(), np.r_[1e-3, np.full(len(PRIOR) - 1, 1.0)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull * (w - PRIOR)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
    return Grammar(words, stems, w)


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` with a last column ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # at most TERMS terms

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.select(F.struct("*").alias("row"), "text").select("row", scored("text").alias("score"))


def remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor
