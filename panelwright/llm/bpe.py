"""Byte-pair encoding by speculation: propose greedily, verify pairs, merge only what fails.

A sequence of tokens is the encoding of a word exactly when no merge across a
boundary of two neighbours comes before the merges that made them.  So the
longest vocabulary entry is taken again and again, all adjacent pairs of a
batch are tested at once with array operations, and only words with a failing
pair go through the merges one by one.

Defined results: null text counts as empty and has no tokens; special-token
strings in a text become special ids; ties and repeated rows encode alike;
other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import record, slices, text_column

#: Words whose encoding one worker remembers.
REMEMBERED = 100_000
_NEVER = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next free one from U+0100."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Encoder:
    """One tokenizer file: normaliser, word pattern, vocabulary and merges."""

    def __init__(self, spec: str):
        conf = json.loads(spec)
        model = conf["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        self.by_byte = {b: c for b, c in enumerate(self.letters)}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marked = min((s[:2] for s in self.special), default="") if len({s[:2] for s in self.special}) == 1 else ""
        # Fixed value: the pattern in the tokenizer's file, with Unicode classes
        self.words = regex.compile(conf["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.size = max(self.names) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges: dict[tuple[str, str], int] = {p: r for r, p in reversed(list(enumerate(pairs)))}
        # arrays for the pair test: rank of a token's last merge, its two halves, and all merge pairs sorted by key
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        keys, ranks = [], []
        for (a, b), r in self.merges.items():
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            keys.append(x * self.size + y)
            ranks.append(r)
            if self.rank[z] < 0 or r < self.rank[z]:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        # a token may be proposed only if merging its own letters gives it back
        made = np.flatnonzero(self.rank >= 0)
        sound = np.ones(self.size, bool)
        sound[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for z in made[np.argsort(self.rank[made])]:
            sound[z] &= sound[self.left[z]] and sound[self.right[z]]
        self.proposable = {t: i for t, i in self.vocab.items() if sound[i]}
        # length of the longest entry that begins with given four letters; others have three at most
        self.reach: dict[str, int] = {}
        for t in self.proposable:
            if len(t) > 3:
                self.reach[t[:4]] = max(len(t), self.reach.get(t[:4], 0))
        self.digits = [str(i) for i in range(self.size)]
        self.inner = np.array([self.vocab.get(c, -1) for c in self.letters], np.int64)
        self.final = np.array([self.vocab.get(c + self.end, -1) for c in self.letters], np.int64)
        self.gaps = bool(min(self.inner.min(), self.final.min()) < 0)  # letters without an entry leave no token
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.memory: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.exact = 0

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether neighbours ``a, b`` stay two tokens: no merge across comes before those within.

        Both tokens are taken apart at the boundary, the later merge first;
        each state shows the pair that stood at the boundary before that
        merge.  Of equal merges the left one comes first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        limit = np.full(len(a), _NEVER) if limit is None else limit.astype(np.int64)
        open_ = np.arange(len(a))
        while len(open_):
            x, y, most = a[open_], b[open_], limit[open_]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merged = (self.pair_keys[at] == key) & (self.pair_ranks[at] < most)
            good[open_[merged]] = False
            rx, ry = self.rank[x], self.rank[y]
            on_left = rx > ry
            limit[open_] = np.where(on_left, rx, ry + 1)
            a[open_] = np.where(on_left, self.right[x], x)
            b[open_] = np.where(on_left, y, self.left[y])
            open_ = open_[~merged & (np.maximum(rx, ry) >= 0)]
        return good

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or never."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words side by side: in each round every word makes its
        lowest-ranked merge, at all its places from the left."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[flat]
        ends = np.cumsum(sizes)
        ids[ends - 1] = self.final[flat[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        ranks = np.full(len(ids), _NEVER)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inside] = self.ranks_of(ids[inside], ids[inside + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.r_[starts, len(ids)]))
            done = lowest == _NEVER
            if done.any():
                rest = np.flatnonzero(done)
                first = np.flatnonzero(np.r_[True, owner[rest][1:] != owner[rest][:-1]])
                flat_ids = ids[rest].tolist()
                for w, a, b in zip(owner[rest][first].tolist(), first.tolist(), [*first[1:].tolist(), len(rest)]):
                    out[w] = [t for t in flat_ids[a:b] if t >= 0]
                ids, owner, ranks, lowest = ids[~done], owner[~done], ranks[~done], lowest[~done]
                if not len(ids):
                    break
            hit = np.flatnonzero(ranks == lowest)
            # of touching hits (the same pair again and again) every second one stands
            run = np.cumsum(np.r_[True, np.diff(hit) != 1])
            head = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
            hit = hit[(np.arange(len(hit)) - head[run - 1]) % 2 == 0]
            ids[hit] = self.made[ranks[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            at = (np.cumsum(keep) - 1)[hit]
            ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
            for p in (at, at[at > 0] - 1):
                ranks[p] = _NEVER
                p = p[p + 1 < len(ids)]
                p = p[owner[p] == owner[p + 1]]
                ranks[p] = self.ranks_of(ids[p], ids[p + 1])
        return out

    def propose(self, word: str) -> list[int] | None:
        """Longest entries from the left; None where no entry fits."""
        whole, out, i = word + self.end, [], 0
        n, last, known, reach = len(whole), len(word), self.proposable, self.reach
        while i < n:
            j = i + max(reach.get(whole[i:i + 4], 3), len(self.end) + 1)
            if j >= n:  # the end mark belongs to the last letter
                t = known.get(whole[i:])
                if t is not None:
                    out.append(t)
                    break
                j = last
            for j in range(min(j, last), i, -1):
                t = known.get(whole[i:j])
                if t is not None:
                    break
            else:
                return None
            out.append(t)
            i = j
        return out

    def learn(self, words: list[str]) -> None:
        """Encode distinct words into the memory, all pairs of the batch tested together."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        found = [self.propose(r.decode("latin-1").translate(self.by_byte)) for r in raw]
        flat = np.fromiter((t for p in found if p for t in p), np.int64)
        owner = np.repeat(np.arange(len(found)), [len(p) if p else 0 for p in found])
        inner = owner[1:] == owner[:-1]
        bad = ~self.compatible(flat[:-1][inner], flat[1:][inner])
        failing = sorted({*owner[1:][inner][bad].tolist(), *(i for i, p in enumerate(found) if p is None)})
        self.exact += len(failing)
        for i, ids in zip(failing, self.merge([raw[i] for i in failing])):
            found[i] = ids
        names, digits, memory = self.names, self.digits, self.memory
        for w, ids in zip(words, found):
            memory[w] = (len(ids), " ".join([digits[t] for t in ids]), " ".join([names[t] for t in ids]))

    def normalise(self, text: str) -> str:
        """Composed and lower-cased; white space needs no rule, as no word holds any."""
        text = unicodedata.normalize("NFC", text)
        # lower-casing is per character: no final form of sigma
        return text.replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list:
        """Words of a text in order; special strings as one-tuples."""
        if self.split_special is None or self.marked not in text:
            return self.words.findall(self.normalise(text))
        out: list = []
        for i, part in enumerate(self.split_special.split(text)):
            out += [(part,)] if i % 2 else self.words.findall(self.normalise(part))
        return out

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, ids joined by spaces and decoded text of each text."""
        cut = [self.pieces(t) for t in texts]
        if len(self.memory) > REMEMBERED:  # words seen again move on from the older memory
            self.memory, self.older = {}, self.memory
        known, older = self.memory, self.older
        for name, i in self.special.items():
            known[(name,)] = (1, str(i), name)
        fresh = []
        for w in set().union(*cut):
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    fresh.append(w)
        for i in range(0, len(fresh), 20_000):
            self.learn(fresh[i:i + 20_000])
        out = []
        for ws in cut:
            found = [known[w] for w in ws]
            if self.gaps:
                found = [f for f in found if f[0]]
            sizes, digits, names = zip(*found) if found else ((), (), ())
            out.append((sum(sizes), " ".join(digits), " ".join(names)))
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encode_batch([text or ""])[0][1].split()]

    def decode(self, ids) -> str:
        return " ".join(self.names[i] for i in ids)


_ENCODERS: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The worker's encoder for a tokenizer file's content, built once."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def _spec(spark, path: str):
    """The tokenizer file, sent to each executor once (a file of fixed size)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every document."""
    spec = _spec(docs.sparkSession, path)

    def run(batches):
        e = encoder(spec.value)
        for b in slices(batches):
            found = e.encode_batch(b.column(1).to_pylist())
            yield record(_IDS, [b.column(0), [list(map(int, f[1].split())) for f in found], [f[2] for f in found]])

    return docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text, without carrying the ids."""
    spec = _spec(docs.sparkSession, path)

    def run(batches):
        e = encoder(spec.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in slices(batches):
            found = e.encode_batch(b.column(1).to_pylist())
            yield record(_DIGESTS, [b.column(0), [f[0] for f in found], [sha(f[1]) for f in found], [sha(f[2]) for f in found]])

    return docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
