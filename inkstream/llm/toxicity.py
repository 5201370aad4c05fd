"""Toxicity: noisy-channel deobfuscation, then a score of the restored words.

A character trigram model is counted over all documents.  A token that may be disguised, with digits or
signs among letters, a letter three times in a row or single letters spelt out with spaces, is a lattice:
each sign may stand for a letter or for nothing, each repeated letter may be dropped.  The Viterbi path of
least cost, channel plus language model, restores it.  Letters spelt out and letters joined by signs may
hold several words, so they are also restored with the edge of a word allowed at each gap or sign.

The lexicon is learnt from the words of toxic rows, their beginnings, and beginnings that two or more
distinct words of a text share.  An entry is possible if unrelated rows would hold it by chance, at the rate of
toxic rows, with a probability below one in `certain`; of near copies one row counts.  Entries are taken one
after the other: the one that explains most toxic rows not yet explained, judged on the rows that hold no entry
taken before, as long as it is possible there as well; its weight is its smoothed precision there.  The other
possible entries stay with a lower weight: their precision on the rows without a taken entry, where their
overall precision, were `doubt` clean rows to hold them as well, counts as one row more.  A text's score is the noisy-or of the best entry of each of its words, over the share of toxic rows that no taken
entry explains.

Fitting reads at most `max_rows` labelled rows, those of least hash, a parameter, and all their entries that are
possible; the language model counts all rows.  Tokens of any length are decoded, in one pass of bounded states.
Null and empty texts hold no entry and have the base score; so does every text where there are no labels (0.5).
Very long texts are read whole.  Rows that share a doc_id are scored each by its own text and share the largest
of their labels; null labels and ids are not learnt from, and a null id's fold is that of an empty text.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import binary, lean, lean_group, staged, tidy
from .quality_classifier import fold

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_N = 28  # a word's edge, 26 letters, any other letter
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "µ": "u"}
_SIGNS = "".join(re.escape(c) for c in LEET)
_NOISE = r".\-_*~'^·•"
_DISGUISED = re.compile(rf"[^\W\d_][{_SIGNS}{_NOISE}]+[^\W\d_]|[{_SIGNS}][^\W\d_]|[^\W\d_][{_SIGNS}]|([^\W\d_])\1\1", re.UNICODE)
_SPELT = re.compile(rf"(?<!\S)(?:[^\s{_NOISE}][ \t{_NOISE}]+){{2,}}[^\s{_NOISE}][.,;:!?]*(?!\S)")
_JOINT = re.compile(rf"[^\w{_SIGNS}]+|_+")
_GAP = re.compile(rf"[ \t{_NOISE}]+")
_EDGE = ".,;:?\"'()[]{}<>#%&=-_*~/\\"
_BARE = re.compile(r"^[\W_]+|[\W_]+$")
_CODE = np.full(256, 27, np.int64)
_CODE[[9, 10, 11, 12, 13, 32]] = 0
for _i, _c in enumerate(_LETTERS):
    _CODE[[ord(_c), ord(_c.upper())]] = _i + 1
#: Lengths of word beginnings that may be lexicon entries.
STARTS = range(4, 10)
_MAX = 32  # longer tokens are decoded as well but not remembered
#: Inside a token to decode, a gap that may be the edge of a word and one that most likely is.
_MAYBE, _WIDE = "\x00", "\x01"


def count_trigrams(texts: list[bytes | None]) -> np.ndarray:
    """Trigram counts over letters, with the edge of words as one symbol."""
    out = np.zeros(_N**3, np.int64)
    for t in texts:
        if t:
            c = _CODE[np.frombuffer(b" " + t + b" ", np.uint8)]
            out += np.bincount(c[:-2] * _N * _N + c[1:-1] * _N + c[2:], minlength=_N**3) if len(c) > _N**3 // 4 else 0
            if len(c) <= _N**3 // 4:
                np.add.at(out, c[:-2] * _N * _N + c[1:-1] * _N + c[2:], 1)
    return out


def costs(counts: np.ndarray) -> list[list[list[float]]]:
    """-log p(c | a, b), backed off to the bigram."""
    tri = counts.reshape(_N, _N, _N).astype(float)
    bi = tri.sum(axis=0) + 0.1
    bi /= bi.sum(axis=1, keepdims=True)
    p = (tri + 8 * bi[None]) / (tri.sum(axis=2, keepdims=True) + 8)
    return (-np.log(p)).tolist()


def _code(c: str) -> int:
    i = _LETTERS.find(c)
    if i >= 0:
        return i + 1
    base = unicodedata.normalize("NFD", c)[0]
    i = _LETTERS.find(base)
    return i + 1 if i >= 0 else 27


class Deobfuscator:
    """Restores disguised tokens; decoded ones are remembered up to a bound."""

    #: Channel costs: a sign read as a letter, dropped; noise dropped; the second of two equal letters kept,
    #: dropped; a further one kept, dropped; a sign or a wide gap that is no edge of a word.
    READ, DROP, NOISE, TWICE, ONCE, MORE, LESS, JOIN = 0.4, 5.0, 0.2, 0.2, 1.5, 6.0, 0.1, 4.0
    #: Costs of an edge that is put in, one decoding for each.
    EDGES = (0.0, -1.5, 1.5)

    def __init__(self, model: list[list[list[float]]]):
        self.model, self.known = model, {}

    def decode(self, token: str, edge: float | None = None) -> str:
        """The token restored as one word or, with a cost for an edge, as words joined by a space."""
        if len(token) > _MAX:
            return self._viterbi(token, edge)
        if (got := self.known.get((token, edge))) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[token, edge] = self._viterbi(token, edge)
        return got

    def words(self, token: str) -> set[str]:
        return {w for e in self.EDGES for w in self.decode(token, e).split()}

    def _viterbi(self, token: str, edge: float | None = None) -> str:
        """In one pass; each path is a chain of (chain before, letter), so a token may have any length."""
        lm = self.model
        paths: dict = {(0, 0, ""): (0.0, None)}  # last two codes and the last letter put out -> cost, chain
        for i, c in enumerate(token):
            arcs: list[tuple[str, float]]
            if c in LEET:
                arcs = [(x, self.READ) for x in LEET[c]] + [("", self.DROP)]
                if edge is not None and not c.isalnum():
                    arcs.append((" ", self.READ + edge))
            elif c.isalpha():
                arcs = [(c, 0.0)]
                if i and token[i - 1] == c:
                    more = i > 1 and token[i - 2] == c
                    arcs = [(c, self.MORE if more else self.TWICE), ("", self.LESS if more else self.ONCE)]
            elif c == _MAYBE:
                arcs = [("", 0.0), (" ", edge or 0.0)]
            elif c == _WIDE:
                arcs = [("", self.JOIN), (" ", 0.0)]
            else:
                arcs = [("", self.NOISE)] + ([(" ", self.NOISE + edge)] if edge is not None else [])
            step: dict = {}
            for (a, b, last), (cost, chain) in paths.items():
                for out, price in arcs:
                    if not out or (out == " " and not b):
                        key, new = (a, b, last), (cost + price, chain)
                    else:
                        k = 0 if out == " " else _code(out)
                        key, new = (b, k, out), (cost + price + lm[a][b][k], (chain, out))
                    if key not in step or new[0] < step[key][0]:
                        step[key] = new
            paths = step
        _, chain = min(((cost + lm[a][b][0], chain) for (a, b, _), (cost, chain) in paths.items()), key=lambda x: x[0])
        letters = []
        while chain:
            chain, out = chain
            letters.append(out)
        return "".join(reversed(letters))

    def restored(self, text: str) -> set[str]:
        """The distinct words of the text in lower case, disguised ones restored as well."""
        low = text.lower()
        words = set()
        for w in set(low.split()):
            words.add(_BARE.sub("", w) if not w.isalnum() else w)
            if not w.isalpha() or _tripled(w):
                core = w.strip(_EDGE)
                if len(core) >= 3 and _DISGUISED.search(core):
                    words.add(self.decode(core))
                    if not core.isalnum():
                        words |= self.words(core) | {self.decode(x) for x in _JOINT.split(core) if len(x) >= 3}
        if " " in low:
            for m in _SPELT.finditer(low):
                run = m.group().rstrip(".,;:!?")
                spelt = _GAP.sub("", run)  # a one-letter word may stand at either end
                words |= {self.decode(x) for x in (spelt, spelt[1:], spelt[:-1])} | self.words(_edged(run))
        words.discard("")
        return words


def _edged(run: str) -> str:
    """The letters of a spelt run, with the gaps between them; those above the most frequent width are wide."""
    gaps = [(len(g.split(" ")) - 1 + g.count("\t"), len(g)) for g in _GAP.findall(run)]
    usual = max(sorted(set(gaps)), key=gaps.count)
    return "".join(c + (_WIDE if g > usual else _MAYBE) for c, g in zip(_GAP.split(run), [*gaps, usual], strict=True))[:-1]


def _tripled(w: str) -> bool:
    return any(w[i] == w[i + 1] == w[i + 2] for i in range(len(w) - 2))


def entries(words: set[str]) -> set[str]:
    """Words and their beginnings of four to nine letters, with a star; with two where two words have them."""
    begun = Counter(w[:n] for w in words for n in STARTS if len(w) > n)
    return words | {w + "*" for w in begun} | {w + "**" for w, k in begun.items() if k > 1}


def evidence(bad: np.ndarray, good: np.ndarray, rate: float) -> np.ndarray:
    """-log of a bound on the chance that so many of the rows are toxic, where toxic rows come at that rate; 0 below it."""
    n = np.maximum(bad + good, 1)
    p = np.clip(bad / n, 1e-12, 1 - 1e-12)
    return np.where(p > rate, n * (p * np.log(p / rate) + (1 - p) * np.log((1 - p) / (1 - rate))), 0.0)


class Toxicity:
    def __init__(self, folds: int = 3, held_out: int = 1, threshold: float = 0.7, max_rows: int = 20_000, purity: float = 0.85, certain: float = 1e6, doubt: float = 10.0, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"):
        self.folds, self.held_out, self.threshold, self.max_rows = folds, held_out, threshold, max_rows
        self.purity, self.certain, self.doubt = purity, certain, doubt
        self.doc_id, self.text, self.label = doc_id, text, label

    def _language_model(self, docs: DataFrame) -> list[list[list[float]]]:
        """Trigrams of all documents: 21,952 numbers reach the driver, whatever the input."""

        def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(_N**3, np.int64)
            for b in it:
                total += count_trigrams(binary(b["text"]))
            yield pa.record_batch({"first": pa.array(range(_N), pa.int64()), "seen": pa.array([x.tobytes() for x in total.reshape(_N, -1)], pa.binary())})

        def add(t: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(x, np.int64) for x in t["seen"].to_pylist()], axis=0)
            return pa.table({"first": t["first"][:1], "seen": pa.array([total.tobytes()], pa.binary())})

        counts = np.zeros((_N, _N * _N), np.int64)
        for r in docs.select("text").mapInArrow(lean(count), "first long, seen binary").groupBy("first").applyInArrow(lean_group(add), "first long, seen binary").collect():
            counts[r["first"]] = np.frombuffer(bytes(r["seen"]), np.int64)
        return costs(counts.reshape(-1))

    def fit(self, docs: DataFrame, labels: DataFrame, model) -> tuple[dict[str, float], float]:
        """(precision of each lexicon entry, base score).  At most max_rows rows and their entries reach the driver."""
        spark = docs.sparkSession
        known = labels.select(F.col(self.doc_id).cast("long").alias("doc_id"), F.col(self.label).cast("int").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL")
        known = known.where(fold("doc_id", self.folds) != self.held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
        sample = {r.doc_id: r.y for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(self.max_rows).collect()}
        taken = spark.createDataFrame([(d,) for d in sample], "doc_id long")
        docs = staged(docs.join(F.broadcast(taken), "doc_id", "left_semi"))  # other texts do not go to Python

        def kin(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The word of least hash, on which near copies mostly agree."""
            for b in it:
                rows = [(d, min(crc32(w) for w in t.split())) for d, t in zip(b["doc_id"].to_pylist(), binary(b["text"]), strict=True) if d in chosen.value and t and t.split()]
                yield pa.record_batch({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "kin": pa.array([r[1] for r in rows], pa.int64())})

        chosen = spark.sparkContext.broadcast(sample)  # max_rows rows at most
        first: dict[tuple[int, int], int] = {}
        for r in docs.mapInArrow(lean(kin), "doc_id long, kin long").collect():
            key = (r.kin, sample[r.doc_id])
            first[key] = min(first.get(key, r.doc_id), r.doc_id)
        rows = {d: y for (_, y), d in first.items()}
        toxic, clean = sum(y == 1 for y in rows.values()), sum(y != 1 for y in rows.values())
        if not toxic or not clean:
            return {}, 0.5
        rate = toxic / (toxic + clean)
        chosen = spark.sparkContext.broadcast(rows)

        def spread(wanted, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = Deobfuscator(model.value)
            for b in it:
                for doc, text in zip(b["doc_id"].to_pylist(), binary(b["text"]), strict=True):
                    if doc in chosen.value and text:
                        e = entries(d.restored(text.decode()))
                        e = sorted(e if wanted is None else e & wanted.value.keys())
                        yield pa.record_batch({"doc_id": pa.array([doc] * len(e), pa.int64()), "y": pa.array([chosen.value[doc]] * len(e), pa.int32()), "entry": pa.array(e, pa.string())})

        kind, sure = "doc_id long, y int, entry string", math.log(self.certain)
        least = sure / -math.log(rate)  # so many toxic rows at least, were all rows of the entry toxic
        counts = docs.mapInArrow(lean(lambda it: spread(None, it)), kind).groupBy("entry").agg(F.sum("y").alias("bad"), F.count("*").alias("all")).where(f"bad >= {least} AND bad >= {self.purity} * all").collect()
        seen = np.array([(r.bad, r["all"] - r.bad) for r in counts], float).reshape(-1, 2)
        possible = evidence(seen[:, 0], seen[:, 1], rate) >= sure
        rest = {r.entry: r.bad / (r["all"] + self.doubt) for r, ok in zip(counts, possible.tolist(), strict=True) if ok}
        names = sorted(rest, key=lambda e: (e.endswith("*") + e.endswith("**"), -len(e), e))
        if not names:
            return {}, min(0.5, (toxic + 0.5) / (toxic + clean + 1.0))
        wanted = spark.sparkContext.broadcast({e: i for i, e in enumerate(names)})
        found = docs.mapInArrow(lean(lambda it: spread(wanted, it)), kind).groupBy("doc_id", "y").agg(F.collect_set("entry").alias("e")).collect()
        at = {e: i for i, e in enumerate(names)}
        row = np.repeat(np.arange(len(found)), [len(r.e) for r in found])
        entry = np.array([at[e] for r in found for e in r.e], np.int64)
        bad = np.array([r.y == 1 for r in found])
        lexicon, alive = {}, np.ones(len(found), bool)
        while (alive & bad).any():
            b, g = (np.bincount(entry[(alive & k)[row]], minlength=len(names)) for k in (bad, ~bad))
            left = [toxic - int((~alive & bad).sum()), clean - int((~alive & ~bad).sum())]
            ok = (evidence(b, g, max(left[0], 1) / max(sum(left), 2)) >= math.log(10 * len(names))) & (b >= self.purity * (b + g))
            if not ok.any():
                break
            best = int(np.where(ok, b, -1).argmax())
            lexicon[names[best]] = (int(b[best]) + 0.5) / (int(b[best] + g[best]) + 1.0)
            alive[row[entry == best]] = False
        gone = [int((~alive & k).sum()) for k in (bad, ~bad)]
        b, g = (np.bincount(entry[(alive & k)[row]], minlength=len(names)) for k in (bad, ~bad))
        rest = {e: (int(b[i]) + rest[e]) / (int(b[i] + g[i]) + 1.0) for i, e in enumerate(names)}
        return rest | lexicon, min(0.5, (toxic - gone[0] + 0.5) / (toxic + clean - sum(gone) + 1.0))

    @tidy
    def scored(self, documents: DataFrame, labels: DataFrame) -> DataFrame:
        """(doc_id, held_out, score, predicted, found): found lists the lexicon entries."""
        sc = documents.sparkSession.sparkContext
        docs = documents.select(F.col(self.doc_id).cast("long").alias("doc_id"), F.col(self.text).cast("string").alias("text"))
        model = sc.broadcast(self._language_model(docs))
        fitted = sc.broadcast(self.fit(docs, labels, model))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d, (lexicon, base) = Deobfuscator(model.value), fitted.value
            heads = {e.rstrip("*")[: STARTS[0]] for e in lexicon}  # what a word must begin with to count
            for b in it:
                score, found = [], []
                for text in binary(b["text"]):
                    words = [w for w in d.restored(text.decode()) if w[: STARTS[0]] in heads] if text else []
                    best: dict[str, tuple[float, str]] = {}  # of each word, and of the words that begin alike
                    begun: Counter = Counter()
                    for w in words:
                        for e in (w, *(w[:n] + "*" for n in STARTS if n < len(w))):
                            if e in lexicon:
                                best[w] = max(best.get(w, (0.0, "")), (lexicon[e], e))
                            if e + "*" in lexicon:
                                begun[e + "*"] += 1
                    for e, k in begun.items():
                        if k > 1:
                            best[e[: STARTS[0]] + "**"] = max(best.get(e[: STARTS[0]] + "**", (0.0, "")), (lexicon[e], e))
                    rest = 1 - base
                    for weight, _ in sorted(best.values()):
                        rest *= 1 - weight
                    score.append(1 - rest)
                    found.append(sorted({e for _, e in best.values()}))
                yield pa.record_batch({"doc_id": b["doc_id"], "score": pa.array(score, pa.float64()), "found": pa.array(found, pa.list_(pa.string()))})

        out = docs.mapInArrow(lean(run), "doc_id long, score double, found array<string>")
        return out.select("doc_id", (fold("doc_id", self.folds) == self.held_out).alias("held_out"), "score", F.expr(f"CAST(score >= {self.threshold} AS INT)").alias("predicted"), "found")
