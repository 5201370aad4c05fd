"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text (lengths, character classes, repetition, line shape) are binned at quantiles.
Boosting visits the features in turn, each time fitting a tree of at most three leaves to the gradient over
that feature's bins and adding it to the feature's lookup table; then it does the same for the pairs of
features whose joint bins explain most of what is left.  A score is the sigmoid of the added table entries.

The model is fitted on the driver on at most `max_rows` labelled rows, those of least hash; the bound is a
parameter, and only those rows are read for it.  Then every document is read once and scored by itself.

A null or empty text has all-zero features and a score like any other; without labels every score is 0.5.
Null labels and ids are not learnt from (a null id's fold is that of an empty text); of several labels of a doc_id the largest counts, and of rows that
share a doc_id each is learnt from and scored by its own text.  Features of very long texts are of the whole
text.  Ties of the hash go by doc_id.  Other columns are not read, whatever their names; `accepted` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import binary, lean

FEATURES = ("log_words", "word_length", "symbols", "exclaims", "upper", "digits", "punctuation", "beyond_ascii", "adjacent_repeats", "distinct_share", "repeated_lines", "line_words", "short_words", "long_words")
_CLASSES = np.zeros((256, 6))
for _k, _chars in enumerate((b"#*$%&|<>@{}[]~^=_+\\/", b"!", bytes(range(65, 91)), b"0123456789", b".,;:?'\"-()")):
    _CLASSES[list(_chars), _k] = 1
_CLASSES[128:, 5] = 1


def features(text: bytes | None) -> list[float]:
    t = text or b""
    words = t.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    sym, exc, upper, digit, punct, high = np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ _CLASSES
    size = np.fromiter(map(len, words), np.int64, n)
    chars = int(size.sum())
    lines = [x for x in t.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), chars / n, sym / n, exc / n, upper / chars, digit / chars, punct / n, high / chars,
        sum(map(eq, words, words[1:])) / n, len(set(words)) / n, 1 - len(set(lines)) / len(lines), n / len(lines),
        float((size <= 3).mean()), float((size > 12).mean()),
    ]


class AdditiveModel:
    """Lookup tables of binned features and of pairs of features."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, rounds: int = 150, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.15, least: int = 20):
        self.bins, self.pair_bins, self.rounds, self.pair_rounds, self.n_pairs, self.rate, self.least = bins, pair_bins, rounds, pair_rounds, pairs, rate, least

    @staticmethod
    def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
        q = np.linspace(0, 1, bins + 1)[1:-1]
        return [np.unique(np.quantile(c, q)) for c in x.T]

    @staticmethod
    def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="right") for c, v in zip(cuts, x.T, strict=True)], axis=1)

    def _gain(self, g, h):
        return g * g / (h + 1)

    def _split(self, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
        """(gain, cut) of the best division of bins; cut 0 if none leaves enough rows on both sides."""
        gl, hl, nl = (np.cumsum(v)[:-1] for v in (g, h, n))
        ok = (nl >= self.least) & (n.sum() - nl >= self.least)
        gain = np.where(ok, self._gain(gl, hl) + self._gain(g.sum() - gl, h.sum() - hl) - self._gain(g.sum(), h.sum()), 0)
        return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) and gain.max() > 1e-9 else (0.0, 0)

    def _tree(self, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Values of a tree of at most three leaves over the bins."""
        edges = [0, len(g)]
        for _ in range(2):
            best = max(((*self._split(g[a:b], h[a:b], n[a:b]), a) for a, b in pairwise(edges)), default=(0.0, 0, 0))
            if not best[1]:
                break
            edges = sorted([*edges, best[2] + best[1]])
        out = np.zeros(len(g))
        for a, b in pairwise(edges):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
        return out

    def _grid(self, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
        """(gain, values) of a tree that divides one axis, then each side along the other."""
        best = (0.0, np.zeros_like(g))
        for turn in (False, True):
            a, b, c = (x.T if turn else x for x in (g, h, n))
            for cut in range(1, a.shape[0]):
                out, gain = np.zeros_like(a), -self._gain(a.sum(), b.sum())
                for part in (slice(0, cut), slice(cut, None)):
                    ga, ha, na = a[part].sum(axis=0), b[part].sum(axis=0), c[part].sum(axis=0)
                    at = self._split(ga, ha, na)[1] or len(ga)
                    for cols in (slice(0, at), slice(at, None)):
                        x, y = ga[cols].sum(), ha[cols].sum()
                        out[part, cols] = x / (y + 1)
                        gain += self._gain(x, y)
                if gain > best[0]:
                    best = (gain, (out.T if turn else out).copy())
        return best

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        y = y.astype(float)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.base = float(np.log(rate / (1 - rate)))
        width = x.shape[1]
        self.cuts, self.coarse = (self._cuts(x, b) if len(y) else [np.zeros(0)] * width for b in (self.bins, self.pair_bins))
        fine, rough = self._binned(x, self.cuts), self._binned(x, self.coarse)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        f = np.full(len(y), self.base)
        for _ in range(self.rounds if len(y) else 0):
            for j in range(width):
                p = 1 / (1 + np.exp(-f))
                sums = [np.bincount(fine[:, j], weights=w, minlength=len(self.tables[j])) for w in (y - p, p * (1 - p), np.ones(len(y)))]
                step = self.rate * self._tree(*sums)
                self.tables[j] += step
                f += step[fine[:, j]]
        shape = lambda i, j: (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)

        def joint(i, j):
            p, (a, b) = 1 / (1 + np.exp(-f)), shape(i, j)
            at = rough[:, i] * b + rough[:, j]
            return at, [np.bincount(at, weights=w, minlength=a * b).reshape(a, b) for w in (y - p, p * (1 - p), np.ones(len(y)))]

        if len(y):
            found = sorted(((self._grid(*joint(i, j)[1])[0], i, j) for i in range(width) for j in range(i)), reverse=True)
            self.pairs = [(i, j) for gain, i, j in found[: self.n_pairs] if gain > 0]
        self.pair_tables = [np.zeros(shape(i, j)) for i, j in self.pairs]
        for _ in range(self.pair_rounds if self.pairs else 0):
            for k, (i, j) in enumerate(self.pairs):
                at, sums = joint(i, j)
                step = self.rate * self._grid(*sums)[1]
                self.pair_tables[k] += step
                f += step.reshape(-1)[at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        fine, rough = self._binned(x, self.cuts), self._binned(x, self.coarse)
        f = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            f += t[fine[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            f += t[rough[:, i], rough[:, j]]
        return 1 / (1 + np.exp(-f))


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is the empty text."""
    return F.expr(f"crc32(CAST(coalesce(CAST({doc_id} AS STRING), '') AS BINARY)) % {folds}")


class QualityClassifier:
    """score() of each document; label 1 is good.  Rows of fold `held_out` of `folds` are never learnt from."""

    def __init__(self, folds: int = 5, held_out: int = 0, threshold: float = 0.3, max_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality"):
        self.folds, self.held_out, self.threshold, self.max_rows = folds, held_out, threshold, max_rows
        self.doc_id, self.text, self.label = doc_id, text, label

    def fit(self, docs: DataFrame, labels: DataFrame) -> AdditiveModel:
        spark, folds = docs.sparkSession, self.folds
        known = labels.select(F.col(self.doc_id).cast("long").alias("doc_id"), F.col(self.label).cast("int").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL")
        known = known.where(fold("doc_id", folds) != self.held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
        here = docs.select(F.col(self.doc_id).cast("long").alias("doc_id"))
        some = known.join(here, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(self.max_rows)
        chosen = spark.sparkContext.broadcast({r.doc_id: r.y for r in some.collect()})  # max_rows rows at most

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                ids = b["doc_id"].to_pylist()
                rows = [i for i, d in enumerate(ids) if d in chosen.value]
                x = [features(t) for t in binary(b["text"].take(pa.array(rows, pa.int64())))]
                yield pa.record_batch({"doc_id": pa.array([ids[i] for i in rows], pa.int64()), "x": pa.array(x, pa.list_(pa.float64()))})

        two = docs.select(F.col(self.doc_id).cast("long").alias("doc_id"), F.col(self.text).cast("string").alias("text"))
        taken = spark.createDataFrame([(d,) for d in chosen.value], "doc_id long")
        two = two.join(F.broadcast(taken), "doc_id", "left_semi")  # other texts do not go to Python
        rows = sorted((r.doc_id, r.x) for r in two.mapInArrow(lean(run), "doc_id long, x array<double>").collect())
        x = np.array([r[1] for r in rows], np.float64).reshape(-1, len(FEATURES))
        return AdditiveModel().fit(x, np.array([chosen.value[r[0]] for r in rows], np.float64))

    def scored(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """(doc_id, held_out, score, predicted)."""
        model = docs.sparkSession.sparkContext.broadcast(self.fit(docs, labels))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                x = np.array([features(t) for t in binary(b["text"])], np.float64).reshape(-1, len(FEATURES))
                yield pa.record_batch({"doc_id": b["doc_id"], "score": pa.array(model.value.score(x))})

        two = docs.select(F.col(self.doc_id).cast("long").alias("doc_id"), F.col(self.text).cast("string").alias("text"))
        out = two.mapInArrow(lean(run), "doc_id long, score double")
        return out.select("doc_id", (fold("doc_id", self.folds) == self.held_out).alias("held_out"), "score", F.expr(f"CAST(score >= {self.threshold} AS INT)").alias("predicted"))

    def accepted(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows of docs that the model accepts, with all their columns."""
        model = docs.sparkSession.sparkContext.broadcast(self.fit(docs, labels))
        threshold, text = self.threshold, self.text

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                x = np.array([features(t) for t in binary(b[text])], np.float64).reshape(-1, len(FEATURES))
                yield b.filter(pa.array(model.value.score(x) >= threshold))

        return docs.mapInArrow(lean(run), docs.schema)
