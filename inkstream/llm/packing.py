"""Packing: bounded-space online best-fit packing of token streams.

Each partition keeps a fixed number of open windows of `size` tokens.  A document first fills whole
sequences by itself; its rest goes to the open window with the least room that holds it, or opens one more
while fewer than `open_windows` are open.  When none fits, the fullest is topped up from the front of the
piece and emitted full, and what is left of the piece opens a window in its place.  So every sequence that
leaves is full.  What is still open at the end of each partition is laid end to end over all partitions and
cut at multiples of `size`: only the last sequence of all is not full.

A null text is an empty one; each document has its end token, so none is without a piece.  Rows that share a
doc_id, repeated rows among them, are documents of their own.  Very long texts fill whole sequences.  Of windows
with equal room the older one is taken.  An empty table gives no pieces; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import binary, lean, staged
from .words import batches

#: Sequence ids of merged leftovers start here; before it they are partition << 32 | number.
MERGED = 1 << 62
#: Words that a tokenizer remembers, and those that stay when there are too many and between tasks: the first met, mostly
#: the common ones.
_CACHE, _KEPT = 400_000, 150_000


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)} | {32: " "}


_BYTES = _byte_alphabet()


class _Places(dict):
    """Where a word's ids begin; -1 for a word that is not known."""

    def __missing__(self, word: bytes) -> int:
        return -1


class WordTokenizer:
    """A tokenizer of lower case whose pre-tokens never cross white space, run once for each distinct word.

    `ids(texts)` equals encoding each text without added special tokens, plus the end id."""

    #: A pre-token of its own that stands between words given to the tokenizer at once.
    _MARK = "\x01"
    #: A full stop or comma after a letter or digit and before white space is a pre-token of its own.
    _STOP = re.compile(rb"([.,])(?=[ \n]|$)(?<=[a-z0-9][.,])")

    _SIMPLE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)  # without offsets where it can
        # Words of lower-case letters of these ranges pass the normaliser and the pre-tokenizer unchanged, but for
        # the byte alphabet; they go to the model directly.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.mark = self.tokenizer.encode(self._MARK, add_special_tokens=False).ids
        if len(self.mark) != 1:
            raise ValueError("the mark must be one token")
        self.place = _Places()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.cut = np.zeros(1, np.int64)

    def forget(self) -> None:
        """All words but the first."""
        self.place = _Places(islice(self.place.items(), _KEPT))
        self.cut = self.cut[: len(self.place) + 1].copy()
        self.flat = self.flat[: int(self.cut[-1])].copy()

    def _learn(self, words: list[bytes]) -> None:
        simple = [w for w in words if self._SIMPLE(w)]
        if simple:
            text = b" ".join(simple).decode("latin-1").translate(_BYTES).replace(" ", f" {_BYTES[1]} ") + f" {_BYTES[1]}"
            self._add(simple, np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
            known = set(simple)
            words = [w for w in words if w not in known]
        plain = [w for w in words if b"\x01" not in w and b"<|" not in w]
        ids = np.array(self.encode([f" {self._MARK} ".join([b" ".join(plain).decode().replace(" ", f" {self._MARK} "), ""])] if plain else [""], add_special_tokens=False)[0].ids, np.uint32)
        self._add(plain, ids if plain else ids[:0])
        for w in words:
            if b"\x01" in w or b"<|" in w:
                self._add([w], np.append(np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, np.uint32), np.uint32(self.mark[0])), whole=True)

    def _add(self, words: list[bytes], ids: np.ndarray, whole: bool = False) -> None:
        """Words whose ids follow each other, each with the mark after it; whole: one word that may hold the mark."""
        ends = np.array([len(ids) - 1]) if whole else np.flatnonzero(ids == self.mark[0])
        sizes = np.diff(np.concatenate([[-1], ends])) - 1
        new = ids[:-1] if whole else ids[ids != self.mark[0]]
        used = int(self.cut[-1])
        if used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(new)), np.uint32)])
        self.flat[used : used + len(new)] = new
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.cut = np.concatenate([self.cut, used + np.cumsum(sizes)])

    def _codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def ids(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        for _, part in batches(texts):
            words, count = [], []
            for t in part:
                if b"<|" not in t:  # letter case matters to special tokens only
                    t = self._STOP.sub(rb" \1", t.lower())
                w = t.split()
                words += w
                count.append(len(w))
            at = self._codes(words)
            if (at < 0).any():
                new = list({words[i] for i in np.flatnonzero(at < 0).tolist()})
                if len(self.place) + len(new) > _CACHE:
                    self.forget()
                    at[at >= len(self.place)] = -1
                    new = list({words[i] for i in np.flatnonzero(at < 0).tolist()})
                self._learn(new)
                todo = np.flatnonzero(at < 0)
                at[todo] = self._codes([words[i] for i in todo.tolist()])
            n = self.cut[at + 1] - self.cut[at]
            ends = np.cumsum(n)
            out = self.flat[np.repeat(self.cut[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
            cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
            for a, b in pairwise(cut.tolist()):
                yield np.append(out[a:b], np.uint32(self.end))


#: The tokenizer of this process with the words that it has learnt; one task of a worker hands it to the next.
_ready: dict[tuple[str, int], WordTokenizer] = {}


def _tokenizer(path: str, end: int) -> WordTokenizer:
    if (path, end) not in _ready:
        _ready.clear()
        _ready[path, end] = WordTokenizer(path, end)
    return _ready[path, end]


class _Packer:
    def __init__(self, size: int, limit: int, part: int):
        self.size, self.limit, self.next = size, limit, part << 32
        self.room: list[tuple[int, int]] = []  # sorted (room, window)
        self.held: dict[int, list[list]] = {}
        self.out: list[list] = []

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc, ids: np.ndarray) -> None:
        n, a, size = len(ids), 0, self.size
        piece = lambda lo, hi: [doc, lo, hi - lo, ids[lo:hi].tobytes(), n]
        while n - a >= size:
            self.out.append([*piece(a, a + size), self._new(), 0, None])
            a += size
        if a == n:
            return
        k = bisect_left(self.room, (n - a, -1))
        if k < len(self.room):
            room, w = self.room.pop(k)
        elif len(self.room) < self.limit:
            room, w = size, self._new()
            self.held[w] = []
        else:
            room, w = self.room.pop(0)
            self.held[w].append([*piece(a, a + room), w, size - room, None])
            self.out += self.held.pop(w)
            a += room
            room, w = size, self._new()
            self.held[w] = []
        self.held[w].append([*piece(a, n), w, size - room, None])
        if room == n - a:
            self.out += self.held.pop(w)
        else:
            insort(self.room, (room - (n - a), w))

    def close(self) -> None:
        spot = 0
        for _, w in self.room:
            for x in self.held[w]:
                x[7] = spot
                spot += x[2]
                self.out.append(x)
        self.room, self.held = [], {}


class Packing:
    """Pieces of token ids in sequences of `size`."""

    def __init__(self, tokenizer_path: str, end: int = 2, size: int = 4096, open_windows: int = 32, doc_id: str = "doc_id", text: str = "text"):
        self.path, self.end, self.size, self.open_windows, self.doc_id, self.text = tokenizer_path, end, size, open_windows, doc_id, text

    _KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    _NAMES = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "spot")

    def _packed(self, docs: DataFrame) -> DataFrame:
        path, end, size, limit, names, kinds = self.path, self.end, self.size, self.open_windows, self._NAMES, self._KINDS

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = _tokenizer(path, end)
            part = TaskContext.get().partitionId()
            packer = _Packer(size, limit, part)

            def rows():
                cols = zip(*packer.out, strict=True) if packer.out else [[] for _ in names]
                b = {c: pa.array(v, k) for c, v, k in zip(names, cols, kinds, strict=True)}
                n, packer.out = len(packer.out), []
                return pa.record_batch(b | {"part": pa.array([part] * n, pa.int64())})

            for b in it:
                held = 0
                for doc, ids in zip(b["doc_id"].to_pylist(), tokens.ids(binary(b["text"])), strict=True):
                    packer.add(doc, ids)
                    held += len(ids)
                    if held > 2_000_000:
                        yield rows()
                        held = 0
                yield rows()
            packer.close()
            yield rows()
            tokens.forget()

        two = docs.select(F.col(self.doc_id).cast("long").alias("doc_id"), F.col(self.text).cast("string").alias("text"))
        return two.mapInArrow(lean(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, spot long, part long")

    def pack(self, docs: DataFrame) -> DataFrame:
        """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) per piece; ids are little-endian 32-bit."""
        size = self.size
        done = staged(self._packed(docs))
        left = done.where("spot IS NOT NULL")
        w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        base = left.groupBy("part").agg(F.sum("length").alias("n")).select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))  # a row per input partition
        laid = left.join(base, "part").withColumn("at", F.expr("base + spot"))
        laid = laid.withColumn("q", F.explode(F.expr(f"sequence(at div {size}, (at + length - 1) div {size})"))).withColumn("lo", F.expr(f"greatest(at, q * {size})"))
        merged = laid.select(
            "doc_id",
            F.expr("start + lo - at").alias("start"),
            F.expr(f"least(at + length, (q + 1) * {size}) - lo").alias("length"),
            F.expr(f"substring(ids, CAST(1 + 4 * (lo - at) AS INT), CAST(4 * (least(at + length, (q + 1) * {size}) - lo) AS INT))").alias("ids"),
            "doc_tokens",
            F.expr(f"{MERGED} + q").alias("sequence_id"),
            F.expr(f"lo - q * {size}").alias("offset"),
        )
        return done.where("spot IS NULL").select(*merged.columns).unionByName(merged)
