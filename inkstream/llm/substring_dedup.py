"""Substring dedup: repeated-phrase automata.

A window is `size` consecutive words of one document.  Every word that lies in a window whose words also
start earlier (a smaller doc_id, or earlier in the same document) is removed; windows are judged on the
input.  Null and empty texts have no words; rows that share a doc_id are one document, so neither precedes the
other, and each repeated row is cut alike.  A row without an id precedes nothing and loses nothing.  Very long texts are streamed whole.  An empty table gives no rows.
Columns to keep may have any names, those of the result and of this module's own tables included: a kept column
of a result's name takes its place.

1. Anchors.  Of the 5-word grams of each window the one of least hash is its anchor; equal windows have
   equal anchors.  Anchors are dealt out by hash, each distinct one once a partition, and those that occur
   twice are told to their documents.
2. Candidate passages: the runs of windows with a recurring anchor, cut from the documents.
3. Confirmation.  The windows of the passages, again one a partition, are counted by two hashes of 64 bits;
   each that occurs twice gets its first place, and is told to the shards of documents that hold it.
4. Shards of documents.  The first places are cut into phrases, maximal runs of such windows, and sent to
   the shards.  A shard compiles its phrases' anchors into Aho-Corasick automata, with words as symbols,
   and streams every whole document through them; each hit is extended word by word, so only exactly equal
   passages count.

Nothing is collected to the driver, and a passage in a third of all documents costs a row per partition
and shard.  Shards and buckets are as many as the measured bytes of the texts ask for, each a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import binary, buckets, dealt, groups, lean, lean_group, lean_pair, staged, text_bytes, tidy
from .words import OTHER_STEP, U, Words, batches, minimizers, runs, windows

GRAM = 5
#: Words of one automaton's phrases, about; codes of three digits reach twice as far.
_SYMBOLS = 1_000_000
_FLUSH = 400_000


def _blobs(names: tuple[str, ...], to: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
    rows = [[b, *(c[at].tobytes() for c in cols)] for b, at in groups(to)]
    data = list(zip(*rows, strict=True)) or [[] for _ in range(len(cols) + 1)]
    return pa.record_batch({c: pa.array(v, pa.int64() if c == "bucket" else pa.binary()) for c, v in zip(("bucket", *names), data, strict=True)})


def _column(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in t[name].to_pylist()), kind)


class SubstringDedup:
    def __init__(self, size: int = 20, doc_id: str = "doc_id", text: str = "text"):
        if size <= GRAM:
            raise ValueError(f"windows of more than {GRAM} words are needed")
        self.size, self.doc_id, self.text = size, doc_id, text

    def _scan(self, texts: list[bytes | None]):
        """(index of the first text, words, gram hashes, anchor of each window, whether the window is whole)."""
        for lo, part in batches(texts):
            w = Words(part)
            if len(w) >= self.size:
                gram = windows(h := w.hashes(), GRAM)
                yield lo, w, h, gram, minimizers(gram, self.size - GRAM + 1), w.whole(self.size)

    # ---- 1

    def _anchors(self, docs: DataFrame, n: int) -> DataFrame:
        """(doc_id, at): positions of anchors that occur more than once; a document may have several rows."""

        def flush(parts):
            key, doc, at = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
            many = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
            known = np.sort(order[many])  # recurs here already
            yield _blobs(("key", "doc", "at"), doc[known] % n, [np.zeros(len(known), "V0"), doc[known], at[known]])
            one = np.sort(order[new])
            yield _blobs(("key", "doc", "at"), (key[one] >> U(33)).astype(np.int64) % n, [key[one], doc[one], at[one]])

        def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, size = [], 0
            for b in it:
                ids = b["doc_id"].to_numpy(zero_copy_only=False)
                for lo, w, _, gram, low, whole in self._scan(binary(b["text"])):
                    a = np.unique(low[whole])
                    own = np.searchsorted(w.first, a, side="right") - 1
                    parts.append((gram[a], ids[lo + own], (a - w.first[own]).astype(np.int32)))
                    size += len(a)
                    if size >= _FLUSH:
                        yield from flush(parts)
                        parts, size = [], 0
            if size:
                yield from flush(parts)

        def meet(t: pa.Table) -> pa.Table:
            doc, at = [], []
            sent = [b"" if not k else k for k in t["key"].to_pylist()]
            here = pa.array([bool(k) for k in sent])
            one, known = t.filter(here), t.filter(pa.compute.invert(here))
            if len(one):
                key, d, p = _column(one, "key", np.uint64), _column(one, "doc", np.int64), _column(one, "at", np.int32)
                order = np.argsort(key, kind="stable")
                k = key[order]
                same = np.zeros(len(k), bool)
                same[1:] = k[1:] == k[:-1]
                same[:-1] |= same[1:]
                doc.append(d[order][same])
                at.append(p[order][same])
            doc.append(_column(known, "doc", np.int64))
            at.append(_column(known, "at", np.int32))
            doc, at = np.concatenate(doc), np.concatenate(at)
            rows = [(d, at[i].tobytes()) for d, i in groups(doc)]
            return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "at": pa.array([r[1] for r in rows], pa.binary())})

        return dealt(docs.mapInArrow(lean(send), "bucket long, key binary, doc binary, at binary"), n).applyInArrow(lean_group(meet), "doc_id long, at binary")

    # ---- 2

    def _passages(self, docs: DataFrame, marks: DataFrame, n: int) -> DataFrame:
        """(shard, doc_id, start, n, words): runs of n windows whose anchors recur, with the bytes of their words."""
        size = self.size

        def cut(d: pa.Table, m: pa.Table) -> pa.Table:
            at: dict[int, list[bytes]] = {}
            for x, p in zip(m["doc_id"].to_pylist(), m["at"].to_pylist(), strict=True):
                at.setdefault(x, []).append(p)
            ids = d["doc_id"].to_pylist()
            shard = d["shard"].to_pylist()
            out = ([], [], [], [], [])
            keep = [i for i, x in enumerate(ids) if x in at]
            texts = binary(d["text"].take(pa.array(keep, pa.int64())))
            for lo, w, _, _, low, whole in self._scan(texts):
                hot = np.zeros(len(w), bool)
                for j in range(len(w.count)):
                    p = np.frombuffer(b"".join(at[ids[keep[lo + j]]]), np.int32)
                    hot[w.first[j] + p[p < w.count[j]]] = True
                go = np.flatnonzero(whole & hot[low])
                if not len(go):
                    continue
                own = np.searchsorted(w.first, go, side="right") - 1
                s, n = runs(np.concatenate([[True], (go[1:] != go[:-1] + 1) | (own[1:] != own[:-1])]))
                for i, k, o in zip(go[s].tolist(), n.tolist(), own[s].tolist(), strict=True):
                    row = keep[lo + o]
                    for c, v in zip(out, (shard[row], ids[row], i - int(w.first[o]), k, w.buf[w.start[i] : w.end[i + k + size - 2]]), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.table({c: pa.array(v, k) for c, v, k in zip(("shard", "doc_id", "start", "n", "words"), out, kinds, strict=True)})

        return dealt(docs, n, "shard").cogroup(dealt(marks, n, "shard")).applyInArrow(lean_pair(cut), "shard long, doc_id long, start long, n long, words binary")

    # ---- 3

    def _first_places(self, passages: DataFrame, n: int) -> DataFrame:
        """(shard, doc_id, at, n): runs of first places of recurring windows that the shard's documents hold."""
        size = self.size
        names = ("key", "more", "shard", "doc", "at", "many")

        def flush(parts):
            key, more, to, shard, doc, at = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((at, doc, shard, more, key))
            k, m, s = key[order], more[order], shard[order]
            first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1]) | (s[1:] != s[:-1])]))
            many = np.diff(np.concatenate([first, [len(k)]])).astype(np.int32)
            one = order[first]
            back = np.argsort(one)
            one, many = one[back], many[back]
            return _blobs(names, (to[one] >> U(33)).astype(np.int64) % n, [key[one], more[one], shard[one], doc[one], at[one], many])

        def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, held = [], 0
            for b in it:
                ids, shard, start = (b[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "shard", "start"))
                for lo, w, h, gram, low, whole in self._scan(b["words"].to_pylist()):
                    i = np.flatnonzero(whole)
                    own = np.searchsorted(w.first, i, side="right") - 1
                    row = lo + own
                    parts.append((windows(h, size)[i], windows(h, size, OTHER_STEP)[i], gram[low[i]], shard[row].astype(np.int32), ids[row], (start[row] + i - w.first[own]).astype(np.int32)))
                    held += len(i)
                    if held >= _FLUSH:
                        yield flush(parts)
                        parts, held = [], 0
            if held:
                yield flush(parts)

        def meet(t: pa.Table) -> pa.Table:
            key, more, shard, doc, at, many = (_column(t, c, k) for c, k in zip(names, (np.uint64, np.uint64, np.int32, np.int64, np.int32, np.int32), strict=True))
            order = np.lexsort((at, doc, more, key))
            key, more, shard, doc, at, many = (x[order] for x in (key, more, shard, doc, at, many))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])])
            run = np.cumsum(new) - 1
            first = np.flatnonzero(new)[run]
            total = np.bincount(run, weights=many)[run]
            here = (total > 1) & ~((many == 1) & (np.arange(len(key)) == first))
            s, d, p = shard[here], doc[first][here], at[first][here]
            order = np.lexsort((p, d, s))
            s, d, p = s[order], d[order], p[order]
            fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1])])[: len(s)]
            s, d, p = s[fresh], d[fresh], p[fresh]
            cut = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)])[: len(s)]
            i, k = runs(cut)
            return pa.table({"shard": s[i].astype(np.int64), "doc_id": d[i], "at": p[i].astype(np.int64), "n": k.astype(np.int64)})

        sent = passages.select("shard", "doc_id", "start", "words").mapInArrow(lean(send), "bucket long, key binary, more binary, shard binary, doc binary, at binary, many binary")
        return dealt(sent, n).applyInArrow(lean_group(meet), "shard long, doc_id long, at long, n long")

    def _phrases(self, passages: DataFrame, places: DataFrame) -> DataFrame:
        """(shard, doc_id, at, words): maximal runs of first places, with their words."""
        size = self.size

        def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                ids, shard, start, own_n = (b[c].to_pylist() for c in ("doc_id", "shard", "start", "n"))
                runs_ = b["runs"].to_pylist()
                out = ([], [], [], [])
                for lo, part in batches(b["words"].to_pylist()):
                    w = Words(part)
                    for j in range(len(part)):
                        r = lo + j
                        end, merged = start[r] + own_n[r], []
                        for x in runs_[r]:
                            if start[r] <= x["at"] < end:
                                if merged and merged[-1][1] == x["at"]:
                                    merged[-1][1] += x["n"]
                                else:
                                    merged.append([x["at"], x["at"] + x["n"]])
                        for a, z in merged:
                            i = int(w.first[j]) + a - start[r]
                            for c, v in zip(out, (shard[r], ids[r], a, w.buf[w.start[i] : w.end[i + z - a + size - 2]]), strict=True):
                                c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch({c: pa.array(v, k) for c, v, k in zip(("shard", "doc_id", "at", "words"), out, kinds, strict=True)})

        listed = places.groupBy("shard", "doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("runs"))
        cuts = passages.select("doc_id", "start", "n", "words")
        return listed.join(cuts, "doc_id").select("shard", "doc_id", "start", "n", "words", "runs").mapInArrow(lean(cut), "shard long, doc_id long, at long, words binary")

    # ---- 4

    def _stream(self, docs: DataFrame, phrases: DataFrame, n: int, keep: list[str], as_it_was: bool) -> DataFrame:
        size = self.size

        def run(d: pa.Table, p: pa.Table) -> pa.Table:
            automata = list(_compiled(p, size))
            n_words, n_removed, kept, spans = [], [], [], []
            for doc, text in zip(d["doc_id"].to_pylist(), binary(d["text"]), strict=True):
                words = (text or b"").split()
                gone = np.zeros(len(words), bool)
                if len(words) >= size and doc is not None:
                    for a in automata:
                        a.mark(doc, words, gone)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                if n_removed[-1]:
                    kept.append(b" ".join(compress(words, (~gone).tolist())))
                else:
                    kept.append(text if as_it_was else b" ".join(words))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
            return pa.table({c: d[c] for c in keep} | {
                "__doc": d["doc_id"],
                "__n_words": pa.array(n_words, pa.int64()),
                "__n_removed": pa.array(n_removed, pa.int64()),
                "__kept": pa.array(kept, pa.binary()).cast(pa.string()),
                "__removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
            })

        fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
        schema = ", ".join([*fields, "__doc long, __n_words long, __n_removed long, __kept string, __removed array<struct<start: long, length: long>>"])
        return dealt(docs, n, "shard").cogroup(dealt(phrases, n, "shard")).applyInArrow(lean_pair(run), schema)

    def _cut(self, documents: DataFrame, keep: list[str], as_it_was: bool) -> DataFrame:
        """(__keep0, ..., __doc, __n_words, __n_removed, __kept, __removed)."""
        text = F.col(self.text).cast("string")
        n = buckets(documents.sparkSession, text_bytes(documents, self.text))
        shard = F.expr(f"CAST(pmod(xxhash64(doc_id), {n}) AS INT)")
        spread = F.when(F.col("doc_id").isNull(), F.expr(f"CAST(pmod(xxhash64(text), {n}) AS INT)")).otherwise(shard)
        own = [f"__keep{i}" for i in range(len(keep))]
        docs = documents.select(F.col(self.doc_id).cast("long").alias("doc_id"), text.alias("text"), *(F.col(f"`{c}`").alias(a) for c, a in zip(keep, own, strict=True)))
        sharded = docs.select(spread.alias("shard"), "doc_id", "text", *own)
        plain = sharded.select("shard", "doc_id", "text").where("doc_id IS NOT NULL")
        marks = self._anchors(plain.select("doc_id", "text"), n).select(shard.alias("shard"), "doc_id", "at")
        passages = staged(self._passages(plain, marks, n))
        phrases = self._phrases(passages, staged(self._first_places(passages, n)))
        return self._stream(sharded, phrases, n, own, as_it_was)

    @tidy
    def dedup(self, documents: DataFrame, keep: list[str] | tuple[str, ...] = (), as_it_was: bool = False) -> DataFrame:
        """(keep, doc_id, n_words, n_removed, kept, removed): the kept words joined by one space, and the removed word spans.

        keep: further columns to pass on.  as_it_was: a text that loses nothing is kept unchanged, null included."""
        out = self._cut(documents, list(keep), as_it_was)
        found = [F.col(f"__{c}").alias(c) for c in ("n_words", "n_removed", "kept", "removed") if c not in keep]
        doc = [] if "doc_id" in keep else [F.col("__doc").alias("doc_id")]
        return out.select(*(F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)), *doc, *found)

    @tidy
    def cleaned(self, documents: DataFrame) -> DataFrame:
        """The documents' rows with all their columns, repeated passages cut from the texts; a text that loses nothing is unchanged."""
        others = [c for c in documents.columns if c not in (self.doc_id, self.text)]
        at = {self.text: F.col("__kept").cast(documents.schema[self.text].dataType), self.doc_id: F.col("__doc").cast(documents.schema[self.doc_id].dataType)}
        at |= {c: F.col(f"__keep{i}") for i, c in enumerate(others)}
        return self._cut(documents, others, True).select(*(at[c].alias(c) for c in documents.columns))


#: Phrases of one anchor from which on they are told apart by the words beside it.
_MANY = 16


class _Crowd:
    """The phrases of a common anchor, by the words before it and by those after it.

    An equal run of `size` words around an anchor has `half` equal words on one side of it at least."""

    def __init__(self, hits: list[tuple[int, int]], phrases: list[tuple[int, int, np.ndarray]], size: int):
        self.half = (size - GRAM + 1) // 2
        self.left: dict[bytes, list[tuple[int, int]]] = {}
        self.right: dict[bytes, list[tuple[int, int]]] = {}
        for k, a in hits:
            codes = phrases[k][2]
            if a >= self.half:
                self.left.setdefault(codes[a - self.half : a].tobytes(), []).append((k, a))
            if a + GRAM + self.half <= len(codes):
                self.right.setdefault(codes[a + GRAM : a + GRAM + self.half].tobytes(), []).append((k, a))

    def at(self, codes: np.ndarray, i: int) -> list[tuple[int, int]]:
        before = self.left.get(codes[i - self.half : i].tobytes(), []) if i >= self.half else []
        return before + self.right.get(codes[i + GRAM : i + GRAM + self.half].tobytes(), [])


class _Automaton:
    """Phrases as strings of word codes, found by their anchors."""

    def __init__(self, phrases: list[tuple[int, int, list[bytes], list[int]]], size: int):
        self.size, self.code = size, {}
        self.phrases = []
        self.machine = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (doc, at, words, anchors) in enumerate(phrases):
            codes = np.array([self.code.setdefault(x, len(self.code) + 1) for x in words], np.int32)
            self.phrases.append((doc, at, codes))
            symbols = _symbols(codes)
            for a in anchors:
                seeds.setdefault(symbols[3 * a : 3 * (a + GRAM)], []).append((k, a))
        for s, hits in seeds.items():
            self.machine.add_word(s, _Crowd(hits, self.phrases, size) if len(hits) > _MANY else hits)
        self.machine.make_automaton()

    def mark(self, doc: int, words: list[bytes], gone: np.ndarray) -> None:
        codes = np.fromiter(map(self.code.get, words, repeat(0)), np.int32, len(words))
        if not codes.any():
            return
        done: dict[tuple[int, int], int] = {}
        for end, hits in self.machine.iter(_symbols(codes)):
            i = end // 3 - GRAM + 1
            for k, a in hits.at(codes, i) if isinstance(hits, _Crowd) else hits:
                if done.get((k, i - a), -1) >= i:
                    continue
                home, at, phrase = self.phrases[k]
                lo = _equal_before(codes, i, phrase, a)
                hi = _equal_after(codes, i, phrase, a)
                done[k, i - a] = i + hi
                if lo + hi >= self.size and (home, at + a - lo) < (doc, i - lo):
                    gone[i - lo : i + hi] = True


def _symbols(codes: np.ndarray) -> str:
    """Three characters a word, of a hundred each and from ranges of their own, so that nodes have few edges
    and matches start at words; an unknown word is three zeros."""
    c = codes.astype(np.uint32)[:, None]
    digits = np.concatenate([c // 10_000 + 1, c // 100 % 100 + 201, c % 100 + 301], axis=1)
    digits[codes == 0] = 0
    return digits.astype(np.uint32).tobytes().decode("utf-32-le")


def _equal_after(x: np.ndarray, i: int, y: np.ndarray, j: int) -> int:
    """How many values from x[i] and y[j] on are equal."""
    n, step, total = min(len(x) - i, len(y) - j), 32, 0
    while total < n:
        m = min(step, n - total)
        bad = np.flatnonzero(x[i + total : i + total + m] != y[j + total : j + total + m])
        if len(bad):
            return total + int(bad[0])
        total += m
        step *= 4
    return n


def _equal_before(x: np.ndarray, i: int, y: np.ndarray, j: int) -> int:
    return _equal_after(x[:i][::-1], 0, y[:j][::-1], 0)


def _compiled(p: pa.Table, size: int) -> Iterator[_Automaton]:
    """Automata over all the shard's phrases, each of at most about _SYMBOLS words."""
    held, n = [], 0
    texts = p["words"].to_pylist()
    docs, starts = p["doc_id"].to_pylist(), p["at"].to_pylist()
    for lo, part in batches(texts):
        w = Words(part)
        low, whole = minimizers(windows(w.hashes(), GRAM), size - GRAM + 1), w.whole(size)
        anchors = np.unique(low[whole]) if len(low) else np.zeros(0, np.int64)
        cut = np.searchsorted(anchors, w.first)
        for j, text in enumerate(part):
            words = text.split()
            held.append((docs[lo + j], starts[lo + j], words, (anchors[cut[j] : cut[j + 1]] - w.first[j]).tolist()))
            n += len(words)
            if n >= _SYMBOLS:
                yield _Automaton(held, size)
                held, n = [], 0
    if held:
        yield _Automaton(held, size)
