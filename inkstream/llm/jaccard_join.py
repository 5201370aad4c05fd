"""N-gram Jaccard join: universe partitioning, one-deletion neighbourhoods and exact verification.

Two documents link when intersection / union of their shingle sets reaches the threshold (a ratio of
integers).  Sets are the distinct k-word shingles; a shorter text is one shingle, a text without words is
empty and links with nothing.  Null texts are empty.  Of rows that share a doc_id the least text counts, and
each row gets its result.  A row without an id links with nothing: its size is counted, its component is null.  Very long texts are read whole, ties of the common
order go by hash, an empty table gives no rows, and other columns are not read, whatever their names.

The plan, none of whose steps holds a group of documents in one task or lists pairs within one:

1. A profile of every document: set size and a 128-bit fingerprint, with counters of how common
   shingles are (262,144 of them, whatever the input).  Documents with equal sets form one class, kept by its smallest doc_id.
2. Of the first n - ceil(t n) + l shingles of a set in a common order, rarest first, at least l are among
   those of a partner (l a tenth of n here, the smaller set's counting).  Documents that share fewer of them
   with any others leave here.
3. Those that stay are signed.  Sizes fall into bands a factor 1/t apart; a pair lies in one band or two
   neighbours, and a set signs for its own band and the one below.  For a band, symmetric difference of
   a linked pair is at most U.  The universe is hashed into segments of weight 1 (equal if no element
   differs) or 2 (also signed without each of its elements, so that one difference is tolerated).  Were
   every segment's difference at least its weight, the total would exceed U when weights sum to U + 1;
   so some segment must agree.  Weights sum to U + 1 + 2q: each set may leave out segments of weight q,
   and it leaves out the costliest (empty ones and those made of common shingles only).  How many
   segments of each kind a band has is chosen by the same estimate of cost.
4. Signatures that several sets share give candidates, each with the smallest set that has it; within a
   partition, with the set it meets most often.  A parity sketch, whose differing bits are at most the
   symmetric difference, drops pairs that cannot link; the rest are verified on the whole sets, and
   components are found.
5. Sets whose signatures are shared by several components are paired across components as well, by the
   shingles of the common-order prefix, of which a linked pair has one in common.  Shingles of few sets list
   their pairs.  The sets of commoner ones go on to pairs of shingles, of a prefix longer by one, of which a
   linked pair has two in common; only those of pairs that are still common are compared in blocks by sketches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import binary, buckets, connected_components, dealt, groups, lean, lean_group, staged, tidy
from .words import U, Words, batches, mix, windows

SLOTS = 1 << 18
_SHIFT = 64 - 18
_RANGES = 16
#: Candidates of a set within a partition, before components are known.
PARTNERS = 6
#: Sets of a shingle up to which its pairs across components are listed; above it they are compared in blocks.
FEW = 64
_FLUSH = 500_000
#: In place of a doc_id: this entry has been counted already.
_COUNTED = -(1 << 63)


def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of each text."""
    for lo, part in batches(texts):
        w = Words([t.lower() for t in part])
        h = w.hashes()
        gram = windows(h, k)
        for i, (a, n) in enumerate(zip(w.first, w.count, strict=False)):
            if n >= k:
                yield lo + i, np.unique(gram[a : a + n - k + 1])
            elif n:
                yield lo + i, mix(windows(h[a : a + n], int(n)) + U(int(n)))
            else:
                yield lo + i, np.zeros(0, np.uint64)


def needed(n: int, num: int, den: int) -> int:
    """ceil(n num / den)."""
    return -(-n * num // den)


@lru_cache(maxsize=4096)
def band_start(k: int, num: int, den: int) -> int:
    n = 1
    for _ in range(k):
        n = n * den // num + 1
    return n


@lru_cache(maxsize=1 << 16)
def band_of(n: int, num: int, den: int) -> int:
    k = 0
    while band_start(k + 1, num, den) <= n:
        k += 1
    return k


@lru_cache(maxsize=4096)
def layout(band: int, num: int, den: int) -> tuple[int, int, int]:
    """(segments of weight 2, segments of weight 1, weight q that a set may leave out) of least estimated cost.

    Cost: signatures of a typical set, and chance partners that agree on a short segment."""
    small = band_start(band + 1, num, den) - 1
    large = small * den // num
    need = (den - num) * (small + large) // (den + num) + 1
    typical = band_start(band, num, den)
    best = None
    for q in {1, need // 8 + 1, need // 4 + 1}:
        for two in {0, (need + 2 * q) // 4, (need + 2 * q) // 2}:
            one = need + 2 * q - 2 * two
            m = one + two
            length = typical / m
            cost = m - q / 2 + two * length + 30 * m * 0.3**length
            if best is None or cost < best[0]:
                best = (cost, two, one, q)
    return best[1:]


def signatures(tokens: np.ndarray, common: np.ndarray, num: int, den: int) -> np.ndarray:
    """The signature keys of one set.  common: how often the slot of each token was counted."""
    own = band_of(len(tokens), num, den)
    out, value = [], mix(tokens + U(0x632BE59BD9B4E019))
    for band in (own, own - 1):
        if band < 0:
            continue
        two, one, q = layout(band, num, den)
        m = two + one
        seg = (mix(tokens ^ U(0xA0761D6478BD642F + band)) % U(m)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        seg, val, cost = seg[order], value[order], common[order]
        have, at = np.unique(seg, return_index=True)
        total = np.zeros(m, np.uint64)
        price = np.full(m, np.iinfo(np.int64).max)
        if len(have):
            total[have] = np.add.reduceat(val, at)
            price[have] = np.minimum.reduceat(cost, at)
        weight = np.where(np.arange(m) < two, 2, 1)
        by_price = np.argsort(-price, kind="stable")
        left_out = np.zeros(m, bool)
        room = q
        for s in by_price[: q + two]:
            if weight[s] <= room:
                left_out[s] = True
                room -= weight[s]
                if not room:
                    break
        label = mix(np.arange(m, dtype=np.uint64) + U((band + 1) << 32))
        out.append(mix(total[~left_out] ^ label[~left_out]))
        lone = (seg < two) & ~left_out[seg]
        out.append(mix((total[seg[lone]] - val[lone]) ^ label[seg[lone]]))
    return np.unique(np.concatenate(out))


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens in 2^j cells; two sketches differ in no more bits than the sets in elements."""
    size = 1 << max(6, (2 * len(tokens)).bit_length())
    return np.packbits((np.bincount((tokens & U(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, width), axis=1)


def across_components(block, rows: list[tuple[int, int, int, bytes, bytes, bytes]], num: int, den: int) -> tuple[list[int], list[int]]:
    """The pairs of a block of sets (document, component, size, sketch, prefix, longer prefix) that share its shingles,
    lie in different components and may link.  A pair comes only from the least shingle that its prefixes share and
    the least other one that the longer prefixes share."""
    out: tuple[list[int], list[int]] = ([], [])
    if len(rows) < 2 or all(r[1] == rows[0][1] for r in rows):
        return out
    doc, place, n = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    width = np.array([len(r[3]) for r in rows])
    key, second = (np.uint64(x & (1 << 64) - 1) for x in block[:2])
    kinds = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    bits = {w: np.frombuffer(b"".join(rows[i][3] for i in at), np.uint8).reshape(len(at), w) for w, at in kinds.items()}
    for w, x in kinds.items():
        for v in (w, 2 * w):
            if v not in kinds:
                continue
            y, far = kinds[v], _folded(bits[v], w)
            for lo in range(0, len(x), 64):
                i = x[lo : lo + 64]
                ok = place[i][:, None] != place[y]
                ok &= np.minimum(n[i][:, None], n[y]) * den >= np.maximum(n[i][:, None], n[y]) * num
                if v == w:
                    ok &= i[:, None] < y
                p, q = np.nonzero(ok)
                for cut in range(0, len(p), 1 << 16):
                    s, t = p[cut : cut + (1 << 16)], q[cut : cut + (1 << 16)]
                    differ = np.bitwise_count(bits[w][lo : lo + 64][s] ^ far[t]).sum(axis=1, dtype=np.int64)
                    good = differ * (den + num) <= (den - num) * (n[i[s]] + n[y[t]])
                    for a, b in zip(i[s[good]].tolist(), y[t[good]].tolist(), strict=True):
                        both, more = (np.intersect1d(np.frombuffer(rows[a][c], np.uint64), np.frombuffer(rows[b][c], np.uint64), assume_unique=True) for c in (4, 5))
                        rest = more if second == key else more[more != key]
                        if len(both) and both[0] == key and (second == key or (len(rest) and rest[0] == second)):
                            out[0].append(min(int(doc[a]), int(doc[b])))
                            out[1].append(max(int(doc[a]), int(doc[b])))
    return out


class _Exchange:
    """Collects (key, columns) entries and yields them as one blob row per bucket."""

    def __init__(self, n: int, names: tuple[str, ...], thin: Callable | None = None):
        self.n, self.names, self.thin = n, names, thin
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(cols)
        self.size += len(cols[0])
        if self.size >= _FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            cols = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            self.parts, self.size = [], 0
            direct = None
            if self.thin:
                cols, direct = self.thin(cols)
            to = (cols[0] >> U(33)).astype(np.int64) % self.n
            rows = [[b, *(c[at].tobytes() for c in cols), None] for b, at in groups(to)]
            if direct is not None and len(direct):
                rows += [[b, *[b""] * len(cols), direct[at].tobytes()] for b, at in groups(direct.reshape(len(direct), -1)[:, 0] % self.n)]
            if rows:
                names = ("bucket", *self.names, "direct")
                yield pa.record_batch({c: pa.array(v, pa.int64() if c == "bucket" else pa.binary()) for c, v in zip(names, zip(*rows, strict=True), strict=True)})


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table[name].to_pylist() if x), kind)


def _same_key(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key, run number, size of the run) per sorted entry."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    return order, run, np.bincount(run)[run] if len(k) else run


class JaccardJoin:
    """Components of documents under Jaccard >= num / den on k-word shingles."""

    def __init__(self, k: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text"):
        self.k, self.num, self.den, self.doc_id, self.text = k, num, den, doc_id, text

    # ---- 1: profiles

    def profile(self, docs: DataFrame) -> DataFrame:
        """Rows (doc_id, n, fp1, fp2) for documents, rows (span, seen) for counters; the others null."""
        k = self.k

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(SLOTS, np.int64)
            for b in it:
                n, one, two = [], [], []
                for _, s in shingle_sets(binary(b["text"]), k):
                    n.append(len(s))
                    one.append(int(mix(s ^ U(0x2545F4914F6CDD1D)).sum().view(np.int64)))
                    two.append(int(mix(s + U(0x9E6C63D0876A9A47)).sum().view(np.int64)))
                    np.add.at(seen, (s >> U(_SHIFT)).astype(np.int64), 1)
                none = pa.nulls(len(n), pa.int64())
                yield pa.record_batch({"doc_id": b["doc_id"], "n": pa.array(n, pa.int64()), "fp1": pa.array(one, pa.int64()), "fp2": pa.array(two, pa.int64()), "span": none, "seen": pa.nulls(len(n), pa.binary())})
            none = pa.nulls(_RANGES, pa.int64())
            yield pa.record_batch({"doc_id": none, "n": none, "fp1": none, "fp2": none, "span": pa.array(range(_RANGES), pa.int64()), "seen": pa.array([x.tobytes() for x in seen.reshape(_RANGES, -1)], pa.binary())})

        return self._all(docs).mapInArrow(lean(run), "doc_id long, n long, fp1 long, fp2 long, span long, seen binary")

    @staticmethod
    def _counted(profile: DataFrame) -> np.ndarray:
        """The counters of a profile, summed by range on the executors: SLOTS numbers reach the driver."""

        def add(t: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(x, np.int64) for x in t["seen"].to_pylist()], axis=0)
            return pa.table({"span": t["span"][:1], "seen": pa.array([total.tobytes()], pa.binary())})

        parts = profile.where("span IS NOT NULL").select("span", "seen").groupBy("span").applyInArrow(lean_group(add), "span long, seen binary").collect()
        out = np.zeros((_RANGES, SLOTS // _RANGES), np.int64)
        for r in parts:
            out[r.span] = np.frombuffer(bytes(r.seen), np.int64)
        return out.reshape(-1)

    def _all(self, docs: DataFrame) -> DataFrame:
        return docs.select(F.col(self.doc_id).cast("long").alias("doc_id"), F.col(self.text).cast("string").alias("text"))

    def _two(self, docs: DataFrame) -> DataFrame:
        """Those with an id: an Arrow column of ids with a null would become doubles."""
        return self._all(docs).where("doc_id IS NOT NULL")

    # ---- 2: who can have a partner

    def _survivors(self, docs: DataFrame, placed: DataFrame, common, n_buckets: int) -> DataFrame:
        k, num, den = self.k, self.num, self.den

        def thin(cols):
            """A shingle that several documents of the partition have counts for each here, and goes on once, for the others to meet."""
            key, doc = cols
            order, run, size = _same_key(key)
            first = np.concatenate([[True], run[1:] != run[:-1]])
            many = size > 1
            return [key[order][first], np.where(many, _COUNTED, doc[order])[first]], np.stack(np.unique(doc[order][many], return_counts=True), axis=1)

        def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, known, seen = _Exchange(n_buckets, ("key", "doc"), thin), common.value, set()
            for b in it:
                ids = b["doc_id"].to_numpy(zero_copy_only=False)
                for i, s in shingle_sets(binary(b["text"]), k):
                    if not len(s):
                        continue
                    mark = (len(s), int(mix(s).sum()))  # of equal sets the first goes on; the class counts once
                    if mark in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(mark)
                    m = len(s) - needed(len(s), num, den) + max(1, len(s) // 10)
                    rare = known[(s >> U(_SHIFT)).astype(np.int64)]
                    s = s[np.lexsort((s, rare))[:m]]
                    yield from out.add(s, np.full(len(s), ids[i], np.int64))
            yield from out.flush()

        def meet(t: pa.Table) -> pa.Table:
            key, doc = _joined(t, "key", np.uint64), _joined(t, "doc", np.int64)
            order, _, size = _same_key(key)
            met = doc[order][size > 1]
            ids, hits = np.unique(met[met != _COUNTED], return_counts=True)
            direct = _joined(t, "direct", np.int64).reshape(-1, 2)
            ids, hits = np.concatenate([ids, direct[:, 0]]), np.concatenate([hits, direct[:, 1]])
            rows = [(to, ids[at].tobytes(), hits[at].tobytes()) for to, at in groups(ids % n_buckets)]
            return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate((("to", pa.int64()), ("doc", pa.binary()), ("hits", pa.binary())))})

        def total(t: pa.Table) -> pa.Table:
            ids, at = np.unique(_joined(t, "doc", np.int64), return_inverse=True)
            return pa.table({"doc_id": ids, "hits": np.bincount(at, weights=_joined(t, "hits", np.int64), minlength=len(ids)).astype(np.int64)})

        sent = self._two(docs).mapInArrow(lean(send), "bucket long, key binary, doc binary, direct binary")
        hits = dealt(dealt(sent, n_buckets).applyInArrow(lean_group(meet), "to long, doc binary, hits binary"), n_buckets, "to").applyInArrow(lean_group(total), "doc_id long, hits long")
        # Any member may have gone on for its class; the class survives by the member with most hits.
        rep = hits.join(placed, "doc_id").groupBy("rep", "n").agg(F.max("hits").alias("hits"))
        return rep.where(f"hits >= greatest(1, ((n * {num} + {den - 1}) div {den}) div 10)").select(F.col("rep").alias("doc_id"))

    # ---- 3 and 4: signatures, candidates

    def _candidates(self, kept: DataFrame, common, n_buckets: int) -> DataFrame:
        k, num, den = self.k, self.num, self.den

        def stars(key, doc, size):
            """(smallest document of the key, another one) for every entry of a shared key whose sizes allow a link."""
            order = np.lexsort((doc, key))
            k, d, s = key[order], doc[order], size[order]
            head = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            ok = (d != d[first]) & (np.minimum(s, s[first]) * den >= np.maximum(s, s[first]) * num)
            return np.stack([d[first][ok], d[ok]], axis=1), order[head]

        def thin(cols):
            """Of the partition's sets that share a key the smallest goes on; each other one is paired with
            those it meets most often."""
            key, doc, size = cols
            met, first = stars(key, doc, size)
            met, often = np.unique(met, axis=0, return_counts=True)
            order = np.lexsort((met[:, 0], -often, met[:, 1]))
            met = met[order]
            head = np.concatenate([[True], met[1:, 1] != met[:-1, 1]])[: len(met)]
            at = np.arange(len(met))
            return [key[first], doc[first], size[first]], met[at - at[head][np.cumsum(head) - 1] < PARTNERS]

        def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, known = _Exchange(n_buckets, ("key", "doc", "size"), thin), common.value
            for b in it:
                ids = b["doc_id"].to_numpy(zero_copy_only=False)
                for i, s in shingle_sets(binary(b["text"]), k):
                    if len(s):
                        key = signatures(s, known[(s >> U(_SHIFT)).astype(np.int64)], num, den)
                        yield from out.add(key, np.full(len(key), ids[i], np.int64), np.full(len(key), len(s), np.int64))
            yield from out.flush()

        def meet(t: pa.Table) -> pa.Table:
            found, _ = stars(_joined(t, "key", np.uint64), _joined(t, "doc", np.int64), _joined(t, "size", np.int64))
            found = np.unique(np.concatenate([found, _joined(t, "direct", np.int64).reshape(-1, 2)]), axis=0)
            return pa.table({"a": found[:, 0], "b": found[:, 1]})

        sent = kept.select("doc_id", "text").mapInArrow(lean(send), "bucket long, key binary, doc binary, size binary, direct binary")
        return dealt(sent, n_buckets).applyInArrow(lean_group(meet), "a long, b long").distinct()

    # ---- 5: pairs across components

    def _across(self, kept: DataFrame, comp: DataFrame, done: DataFrame, sketches: DataFrame, common, n_buckets: int) -> DataFrame:
        k, num, den = self.k, self.num, self.den
        placed = kept.join(comp, kept.doc_id == comp.node, "left").select("doc_id", "text", F.coalesce("component", "doc_id").alias("component"))

        def one_each(cols):
            key, where = cols
            order = np.lexsort((where, key))
            key, where = key[order], where[order]
            at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (where[1:] != where[:-1])])[: len(key)])
            return [key[at], where[at]], None

        def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, known = _Exchange(n_buckets, ("key", "place"), one_each), common.value
            for b in it:
                place = b["component"].to_numpy(zero_copy_only=False)
                for i, s in shingle_sets(binary(b["text"]), k):
                    if len(s):
                        key = signatures(s, known[(s >> U(_SHIFT)).astype(np.int64)], num, den)
                        yield from out.add(key, np.full(len(key), place[i], np.int64))
            yield from out.flush()

        def still_open(t: pa.Table) -> pa.Table:
            """Keys whose sets lie in several components."""
            (key, _), _ = one_each([_joined(t, "key", np.uint64), _joined(t, "place", np.int64)])
            order, _, many = _same_key(key)
            return pa.table({"key": np.unique(key[order][many > 1]).view(np.int64)})

        def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = common.value
            for b in it:
                ids = b["doc_id"].to_numpy(zero_copy_only=False)
                for i, s in shingle_sets(binary(b["text"]), k):
                    if len(s):
                        key = signatures(s, known[(s >> U(_SHIFT)).astype(np.int64)], num, den).view(np.int64)
                        yield pa.record_batch({"key": pa.array(key), "doc_id": pa.array(np.full(len(key), ids[i], np.int64))})

        sent = placed.mapInArrow(lean(send), "bucket long, key binary, place binary, direct binary")
        keys = staged(dealt(sent, n_buckets).applyInArrow(lean_group(still_open), "key long"))
        if keys.isEmpty():
            return done.limit(0)
        opened = placed.mapInArrow(lean(spread), "key long, doc_id long").join(keys, "key", "left_semi").select("doc_id").distinct()

        def listed(rows: DataFrame, by: list[str]) -> DataFrame:
            """The pairs across components of keys with few sets."""
            x, y = rows.where(f"many <= {FEW}").alias("x"), rows.where(f"many <= {FEW}").alias("y")
            same = " AND ".join(f"x.{c} = y.{c}" for c in by)
            met = x.join(y, F.expr(f"{same} AND x.component < y.component AND least(x.n, y.n) * {den} >= greatest(x.n, y.n) * {num}"))
            return met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))

        def held_by_several(rows: DataFrame, by: list[str]) -> DataFrame:
            """The rows of keys whose sets lie in several components, with how many sets have the key."""
            wide = rows.groupBy(*by).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many")).where("lo <> hi")
            return staged(rows.join(wide.select(*by, "many"), by))

        def tested(pairs: DataFrame) -> DataFrame:
            return self._possible(pairs.distinct().join(done, ["a", "b"], "left_anti"), sketches)

        def prefix(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = common.value
            for b in it:
                rows = []
                for _, s in shingle_sets(binary(b["text"]), k):
                    m = len(s) - needed(len(s), num, den) + 1
                    rare = s[np.lexsort((s, known[(s >> U(_SHIFT)).astype(np.int64)]))[: m + 1]]
                    more = np.sort(rare)
                    first = np.sort(rare[:m])
                    rows.append((len(s), sketch(s), first.tobytes(), more.tobytes(), first.view(np.int64), more.view(np.int64)))
                n, bits, held, longer, keys, more = zip(*rows, strict=True) if rows else ([], [], [], [], [], [])
                longs = pa.list_(pa.int64())
                yield pa.record_batch({"doc_id": b["doc_id"], "component": b["component"], "n": pa.array(n, pa.int64()), "bits": pa.array(bits, pa.binary()), "held": pa.array(held, pa.binary()), "longer": pa.array(longer, pa.binary()), "keys": pa.array(keys, longs), "more": pa.array(more, longs)})

        full = staged(placed.join(opened, "doc_id", "left_semi").mapInArrow(lean(prefix), "doc_id long, component long, n long, bits binary, held binary, longer binary, keys array<long>, more array<long>"))
        shared = held_by_several(full.select(F.explode("keys").alias("key"), "doc_id", "n", "component"), ["key"])
        # A linked pair of different sets has two shingles in common, if the threshold is above a half.
        hot = shared.where(f"many > {FEW}").select("key", "doc_id").join(full.select("doc_id", "n", "component", "more"), "doc_id")
        second = F.explode("more") if 2 * num > den else F.col("key")
        two = hot.select("key", second.alias("second"), "doc_id", "n", "component").where("second <> key" if 2 * num > den else "true")
        twice = held_by_several(two, ["key", "second"])
        near = tested(listed(shared, ["key"]).unionByName(listed(twice, ["key", "second"])))
        # The sets of what is still common are compared in a grid of blocks of about 1,024.
        grid = twice.where(f"many > {FEW}").withColumn("side", F.expr("(many + 1023) div 1024")).withColumn("i", F.expr("pmod(xxhash64(doc_id), side)"))
        by = ["key", "second", "p", "q"]
        grid = grid.withColumn("j", F.explode(F.expr("sequence(0L, side - 1)"))).select("key", "second", "doc_id", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"))
        grid = grid.join(full.select("doc_id", "component", "n", "bits", "held", "longer"), "doc_id").repartition(*by).sortWithinPartitions(*by)

        def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, rows = None, []
            for b in it:
                found = []
                for *block, doc, place, n, bits, held, longer in zip(*(b[c].to_pylist() for c in (*by, "doc_id", "component", "n", "bits", "held", "longer")), strict=True):
                    if block != at:
                        found.append(across_components(at, rows, num, den))
                        at, rows = block, []
                    rows.append((doc, place, n, bits, held, longer))
                yield pa.record_batch({c: pa.array([x for f in found for x in f[i]], pa.int64()) for i, c in enumerate("ab")})
            a, b = across_components(at, rows, num, den)
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        pairs = grid.mapInArrow(lean(meet), "a long, b long").distinct()
        return near.unionByName(pairs.join(done, ["a", "b"], "left_anti")).distinct()

    # ---- exact verification

    def _sketches(self, kept: DataFrame) -> DataFrame:
        k = self.k

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                n, bits = [], []
                for _, s in shingle_sets(binary(b["text"]), k):
                    n.append(len(s))
                    bits.append(sketch(s))
                yield pa.record_batch({"doc_id": b["doc_id"], "n": pa.array(n, pa.int64()), "bits": pa.array(bits, pa.binary())})

        return kept.mapInArrow(lean(run), "doc_id long, n long, bits binary")

    def _possible(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """The pairs whose sketches differ in no more bits than linked sets can."""
        num, den = self.num, self.den

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                ok = []
                for m, n, x, y in zip(*(b[c].to_pylist() for c in ("an", "bn", "abits", "bbits")), strict=True):
                    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                    short = min(len(x), len(y))
                    x, y = (np.bitwise_xor.reduce(z.reshape(-1, short), axis=0) for z in (x, y))
                    ok.append(int(np.bitwise_count(x ^ y).sum()) * (den + num) <= (den - num) * (m + n))
                yield pa.record_batch({c: b[c].filter(pa.array(ok, pa.bool_())) for c in ("a", "b")})

        one = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("an"), F.col("bits").alias("abits"))
        two = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("bbits"))
        return pairs.join(one, "a").join(two, "b").mapInArrow(lean(run), "a long, b long")

    def _verified(self, pairs: DataFrame, kept: DataFrame) -> DataFrame:
        """Links among the pairs (a, b).  Each chunk of at most about 64 partners meets its a once."""
        k, num, den = self.k, self.num, self.den
        chunks = pairs.join(pairs.groupBy("a").count(), "a").withColumn("part", F.expr("pmod(xxhash64(b), (count + 63) div 64)")).select("a", "part", "b")
        text = kept.select("doc_id", "text")
        right = chunks.join(text, chunks.b == text.doc_id).select("a", "part", "doc_id", "text", F.lit(1).alias("side"))
        heads = chunks.select("a", "part").distinct()
        left = heads.join(text, heads.a == text.doc_id).select("a", "part", "doc_id", "text", F.lit(0).alias("side"))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, head = None, np.zeros(0, np.uint64)
            for b in it:
                u, v = [], []
                key = list(zip(b["a"].to_pylist(), b["part"].to_pylist(), strict=True))
                side, ids = b["side"].to_pylist(), b["doc_id"].to_pylist()
                for i, s in shingle_sets(binary(b["text"]), k):
                    if side[i] == 0:
                        at, head = key[i], s
                    elif at == key[i]:
                        both = len(np.intersect1d(head, s, assume_unique=True))
                        if both * den >= num * (len(head) + len(s) - both):
                            u.append(ids[i])
                            v.append(at[0])
                yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

        together = left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", "side", "doc_id")
        return together.mapInArrow(lean(run), "u long, v long")

    @tidy
    def components(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, component_id): the smallest doc_id that links reach."""
        spark = docs.sparkSession
        profile = staged(self.profile(docs))
        common = spark.sparkContext.broadcast(self._counted(profile))
        doc = profile.where("span IS NULL AND doc_id IS NOT NULL").select("doc_id", "n", "fp1", "fp2")
        nameless = profile.where("span IS NULL AND doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        differ = " OR ".join(f"min({c}) <> max({c})" for c in ("n", "fp1", "fp2"))
        told = staged(doc.groupBy("doc_id").agg(F.count("*").alias("rows"), F.expr(differ).alias("differ")))
        several = told.where("rows > 1").select("doc_id", "rows")
        if not told.where("differ").isEmpty():
            two = self._two(docs)
            least = two.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
            one = JaccardJoin(self.k, self.num, self.den).components(staged(two.join(several, "doc_id", "left_anti").unionByName(least)))
            again = one.join(several, "doc_id", "left").withColumn("rows", F.explode(F.expr("sequence(1L, coalesce(rows, 1L))")))
            return again.drop("rows").unionByName(nameless)
        n = buckets(spark, 8 * (doc.agg(F.sum("n")).first()[0] or 0))  # what a shingle comes to in an exchange, about
        first = doc.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"))
        placed = staged(doc.join(first, ["fp1", "fp2", "n"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")))
        kept = staged(self._two(docs).join(self._survivors(docs, placed, common, n), "doc_id", "left_semi"))
        common = spark.sparkContext.broadcast(self._counted(self.profile(kept)))
        sketches = staged(self._sketches(kept))
        pairs = staged(self._candidates(kept, common, n))
        links = staged(self._verified(staged(self._possible(pairs, sketches)), kept))
        comp = connected_components(links)
        more = staged(self._across(kept, comp, pairs, sketches, common, n))
        if not more.isEmpty():
            comp = connected_components(links.unionByName(self._verified(more, kept)))
        out = placed.join(comp, placed.rep == comp.node, "left")
        out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
        return out.unionByName(nameless)
