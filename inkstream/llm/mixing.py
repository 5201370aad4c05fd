"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's words are one stream of blocks of `block` words.  A source of target t takes every block
floor(t / size) times, and of one more permutation of its blocks the first ones, down to a part of a block,
so that the words it takes are the rounded target.  The positions of all these draws are shared out among
output shards: a tree over the shards splits the sources' exact quotas by multivariate hypergeometric draws,
seeded by node, so a shard's ranges follow from the path to it alone.  Within a shard rows are put in the
order of a hash.  Everything follows from (seed, source, block), so reruns agree.

The mix is what the shards hold: `dealt` lists each shard's draws, `taken` sums them up by row, `shards_of` and
`mixed` put out their texts.

Null texts have size 0; a null source is a source of its own, in last place.  Documents of size 0 draw nothing.
Rows that share a doc_id, repeated rows among them, are rows of their own, each with its own place in the
stream; of equal rows it is open which has which place.  Ties of rank go by doc_id and place.  Very long texts
are many blocks and may go to many shards.  Further columns, whatever their names, are passed on by `mixed`.
A row per source reaches the driver and every task, which holds for up to some millions of sources.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .cluster import GROUP_BYTES, binary, buckets, lean, staged, tidy
from .words import U, mix

#: Up to so many sources their parameters are broadcast; beyond it they are joined by a shuffle.
_FEW = 100_000
#: Below it the library's generator of hypergeometric numbers, which is exact, is defined.
_LIBRARY = 10**9
#: Rows of one chunk of a source's stream, about.
_CHUNK = 200_000


def targets(sizes: list[int], weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets of sources in their order: weights repeat, `share` of all words in sum, `most` times the size at most."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, active, rest = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while active:
        total = sum(w[i] for i in active)
        over = [i for i in active if rest * w[i] / total > most * sizes[i]]
        if not over:
            for i in active:
                out[i] = rest * w[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        rest -= sum(out[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return out


class Permutation:
    """A keyed permutation of range(n): a Feistel network, walked until it lands inside."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = mix(np.arange(1, 7, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(key & (1 << 64) - 1))

    def _walk(self, x: np.ndarray, keys) -> np.ndarray:
        low, h = U((1 << self.half) - 1), U(self.half)
        x = x.astype(np.uint64)
        todo = np.arange(len(x))
        while len(todo):
            a, b = x[todo] >> h, x[todo] & low
            for k in keys:
                a, b = b, a ^ (mix(b + k) & low)
            x[todo] = b << h | a  # the halves are swapped at the end, so the same steps in reverse order undo it
            todo = todo[x[todo] >= U(self.n)]
        return x.astype(np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys[::-1])


def _log_factorial(n: int) -> Decimal:
    """ln n!, to about 40 digits: the product for small n, Stirling's series above."""
    if n < 200:
        out = 1
        for k in range(2, n + 1):
            out *= k
        return Decimal(out).ln()
    x, pi = Decimal(n), Decimal("3.14159265358979323846264338327950288419716939937510")
    out = (x + Decimal("0.5")) * x.ln() - x + (2 * pi).ln() / 2
    power = x
    for top, bottom in ((1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188), (-691, 360360), (1, 156), (-3617, 122400)):
        out += Decimal(top) / (Decimal(bottom) * power)
        power *= x * x
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many good ones are among `take` of good + bad; exact for numbers of any size.

    Above the library's range: ratio of uniforms under a table-mountain hat, with the logarithms of the
    probabilities in decimals that leave nothing to round."""
    total = good + bad
    least, most = max(0, take - bad), min(good, take)
    if least == most:
        return least
    if total < _LIBRARY:
        return int(rng.hypergeometric(good, bad, take))
    with localcontext() as c:
        c.prec = 60
        mean = Decimal(take) * good / total
        spread = (mean * bad / total * (total - take) / (total - 1) + Decimal("0.5")).sqrt()
        width = 2 * (Decimal(2) / Decimal(1).exp()).sqrt() * spread + 3 - 2 * (Decimal(3) / Decimal(1).exp()).sqrt()
        mode = (take + 1) * (good + 1) // (total + 2)
        weight = lambda k: _log_factorial(k) + _log_factorial(good - k) + _log_factorial(take - k) + _log_factorial(bad - take + k)
        top = weight(mode)
        while True:
            u, v = (Decimal(int(x)) / (1 << 63) for x in rng.integers(1, 1 << 63, 2))
            k = int((mean + Decimal("0.5") + width * (v - Decimal("0.5")) / u).to_integral_value("ROUND_FLOOR"))
            if least <= k <= most and 2 * u.ln() <= top - weight(k):
                return k


class SplittingTree:
    """Ranges of draw positions that each output shard gets of each source."""

    def __init__(self, quotas: list[int], shards: int, seed: int):
        self.quotas, self.shards, self.seed = np.array(quotas, np.int64), shards, seed
        self.known: dict[tuple[int, int], np.ndarray] = {}

    def _left(self, lo: int, hi: int, counts: np.ndarray) -> np.ndarray:
        """How many draws of each source the left half of shards lo to hi gets."""
        if (lo, hi) not in self.known:
            rng = np.random.Generator(np.random.PCG64([self.seed, lo, hi]))
            total, mid = int(counts.sum()), (lo + hi) // 2
            take = (total * (mid - lo) + (hi - lo) // 2) // (hi - lo)
            out = np.zeros_like(counts)
            for i, good in enumerate(counts.tolist()):
                out[i] = hypergeometric(rng, good, total - good, take)
                take -= int(out[i])
                total -= good
            self.known[lo, hi] = out
        return self.known[lo, hi]

    def quota(self, shard: int) -> np.ndarray:
        """The draws of each source that a shard gets: the path from the root to it."""
        lo, hi, counts = 0, self.shards, self.quotas
        while hi - lo > 1:
            left, mid = self._left(lo, hi, counts), (lo + hi) // 2
            lo, hi, counts = (lo, mid, left) if shard < mid else (mid, hi, counts - left)
        return counts

    def shard(self, source: int, position: np.ndarray) -> np.ndarray:
        """The shard of each draw position of a source."""
        out = np.zeros(len(position), np.int64)
        todo = [(0, self.shards, self.quotas, np.arange(len(position)), position)]
        while todo:
            lo, hi, counts, at, p = todo.pop()
            if not len(at):
                continue
            if hi - lo == 1:
                out[at] = lo
                continue
            left = self._left(lo, hi, counts)
            go = p < left[source]
            mid = (lo + hi) // 2
            todo += [(lo, mid, left, at[go], p[go]), (mid, hi, counts - left, at[~go], p[~go] - left[source])]
        return out


def source_plan(size: int, target: float, block: int, key: int) -> tuple[int, int, int, int]:
    """(blocks, times every block is taken, whole blocks drawn besides, words of the next one)."""
    n = -(-size // block)
    if not n:
        return 0, 0, 0, 0
    times, words = divmod(round(target), size)
    q, rem = divmod(words, block)
    short = n * block - size
    if short and int(Permutation(n, key + times).inverse(np.array([n - 1]))[0]) < q:  # the short last block is among those drawn
        rem += short
        q, rem = q + rem // block, rem % block
    return n, times, q, rem


class Mixing:
    def __init__(self, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 128, seed: int = 17, shards: int | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source"):
        self.weights, self.share, self.most, self.block, self.seed, self.shards = weights, share, most, block, seed, shards
        self.doc_id, self.text, self.source = doc_id, text, source

    def _key(self, index: int) -> int:
        return (self.seed << 40) + (index << 8)

    def _placed(self, documents: DataFrame, keep: str | None = None) -> tuple[DataFrame, list[int], int]:
        """((doc_id, source, size, its source's parameters, at; keep), quotas, shards): at is the row's first word in its source's stream."""
        spark, block = documents.sparkSession, self.block
        kept = [keep] if keep else []

        def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                n = [len((t or b"").split()) for t in binary(b["text"])]
                yield pa.record_batch({"doc_id": b["doc_id"], "source": b["source"], "size": pa.array(n, pa.int64()), "tie": b["tie"]} | {c: b[c] for c in kept})

        text = F.col(self.text).cast("string")
        docs = documents.select(F.col(self.doc_id).cast("long").alias("doc_id"), F.col(self.source).cast("string").alias("source"), text.alias("text"), F.xxhash64(text).alias("tie"), *kept)
        sized = staged(docs.mapInArrow(lean(measure), "doc_id long, source string, size long, tie long" + "".join(f", {c} long" for c in kept)))
        chunks = 4 * buckets(spark, sized.count() * GROUP_BYTES // _CHUNK)
        sized = sized.withColumn("chunk", F.expr(f"pmod(xxhash64(doc_id), {chunks})"))
        totals = staged(sized.groupBy("source", "chunk").agg(F.sum("size").alias("size")))
        sums = totals.groupBy("source").agg(F.sum("size").alias("size")).collect()  # a row per source
        order = sorted(sums, key=lambda r: (r.source is None, r.source or ""))
        goal = targets([r["size"] for r in order], self.weights, self.share, self.most)
        rows, quotas = [], []
        for i, (r, t) in enumerate(zip(order, goal, strict=True)):
            n, times, q, rem = source_plan(r["size"], t, block, self._key(i))
            rows.append((r.source, i, r["size"], t, n, times, q, rem))
            quotas.append(n * times + q + (rem > 0))
        params = spark.createDataFrame(rows, "source string, place long, source_size long, target double, n long, times long, q long, rem long")
        params = F.broadcast(params) if len(rows) <= _FEW else params
        before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        bases = totals.select("source", "chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("source", "chunk").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
        placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        same = lambda a, b: a["source"].eqNullSafe(b["source"])
        placed = placed.join(bases, same(placed, bases) & (placed["chunk"] == bases["chunk"])).select(placed["source"], "doc_id", "size", F.expr("base + inside").alias("at"), *kept)
        placed = placed.join(params, same(placed, params)).select("doc_id", placed["source"], "size", "source_size", "target", "at", "place", "n", "times", "q", "rem", *kept)
        return placed, quotas, self.shards or buckets(spark, sum(quotas) * block * 8)

    def _drawn(self, placed: DataFrame, quotas: list[int], shards: int, keep: tuple[str, ...]) -> DataFrame:
        """(shard, rank, copy, start, length; keep) per draw: where the tree and the permutations put each row's blocks."""
        key, seed, block = self._key, self.seed, self.block

        def draw(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = SplittingTree(quotas, shards, seed)
            for b in it:
                c = {x: b[x].to_numpy(zero_copy_only=False) for x in ("size", "at", "place", "n", "times", "q", "rem")}
                for place in np.unique(c["place"]).tolist():
                    rows = np.flatnonzero((c["place"] == place) & (c["size"] > 0))
                    if not len(rows):
                        continue
                    n, times, q, rem = (int(c[x][rows[0]]) for x in ("n", "times", "q", "rem"))
                    lo, hi = c["at"][rows], c["at"][rows] + c["size"][rows]
                    many = (hi - 1) // block - lo // block + 1
                    row = np.repeat(np.arange(len(rows)), many)
                    blk = (lo // block)[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    start = np.maximum(blk * block, lo[row])
                    for epoch in range(times + (q + rem > 0)):
                        pos = Permutation(n, key(place) + epoch).inverse(blk)
                        end = np.minimum((blk + 1) * block, hi[row])
                        if epoch == times:
                            end = np.where(pos < q, end, np.where(pos == q, np.minimum(blk * block + rem, end), start))
                        go = np.flatnonzero(end > start)
                        p = pos[go] + n * epoch
                        rank = mix(p.astype(np.uint64) * U(2654435761) + U(key(place))).view(np.int64)
                        t = b.take(pa.array(rows[row[go]]))
                        yield pa.record_batch({"shard": pa.array(tree.shard(place, p)), "rank": pa.array(rank), "copy": pa.array(np.full(len(go), epoch, np.int64)), "start": pa.array((start - lo[row])[go]), "length": pa.array((end - start)[go])} | {x: t[x] for x in keep})

        kinds = dict(placed.dtypes)
        return placed.mapInArrow(lean(draw), "shard long, rank long, copy long, start long, length long" + "".join(f", {x} {kinds[x]}" for x in keep))

    @tidy
    def dealt(self, documents: DataFrame) -> DataFrame:
        """(shard, rank, doc_id, source, copy, start, length): the draws of every shard.  Words start to start + length
        of the document go into the shard, which is ordered by rank."""
        placed, quotas, shards = self._placed(documents)
        return self._drawn(placed, quotas, shards, ("doc_id", "source"))

    @tidy
    def taken(self, documents: DataFrame) -> DataFrame:
        """(doc_id, source, size, source_size, target, taken, draws, shards) per row: the words and the draws of it that
        the shards hold, and how many shards hold some."""
        placed, quotas, n = self._placed(documents.withColumn("__mix_row", F.monotonically_increasing_id()), "__mix_row")
        placed = staged(placed)
        held = self._drawn(placed, quotas, n, ("__mix_row",)).groupBy("__mix_row", "shard").agg(F.sum("length").alias("words"), F.count("*").alias("draws"))
        held = held.groupBy("__mix_row").agg(F.sum("words").alias("taken"), F.sum("draws").alias("draws"), F.count("*").alias("shards"))
        none = F.lit(0).cast("long")
        return placed.join(held, "__mix_row", "left").select("doc_id", "source", "size", "source_size", "target", *(F.coalesce(x, none).alias(x) for x in ("taken", "draws", "shards")))

    @tidy
    def shards_of(self, documents: DataFrame) -> DataFrame:
        """(shard, rank, doc_id, text): the drawn blocks, each shard together and in its shuffled order."""
        rows = staged(documents.select(F.col(self.doc_id).cast("long").alias("doc_id"), F.col(self.source).alias("source"), F.col(self.text).cast("string").alias("text")).withColumn("__mix_row", F.monotonically_increasing_id()))
        placed, quotas, n = Mixing(self.weights, self.share, self.most, self.block, self.seed, self.shards)._placed(rows, "__mix_row")
        draws = self._drawn(placed, quotas, n, ("__mix_row",))
        words = rows.select("__mix_row", "doc_id", F.expr(r"regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)").alias("w"))
        text = F.expr("array_join(slice(w, CAST(start + 1 AS INT), CAST(length AS INT)), ' ')")
        out = draws.join(words, "__mix_row").select(F.col("shard").cast("int").alias("shard"), "rank", "doc_id", text.alias("text"))
        return out.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "rank", "doc_id")

    @tidy
    def mixed(self, documents: DataFrame) -> DataFrame:
        """The documents' rows as the mix takes them, one per copy, with all columns: the whole text, or the
        words of the blocks that the copy takes joined by one space.  A copy goes to the shard and the rank of
        the first block that it takes; each shard is together and in the order of rank."""
        text, doc_id, schema = self.text, self.doc_id, documents.schema
        rows = staged(documents.withColumn("__mix_row", F.monotonically_increasing_id()))
        placed, quotas, n = self._placed(rows, "__mix_row")
        place = F.struct("copy", "start", "length", "shard", "rank")
        draws = self._drawn(placed, quotas, n, ("__mix_row", "size")).groupBy("__mix_row").agg(F.first("size").alias("__mix_size"), F.sort_array(F.collect_list(place)).alias("__mix_draws"))  # a row's own blocks

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                at, texts, shard, rank = [], [], [], []
                whole = binary(b[text])
                for i, (t, size, draws) in enumerate(zip(whole, b["__mix_size"].to_pylist(), b["__mix_draws"].to_pylist(), strict=True)):
                    copies: dict[int, list[dict]] = {}
                    for d in draws:
                        copies.setdefault(d["copy"], []).append(d)
                    words = None
                    for parts in copies.values():
                        at.append(i)
                        shard.append(parts[0]["shard"])
                        rank.append(parts[0]["rank"])
                        if sum(d["length"] for d in parts) == size:
                            texts.append(t)
                        else:
                            words = words or (t or b"").split()
                            texts.append(b" ".join(w for d in parts for w in words[d["start"] : d["start"] + d["length"]]))
                out = b.take(pa.array(at, pa.int64()))
                new = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.record_batch({f.name: new if f.name == text else out[f.name] for f in schema} | {"__mix_shard": pa.array(shard, pa.int32()), "__mix_rank": pa.array(rank, pa.int64())})

        out = StructType([*schema, StructField("__mix_shard", IntegerType()), StructField("__mix_rank", LongType())])
        dealt = rows.join(draws, "__mix_row").mapInArrow(lean(run), out).repartitionById(n, F.col("__mix_shard"))
        return dealt.sortWithinPartitions("__mix_shard", "__mix_rank", doc_id).select(*documents.columns)
