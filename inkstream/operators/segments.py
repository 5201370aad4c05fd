"""A search index of segments: batches append small sorted segments, reads merge them, compaction rewrites them.

A segment holds rows (what hits are filtered and scored by, and the row's words in order as one string), blocks of
postings, which name a row by its number, a dictionary of how many rows hold a word or a beginning of words, and `gone`,
the uris whose earlier rows it hides.
Dictionary entries are differences: a batch subtracts what it hides, so sums over the segments are exact and a query of
the segments equals one of an index built anew.  What a batch writes follows from the batch alone.  A manifest names the
segments; it is created, never overwritten, so of two writers one fails and readers keep the version they opened.

Postings are cut into blocks where their rows are: a task takes a run of them, orders those of a word by what they can
come to in a score, the word's weight less the row's prior (its age), and cuts blocks with bounds: the largest count, the
shortest row, the least prior.  A batch moves texts once, and neither it nor a compaction moves postings: a compaction
cuts them anew from the words of the rows that are left, where these lie.  What it needs to know of hidden rows are their
numbers.  A query for the best K first reads the best blocks, which bounds the K-th score, and then only blocks with a
row that could reach it.  A row of a block that is passed over cannot be among the best, whatever it holds elsewhere, so
the result is exact."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.query_text import Parsed, parse_query
from ..sources import store
from .postings import K1, SearchIndex, inverted, spaced, token_words
from .postings import B as DAMP

#: Postings of a block.
BLOCK = 256
#: Postings of a run, within which those of a word are ordered.
HOT = 1_000_000
#: Letters up to which beginnings are counted; the rows of longer ones are counted from their postings.
BEGIN = 24
#: Rows of a query's words up to which all of them are read at once.
FEW = 4_096
#: Rows of a segment have numbers below 2 to this power; above it is the place of the segment.
SEG = 52


def listed(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Batches with their words, `t`, as a list."""
    for b in batches:
        yield b.set_column(b.schema.get_field_index("t"), name, pc.split_pattern(b["t"], " "))


def blocked(block: int, most: int, kept: tuple[str, ...] = ("uri", "dl", "tf", "at")) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of the postings (term, kept, dl, prior, tf) of a task, in runs sorted by term."""

    def run(t: pa.Table, name: str) -> Iterator[pa.RecordBatch]:
        terms = t["term"].combine_chunks().dictionary_encode()
        word, n = terms.indices.to_numpy(), len(t)
        dl, prior, tf = (t[c].to_numpy().astype(np.float64) for c in ("dl", "prior", "tf"))
        df = np.bincount(word)
        weight = np.maximum(np.log((df.max() - df + 0.5) / (df + 0.5)), 1e-6)[word]
        top = (K1 + 1) * tf / (tf + K1 * (1 - DAMP + DAMP * dl / max(dl.mean(), 1.0))) * weight - prior
        by_text = np.empty(len(df), np.int64)
        by_text[pc.sort_indices(terms.dictionary).to_numpy()] = np.arange(len(df))
        best = (-top).astype(np.float32).view(np.int32).astype(np.int64)
        order = np.argsort((by_text[word] << 32) + np.where(best < 0, -(best & 0x7FFFFFFF), best))
        word = word[order]
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        place = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
        first = np.flatnonzero(place % block == 0)
        posts = pa.StructArray.from_arrays([t[c].combine_chunks().take(pa.array(order)) for c in kept], kept)
        out = pa.table({
            "term": terms.dictionary.take(pa.array(word[first])),
            "block": pa.array([f"{name}-{i}" for i in (place[first] // block).tolist()]),
            "max_tf": np.maximum.reduceat(tf[order], first).astype(np.int32),
            "min_dl": np.minimum.reduceat(dl[order], first).astype(np.int32),
            "min_prior": np.minimum.reduceat(prior[order], first),
            "rows": np.diff(np.r_[first, n]),
            "posts": pa.ListArray.from_arrays(pa.array(np.r_[first, n].astype(np.int32)), posts),
        })
        yield from out.to_batches(2_000)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, held, n, runs = context.partitionId() if context else 0, [], 0, 0
        for b in batches:
            for lo in range(0, b.num_rows, most):
                held.append(b.slice(lo, most))
                n += held[-1].num_rows
                if n >= most:
                    yield from run(pa.Table.from_batches(held), f"{part}-{runs}")
                    held, n, runs = [], 0, runs + 1
        if n:
            yield from run(pa.Table.from_batches(held), f"{part}-{runs}")

    return task


def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, shared, n) by text: how many rows (terms, by) hold a word, each weighed by `by`, where `shared` is how many letters the
    word has in common with the one before it among the row's words in order, up to BEGIN."""
    for b in batches:
        words = pc.list_flatten(b["terms"]).dictionary_encode()
        if not len(words):
            continue
        by_text = pc.sort_indices(words.dictionary)
        texts = words.dictionary.take(by_text)
        place = np.empty(len(texts), np.int64)
        place[by_text.to_numpy()] = np.arange(len(texts))
        size = pc.list_value_length(b["terms"]).to_numpy(zero_copy_only=False).astype(np.int64)
        pair = np.sort(np.repeat(np.arange(len(size)), size) * len(texts) + place[words.indices.to_numpy()])
        pair = pair[np.r_[True, pair[1:] != pair[:-1]]]
        row, word = np.divmod(pair, len(texts))
        # Two words share the least of what the neighbours between them share: least[k] has it for 2 ** k neighbours on.
        least = [alike(texts).astype(np.int8)]
        while 2 ** len(least) < len(texts):
            last, half = least[-1], 2 ** (len(least) - 1)
            least.append(np.minimum(last, np.r_[last[half:], np.zeros(min(half, len(last)), np.int8)]))
        shared, after = np.zeros(len(pair), np.int64), np.flatnonzero(row[1:] == row[:-1]) + 1
        lo, hi = word[after - 1] + 1, word[after]
        k = np.log2(hi - lo + 1).astype(np.int64)
        shared[after] = np.minimum(np.stack(least)[k, lo], np.stack(least)[k, hi + 1 - (1 << k)])
        key, row = np.divmod(np.sort((word * (BEGIN + 1) + shared) * len(size) + row), len(size))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.add.reduceat(b["by"].to_numpy().astype(np.int64)[row], first)
        yield pa.record_batch({"text": texts.take(pa.array(key[first] // (BEGIN + 1))), "shared": pa.array((key[first] % (BEGIN + 1)).astype(np.int32)), "n": pa.array(n)})


def alike(words: pa.Array) -> np.ndarray:
    """How many first letters, up to BEGIN, each word has in common with the one before it; 0 for the first."""
    letters = words.to_numpy(zero_copy_only=False).astype(f"U{BEGIN}").view(np.uint32).reshape(-1, BEGIN)
    differs = letters[1:] != letters[:-1]
    return np.r_[0, np.where(differs.any(axis=1), differs.argmax(axis=1), BEGIN)]


def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, begins, df) of (text, shared, n) by text: how many rows hold a word, or a beginning of words.

    A word begins in those ways new to its row that are longer than what it shares.  What spans batches comes in parts."""
    for b in batches:
        if not b.num_rows:
            continue
        words = b["text"].dictionary_encode()
        texts = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = words.indices.to_numpy().astype(np.int64) * (BEGIN + 1) + b["shared"].to_numpy()
        new = np.bincount(at, weights=b["n"].to_numpy().astype(np.float64), minlength=len(texts) * (BEGIN + 1)).reshape(len(texts), BEGIN + 1).cumsum(axis=1).astype(np.int64)
        same, size = alike(words.dictionary), np.array([len(w) for w in texts])
        out, df = list(texts), [new[:, BEGIN]]
        for k in range(1, BEGIN + 1):
            some = np.flatnonzero(size >= k)
            if not len(some):
                break
            first = np.flatnonzero(np.r_[True, same[some[1:]] < k])
            out += [texts[i][:k] for i in some[first].tolist()]
            df.append(np.add.reduceat(new[some, k - 1], first))
        yield pa.record_batch({"text": pa.array(out, pa.string()), "begins": pa.array(np.arange(len(out)) >= len(texts)), "df": pa.array(np.concatenate(df))})


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, begins, df) of each batch of rows (terms, by)."""
    return begun(shares(batches))


_BLOCKS = "term string, block string, max_tf int, min_dl int, min_prior double, rows long, posts array<struct<doc: long, tf: int, at: array<int>>>"


@dataclass
class Manifest:
    version: int = 0
    segments: list[dict] = field(default_factory=list)
    batches: list[str] = field(default_factory=list)
    n: int = 0
    dl: int = 0


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The latest version, or an empty one."""
    at, fs = _files(spark, f"{path}/_manifest")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    last = max((x for x in names if x.endswith(".json")), default=None)
    return Manifest(**json.loads(store.read_text(spark, f"{path}/_manifest/{last}"))) if last else Manifest()


def commit(spark: SparkSession, path: str, m: Manifest) -> None:
    """Creates the next version; it fails if another writer has created it."""
    at, fs = _files(spark, f"{path}/_manifest/{m.version:08d}.json")
    out = fs.create(at, False)
    out.write(bytearray(json.dumps(m.__dict__).encode()))
    out.close()


def numbered(doc: str) -> Column:
    """The number of a row of a segment as one among all segments."""
    return F.shiftleft(F.col("seg").cast("long"), SEG) + F.col(doc)


class SegmentIndex(SearchIndex):
    """The index in a folder, at the version that was latest when it was opened.

    text is the indexed expression, columns the further ones of rows, prior an expression that is added to scores."""

    def __init__(self, spark: SparkSession, path: str, text: str, columns: list[str], prior: str = "0D"):
        self.spark, self.path, self.text, self.columns, self.prior = spark, path, text, columns, prior
        self.open()

    def open(self) -> SegmentIndex:
        self.manifest = manifest(self.spark, self.path)
        if self.manifest.segments:
            read = lambda name: [(i, self.spark.read.parquet(f"{self.path}/{s['folder']}/{name}")) for i, s in enumerate(self.manifest.segments)]
            union = lambda parts: reduce(DataFrame.unionByName, [df.withColumn("seg", F.lit(i)) for i, df in parts])
            self._rows, self.blocks, self.words, self.gone = (union(read(x)) for x in ("rows", "blocks", "words", "gone"))
            self._rows = self._rows.withColumn("doc", numbered("doc"))
            self.rows = self.live(self._rows).drop("seg", "t")
            self.postings = self.posted(self.blocks, "tf", "at").join(self.rows.select("doc", "dl"), "doc")
            mean = self.manifest.dl / self.manifest.n if self.manifest.n else None
            self.stats = self.spark.range(1).select(F.lit(self.manifest.n).cast("long").alias("n"), F.lit(mean).cast("double").alias("a"))
        return self

    def live(self, df: DataFrame) -> DataFrame:
        """Those of (seg, uri, ...) that no later segment hides."""
        if len(self.manifest.segments) < 2:
            return df
        last = self.gone.groupBy("uri").agg(F.max("seg").alias("hidden"))
        return df.join(last, "uri", "left").where("hidden IS NULL OR hidden <= seg").drop("hidden")

    def dead(self, first: int) -> DataFrame:
        """(doc) of the rows of the segments from `first` on that a later segment hides."""
        last = self.gone.groupBy("uri").agg(F.max("seg").alias("hidden"))
        return self._rows.where(F.col("seg") >= first).select("seg", "uri", "doc").join(last, "uri").where("hidden > seg").select("doc")

    def posted(self, blocks: DataFrame, *columns: str) -> DataFrame:
        """(term, doc, columns) of the postings of some blocks, those of hidden rows included."""
        posts = blocks.select("seg", "term", F.explode("posts").alias("p"))
        return posts.select("term", numbered("p.doc").alias("doc"), *[f"p.{c}" for c in columns])

    # ---- writing

    def apply(self, batch: str, docs: DataFrame, deleted: DataFrame | None = None) -> SegmentIndex:
        """Adds docs (one row a uri) and hides what they and `deleted` (uri) replace; a batch applied before changes nothing."""
        m = manifest(self.spark, self.path)
        if batch in m.batches:
            return self.open()
        self.open()
        folder = f"seg-{uuid.uuid4().hex}"
        at = f"{self.path}/{folder}"
        own = [c for c in self.columns if c != "uri"]
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        said = docs.select("uri", *own, F.expr(self.prior).cast("double").alias("prior"), F.expr(self.text).alias("_s"))
        if len(docs.inputFiles()) < 2 * self.spark.sparkContext.defaultParallelism:  # a table may be one large file; many are read where they lie
            said = said.repartition(n, "uri")
        dl = F.when(F.col("t") == "", 0).otherwise(F.length("t") - F.length(F.replace("t", F.lit(" "))) + 1)
        self._write_rows(at, said.withColumn("t", spaced("coalesce(_s, '')")).drop("_s").withColumn("dl", dl))
        rows = self.spark.read.parquet(f"{at}/rows")
        gone = rows.select("uri") if deleted is None else rows.select("uri").unionByName(deleted.select("uri")).distinct()
        gone.sortWithinPartitions("uri").write.parquet(f"{at}/gone")
        if self.manifest.segments:
            gone = self.spark.read.parquet(f"{at}/gone")
            hides = self.live(self._rows.select("seg", "uri", "doc")).join(gone, "uri", "left_semi")
            hidden = self._rows.join(self._listed(at, "hidden", hides), "doc", "left_semi").select("dl", "t")
        else:
            hidden = rows.limit(0).select("dl", "t")
        self._write_words(at, rows, hidden)
        self._write_blocks(at)
        counts = [F.count_if(F.col("dl") > 0), F.coalesce(F.sum("dl"), F.lit(0).cast("long")), F.count("*")]
        plus, minus = rows.agg(*counts).first(), hidden.agg(*counts).first()
        store.delete(self.spark, f"{at}/hidden")
        self._commit(m, [*m.segments, {"folder": folder, "rows": plus[2]}], [*m.batches, batch], m.n + plus[0] - minus[0], m.dl + plus[1] - minus[1])
        return self.open()

    def _commit(self, m: Manifest, segments: list[dict], batches: list[str], n: int, dl: int) -> None:
        commit(self.spark, self.path, Manifest(m.version + 1, segments, batches, n, dl))

    def _listed(self, at: str, name: str, docs: DataFrame) -> DataFrame:
        """Numbers of rows as a table of their own: it is small, and what is joined with it need not move."""
        docs.select("doc").sortWithinPartitions("doc").write.option("compression", "zstd").parquet(f"{at}/{name}")
        return self.spark.read.parquet(f"{at}/{name}")

    def _write_rows(self, at: str, rows: DataFrame) -> None:
        """(doc, uri, columns, prior, t, dl): rows with numbers."""
        rows.select(F.monotonically_increasing_id().alias("doc"), *rows.columns).write.option("compression", "zstd").parquet(f"{at}/rows")

    def _write_words(self, at: str, rows: DataFrame, hidden: DataFrame) -> None:
        """(text, begins, df): in how many more rows a word, or a beginning of words, stands than before."""
        both = rows.where("dl > 0").select("t", F.lit(1).alias("by")).unionByName(hidden.where("dl > 0").select("t", F.lit(-1).alias("by")))
        words = both.mapInArrow(lambda b: shares(listed(b, "terms")), "text string, shared int, n long").groupBy("text", "shared").agg(F.sum("n").alias("n")).where("n <> 0")
        words = words.repartitionByRange("text").sortWithinPartitions("text").mapInArrow(begun, "text string, begins boolean, df long")
        self._store_words(at, words.where("df <> 0"))

    def _store_words(self, at: str, words: DataFrame) -> None:
        words.sortWithinPartitions("text").write.option("parquet.page.row.count.limit", 2000).option("compression", "zstd").parquet(f"{at}/words")

    def _write_blocks(self, at: str) -> None:
        invert, cut = inverted(["doc", "dl", "prior"]), blocked(BLOCK, HOT, ("doc", "tf", "at"))
        rows = self.spark.read.parquet(f"{at}/rows").where("dl > 0").select("doc", "dl", "prior", "t")
        blocks = rows.mapInArrow(lambda b: cut(invert(listed(b, "_t"))), _BLOCKS)
        blocks.write.option("parquet.page.row.count.limit", 512).option("compression", "zstd").parquet(f"{at}/blocks")

    def compact(self, first: int = 0) -> SegmentIndex:
        """The segments from `first` on as one; folders that only older versions name stay until `vacuum`."""
        m = self.open().manifest
        old = m.segments[first:]
        if len(old) < 2:
            return self
        folder = f"seg-{uuid.uuid4().hex}"
        at, late = f"{self.path}/{folder}", F.col("seg") >= first
        rows = self._rows.where(late).join(self._listed(at, "hidden", self.dead(first)), "doc", "left_anti")
        self._write_rows(at, rows.drop("doc", "seg"))
        store.delete(self.spark, f"{at}/hidden")
        gone = self.gone.where(late).select("uri").distinct() if first else self.gone.limit(0).select("uri")
        gone.sortWithinPartitions("uri").write.parquet(f"{at}/gone")
        words = self.words.where(late).select("text", "begins", "df").repartitionByRange("text").groupBy("text", "begins").agg(F.sum("df").alias("df"))
        self._store_words(at, words.where("df <> 0"))
        self._write_blocks(at)
        kept = self.spark.read.parquet(f"{at}/rows").count()
        self._commit(m, [*m.segments[:first], {"folder": folder, "rows": kept}], m.batches, m.n, m.dl)
        return self.open()

    def due(self, fanout: int = 4) -> int | None:
        """From which segment on to compact, so that each is `fanout` times as large as all later ones; None: not now."""
        sizes = [s["rows"] for s in self.manifest.segments]
        at, total = len(sizes) - 1, sizes[-1] if sizes else 0
        while at > 0 and sizes[at - 1] < fanout * max(total, 1):
            at, total = at - 1, total + sizes[at - 1]
        return at if at < len(sizes) - 1 else None

    def vacuum(self) -> None:
        """Deletes folders that the latest version does not name, those of writers that failed included."""
        named = {s["folder"] for s in manifest(self.spark, self.path).segments}
        at, fs = _files(self.spark, self.path)
        for s in fs.listStatus(at):
            if s.getPath().getName().startswith("seg-") and s.getPath().getName() not in named:
                fs.delete(s.getPath(), True)

    # ---- reading

    def _groups(self, q: Parsed) -> list[tuple[str, bool]] | None:
        """(word, whether it is a beginning) of a query of bare words; None for one that is read as a whole."""
        words = [token_words(t) for t in q.terms]
        if q.phrases or not words or any(len(w) != 1 for w in words) or any(t.prefix and len(w[0]) > BEGIN for w, t in zip(words, q.terms, strict=True)):
            return None
        return [(w[0], t.prefix) for w, t in zip(words, q.terms, strict=True)]

    def _bounds(self, groups: list[tuple[str, bool]]) -> tuple[list[float], int]:
        """Weight of each word, and how many rows hold them in all."""
        texts = [(F.col("text") == w) & (F.col("begins") == p) for w, p in dict.fromkeys(groups)]
        found = self.words.where(reduce(lambda a, b: a | b, texts)).groupBy("text", "begins").agg(F.sum("df").alias("df")).collect()
        df = {(r.text, r.begins): r.df for r in found}
        n = self.manifest.n
        return [max(math.log((n - df.get(g, 0) + 0.5) / (df.get(g, 0) + 0.5)), 1e-6) for g in groups], sum(df.values())

    def _reach(self, groups: list[tuple[str, bool]], weights: list[float], mean: float) -> Column:
        """The best score that a row of a block can have: a bound of this word, and of the others all they can come to."""
        out = F.lit(None).cast("double")
        for i, (w, begins) in enumerate(groups):
            hit = F.col("term").startswith(w) if begins else F.col("term") == w
            most = F.lit(1.0) if begins else F.expr(f"max_tf / (max_tf + {K1}D * ({1 - DAMP}D + {DAMP}D * min_dl / {mean}D))")
            others = sum(x for k, x in enumerate(weights) if k != i) * (K1 + 1)
            best = F.col("min_prior") - F.lit(weights[i] * (K1 + 1)) * most - F.lit(others)
            out = F.least(out, F.when(hit, best))
        return out

    def _ranked(self, rows: DataFrame, blocks: DataFrame, groups: list[tuple[str, bool]], weights: list[float], mean: float) -> DataFrame:
        """Those of some rows that some blocks name, with their rank by what these blocks hold."""
        sums = [F.sum(F.when(F.col("term").startswith(w) if p else F.col("term") == w, F.col("tf")).otherwise(0)).alias(f"f{i}") for i, (w, p) in enumerate(groups)]
        found = self.posted(blocks, "tf").groupBy("doc").agg(*sums)
        part = lambda i: f"CASE WHEN f{i} > 0 THEN {weights[i]!r}D * f{i} * {K1 + 1}D / (f{i} + {K1}D * ({1 - DAMP}D + {DAMP}D * dl / {mean!r}D)) ELSE 0D END"
        rank = "round(-(" + " + ".join(part(i) for i in range(len(groups))) + "), 6)"
        return rows.join(found, "doc").withColumn("rank", F.expr(rank)).drop(*(f"f{i}" for i in range(len(groups))))

    def candidates(self, query: str | Parsed, k: int, kept: Column | None = None, tags: DataFrame | None = None) -> DataFrame:
        """(rows' columns, rank) among which are the best k by rank + prior, of the rows that `kept` keeps.

        Queries with phrases, and those of few rows, are read whole."""
        q = parse_query(query) if isinstance(query, str) else query
        groups = self._groups(q)
        if groups is None or not self.manifest.n:
            return super().candidates(q, k, kept, tags)
        rows = self._kept(kept, tags)
        weights, many = self._bounds(groups)
        mean = self.manifest.dl / self.manifest.n
        held = self.terms_of(groups)
        if many > FEW:
            bound = self._kth(held, rows, groups, weights, mean, k)
            if bound is not None:
                held = held.where(self._reach(groups, weights, mean) <= bound + 1e-5)
        return self._ranked(rows, held, groups, weights, mean)

    def terms_of(self, groups: list[tuple[str, bool]]) -> DataFrame:
        return self.blocks.where(reduce(lambda a, b: a | b, [F.col("term").startswith(w) if p else F.col("term") == w for w, p in groups]))

    def _kth(self, held: DataFrame, rows: DataFrame, groups: list, weights: list[float], mean: float, k: int) -> float | None:
        """A bound of the k-th best score: the k-th best of the rows of the best blocks, by what these alone hold."""
        some = 4 * k // BLOCK + 4
        first = held.select("seg", "term", "block", self._reach(groups, weights, mean).alias("reach")).orderBy("reach").limit(some).collect()
        if not first:
            return None
        at = reduce(lambda a, b: a | b, [(F.col("seg") == r.seg) & (F.col("term") == r.term) & (F.col("block") == r.block) for r in first])
        best = self._ranked(rows, held.where(at), groups, weights, mean)
        top = best.select((F.col("rank") + F.col("prior")).alias("score")).orderBy("score").limit(k).agg(F.max("score").alias("s"), F.count("*").alias("n")).first()
        return top.s if top.n == k else None

    def read_share(self, query: str, k: int) -> tuple[int, int]:
        """(blocks that `candidates` reads, blocks of the query's words), without filters."""
        groups = self._groups(parse_query(query))
        weights, many = self._bounds(groups)
        mean, held = self.manifest.dl / self.manifest.n, self.terms_of(groups)
        bound = self._kth(held, self.rows, groups, weights, mean, k) if many > FEW else None
        return (held if bound is None else held.where(self._reach(groups, weights, mean) <= bound + 1e-5)).count(), held.count()
