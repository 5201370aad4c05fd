"""A stored inverted index, and queries over it.

postings(term, doc, dl, tf, at) lies in runs sorted by term, some for each part of the rows, so that a common term
spreads over files and a query reads only the pages of its terms; a prefix is a range of them.  A row is a task's own
from its text to its postings: the build moves each text once and no posting.  rows(doc, uri, dl, ...) holds what hits
are filtered, scored and shown by, without the texts; doc is a number of the index's own.  stats(n, a) counts the rows
with tokens and their mean length.  The index is built once for each state of its sources."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.query_text import Parsed, Term, parse_query
from ..sources import store

K1, B = 1.2, 0.75
#: Tokens of a sorted run of postings, at most, but for a row that holds more.
RUN = 2_000_000


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Letters with marks and what they are without; the marks themselves come last and go away."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for r in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(*r)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(d for _, d in pairs)


def _folded(text: str) -> Column:
    marked, plain = _folding()
    return F.translate(F.lower(F.expr(text)), marked, plain)


def tokens(text: str) -> Column:
    """Lower-case runs of letters and digits without diacritics."""
    return F.regexp_extract_all(_folded(text), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def spaced(text: str) -> Column:
    """The same, in order, with a space between two."""
    return F.trim(F.regexp_replace(_folded(text), r"[^\p{L}\p{N}\p{Co}]+", " "))


def folded_words(text: str) -> list[str]:
    """The same for a query's own text."""
    marked, plain = _folding()
    table = {ord(c): plain[i] if i < len(plain) else None for i, c in enumerate(marked)}
    return re.findall(r"[^\W_]+", text.lower().translate(table))


def token_words(term: Term) -> list[str]:
    return folded_words(" ".join(term.words))


def inverted(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, *keys, tf, at) of rows (*keys, _t: tokens in order), in runs sorted by term."""

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        words = pc.list_flatten(rows["_t"]).combine_chunks()
        words = words.dictionary_encode()
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        size = pc.list_value_length(rows["_t"]).to_numpy().astype(np.int64)
        n, m = len(words), len(size)
        if not n:
            return
        sorted_ = pc.sort_indices(words.dictionary).to_numpy()
        place = np.empty(len(sorted_), np.int64)
        place[sorted_] = np.arange(len(sorted_))
        word, order = np.divmod(np.sort(place[words.indices.to_numpy()] * n + np.arange(n)), n)  # tokens lie row by row
        of = np.repeat(np.arange(m), size)[order]
        first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (of[1:] != of[:-1])])
        ends = np.r_[first, n]
        at = (order - (np.cumsum(size) - size)[of]).astype(np.int32)
        row = pa.array(of[first])
        said = {k: rows[k].combine_chunks().take(row) for k in keys}
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at))
        out = pa.table({"term": words.dictionary.take(pa.array(sorted_[word[first]])), **said, "tf": np.diff(ends).astype(np.int32), "at": lists})
        yield from out.to_batches(20_000)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            sizes = np.cumsum(pc.list_value_length(b["_t"]).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < b.num_rows:
                before = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, before + RUN - n, side="right")))
                held.append(b.slice(lo, hi - lo))
                n, lo = n + int(sizes[hi - 1] - before), hi
                if n >= RUN or lo < b.num_rows:
                    yield from run(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            yield from run(pa.Table.from_batches(held))

    return task


def _earlier(k: int):
    return lambda place: place - k


#: Indexes that this driver has opened, by their folder, which names the application.
_open: dict[str, SearchIndex] = {}


class SearchIndex:
    """The index in a folder."""

    #: By what postings name a row.
    key = "doc"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        self.postings, self.rows, self.stats = read("postings"), read("rows"), read("stats")

    @classmethod
    def of(cls, spark: SparkSession, docs: Callable[[], DataFrame], name: str, state: str, text: str, columns: list[str]) -> SearchIndex:
        """The stored index of that name and state, built first where there is none; an open one is handed out again."""
        path = f"{store.folder(spark)}/index-{name}-{state}"
        if path not in _open or _open[path].spark._jsparkSession != spark._jsparkSession:
            if not store.is_ready(spark, path):
                cls.build(docs(), path, text, columns)
            _open[path] = cls(spark, path)
        return _open[path]

    @staticmethod
    def build(docs: DataFrame, path: str, text: str, columns: list[str]) -> None:
        spark = docs.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        own = docs.select("uri", *[c for c in columns if c != "uri"], F.expr(text).alias("_s")).repartition(n, "uri")  # a table may be one large file
        said = own.select(F.monotonically_increasing_id().alias("doc"), *[c for c in own.columns if c != "_s"], tokens("coalesce(_s, '')").alias("_t"))
        said.write.mode("overwrite").parquet(f"{path}/said")
        said = spark.read.parquet(f"{path}/said").withColumn("dl", F.size("_t"))
        posts = said.select("doc", "dl", "_t").mapInArrow(inverted(["doc", "dl"]), "term string, doc long, dl int, tf int, at array<int>")
        posts.write.mode("overwrite").option("parquet.page.row.count.limit", 2000).parquet(f"{path}/postings")
        said.drop("_t").write.mode("overwrite").parquet(f"{path}/rows")
        spark.read.parquet(f"{path}/rows").where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("a")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        store.delete(spark, f"{path}/said")
        store.mark_ready(spark, path)

    def terms(self, words: set[str], prefixes: set[str]) -> DataFrame:
        """The postings of some words and of all words that begin in some ways."""
        keep = F.lit(False)
        if words:
            keep = F.col("term").isin(sorted(words))
        for p in sorted(prefixes):
            keep = keep | F.col("term").startswith(p)
        return self.postings.where(keep)

    def matches(self, query: str | Parsed) -> DataFrame:
        """(uri, rank) of the rows that match; rank is negative, lower is better."""
        return self.rows.select(*{self.key, "uri"}).join(self.hits(query), self.key).select("uri", "rank")

    def matched(self, query: str | Parsed) -> DataFrame:
        """The rows that match, with rank."""
        return self.rows.join(self.hits(query), self.key)

    def hits(self, query: str | Parsed) -> DataFrame:
        """(key, rank) of the rows that match.

        All phrases are required and, if there are bare words, one of those.  A phrase is a run of tokens in place;
        one without tokens matches nothing."""
        q = parse_query(query) if isinstance(query, str) else query
        words = [token_words(t) for t in q.terms]
        if not words or any(not w for w, t in zip(words, q.terms, strict=True) if t.phrase):
            return self.postings.limit(0).select(self.key, F.lit(0.0).alias("rank"))
        prefixes = {w[0] for w, t in zip(words, q.terms, strict=True) if t.prefix}
        singles = {x for w, t in zip(words, q.terms, strict=True) if not t.prefix for x in w}
        sums, counts = {}, {}
        for i, (w, t) in enumerate(zip(words, q.terms, strict=True)):
            if len(w) == 1:
                hit = F.col("term").startswith(w[0]) if t.prefix else F.col("term") == w[0]
                sums[f"f{i}"] = F.sum(F.when(hit, F.col("tf")).otherwise(0))
            else:
                for x in w:
                    sums[f"p_{x}"] = F.first(F.when(F.col("term") == x, F.col("at")), ignorenulls=True)
                place = [F.transform(F.coalesce(F.col(f"p_{x}"), F.array().cast("array<int>")), _earlier(k)) for k, x in enumerate(w)]
                both = place[0]
                for p in place[1:]:
                    both = F.array_intersect(both, p)
                counts[f"f{i}"] = F.size(both).cast("long")
        found = self.terms(singles, prefixes).groupBy(self.key, "dl").agg(*(c.alias(k) for k, c in sums.items()))
        found = found.withColumns(counts) if counts else found
        found = found.select(self.key, "dl", *(f"f{i}" for i in range(len(words))))
        counted = found.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in range(len(words))))
        need = [f"f{i} > 0" for i in range(len(q.phrases))]
        if q.words:
            need.append("(" + " OR ".join(f"f{i} > 0" for i in range(len(q.phrases), len(words))) + ")")
        part = lambda i: f"CASE WHEN f{i} > 0 THEN greatest(ln((n - df{i} + 0.5D) / (df{i} + 0.5D)), 1e-6D) * f{i} * {K1 + 1}D / (f{i} + {K1}D * ({1 - B}D + {B}D * dl / a)) ELSE 0D END"
        rank = "round(-(" + " + ".join(part(i) for i in range(len(words))) + "), 6)"
        hits = found.where(" AND ".join(need)).crossJoin(F.broadcast(counted)).crossJoin(F.broadcast(self.stats))  # one row each
        return hits.select(self.key, F.expr(rank).alias("rank"))

    def _kept(self, kept: Column | None, tags: DataFrame | None) -> DataFrame:
        """The rows that a condition and a list of uris keep."""
        rows = self.rows if kept is None else self.rows.where(kept)
        return rows if tags is None else rows.join(tags, "uri", "left_semi")

    def candidates(self, query: str | Parsed, k: int, kept: Column | None = None, tags: DataFrame | None = None) -> DataFrame:
        """(rows' columns, rank) among which are the best k of the rows that match: here all of them."""
        return self._kept(kept, tags).join(self.hits(query), self.key)

    def batch(self, queries: list[str]) -> DataFrame:
        """(query, key, rank) of many queries of bare words at once, the last word of each a prefix.

        Prefixes meet the words of the index by their first letters, a join for each length of prefix."""
        rows = [(q, i, folded_words(t.words[0])[0], t.prefix) for q in queries for i, t in enumerate(parse_query(q).words)]
        wanted = self.spark.createDataFrame(rows, "query string, q int, word string, prefix boolean")
        exact, begun = [r for r in rows if not r[3]], [r for r in rows if r[3]]
        held = self.terms({r[2] for r in exact}, {r[2] for r in begun})
        hit = held.join(wanted.where("NOT prefix"), F.col("term") == F.col("word"))
        for n in sorted({len(r[2]) for r in begun}):
            some = wanted.where(f"prefix AND length(word) = {n}")
            hit = hit.unionByName(held.join(some, F.substring("term", 1, n) == F.col("word")))
        hit = hit.groupBy("query", "q", self.key, "dl").agg(F.sum("tf").alias("f"))
        df = hit.groupBy("query", "q").agg(F.count("*").alias("df"))
        part = F.expr(f"greatest(ln((n - df + 0.5D) / (df + 0.5D)), 1e-6D) * f * {K1 + 1}D / (f + {K1}D * ({1 - B}D + {B}D * dl / a))")
        return hit.join(df, ["query", "q"]).crossJoin(F.broadcast(self.stats)).groupBy("query", self.key).agg(F.round(-F.sum(part), 6).alias("rank"))  # one row


def batch_search(index: SearchIndex, queries: list[str], limit: int = 20) -> DataFrame:
    """(query, uri, rank, score, pos) of each query's best live rows."""
    from .search import LIVE, age

    scored = index.batch(queries).join(index.rows.where(LIVE).select(*{index.key, "uri"}, "created_at"), index.key).select("query", "uri", "rank", F.round(F.col("rank") + age(), 6).alias("score"))
    return scored.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy("score", "uri")).cast("long")).where(F.col("pos") <= limit)
