"""Keyword search: bm25 over the stored index, recency, filters, dedup, overlay merge and paging.

Matching reads the postings of the query's terms; hits meet the index's rows, which hold no texts, for filters
and scores, and the best are taken by a top-N.  Texts are read for the snippets of a final page only."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import AS_OF
from ..functions.query_text import parse_query
from .postings import SearchIndex, folded_words, token_words

LIVE = "coalesce(is_bridgyfed, 0) = 0 AND coalesce(url_dead, 0) = 0"


def ranked_rows(index: SearchIndex, query: str) -> DataFrame:
    """The index's rows that match, with `rank`."""
    return index.matched(query)


def age(created: str = "created_at", as_of: str = AS_OF) -> Column:
    return F.expr(f"coalesce((unix_micros(TIMESTAMP '{as_of} 00:00:00Z') - unix_micros(try_to_timestamp(nullif({created}, '')))) / 86400e6D / 30.0D, 120.0D)")


def scored(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round(F.col("rank") + age(), 6))


def _conditions(live: bool, platform: str = "", since: str = "", author: str = "") -> Column | None:
    """Filters of rows as one condition; None where none is set."""
    conditions = [F.expr(LIVE)] if live else []
    if platform:
        conditions.append(F.col("platform") == platform)
    if since:
        conditions.append((F.col("created_at") != "") & (F.col("created_at") >= since))
    if author:
        conditions.append(F.col("did") == author)
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def filtered(docs: DataFrame, platform: str = "", since: str = "", author: str = "", tag: str = "", tags: DataFrame | None = None) -> DataFrame:
    """Filters that apply before the limit; an unset one adds nothing to the plan."""
    if platform:
        docs = docs.where(F.col("platform") == platform)
    if since:
        docs = docs.where((F.col("created_at") != "") & (F.col("created_at") >= since))
    if author:
        docs = docs.where(F.col("did") == author)
    if tag:
        docs = docs.join(tags.where(F.col("tag") == tag), docs.uri == tags.document_uri, "left_semi")
    return docs


def numbered(df: DataFrame, *order: Column | str, limit: int | None = None) -> DataFrame:
    """A top-N and the position of its rows."""
    top = df.orderBy(*order)
    if limit is not None:
        top = top.limit(limit)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long"))


_SHOWN = ("uri", "did", "title", "created_at", "rank", "score")


def keyword(index: SearchIndex, query: str, limit: int = 20, live: bool = True, tag: str = "", tags: DataFrame | None = None, **filters) -> DataFrame:
    """(uri, did, title, created_at, rank, score, pos).  Statistics are of the whole corpus, filters apply to hits."""
    tagged = tags.where(F.col("tag") == tag).select(F.col("document_uri").alias("uri")) if tag else None
    hits = index.candidates(query, limit, _conditions(live, **filters), tagged)
    return numbered(scored(hits).select(*_SHOWN), "score", "uri", limit=limit)


def prefiltered(index: SearchIndex, query: str, limit: int = 20, depth: int = 2000) -> DataFrame:
    """The best `depth` matches by rank alone, of those the live ones by rank and recency."""
    best = index.matches(query).orderBy("rank", "uri").limit(depth)
    return numbered(scored(index.rows.join(best, "uri").where(LIVE)).select(*_SHOWN), "score", "uri", limit=limit)


def by_publication_text(index: SearchIndex, publications: SearchIndex, query: str, limit: int = 20, **filters) -> DataFrame:
    """Documents of the publications that match; the publication's rank counts."""
    pubs = publications.matches(query).withColumnRenamed("uri", "publication_uri")
    hits = filtered(index.rows.where(LIVE), **filters).join(pubs, "publication_uri")
    return numbered(scored(hits).select(*_SHOWN), "score", "uri", limit=limit)


def publications(index: SearchIndex, query: str, limit: int = 20) -> DataFrame:
    return numbered(ranked_rows(index, query).select("uri", "name", "base_path", "rank"), "rank", "uri", limit=limit)


def deduped(rows: DataFrame, *order: str) -> DataFrame:
    """The first of each (did, title) in the order; rows without either are never duplicates."""
    w = Window.partitionBy("did", "title").orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1 OR did = '' OR title = ''").drop("_r")


def blocks(index: SearchIndex, pubs: SearchIndex, query: str, limit: int = 20) -> DataFrame:
    """Documents, then documents by publication text, then publications; first uri wins, then first (did, title)."""
    cols = ["block", "uri", "did", "title", "score"]
    a = keyword(index, query, 100).withColumn("block", F.lit(0)).select(cols)
    b = by_publication_text(index, pubs, query, 100).withColumn("block", F.lit(1)).select(cols)
    c = publications(pubs, query, 100).join(pubs.rows.select("uri", "did"), "uri").select(F.lit(2).alias("block"), "uri", "did", F.col("name").alias("title"), F.col("rank").alias("score"))
    rows = a.unionByName(b).unionByName(c)
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("uri").orderBy("block", "score"))).where("_r = 1").drop("_r")
    return numbered(deduped(first, "block", "score", "uri"), "block", "score", "uri", limit=limit)


def overlay_merge(snapshot: SearchIndex, overlay: SearchIndex, deleted: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Snapshot and overlay hits by score; overlay first on ties.  Overlay hits and deleted uris hide snapshot rows."""
    new = scored(ranked_rows(overlay, query).where("coalesce(is_bridgyfed, 0) = 0")).orderBy("score", "uri").limit(50).select("uri", "did", "title", "score", F.lit(0).alias("layer"))
    hidden = new.select("uri").unionByName(deleted.select("uri"))
    old = scored(ranked_rows(snapshot, query).where(LIVE)).join(hidden, "uri", "left_anti").select("uri", "did", "title", "score", F.lit(1).alias("layer"))
    return numbered(old.unionByName(new), "score", "layer", "uri", limit=limit)


def page(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    """One page of positioned rows and whether more follow: it reads offset + limit + 1 rows."""
    cut = rows.where(F.col("pos") <= offset + limit + 1)
    more = cut.agg(F.max("pos").alias("_last"))
    return cut.where((F.col("pos") > offset) & (F.col("pos") <= offset + limit)).crossJoin(F.broadcast(more)).withColumn("has_more", F.col("_last") > offset + limit).drop("_last")


def snippet(text: str, terms: list[str], size: int = 32, begun: tuple[str, ...] = ()) -> str:
    """The window of `size` tokens that holds most query words or words that begin so, the earliest; cut ends are marked."""
    import re

    found = list(re.finditer(r"[^\W_]+", text, re.UNICODE))
    if len(found) <= size:
        return text
    wanted = set(terms)
    hit = [any(w in wanted or w.startswith(begun) for w in folded_words(m.group())) if begun else bool(wanted.intersection(folded_words(m.group()))) for m in found]
    best, at, now = -1, 0, sum(hit[:size])
    for i in range(len(found) - size + 1):
        if i:
            now += hit[i + size - 1] - hit[i - 1]
        if now > best:
            best, at = now, i
    cut = text[found[at].start() : found[at + size - 1].end()]
    return ("..." if at else "") + cut + ("..." if at + size < len(found) else "")


def with_snippets(rows: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """Snippets of a final page only."""
    terms = parse_query(query).terms
    words = [w for t in terms if not t.prefix for w in token_words(t)]
    begun = tuple(w for t in terms if t.prefix for w in token_words(t))

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: snippet(x or "", words, begun=begun))

    return rows.join(docs.select("uri", "content"), "uri").withColumn("snippet", cut("content")).drop("content")
