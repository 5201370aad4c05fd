"""Exact vector retrieval, fusion with keyword ranks, and neighbourhood descriptions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import deduped, numbered

RRF = 60
DEPTH = 75


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)")


def distances(vectors: DataFrame, vec_id: int) -> DataFrame:
    """(vec_id, label, distance) to one vector, which is broadcast as a single row.  Cosine distance, rounded."""
    q = vectors.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("_q")).limit(1)
    near = vectors.crossJoin(F.broadcast(q))
    d = 1 - dot("embedding", "_q") / F.sqrt(dot("embedding", "embedding") * dot("_q", "_q"))
    return near.select("vec_id", "label", F.round(d, 8).alias("distance"))


def nearest(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(vec_id, distance) of all vectors to a given one."""
    q = F.array(*(F.lit(float(x)) for x in query))
    near = vectors.withColumn("_q", q)
    d = 1 - dot("embedding", "_q") / F.sqrt(dot("embedding", "embedding") * dot("_q", "_q"))
    return near.select("vec_id", F.round(d, 8).alias("distance"))


def top_k(vectors: DataFrame, vec_id: int, k: int) -> DataFrame:
    return numbered(distances(vectors, vec_id), "distance", "vec_id", limit=k)


def similar(vectors: DataFrame, docs: DataFrame, vec_id: int, limit: int = 5, over: int = 25, shown: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Neighbours of a document: itself dropped, live only, those that policy shows, one per author and title."""
    near = distances(vectors, vec_id).where(F.col("vec_id") != vec_id).orderBy("distance", "vec_id").limit(limit + over)
    rows = near.join(docs.where("coalesce(is_bridgyfed, 0) = 0 AND title <> ''"), near.vec_id == docs.doc_id)
    rows = deduped(shown(rows).select("vec_id", "uri", "did", "title", "distance"), "distance", "vec_id")
    return numbered(rows, "distance", "vec_id", limit=limit)


def semantic(vectors: DataFrame, docs: DataFrame, vec_id: int, limit: int = 10, depth: int = 200, platform: str = "", since: str = "") -> DataFrame:
    """Over-fetch, then the filters that the vector store does not apply."""
    near = distances(vectors, vec_id).orderBy("distance", "vec_id").limit(depth)
    rows = near.join(docs.where("title <> '' AND coalesce(is_bridgyfed, 0) = 0"), near.vec_id == docs.doc_id)
    if platform:
        rows = rows.where(F.col("platform") == platform)
    if since:
        rows = rows.where((F.col("created_at") != "") & (F.col("created_at") >= since))
    return numbered(deduped(rows.select("vec_id", "uri", "did", "title", "distance"), "distance", "vec_id"), "distance", "vec_id", limit=limit)


def fused(first: DataFrame, second: DataFrame, limit: int = 20) -> DataFrame:
    """Reciprocal rank fusion of two positioned lists: sum of 1 / (60 + rank), ties by uri, with the legs that hold it."""
    legs = first.where(F.col("pos") <= DEPTH).select("uri", "pos", F.lit(1).alias("leg")).unionByName(second.where(F.col("pos") <= DEPTH).select("uri", "pos", F.lit(2).alias("leg")))
    both = legs.groupBy("uri").agg(F.round(F.sum(1 / (F.lit(RRF) + F.col("pos"))), 9).alias("fusion"), F.sum("leg").alias("legs"))
    both = both.withColumn("source", F.expr("CASE legs WHEN 1 THEN 'keyword' WHEN 2 THEN 'semantic' ELSE 'both' END")).drop("legs")
    return numbered(both, F.desc("fusion"), "uri", limit=limit)


def upper_median(values: DataFrame, column: str, bins: int = 10_000) -> DataFrame:
    """(median): the value at floor(n / 2) of the ascending values, from zero.

    Counts by bin find the bin that holds it, and only that bin's values are put in order."""
    binned = values.select(F.col(column).alias("v"), F.floor(F.col(column) * bins).alias("bin"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"))  # at most `bins` rows for a unit of values
    placed = counts.crossJoin(F.broadcast(counts.agg(F.floor(F.sum("n") / 2).alias("k")))).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))  # one row
    at = placed.where("before <= k AND k < before + n").select("bin", (F.col("k") - F.col("before") + 1).alias("r"))
    return binned.join(at, "bin").withColumn("i", F.row_number().over(Window.partitionBy("bin").orderBy("v"))).where("i = r").agg(F.max("v").alias("median"))


def distance_report(vectors: DataFrame, vec_id: int) -> DataFrame:
    """Least, largest and upper median distance, and how many lie under some thresholds."""
    d = distances(vectors, vec_id).where(F.col("vec_id") != vec_id)
    sums = d.agg(F.min("distance").alias("least"), F.max("distance").alias("most"), F.count_if(F.col("distance") < 0.5).alias("under_05"), F.count_if(F.col("distance") < 1.0).alias("under_10"))
    return sums.crossJoin(upper_median(d, "distance"))


def distance_histogram(vectors: DataFrame, vec_id: int) -> DataFrame:
    d = distances(vectors, vec_id).where(F.col("vec_id") != vec_id)
    return d.groupBy(F.round(F.floor(F.col("distance") * 10) / 10, 1).alias("bucket")).agg(F.count("*").alias("n"))


def neighbourhood(vectors: DataFrame, docs: DataFrame, vec_id: int, k: int = 20) -> DataFrame:
    """Platforms, authors and shared title terms of the neighbours, in one row."""
    near = distances(vectors, vec_id).where(F.col("vec_id") != vec_id).orderBy("distance", "vec_id").limit(k)
    rows = near.join(docs, near.vec_id == docs.doc_id)
    terms = rows.select("uri", F.explode(F.array_distinct(F.expr("filter(regexp_extract_all(lower(title), '[\\\\p{L}]+', 0), x -> length(x) >= 4)"))).alias("term"))
    shared = terms.groupBy("term").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "term").limit(10)
    one = rows.agg(F.count("*").alias("n"), F.count_distinct("did").alias("authors"), F.count_distinct("platform").alias("platforms"))
    return one.crossJoin(shared.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "term"))), lambda x: x["term"]), ",").alias("terms")))


def centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector of each label as rows (label, dim, value): exploded once, summed with map-side combine."""
    return vectors.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"), F.count("*").alias("n"))


#: Labels up to which their centroids are broadcast.
FEW_LABELS = 5_000


def nearest_centroid(vectors: DataFrame) -> DataFrame:
    """Each vector's label by the nearest centroid; the centroids, a row per label, are broadcast while they are few."""
    mean = vectors.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("v"))
    mean = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("_c")).withColumnRenamed("label", "near")
    d = F.expr("aggregate(zip_with(embedding, _c, (x, y) -> (CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)), 0D, (s, x) -> s + x)")
    few = vectors.agg(F.approx_count_distinct("label")).first()[0] <= FEW_LABELS
    each = vectors.crossJoin(F.broadcast(mean) if few else mean).withColumn("_d", F.round(d, 9))
    best = each.groupBy("vec_id", "label").agg(F.min(F.struct("_d", "near")).alias("b"))
    return best.select("vec_id", "label", F.col("b.near").alias("near"), F.round(F.sqrt("b._d"), 6).alias("distance"))
