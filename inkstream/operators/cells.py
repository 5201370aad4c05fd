"""A stored vector index: vectors by cells around centroids, of which a search reads the nearest few.

Centroids are fitted on a bounded sample, and so is the number of cells that a search probes: the least that finds
`recall` of the nearest neighbours in the sample of vectors that no centroid was fitted on.  Every vector is stored, in the folder of its cell, so files of cells
that are not probed are not read; a large cell is cut into parts, each a task of its own.  Probing all cells is an exact
search.  Vectors that are null, zero or hold null or non-finite entries have no direction and are left out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import store
from .vectors import nearest

#: Vectors of the sample, cells, rows of a part of a cell, and vectors of the sample that probes are set by, at most.
SAMPLE, CELLS, PART, HELD = 20_000, 4_096, 50_000, 1_024
_USABLE = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND abs(x) < CAST('Infinity' AS DOUBLE)) AND exists(embedding, x -> x <> 0)"


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Unit vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centroids(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from the first k vectors, which are a sample by hash already."""
    c = x[:k]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1.0), c)
    return c


def _probes(q: np.ndarray, x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """How many cells hold, on average, `recall` of the k nearest in the sample x of the vectors q, and nine tenths for that share of them.

    No centroid may have been fitted on q."""
    home, depth = (x @ c.T).argmax(axis=1), []
    for lo in range(0, len(q), 256):
        some = q[lo : lo + 256]
        order = np.argsort(-(some @ c.T), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(c))[None, :], axis=1)
        near = np.argsort(-(some @ x.T), axis=1, kind="stable")[:, :k]
        depth.append(np.sort(np.take_along_axis(place, home[near], axis=1), axis=1))
    by_query = np.concatenate(depth)
    at = lambda v, share: int(np.sort(v)[min(len(v) - 1, int(np.ceil(share * len(v))))])
    most = by_query[:, min(by_query.shape[1] - 1, int(np.ceil(0.9 * by_query.shape[1])) - 1)]
    return max(at(by_query.ravel(), recall), at(most, recall)) + 1


class VectorIndex:
    """The index in a folder.  Columns: vec_id and embedding."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.meta = json.loads(store.read_text(spark, f"{path}/meta"))
        self.centroids = np.array(self.meta["centroids"])
        self.stored = spark.read.schema("vec_id long, embedding array<double>, part int, cell int").parquet(f"{path}/cells")

    @classmethod
    def of(cls, spark: SparkSession, vectors: DataFrame, path: str, k: int = 20, recall: float = 0.95) -> VectorIndex:
        """The stored index, built first where there is none."""
        if not store.is_ready(spark, path):
            cls.build(vectors, path, k, recall)
        return cls(spark, path)

    @staticmethod
    def build(vectors: DataFrame, path: str, k: int = 20, recall: float = 0.95, cells: int | None = None, part: int = PART) -> None:
        spark = vectors.sparkSession
        good = vectors.where(_USABLE).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        sizes = good.groupBy(F.size("embedding").alias("size")).count().collect()  # one row for each length of vectors
        if len(sizes) > 1:
            raise ValueError("vectors of one length are needed")
        size, n = (sizes[0].size, sizes[0]["count"]) if sizes else (1, 0)
        taken = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
        x = _matrix(taken["embedding"], size)
        held = min(HELD, len(x) // 10)
        fit, asked = x[: len(x) - held], x[len(x) - held :] if held else x
        many = min(cells or max(1, round(n**0.5)), CELLS, max(1, len(fit)))
        c = _centroids(fit, many) if len(x) else np.ones((1, size))
        probes = min(len(c), _probes(asked, x, c, k, recall)) if len(x) else 1

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = (_matrix(b["embedding"], size) @ c.T).argmax(axis=1) if b.num_rows else np.zeros(0)
                yield pa.record_batch({"vec_id": b["vec_id"], "embedding": b["embedding"], "cell": pa.array(near.astype(np.int32))})

        placed = good.mapInArrow(task, "vec_id long, embedding array<double>, cell int")
        placed.write.mode("overwrite").parquet(f"{path}/placed")
        placed = spark.read.parquet(f"{path}/placed")
        parts = {r.cell: r["count"] // part + 1 for r in placed.groupBy("cell").count().collect()}  # CELLS rows at most
        table = spark.createDataFrame(list(parts.items()), "cell int, parts long")
        cut = placed.join(F.broadcast(table), "cell").withColumn("part", F.expr("CAST(pmod(xxhash64(vec_id), parts) AS INT)")).drop("parts")
        cut.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
        store.delete(spark, f"{path}/placed")
        meta = {"size": size, "n": n, "probes": probes, "parts": {str(k): v for k, v in parts.items()}, "centroids": c.tolist()}
        store.write_text(spark, f"{path}/meta", json.dumps(meta))
        store.mark_ready(spark, path)

    def probed(self, vector: list[float], probes: int | None = None) -> list[int]:
        """The cells that a search of one vector reads."""
        near = np.argsort(-(self.centroids @ np.array(vector, float)), kind="stable")
        return [int(i) for i in near[: probes or self.meta["probes"]]]

    def near(self, vector: list[float], k: int, probes: int | None = None) -> DataFrame:
        """(vec_id, distance) of the k nearest in the probed cells."""
        rows = self.stored.where(F.col("cell").isin(self.probed(vector, probes)))
        return nearest(rows, vector).orderBy("distance", "vec_id").limit(k)

    def search(self, queries: DataFrame, k: int = 20, probes: int | None = None) -> DataFrame:
        """(query_id, vec_id, distance, pos) of the k nearest of each row (vec_id, embedding) of `queries`, itself included."""
        c, size, most = self.centroids, self.meta["size"], min(probes or self.meta["probes"], len(self.centroids))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near = np.argsort(-(_matrix(b["embedding"], size) @ c.T), axis=1, kind="stable")[:, :most]
                    at = pa.array(np.repeat(np.arange(b.num_rows), most))
                    yield pa.record_batch({"query_id": b["vec_id"].take(at), "cell": pa.array(near.ravel().astype(np.int32)), "embedding": b["embedding"].take(at)})

        def meet(q: pa.Table, v: pa.Table) -> pa.Table:
            ids, out = v["vec_id"].combine_chunks(), []
            x = _matrix(v["embedding"], size)
            for lo in range(0, len(q), 1024):
                some = q.slice(lo, 1024)
                d = np.round(1 - _matrix(some["embedding"], size) @ x.T, 8) + 0.0
                best = np.argpartition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else np.tile(np.arange(d.shape[1]), (len(d), 1))
                worst = np.take_along_axis(d, best, axis=1).max(axis=1, initial=-1.0)
                row, col = np.nonzero(d <= worst[:, None])  # ties at the end included
                out.append(pa.table({"query_id": some["query_id"].combine_chunks().take(pa.array(row)), "vec_id": ids.take(pa.array(col)), "distance": d[row, col]}))
            return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})

        good = queries.where(_USABLE).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        sent = good.mapInArrow(route, "query_id long, cell int, embedding array<double>")
        parts = self.spark.createDataFrame([(int(i), n) for i, n in self.meta["parts"].items()], "cell int, parts long")
        sent = sent.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.expr("sequence(0, CAST(parts - 1 AS INT))"))).drop("parts")
        if most < len(c):
            wanted = [r.cell for r in sent.select("cell").distinct().collect()]  # CELLS rows at most
            stored = self.stored.where(F.col("cell").isin(wanted))
        else:
            stored = self.stored
        met = sent.groupBy("cell", "part").cogroup(stored.groupBy("cell", "part")).applyInArrow(meet, "query_id long, vec_id long, distance double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
        return met.withColumn("pos", place.cast("long")).where(F.col("pos") <= k)


def recall(index: VectorIndex, queries: DataFrame, k: int = 20) -> DataFrame:
    """(queries, asked, found): how many of the k nearest by the exact search the index finds, by distance."""
    exact = index.search(queries, k, len(index.centroids)).select("query_id", "vec_id", "pos")
    found = index.search(queries, k).select("query_id", "vec_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("asked"), F.count("hit").alias("found"))
