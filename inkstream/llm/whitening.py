"""Whitening of embeddings: principal components of scaled whole-number vectors, with unit variance along each.

Each partition counts its vectors and keeps their exact sums, their mean and their scatter about it; two of these merge
by the pairwise formula (counts and sums add, scatters add with a term for the distance of the means), in a tree of
tasks.  What travels is a square of the dimension for each partition, whatever the rows, and one of them reaches the
driver, which takes the eigenvectors.  A second pass whitens every vector and gathers the covariance of the result in the
same way, to be compared with the identity.

Vectors that are null, empty, or hold a null or non-finite entry are left out; of the others those of the commonest
length stay (the smaller of two equally common ones).  Equal rows count as often as they stand.  A component whose
variance is zero or too small to be told from rounding has null for `whitened` and is no part of the identity that is
checked; without variance at all `explained` is null too.  A `deviation` beyond 64 bits is null.  Columns besides those
named are not carried.  Lost executors repeat their partition's sums.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Count, exact sums, mean and scatter about the mean of some vectors."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        away = x - mean
        return cls(len(x), np.array([int(c) for c in x.sum(axis=0)], object) if x.dtype.kind == "i" else x.sum(axis=0), mean, away.T @ away)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.sums + other.sums, self.mean + apart * (other.n / n), scatter)

    def covariance(self) -> np.ndarray:
        return self.scatter / self.n


def _vectors(batch: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    """The vectors of a batch as a matrix."""
    values = batch.column(column)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, size)


def _merge(a: Moments, b: Moments) -> Moments:
    return a.merged(b)


class Whitening:
    """Components of x = floor(scale * entry) + offset, at most `components` of them."""

    def __init__(self, scale: int = 64, offset: int = 1_000_000, components: int = 32, depth: int = 2) -> None:
        self.scale, self.offset, self.components, self.depth = scale, offset, components, depth

    def _usable(self, vectors: DataFrame, identity: str, embedding: str) -> tuple[DataFrame, int]:
        """(identity, vector) of the rows that stay, and their dimension."""
        good = f"forall(`{embedding}`, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < CAST('Infinity' AS DOUBLE))"
        rows = vectors.where(F.expr(f"`{embedding}` IS NOT NULL AND size(`{embedding}`) > 0 AND {good}"))
        rows = rows.select(F.col(identity).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
        size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
        return rows.where(F.size("v") == (size.size if size else -1)), size.size if size else 0

    def _whole(self, v: np.ndarray) -> np.ndarray:
        """The whole-number vectors less the offset, which no difference or covariance sees."""
        return np.floor(self.scale * v).astype(np.int64)

    def fit(self, rows: DataFrame, size: int) -> Moments:
        """Moments of all rows."""
        whole = self._whole
        return self._gathered(rows, lambda b: whole(_vectors(b, 0, size)))

    def _gathered(self, rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray]) -> Moments:
        """Moments of a matrix for each batch, merged within the partitions and then in a tree; there are rows."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    one = Moments.of(of(b))
                    total = one if total is None else total.merged(one)
            if total is not None:
                yield pa.record_batch({"moments": pa.array([pickle.dumps(total)], pa.binary())})

        each = rows.select("v").mapInArrow(task, "moments binary").rdd.map(lambda r: pickle.loads(r.moments))
        return each.treeReduce(_merge, self.depth)

    def whitened(self, vectors: DataFrame, identity: str = "vec_id", embedding: str = "embedding") -> DataFrame:
        """(identity, component, n, deviation, whitened, explained, identity_error) for each vector and component."""
        rows, size = self._usable(vectors, identity, embedding)
        kind = vectors.schema[identity].dataType
        schema = f"id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        moments = self.fit(rows, size) if size else None
        if moments is None:
            return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", identity)
        values, axes = np.linalg.eigh(moments.covariance())
        values, axes = values[::-1], axes[:, ::-1]
        k = min(self.components, size)
        trace = float(np.trace(moments.covariance()))
        told = values[:k] > max(trace, 0.0) * size * np.finfo(float).eps
        spread = np.where(told, np.sqrt(np.maximum(values[:k], 0.0)), np.nan)
        explained = values[:k] / trace if trace > 0 else np.full(k, np.nan)
        n, sums, mean, whole = moments.n, moments.sums, np.array([s / moments.n for s in moments.sums], float), self._whole

        def project(x: np.ndarray) -> np.ndarray:
            return (x - mean) @ axes[:, :k] / spread

        check = self._gathered(rows, lambda b: project(whole(_vectors(b, 0, size)))[:, told]) if told.any() else None
        error = float(np.abs(check.covariance() - np.eye(int(told.sum()))).max()) if check is not None else None

        def deviation(x: np.ndarray) -> pa.Array:
            """Sum over the dimensions of (n * x - sum)^2: in 64 bits where it must fit, else in whole numbers of any length."""
            far = n * np.abs(x).astype(float) + np.abs(sums.astype(float))
            if (far * far).sum(axis=1).max() < 2.0**62:
                d = n * x - sums.astype(np.int64)
                return pa.array((d * d).sum(axis=1), pa.int64())
            exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
            return pa.array([e if e < 2**63 else None for e in exact], pa.int64())

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = whole(_vectors(b, 1, size))
                at = pa.array(np.repeat(np.arange(b.num_rows), k))
                nulls = lambda a: pa.array(a, pa.float64(), from_pandas=True)
                yield pa.record_batch(
                    {
                        "id": b.column(0).take(at),
                        "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                        "n": pa.array(np.full(len(at), n, np.int64)),
                        "deviation": deviation(x).take(at),
                        "whitened": nulls(project(x).ravel()),
                        "explained": nulls(np.tile(explained, b.num_rows)),
                        "identity_error": pa.array([error] * len(at), pa.float64()),
                    }
                )

        return rows.mapInArrow(task, schema).withColumnRenamed("id", identity)
