"""Cluster plumbing: tables in the shared folder, bucket counts and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one group of exchanged blobs or texts holds, about.
GROUP_BYTES = 32 << 20
#: Rows of a batch that goes to Python while a table is staged.
BATCH_ROWS = 2_000
_open = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine's own only where none is set, as in tests."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="inkstream-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/inkstream-{sc.applicationId}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Python is handed batches of at most BATCH_ROWS rows: of texts the usual ones are large, and the
    JVM and the worker hold each of them several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scratch(spark: SparkSession) -> str:
    """A new name in the shared folder, deleted when the operator returns, if it is tidy and its result does not read it."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    if getattr(_open, "tables", None):
        _open.tables[-1].append(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Of the tables that `run` stages, those that its result does not read are deleted when it returns; the
    others pass to the operator that called it, if it is tidy as well, and otherwise stay."""

    @wraps(run)
    def cleaned(*args, **kwargs) -> DataFrame:
        _open.tables = [*getattr(_open, "tables", []), []]
        mine = _open.tables[-1]
        try:
            out = run(*args, **kwargs)
        finally:
            _open.tables = _open.tables[:-1]
        if mine:
            read = {f.rpartition("/")[0].rpartition("/")[2] for f in out.inputFiles()}
            files = out.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
            for path in mine:
                if path.rpartition("/")[2] in read:
                    if _open.tables:
                        _open.tables[-1].append(path)
                else:
                    at = files.Path(path)
                    at.getFileSystem(out.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
        return out

    return cleaned


def buckets(spark: SparkSession, bytes_: int = 0) -> int:
    """How many groups that many exchanged bytes are dealt into: as many as there are shuffle partitions, and
    more where a group would hold more than GROUP_BYTES."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // GROUP_BYTES))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, measured."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def dealt(df: DataFrame, n: int, bucket: str = "bucket"):
    """df grouped by an integer bucket from 0 to n - 1, each bucket a task of its own."""
    return df.withColumn(bucket, F.col(bucket).cast("int")).repartitionById(n, F.col(bucket)).groupBy(bucket)


def release() -> None:
    """Gives this worker's free memory back: workers stay for other tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """The function of a task over batches, after which its worker gives memory back."""

    def task(it):
        try:
            yield from run(it)
        finally:
            release()

    return task


def lean_group(run: Callable) -> Callable:
    """The same of a group."""

    def task(t):
        try:
            return run(t)
        finally:
            release()

    return task


def lean_pair(run: Callable) -> Callable:
    """The same of two groups of one key."""

    def task(a, b):
        try:
            return run(a, b)
        finally:
            release()

    return task


def binary(col) -> list[bytes | None]:
    """An Arrow column of strings as UTF-8 bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    return col.to_pylist()


def groups(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, indices in their order) for each distinct key."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    k = key[order]
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    for lo, hi in zip(cut, [*cut[1:], len(k)], strict=True):
        yield int(k[lo]), order[lo:hi]


class Forest:
    """Union-find over arbitrary integers; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in self.up if self.root(x) != x]
        return nodes, [self.root(x) for x in nodes]


def _contract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars around the smallest member of each set."""
    f = Forest()
    for b in it:
        for a, c in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True):
            f.link(a, c)
        if len(f.up) > 2_000_000:
            u, v = f.edges()
            yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
            f = Forest()
    u, v = f.edges()
    yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (u, v) reach, for every node that has a link.

    Alternating large-star and small-star rounds; each is two aggregations and two joins on a node, with
    no component in one task, and is written to the shared folder.  Partitions contract their own links
    before each round, so chains shrink by more than the star rounds alone would do."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = staged(e.mapInArrow(lean(_contract), "u long, v long"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().mapInArrow(lean(_contract), "u long, v long").distinct())
        inner = e.select("v").distinct().join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if inner.isEmpty() and not e.groupBy("u").count().where("count > 1").limit(1).count():
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
