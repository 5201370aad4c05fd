"""Tables that outlive a query: a shared folder, and what is built once per state of its sources."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

READY = "_ready"


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of this machine's own only in local
    mode without that setting, as in tests."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="inkstream-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/inkstream-store-{sc.applicationId}"


def shared(spark: SparkSession) -> str:
    """A folder for what other applications use as well, where spark.checkpoint.dir is set; else this application's own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{base.rstrip('/')}/inkstream-shared" if base else folder(spark)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def state(spark: SparkSession, *paths: str) -> str:
    """A name for the state of some files or folders: it changes with their size or time of change."""
    out = hashlib.sha256()
    for path in paths:
        at, fs = _at(spark, path)
        s = fs.getFileStatus(at)
        files = [s] if s.isFile() else list(fs.listStatus(at))
        out.update(repr((path, [(f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files])).encode())
    return out.hexdigest()[:16]


def mark_ready(spark: SparkSession, path: str) -> None:
    """Written last: a folder without this mark is not complete."""
    at, fs = _at(spark, f"{path}/{READY}")
    fs.create(at, True).close()


def is_ready(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/{READY}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _at(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file; it fails where there is one already."""
    at, fs = _at(spark, path)
    out = fs.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    at, fs = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.option("pathGlobFilter", "*").text(path).collect())


def cached(spark: SparkSession, name: str, build: Callable[[], DataFrame], seconds: float, now: float | None = None) -> DataFrame:
    """A result that is computed again once it is older than `seconds`; the last good one stays when that fails.

    A version is written beside the others and named by the pointer only when it is complete."""
    now = time.time() if now is None else now
    base = f"{folder(spark)}/cache-{name}"
    last = json.loads(read_text(spark, f"{base}/pointer")) if exists(spark, f"{base}/pointer") else None
    if last is None or now - last["at"] > seconds:
        try:
            version = f"{base}/v{int(now * 1000)}"
            build().write.mode("overwrite").parquet(version)
            write_text(spark, f"{base}/pointer", json.dumps({"at": now, "path": version}))
            last = {"at": now, "path": version}
        except Exception:
            if last is None:
                raise
    return spark.read.parquet(last["path"])
