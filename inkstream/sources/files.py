"""Readers and writers of files: deny lists, snapshots with a manifest, and incremental scans."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

MANIFEST = "manifest.json"


def list_entries(spark: SparkSession, path: str) -> DataFrame:
    """(did, note) of a line-oriented list; what follows '#' is the note, lines without an entry are dropped."""
    t = spark.read.text(path)
    return t.select(F.trim(F.split("value", "#", 2)[0]).alias("did"), F.expr("trim(try_element_at(split(value, '#', 2), 2))").alias("note")).where("did <> ''")


def since(df: DataFrame, indexed_at: str, uri: str) -> DataFrame:
    """Rows after a (indexed_at, uri) keyset."""
    return df.where(F.struct("indexed_at", "uri") > F.struct(F.lit(indexed_at), F.lit(uri)))


def snapshot_rows(docs: DataFrame, watermark: str, banned: list[str]) -> DataFrame:
    """What a snapshot holds: rows up to the watermark that are not bridged and not banned."""
    return docs.where((F.col("indexed_at") <= watermark) & F.expr("coalesce(is_bridgyfed, 0) = 0") & ~F.col("did").isin(banned))


# What a snapshot is written as, the word that its text must hold, and platforms that it must span.
SCHEMA_VERSION = 5
SENTINEL = "leaflet"
PLATFORMS = ("leaflet", "whitewind")


def fingerprint(spark: SparkSession, path: str, tables: list[str]) -> tuple[int, str]:
    """(bytes, digest) of a snapshot's data files; each file is digested where it is read."""
    out = []
    for name in sorted(tables):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/{name}")
        out += [(name, r.file, r.length, r.digest) for r in files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("digest")).collect()]
    return sum(r[2] for r in out), hashlib.sha256(repr(sorted(out)).encode()).hexdigest()


def write_snapshot(tables: dict[str, DataFrame], path: str, watermark: str, build_id: str, created_at: float = 0.0) -> dict:
    """Writes the tables, then the manifest: a directory without one is not a snapshot."""
    spark, counts = next(iter(tables.values())).sparkSession, {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{name}").count()
    size, digest = fingerprint(spark, path, list(tables))
    manifest = {"schema_version": SCHEMA_VERSION, "build_id": build_id, "created_at": created_at, "source_watermark": watermark, "counts": counts, "byte_size": size, "sha256": digest}
    store.write_text(spark, f"{path}/{MANIFEST}", json.dumps(manifest))
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(store.read_text(spark, f"{path}/{MANIFEST}"))


def gates(spark: SparkSession, path: str, live_documents: int, banned: list[str], sentinel: str = SENTINEL, platforms: tuple[str, ...] = PLATFORMS) -> DataFrame:
    """(gate, ok): what must hold before a snapshot is adopted: bytes, digest, schema, exact counts, no banned or
    bridged row, a text that answers, all platforms, a watermark that no row exceeds, and no great loss of rows."""
    m = read_manifest(spark, path)
    docs = spark.read.parquet(f"{path}/documents")
    found = docs.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("did").isin(banned)).alias("banned"),
        F.count_if(F.col("is_bridgyfed").cast("string") == "1").alias("bridged"),
        F.max("indexed_at").alias("newest"),
        F.count_if(F.lower("content").contains(sentinel)).alias("sentinel"),
        *(F.count_if(F.col("platform") == p).alias(f"p{i}") for i, p in enumerate(platforms)),
    ).first()
    size, digest = fingerprint(spark, path, list(m["counts"]))
    others = [spark.read.parquet(f"{path}/{t}").count() == n for t, n in m["counts"].items() if t != "documents"]
    checks = {
        "size": size == m["byte_size"],
        "sha256": digest == m["sha256"],
        "schema": m["schema_version"] == SCHEMA_VERSION,
        "counts": found.n == m["counts"]["documents"] and all(others),
        "shrink": passes_shrink_floor(found.n, live_documents),
        "banned": found.banned == 0,
        "bridged": found.bridged == 0,
        "sentinel": found.sentinel > 0,
        "platforms": all(found[f"p{i}"] > 0 for i in range(len(platforms))),
        "watermark": bool(m["source_watermark"]) and (found.newest or "") <= m["source_watermark"],
    }
    return spark.createDataFrame(list(checks.items()), "gate string, ok boolean")


def build_gates(built: int, source: int, answered: int) -> dict[str, bool]:
    """Before a snapshot is published: its rows against those of the source, within a thousandth or ten, and its text."""
    return {"count": abs(built - source) <= max(source * 0.001, 10), "sentinel": answered > 0}


def adoption(candidate: dict, live: dict | None, hour: int, hours: str | None) -> str:
    """What to do with a new build: current, schema, shrunk, wait or adopt.  A new schema does not wait for its hour."""
    if candidate["schema_version"] not in (0, SCHEMA_VERSION):
        return "schema"
    if live and live["build_id"] == candidate["build_id"]:
        return "current"
    if live and not passes_shrink_floor(candidate["counts"]["documents"], live["counts"]["documents"]):
        return "shrunk"
    upgrade = not live or live["schema_version"] != SCHEMA_VERSION
    return "adopt" if upgrade or not hours or hour_is_listed(hours, hour) else "wait"


def adopt(spark: SparkSession, root: str, path: str) -> dict:
    """Points to a validated snapshot: what was live becomes the previous one; the pointer changes last, at once."""
    old = pointer(spark, root)
    new = {"live": path, "previous": old["live"] if old else None}
    if not old or old["live"] != path:
        store.write_text(spark, f"{root}/pointer", json.dumps(new))
    return pointer(spark, root)


def pointer(spark: SparkSession, root: str) -> dict | None:
    return json.loads(store.read_text(spark, f"{root}/pointer")) if store.exists(spark, f"{root}/pointer") else None


def passes_shrink_floor(new: int, live: int) -> bool:
    return new >= live / 2


def hour_is_listed(raw: str, hour: int) -> bool:
    return str(hour) in [x.strip() for x in raw.split(",")]
