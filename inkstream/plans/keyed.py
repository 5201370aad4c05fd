"""Queries of the keyed table: documents after batches of changes, and counts that are kept by batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import KeyedTable, MaintainedCounts
from ..sources import store
from ..sources.projection import Corpus, with_views
from .segments import _MERGED

_SHOWN = ["uri", "did", "title", "content", "created_at", "platform", "is_bridgyfed"]


def _documents(c: Corpus) -> DataFrame:
    """A snapshot, then three batches of changed and deleted documents, the second of them twice."""
    table = KeyedTable(c.spark, f"{store.folder(c.spark)}/keyed-{uuid.uuid4().hex}", ["uri"], 16)
    table.apply("snapshot", c.p_snapshot.select(*_SHOWN))
    for i in (0, 1, 1, 2):
        mine = c.p_overlay.where(F.col("doc_id") % 3 == i)
        table.apply(f"batch-{i}", mine.where("deleted = 0").select(*_SHOWN), mine.where("deleted = 1").select("uri"))
    return table.read().select("uri", "did", "title", "platform", F.length("content").cast("long").alias("chars"))


def _counts(c: Corpus) -> DataFrame:
    """Distinct recommenders of documents: two thirds of the edges, then the others, of which some are taken back."""
    edges = c.p_recommends.select("document_uri", "did", F.expr("pmod(length(uri) + ascii(right(uri, 1)), 3)").alias("k"))
    counts = MaintainedCounts(c.spark, f"{store.folder(c.spark)}/counts-{uuid.uuid4().hex}", "document_uri", "did", 16)
    counts.apply("first", edges.where("k <> 2"))
    counts.apply("second", edges.where("k = 2"), edges.where("k = 0"))
    counts.apply("second", edges.where("k = 2"), edges.where("k = 0"))
    return counts.read().select("document_uri", "n")


PLANS = {
    "keyed_documents": (_documents, with_views(f"WITH {_MERGED} SELECT uri, did, title, platform, length(content) AS chars FROM merged")),
    "maintained_counts": (_counts, with_views("SELECT document_uri, count(DISTINCT did) AS n FROM (SELECT document_uri, did, (length(uri) + ascii(right(uri, 1))) % 3 AS k FROM p_recommends) e WHERE k <> 0 GROUP BY document_uri")),
}
