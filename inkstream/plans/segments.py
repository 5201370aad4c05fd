"""Queries of the segmented index: a snapshot and three batches of later, changed and deleted documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import AS_OF, LIVE, ranked
from ..functions.query_text import parse_query
from ..operators import search
from ..operators.segments import SegmentIndex
from ..sources import store
from ..sources.projection import Corpus, with_views
from .oracles import _AGE, _DOC_TEXT, _rank_ctes

COLUMNS = ["did", "title", "created_at", "platform", "is_bridgyfed", "url_dead"]
AGE = f"coalesce((unix_micros(TIMESTAMP '{AS_OF} 00:00:00Z') - unix_micros(try_to_timestamp(nullif(created_at, '')))) / 86400e6D / 30.0D, 120.0D)"
BATCHES = 3


def index(c: Corpus) -> SegmentIndex:
    """The index after the snapshot and all batches; what is applied already, by any application, is not applied again."""
    at = f"{store.shared(c.spark)}/segments-docs-{c.state()}"
    out = SegmentIndex(c.spark, at, "concat(title, ' ', content)", COLUMNS, AGE)
    wanted = ["snapshot", *(f"batch-{i}" for i in range(BATCHES))]
    if "snapshot" not in out.manifest.batches:
        out.apply("snapshot", c.p_snapshot.select("uri", "content", *COLUMNS))
    changes = c.p_overlay.withColumn("url_dead", F.lit(None).cast("int"))
    for i, name in enumerate(wanted[1:]):
        if name not in out.manifest.batches:
            mine = changes.where(F.col("doc_id") % BATCHES == i)
            out.apply(name, mine.where("deleted = 0").select("uri", "content", *COLUMNS), mine.where("deleted = 1").select("uri"))
    due = out.due()
    if due is not None:  # once for all batches that came together: reads merge segments in the meantime
        out.compact(due)
    return out


_MERGED = """merged AS (SELECT uri, did, title, content, created_at, platform, is_bridgyfed, url_dead FROM p_snapshot WHERE uri NOT IN (SELECT uri FROM p_overlay)
 UNION ALL SELECT uri, did, title, content, created_at, platform, is_bridgyfed, NULL FROM p_overlay WHERE deleted = 0)"""


def _oracle(query: str, where: str = "") -> str:
    hits = f"SELECT d.uri, d.did, d.title, d.created_at, r.rank, round(r.rank + {_AGE}, 6) AS score FROM ranked r JOIN merged d ON d.uri = r.uri WHERE {LIVE}{where}"
    return with_views(f"WITH {_MERGED}, {_rank_ctes(parse_query(query), 'merged', _DOC_TEXT)} {ranked(hits, 'score, uri', 20)}")


PLANS = {
    "segments_common": (lambda c: search.keyword(index(c), "the"), _oracle("the")),
    "segments_words": (lambda c: search.keyword(index(c), "license of public ci"), _oracle("license of public ci")),
    "segments_phrase": (lambda c: search.keyword(index(c), '"of the" license'), _oracle('"of the" license')),
    "segments_filtered": (lambda c: search.keyword(index(c), "de la", platform="pckt", since="2023-02-01"), _oracle("de la", " AND platform = 'pckt' AND created_at <> '' AND created_at >= '2023-02-01'")),
    "segments_rare": (lambda c: search.keyword(index(c), "rev zzz"), _oracle("rev zzz")),
}
