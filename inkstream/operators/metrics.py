"""Dashboards, time series, endpoint latency and single-number facts."""

from __future__ import annotations

from ..functions.common import AS_OF, LIVE, ranked, when

#: Range -> bucket and how many days before today it begins.
_UNIT = {"7d": ("day", 6), "30d": ("day", 29), "90d": ("day", 89), "1y": ("week", 364), "all": (None, None)}


def timeline(span: str, field: str) -> str:
    """Documents per bucket of indexed_at or created_at, with how many are bridged; nothing later than as_of.

    Weeks start on Monday.  All time is monthly by indexed_at, and yearly with a floor of 2000 by created_at."""
    unit, days = _UNIT[span]
    unit = unit or ("month" if field == "indexed_at" else "year")
    day = f"@DAY(NULLIF({field}, ''))"
    low = f" AND {day} >= @MINUS_DAYS({AS_OF}, {days})" if days else (f" AND {day} >= DATE '2000-01-01'" if field == "created_at" else "")
    return f"SELECT @DATE_TEXT(date_trunc('{unit}', {day})) AS bucket, count(*) AS n, CAST(sum(CASE WHEN is_bridgyfed = 1 THEN 1 ELSE 0 END) AS BIGINT) AS bridged FROM p_documents WHERE {day} <= DATE '{AS_OF}'{low} GROUP BY 1 ORDER BY 1"


DASHBOARD = {
    "dashboard_stats": """SELECT d.documents, p.publications, e.searches, x.errors, x.started_at, v.embeddings, d.bridged, d.last_indexed FROM
 (SELECT count(*) AS documents, count(CASE WHEN COALESCE(is_bridgyfed, 0) = 1 THEN 1 END) AS bridged, COALESCE(CAST(@EPOCH(@TS(max(indexed_at))) AS BIGINT), 0) AS last_indexed FROM p_documents) d
 CROSS JOIN (SELECT count(*) AS publications FROM p_publications) p CROSS JOIN (SELECT count(*) AS searches FROM p_search_events) e
 CROSS JOIN (SELECT count(CASE WHEN endpoint = 'error' THEN 1 END) AS errors, CAST(floor(@EPOCH(min(ts))) AS BIGINT) AS started_at FROM p_requests) x CROSS JOIN (SELECT count(*) AS embeddings FROM a_vectors) v""",
    "dashboard_platforms": "SELECT CASE WHEN is_bridgyfed = 1 THEN 'bridgy fed' ELSE platform END AS platform, count(*) AS n FROM p_documents GROUP BY 1",
    "dashboard_tags": ranked("SELECT tag, count(*) AS n FROM p_document_tags GROUP BY tag", "n DESC, tag", 100),
    "dashboard_top_pubs": ranked("SELECT p.name, p.base_path, count(*) AS n FROM (SELECT publication_uri FROM p_documents WHERE COALESCE(is_bridgyfed, 0) = 0) d JOIN p_publications p ON p.uri = d.publication_uri GROUP BY p.uri, p.name, p.base_path", "n DESC, name, base_path", 8),
    "popular": ranked("SELECT query, count(*) AS n FROM p_search_events WHERE searched_at >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY query", "n DESC, query", 5),
    "search_retention": "SELECT count(*) AS kept FROM p_search_events WHERE searched_at >= TIMESTAMP '2023-11-02 00:00:00'",
    "freshness": "SELECT max(indexed_at) AS newest, count(*) AS n, count(NULLIF(cover_image, '')) AS covers FROM p_documents",
    "embedding_coverage": "SELECT count(*) AS documents, count(e.vec_id) AS embedded, count(*) - count(e.vec_id) AS missing FROM p_documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id",
    "sweep_lag": "SELECT min(CASE WHEN doc_id % 7 <> 0 THEN indexed_at END) AS oldest, count(CASE WHEN doc_id % 7 = 0 THEN 1 END) AS never FROM p_documents",
    "content_type_groups": "SELECT platform, source_collection, count(*) AS n FROM p_documents GROUP BY platform, source_collection",
}

#: Percentiles are the element at floor(n p) of the ascending last 1,000 samples, counted from zero.
LATENCY = {
    "latency_stats": """WITH last AS (SELECT endpoint, latency_us FROM (SELECT endpoint, latency_us, row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, event_id DESC) AS r FROM p_requests) x WHERE r <= 1000),
o AS (SELECT endpoint, latency_us, row_number() OVER (PARTITION BY endpoint ORDER BY latency_us) - 1 AS i, count(*) OVER (PARTITION BY endpoint) AS n FROM last),
s AS (SELECT endpoint, avg(latency_us) AS mean, max(CASE WHEN i = floor(n * 50 / 100.0) THEN latency_us END) AS p50, max(CASE WHEN i = floor(n * 95 / 100.0) THEN latency_us END) AS p95, max(CASE WHEN i = floor(n * 99 / 100.0) THEN latency_us END) AS p99, max(latency_us) AS max_us FROM o GROUP BY endpoint)
SELECT s.endpoint, t.n, round(s.mean / 1000, 6) AS avg_ms, CAST(s.p50 AS DOUBLE) / 1000 AS p50_ms, CAST(s.p95 AS DOUBLE) / 1000 AS p95_ms, CAST(s.p99 AS DOUBLE) / 1000 AS p99_ms, CAST(s.max_us AS DOUBLE) / 1000 AS max_ms FROM s JOIN (SELECT endpoint, count(*) AS n FROM p_requests GROUP BY endpoint) t ON t.endpoint = s.endpoint""",
    "latency_hourly": "SELECT endpoint, @HOUR_NO(ts) AS hour, count(*) AS n, CAST(sum(latency_us) AS BIGINT) AS sum_us, max(latency_us) AS max_us FROM p_requests GROUP BY endpoint, @HOUR_NO(ts)",
    "latency_series": """WITH b AS (SELECT endpoint, @HOUR_NO(ts) AS hour, count(*) AS n, CAST(sum(latency_us) AS BIGINT) AS sum_us, max(latency_us) AS max_us FROM p_requests GROUP BY endpoint, @HOUR_NO(ts)),
h AS (SELECT e.endpoint, s.hour FROM (SELECT DISTINCT endpoint FROM p_requests) e CROSS JOIN (SELECT @SERIES(CAST(474071 - 167 AS BIGINT), CAST(474071 AS BIGINT)) AS hour) s)
SELECT h.endpoint, h.hour, COALESCE(b.n, 0) AS n, round(COALESCE(CAST(b.sum_us AS DOUBLE) / b.n, 0.0), 6) AS avg_us, COALESCE(b.max_us, 0) AS max_us FROM h LEFT JOIN b ON b.endpoint = h.endpoint AND b.hour = h.hour""",
    # The last 60 slots of 100 ms up to the latest request, empty ones included.
    "activity_slots": """WITH b AS (SELECT CAST(floor(@EPOCH(ts) * 10) AS BIGINT) AS slot, count(*) AS n FROM p_requests GROUP BY CAST(floor(@EPOCH(ts) * 10) AS BIGINT)),
h AS (SELECT @SERIES(last - 59, last) AS slot FROM (SELECT max(slot) AS last FROM b) m) SELECT h.slot, COALESCE(b.n, 0) AS n FROM h LEFT JOIN b ON b.slot = h.slot""",
    "traffic_series": "SELECT @HOUR_NO(ts) AS hour, count(*) AS n FROM p_requests WHERE endpoint <> 'error' GROUP BY @HOUR_NO(ts)",
    "latency_rollup": "SELECT endpoint, round(sum(avg_us * n) / sum(n), 6) AS avg_us, max(max_us) AS worst FROM (SELECT endpoint, @HOUR_NO(ts) AS hour, avg(latency_us) AS avg_us, count(*) AS n, max(latency_us) AS max_us FROM p_requests GROUP BY endpoint, @HOUR_NO(ts)) b GROUP BY endpoint",
    "bench_stats": "SELECT endpoint, count(*) AS n, round(avg(latency_us), 6) AS mean, min(latency_us) AS least, max(latency_us) AS most, round(median(latency_us), 6) AS median, round(stddev_samp(latency_us), 6) AS deviation FROM p_requests GROUP BY endpoint",
    "counters": "SELECT b.n + COALESCE(d.n, 0) AS total FROM (SELECT count(*) AS n FROM p_search_events WHERE searched_at < TIMESTAMP '2024-01-20 00:00:00') b CROSS JOIN (SELECT count(*) AS n FROM p_search_events WHERE searched_at >= TIMESTAMP '2024-01-20 00:00:00') d",
}

_RECENT = f"@MINUS_DAYS({AS_OF}, 30)"
_TOLD = "COALESCE(is_bridgyfed, 0) = 0"
#: The first day whose arrivals were seen as they came, characters of a novel.
EPOCH, NOVEL = "2024-01-02", 500_000
_WORDS = "CASE WHEN trim(content) = '' THEN 0 ELSE length(@GSUB(@GSUB(trim(content), '[^ \t\n\r]+', 'x'), '[ \t\n\r]+', '')) END"
FACTS = {
    "facts_tags": ranked("SELECT tag, count(*) AS n FROM p_document_tags GROUP BY tag", "n DESC, tag", 6),
    "facts_tags_once": "SELECT count(*) AS n FROM (SELECT tag FROM p_document_tags GROUP BY tag HAVING count(*) = 1) x",
    "facts_prolific": ranked(f"SELECT did, count(*) AS n FROM p_documents WHERE {_TOLD} GROUP BY did", "n DESC, did", 1),
    "facts_single_authors": f"SELECT count(CASE WHEN n = 1 THEN 1 END) AS single, count(*) AS authors FROM (SELECT did, count(*) AS n FROM p_documents WHERE {_TOLD} GROUP BY did) x",
    "facts_recent_share": f"SELECT count(CASE WHEN created_at >= @DATE_TEXT({_RECENT}) THEN 1 END) AS recent, count(*) AS n FROM p_documents WHERE {_TOLD}",
    "facts_busiest_day": ranked(f"SELECT substr(indexed_at, 1, 10) AS day, count(*) AS n FROM p_documents WHERE {_TOLD} AND indexed_at >= '{EPOCH}' GROUP BY substr(indexed_at, 1, 10)", "n DESC, day", 1),
    "facts_largest_publication": ranked(f"SELECT p.name, p.base_path, count(*) AS n FROM p_documents d JOIN p_publications p ON p.uri = d.publication_uri WHERE {_TOLD} GROUP BY p.uri, p.name, p.base_path", "n DESC, name", 1),
    "facts_publications": "SELECT count(*) AS n FROM p_publications",
    "facts_size": f"SELECT count(*) AS documents, CAST(sum(length(content)) AS BIGINT) AS chars, count(NULLIF(cover_image, '')) AS covers, CAST(round(count(NULLIF(cover_image, '')) * 100.0 / count(*), 6) AS DOUBLE) AS cover_percent, CAST(round(sum(length(content)) / {NOVEL}.0, 6) AS DOUBLE) AS novels FROM p_documents WHERE {_TOLD}",
    "facts_new_authors": f"SELECT count(*) AS n FROM (SELECT did FROM p_documents WHERE {_TOLD} GROUP BY did HAVING min(indexed_at) >= @DATE_TEXT({_RECENT})) x",
    "facts_other_platforms": f"SELECT count(*) AS n FROM p_documents WHERE {_TOLD} AND platform = 'other'",
    "facts_per_platform": "SELECT platform, count(*) AS n, count(DISTINCT did) AS authors, CAST(sum(length(content)) AS BIGINT) AS chars FROM p_documents GROUP BY platform",
    "facts_longest": ranked(f"SELECT uri, {_WORDS} AS words FROM (SELECT uri, content FROM p_documents WHERE {_TOLD} ORDER BY length(content) DESC, uri LIMIT 10) x", "words DESC, uri", 1),
    "author_aggregates": "SELECT did, count(*) AS n, count(DISTINCT publication_uri) AS publications, round(avg(length(content)), 6) AS avg_length FROM p_documents GROUP BY did HAVING count(*) >= 5",
    "legacy_counter_events": "SELECT query, @SERIES(CAST(1 AS BIGINT), CAST(least(n, 5) AS BIGINT)) AS seq FROM (SELECT lower(trim(query)) AS query, count(*) AS n FROM p_search_events GROUP BY lower(trim(query))) x WHERE length(query) >= 2",
    "last_recommend": f"SELECT r.did, max({when()}) AS last_at FROM p_recommends r GROUP BY r.did",
}


def queries() -> dict[str, str]:
    return {f"timeline_{s}_{f[:-3]}": timeline(s, f) for s in _UNIT for f in ("indexed_at", "created_at")} | DASHBOARD | LATENCY | FACTS
