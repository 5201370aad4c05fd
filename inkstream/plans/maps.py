"""Queries of the map, the facts that clocks decide, and the small rules, each with an oracle of its own text."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, scalars
from ..functions.common import AS_OF
from ..operators import maps, search, vectors
from ..sources import store
from ..sources.projection import Corpus, with_views
from . import oracles as o

Plan = tuple[Callable[[Corpus], DataFrame], str]
RADIUS, TIERS = 0.03, {"coarse": (6, 12), "fine": (3, 6)}
NOW = dt.datetime(2024, 1, 31, 12, 30, tzinfo=dt.UTC)


def _points(c: Corpus) -> DataFrame:
    return c.embeddings.select(F.col("vec_id").alias("id"), F.expr("CAST(embedding[0] AS DOUBLE)").alias("x"), F.expr("CAST(embedding[1] AS DOUBLE)").alias("y"))


def _placed(c: Corpus) -> DataFrame:
    return _points(c).join(c.p_documents.select(F.col("doc_id").alias("id"), "uri"), "id").select("uri", "x", "y")


def _clusters(c: Corpus, tier: str) -> DataFrame:
    return maps.density_clusters(_points(c), RADIUS, *TIERS[tier])


def _cluster_ctes(tier: str) -> str:
    samples, size = TIERS[tier]
    return f"""WITH RECURSIVE pt AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
pr AS (SELECT a.id AS a, b.id AS b FROM pt a JOIN pt b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {RADIUS} * {RADIUS}),
dn AS (SELECT a AS id FROM pr GROUP BY a HAVING count(*) >= {samples}),
lk AS (SELECT a, b FROM pr WHERE a IN (SELECT id FROM dn) AND b IN (SELECT id FROM dn)),
rc AS (SELECT id, id AS c FROM dn UNION SELECT lk.b, rc.c FROM rc JOIN lk ON lk.a = rc.id WHERE rc.c < lk.b),
cm AS (SELECT id, min(c) AS c FROM rc GROUP BY id),
mb AS (SELECT id, c FROM cm UNION ALL SELECT pr.a, min(cm.c) FROM pr JOIN cm ON cm.id = pr.b WHERE pr.a NOT IN (SELECT id FROM dn) GROUP BY pr.a),
ms AS (SELECT id, c FROM mb WHERE c IN (SELECT c FROM mb GROUP BY c HAVING count(*) >= {size})),
ct AS (SELECT c, avg(x) AS mx, avg(y) AS my FROM ms JOIN pt USING (id) GROUP BY c),
sn AS (SELECT id, c FROM (SELECT p.id, ct.c, row_number() OVER (PARTITION BY p.id ORDER BY round((x - mx) * (x - mx) + (y - my) * (y - my), 12), ct.c) AS r FROM pt p CROSS JOIN ct WHERE p.id NOT IN (SELECT id FROM ms)) s WHERE r = 1),
cl AS (SELECT id, c AS cluster, true AS core FROM ms UNION ALL SELECT id, c, false FROM sn)"""


_STOP = ", ".join(f"'{w}'" for w in maps.STOP_WORDS)
_LABELS = f"""{_cluster_ctes("fine")},
ti AS (SELECT cl.cluster, cl.core, d.title FROM cl JOIN p_documents d ON d.doc_id = cl.id WHERE d.title <> ''),
us AS (SELECT * FROM ti WHERE core OR cluster NOT IN (SELECT cluster FROM ti WHERE core)),
wd AS (SELECT cluster, unnest([w FOR w IN regexp_extract_all(lower(title), '[a-z0-9]+') IF length(w) >= 2 AND w NOT IN ({_STOP})]) AS w FROM us),
sc AS (SELECT f.cluster, f.w, round(f.n * (ln((1.0 + (SELECT count(DISTINCT cluster) FROM cl)) / (1.0 + count(*) OVER (PARTITION BY f.w))) + 1), 6) AS s FROM (SELECT cluster, w, count(*) AS n FROM wd GROUP BY cluster, w) f),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, w) AS r FROM sc)
SELECT k.cluster, coalesce(string_agg(w, ' ' ORDER BY r), 'cluster ' || k.cluster) AS label FROM (SELECT DISTINCT cluster FROM cl) k LEFT JOIN rk ON rk.cluster = k.cluster AND r <= 3 GROUP BY k.cluster"""

_OVERLAY = f"""h AS (SELECT * FROM ({o.keyword("the license", limit=40)}) k),
m AS (SELECT h.pos, (SELECT max(pos) FROM h) - h.pos + 1 AS w, CAST(e.embedding[1] AS DOUBLE) AS x, CAST(e.embedding[2] AS DOUBLE) AS y FROM h JOIN embeddings e ON e.vec_id = CAST(regexp_extract(h.uri, '/r([0-9]+)$', 1) AS BIGINT)),
c AS (SELECT count(*) AS found, sum(x * w) / sum(w) AS cx, sum(y * w) / sum(w) AS cy FROM m), d AS (SELECT max(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS d FROM m, c)
SELECT found, round(cx, 6) AS cx, round(cy, 6) AS cy, round(greatest(4.0, least(15.0, CASE WHEN d > 0 THEN least(500.0, 0.3 / d) ELSE 6.0 END)), 6) AS zoom FROM c, d WHERE found > 0"""

_SIZES = "SELECT p.uri, round(0.06 * sqrt((SELECT count(*) FROM p_documents d WHERE d.publication_uri = p.uri)) + 0.9 * sqrt((SELECT count(DISTINCT s.did) FROM p_subscriptions s WHERE s.publication_did = p.did AND s.publication_rkey = p.rkey)), 6) AS score FROM p_publications p"
_ORDER = """WITH b AS (SELECT uri, w FROM (SELECT r.document_uri AS uri, count(DISTINCT r.did) AS w, any_value(coalesce(d.created_at, '')) AS made FROM p_recommends r JOIN p_documents d ON d.uri = r.document_uri GROUP BY r.document_uri) x ORDER BY w DESC, made DESC, uri LIMIT 250),
n AS (SELECT base_path, count(*) AS n FROM p_documents WHERE base_path <> '' GROUP BY base_path)
SELECT d.uri, round(ln(1 + coalesce(n.n, 0)) + coalesce(6.0 + ln(1 + b.w), 0.0), 6) AS weight FROM p_documents d LEFT JOIN n ON n.base_path = d.base_path LEFT JOIN b ON b.uri = d.uri"""


# ---- facts that the record key's time decides


def _clocked(c: Corpus) -> DataFrame:
    t = c.t_documents.where("coalesce(is_bridgyfed, 0) = 0").withColumn("wrote", scalars.tid_time("rkey"))
    near = lambda x: f"abs(unix_micros(wrote) - unix_micros(try_to_timestamp({x}))) < 86400000000"
    return t.withColumn("agrees", F.expr(f"coalesce({near('created_at')} AND {near('indexed_at')}, false)"))


def _first_arrivals(c: Corpus, epoch: str = "2024-01-02") -> DataFrame:
    """(platform, uri): the first document whose three clocks agree, of all and of each platform.

    A platform has none if a document of the overall first's title comes before its own."""
    rows = _clocked(c).where(F.col("indexed_at") >= epoch)
    at = F.struct("indexed_at", "uri", "title")
    first = rows.where("agrees").agg(F.min(at).alias("f"))
    own = rows.where("platform <> 'other'").crossJoin(F.broadcast(first)).groupBy("platform").agg(F.min(F.when(F.col("agrees"), at)).alias("a"), F.min(F.when(F.col("title") == F.col("f.title"), at)).alias("same"))  # one row
    own = own.where("a IS NOT NULL AND (same IS NULL OR a < same)").select("platform", F.col("a.uri").alias("uri"))
    return first.where("f IS NOT NULL").select(F.lit("all").alias("platform"), F.col("f.uri").alias("uri")).unionByName(own)


_TID = "(list_reduce([CAST(strpos('234567abcdefghijklmnopqrstuvwxyz', substr(rkey, k, 1)) - 1 AS HUGEINT) FOR k IN range(1, 14)], lambda a, b: a * 32 + b) // 1024) / 1e6"
_CLOCKED = f"t AS (SELECT *, {_TID} AS wrote, epoch(try_cast(nullif(created_at, '') AS TIMESTAMP)) AS made, epoch(CAST(indexed_at AS TIMESTAMP)) AS came FROM t_documents WHERE is_bridgyfed = 0)"
_ARRIVALS = f"""WITH {_CLOCKED}, r AS (SELECT *, coalesce(abs(wrote - made) < 86400, false) AND abs(wrote - came) < 86400 AS ok, row_number() OVER (ORDER BY indexed_at, uri, title) AS i FROM t WHERE indexed_at >= '2024-01-02'),
f AS (SELECT uri, title FROM r WHERE ok ORDER BY i LIMIT 1)
SELECT 'all' AS platform, uri FROM f UNION ALL SELECT platform, (SELECT uri FROM r q WHERE q.i = m) FROM (SELECT platform, min(CASE WHEN ok THEN i END) AS m, min(CASE WHEN title = (SELECT title FROM f) THEN i END) AS s FROM r WHERE platform <> 'other' GROUP BY platform) g WHERE m IS NOT NULL AND (s IS NULL OR m < s)"""


def _deepest_import(c: Corpus) -> DataFrame:
    gap = F.expr("(unix_micros(wrote) - unix_micros(try_to_timestamp(created_at))) / 86400e6D")
    rows = _clocked(c).where("created_at >= '1995'").withColumn("days", F.round(gap, 6)).where("days > 90")
    return search.numbered(rows.select("uri", "days", "created_at"), F.desc("days"), "created_at", "uri", limit=1).select("uri", "days")


_IMPORT = f"WITH {_CLOCKED} SELECT uri, round((wrote - made) / 86400, 6) AS days FROM t WHERE created_at >= '1995' AND (wrote - made) / 86400 > 90 ORDER BY days DESC, created_at, uri LIMIT 1"


# ---- rules


def _windows(c: Corpus) -> DataFrame:
    spans = [(s, f, rules.bucket_label(s, f)) for s in ("7d", "30d", "90d", "1y", "all") for f in ("indexed_at", "created_at")]
    slugs = [(s, "days", str(rules.window_days(s))) for s in ("day", "week", "month", "year", "all", "never")]
    return c.spark.createDataFrame(spans + slugs, "name string, field string, value string")


_WINDOWS = "SELECT * FROM (VALUES ('7d', 'indexed_at', 'daily'), ('7d', 'created_at', 'daily'), ('30d', 'indexed_at', 'daily'), ('30d', 'created_at', 'daily'), ('90d', 'indexed_at', 'daily'), ('90d', 'created_at', 'daily'), ('1y', 'indexed_at', 'weekly'), ('1y', 'created_at', 'weekly'), ('all', 'indexed_at', 'monthly'), ('all', 'created_at', 'yearly'), ('day', 'days', '1'), ('week', 'days', '7'), ('month', 'days', '30'), ('year', 'days', '365'), ('all', 'days', 'None'), ('never', 'days', 'None')) t(name, field, value)"


def _scales(c: Corpus) -> DataFrame:
    e = c.events.select("event_id", F.col("value").alias("v"), F.expr("event_id % 7").alias("d"), F.expr("CAST(unix_timestamp(ts) AS BIGINT)").alias("at"))
    r6 = lambda x: F.round(F.expr(x), 6)
    return e.select("event_id", rules.iso_time("at").alias("iso"), r6(rules.clamp01("v / 100 - 0.2D")).alias("clamped"), r6(rules.share("event_id", "d")).alias("share"), r6(rules.log_volume("event_id")).alias("volume"), r6(rules.fade("v", 10, 60)).alias("faded"))


_SCALES = "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso, round(CASE WHEN value / 100 - 0.2 < 0 THEN 0.0 WHEN value / 100 - 0.2 > 1 THEN 1.0 ELSE value / 100 - 0.2 END, 6) AS clamped, round(CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE event_id / CAST(event_id % 7 AS DOUBLE) END, 6) AS share, round(CASE WHEN event_id <= 100 THEN 0.0 WHEN event_id >= 10000 THEN 1.0 ELSE log10(event_id) / 2 - 1 END, 6) AS volume, round(CASE WHEN value <= 10 THEN 0.0 WHEN value >= 60 THEN 1.0 ELSE (value - 10) / 50.0 END, 6) AS faded FROM events"


def _staleness(c: Corpus) -> DataFrame:
    m = c.events.select("event_id", F.expr("CASE WHEN event_id % 50 = 0 THEN 0 ELSE unix_timestamp(ts) END").alias("t"))
    policies = {"windowed": (True, "8, 9"), "always": (True, ""), "off": (False, "8"), "broken": (True, "8,x")}
    return m.select("event_id", *(rules.staleness("t", NOW, *p).alias(n) for n, p in policies.items()))


_STALENESS = "SELECT event_id, CASE WHEN z THEN 'invalid' WHEN t < epoch(TIMESTAMP '2024-01-31 06:30:00') THEN 'stale' ELSE 'fresh' END AS windowed, CASE WHEN z THEN 'invalid' WHEN t < epoch(TIMESTAMP '2024-01-31 09:30:00') THEN 'stale' ELSE 'fresh' END AS always, CASE WHEN z THEN 'invalid' ELSE 'fresh' END AS off, CASE WHEN z THEN 'invalid' ELSE 'policy' END AS broken FROM (SELECT event_id, event_id % 50 = 0 AS z, epoch(date_trunc('second', ts)) AS t FROM events) e"


def _posted(c: Corpus) -> DataFrame:
    return rules.recently_posted(c.p_recommends.select(F.col("document_uri").alias("url"), "created_at"), "2024-01-24 00:00:00")


def _ring(c: Corpus) -> DataFrame:
    e = c.events.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.expr("lower(trim(regexp_extract(props, '[0-9]+', 0)))").alias("query"), F.col("ts").alias("at")).where("octet_length(query) >= 2")
    return rules.ring(e, "10 days", 20).select("id", "query")


_RING = "SELECT id, query FROM (SELECT event_id AS id, regexp_extract(props, '[0-9]+') AS query, row_number() OVER (PARTITION BY floor(epoch(ts) / 864000) ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'view' AND length(regexp_extract(props, '[0-9]+')) >= 2) e WHERE r < 20"


def _silences(c: Corpus) -> DataFrame:
    e = c.events.select(F.expr("user_id % 5").alias("stream"), F.date_trunc("second", "ts").alias("at")).distinct()
    return rules.silences(e, seconds=7200).select("stream", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "seconds")


_SILENCES = "SELECT stream, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, CAST(epoch(t) - epoch(since) AS BIGINT) AS seconds FROM (SELECT stream, t, lag(t) OVER (PARTITION BY stream ORDER BY t) AS since FROM (SELECT DISTINCT user_id % 5 AS stream, date_trunc('second', ts) AS t FROM events) e) x WHERE epoch(t) - epoch(since) > 7200"


def _bodies(c: Corpus) -> DataFrame:
    body = F.expr("CASE event_id % 3 WHEN 0 THEN concat('{\"results\": [{\"id\": ', event_id, '}, {\"id\": 1}], \"total\": null}') WHEN 1 THEN concat('[{\"id\": ', event_id, '}]') ELSE '{\"error\": \"x\"}' END")
    rows = c.events.select("event_id", body.alias("body"))
    return rows.select("event_id", F.explode(rules.results_of("body")).alias("r")).select("event_id", F.get_json_object("r", "$.id").cast("long").alias("id"))


_BODIES = "SELECT event_id, unnest(CASE event_id % 3 WHEN 0 THEN [event_id, 1] WHEN 1 THEN [event_id] ELSE [] END) AS id FROM events WHERE event_id % 3 < 2"


def _cached(c: Corpus) -> DataFrame:
    """The leaderboard of tags as a cache holds it: computed, kept while fresh, and kept when a later computation fails."""
    board = lambda: c.p_document_tags.groupBy("tag").agg(F.count("*").alias("n"))
    name = f"tags-{c.state()}"
    store.cached(c.spark, name, board, 1800, now=1000.0)

    def broken() -> DataFrame:
        raise RuntimeError("the source is away")

    return store.cached(c.spark, name, broken, 1800, now=9000.0)


PLANS: dict[str, Plan] = {
    "publication_size_score": (lambda c: maps.size_scores(c.p_publications, c.p_documents, c.p_subscriptions), with_views(_SIZES)),
    "label_popularity": (lambda c: maps.label_order(c.p_documents, c.p_recommends), with_views(_ORDER)),
    "map_search_overlay": (lambda c: maps.search_overlay(search.keyword(_index(c), "the license", 40).select("uri", "pos"), _placed(c)), f"WITH {_OVERLAY}"),
    "map_places": (lambda c: maps.place_of(c.p_documents.select("uri"), _placed(c)).select("uri", "found", F.round("x", 6).alias("x")), with_views("SELECT d.uri, e.vec_id IS NOT NULL AS found, round(CAST(e.embedding[1] AS DOUBLE), 6) AS x FROM p_documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")),
    "map_scaled": (lambda c: maps.scaled(_points(c)), "SELECT vec_id AS id, round(2 * (CAST(embedding[1] AS DOUBLE) - min(CAST(embedding[1] AS DOUBLE)) OVER ()) / (max(CAST(embedding[1] AS DOUBLE)) OVER () - min(CAST(embedding[1] AS DOUBLE)) OVER ()) - 1, 6) AS x, round(2 * (CAST(embedding[2] AS DOUBLE) - min(CAST(embedding[2] AS DOUBLE)) OVER ()) / (max(CAST(embedding[2] AS DOUBLE)) OVER () - min(CAST(embedding[2] AS DOUBLE)) OVER ()) - 1, 6) AS y FROM embeddings"),
    "map_projection": (lambda c: maps.scaled(maps.projected(c.embeddings, 2).select("vec_id", F.expr("axis[0]").alias("x"), F.expr("axis[1]").alias("y"))), ""),
    "cluster_coarse": (lambda c: _clusters(c, "coarse").select("id", "cluster", "core"), f"{_cluster_ctes('coarse')} SELECT id, cluster, core FROM cl"),
    "cluster_fine": (lambda c: _clusters(c, "fine").select("id", "cluster", "core"), f"{_cluster_ctes('fine')} SELECT id, cluster, core FROM cl"),
    "cluster_labels_tfidf": (lambda c: maps.cluster_labels(_clusters(c, "fine"), c.p_documents.select(F.col("doc_id").alias("id"), "title")), with_views(_LABELS)),
    "cluster_context": (lambda c: vectors.neighbourhood(c.embeddings, c.p_documents, 7), o.neighbourhood(7)),
    "facts_first_arrival": (_first_arrivals, with_views(_ARRIVALS)),
    "facts_deepest_import": (_deepest_import, with_views(_IMPORT)),
    "rule_windows": (_windows, _WINDOWS),
    "rule_scales": (_scales, _SCALES),
    "rule_staleness": (_staleness, _STALENESS),
    "rule_edge_cache": (lambda c: c.events.select("event_id", F.expr(rules.edge_state("CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 2400 END")).alias("state")), "SELECT event_id, CASE WHEN event_id % 9 = 0 OR event_id % 2400 > 1800 THEN 'miss' WHEN event_id % 2400 <= 600 THEN 'hit' ELSE 'stale' END AS state FROM events"),
    "rule_posted": (_posted, with_views("SELECT DISTINCT document_uri AS url FROM p_recommends WHERE created_at = '' OR created_at >= '2024-01-24T00:00:00'")),
    "rule_ring": (_ring, _RING),
    "rule_silences": (_silences, _SILENCES),
    "rule_result_lists": (_bodies, _BODIES),
    "cached_leaderboard": (_cached, with_views("SELECT tag, count(*) AS n FROM p_document_tags GROUP BY tag")),
    "table_catalog": (lambda c: c.catalog(), "SELECT table_name AS name, CAST(count(*) AS BIGINT) AS columns FROM information_schema.columns WHERE table_name IN ('documents', 'embeddings', 'events', 'labels') GROUP BY table_name"),
}


def _index(c: Corpus):
    from .registry import documents

    return documents(c)
