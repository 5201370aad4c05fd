"""The write path of documents, publications, edges, labels and vectors: every write is a merge that may be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import vector_id

# Hosts by which a platform is known.
HOSTS = (("leaflet", "leaflet.pub"), ("pckt", "pckt.blog"), ("offprint", "offprint.app"), ("greengale", "greengale.app"), ("lemma", "lemma.pub"))
CONTENT_TYPES = (("leaflet", "pub.leaflet."), ("lemma", "pub.lemma."))
OWN_HOST = ("greengale", "pckt", "offprint", "leaflet")
STORED = ("uri", "did", "rkey", "title", "content", "created_at", "publication_uri", "platform", "source_collection", "path", "base_path", "has_publication", "content_hash", "cover_image", "indexed_at", "is_bridgyfed", "content_type", "source_cid", "embedded_at")


def content_hash(title: str = "title", content: str = "content") -> str:
    """SQL: what decides whether a document's content is the same."""
    return f"md5(concat(coalesce({title}, ''), chr(0), coalesce({content}, '')))"


def resolved_base_path(docs: DataFrame, publications: DataFrame) -> DataFrame:
    """docs with base_path, of five sources the first that is not empty, and pub_is_pckt.

    The publication's own; the root host of an http site; of the author's publications the longest on the
    document's platform, then the longest of all; the site's address without its scheme."""
    pubs = publications.select(F.col("uri").alias("publication_uri"), F.col("base_path").alias("_own"), (F.col("platform") == "pckt").alias("_sidecar"))
    longest = lambda where, name: publications.where(where).groupBy("did").agg(F.max(F.struct(F.length("base_path").alias("n"), "base_path"))["base_path"].alias(name))
    out = docs.join(pubs, "publication_uri", "left").join(longest("base_path <> ''", "_any"), "did", "left")
    best = F.lit(None).cast("string")
    for platform, host in HOSTS:
        if platform in OWN_HOST:
            out = out.join(longest(f"base_path ILIKE '%{host}%'", f"_{platform}"), "did", "left")
            best = F.when(F.col("platform") == platform, F.col(f"_{platform}")).otherwise(best)
    site = "coalesce(publication_uri, '')"
    root = f"regexp_extract({site}, '^https?://([^/?#]+)/?$', 1)"
    stripped = f"CASE WHEN {site} RLIKE '^https?://' THEN regexp_replace(regexp_replace({site}, '^https?://', ''), '/$', '') ELSE '' END"
    steps = [F.col("_own"), F.expr(root), best, F.col("_any"), F.expr(stripped)]
    chosen = F.coalesce(*(F.when(c != "", c) for c in steps), F.lit(""))
    drop = [c for c in out.columns if c.startswith("_")]
    return out.withColumn("base_path", F.regexp_replace(chosen, "(?<=.)/$", "")).withColumn("pub_is_pckt", F.coalesce("_sidecar", F.lit(False))).drop(*drop)


def refined_platform(platform: str = "platform", base_path: str = "base_path", content_type: str = "content_type", pub_is_pckt: str = "pub_is_pckt") -> str:
    """SQL: an unknown platform by the sidecar's mark, then the host, then the type of the content."""
    hosts = " ".join(f"WHEN contains({base_path}, '{h}') THEN '{p}'" for p, h in HOSTS)
    types = " ".join(f"WHEN startswith({content_type}, '{t}') THEN '{p}'" for p, t in CONTENT_TYPES)
    return f"CASE WHEN {platform} NOT IN ('unknown', 'other') THEN {platform} WHEN {pub_is_pckt} THEN 'pckt' {hosts} {types} ELSE {platform} END"


def cid_gate_skips(stored_cid: str, cid: str, stored_length: str, length: str) -> str:
    """SQL: the same record is stored already, with more text than it holds inline."""
    return f"coalesce({stored_cid}, '') <> '' AND coalesce({cid}, '') <> '' AND {stored_cid} = {cid} AND {stored_length} > {length}"


def verdicts(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """batch with stale_uri (an older record of the same did and rkey) and verdict: new, same_document, rename or
    cross_platform_dupe, by the least uri among the author's rows of equal content."""
    old = stored.select("did", "rkey", F.col("uri").alias("_u")).groupBy("did", "rkey").agg(F.min("_u").alias("_old"))
    same = stored.groupBy("did", "content_hash").agg(F.min(F.struct("uri", F.coalesce("source_collection", F.lit("")).alias("c"))).alias("_same"))
    out = batch.withColumn("content_hash", F.expr(content_hash())).join(old, ["did", "rkey"], "left").join(same, ["did", "content_hash"], "left")
    rule = "CASE WHEN _same IS NULL THEN 'new' WHEN _same.uri = uri THEN 'same_document' WHEN _same.c = source_collection THEN 'rename' ELSE 'cross_platform_dupe' END"
    return out.withColumn("verdict", F.expr(rule)).withColumn("stale_uri", F.expr("CASE WHEN _old <> uri THEN _old END")).drop("_old", "_same")


def admitted(batch: DataFrame, stored: DataFrame, publications: DataFrame, banned: list[str]) -> DataFrame:
    """The rows of a batch that are written, as they are written: banned authors, test hosts and cross-posts are dropped."""
    rows = verdicts(batch.where(~F.col("did").isin(banned) & (F.coalesce("visibility", F.lit("public")) != "author")), stored).where("verdict <> 'cross_platform_dupe'")
    rows = resolved_base_path(rows.drop("base_path"), publications).where("NOT endswith(base_path, '.test')")
    rows = rows.withColumn("platform", F.expr(refined_platform()))
    return rows.withColumn("has_publication", F.expr("IF(coalesce(publication_uri, '') <> '', 1, 0)")).withColumn("is_bridgyfed", F.lit(0))


def merged_documents(stored: DataFrame, written: DataFrame, as_of: str) -> DataFrame:
    """The table after a batch: stale rows are gone, indexed_at changes with the content only, embedded_at stays."""
    kept = stored.join(written.where("stale_uri IS NOT NULL").select(F.col("stale_uri").alias("uri")).distinct(), "uri", "left_anti")
    old = kept.select("uri", *(F.col(c).alias(f"_{c}") for c in STORED if c != "uri"), F.lit(True).alias("_is"))
    new = written.withColumn("_new", F.lit(True)).select("uri", "_new", *(c for c in STORED if c not in ("uri", "indexed_at", "embedded_at")))
    both = old.join(new, "uri", "full")
    value = lambda c: F.expr(f"CASE WHEN _new THEN {c} ELSE _{c} END").alias(c)
    when = F.expr(f"CASE WHEN _is AND (_new IS NULL OR _content_hash <=> content_hash) THEN _indexed_at ELSE '{as_of}' END")
    return both.select("uri", *(when.alias(c) if c == "indexed_at" else F.col("_embedded_at").alias(c) if c == "embedded_at" else value(c) for c in STORED if c != "uri"))


def replaced_tags(tags: DataFrame, written: DataFrame) -> DataFrame:
    """The tag table after a batch: all tags of written and stale documents go, each new pair comes once."""
    gone = written.select("uri").unionByName(written.where("stale_uri IS NOT NULL").select(F.col("stale_uri").alias("uri")))
    new = written.select(F.col("uri").alias("document_uri"), F.explode("tags").alias("tag")).where("tag IS NOT NULL").dropDuplicates()
    return tags.select("document_uri", "tag").join(gone.withColumnRenamed("uri", "document_uri"), "document_uri", "left_anti").unionByName(new)


def reindexed(stored: DataFrame, written: DataFrame) -> DataFrame:
    """(uri, op): which full-text rows a batch deletes and inserts; unchanged content is not touched."""
    stale = written.where("stale_uri IS NOT NULL").select(F.col("stale_uri").alias("uri"), F.lit("delete").alias("op"))
    fresh = written.where("verdict <> 'same_document'")
    again = fresh.join(stored.select("uri"), "uri", "left_semi").select("uri", F.lit("delete").alias("op"))
    return stale.unionByName(again).unionByName(fresh.select("uri", F.lit("insert").alias("op")))


def merged_publications(stored: DataFrame, batch: DataFrame, banned: list[str], as_of: str) -> DataFrame:
    """Publications after a batch (uri, did, rkey, name, description, base_path, show_in_discover): an older record of the
    same did and rkey goes, the mark of a platform stays."""
    new = batch.where(~F.col("did").isin(banned) & ~F.endswith(F.coalesce("base_path", F.lit("")), F.lit(".test")))
    renamed = stored.join(new.select("did", "rkey", F.col("uri").alias("_u")), ["did", "rkey"]).where("uri <> _u").select("uri")
    kept = stored.join(renamed, "uri", "left_anti")
    fields = ["did", "rkey", "name", "description", "base_path", "show_in_discover"]
    n = new.select("uri", *(F.coalesce(c, F.lit("")).alias(f"_{c}") if c in ("description", "base_path") else F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_new"))
    both = kept.join(n, "uri", "full")
    return both.select("uri", *(F.expr(f"CASE WHEN _new THEN _{c} ELSE {c} END").alias(c) for c in fields), F.coalesce("platform", F.lit("")).alias("platform"), F.expr(f"CASE WHEN _new THEN '{as_of}' ELSE indexed_at END").alias("indexed_at"))


def propagated_base_path(documents: DataFrame, written: DataFrame, as_of: str) -> DataFrame:
    """(uri, base_path, indexed_at): documents follow the base path of a publication that was written."""
    p = written.where("coalesce(base_path, '') <> ''").select(F.col("uri").alias("publication_uri"), F.col("base_path").alias("_b"))
    j = documents.join(p, "publication_uri", "left")
    moves = "_b IS NOT NULL AND coalesce(base_path, '') <> _b"
    return j.select("uri", F.expr(f"CASE WHEN {moves} THEN _b ELSE base_path END").alias("base_path"), F.expr(f"CASE WHEN {moves} THEN '{as_of}' ELSE indexed_at END").alias("indexed_at"))


def retagged(rows: DataFrame, sidecars: DataFrame, key: str, as_of: str, platform: str = "pckt") -> DataFrame:
    """(uri, platform, indexed_at) after sidecars named some publications; rows of that platform already are not touched."""
    s = sidecars.select(F.col("publication_uri").alias(key), F.lit(True).alias("_s")).distinct()
    moves = f"_s AND platform <> '{platform}'"
    out = rows.join(s, key, "left")
    return out.select("uri", F.expr(f"CASE WHEN {moves} THEN '{platform}' ELSE platform END").alias("platform"), F.expr(f"CASE WHEN {moves} THEN '{as_of}' ELSE indexed_at END").alias("indexed_at"))


def merged_edges(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Edges after a batch, by uri; of several rows the one of greatest seq."""
    last = batch.groupBy("uri").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "uri"]), "seq").alias("e")).select("uri", "e.*").drop("seq")
    return stored.join(last.select("uri"), "uri", "left_anti").unionByName(last)


def appended_labels(log: DataFrame, new: DataFrame) -> DataFrame:
    """The label log after an append: unsigned labels are refused, numbers go on where the log ends."""
    from pyspark.sql import Window

    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_last"))
    signed = new.where("sig IS NOT NULL AND length(sig) > 0")
    numbered = signed.crossJoin(F.broadcast(last)).withColumn("seq", F.col("_last") + F.row_number().over(Window.orderBy("cts", "src", "uri", "val"))).drop("_last")  # one row; an append is small
    return log.unionByName(numbered.select(*log.columns))


def merged_vectors(stored: DataFrame, upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """(id, uri, embedding) after a batch keyed by the hash of the uri; a delete of the batch wins."""
    new = upserts.select(vector_id("uri").alias("id"), "uri", "embedding")
    gone = deletes.select(vector_id("uri").alias("id"))
    return stored.join(new.select("id"), "id", "left_anti").unionByName(new).join(gone, "id", "left_anti")


def unembedded(documents: DataFrame, uris: DataFrame) -> DataFrame:
    """(uri, embedded_at) with the mark of some documents taken away."""
    return documents.join(uris.select("uri", F.lit(True).alias("_r")).distinct(), "uri", "left").select("uri", F.expr("CASE WHEN _r THEN NULL ELSE embedded_at END").alias("embedded_at"))


def evolved(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """df with every column of name -> (type, default) that it lacks."""
    for name, (kind, default) in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    return df
