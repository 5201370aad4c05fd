"""Nested-record extraction over JSON text columns: variant paths and built-in array functions.

Lists nest without bound, so flattening pages is an Arrow function, applied to the records that hold blocks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import tid_time, without_scheme

# Blocks with plain text, the block with a label, the list, the image; collections by lexicon.
PLAIN_BLOCKS = frozenset(f"pub.leaflet.blocks.{k}" for k in ("text", "header", "blockquote", "code"))
BUTTON, LIST, IMAGE = "pub.leaflet.blocks.button", "pub.leaflet.blocks.unorderedList", "pub.leaflet.blocks.image"
PRIVATE_COLLECTION = "com.whtwnd.blog.entry"
REASON = 280
TOO_LARGE = 16 << 20


def _said(holder, name: str) -> list[str]:
    value = holder.get(name) if isinstance(holder, dict) else None
    return [value] if isinstance(value, str) and value else []


def list_texts(node) -> list[str]:
    """The texts of a list block and of the lists in it, in order."""
    children = node.get("children") if isinstance(node, dict) else None
    out = []
    for item in children if isinstance(children, list) else []:
        if isinstance(item, dict):
            out += _said(item.get("content"), "plaintext") + list_texts(item)
    return out


def _blocks(pages):
    for page in pages if isinstance(pages, list) else []:
        held = page.get("blocks") if isinstance(page, dict) else None
        for wrapper in held if isinstance(held, list) else []:
            block = wrapper.get("block") if isinstance(wrapper, dict) else None
            if isinstance(block, dict) and isinstance(block.get("$type"), str):
                yield block


def page_texts(pages) -> list[str]:
    """The texts of all pages' blocks that hold some."""
    out = []
    for block in _blocks(pages):
        kind = block["$type"]
        out += _said(block, "plaintext") if kind in PLAIN_BLOCKS else _said(block, "text") if kind == BUTTON else list_texts(block) if kind == LIST else []
    return out


def first_image(pages) -> str | None:
    for block in _blocks(pages):
        image = block.get("image") if block["$type"] == IMAGE else None
        ref = image.get("ref") if isinstance(image, dict) else None
        link = ref.get("$link") if isinstance(ref, dict) else None
        if isinstance(link, str):
            return link
    return None


def _loaded(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def _pages_of(record):
    if not isinstance(record, dict):
        return None
    if isinstance(record.get("pages"), list):
        return record["pages"]
    inner = record.get("content")
    return inner.get("pages") if isinstance(inner, dict) else None


def _deep(record: Column) -> Column:
    """(texts of the pages joined by a space, first image) of records that hold blocks."""

    @F.pandas_udf("texts string, image string")
    def run(s: pd.Series) -> pd.DataFrame:
        pages = [_pages_of(_loaded(r)) for r in s]
        return pd.DataFrame({"texts": [" ".join(page_texts(p)) for p in pages], "image": [first_image(p) for p in pages]})

    return run(record)


def blob_texts(body: str = "body") -> Column:
    """The text of pages that lie outside their record; null unless they are a JSON array, or if they are too large."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        pages = s.map(_loaded)
        return pages.map(lambda p: " ".join(page_texts(p)) if isinstance(p, list) else None)

    return F.when(F.octet_length(body) <= TOO_LARGE, run(F.col(body)))


def _path(path: str, kind: str = "string") -> str:
    """A value of the record, only if it is of that kind."""
    value = f"variant_get(v, '{path}', 'variant')"
    is_kind = {"string": "'STRING'", "boolean": "'BOOLEAN'"}[kind]
    return f"CASE WHEN schema_of_variant({value}) = {is_kind} THEN try_variant_get(v, '{path}', '{kind}') END"


def documents(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds title, content, created_at, publication_uri, path, content_type, cover_image, tags, visibility and blob.

    Content is the flat text, else a content that is a string, else the description and the texts of the blocks; it
    is empty where only a blob holds it.  A record without a title or any content has null there and is not indexed."""
    r = records.withColumn("v", F.expr(f"try_parse_json({record})"))
    r = r.withColumn("_deep", F.when(F.col(record).contains("blocks"), _deep(F.col(record))))
    blob = _path('$.content.blobPages.ref["$link"]')
    built = f"concat_ws(' ', nullif({_path('$.description')}, ''), nullif(_deep.texts, ''))"
    return r.select(
        *records.columns,
        F.expr(_path("$.title")).alias("title"),
        F.expr(f"coalesce({_path('$.textContent')}, {_path('$.content')}, nullif({built}, ''), IF(({blob}) IS NOT NULL, '', NULL))").alias("content"),
        F.expr(f"coalesce({_path('$.publishedAt')}, {_path('$.createdAt')})").alias("created_at"),
        F.expr(f"coalesce({_path('$.publication')}, {_path('$.publication.uri')}, {_path('$.site')}, {_path('$.site.uri')})").alias("publication_uri"),
        F.expr(_path("$.path")).alias("path"),
        F.expr(_path('$.content["$type"]')).alias("content_type"),
        F.expr(f"coalesce({_path('$.coverImage.ref[\"$link\"]')}, _deep.image)").alias("cover_image"),
        F.expr("transform(filter(coalesce(try_variant_get(v, '$.tags', 'array<variant>'), array()), t -> schema_of_variant(t) = 'STRING'), t -> try_variant_get(t, '$', 'string'))").alias("tags"),
        F.expr(f"coalesce({_path('$.visibility')}, 'public')").alias("visibility"),
        F.expr(blob).alias("blob"),
    )


def hydrated(docs: DataFrame, blobs: DataFrame) -> DataFrame:
    """docs with the text of their blob (did, cid, body) after their own; without the blob they stay as they are."""
    b = blobs.select("did", F.col("cid").alias("blob"), blob_texts().alias("_t"))
    return docs.join(b, ["did", "blob"], "left").withColumn("content", F.expr("concat_ws(' ', nullif(content, ''), nullif(_t, ''))")).drop("_t")


def eligibility(title: str = "title", content: str = "content") -> str:
    """SQL: whether an extracted record can be indexed."""
    return f"CASE WHEN {title} IS NULL THEN 'no_title' WHEN {content} IS NULL THEN 'no_content' ELSE 'eligible' END"


def publications(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds name, description, base_path and show_in_discover: the host of the older lexicon, or the address without its scheme."""
    r = records.withColumn("v", F.expr(f"try_parse_json({record})")).withColumn("_url", F.expr(_path("$.url")))
    return r.select(
        *records.columns,
        F.expr(_path("$.name")).alias("name"),
        F.expr(_path("$.description")).alias("description"),
        F.coalesce(F.expr(_path("$.base_path")), without_scheme("_url")).alias("base_path"),
        F.expr(f"coalesce({_path('$.preferences.showInDiscover', 'boolean')}, true)").alias("show_in_discover"),
    )


def recommends(records: DataFrame, record: str = "record", collection: str = "collection") -> DataFrame:
    """The endorsed document: `subject` in the older lexicon, `document` in the newer."""
    r = records.withColumn("v", F.expr(f"try_parse_json({record})"))
    return r.select(*records.columns, F.expr(f"CASE WHEN startswith({collection}, 'pub.leaflet.') THEN {_path('$.subject')} ELSE {_path('$.document')} END").alias("document_uri"), F.expr(_path("$.createdAt")).alias("created_at"))


def subscriptions(records: DataFrame, record: str = "record", rkey: str = "rkey") -> DataFrame:
    """Adds publication_uri and created_at; without a time of its own it is that of the record's key."""
    r = records.withColumn("v", F.expr(f"try_parse_json({record})"))
    told = F.date_format(tid_time(rkey), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return r.select(*records.columns, F.expr(_path("$.publication")).alias("publication_uri"), F.coalesce(F.expr(_path("$.createdAt")), told).alias("created_at"))


def sidecars(records: DataFrame, record: str = "record") -> DataFrame:
    """(publication_uri) that sidecar records name."""
    r = records.withColumn("v", F.expr(f"try_parse_json({record})"))
    return r.select(F.expr(_path("$.publication.uri")).alias("publication_uri")).where("publication_uri IS NOT NULL")


def verdict(reply: str) -> Column:
    """The last verdict of a reply: true, false, or null when it holds none."""
    found = f"regexp_extract_all({reply}, '\"machine\": ?(true|false)', 1)"
    return F.expr(f"CASE WHEN size({found}) > 0 THEN {found}[size({found}) - 1] = 'true' END")


def verdict_reason(reply: str) -> Column:
    """The reason in the object of the last verdict, cut; braces within it don't end it."""

    def reason(text: str | None) -> str | None:
        at = max((text or "").rfind(f'"machine":{s}{v}') for s in ("", " ") for v in ("true", "false"))
        if at < 0:
            return None
        start, close = text.rfind("{", 0, at), text.find("}", at)
        while 0 <= start and 0 <= close:
            inner = _loaded(text[start : close + 1])
            if inner is not None:
                said = inner.get("reason") if isinstance(inner, dict) else None
                return said.encode()[:REASON].decode("utf-8", "ignore") if isinstance(said, str) else ""
            close = text.find("}", close + 1)
        return ""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(reason)

    return run(F.col(reply))


def reply_of(response: str) -> Column:
    """The text of a chat completion's first choice."""
    return F.expr(f"try_variant_get(try_parse_json({response}), '$.choices[0].message.content', 'string')")
