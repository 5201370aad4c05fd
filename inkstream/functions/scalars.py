"""Scalar functions over columns, as Spark expressions; each is one built-in expression tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The base-32 alphabet of record keys whose order is that of time.
TID_ALPHABET = "234567abcdefghijklmnopqrstuvwxyz"
BRIDGE = "brid.gy"


def at_uri_did(uri: str) -> Column:
    """null unless the uri has an authority and a last segment."""
    return F.expr(f"nullif(regexp_extract({uri}, '^at://([^/]+)/(?:.*/)([^/]+)$', 1), '')")


def at_uri_rkey(uri: str) -> Column:
    return F.expr(f"nullif(regexp_extract({uri}, '^at://([^/]+)/(?:.*/)([^/]+)$', 2), '')")


def at_uri_collection(uri: str) -> Column:
    return F.expr(f"CASE WHEN size(split({uri}, '/')) = 5 THEN split({uri}, '/')[3] END")


def site_root_host(url: str) -> Column:
    """The host of a site's root, null for any page below it."""
    return F.expr(f"nullif(regexp_extract({url}, '^https?://([^/]+)/?$', 1), '')")


def without_scheme(url: str) -> Column:
    return F.expr(f"regexp_replace(regexp_replace(regexp_replace({url}, '^https?://', ''), '#.*$', ''), '/$', '')")


def url_host(url: str) -> Column:
    return F.expr(f"nullif(regexp_extract({url}, '^[a-zA-Z]+://(?:[^@/]*@)?([^/:?#]+)', 1), '')")


def is_bridged_host(endpoint: str) -> Column:
    host = f"coalesce(nullif(regexp_extract({endpoint}, '^[a-zA-Z]+://([^/:?#]+)', 1), ''), '')"
    return F.expr(f"{host} = '{BRIDGE}' OR endswith({host}, '.{BRIDGE}')")


def tid_time(rkey: str) -> Column:
    """The time in a 13-character record key, null for any other key."""
    value = f"aggregate(split({rkey}, ''), 0L, (a, c) -> a * 32 + instr('{TID_ALPHABET}', c) - 1)"
    return F.expr(f"CASE WHEN {rkey} RLIKE '^[{TID_ALPHABET}]{{13}}$' THEN timestamp_micros(shiftright({value}, 10)) END")


def clocks_agree(a: str, b: str) -> Column:
    """Two ISO times less than a day apart."""
    return F.expr(f"abs(unix_micros(try_to_timestamp({a})) - unix_micros(try_to_timestamp({b}))) < 86400000000L")


def platform_of(collection: str) -> Column:
    return F.expr(f"CASE WHEN startswith({collection}, 'pub.leaflet.') THEN 'leaflet' WHEN startswith({collection}, 'com.whtwnd.') THEN 'whitewind' WHEN startswith({collection}, 'blog.pckt.') THEN 'pckt' WHEN startswith({collection}, 'site.standard.') THEN 'unknown' ELSE 'other' END")


def content_hash(title: str, content: str) -> Column:
    return F.expr(f"sha2(concat({title}, char(0), {content}), 256)")


def vector_id(uri: str) -> Column:
    return F.expr(f"substring(sha2({uri}, 256), 1, 32)")


def hash01(text: str) -> Column:
    """A stable value in [0, 1)."""
    return F.expr(f"shiftrightunsigned(xxhash64({text}), 11) / 9007199254740992D")


def hex_colour(r: str, g: str, b: str) -> Column:
    return F.expr(f"format_string('#%02x%02x%02x', {r}, {g}, {b})")


def as_int(text: str) -> Column:
    return F.expr(f"coalesce(try_cast({text} AS BIGINT), 0L)")


def query_param(raw: str) -> Column:
    return F.expr(f"try_url_decode(replace({raw}, '+', ' '))")


def list_param(raw: str) -> Column:
    """Repeated and comma-joined values, decoded."""
    return F.expr(f"filter(transform(split({raw}, ','), x -> trim(try_url_decode(x))), x -> x <> '')")


def html_text(html: str) -> Column:
    """Text without scripts, styles, tags and the common entities, blanks collapsed."""
    e = f"regexp_replace({html}, '(?is)<(script|style)[^>]*>.*?</\\\\1>', ' ')"
    e = f"regexp_replace({e}, '<[^>]+>', ' ')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\\'"), ("&nbsp;", " "), ("&amp;", "&")):
        e = f"replace({e}, '{name}', '{char}')"
    return F.expr(f"trim(regexp_replace({e}, '\\\\s+', ' '))")


def author_mention(query: str) -> Column:
    """The handle of a from: or @ mention, and the text without it, as a struct."""
    return F.expr(f"named_struct('author', nullif(regexp_extract({query}, '(?:from:|@)([A-Za-z0-9.:-]+)', 1), ''), 'text', trim(regexp_replace({query}, '(?:from:|@)[A-Za-z0-9.:-]+', '')))")


def title_terms(title: str) -> Column:
    return F.expr(f"array_distinct(filter(transform(split(lower({title}), '\\\\s+'), x -> regexp_replace(x, '^[^a-z0-9]+|[^a-z0-9]+$', '')), x -> length(x) >= 4 AND NOT x RLIKE '^[0-9]+$'))")


def utf8_prefix(text: bytes, n: int) -> bytes:
    """At most n bytes, cut between characters."""
    return text[:n].decode("utf-8", "ignore").encode()


def utf8_middle(text: bytes, n: int) -> bytes:
    if len(text) <= n:
        return text
    lo = (len(text) - n) // 2
    while lo < len(text) and text[lo] & 0xC0 == 0x80:
        lo += 1
    return utf8_prefix(text[lo:], n)
