"""Readers of repositories of records: listings, single records, archives, inventories, backlinks and identities.

Transport is the caller's: it leaves responses as JSON lines, or archives as files, and these readers make tables
of them."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(uri, cid, record) of pages {records: [{uri, cid, value}], cursor}; value stays JSON text."""
    pages = spark.read.text(path).select(F.expr("try_parse_json(value)").alias("v"))
    items = pages.select(F.explode(F.expr("coalesce(try_variant_get(v, '$.records', 'array<variant>'), array())")).alias("r"))
    return items.select(F.expr("try_variant_get(r, '$.uri', 'string')").alias("uri"), F.expr("try_variant_get(r, '$.cid', 'string')").alias("cid"), F.expr("to_json(try_variant_get(r, '$.value', 'variant'))").alias("record"))


def last_cursor(spark: SparkSession, path: str) -> DataFrame:
    """(pages, open): how many pages there are, and how many end with a cursor, so that another follows."""
    return spark.read.text(path).agg(F.count("*").alias("pages"), F.count_if(F.expr("coalesce(try_variant_get(try_parse_json(value), '$.cursor', 'string'), '') <> ''")).alias("open"))


def fetched(responses: DataFrame) -> DataFrame:
    """responses (uri, status, body) with outcome: found, missing (400 and 404) or unavailable, and the record and cid found."""
    kind = F.expr("CASE WHEN status IN (400, 404) THEN 'missing' WHEN status BETWEEN 200 AND 299 THEN 'found' ELSE 'unavailable' END")
    v = "try_parse_json(body)"
    return responses.select("uri", kind.alias("outcome"), F.expr(f"CASE WHEN status BETWEEN 200 AND 299 THEN try_variant_get({v}, '$.cid', 'string') END").alias("cid"), F.expr(f"CASE WHEN status BETWEEN 200 AND 299 THEN to_json(try_variant_get({v}, '$.value', 'variant')) END").alias("record"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Distinct dids of pages {repos: [{did}]}."""
    pages = spark.read.text(path).select(F.expr("try_parse_json(value)").alias("v"))
    items = pages.select(F.explode(F.expr("coalesce(try_variant_get(v, '$.repos', 'array<variant>'), array())")).alias("r"))
    return items.select(F.expr("try_variant_get(r, '$.did', 'string')").alias("did")).where("did IS NOT NULL").distinct()


def backlinks(spark: SparkSession, path: str) -> DataFrame:
    """(target, uri) of pages {target, linking_records: [{did, collection, rkey}]}."""
    pages = spark.read.text(path).select(F.expr("try_parse_json(value)").alias("v"))
    items = pages.select(F.expr("try_variant_get(v, '$.target', 'string')").alias("target"), F.explode(F.expr("coalesce(try_variant_get(v, '$.linking_records', 'array<variant>'), array())")).alias("r"))
    part = lambda p: f"try_variant_get(r, '$.{p}', 'string')"
    return items.select("target", F.expr(f"concat('at://', {part('did')}, '/', {part('collection')}, '/', {part('rkey')})").alias("uri")).where("uri IS NOT NULL").distinct()


def host_of_identity(body: str) -> Column:
    """The host of an identity document: the first service of its kind with an https address, without a slash at the end."""
    services = f"coalesce(from_json({body}, 'struct<service: array<struct<id: string, type: string, serviceEndpoint: string>>>').service, array())"
    mine = f"get(filter({services}, s -> (s.type = 'AtprotoPersonalDataServer' OR endswith(s.id, '#atproto_pds')) AND startswith(s.serviceEndpoint, 'https://')), 0)"
    return F.expr(f"regexp_replace({mine}.serviceEndpoint, '/+$', '')")


def did_of_dns_answer(body: str) -> Column:
    """The did of a name's text record in a resolver's JSON answer."""
    data = f"from_json({body}, 'struct<Answer: array<struct<data: string>>>').Answer"
    return F.expr(f"get(filter(transform(coalesce({data}, array()), a -> regexp_extract(replace(a.data, '\"', ''), '^did=(did:[a-z]+:[A-Za-z0-9._:%-]+)$', 1)), d -> d <> ''), 0)")


def resolved(dids: DataFrame, identities: DataFrame) -> DataFrame:
    """dids with the host of their identity; each did is asked once, however often it occurs."""
    memo = identities.groupBy("did").agg(F.max("body").alias("body")).select("did", host_of_identity("body").alias("host"))
    return dids.join(memo, "did", "left")


# ---- archives: blocks named by digests, and a tree of keys over them


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if b[at - 1] < 128:
            return n, at


class Link(bytes):
    """The name of a block."""


def name_of(block: bytes) -> Link:
    return Link(b"\x01\x71\x12\x20" + hashlib.sha256(block).digest())


def encode(x) -> bytes:
    """A value as the compact binary form of JSON with links; map keys by length, then by bytes."""

    def head(major: int, n: int) -> bytes:
        for limit, code, form in ((24, None, None), (1 << 8, 24, ">B"), (1 << 16, 25, ">H"), (1 << 32, 26, ">I")):
            if n < limit:
                return bytes([major << 5 | n]) if code is None else bytes([major << 5 | code]) + struct.pack(form, n)
        return bytes([major << 5 | 27]) + struct.pack(">Q", n)

    if x is None or isinstance(x, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[x]
    if isinstance(x, Link):
        return b"\xd8\x2a" + head(2, len(x) + 1) + b"\x00" + x
    if isinstance(x, int):
        return head(0, x) if x >= 0 else head(1, -1 - x)
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, bytes):
        return head(2, len(x)) + x
    if isinstance(x, str):
        return head(3, len(x.encode())) + x.encode()
    if isinstance(x, list):
        return head(4, len(x)) + b"".join(map(encode, x))
    items = sorted(((k.encode(), v) for k, v in x.items()), key=lambda i: (len(i[0]), i[0]))
    return head(5, len(items)) + b"".join(encode(k.decode()) + encode(v) for k, v in items)


def decode(b: bytes, at: int = 0):
    """(value, where it ends)."""
    major, info = b[at] >> 5, b[at] & 31
    at += 1
    if major == 7 and info in (20, 21, 22):
        return {20: False, 21: True, 22: None}[info], at
    if major == 7 and info == 27:
        return struct.unpack_from(">d", b, at)[0], at + 8
    size = {24: 1, 25: 2, 26: 4, 27: 8}.get(info, 0)
    if info > 27 or major == 7:
        raise ValueError("not in the compact form")
    n = int.from_bytes(b[at : at + size]) if size else info
    at += size
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        if at + n > len(b):
            raise ValueError("cut short")
        return (b[at : at + n].decode() if major == 3 else bytes(b[at : at + n])), at + n
    if major == 4:
        out = []
        for _ in range(n):
            v, at = decode(b, at)
            out.append(v)
        return out, at
    if major == 5:
        held = {}
        for _ in range(n):
            k, at = decode(b, at)
            held[k], at = decode(b, at)
        return held, at
    v, at = decode(b, at)
    return (Link(v[1:]) if n == 42 else v), at


def archive(did: str, records: dict[str, dict], width: int = 8) -> bytes:
    """An archive of records by key (collection/rkey): leaves of `width` entries under one root."""
    blocks: dict[bytes, bytes] = {}

    def put(x) -> Link:
        b = encode(x)
        blocks[name_of(b)] = b
        return name_of(b)

    def node(entries: list[tuple[bytes, Link, Link | None]], left: Link | None = None) -> Link:
        out, last = [], b""
        for k, v, tree in entries:
            same = next((i for i, (x, y) in enumerate(zip(k, last, strict=False)) if x != y), min(len(k), len(last)))
            out.append({"p": same, "k": k[same:], "v": v, "t": tree})
            last = k
        return put({"l": left, "e": out})

    keys = sorted((k.encode(), put(v)) for k, v in records.items())
    groups = [keys[i : i + width] for i in range(0, len(keys), width)]
    first = node([(k, v, None) for k, v in groups[0]]) if groups else None
    tops = [(g[0][0], g[0][1], node([(k, v, None) for k, v in g[1:]]) if len(g) > 1 else None) for g in groups[1:]]
    root = put({"did": did, "version": 3, "data": node(tops, first), "rev": "3", "prev": None, "sig": b"\x00"})
    head = encode({"version": 1, "roots": [root]})
    return _varint(len(head)) + head + b"".join(_varint(len(n) + len(b)) + n + b for n, b in blocks.items())


def walk(car: bytes, prefix: str = "") -> Iterator[tuple[str, str, dict]]:
    """(did, key, record) of an archive's records whose key begins so, in the order of keys."""
    size, at = _read_varint(car, 0)
    header, _ = decode(car, at)
    at += size
    blocks: dict[bytes, tuple[int, int]] = {}
    while at < len(car):
        size, start = _read_varint(car, at)
        blocks[bytes(car[start : start + 36])] = (start + 36, start + size)
        at = start + size
    get = lambda link: decode(car[slice(*blocks[bytes(link)])])[0]
    commit = get(header["roots"][0])
    wanted = prefix.encode()

    def down(link) -> Iterator[tuple[bytes, Link]]:
        if link is None:
            return
        here = get(link)
        yield from down(here["l"])
        key = b""
        for e in here["e"]:
            key = key[: e["p"]] + e["k"]
            yield key, e["v"]
            yield from down(e["t"])

    for key, link in down(commit["data"]):
        if key.startswith(wanted):
            yield commit["did"], key.decode(), get(link)


def _plain(x):
    if isinstance(x, Link):
        return {"$link": x.hex()}
    if isinstance(x, bytes):
        return {"$bytes": x.hex()}
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def walked(archives: DataFrame, prefix: str = "", content: str = "content") -> DataFrame:
    """(did, collection, rkey, record, problem) of a column of archives; an archive that can't be read gives its problem."""
    import json

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("did", "collection", "rkey", "record", "problem")
        for b in it:
            for car in b[content].to_pylist():
                try:
                    rows = [(d, *k.split("/", 1), json.dumps(_plain(r), sort_keys=True), None) for d, k, r in walk(car, prefix)]
                except (ValueError, KeyError, IndexError, TypeError, AttributeError, struct.error) as e:
                    rows = [(None, None, None, None, type(e).__name__)]
                cols = zip(*rows, strict=True) if rows else [[] for _ in names]
                yield pa.record_batch({c: pa.array(v, pa.string()) for c, v in zip(names, cols, strict=True)})

    return archives.select(content).mapInArrow(run, "did string, collection string, rkey string, record string, problem string")


def archived(records: DataFrame) -> DataFrame:
    """(did, content): the archive of each did's records (did, key, record as JSON text)."""
    import json

    def run(t: pa.Table) -> pa.Table:
        did = t["did"][0].as_py()
        held = {k: json.loads(r) for k, r in zip(t["key"].to_pylist(), t["record"].to_pylist(), strict=True)}
        return pa.table({"did": [did], "content": pa.array([archive(did, held)], pa.binary())})

    return records.groupBy("did").applyInArrow(run, "did string, content binary")
