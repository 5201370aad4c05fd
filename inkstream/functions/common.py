"""Named sub-expressions shared by the queries, as portable SQL text.

Times are ISO strings that may be empty or junk; `as_of` is a bound parameter, never the clock."""

from __future__ import annotations

AS_OF = "2024-01-31"
LIVE = "(is_bridgyfed IS NULL OR is_bridgyfed = 0) AND (url_dead IS NULL OR url_dead = 0)"
#: Window slug -> whole calendar days; None is unbounded.  An unknown slug means all time.
WINDOWS: dict[str, int | None] = {"day": 1, "week": 7, "month": 30, "year": 365, "all": None}


def when(alias: str = "r") -> str:
    """Event time of an edge."""
    return f"COALESCE(NULLIF({alias}.created_at, ''), {alias}.indexed_at)"


def within(window: str, alias: str = "r", as_of: str = AS_OF) -> str:
    days = WINDOWS.get(window)
    return "TRUE" if days is None else f"@DAY({when(alias)}) >= @MINUS_DAYS({as_of}, {days})"


def age(created: str = "created_at", as_of: str = AS_OF) -> str:
    """Months since creation; 120 where there is no usable date."""
    return f"COALESCE((@EPOCH(TIMESTAMP '{as_of} 00:00:00') - @EPOCH(@TS(NULLIF({created}, '')))) / 86400.0 / 30.0, 120.0)"


def ranked(select: str, order: str, limit: int | None) -> str:
    """The first rows in a total order, with their position: top-N first, so only N rows are numbered."""
    cut = f"({select} ORDER BY {order} LIMIT {limit})" if limit else f"({select})"
    return f"SELECT t.*, CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS pos FROM {cut} t"


def rkey(uri: str) -> str:
    """Everything after the second slash of an at-uri's path."""
    rest = f"substr({uri}, 6)"
    tail = f"substr({rest}, instr({rest}, '/') + 1)"
    return f"substr({tail}, instr({tail}, '/') + 1)"


def did(uri: str) -> str:
    return f"substr({uri}, 6, instr(substr({uri}, 6), '/') - 1)"


# A host that serves no documents, and the pages that show documents without a site.
SKIPPED_HOST = "blento.app"
LEAFLET_PAGE, WHITEWIND_PAGE, RECORD_PAGE = "https://leaflet.pub/p/", "https://whtwnd.com/", "https://pdsls.dev/at/"


def doc_url(alias: str = "d", kind: str = "''") -> str:
    """The canonical URL of a result.

    A publication is its host.  A document is its path on its host; else, on one platform, its key there; else the
    page of its platform; else the page that shows any record.  Some hosts serve no documents."""
    d = alias
    base = f"({d}.base_path <> '' AND substr({d}.base_path, 1, {len(SKIPPED_HOST)}) <> '{SKIPPED_HOST}')"
    known = f"({d}.did <> '' AND {d}.rkey <> '')"
    return (
        f"CASE WHEN {kind} = 'publication' AND {d}.base_path <> '' THEN 'https://' || {d}.base_path"
        f" WHEN {base} AND COALESCE({d}.path, '') <> '' THEN 'https://' || {d}.base_path || CASE WHEN substr({d}.path, 1, 1) = '/' THEN '' ELSE '/' END || {d}.path"
        f" WHEN {d}.platform = 'leaflet' AND {base} AND {d}.rkey <> '' THEN 'https://' || {d}.base_path || '/' || {d}.rkey"
        f" WHEN {d}.platform = 'leaflet' AND {known} THEN '{LEAFLET_PAGE}' || {d}.did || '/' || {d}.rkey"
        f" WHEN {d}.platform = 'whitewind' AND {known} THEN '{WHITEWIND_PAGE}' || {d}.did || '/' || {d}.rkey"
        f" WHEN {known} THEN '{RECORD_PAGE}' || {d}.did || '/site.standard.document/' || {d}.rkey ELSE '' END"
    )


def result_type(alias: str = "d") -> str:
    return f"CASE WHEN {alias}.has_publication = 1 THEN 'article' ELSE 'looseleaf' END"


def rows_with_urls() -> str:
    """Documents and publications as results, with type and URL; some hosts are changed so that every rule is met."""
    docs = "SELECT uri, did, rkey, platform, path, CASE WHEN doc_id % 13 = 0 THEN 'blento.app/x' ELSE base_path END AS base_path, has_publication FROM p_documents"
    pubs = "SELECT uri, did, rkey, '' AS platform, '' AS path, base_path, 1 AS has_publication FROM p_publications"
    return f"SELECT d.uri, {doc_url('d')} AS url, {result_type('d')} AS type FROM ({docs}) d UNION ALL SELECT p.uri, {doc_url('p', repr('publication'))}, 'publication' FROM ({pubs}) p"
