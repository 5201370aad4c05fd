"""SQL of the queries on sequenced changes and personal data, as DuckDB runs it over the base tables."""

from __future__ import annotations

from .pii import IBAN_LENGTHS, KINDS, NEAR

#: One event of a client at a time: the start of a batch (again while it jumps), or a row; held is sorted by n.
SEQUENCED = """
WITH RECURSIVE bits AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, j: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM range(256) x(i)),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY client_id ORDER BY seq NULLS FIRST) AS n FROM (SELECT DISTINCT * FROM client_changes)),
hashed AS (SELECT ranked.*, xor(4294967295, list_reduce(list_concat([4294967295], [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(change_id AS VARCHAR), '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM ranked, bits WHERE valid_at IS NOT NULL AND change_id IS NOT NULL),
dated AS (SELECT *, date_diff('day', DATE '1970-01-01', CAST(valid_at AS DATE)) + 2 * (h % 4) AS day FROM hashed WHERE h % 11 <> 0),
fed AS (SELECT *, CAST(least(8, greatest(1, 1 + floor((day - 19723) * 8 / 160))) AS BIGINT) AS batch FROM dated),
starts AS (SELECT b AS batch, CASE WHEN b = 9 THEN 99999999 ELSE (SELECT max(day) FROM fed WHERE batch < b) END AS horizon FROM range(1, 10) x(b)),
happens AS (SELECT client_id, batch, horizon, NULL::BIGINT AS day, NULL::BIGINT AS change_id, NULL::STRUCT(n BIGINT, day BIGINT, change_id BIGINT, op VARCHAR, city VARCHAR, balance DOUBLE) AS r FROM (SELECT DISTINCT client_id FROM fed), starts
 UNION ALL SELECT client_id, batch, NULL, day, change_id, {'n': n, 'day': day, 'change_id': change_id, 'op': op, 'city': city, 'balance': balance} FROM fed),
ev AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY batch, r IS NOT NULL, day, change_id) AS k FROM happens),
state AS (
 SELECT client_id, 0::BIGINT AS k, 0::BIGINT AS batch, 1::BIGINT AS next, []::STRUCT(n BIGINT, day BIGINT, change_id BIGINT, op VARCHAR, city VARCHAR, balance DOUBLE)[] AS held, []::STRUCT(n BIGINT, day BIGINT, change_id BIGINT, op VARCHAR, city VARCHAR, balance DOUBLE)[] AS done, 0::BIGINT AS missed, false AS again, NULL::BIGINT AS refused FROM (SELECT DISTINCT client_id FROM fed)
 UNION ALL
 SELECT client_id, k, batch, CASE WHEN taken > 0 THEN least_n + taken ELSE next END, all_[taken + 1:], all_[1:taken], CASE WHEN jumps THEN least_n - next ELSE 0 END, jumps, refused FROM (
  SELECT *, CASE WHEN r IS NULL AND NOT jumps THEN 0 ELSE len([i FOR i IN range(1, len(all_) + 1) IF all_[i].n = least_n + i - 1]) END AS taken FROM (
   SELECT *, CASE WHEN jumps THEN all_[1].n ELSE next END AS least_n FROM (
    SELECT s.client_id, e.k, e.batch, s.next, e.r,
     coalesce(e.r IS NULL AND len(s.held) > 0 AND list_min([x.day FOR x IN s.held]) + 5 <= e.horizon, false) AS jumps,
     CASE WHEN e.r IS NOT NULL AND (e.r.n < s.next OR list_contains([x.n FOR x IN s.held], e.r.n)) THEN e.r.change_id END AS refused,
     CASE WHEN e.r IS NULL OR e.r.n < s.next OR list_contains([x.n FOR x IN s.held], e.r.n) THEN s.held ELSE list_sort(list_append(s.held, e.r)) END AS all_
    FROM state s JOIN ev e ON e.client_id IS NOT DISTINCT FROM s.client_id AND e.k = s.k + CASE WHEN s.again THEN 0 ELSE 1 END)))),
applied AS (SELECT client_id, batch, done[i] AS r, CASE WHEN i = 1 THEN missed ELSE 0 END AS missed FROM (SELECT *, unnest(range(1, len(done) + 1)) AS i FROM state)),
ordered AS (SELECT client_id, batch, missed, r.*, count(*) FILTER (WHERE r.op IN ('I', 'D')) OVER (PARTITION BY client_id ORDER BY r.n) AS era, max(r.n) OVER (PARTITION BY client_id) AS top FROM applied),
shown AS (SELECT *, last_value(CASE WHEN op IN ('I', 'U') THEN city END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN op IN ('I', 'U') THEN balance END IGNORE NULLS) OVER w AS b FROM ordered WINDOW w AS (PARTITION BY client_id, era ORDER BY n))
SELECT change_id, client_id, 'applied' AS status, CAST(batch AS INT) AS batch, missed, c AS city, CAST(floor(100 * b + 0.5) AS BIGINT) AS cents, n = top AND op IS DISTINCT FROM 'D' AS current FROM shown
UNION ALL SELECT refused, client_id, 'rejected', CAST(batch AS INT), 0, NULL, NULL, false FROM state WHERE refused IS NOT NULL
"""


def pii() -> str:
    """Plain patterns, places by sums over all earlier pieces, validators written for DuckDB."""
    sizes = ", ".join(f"'{k}': {v}" for k, v in IBAN_LENGTHS.items())
    digits = "regexp_replace(x, '[^0-9]', '', 'g')"
    value = "regexp_extract(x, '[A-Za-z0-9_/+-]+$')"
    odd = lambda j: f"CAST(substr(reverse({digits}), {j}, 1) AS BIGINT)"
    luhn = f"list_sum([CASE WHEN j % 2 = 1 THEN {odd('j')} ELSE 2 * {odd('j')} // 10 + 2 * {odd('j')} % 10 END FOR j IN range(1, length({digits}) + 1)]) % 10 = 0"
    c = "replace(x, ' ', '')"
    number = f"substr({c}, 5, size - 4) || substr({c}, 1, 4)"
    mod = f"list_reduce(list_concat([0], [CASE WHEN y > '9' THEN ascii(y) - 55 ELSE CAST(y AS INT) END FOR y IN string_split({number}, '')]), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"
    ends = f"list_min([j FOR j IN range(15, length(x) + 1) IF length(replace(x[1:j], ' ', '')) = size])"
    valid = {
        "email": "true",
        "ip": "len([y FOR y IN string_split(x, '.') IF coalesce(TRY_CAST(y AS HUGEINT), 999) > 255]) = 0",
        "card": f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"NOT regexp_matches(before, '[A-Za-z0-9]$') AND {ends} IS NOT NULL AND NOT regexp_matches(substr(x, {ends} + 1) || after, '^[A-Za-z0-9]') AND {mod}",
        "ssn": "NOT regexp_matches(before, '[0-9A-Za-z-]$') AND NOT regexp_matches(after, '^[0-9A-Za-z-]') AND x[1:3] NOT IN ('000', '666') AND x[1:1] <> '9' AND x[5:6] <> '00' AND x[8:] <> '0000'",
        "local": "NOT regexp_matches(before, '[0-9A-Za-z]$|[+][0-9][ ().0-9-]*$') AND NOT regexp_matches(after, '^[0-9A-Za-z]|^[ .-][0-9]')",
        "secret": f"regexp_matches({value}, '[0-9]') AND regexp_matches({value}, '[A-Za-z]')",
    }
    cut = {"iban": ("0", ends), "secret": (f"length(x) - length({value})", f"length({value})")}
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for rank, k in enumerate(KINDS):
        skip, length = cut.get(k.name, ("0", "length(x)"))
        near = f"CASE WHEN regexp_matches(lower(right(before, {NEAR})), {q(k.words)}) OR regexp_matches(lower(left(after, {NEAR})), {q(k.words)}) THEN 0.3 ELSE 0 END"
        parts.append(
            f"""SELECT doc_id, {rank} AS rank, '{k.name}' AS kind, {str(k.base).lower()} AS base, s + {skip} AS s, s + {skip} + {length} AS e, least(1.0, {k.score} + {near})::DOUBLE AS score FROM (
 SELECT doc_id, m[i] AS x, right(p[i], {NEAR}) AS before, left(p[i + 1], {NEAR}) AS after, CAST(list_sum([length(y) FOR y IN p[1:i]]) + coalesce(list_sum([length(y) FOR y IN m[1:i - 1]]), 0) AS BIGINT) AS s,
  coalesce(map_extract_value(MAP {{{sizes}}}, m[i][1:2]), 99) AS size
 FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {q(k.plain)}) AS m, string_split_regex(t, {q(k.plain)}) AS p FROM d))) WHERE {valid[k.name]}"""
        )
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k.name}') AS BIGINT) AS n_{k.name}" for k in KINDS if k.base)
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id AS own, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
spans AS (SELECT doc_id AS doc, * EXCLUDE (doc_id) FROM ({" UNION ALL ".join(parts).replace("SELECT doc_id, regexp", "SELECT doc AS doc_id, regexp")}) WHERE base OR score >= 0.5)
SELECT any_value(own) AS doc_id, {counts}, sha256(coalesce({listed} FILTER (WHERE base), '')) AS base_sha256,
 coalesce({listed}, '') AS spans, coalesce(max(score), 0.0) AS score
FROM d LEFT JOIN spans USING (doc) GROUP BY doc
"""
