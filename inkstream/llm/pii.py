"""Personal data in texts: regular expressions propose spans, checksums confirm them, words nearby adjust their score.

A pattern marks its matches in one pass over the text; the text is cut at the marks, so the pieces between and the
matches alternate and places are sums of their lengths, kept by blocks of 64 pieces.  Base kinds (email, ip, card, phone)
are always reported when their validator holds.  The further kinds (iban, ssn, local phone number, secret) are reported
when their score, raised by words nearby, reaches `least`.  Only functions of Spark are used, in one projection without
an exchange, so rows are independent: nothing is grouped and no row waits for another.

Patterns start where the plain ones would: a run of characters that fails at its first place fails at all of them, so the
later ones are passed over, and repetitions never give back, which keeps the time linear in the text.  A null text is
empty and has no spans; each of several equal rows, or rows of one doc_id, keeps its own spans; columns of docs are kept
and `spans` replaces one of that name.  U+0001 in a text is read as U+0002, which no pattern holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lengths of international bank account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
#: Characters before and after a match, up to the next match of its kind, in which words count as nearby.
NEAR = 40


@dataclass(frozen=True)
class Kind:
    """A pattern (as Spark runs it, and plainly), a condition on the match `x` with what stands `before` and `after` it,
    its score, and words that raise the score.  `inner` cuts the span out of the match: (characters to skip, length)."""

    name: str
    pattern: str
    plain: str
    valid: str
    score: float
    words: str
    base: bool = False
    needs: str = ""
    inner: tuple[str, str] = ("0", "length(x)")


_LOCAL = r"[A-Za-z0-9._%+-]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SECRET = r"[A-Za-z0-9_/+-]"
_NUMBER = r"[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?|[A-Z0-9]{11,30})"
_DIGITS = "length(regexp_replace(x, '[^0-9]', ''))"
_LUHN = """aggregate(sequence(1, length(translate(x, ' -', ''))), 0, (a, i) -> a +
 CASE WHEN i % 2 = 1 THEN CAST(substr(translate(x, ' -', ''), -i, 1) AS INT)
 ELSE 2 * CAST(substr(translate(x, ' -', ''), -i, 1) AS INT) - CASE WHEN substr(translate(x, ' -', ''), -i, 1) > '4' THEN 9 ELSE 0 END END) % 10 = 0"""


def _iban(expr: str) -> str:
    """expr with `size` as the length of the country's numbers."""
    sizes = ", ".join(f"'{k}', {v}" for k, v in IBAN_LENGTHS.items())
    return expr.replace("{size}", f"coalesce(element_at(map({sizes}), left(x, 2)), 99)")


#: Length of the shortest beginning of x that holds all characters of the number.
_IBAN_LONG = "coalesce(array_min(filter(sequence(15, 42), j -> length(replace(left(x, j), ' ', '')) = {size} AND j <= length(x))), 0)"
_MOD97 = """aggregate(filter(split(concat(substr(replace(x, ' ', ''), 5, {size} - 4), left(replace(x, ' ', ''), 4)), ''), c -> c <> ''), 0,
 (a, c) -> (CASE WHEN c > '9' THEN a * 100 + ascii(c) - 55 ELSE a * 10 + CAST(c AS INT) END) % 97) = 1"""

KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", rf"{_LOCAL}+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 0.9, "mail|contact|write", True, "@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", rf"x RLIKE '^{_PART}(?:[.]{_PART}){{3}}$'", 0.6, "address|adresse|server|host|login", True, "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9])+", f"length(translate(x, ' -', '')) BETWEEN 16 AND 19 AND {_LUHN}", 0.9, "card|karte|carte|tarjeta|visa|pay", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", f"{_DIGITS} BETWEEN 8 AND 15", 0.7, "phone|tel|call|mobil|fax|whatsapp", True, "+"),
    Kind(
        "iban",
        _NUMBER,
        _NUMBER,
        _iban(f"NOT (before RLIKE '[A-Za-z0-9]$') AND {_IBAN_LONG} > 0 AND NOT (concat(substr(x, {_IBAN_LONG} + 1), after) RLIKE '^[A-Za-z0-9]') AND {_MOD97}"),
        0.7,
        "iban|account|konto|compte|cuenta|bank",
        inner=("0", _iban(_IBAN_LONG)),
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "NOT (before RLIKE '[0-9A-Za-z-]$') AND NOT (after RLIKE '^[0-9A-Za-z-]') AND NOT (x RLIKE '^(?:000|666|9)|-00-|0000$')",
        0.4,
        "ssn|social|security|tax",
    ),
    Kind(
        "local",
        r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
        r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
        "NOT (before RLIKE '[0-9A-Za-z]$|[+][0-9][ ().0-9-]*$') AND NOT (after RLIKE '^[0-9A-Za-z]|^[ .-][0-9]')",
        0.4,
        "phone|tel[.:e ]|call|mobil|fax|whatsapp|handy",
    ),
    Kind(
        "secret",
        rf"(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\x22']? ?[=:] ?[\x22']?{_SECRET}{{16,}}+",
        rf"(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\x22']? ?[=:] ?[\x22']?{_SECRET}{{16,}}",
        f"regexp_extract(x, '{_SECRET}+$', 0) RLIKE '[0-9]' AND regexp_extract(x, '{_SECRET}+$', 0) RLIKE '[A-Za-z]'",
        0.6,
        "login|user|config|private",
        inner=(f"length(x) - length(regexp_extract(x, '{_SECRET}+$', 0))", f"length(regexp_extract(x, '{_SECRET}+$', 0))"),
    ),
)


def _let(expr: str, name: str, body: str) -> str:
    """body with name for the value of expr, which is found once."""
    return f"element_at(transform(array({expr}), {name} -> {body}), 1)"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: Kind, text: str, near: int) -> str:
    """SQL for the array of a kind's confirmed spans, with their scores."""
    parts = rf"split(regexp_replace({text}, {_literal(kind.pattern)}, '\u0001$0\u0001'), '\u0001', -1)"
    length = "aggregate({}, 0, (a, x) -> a + length(x))"
    blocks = "transform(sequence(0, (size(p) - 1) DIV 64), c -> slice(p, c * 64 + 1, 64))"  # a slice copies its whole array
    sums = f"transform(blocks, b -> {length.format('b')})"
    before = "transform(sequence(0, size(sums) - 1), c -> aggregate(slice(sums, 1, c), 0, (a, x) -> a + x))"
    start = f"starts[i DIV 64] + {length.format('slice(blocks[i DIV 64], 1, i % 64)')}"
    words = _literal(kind.words)
    score = f"least(1.0D, {kind.score}D + CASE WHEN lower(right(before, {near})) RLIKE {words} OR lower(left(after, {near})) RLIKE {words} THEN 0.3D ELSE 0.0D END)"
    valid = kind.valid.replace("\\", "\\\\")
    names = lambda body: _let("p[i]", "x", _let(f"right(p[i - 1], {near})", "before", _let(f"left(p[i + 1], {near})", "after", body)))
    at = f"({start}) + ({kind.inner[0]})"
    span = f"named_struct('kind', '{kind.name}', 'start', {at}, 'end', {at} + ({kind.inner[1]}), 'score', {score}, 'base', {str(kind.base).lower()})"
    found = f"transform(filter(sequence(1, size(p) - 2, 2), i -> {names(valid)}), i -> {names(span)})"
    none = "CAST(array() AS ARRAY<STRUCT<kind: STRING, start: INT, end: INT, score: DOUBLE, base: BOOLEAN>>)"
    whole = _let(parts, "p", f"CASE WHEN size(p) > 1 THEN {_let(blocks, 'blocks', _let(sums, 'sums', _let(before, 'starts', found)))} ELSE {none} END")
    return f"CASE WHEN contains({text}, '{kind.needs}') THEN {whole} ELSE {none} END"


def pii_spans(docs: DataFrame, text: str = "text", least: float = 0.5, near: int = NEAR) -> DataFrame:
    """docs with `spans`: (kind, start, end, score, base), by kind in the order of KINDS, then by start; code points, end
    exclusive.  Spans of base kinds stay whatever their score."""
    whole = f"translate(coalesce(`{text}`, ''), '\\u0001', '\\u0002')"
    kinds = [_spans(k, "t", near) if k.base else f"filter({_spans(k, 't', near)}, s -> s.score >= {least}D)" for k in KINDS]
    return docs.withColumn("spans", F.expr(_let(whole, "t", f"concat({', '.join(kinds)})")))
