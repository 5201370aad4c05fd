"""License scans: ordered signature rules, keyword prefilter, suppression of contained detections.

Text is reduced to its lower-case words (runs of letters, digits and anything beyond ASCII), each with a
space before and after it, so that a regex over words cannot run into a neighbour.  A rule is a label, a
keyword that its matches always hold, a regex over words, a priority and a confidence.  Texts without any
stem of the prefilter are not scanned; of the others only the rules whose keyword occurs are tried.  Of the
detections, one that lies inside an interval of the same or a better priority is suppressed.  All of it is
one projection of built-in functions: no rows are exploded or exchanged.

Null and empty texts have no words and no detections; only A-Z are lower-cased.  Very long texts are read whole,
in time linear in their hits.  Detections of equal interval and priority are a tie that the smaller label wins.
Repeated rows and rows that share a doc_id are scanned each by itself, an empty table gives none, and other
columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str  # words and groups separated by single spaces
    priority: int = 2  # 0 is best
    confidence: float = 0.9
    base: bool = False

    def regex(self) -> str:
        """The pattern over words that have a space on either side."""
        return " " + self.pattern.replace(" ", "  ") + " "


#: Fixed values of the base: phrase -> label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_V = "(?:version |v)?"
_LATER = "(?:or(?: at your option)?(?: any)?|and) (?:later|newer)"
_ANY = "at your option any later version"


def _gnu() -> list[Rule]:
    """Names, short names, identifiers and notices of the three GNU licences by version."""
    out = []
    for short, name, key, versions in (("gpl", "general public license", "general public", ("1", "2", "3")), ("lgpl", "(?:lesser|library) general public license", "general public", ("2", "2 1", "3")), ("agpl", "affero general public license", "affero", ("1", "3"))):
        for v in versions:
            tag = f"{short}-{v.replace(' ', '.') if ' ' in v else v + '.0'}"
            num = v if " " in v else f"{v}(?: 0)?"
            out += [
                Rule(f"{tag}-or-later", key, f"(?:gnu )?{name} (?:as published by the free software foundation )?(?:either )?{_V}{num} (?:of the license )?{_LATER}(?: version)?", 0, 1.0),
                Rule(f"{tag}-or-later", key, f"(?:gnu )?{name} as published by the free software foundation either {_V}{num} of the license or {_ANY}", 0, 1.0),
                Rule(f"{tag}-only", key, f"(?:gnu )?{name} {_V}{num} only", 0, 1.0),
                Rule(tag, key, f"(?:gnu )?{name} {_V}{num}", 1, 0.95),
                Rule(tag, key, f"{_V}{num} of the (?:gnu )?{name}", 1, 0.95),
                Rule(f"{tag}-or-later", short, f"{short} {num} or later", 0, 1.0),
                Rule(f"{tag}-only", short, f"{short} {num} only", 0, 1.0),
                Rule(tag, short, f"(?:gnu )?{short} {_V}{num}", 1, 0.9),
                Rule(tag, short, f"{short}v?{v[0]}", 1, 0.85),
                Rule(f"{tag}-or-later", short, f"{short}v?{v[0]} (?:plus|or later)", 0, 0.9),
                Rule(tag, "gnu org", f"gnu org licenses {short} {num}(?: html| txt)?", 1, 0.95),
                Rule(tag, "opensource org", f"opensource org licenses {short} {num}", 1, 0.95),
            ]
        out += [Rule(short, key, f"gnu {name}", 2, 0.9), Rule(short, short, f"(?:the )?(?:gnu )?{short} license", 2, 0.8), Rule(short, short, f"licensed under (?:the )?(?:gnu )?{short}", 2, 0.85), Rule(short, key, f"terms of the (?:gnu )?{name}", 2, 0.9), Rule(short, "gnu org", f"gnu org licenses {short}(?: html| txt)?", 2, 0.9)]
    return out


def _creative_commons() -> list[Rule]:
    """Creative Commons by terms and version, as names, short names and addresses."""
    terms = (("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nd", "attribution noderivs|attribution noderivatives"), ("by-nc", "attribution noncommercial"), ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivs|attribution noncommercial noderivatives"))
    out = []
    for code, name in terms:
        words = code.replace("-", " ")
        names = f"(?:{name})"
        label = f"cc-{code}"
        out += [Rule(label, "cc ", f"cc {words}", 2, 0.85), Rule(label, "creative", f"creative commons {names}(?: license| licence)?", 2, 0.9), Rule(label, "creative", f"creativecommons org licenses {words}", 1, 0.95), Rule(label, "creative", f"creative commons cc {words}", 1, 0.9)]
        for v in ("2 0", "2 5", "3 0", "4 0"):
            full = f"{label}-{v.replace(' ', '.')}"
            out += [
                Rule(full, "cc ", f"cc {words} {v}", 1, 0.95),
                Rule(full, "creative", f"creative commons {names} {v} (?:international|unported|generic)(?: license| licence| public license)?", 0, 1.0),
                Rule(full, "creative", f"creative commons {names} {v}", 1, 0.95),
                Rule(full, "creative", f"creativecommons org licenses {words} {v}", 0, 1.0),
            ]
    return out


def _versioned() -> list[Rule]:
    """Families whose versions are written alike: name, identifier, address."""
    families = (
        ("apache", "apache", "apache (?:software )?license", ("1 0", "1 1", "2 0"), "apache"),
        ("mpl", "mozilla", "mozilla public license", ("1 0", "1 1", "2 0"), "mpl"),
        ("epl", "eclipse", "eclipse public license", ("1 0", "2 0"), "epl"),
        ("cddl", "common development", "common development and distribution license", ("1 0", "1 1"), "cddl"),
        ("eupl", "european union public", "european union public licen[cs]e", ("1 1", "1 2"), "eupl"),
        ("osl", "open software license", "open software license", ("2 1", "3 0"), "osl"),
        ("afl", "academic free", "academic free license", ("2 1", "3 0"), "afl"),
        ("artistic", "artistic", "artistic license", ("1 0", "2 0"), "artistic"),
        ("cecill", "cecill", "cecill(?: free software)? license(?: agreement)?", ("2 0", "2 1"), "cecill"),
        ("ofl", "open font", "(?:sil )?open font license", ("1 0", "1 1"), "ofl"),
        ("ms-pl", "microsoft public", "microsoft public license", ("1 0",), "ms pl"),
        ("bsl", "boost", "boost software license", ("1 0",), "bsl"),
        ("odbl", "database license", "open (?:data commons )?(?:open )?database license", ("1 0",), "odbl"),
        ("gfdl", "free documentation", "(?:gnu )?free documentation license", ("1 1", "1 2", "1 3"), "gfdl"),
        ("lppl", "latex project", "latex project public license", ("1 2", "1 3"), "lppl"),
        ("python", "python software", "python software foundation license", ("2 0",), "psf"),
    )
    out = []
    for label, key, name, versions, short in families:
        out += [Rule(label, key, name, 2, 0.9), Rule(label, key, f"licensed under (?:the )?{name}", 1, 0.95), Rule(label, key, f"subject to the terms of the {name}", 1, 0.95)]
        for v in versions:
            full = f"{label}-{v.replace(' ', '.')}"
            num = f"{v[:-2]}(?: 0)?" if v.endswith(" 0") else v
            out += [Rule(full, key, f"{name} {_V}{num}", 1, 0.95), Rule(full, key, f"licensed under (?:the )?{name} {_V}{num}", 0, 1.0), Rule(full, f"{short} {v}", f"{short} {v}", 1, 0.9)]
    return out


_SINGLE = (
    Rule("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy", 0, 1.0),
    Rule("mit", "mit", "(?:under|is) the (?:terms of the )?mit license", 1, 0.95),
    Rule("mit", "mit", "license mit", 1, 0.9),
    Rule("mit", "mit", "spdx license identifier mit", 0, 1.0),
    Rule("mit", "opensource org", "opensource org licenses mit(?: license)?(?: php)?", 1, 0.95),
    Rule("mit", "expat", "expat license", 1, 0.9),
    Rule("x11", "x11", "x11 license", 1, 0.9),
    Rule("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?", 1, 0.95),
    Rule("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?", 1, 0.95),
    Rule("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: license)?", 1, 0.95),
    Rule("0bsd", "bsd", "(?:0bsd|zero clause bsd|bsd zero clause)(?: license)?", 1, 0.95),
    Rule("bsd", "bsd", "bsd (?:style )?licen[sc]e", 2, 0.85),
    Rule("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 1, 0.95),
    Rule("isc", "isc", "isc licen[sc]e", 1, 0.95),
    Rule("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose", 1, 0.95),
    Rule("unlicense", "unlicense", "(?:the )?unlicense", 1, 0.9),
    Rule("unlicense", "public domain", "this is free and unencumbered software released into the public domain", 0, 1.0),
    Rule("wtfpl", "wtfpl", "wtfpl(?: license)?", 1, 0.95),
    Rule("wtfpl", "do what the", "do what the (?:fuck|f) you want to public license", 0, 1.0),
    Rule("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", 1, 0.95),
    Rule("libpng", "libpng", "libpng licen[sc]e", 1, 0.9),
    Rule("openssl", "openssl", "openssl licen[sc]e", 1, 0.95),
    Rule("ssleay", "ssleay", "ssleay licen[sc]e", 1, 0.9),
    Rule("postgresql", "postgresql", "postgresql licen[sc]e", 1, 0.95),
    Rule("php-3.01", "php", "php license (?:version )?3 01", 1, 0.95),
    Rule("php", "php", "php license", 2, 0.9),
    Rule("ruby", "ruby", "ruby license", 2, 0.85),
    Rule("vim", "vim", "vim license", 2, 0.85),
    Rule("curl", "curl", "curl license", 2, 0.85),
    Rule("json", "json", "json license", 2, 0.85),
    Rule("json", "the software shall be used", "the software shall be used for good not evil", 0, 1.0),
    Rule("beerware", "beer", "(?:beerware|beer ware) license", 1, 0.9),
    Rule("ncsa", "ncsa", "(?:university of illinois )?ncsa open source license", 1, 0.95),
    Rule("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", 1, 0.95),
    Rule("cc0-1.0", "creative", "creative commons zero(?: v1 0| 1 0)?(?: universal)?", 1, 0.95),
    Rule("cc0-1.0", "publicdomain zero", "creativecommons org publicdomain zero 1 0", 0, 1.0),
    Rule("cc", "creative", "creative commons(?: license| licence)?", 2, 0.7),
    Rule("pddl", "public domain dedication", "(?:open data commons )?public domain dedication and licen[sc]e", 1, 0.95),
    Rule("public-domain", "public domain", "(?:is in|into|in) the public domain", 2, 0.8),
    Rule("public-domain", "public domain", "dedicated to the public domain", 1, 0.9),
    Rule("public-domain", "no known copyright", "no known copyright restrictions", 1, 0.8),
    Rule("sspl-1.0", "server side public", "server side public license(?: version 1| v1)?", 1, 0.95),
    Rule("busl-1.1", "business source", "business source license(?: version)?(?: 1 1)?", 1, 0.95),
    Rule("elastic-2.0", "elastic license", "elastic license(?: version)?(?: 2 0)?", 1, 0.9),
    Rule("commons-clause", "commons clause", "commons clause(?: license condition)?", 1, 0.9),
    Rule("openrail", "rail", "(?:creativeml )?(?:openrail|open rail)(?: m)?(?: license)?", 1, 0.9),
    Rule("openrail", "responsible ai", "responsible ai licen[sc]e", 1, 0.9),
    Rule("all-rights-reserved", "all rights reserved", "(?:copyright c? ?)?all rights reserved", 2, 0.7),
    Rule("all-rights-reserved", "all rights reserved", "copyright (?:c )?[0-9]{4}(?: [0-9]{4})? (?:[^ ]+ ){1,6}all rights reserved", 1, 0.9),
    Rule("proprietary", "proprietary", "proprietary and confidential", 1, 0.9),
    Rule("proprietary", "unauthorized copying", "unauthorized copying of this (?:file|work|document)", 1, 0.9),
    Rule("proprietary", "may not be reproduced", "may not be reproduced (?:[^ ]+ ){0,4}without (?:prior )?(?:written )?permission", 1, 0.9),
    Rule("fair-use", "fair use", "fair use", 2, 0.4),
    Rule("license-mention", "licensed under", "licensed under (?:the )?(?:terms of )?(?:the )?(?:[^ ]+ ){0,4}licen[sc]e", 2, 0.5),
)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    base = [Rule(label, phrase.split()[0] + " " if phrase.startswith("cc") else phrase.split()[0], phrase, 2, 0.9, True) for phrase, label in BASE.items()]
    found = [*base, *_gnu(), *_creative_commons(), *_versioned(), *_SINGLE]
    unique = {(r.label, r.pattern): r for r in reversed(found)}
    return tuple(sorted(unique.values(), key=lambda r: (r.priority, not r.base, r.label, r.pattern)))


#: Every rule's matches hold one of these stems; most texts hold none and are not scanned.
STEMS = r"licen|cc[^a-z0-9]+by|cc0|gpl|apache|mit[^a-z0-9]|bsd|isc[^a-z0-9]|creative|general[^a-z0-9]+public|free[^a-z0-9]+documentation|mozilla|eclipse|cddl|mpl|epl|eupl|osl|afl|artistic|cecill|ofl|ms[^a-z0-9]+pl|bsl|odbl|gfdl|lppl|psf|permission|redistribution|public[^a-z0-9]+domain|publicdomain|known[^a-z0-9]+copyright|rights[^a-z0-9]+reserved|opensource|gnu|wtfpl|do[^a-z0-9]+what[^a-z0-9]+the|zlib|software[^a-z0-9]+shall|commons|openrail|rail|proprietary|unauthorized|reproduced|fair[^a-z0-9]+use|cc[^a-z0-9]|database"


#: Hits that one step of the suppression holds; steps are chained by their furthest ends.
_STEP = 128
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _spans(text: str, rule: str) -> str:
    """SQL: the rule's matches in the text as (from, to, priority, label, confidence, base), in words from 0, `to` not included.

    Matches are put between marks, and a mark's place among the words, less the marks before it, is the word's."""
    marked = f"filter(split(regexp_replace({text}, {rule}.regex, ' \\u0001$0\\u0002 '), ' '), x -> x <> '')"
    places = f"filter(transform({marked}, (x, i) -> named_struct('x', x, 'i', i)), s -> s.x = '\\u0001' OR s.x = '\\u0002')"
    word = f"transform({places}, (s, k) -> s.i - k)"
    ends = f"filter({word}, (w, k) -> k % 2 = 1)"
    item = f"zip_with(filter({word}, (w, k) -> k % 2 = 0), {ends}, (a, b) -> named_struct('from', a, 'to', b, 'priority', {rule}.priority, 'label', {rule}.label, 'confidence', {rule}.confidence, 'base', {rule}.base))"
    empty = "CAST(array() AS array<struct<from: int, to: int, priority: int, label: string, confidence: double, base: boolean>>)"
    return f"CASE WHEN {text} RLIKE {rule}.regex THEN {item} ELSE {empty} END"


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, hits, detections, first_word, last_word): all rule matches, and those that are not suppressed;
    places are words from 0, and first_word and last_word are the base matches' first and last start."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    by_key: dict[str, list[Rule]] = {}
    for r in rules():
        by_key.setdefault(r.keyword, []).append(r)
    group = lambda k, rs: f"named_struct('key', {q(k.strip().replace(' ', '  '))}, 'rules', array({', '.join(f'''named_struct('regex', {q(r.regex())}, 'priority', {r.priority}, 'label', {q(r.label)}, 'confidence', {r.confidence}D, 'base', {str(r.base).lower()})''' for r in rs)}))"
    table = "array(" + ", ".join(group(k, rs) for k, rs in by_key.items()) + ")"
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = df.select("doc_id", "_text", F.expr(f"CAST(regexp_count(_text, r'{_WORD}') AS BIGINT)").alias("n_words"), F.translate("_text", _UPPER, _UPPER.lower()).alias("_low"))
    df = df.select("doc_id", "n_words", F.expr(f"CASE WHEN _low RLIKE r'{STEMS}' THEN concat(' ', trim(regexp_replace(_low, r'{_BREAK}', '  ')), ' ') END").alias("_norm"))
    df = df.select("*", F.expr(f"CASE WHEN _norm IS NOT NULL THEN filter({table}, g -> contains(_norm, g.key)) END").alias("_open"))
    df = df.select("doc_id", "n_words", "_norm", F.expr(f"flatten(transform(coalesce(_open, array()), g -> flatten(transform(g.rules, r -> {_spans('_norm', 'r')}))))").alias("_hits"))
    order = "array_sort(_hits, (x, y) -> CASE WHEN x.from <> y.from THEN x.from - y.from WHEN x.to <> y.to THEN y.to - x.to WHEN x.priority <> y.priority THEN x.priority - y.priority WHEN x.label < y.label THEN -1 WHEN x.label > y.label THEN 1 ELSE 0 END)"
    df = df.select("doc_id", "n_words", F.expr(order).alias("hits"))
    # In this order whatever contains a detection precedes it, so the furthest end so far of each priority decides.
    # Within a step it is carried along; before a step it is that of the steps before.
    steps = f"CASE WHEN size(hits) = 0 THEN array() ELSE transform(sequence(0, (size(hits) - 1) div {_STEP}), s -> slice(hits, s * {_STEP} + 1, {_STEP})) END"
    df = df.select("doc_id", "n_words", "hits", F.expr(steps).alias("_steps"))
    end = lambda p: f"array_max(transform(s, h -> IF(h.priority <= {p}, h.to, 0)))"
    df = df.select("*", F.expr(f"transform(_steps, s -> named_struct('p0', {end(0)}, 'p1', {end(1)}, 'p2', {end(2)}))").alias("_ends"))
    last = "get(a, size(a) - 1)"
    reach = ", ".join(f"'p{p}', greatest(coalesce({last}.p{p}, 0), e.p{p})" for p in range(3))
    df = df.select("*", F.expr(f"aggregate(_ends, filter(_ends, e -> false), (a, e) -> array_append(a, named_struct({reach})))").alias("_before"))
    on = "named_struct('p0', greatest(a.p0, IF(h.priority = 0, h.to, 0)), 'p1', greatest(a.p1, IF(h.priority <= 1, h.to, 0)), 'p2', greatest(a.p2, h.to), 'out', IF(h.to <= CASE h.priority WHEN 0 THEN a.p0 WHEN 1 THEN a.p1 ELSE a.p2 END, a.out, array_append(a.out, h)))"
    first = ", ".join(f"'p{p}', coalesce(get(_before, i - 1).p{p}, 0)" for p in range(3))
    kept = f"flatten(transform(_steps, (s, i) -> aggregate(s, named_struct({first}, 'out', filter(s, h -> false)), (a, h) -> {on}, a -> a.out)))"
    df = df.select("doc_id", "n_words", "hits", F.expr(kept).alias("detections"), F.expr("transform(filter(hits, h -> h.base), h -> CAST(h.from AS BIGINT))").alias("_base"))
    return df.select("doc_id", "n_words", "hits", "detections", F.array_min("_base").alias("first_word"), F.array_max("_base").alias("last_word"))
