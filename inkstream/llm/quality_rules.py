"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A word is a run of characters other than 0x20 and 0x09-0x0D.  Null texts are empty: they have no words and
fail the base rules.  Very long texts are measured whole; repeated rows and rows that share a doc_id are judged
each by itself, a ratio that equals its bound passes, an empty table gives none, and other columns are not read,
whatever their names.  Repeated words are those in windows of eight words that occur twice or more in the
text; windows are compared by a 64-bit hash of their words' 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
#: Frequent function words of four languages.
STOP_WORDS = (
    "the of and in to a is that on with for was as it by be are this or from "
    "de la que el en y los las un una por con del se "
    "le les et des du est dans pour au que qui "
    "der die und den von zu das mit ist sich des auf für nicht ein eine"
).split()


@dataclass(frozen=True)
class Rule:
    """`ratio` must lie between `least` and `most` wherever `where` holds."""

    name: str
    ratio: str
    least: float | None = None
    most: float | None = None
    where: str = "true"

    def failed(self) -> str:
        bounds = [f"({self.ratio}) < {self.least}D"] * (self.least is not None) + [f"({self.ratio}) > {self.most}D"] * (self.most is not None)
        return f"({self.where}) AND ({' OR '.join(bounds)})"


RULES = (
    Rule("word_length", "word_chars / n_words", 1.5, 25.0),
    Rule("symbols_per_word", "n_symbols / n_words", most=0.3),
    Rule("exclaims_per_word", "n_exclaims / n_words", most=0.5),
    Rule("stop_words", "n_stop / n_words", 0.01, where="n_words >= 100"),
    Rule("duplicate_lines", "n_dup_lines / n_lines", most=0.5, where="n_lines >= 6"),
    Rule("bullet_lines", "n_bullet_lines / n_lines", most=0.9, where="n_lines >= 6"),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", most=0.5, where="n_lines >= 6"),
)
#: The base: fewer than 20 words, or more than 30 % of them repeated.
BASE = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def _measures(text: str) -> list[dict[str, Column | str]]:
    """Steps of named expressions; each step reads the columns of the ones before."""
    row = ", ".join(f"get(_hash, i + {k})" for k in range(WINDOW))
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]))
    return [
        {"_text": f"coalesce({text}, '')"},
        {"_words": f"regexp_extract_all(_text, r'{WORD}', 0)", "_lines": rf"filter(split(_text, '\n'), x -> x RLIKE r'{WORD}')"},
        {"n_words": "CAST(size(_words) AS BIGINT)", "_hash": "transform(_words, x -> xxhash64(x))"},
        {"_windows": f"CASE WHEN n_words >= {WINDOW} THEN transform(sequence(0, CAST(n_words AS INT) - {WINDOW}), i -> xxhash64({row})) ELSE array() END"},
        {"_sorted": "CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(transform(_windows, (h, i) -> struct(h, i))) ELSE filter(transform(_windows, (h, i) -> struct(h, i)), x -> false) END"},
        {"_repeated": "sort_array(transform(filter(_sorted, (x, k) -> x.h = get(_sorted, k - 1).h OR x.h = get(_sorted, k + 1).h), x -> x.i))"},
        {
            "word_chars": "CAST(length(array_join(_words, '')) AS BIGINT)",
            "n_symbols": "CAST(length(_text) - length(regexp_replace(_text, '[#*$%&|<>]', '')) AS BIGINT)",
            "n_exclaims": "CAST(length(_text) - length(replace(_text, '!', '')) AS BIGINT)",
            "n_lines": "CAST(size(_lines) AS BIGINT)",
            "n_dup_lines": "CAST(size(_lines) - size(array_distinct(_lines)) AS BIGINT)",
            "n_bullet_lines": "CAST(size(filter(_lines, x -> x RLIKE '^[ \\\\t]*[-*•]')) AS BIGINT)",
            "n_ellipsis_lines": "CAST(size(filter(_lines, x -> x RLIKE '(\\\\.\\\\.\\\\.|…)[ \\\\t]*$')) AS BIGINT)",
            "n_stop": f"CAST(size(filter(_words, x -> x IN ({stop}))) AS BIGINT)",
            "n_repeat_words": f"CAST(aggregate(_repeated, named_struct('n', 0, 'to', 0), (a, i) -> named_struct('n', a.n + i + {WINDOW} - greatest(i, a.to), 'to', i + {WINDOW}), a -> a.n) AS BIGINT)",
        },
    ]


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, counts, base_failed, failed_rules, kept).  failed_rules names the rules of the table that fail."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_in"))
    for step in _measures("_in"):
        df = df.select("*", *(F.expr(e).alias(c) for c, e in step.items()))
    failed = "filter(array(" + ", ".join(f"CASE WHEN n_words > 0 AND {r.failed()} THEN '{r.name}' END" for r in rules) + "), x -> x IS NOT NULL)"
    counts = [c for c in df.columns if c[0] != "_"]
    df = df.select(*counts, F.expr(BASE).alias("base_failed"), F.expr(failed).alias("failed_rules"))
    return df.select("*", F.expr("NOT base_failed AND size(failed_rules) = 0").alias("kept"))
