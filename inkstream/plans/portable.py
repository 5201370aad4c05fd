"""Queries written once in SQL and run by Spark; the oracle is the same relational text over the base tables.

A few functions have different names in the two engines; the text names them as macros."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.projection import Corpus, with_views

#: macro -> (Spark, DuckDB); `{0}`, `{1}` are its arguments.
MACROS = {
    "EPOCH": ("(unix_micros(CAST({0} AS TIMESTAMP)) / 1e6)", "epoch({0})"),
    "TS": ("try_cast({0} AS TIMESTAMP)", "try_cast({0} AS TIMESTAMP)"),
    "DAY": ("CAST(try_cast({0} AS TIMESTAMP) AS DATE)", "CAST(try_cast({0} AS TIMESTAMP) AS DATE)"),
    "MINUS_DAYS": ("date_sub(DATE'{0}', {1})", "(DATE '{0}' - {1})"),
    "ISO": ("replace(substr(CAST({0} AS STRING), 1, 19), ' ', 'T')", "replace(substr(CAST({0} AS VARCHAR), 1, 19), ' ', 'T')"),
    "DATE_TEXT": ("CAST(CAST({0} AS DATE) AS STRING)", "CAST(CAST({0} AS DATE) AS VARCHAR)"),
    "GSUB": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "HOUR_NO": ("CAST(floor(unix_micros(CAST({0} AS TIMESTAMP)) / 3600e6) AS BIGINT)", "CAST(floor(epoch({0}) / 3600) AS BIGINT)"),
    "SHA": ("sha2({0}, 256)", "sha256({0})"),
    "TOKENS": ("regexp_extract_all(lower({0}), '[\\\\p{L}\\\\p{N}]+', 0)", "regexp_extract_all(lower({0}), '[\\p{L}\\p{N}]+')"),
    "ELEM": ("element_at({0}, {1})", "{0}[{1}]"),
    "UNNEST": ("explode({0})", "unnest({0})"),
    "SERIES": ("explode(sequence({0}, {1}))", "unnest(range({0}, {1} + 1))"),
}
_CALL = re.compile(r"@(" + "|".join(MACROS) + r")\(")


def _expanded(sql: str, engine: int) -> str:
    while m := _CALL.search(sql):
        depth, i, args, lo, quoted = 1, m.end(), [], m.end(), False
        while depth:
            c = sql[i]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c == "(") - (c == ")")
                if c == "," and depth == 1 or not depth:
                    args.append(sql[lo:i].strip())
                    lo = i + 1
            i += 1
        text = MACROS[m[1]][engine]
        for k, a in enumerate(args):
            text = text.replace(f"{{{k}}}", a)
        sql = sql[: m.start()] + text + sql[i:]
    return sql


class Portable:
    """A named query in portable SQL."""

    def __init__(self, sql: str):
        self.sql = sql.strip()

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return Corpus(spark, sf_dir).sql(_expanded(self.sql, 0))

    def oracle(self) -> str:
        return _expanded(with_views(self.sql), 1)


Query = Callable[[SparkSession, str], DataFrame]
