"""Authors in a stream: running sums and a sample of titles by author, a look every some documents, a decision that stays.

Documents count in the order of their time and uri, however they arrive: they wait in the author's state until the
watermark has passed them, so rows that come late by less than its delay change nothing, nor does a row that comes again.
A look scores the author as `operators.classifier` does for all authors at once; the first one that reaches the threshold
decides, and later documents are only counted.  The last row of an author in the result, that of greatest n, holds."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.classifier import EVERY, FLOOR, SAMPLE, STOP_WORDS, THIN, THRESHOLD, WEIGHTS, normalized_title

STATES = "did string, state string, n long, decided_at long"
_WAITING = "at long, uri string, norm string, chars long, empty boolean, digit boolean, curated boolean"
#: A time beyond all others: its tick ends the stream.
END = "2200-01-01 00:00:00"


def template_share(titles: list[str]) -> float:
    """The mean share of a title's content words that stand in at least half of the titles."""
    words = [[w for w in t.split(" ") if len(w) > 1 and w not in STOP_WORDS] for t in titles]
    common = {w for w, c in Counter(w for t in words for w in set(t)).items() if c * 2 >= len(titles)}
    covered = 0.0
    for t in words:
        hit = sum(w in common for w in t)
        covered += 0 if not hit else 1.0 if len(t) <= 3 and hit * 2 >= len(t) else hit / len(t)
    return covered / len(titles) if titles else 0.0


def decides(n: int, chars: int, empties: int, digits: int, titles: list[str]) -> bool:
    """Whether a look at an author reaches the threshold, or finds a thin and prolific one."""
    thin = 1 - chars / n / THIN
    parts = {
        "template": template_share([t for t in titles if t]),
        "structural": max(empties / n, digits / n),
        "thinness": min(1.0, max(0.0, thin)),
        "volume": min(1.0, max(0.0, (math.log10(max(n, 1)) - 2) / 2)),
    }
    return round(sum(w * parts[k] for k, w in WEIGHTS.items()), 6) >= THRESHOLD or thin > 0.9 and parts["volume"] > 0.3


class Authors(StatefulProcessor):
    def __init__(self, floor: int, every: int):
        self.floor, self.every = floor, every

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, chars long, empties long, digits long, state string, decided long, timer long")
        self.titles = handle.getListState("titles", "norm string")
        self.waiting = handle.getListState("waiting", _WAITING)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(r.ms), r.uri, r.norm, int(r.chars), bool(r.empty), bool(r.digit), bool(r.curated)) for f in rows for r in f.itertuples(index=False)]
        self.waiting.appendList(new)
        self._wake(min(r[0] for r in new))
        return iter(())

    def _wake(self, at: int) -> None:
        """A timer for the earliest document that waits."""
        n, chars, empties, digits, state, decided, timer = self.sums.get() or (0, 0, 0, 0, "observing", None, None)
        if timer is None or at < timer:
            self.handle.registerTimer(at)
            self.sums.update((n, chars, empties, digits, state, decided, at))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        n, chars, empties, digits, state, decided, _ = self.sums.get()
        waiting = {r[1]: tuple(r) for r in self.waiting.get()}  # by uri
        due = sorted(r for r in waiting.values() if r[0] <= now)
        late = [r for r in waiting.values() if r[0] > now]
        titles = [t for (t,) in self.titles.get()]
        had = len(titles)
        for _, _, norm, length, empty, digit, curated in due:
            n, chars, empties, digits = n + 1, chars + length, empties + empty, digits + digit
            if len(titles) < SAMPLE:
                titles.append(norm)
            if state == "observing" and n >= self.floor and n % self.every == 0 and decides(n, chars, empties, digits, titles):
                state, decided = "vetoed" if curated else "pending", n
        if len(titles) > had:
            self.titles.appendList([(t,) for t in titles[had:]])
        self.waiting.clear()
        self.sums.update((n, chars, empties, digits, state, decided, None))
        if late:
            self.waiting.put(late)
            self._wake(min(r[0] for r in late))
        if due:
            yield pd.DataFrame([(key[0], state, n, decided)], columns=["did", "state", "n", "decided_at"], dtype=object)


def observed(docs: DataFrame, curated: DataFrame) -> DataFrame:
    """What the stream reads of documents: (did, at, uri, norm, chars, empty, digit, curated)."""
    t = docs.select("did", F.to_timestamp("indexed_at").alias("at"), "uri", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("chars"))
    t = t.select("did", "at", "uri", normalized_title("title").alias("norm"), "chars", F.expr("trim(title) = ''").alias("empty"), F.expr("title RLIKE '[0-9]'").alias("digit"))
    return t.join(curated.select("did", F.lit(True).alias("curated")).distinct(), "did", "left").withColumn("curated", F.coalesce("curated", F.lit(False)))


def author_stream(stream: DataFrame, delay: str, floor: int = FLOOR, every: int = EVERY) -> DataFrame:
    """(did, state, n, decided_at) whenever documents of an author have been counted; a null did only moves the time."""
    rows = stream.withWatermark("at", delay).withColumn("ms", F.unix_millis("at")).where("did IS NOT NULL OR at IS NULL")
    return rows.groupBy("did").transformWithStateInPandas(Authors(floor, every), STATES, "append", "EventTime")


def run(spark: SparkSession, inbox: str, schema: str, checkpoint: str, out: str, delay: str, floor: int = FLOOR, every: int = EVERY) -> None:
    """Takes what lies in the inbox and stops; a later run goes on with the authors' states."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        states = author_stream(spark.readStream.schema(schema).parquet(inbox), delay, floor, every)
        states.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)


def latest_states(rows: DataFrame) -> DataFrame:
    """The last row of each author."""
    return rows.groupBy("did").agg(F.max_by(F.struct("state", "n", "decided_at"), "n").alias("s")).select("did", "s.*")
