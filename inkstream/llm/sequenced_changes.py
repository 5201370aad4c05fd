"""Sequenced changes: numbered changes of many keys, applied in the order of their numbers although they arrive late,
repeated or never.

A stateful streaming query, started anew for every batch on one checkpoint, keeps for each key the next number, the
fields as they stand, and a buffer of held changes like that of a log-structured merge tree.  Keys are kept by pages of
some dozens, as state is read and written by page.  What a batch leaves over of a page is appended as one run to a
ListState of its own, each key's part sorted by number, with a cursor for each part that says how many of its changes are
drained.  A heap merges the parts of a key; it drains while the smallest number is the next one, or, at the start of a
batch, while the longest held change is overdue: then the next number jumps to the smallest held one.  When all slots but
one hold runs, the runs are merged into that one and the others are cleared.

What is overdue depends on the largest day of all keys in earlier batches.  It is the watermark: each batch carries one
clock that holds this day and the batch's number, timers on a page's oldest held day wake pages without new rows, and a
row without a key moves the clock of an empty batch.

Results of odd input: a null number, a number below the next one, one that is held, or one that is repeated in the batch
(but for the first by day and id) is rejected; so are copies of a whole row.  A null key is a key like any other.  A null
day counts as the earliest and is overdue as soon as any batch has ended.  Operations other than I, U and D change no
field and use their number up.  NaN in a field comes out as null.  An empty table gives no rows.  Columns beyond those named are not carried, so their names
cannot clash.

A page's changes within one batch are taken in chunks of CHUNK rows, and longer runs are read as streams of blocks, so
what a task holds does not follow the rows of a key; a key is one task's work in each batch, as its changes form one
sequence.  State is checkpointed to the shared folder, the result is a file sink's output: lost executors repeat their
tasks of the batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, BooleanType, FractionalType, IntegerType, IntegralType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .cluster import scratch, staged, tidy

#: Milliseconds of the clock for a day: fewer than a day has, so that all clocks are times that pandas can hold.
DAY = 1_000_000
#: Days added to those of a clock, so that every clock is above the watermark 0 of a query that has seen nothing.
SHIFT = 1_000_000
#: The day of the clock after the last batch.
LAST = 4 * SHIFT
#: The day that stands for a null one.
EARLIEST = -(2**31)
#: Rows of a page that are taken at once, and length up to which a run is read as a whole.
CHUNK = 50_000
#: Rows of an element of a run.
BLOCK = 1_000
#: Keys of a page, about.
PAGE = 64
#: Places of a row (number, day, id, operation, fields..., oldest day from here to the end of its part).
N, AT, ID, OP, FIELDS = 0, 1, 2, 3, 4


def clock(day: int | None, batch: int) -> int:
    """Milliseconds of the clock of a batch: the largest day so far and the batch's number; a batch counts two, so
    that a timer fits between the clocks of two batches of one day."""
    return (SHIFT + (-SHIFT + 1 if day is None else max(day, 1 - SHIFT))) * DAY + 2 * batch


def told(watermark: int) -> tuple[int, int]:
    """(largest day in earlier batches, number of the batch that begins) of a watermark."""
    return (watermark // DAY - SHIFT, watermark % DAY // 2 + 1) if watermark > 0 else (EARLIEST, 1)


def _carried(f: StructField) -> list[Column]:
    """A column, and for numbers another that tells nulls: pandas would turn whole numbers beside a null into doubles."""
    if not isinstance(f.dataType, (IntegralType, FractionalType)):
        return [F.col(f.name)]
    return [F.coalesce(f.name, F.lit(0).cast(f.dataType)).alias(f.name), F.col(f.name).isNull().alias(f"{f.name}_null")]


def _values(frame: pd.DataFrame, name: str) -> list:
    """The values of such a column, null as None."""
    if f"{name}_null" in frame:
        return [None if null else v for v, null in zip(frame[name].tolist(), frame[f"{name}_null"].tolist(), strict=True)]
    return [v if v == v else None for v in frame[name].tolist()]


@dataclass
class Part:
    """A key's rows in a run: the run's slot (-1: new rows), their place, how many are drained, the oldest day of the others."""

    slot: int
    offset: int
    length: int
    taken: int
    oldest: int


@dataclass
class Key:
    key: Any
    next: int
    fields: list
    parts: list[Part] = field(default_factory=list)


@dataclass
class Page:
    keys: dict[Any, Key] = field(default_factory=dict)
    timer: int | None = None
    batch: int = 0
    used: set[int] = field(default_factory=set)

    def live(self) -> list[tuple[int, Part]]:
        """(place of the key, part) of all parts that are not drained."""
        return [(i, p) for i, k in enumerate(self.keys.values()) for p in k.parts if p.taken < p.length]


class Merge:
    """The rows of some parts by number; rows that are popped count as taken."""

    def __init__(self, parts: list[tuple[Part, Iterator[tuple]]]) -> None:
        self.parts, self.heap = parts, []
        for i in range(len(parts)):
            self._push(i)

    def _push(self, i: int) -> None:
        part, rest = self.parts[i]
        row = next(rest, None)
        if row is not None:
            part.oldest = row[-1]
            heapq.heappush(self.heap, (row[N], i, row))

    def pop(self) -> tuple:
        _, i, row = heapq.heappop(self.heap)
        self.parts[i][0].taken += 1
        self._push(i)
        return row

    def oldest(self) -> int:
        """The oldest day of all rows that are left."""
        return min(row[-1] for _, _, row in self.heap)


class Applier(StatefulProcessor):
    """Applies the changes of a page; a row comes as n, day, op, first, key, id and the fields, as `_carried` has them."""

    def __init__(self, key: StructField, identity: StructField, fields: list[StructField], patience: int, slots: int) -> None:
        self.names = [f.name for f in fields]
        self.columns = ["key", "id", "n", "op", "applied", "batch", "missed", *self.names]
        self.patience, self.slots = patience, slots
        many = lambda name, kind: StructField(name, ArrayType(kind))
        values = [many(f.name, f.dataType) for f in fields]
        row = [many("n", LongType()), many("day", IntegerType()), many("id", identity.dataType), many("op", StringType())]
        self.block = StructType([*row, *values, many("oldest", IntegerType())])
        parts = [many(c, LongType()) for c in ("part", "slot", "offset", "length", "taken", "oldest")]
        counts = [StructField("timer", LongType()), StructField("batch", LongType())]
        self.page = StructType([*counts, many("key", key.dataType), many("next", LongType()), *parts, *values])

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.state = handle.getValueState("page", self.page)
        self.lists = [handle.getListState(f"run{i}", self.block) for i in range(self.slots)]
        self.cache: dict[int, list[tuple]] = {}

    def close(self) -> None:
        pass

    def _load(self) -> Page:
        self.cache = {}
        got = self.state.get()
        if got is None:
            return Page()
        timer, batch, keys, next_, *rest = got
        parts, values = rest[:6], rest[6:]
        at = [Key(k, n, list(v)) for k, n, *v in zip(keys, next_, *values, strict=True)]
        for i, *p in zip(*parts, strict=True):
            at[i].parts.append(Part(*p))
        return Page({k.key: k for k in at}, timer, batch, set(parts[1]))

    def _save(self, page: Page, watermark: int) -> None:
        """Clears runs that are drained, sets the timer of the oldest held day and stores the page."""
        live = page.live()
        for slot in page.used - {p.slot for _, p in live}:
            self.lists[slot].clear()
        if live:
            due = max(clock(min(p.oldest for _, p in live) + self.patience, 0), watermark + 1)
            if page.timer is None or due < page.timer:
                self.handle.registerTimer(due)
                page.timer = due
        parts = [[i for i, _ in live], *([getattr(p, c) for _, p in live] for c in ("slot", "offset", "length", "taken", "oldest"))]
        keys = list(page.keys.values())
        values = [[k.fields[i] for k in keys] for i in range(len(self.names))]
        self.state.update((page.timer, page.batch, [k.key for k in keys], [k.next for k in keys], *parts, *values))

    def _run(self, slot: int) -> Iterator[tuple]:
        return (row for block in self.lists[slot].get() for row in zip(*block, strict=True))

    def _rest(self, page: Page, part: Part) -> Iterator[tuple]:
        """The rows of a part that are not drained."""
        lo, hi = part.offset + part.taken, part.offset + part.length
        if part.slot not in self.cache:
            if max(p.offset + p.length for _, p in page.live() if p.slot == part.slot) > CHUNK:
                return islice(self._run(part.slot), lo, hi)
            self.cache[part.slot] = list(self._run(part.slot))
        return islice(self.cache[part.slot], lo, hi)

    def _merge(self, page: Page, key: Key, more: tuple = ()) -> Merge:
        return Merge([*((p, self._rest(page, p)) for p in key.parts if p.taken < p.length), *more])

    def _apply(self, k: Key, row: tuple, batch: int) -> tuple:
        missed, k.next = row[N] - k.next, row[N] + 1
        new = row[FIELDS : FIELDS + len(self.names)]
        if row[OP] == "I":
            k.fields = list(new)
        elif row[OP] == "U":
            k.fields = [old if v is None else v for old, v in zip(k.fields, new, strict=True)]
        elif row[OP] == "D":
            k.fields = [None] * len(self.names)
        return (k.key, row[ID], row[N], row[OP], True, batch, missed, *k.fields)

    def _reject(self, key: Any, row: tuple, batch: int) -> tuple:
        return (key, row[ID], None if row[N] < 0 else row[N], row[OP], False, batch, 0, *[None] * len(self.names))

    def _start(self, page: Page, day: int, batch: int) -> Iterator[tuple]:
        """What the start of a batch drains: next jumps while the longest held change is overdue."""
        page.batch = batch
        for k in page.keys.values():
            if min((p.oldest for p in k.parts if p.taken < p.length), default=day + 1) + self.patience > day:
                continue
            m = self._merge(page, k)
            while m.heap and (m.heap[0][0] == k.next or m.oldest() + self.patience <= day):
                yield self._apply(k, m.pop(), batch)

    def _take(self, page: Page, rows: dict[Any, list[tuple]], batch: int) -> Iterator[tuple]:
        """Rejects, holds and applies new rows of some keys."""
        over = {}
        for key, some in rows.items():
            k = page.keys.setdefault(key, Key(key, 1, [None] * len(self.names)))
            new = {}
            for row in some:
                if row[-1] and row[N] >= k.next:
                    new[row[N]] = row
                else:
                    yield self._reject(key, row, batch)
            top = max(new, default=0)
            for p in k.parts:
                if p.taken == p.length or not new:
                    continue
                for row in self._rest(page, p):
                    if row[N] > top:
                        break
                    if row[N] in new:
                        yield self._reject(key, new.pop(row[N]), batch)
            run, oldest = [], 2**31 - 1
            for n in sorted(new, reverse=True):
                oldest = min(oldest, new[n][AT])
                run.append((*new[n][:-1], oldest))
            run.reverse()
            if run and run[0][N] == k.next:
                mine = Part(-1, 0, len(run), 0, 0)
                m = self._merge(page, k, ((mine, iter(run)),))
                while m.heap and m.heap[0][0] == k.next:
                    yield self._apply(k, m.pop(), batch)
                run = run[mine.taken :]
            if run:
                over[key] = run
        if over:
            self._append(page, over)

    def _blocks(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        while some := list(islice(rows, BLOCK)):
            yield tuple(list(column) for column in zip(*some, strict=True))

    def _append(self, page: Page, over: dict[Any, list[tuple]]) -> None:
        """Appends a run of the parts that are left over; into the last free slot all runs are merged."""
        used = {p.slot for _, p in page.live()}
        slot = next(i for i in range(self.slots) if i not in used)
        self.cache.pop(slot, None)
        page.used.add(slot)
        if len(used) + 1 < self.slots:
            offset = 0
            for key, run in over.items():
                page.keys[key].parts.append(Part(slot, offset, len(run), 0, run[0][-1]))
                offset += len(run)
            self.lists[slot].put(list(self._blocks(row for run in over.values() for row in run)))
            return
        self.lists[slot].clear()
        merged: list[tuple[Key, Part]] = []
        blocks = self._blocks(self._compacted(page, over, slot, merged))
        while some := list(islice(blocks, CHUNK // BLOCK)):
            self.lists[slot].appendList(some)
        for k in page.keys.values():
            k.parts = []
        for k, p in merged:
            k.parts = [p]
        self.cache = {}

    def _compacted(self, page: Page, over: dict[Any, list[tuple]], slot: int, merged: list) -> Iterator[tuple]:
        """All rows that are held, key by key in order of number; merged gets the new parts."""
        offset = 0
        for k in page.keys.values():
            run = over.get(k.key)
            m = self._merge(page, k, ((Part(-1, 0, len(run), 0, 0), iter(run)),) if run else ())
            if m.heap:
                part = Part(slot, offset, 0, 0, m.oldest())
                merged.append((k, part))
            while m.heap:
                oldest = m.oldest()
                yield (*m.pop()[:-1], oldest)
                part.length += 1
                offset += 1

    def _frames(self, rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        while some := list(islice(rows, CHUNK)):
            yield pd.DataFrame(some, columns=self.columns, dtype=object)

    def _chunks(self, frames: Iterator[pd.DataFrame]) -> Iterator[dict[Any, list[tuple]]]:
        """Rows by key, CHUNK of them at once."""
        rows, count = {}, 0
        for f in frames:
            ids = [_values(f, c) for c in ("key", "id", *self.names)]
            plain = [f[c].tolist() for c in ("n", "day", "first")]
            for n, day, first, op, key, id_, *values in zip(*plain, _values(f, "op"), *ids, strict=True):
                rows.setdefault(key, []).append((n, day, id_, op, *values, first))
            count += len(f)
            if count >= CHUNK:
                yield rows
                rows, count = {}, 0
        if rows:
            yield rows

    def _given(self, page: Page, frames: Iterator[pd.DataFrame], day: int, batch: int) -> Iterator[tuple]:
        if page.batch < batch:
            yield from self._start(page, day, batch)
        for rows in self._chunks(frames):
            yield from self._take(page, rows, batch)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        page = self._load()
        yield from self._frames(self._given(page, rows, *told(watermark)))
        self._save(page, watermark)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        page = self._load()
        if page.timer is not None and page.timer <= watermark:
            page.timer = None
        yield from self._frames(self._given(page, iter(()), *told(watermark)))
        self._save(page, watermark)


class SequencedChanges:
    """Changes with a number for each key, applied to `fields` by operations I (sets all), U (sets those that are not
    null) and D (nulls all).  A held change is waited for `patience` days of the clock."""

    #: State stores in RocksDB, whose memory is bounded, closed as soon as a task has committed.
    SETTINGS = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }

    def __init__(self, key: str, number: str, day: str, identity: str, op: str, fields: tuple[str, ...], patience: int = 5, slots: int = 5) -> None:
        if slots < 2:
            raise ValueError("at least two slots: one of them is merged into")
        self.key, self.number, self.day, self.identity, self.op, self.fields = key, number, day, identity, op, fields
        self.patience, self.slots = patience, slots

    @tidy
    def applied(self, changes: DataFrame, batch: str, batches: int) -> DataFrame:
        """The changes (`batch` from 1 to `batches`) fed batch by batch.  A row for each change: key, identity, number,
        op, applied, batch (where it was applied or rejected), missed (numbers jumped right before it), the fields after
        it, and current: whether it is the key's final applied change and no D."""
        spark = changes.sparkSession
        pages = changes.agg(F.approx_count_distinct(self.key).alias("n")).first().n // PAGE + 1
        rows = changes.select(
            F.pmod(F.xxhash64(self.key), F.lit(pages)).cast("int").alias("page"),
            F.col(self.key).alias("key"),
            F.coalesce(F.greatest(F.col(self.number).cast("long"), F.lit(-1)), F.lit(-1)).alias("n"),
            F.coalesce(F.greatest(F.col(self.day).cast("int"), F.lit(1 - SHIFT)), F.lit(EARLIEST)).alias("day"),
            F.col(self.identity).alias("id"),
            F.col(self.op).cast("string").alias("op"),
            *(F.col(f).alias(f"f{i}") for i, f in enumerate(self.fields)),
            F.col(batch).cast("int").alias("batch"),
        )
        values = [f"f{i}" for i in range(len(self.fields))]
        same = Window.partitionBy("key", "n", "batch").orderBy("day", "id", "op", *values)
        rows = rows.withColumn("first", F.row_number().over(same) == 1)
        folder = scratch(spark)
        rows.write.partitionBy("batch").parquet(f"{folder}/fed")
        fed = spark.read.schema(rows.schema).parquet(f"{folder}/fed")
        last = {r.batch: r.day for r in fed.groupBy("batch").agg(F.max("day").alias("day")).collect()}
        day = None
        before = {k: spark.conf.get(k, None) for k in self.SETTINGS}
        try:
            for k, v in self.SETTINGS.items():
                spark.conf.set(k, v)
            for b in range(1, batches + 1):
                day = max((d for d in (day, last.get(b)) if d is not None and d > EARLIEST), default=None)
                self._feed(fed.where(F.col("batch") == b), folder, clock(day, b))
            self._feed(fed.limit(0), folder, clock(LAST - SHIFT, batches), ends=True)
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        out = spark.read.schema(self._shown(rows.schema)).parquet(f"{folder}/results")
        newest = out.where("applied").groupBy("key").agg(F.max("n").alias("n")).select(F.col("key").alias("k"), F.col("n").alias("m"), F.lit(True).alias("newest"))
        out = out.join(newest, (F.col("key").eqNullSafe(F.col("k"))) & (F.col("n") == F.col("m")) & F.col("applied"), "left")
        return staged(
            out.select(
                F.col("key").alias(self.key),
                F.col("id").alias(self.identity),
                F.col("n").alias(self.number),
                F.col("op").alias(self.op),
                "applied",
                "batch",
                "missed",
                *(F.col(f"f{i}").alias(f) for i, f in enumerate(self.fields)),
                (F.coalesce("newest", F.lit(False)) & ~F.col("op").eqNullSafe("D")).alias("current"),
            )
        )

    def _shown(self, schema: StructType) -> StructType:
        """Of the rows that come out of the stream."""
        out = StructType([schema["key"], schema["id"], schema["n"], schema["op"]])
        out = out.add("applied", BooleanType()).add("batch", IntegerType()).add("missed", LongType())
        return StructType([*out.fields, *(schema[f"f{i}"] for i in range(len(self.fields)))])

    def _feed(self, rows: DataFrame, folder: str, at: int, ends: bool = False) -> None:
        """Adds a batch to the folder that the streaming query reads, and runs the query until it has taken it."""
        spark = rows.sparkSession
        columns = ["page", "key", "n", "day", "id", "op", *(f"f{i}" for i in range(len(self.fields))), "first"]
        nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns]
        ticks = spark.range(1).select(*nothing, F.lit(True).alias("tick"))
        all_ = rows.select(*columns, F.lit(False).alias("tick")).unionByName(ticks).withColumn("clock", F.timestamp_millis(F.lit(at)))
        all_.write.mode("append").parquet(f"{folder}/inbox")
        stream = spark.readStream.schema(all_.schema).parquet(f"{folder}/inbox").withWatermark("clock", "0 seconds")
        # the condition names the clock, else it would be tested before the clock is seen
        fields = [rows.schema[f"f{i}"] for i in range(len(self.fields))]
        carried = [c for f in (rows.schema["key"], rows.schema["id"], *fields) for c in _carried(f)]
        stream = stream.where("NOT (tick AND clock IS NOT NULL)").select("page", "n", "day", "op", "first", *carried, "clock")
        applier = Applier(rows.schema["key"], rows.schema["id"], fields, self.patience, self.slots)
        out = stream.groupBy("page").transformWithStateInPandas(applier, self._shown(rows.schema), "append", "EventTime")
        # the last clock is seen by a batch without data that follows it
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(ends).lower())
        sink = out.writeStream.format("parquet").option("path", f"{folder}/results").option("checkpointLocation", f"{folder}/state")
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()


@tidy
def dense_numbers(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """rows with `name`, the dense rank of `order` (null first) for each `key`.

    Rows are dealt by ranges of (key, order) and numbered in each range; a key that spans ranges gets in each the count
    of the earlier ones.  At most one key of a range began before it, so there are no more such counts than ranges."""
    dealt = staged(rows.repartitionByRange(F.col(key), F.col(order)).withColumn("_range", F.spark_partition_id()))
    ranked = dealt.withColumn("_rank", F.dense_rank().over(Window.partitionBy("_range", key).orderBy(F.col(order).asc_nulls_first())))
    counts = ranked.groupBy("_range", key).agg(F.max("_rank").alias("_top"))
    before = F.sum("_top").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    began = counts.select("_range", F.col(key).alias("_key"), before.alias("_before")).where("_before > 0")
    same = (ranked["_range"] == began["_range"]) & ranked[key].eqNullSafe(began["_key"])
    out = ranked.join(F.broadcast(began), same, "left")
    return out.select(*(ranked[c] for c in rows.columns), (F.col("_rank") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))
