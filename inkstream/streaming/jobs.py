"""Structured Streaming jobs over the event stream, and the batch twins that tests compare them with.

Every sink is idempotent: a micro-batch may be replayed after a failure, and the latest sequence number of a
key wins, so at-least-once delivery gives exactly-once tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "seq long, time timestamp, did string, op string, collection string, rkey string, cid string, record string"
#: The collections that are ingested, by kind.
COLLECTIONS = {
    "document": ("pub.leaflet.document", "site.standard.document", "com.whtwnd.blog.entry"),
    "publication": ("pub.leaflet.publication", "site.standard.publication"),
    "recommend": ("pub.leaflet.interactions.recommend", "site.standard.graph.recommend"),
    "subscription": ("pub.leaflet.graph.subscription", "site.standard.graph.subscription"),
    "sidecar": ("blog.pckt.publication",),
}


def events(spark: SparkSession, path: str) -> DataFrame:
    """The stream of commit events; the checkpoint of the query is its cursor."""
    return spark.readStream.schema(EVENT).json(path)


def routed(df: DataFrame) -> DataFrame:
    """Adds kind; other collections are dropped."""
    kind = "CASE " + " ".join(f"WHEN collection IN ({', '.join(map(repr, c))}) THEN '{k}'" for k, c in COLLECTIONS.items()) + " END"
    return df.withColumn("kind", F.expr(kind)).where("kind IS NOT NULL")


def gated(df: DataFrame, banned: DataFrame, bridged: DataFrame) -> DataFrame:
    """Banned authors leave; bridged ones leave for upserts only; unknown ones pass."""
    df = df.join(banned.select("did"), "did", "left_anti")
    marked = df.join(bridged.select("did", F.lit(True).alias("_b")).distinct(), "did", "left")
    return marked.where("op = 'delete' OR _b IS NULL").drop("_b")


def latest(df: DataFrame) -> DataFrame:
    """The event of greatest seq per record."""
    key = ("did", "collection", "rkey")
    best = df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), "seq").alias("e"))
    return best.select(*key, "e.*")


def merged(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Upserts and tombstones of a batch over a table of the latest events; replaying a batch changes nothing."""
    return latest(table.unionByName(latest(batch)))


def alive(table: DataFrame) -> DataFrame:
    return table.where("op <> 'delete'")


def ingest(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Routed micro-batches, each deduplicated to one event per record, go to `write`."""
    q = routed(stream).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: write(latest(df), n))
    return (q.trigger(availableNow=True) if once else q.trigger(processingTime="2 seconds")).start()


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drops events that come again over the seam of replay and live tail."""
    return stream.withWatermark("time", delay).dropDuplicatesWithinWatermark(["seq"])


def hourly(df: DataFrame, time: str = "time", key: str = "endpoint", value: str = "latency_us") -> DataFrame:
    """Count, sum and maximum by hour and key; a stream needs its watermark to forget closed hours."""
    if df.isStreaming:
        df = df.withWatermark(time, "1 hour")
    g = df.groupBy(F.window(time, "1 hour").alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("sum_us"), F.max(value).alias("max_us"))
    return g.select(F.col("w.start").alias("hour"), key, "n", "sum_us", "max_us")


def activity(df: DataFrame, now: str, time: str = "time", slots: int = 60) -> DataFrame:
    """The last 60 slots of 100 ms up to `now`, empty ones included."""
    end = f"TIMESTAMP '{now}'"
    each = df.groupBy(F.window(time, "100 milliseconds").start.alias("slot")).agg(F.count("*").alias("n"))
    all_ = df.sparkSession.sql(f"SELECT explode(sequence(date_trunc('SECOND', {end}) - INTERVAL 5 SECONDS 900 MILLISECONDS, date_trunc('SECOND', {end}), INTERVAL 100 MILLISECONDS)) AS slot")
    return all_.join(each, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("slot")).limit(slots)


def label_changes(labels: DataFrame, cursor: int) -> DataFrame:
    """Labels after a cursor; a cursor beyond the log is an error of the caller."""
    return labels.where(F.col("seq") > cursor)


def label_backfill(labels: DataFrame, cursor: int) -> DataFrame:
    """(seq, ..., error): the labels after a cursor, or the one error of a cursor beyond the log."""
    last = labels.agg(F.max("seq").alias("_last")).where(f"coalesce(_last, 0) < {cursor}")
    error = last.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in labels.schema), F.lit("FutureCursor").alias("error"))
    return label_changes(labels, cursor).withColumn("error", F.lit(None).cast("string")).unionByName(error)


def resume_point(cursor: str = "v") -> str:
    """SQL: a stored cursor is a time in microseconds from 1e15 on, a sequence number below."""
    return f"CASE WHEN {cursor} >= 1000000000000000 THEN struct('time' AS kind, {cursor} AS at) ELSE struct('seq' AS kind, {cursor} AS at) END"


def author_states(df: DataFrame) -> DataFrame:
    """Running author sums: documents, characters, empty and digit titles.  Works on batches and streams alike."""
    return df.groupBy("did").agg(F.count("*").alias("doc_count"), F.sum("length").alias("len_sum"), F.count_if(F.col("title") == "").alias("empty_titles"), F.count_if(F.col("title").rlike("[0-9]")).alias("digit_titles"))


def review_state(state: str = "state", votes: str = "votes", attempts: str = "attempts", curated: str = "curated") -> str:
    """SQL: the next state of a pending author.  Curation vetoes; two of three votes decide; five attempts end it."""
    yes, no = f"size(filter({votes}, x -> x))", f"size(filter({votes}, x -> NOT x))"
    return f"CASE WHEN {state} <> 'pending' THEN {state} WHEN {curated} THEN 'vetoed' WHEN {yes} >= 2 THEN 'labeled' WHEN {no} >= 2 THEN 'rejected' WHEN {attempts} >= 5 THEN 'rejected' ELSE 'pending' END"


def last_events(df: DataFrame, n: int, key: str = "endpoint", time: str = "time") -> DataFrame:
    """The last n rows of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time)))).where(F.col("_r") <= n).drop("_r")
