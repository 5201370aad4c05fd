"""A stored table by key: a batch writes the buckets that it touches anew and leaves the others as they are.

Rows lie in buckets by a hash of their key.  A manifest names the folder of each bucket; it is created, never overwritten,
when all files of a batch are written, so a batch that fails leaves the version before it readable, of two writers one
fails, and a batch that comes again changes nothing.  Maintained counts are two such tables: how often each pair stands,
and for each key how many pairs it has."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import store


@dataclass
class Version:
    number: int = 0
    schema: str = ""
    buckets: dict[str, str] = field(default_factory=dict)
    batches: list[str] = field(default_factory=list)


class KeyedTable:
    """The table in a folder; `keys` tell rows apart, and `buckets` is fixed by the first batch."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.n = spark, path, keys, buckets

    def version(self) -> Version:
        names = [x for x in store.names(self.spark, f"{self.path}/_versions") if x.endswith(".json")]
        return Version(**json.loads(store.read_text(self.spark, f"{self.path}/_versions/{max(names)}"))) if names else Version()

    def _schema(self, v: Version) -> StructType:
        return StructType.fromJson(json.loads(v.schema))

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, at the latest version."""
        v = self.version()
        folders = [f for b, f in v.buckets.items() if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], self._schema(v))
        return self.spark.read.schema(self._schema(v)).parquet(*(f"{self.path}/{f}" for f in folders))

    def bucket(self) -> Column:
        return F.expr(f"CAST(pmod(xxhash64({', '.join(self.keys)}), {self.n}) AS INT)")

    def apply(self, batch: str, rows: DataFrame, deleted: DataFrame | None = None) -> list[int]:
        """Puts rows (one a key) in place of those of their keys and removes those of `deleted`; the buckets written."""
        v = self.version()
        if batch in v.batches:
            return []
        gone = rows.select(*self.keys) if deleted is None else rows.select(*self.keys).unionByName(deleted.select(*self.keys)).distinct()
        touched = sorted(r.b for r in gone.select(self.bucket().alias("b")).distinct().collect())  # no more than buckets
        if touched:
            kept = rows
            if v.schema:
                same = [F.col(f"o.{k}").eqNullSafe(F.col(f"g.{k}")) for k in self.keys]
                old = self.read(touched).alias("o").join(gone.alias("g"), same, "left_anti")
                kept = old.select(*rows.columns).unionByName(rows)
            folder = f"v-{uuid.uuid4().hex}"
            spread = kept.withColumn("_bucket", self.bucket())
            spread.repartition(min(self.n, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            written = {x.partition("=")[2]: f"{folder}/{x}" for x in store.names(self.spark, f"{self.path}/{folder}") if "=" in x}
            v.buckets = {b: f for b, f in v.buckets.items() if int(b) not in touched} | written
        v.number, v.schema, v.batches = v.number + 1, v.schema or json.dumps(json.loads(rows.schema.json())), [*v.batches, batch]
        store.create_text(self.spark, f"{self.path}/_versions/{v.number:08d}.json", json.dumps(v.__dict__))
        return touched


class MaintainedCounts:
    """How many distinct `member`s each `group` has, kept by batches of added and removed rows (group, member).

    A pair may stand several times; it counts while it stands at least once.  Counts follow from what a batch changes:
    only the pairs and groups of the batch are read and written."""

    def __init__(self, spark: SparkSession, path: str, group: str, member: str, buckets: int = 64):
        self.group, self.member = group, member
        self.pairs = KeyedTable(spark, f"{path}/pairs", [group, member], buckets)
        self.counts = KeyedTable(spark, f"{path}/counts", [group], buckets)

    def _touched(self, table: KeyedTable, rows: DataFrame) -> DataFrame:
        v = table.version()
        if not v.schema:
            return table.spark.createDataFrame([], rows.schema)
        return table.read([r.b for r in rows.select(table.bucket().alias("b")).distinct().collect()])

    def apply(self, batch: str, added: DataFrame, removed: DataFrame | None = None) -> None:
        """A batch that stopped between the two tables is finished when it comes again."""
        g, m = self.group, self.member
        both = added.select(g, m, F.lit(1).alias("by"))
        if removed is not None:
            both = both.unionByName(removed.select(g, m, F.lit(-1).alias("by")))
        change = both.where(f"{g} IS NOT NULL AND {m} IS NOT NULL").groupBy(g, m).agg(F.sum("by").alias("n")).where("n <> 0")
        if batch not in self.pairs.version().batches:
            old = self._touched(self.pairs, change).select(g, m, F.col("n").alias("had"))
            now = change.join(old, [g, m], "left").select(g, m, F.greatest(F.lit(0), F.coalesce("had", F.lit(0)) + F.col("n")).cast("long").alias("n"))
            self.pairs.apply(batch, now.where("n > 0"), now.where("n = 0"))
        if batch not in self.counts.version().batches:
            # the pairs table is at this batch now: groups of the batch are counted from its rows
            groups = change.select(g).distinct()
            held = self.pairs.read().join(groups, g, "left_semi").groupBy(g).agg(F.count("*").alias("n"))
            self.counts.apply(batch, held, groups)

    def read(self) -> DataFrame:
        return self.counts.read()
