"""Connected components of a table of links, in rounds that are written to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the least node that links (u, v) reach; nodes without links are components of their own.

    Each round takes the least label among a node's neighbours and then the label of that label, so chains halve;
    a round is two aggregations and two joins, and no component meets in one task."""
    spark = nodes.sparkSession
    base = f"{store.folder(spark)}/components-{uuid.uuid4().hex}"
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    edges = kept(both, "links")
    labels = kept(nodes.select(F.col("node"), F.col("node").alias("component")).distinct(), "0")
    for n in range(1, 10_000):
        near = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("component").alias("m"))
        low = labels.join(near, labels.node == near.u, "left").select("node", "component", F.least("component", "m").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        new = kept(low.join(up, "low", "left").select("node", F.least("low", "up").alias("component"), F.col("component").alias("was")), str(n))
        labels = new.select("node", "component")
        store.delete(spark, f"{base}/{n - 1}")
        if new.where("component <> was").isEmpty():
            break
    store.delete(spark, f"{base}/links")
    return labels
