"""Where an external model comes in: embeddings, reviews of authors and refined labels.

A model is a function of the caller's over a batch of texts; it runs on the executors in Arrow batches, so what it
captures must be small or loaded by it once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import verdict

# Bytes of a text that are embedded, titles of a vote, votes of a review.
EMBED_BYTES = 8000
TITLES, VOTES = 30, 3


def embedding_text(title: str = "title", content: str = "content") -> Column:
    """Title and content in at most EMBED_BYTES bytes; what a cut leaves of a character becomes a space."""
    cut = F.expr(f"substring(encode(concat(coalesce({title}, ''), ' ', coalesce({content}, '')), 'UTF-8'), 1, {EMBED_BYTES})")

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda b: bytes(b).decode("utf-8", "replace").replace("�", " "))

    return text(cut)


def embedded(docs: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(uri, embedding) of documents; the model is asked `batch` texts at a time."""

    @F.pandas_udf("array<double>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            texts = s.tolist()
            out = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pd.Series(out)

    return docs.select("uri", run(embedding_text()).alias("embedding"))


def vote_samples(docs: DataFrame, votes: int = VOTES, titles: int = TITLES) -> DataFrame:
    """(did, vote, titles): each vote sees another slice of an author's documents, spread over all of them."""
    w = Window.partitionBy("did").orderBy("indexed_at", "uri")
    n = docs.groupBy("did").agg(F.count("*").alias("n"))
    rows = docs.select("did", "title", (F.row_number().over(w) - 1).alias("i")).join(n, "did").withColumn("stride", F.expr(f"greatest({votes}, (n + {titles} - 1) div {titles})"))
    rows = rows.withColumn("vote", F.expr("i % stride")).where(f"vote < {votes}")
    return rows.groupBy("did", "vote").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "title"))), lambda x: x["title"]).alias("titles"))  # at most `titles` of them


def reviewed(docs: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """(did, verdict): the majority of the votes that a model casts on an author's titles; null where none has two."""
    asked = vote_samples(docs).select("did", "vote", F.array_join("titles", "\n").alias("prompt"))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(model(s.tolist()))

    cast = asked.select("did", run("prompt").alias("reply")).select("did", verdict("reply").alias("v"))
    g = cast.groupBy("did").agg(F.count_if("v").alias("yes"), F.count_if(~F.col("v")).alias("no"))
    return g.select("did", F.expr("CASE WHEN yes >= 2 THEN true WHEN no >= 2 THEN false END").alias("verdict"))


def refined_labels(labels: DataFrame, titles: DataFrame, model: Callable[[list[str]], list[str]], shown: int = 10) -> DataFrame:
    """(cluster, label): a model's name for each cluster by its label and some titles; an empty answer keeps the label."""
    w = Window.partitionBy("cluster").orderBy("title")
    some = titles.withColumn("r", F.row_number().over(w)).where(F.col("r") <= shown).groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list("title")), "\n").alias("t"))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(model(s.tolist()))

    asked = labels.join(some, "cluster", "left").withColumn("said", F.trim(run(F.concat_ws("\n", "label", "t"))))
    return asked.select("cluster", F.expr("CASE WHEN coalesce(said, '') <> '' THEN said ELSE label END").alias("label"))
