"""The training-data pipeline: STAGES over `documents`, each written as Parquet and read again.

1. quality_classifier: documents that the classifier rejects go.
2. jaccard_join: one document of each group of near duplicates stays, that of least doc_id.
3. substring_dedup: passages that also stand earlier are cut; text without such a passage is unchanged.
4. mixing: documents are taken as often as their source's target asks, one row per copy; a copy that takes
   some blocks of a document only holds their words joined by a space.
5. packing: token sequences of 4096; a row per piece.

Null and empty texts, empty tables, very long texts, ties and repeated rows have the results that the operators
state; the classifier mostly rejects texts without words.  Rows that share a doc_id are judged each by its own
text in 1, 4 and 5 and as one document in 2 and 3; those of a document that is a copy go together.  Columns
beyond those of documents are passed on, whatever their names, up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm.cluster import staged, tidy
from inkstream.llm.jaccard_join import JaccardJoin
from inkstream.llm.mixing import Mixing
from inkstream.llm.packing import Packing
from inkstream.llm.quality_classifier import QualityClassifier
from inkstream.llm.queries import tokenizer_path
from inkstream.llm.substring_dedup import SubstringDedup



def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return QualityClassifier(folds=5, held_out=0, threshold=0.3).accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = JaccardJoin(k=5, num=4, den=5).components(docs).where("component_id <> doc_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(SubstringDedup(size=20).cleaned(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(Mixing(weights=(5, 2, 1), share=1.5, most=2.0).mixed(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = Packing(tokenizer_path(), end=2, size=4096).pack(docs)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]
STAGES: list[Stage] = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]
#: The classifier and the mix's permutations are not expressible in SQL; tests compare with a plain version.
ORACLE_SQL: str | None = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = tidy(lambda stage=stage, docs=docs: staged(stage(spark, docs, sf_dir)))()
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
