"""Queries of the stored vector index: rows whose id is divisible by 100 against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cells import VectorIndex, recall
from ..sources import store
from ..sources.projection import Corpus


def index(c: Corpus) -> VectorIndex:
    state = store.state(c.spark, f"{c.sf_dir}/embeddings.parquet")
    return VectorIndex.of(c.spark, c.embeddings, f"{store.shared(c.spark)}/cells-{state}")


def _asked(c: Corpus) -> DataFrame:
    return c.embeddings.where("vec_id % 100 = 0")


def _recall(c: Corpus) -> DataFrame:
    return recall(index(c), _asked(c)).select("queries", "asked", (F.col("found") >= 0.9 * F.col("asked")).alias("enough"))


def _exact(c: Corpus) -> DataFrame:
    at = index(c)
    return at.search(_asked(c), 20, len(at.centroids))


_GOOD = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0"
_EXACT = f"""WITH good AS ({_GOOD}),
d AS (SELECT q.vec_id AS query_id, v.vec_id, round(1 - list_cosine_similarity(q.e, v.e), 8) + 0.0 AS distance FROM good q JOIN good v ON q.vec_id % 100 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS pos FROM d) r WHERE pos <= 20"""

PLANS = {
    "vector_ann": (lambda c: index(c).search(_asked(c), 20), ""),
    "vector_ann_exact": (_exact, _EXACT),
    "vector_ann_recall": (_recall, f"SELECT count(*) AS queries, CAST(sum(least(20, (SELECT count(*) FROM embeddings))) AS BIGINT) AS asked, true AS enough FROM ({_GOOD}) g WHERE vec_id % 100 = 0"),
}
