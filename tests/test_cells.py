"""The vector index against a scan of all vectors."""

import numpy as np

from inkstream.operators import vectors
from inkstream.operators.cells import VectorIndex, recall

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(spark, n=3000, groups=60):
    r = np.random.default_rng(3)
    centres = r.normal(size=(groups, 16))
    x = centres[r.integers(0, groups, n)] + 0.2 * r.normal(size=(n, 16))
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)] + [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [None] * 16, 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_recall_and_files_of_cells_that_are_not_probed(spark, tmp_path):
    df = clustered(spark)
    VectorIndex.build(df, f"{tmp_path}/index", part=40)
    index = VectorIndex(spark, f"{tmp_path}/index")
    assert index.stored.count() == 3000 and max(index.meta["parts"].values()) > 1
    got = recall(index, df.where("vec_id % 100 = 0")).first()
    assert got.queries == 30 and got.asked == 600 and got.found >= 0.9 * got.asked
    own = df.where("vec_id = 7").first().embedding
    near, cells = index.near(own, 20), index.probed(own)
    assert len(cells) * 4 < len(index.centroids)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    read = {r.f for r in near.sparkSession.read.parquet(f"{tmp_path}/index/cells").where(f"cell IN ({', '.join(map(str, cells))})").selectExpr("input_file_name() AS f").distinct().collect()}
    assert read and all(any(f"/cell={c}/" in f for c in cells) for f in read)
    exact = [tuple(r) for r in vectors.nearest(df.where("vec_id < 9000"), own).orderBy("distance", "vec_id").limit(20).collect()]
    assert len(set(exact) & {tuple(r) for r in near.collect()}) >= 18
    assert [tuple(r) for r in index.near(own, 20, len(index.centroids)).orderBy("distance", "vec_id").collect()] == exact


def test_probing_all_cells_is_exact(spark, tmp_path):
    df = clustered(spark, 300, 5)
    VectorIndex.build(df, f"{tmp_path}/index", cells=4, part=30)
    index = VectorIndex(spark, f"{tmp_path}/index")
    got = index.search(df.where("vec_id % 50 = 0"), 7, 4).collect()
    x = np.array([r.embedding for r in df.where("vec_id < 9000").orderBy("vec_id").collect()], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        want = sorted((round(1 - float(x[q] @ v), 8) + 0.0, i) for i, v in enumerate(x))[:7]
        mine = [r for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.pos)]
        assert [r.vec_id for r in mine] == [i for _, i in want] and np.allclose([r.distance for r in mine], [d for d, _ in want], atol=2e-8)


def test_no_vectors(spark, tmp_path):
    df = clustered(spark, 10, 2).limit(0)
    VectorIndex.build(df, f"{tmp_path}/index")
    index = VectorIndex(spark, f"{tmp_path}/index")
    assert index.search(df).collect() == [] and recall(index, df).first().asked == 0


def test_recall_of_vectors_without_structure(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(6000, 48))
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], SCHEMA).repartition(4)
    VectorIndex.build(df, f"{tmp_path}/index", cells=200)
    index = VectorIndex(spark, f"{tmp_path}/index")
    assert index.meta["probes"] < 200
    got = recall(index, df.where("vec_id % 20 = 0")).first()
    assert got.asked == 6000 and got.found >= 0.93 * got.asked
