"""The keyed table and maintained counts against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from inkstream.operators.keyed import KeyedTable, MaintainedCounts
from inkstream.sources import store


def rows(spark, items):
    return spark.createDataFrame(items, "id string, v long")


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", ["id"], 32)
    want = {str(i): i for i in range(400)}
    assert t.apply("a", rows(spark, list(want.items()))) == list(range(32))
    before = t.version().buckets
    touched = t.apply("b", rows(spark, [("7", -1), ("new", 5)]), rows(spark, [("9", 0), ("none", 0)]).select("id"))
    after = t.version().buckets
    assert 1 <= len(touched) <= 4 and all((before[b] == after[b]) == (int(b) not in touched) for b in before)
    want |= {"7": -1, "new": 5}
    del want["9"]
    assert {r.id: r.v for r in t.read().collect()} == want and t.read().count() == len(want)
    assert t.apply("b", rows(spark, [("7", 99)])) == [] and {r.id: r.v for r in t.read().collect()} == want
    other = KeyedTable(spark.newSession(), f"{tmp_path}/t", ["id"], 32)
    assert {r.id: r.v for r in other.read().collect()} == want


def test_a_batch_that_fails_leaves_the_version_before_it(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", ["id"], 4)
    t.apply("a", rows(spark, [("x", 1), (None, 2)]))
    bad = rows(spark, [("x", 5)]).withColumn("v", F.expr("CAST(raise_error('lost') AS BIGINT)"))
    with pytest.raises(Exception, match="lost"):
        t.apply("b", bad)
    assert sorted(r.v for r in t.read().collect()) == [1, 2] and t.version().batches == ["a"]
    number = t.version().number + 1
    store.create_text(spark, f"{tmp_path}/t/_versions/{number:08d}.json", "{}")
    with pytest.raises(Exception, match="exist"):
        store.create_text(spark, f"{tmp_path}/t/_versions/{number:08d}.json", "{}")


def test_counts_after_random_batches(spark, tmp_path):
    r = random.Random(6)
    counts, stands = MaintainedCounts(spark, f"{tmp_path}/c", "g", "m", 8), {}
    frame = lambda pairs: spark.createDataFrame(pairs, "g string, m string")
    for k in range(5):
        new = [(f"g{r.randint(0, 9)}", f"m{r.randint(0, 5)}") for _ in range(30)]
        old = r.sample([p for p, n in stands.items() for _ in range(n)], 12) if k else []
        for _ in range(1 + (k == 2)):  # one batch comes twice
            counts.apply(f"b{k}", frame([*new, (None, "m1"), ("g1", None)]), frame(old) if old else None)
        for p in new:
            stands[p] = stands.get(p, 0) + 1
        for p in old:
            stands[p] -= 1
    want = {}
    for (g, _), n in stands.items():
        want[g] = want.get(g, 0) + (n > 0)
    assert {x.g: x.n for x in counts.read().collect()} == {g: n for g, n in want.items() if n}
