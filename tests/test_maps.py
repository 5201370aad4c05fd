"""Density clusters against a plain computation, and what they move."""

import random

import pytest
from pyspark.sql import functions as F

from inkstream.operators import maps


def plain(points, radius, min_samples, min_size):
    """{(id, x, y): (cluster, core)} by all pairs."""
    near = lambda a, b: (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]) <= radius * radius
    ok = [p for p in points if None not in p]
    pairs = [(a[0], b[0]) for a in ok for b in ok if a[0] != b[0] and near(a, b)]
    count = {}
    for a, _ in pairs:
        count[a] = count.get(a, 0) + 1
    dense = {a for a, n in count.items() if n >= min_samples}
    of, changed = {a: a for a in dense}, True
    while changed:
        changed = False
        for a, b in pairs:
            if a in dense and b in dense and of[b] < of[a]:
                of[a], changed = of[b], True
    member = dict(of)
    for a, b in pairs:
        if a not in dense and b in dense:
            member[a] = min(member.get(a, of[b]), of[b])
    sizes = {}
    for c in member.values():
        sizes[c] = sizes.get(c, 0) + 1
    member = {a: c for a, c in member.items() if sizes[c] >= min_size}
    rows = [(p, member[p[0]]) for p in points if p[0] in member]
    mean = lambda c, k: sum(p[k] for p, m in rows if m == c) / sum(m == c for _, m in rows)
    centres = {c: (mean(c, 1), mean(c, 2)) for c in set(member.values())}
    out = {p: (c, True) for p, c in rows}
    for p in points:
        if p[0] not in member and centres:
            far = lambda c: round((p[1] - centres[c][0]) ** 2 + (p[2] - centres[c][1]) ** 2, 12) if None not in p[1:] else 0  # noqa: B023, E731
            out[p] = (min(centres, key=lambda c: (far(c), c)), False)
    return out


def scattered(seed):
    """Clouds of all densities, copies, borders of cells, ids in two places, and rows without an id or a place."""
    r = random.Random(seed)
    out = [(r.gauss(0, 0.3), r.gauss(0, 0.3)) for _ in range(150)] + [(2 + r.random() * 0.3, r.random() * 0.3) for _ in range(120)]
    out += [(-3.0 + 0.1 * (i % 5), 0.1 * (i // 5)) for i in range(25)] + [(5.0, 5.0)] * 9 + [(5.1, 5.0)] * 2 + [(5.2, 5.0)] * 9 + [(9.0, -9.0)]
    order = r.sample(range(len(out)), len(out))
    points = [(i, *xy) for i, xy in zip(order, out, strict=True)]
    points += [(order[0], 7.0, 7.0), (order[200], 7.05, 7.0), (order[201], 7.0, 7.05)] + [(1000 + i, 7.0, 7.05) for i in range(2)]
    return points + [(2000, None, 1.0), (None, 0.0, 0.0)]


@pytest.mark.parametrize(("seed", "compared", "samples", "size"), [(1, 16, 3, 5), (2, 0, 6, 12)])
def test_density_clusters_are_those_of_all_pairs(spark, monkeypatch, seed, compared, samples, size):
    monkeypatch.setattr(maps, "COMPARED", compared)
    points = scattered(seed)
    frame = spark.createDataFrame(points, "id long, x double, y double").repartition(3)
    got = [((r.id, r.x, r.y), (r.cluster, r.core)) for r in maps.density_clusters(frame, 0.1, samples, size).collect()]
    want = plain(points, 0.1, samples, size)
    known = lambda rows: {p: v for p, v in rows if None not in p}
    assert len({c for c, _ in want.values()}) > 2 and len(got) == len(set(points))
    assert known(got) == known(want.items()) and not any(core for p, (_, core) in got if None in p)


def test_density_clusters_move_points_and_no_pairs(spark):
    status, all_ = spark._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    moved = lambda: sum(s.shuffleWriteRecords() for s in (lambda v: [v.apply(i) for i in range(v.size())])(status.stageList(None, False, False, all_, None)))
    points = spark.range(6000).select("id", (F.rand(1) * 0.1).alias("x"), (F.rand(2) * 0.1).alias("y"))
    before = moved()
    got = maps.density_clusters(points, 0.1, 6, 12).groupBy("cluster", "core").count().collect()
    spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    assert [tuple(r) for r in got] == [(0, True, 6000)]
    assert moved() - before < 20 * 6000
