"""The sequenced change applier against a plain loop over rows."""

import random
from collections import defaultdict

import pytest

from inkstream.llm.queries import op11_sequenced_changes
from inkstream.llm.sequenced_changes import Applier, SequencedChanges


def plain(rows, batches, patience=5):
    """{id: (applied, batch, missed, fields, current)} of rows (id, key, n, day, op, fields, batch), one at a time."""
    next_, held, fields, out, last = defaultdict(lambda: 1), defaultdict(dict), defaultdict(lambda: (None, None)), {}, {}

    def drain(key, batch):
        while next_[key] in held[key]:
            apply(key, held[key].pop(next_[key]), batch, 0)

    def apply(key, r, batch, missed):
        old, new = fields[key], r[5]
        fields[key] = new if r[4] == "I" else (None, None) if r[4] == "D" else tuple(o if v is None or r[4] != "U" else v for o, v in zip(old, new, strict=True))
        out[r[0]] = [True, batch, missed, fields[key]]
        last[key] = r
        next_[key] = r[2] + 1

    def jumps(key, batch, horizon):
        while held[key] and (horizon is None or min(-(10**9) if r[3] is None else r[3] for r in held[key].values()) + patience <= horizon):
            n = min(held[key])
            apply(key, held[key].pop(n), batch, n - next_[key])
            drain(key, batch)

    day = -(10**9)
    for b in range(1, batches + 1):
        mine = [r for r in rows if r[6] == b]
        for key in list(held):
            if b > 1:
                jumps(key, b, max(day, -(10**6) + 1))
        for r in sorted(mine, key=lambda r: (-(10**9) if r[3] is None else r[3], r[0])):
            if r[2] is None or r[2] < next_[r[1]] or r[2] in held[r[1]]:
                out[r[0]] = [False, b, 0, (None, None)]
            else:
                held[r[1]][r[2]] = r
                drain(r[1], b)
        day = max([day, *(r[3] for r in mine if r[3] is not None)])
    for key in list(held):
        jumps(key, batches + 1, None)
    return {i: (*v, any(r[0] == i and r[4] != "D" for r in last.values())) for i, v in out.items()}


def rows_of(seed, n=900, batches=6, late=False):
    r = random.Random(seed)
    out = []
    for i in range(n):
        batch = r.randint(1, batches)
        batch = 4 if batch == 3 else batch  # an empty batch
        key = r.choice([None, 1, 2**53 + 1, 3, 3, 3, 3, 3, 2**53 + 3, *range(5, 40)])
        day = 19_723 + r.randint(-30, 50) if late else 19_723 + batch * 6 + r.randint(0, 5)
        out.append((i, key, None if i % 97 == 0 else r.randint(1, 12 if key != 3 else 150), None if i % 89 == 0 else day, r.choice("IUUUUDX"), (r.choice([None, "x", "y"]), r.choice([None, 1.5, 2.5])), batch))
    return out


@pytest.mark.parametrize(("seed", "slots", "late"), [(1, 2, False), (2, 3, True)])
def test_against_a_plain_loop(spark, monkeypatch, seed, slots, late):
    rows = rows_of(seed, late=late)
    flat = [(*r[:5], *r[5], r[6], "k", True) for r in rows]
    df = spark.createDataFrame(flat, "id long, who long, num long, day int, what string, a string, b double, part int, key string, first boolean").repartition(3)
    got = SequencedChanges("who", "num", "day", "id", "what", ("a", "b"), slots=slots).applied(df, "part", 6).collect()
    assert {r.id: (r.applied, r.batch, r.missed, (r.a, r.b), r.current) for r in got} == plain(rows, 6)
    assert len(got) == len(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "id long, who long, num long, day int, what string, a string, part int")
    out = SequencedChanges("who", "num", "day", "id", "what", ("a",)).applied(df, "part", 2)
    assert out.columns == ["who", "id", "num", "what", "applied", "batch", "missed", "a", "current"] and out.collect() == []
