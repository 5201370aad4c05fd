"""Runs of postings and what a build of the index moves."""

import random

import pyarrow as pa

from inkstream.operators import postings
from inkstream.operators.postings import SearchIndex, inverted, spaced, tokens
from inkstream.operators.segments import begun, blocked, counted, shares


def test_runs_hold_every_posting(monkeypatch):
    monkeypatch.setattr(postings, "RUN", 40)
    r = random.Random(2)
    texts = [[r.choice("abcdeéf") for _ in range(r.choice([0, 1, 5, 90]))] for _ in range(50)]
    batches = [pa.record_batch({"doc": pa.array(range(lo, lo + 10)), "_t": pa.array(texts[lo : lo + 10], pa.list_(pa.string()))}) for lo in range(0, 50, 10)]
    out = [b.to_pylist() for b in inverted(["doc"])(iter(batches))]
    got = {(p["term"], p["doc"]): (p["tf"], p["at"]) for b in out for p in b}
    want = {(w, i): (t.count(w), [k for k, x in enumerate(t) if x == w]) for i, t in enumerate(texts) for w in t}
    assert got == want and sum(map(len, out)) == len(want)
    assert len(out) > 1 and all([p["term"].encode() for p in b] == sorted(p["term"].encode() for p in b) for b in out)


def test_a_build_moves_rows_and_no_postings(spark, tmp_path):
    docs = spark.createDataFrame([(f"at://{i}", " ".join(f"w{i * k % 97}" for k in range(80))) for i in range(300)], "uri string, content string")
    status, all_ = spark._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    moved = lambda: sum(s.shuffleWriteRecords() for s in (lambda v: [v.apply(i) for i in range(v.size())])(status.stageList(None, False, False, all_, None)))
    before = moved()
    SearchIndex.build(docs, f"{tmp_path}/index", "content", [])
    spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    assert 300 <= moved() - before < 400
    assert SearchIndex(spark, f"{tmp_path}/index").postings.count() > 10_000


def test_words_and_beginnings_are_counted_once_a_row():
    r = random.Random(8)
    words = ["a", "ab", "abc", "été", "étage", "𝒳y", "b" * 30, "b" * 24 + "c", "zz"]
    rows = [(r.sample(words, r.randint(0, 6)), r.choice([1, 1, -1])) for _ in range(200)]
    batch = pa.record_batch({"terms": pa.array([t for t, _ in rows], pa.list_(pa.string())), "by": pa.array([b for _, b in rows], pa.int32())})
    got = {(p["text"], p["begins"]): p["df"] for b in counted(iter([batch])) for p in b.to_pylist()}
    want = {}
    for terms, by in rows:
        for key in {(w, False) for w in terms} | {(w[:k], True) for w in terms for k in range(1, min(24, len(w)) + 1)}:
            want[key] = want.get(key, 0) + by
    assert got == want


def test_blocks_hold_every_posting_and_bound_it():
    r = random.Random(3)
    rows = [{"term": r.choice("abc"), "uri": f"u{i}", "dl": r.randint(1, 50), "prior": r.random() * 9, "tf": r.randint(1, 5), "at": [i, i + 1]} for i in range(500)]
    batch = pa.Table.from_pylist(rows, pa.schema({"term": pa.string(), "uri": pa.string(), "dl": pa.int32(), "prior": pa.float64(), "tf": pa.int32(), "at": pa.list_(pa.int32())})).to_batches()
    at = {x["uri"]: x for x in rows}
    out = [p for b in blocked(16, 200)(iter(batch)) for p in b.to_pylist()]
    assert sorted(p["uri"] for b in out for p in b["posts"]) == sorted(at) and len({(b["term"], b["block"]) for b in out}) == len(out)
    for b in out:
        own = [at[p["uri"]] for p in b["posts"]]
        assert b["rows"] == len(own) <= 16 and all(x["term"] == b["term"] and [p["tf"], p["dl"], p["at"]] == [x["tf"], x["dl"], x["at"]] for x, p in zip(own, b["posts"], strict=True))
        assert (b["max_tf"], b["min_dl"], b["min_prior"]) == (max(x["tf"] for x in own), min(x["dl"] for x in own), min(x["prior"] for x in own))


def test_spaced_words_are_the_tokens(spark):
    texts = ["", " ", None, "One-two  THREE", "café — Ünï\u0308 ﬁn", "\n a\tb\u00a0c\u2003d ", "日本 x\ue000y 𝒳1", "...", "I\u0307stanbul ß"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(tokens("s").alias("a"), spaced("s").alias("b")).collect()
    assert [r.a for r in rows] == [None if r.b is None else [w for w in r.b.split(" ") if w] for r in rows]
    assert all(r.b is None or r.b == " ".join(r.a) for r in rows)


def test_dictionary_in_parts_sums_to_the_whole():
    r = random.Random(5)
    rows = [[r.choice("ab") * r.randint(1, 3) + r.choice(["", "c", "cd", "x" * 30]) for _ in range(r.randint(0, 8))] for _ in range(100)]
    batch = pa.record_batch({"terms": pa.array(rows, pa.list_(pa.string())), "by": pa.array([1] * 100, pa.int32())})
    (whole,) = shares(iter([batch]))
    got = {}
    for b in begun(whole.slice(lo, 3) for lo in range(0, whole.num_rows, 3)):
        for p in b.to_pylist():
            got[p["text"], p["begins"]] = got.get((p["text"], p["begins"]), 0) + p["df"]
    want = {}
    for words in rows:
        for key in {(w, False) for w in words} | {(w[:k], True) for w in words for k in range(1, min(24, len(w)) + 1)}:
            want[key] = want.get(key, 0) + 1
    assert got == want
