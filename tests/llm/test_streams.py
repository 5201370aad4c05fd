"""Packing, mixing and embeddings."""

from math import comb

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkstream.llm.embedding_dedup import EmbeddingDedup
from inkstream.llm.mixing import Mixing, Permutation, SplittingTree, hypergeometric, targets
from inkstream.llm.packing import Packing, WordTokenizer

from .conftest import texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAbßÉ́.,'’s0 \n\t\x01\x1c <|endoftext|>", max_size=40), max_size=4))
def test_tokenizer_by_words_equals_whole_texts(parts):
    if not hasattr(test_tokenizer_by_words_equals_whole_texts, "t"):
        test_tokenizer_by_words_equals_whole_texts.t = (WordTokenizer(PATH, 2), Tokenizer.from_file(PATH))
    mine, whole = test_tokenizer_by_words_equals_whole_texts.t
    for t, ids in zip(parts, mine.ids([p.encode() for p in parts]), strict=True):
        assert ids.tolist() == [*whole.encode(t, add_special_tokens=False).ids, 2]


def test_packing_is_a_round_trip(docs):
    size = 256
    rows = Packing(PATH, size=size, open_windows=4).pack(docs).collect()
    whole, by_doc, by_seq = Tokenizer.from_file(PATH), {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts()):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]).tolist() == ids
        assert all(r.doc_tokens == len(ids) for r in parts)
    total = []
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        total.append(at)
    assert max(total) <= size and sum(x < size for x in total) <= 1


def test_packing_of_nothing(empty):
    assert Packing(PATH).pack(empty).collect() == []


def test_targets_reshare_the_excess():
    t = targets([100, 100, 100, 1000])
    assert sum(t) == pytest.approx(1950) and all(x <= 2 * n + 1e-9 for x, n in zip(t, [100, 100, 100, 1000]))
    assert targets([]) == [] and targets([0, 0]) == [0, 0]


def test_permutation_and_tree():
    for n in (1, 2, 3, 100, 1025):
        p = Permutation(n, 7)
        y = p.of(np.arange(n))
        assert sorted(y.tolist()) == list(range(n)) and p.inverse(y).tolist() == list(range(n))
    quotas = [40, 0, 7, 300]
    got = [np.bincount(SplittingTree(quotas, 5, 3).shard(i, np.arange(q)), minlength=5) for i, q in enumerate(quotas)]
    sizes = np.sum(got, axis=0)
    assert [int(g.sum()) for g in got] == quotas and sizes.max() - sizes.min() <= 2


def plain_targets(sizes, weights, share, most):
    """Shares by a level: each source gets min(most * size, level * weight), and the level makes the sum right."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    want = min(share * sum(sizes), most * sum(sizes))
    lo, hi = 0.0, most * max(sizes, default=0) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * n, mid * k) for n, k in zip(sizes, w)) < want else (lo, mid)
    return [min(most * n, hi * k) for n, k in zip(sizes, w)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=9))
def test_targets_equal_a_plain_level(sizes):
    assert targets(sizes) == pytest.approx(plain_targets(sizes, (5, 2, 1), 1.5, 2.0), rel=1e-6, abs=1e-3)


def test_draws_of_any_size_are_exact():
    import inkstream.llm.mixing as m

    rng = np.random.default_rng(4)
    good, bad, take = 6 * 10**11, 4 * 10**11, 3 * 10**11
    x = np.array([hypergeometric(rng, good, bad, take) for _ in range(200)], float)
    sd = (take * 0.6 * 0.4 * 0.7) ** 0.5
    assert abs((x - take * 0.6).mean()) < 5 * sd / 200**0.5 and 0.8 < x.std() / sd < 1.2
    assert hypergeometric(rng, 10**10, 0, 7) == 7 and hypergeometric(rng, 3, 10**10, 10**10 + 3) == 3
    exact = [comb(30, k) * comb(50, 20 - k) / comb(80, 20) for k in range(21)]
    library, m._LIBRARY = m._LIBRARY, 0
    try:
        got = np.bincount([hypergeometric(rng, 30, 50, 20) for _ in range(4000)], minlength=21) / 4000
    finally:
        m._LIBRARY = library
    assert np.abs(got - exact).max() < 0.04
    quotas = [3 * 10**11, 10**10, 7]
    tree = SplittingTree(quotas, 4, 1)
    assert np.sum([tree.quota(s) for s in range(4)], axis=0).tolist() == quotas


def test_mixing_meets_targets_and_repeats(docs):
    rows = Mixing(block=16).taken(docs).collect()
    assert len(rows) == len(texts())
    sizes, taken, goal = {}, {}, {}
    for r in rows:
        assert r.taken <= 2 * r["size"] and r["size"] == len((texts()[r.doc_id] or "").encode().split())
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        goal[r.source] = r.target
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [goal[s] for s in order] == pytest.approx(plain_targets([sizes[s] for s in order], (5, 2, 1), 1.5, 2.0), rel=1e-6)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    assert sorted(map(str, rows)) == sorted(map(str, Mixing(block=16).taken(docs.repartition(2)).collect()))


def test_shards_hold_the_quotas_of_the_tree(docs):
    """Against a plain version: draws of no shard meet those of another, and each shard has what the tree splits off."""
    mix = Mixing(block=16, shards=3)
    draws = mix.dealt(docs).collect()
    spans = {}
    for d in draws:
        spans.setdefault((d.doc_id, d.copy), []).append((d.start, d.length))
    for parts in spans.values():
        ends = [(a, a + n) for a, n in sorted(parts)]
        assert all(e <= s for (_, e), (s, _) in zip(ends, ends[1:]))
    words = {}
    for d in draws:
        words[d.doc_id] = words.get(d.doc_id, 0) + d.length
    assert words == {r.doc_id: r.taken for r in mix.taken(docs).collect() if r.taken}
    _, quotas, shards = mix._placed(docs)
    tree = SplittingTree(quotas, shards, mix.seed)
    blocks = {}
    for d in draws:  # a block that spans documents is one draw, of one rank
        blocks.setdefault((d.shard, d.source), set()).add(d.rank)
    sources = sorted({r.source for r in mix.taken(docs).collect()}, key=lambda s: (s is None, s or ""))
    for shard in range(shards):
        assert [len(blocks.get((shard, s), ())) for s in sources] == tree.quota(shard).tolist()


def test_shards_are_shuffled_and_hold_the_words(docs):
    mix = Mixing(block=16, shards=3)
    rows = mix.shards_of(docs).collect()
    assert len(rows) == mix.dealt(docs).count() and {r.shard for r in rows} == {0, 1, 2}
    for s in range(3):
        mine = [r for r in rows if r.shard == s]
        assert [r["rank"] for r in mine] == sorted(r["rank"] for r in mine)
        ids = [r.doc_id for r in mine]
        assert len(mine) < 10 or ids != sorted(ids)
    n = {r.doc_id: r.taken for r in mix.taken(docs).collect() if r.taken}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
    assert got == n


def test_mixed_texts_hold_the_words_taken(docs):
    mix = Mixing(block=16)
    twice = docs.unionByName(docs.where("doc_id % 3 = 1"))  # repeated rows have draws of their own
    for df in (docs, twice):
        taken = {}
        for r in mix.taken(df).collect():
            taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
        got = {}
        for r in mix.mixed(df).collect():
            got[r.doc_id] = got.get(r.doc_id, 0) + len((r.text or "").encode().split())
        assert {k: v for k, v in taken.items() if v} == {k: v for k, v in got.items() if v}


def test_mixed_rows_leave_by_shard_and_rank(docs):
    mix = Mixing(block=16, shards=3)
    place = {}
    for d in sorted(mix.dealt(docs).collect(), key=lambda d: d.start):
        place.setdefault((d.doc_id, d.copy), (d.shard, d.rank))
    want = {}
    for (doc, _), (shard, rank) in place.items():
        want.setdefault(shard, []).append((rank, doc))
    parts = [[r.doc_id for r in x] for x in mix.mixed(docs).rdd.glom().collect()]
    assert [x for x in parts if x] == [[doc for _, doc in sorted(x)] for _, x in sorted(want.items())]


def test_mixing_of_nothing(empty):
    assert Mixing().taken(empty).collect() == [] and Mixing().mixed(empty).collect() == []


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(4, 8))
    rows = [(i, (base[i % 4] + r.normal(size=8) * 0.12).astype(np.float32).tolist(), [0, 1, None][i % 3]) for i in range(150)]
    rows += [(200 + i, [1.0] * 8, 1) for i in range(30)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] * 8, 1), (303, [float("inf")] + [0.0] * 7, 1), (304, [], 1), (305, [1.0] * 4, 1), (306, [3.0] * 4, 1), (307, [1.0, None] * 4, 1)]
    df = spark.createDataFrame([(*x, 5, "k") for x in rows], "vec_id long, embedding array<float>, label int, cell int, key string")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in EmbeddingDedup(cell=20, block=16).dedup(df).collect()}
    ok = lambda e: e and all(v is not None and np.isfinite(v) for v in e) and any(e)
    up, links = {x[0]: x[0] for x in rows}, {x[0]: 0 for x in rows}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[2] is not None and a[2] == b[2] and ok(a[1]) and ok(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = root(a[0]), root(b[0])
                    up[max(p, q)] = min(p, q)
    assert got == {i: (links[i], root(i), root(i) == i) for i in links}
    assert EmbeddingDedup().dedup(df.limit(0)).collect() == []
