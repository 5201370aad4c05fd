"""Jaccard join and substring dedup against brute force."""

import hashlib
import random

import pytest

from inkstream.llm.jaccard_join import JaccardJoin, layout, needed, signatures
from inkstream.llm.substring_dedup import SubstringDedup

from .conftest import texts


def lower(b: bytes) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def shingles(t):
    w = lower((t or "").encode()).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows, num=4, den=5):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_equals_brute_force(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in JaccardJoin().components(docs).collect()}
    assert got == components(list(enumerate(texts())))


def test_jaccard_of_chains_of_near_copies(spark):
    """Sets near the threshold, where components are only reached through other documents."""
    r = random.Random(1)
    base, rows = [f"v{i}" for i in range(80)], []
    for i in range(120):
        base = list(base)
        for _ in range(r.choice((0, 1, 2))):
            base[r.randrange(80)] = f"n{i}{r.random()}"
        rows.append((i * 3, " ".join(base)))
    r.shuffle(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in JaccardJoin().components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)


@pytest.mark.parametrize(("few", "num", "den"), [(1, 4, 5), (3, 4, 5), (1, 1, 2)])
def test_common_shingles_lose_no_link(spark, monkeypatch, few, num, den):
    """Many sets share shingles of their prefixes; pairs across components come through pairs of shingles and blocks."""
    from inkstream.llm import jaccard_join as j

    monkeypatch.setattr(j, "FEW", few)
    monkeypatch.setattr(j, "PARTNERS", 1)
    r = random.Random(few * den)
    word = lambda: f"u{r.random()}"
    stem = [word() for _ in range(30)]
    rows = []
    for i in range(90):
        w = stem[: r.choice((20, 25, 30))] + [word() for _ in range(r.choice((0, 1, 2, 5, 9)))]
        rows.append((i * 5 % 91, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in JaccardJoin(num=num, den=den).components(df).collect()}
    assert got == components(rows, num, den)


def test_jaccard_of_nothing(empty):
    assert JaccardJoin().components(empty).collect() == []


@pytest.mark.parametrize("n", [1, 2, 5, 9, 30, 200])
def test_linked_sets_share_a_signature(n):
    """Pigeonhole: whatever elements differ, sets at the threshold have a key in common."""
    import numpy as np

    r = np.random.default_rng(n)
    for _ in range(60):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        drop = int(r.integers(0, len(a) - needed(len(a), 4, 5) + 1))
        rest = a[r.permutation(len(a))[drop:]]
        most = len(rest) * 5 // 4 - len(a)
        b = np.unique(np.concatenate([rest, r.integers(0, 1 << 63, max(0, int(r.integers(0, most + 1)))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 5 * both >= 4 * (len(a) + len(b) - both):
            keys = [signatures(x, np.zeros(len(x), np.int64), 4, 5) for x in (np.sort(a), np.sort(b))]
            assert len(np.intersect1d(*keys))


def test_layout_weights_cover_the_difference():
    for band in range(30):
        two, one, q = layout(band, 4, 5)
        assert two >= 0 and one >= 0 and q >= 0 and two + one > 0


def dedup(rows, size=20):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone[k : k + size] = [True] * size
            seen.setdefault(key, (i, k))
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def test_substring_dedup_equals_brute_force(docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in SubstringDedup().dedup(docs).collect()}
    want = dedup(list(enumerate(texts())))
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_substring_dedup_keeps_columns_and_untouched_text(docs):
    rows = SubstringDedup().dedup(docs, keep=["source", "draws"], as_it_was=True).collect()
    for r in rows:
        if not r.n_removed:
            assert r.kept == texts()[r.doc_id]
        assert r.draws == [1] and sum(s.length for s in r.removed) == r.n_removed


def test_repeated_rows_do_not_precede_each_other(spark):
    t = " ".join(f"q{i}" for i in range(40))
    got = SubstringDedup().dedup(spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 40)]


def test_phrases_of_one_anchor_are_told_apart(monkeypatch):
    """Marks of an automaton with and without crowds, and by brute force: many phrases share their middle words."""
    import numpy as np

    from inkstream.llm import substring_dedup as d

    r = random.Random(8)
    word = lambda: f"x{r.randrange(400)}".encode()
    middle = [word() for _ in range(5)]
    phrases = []
    for k in range(60):
        words = [word() for _ in range(r.randint(15, 25))]
        at = r.randint(0, len(words))
        phrases.append((k, 0, words[:at] + middle + words[at:], [at]))
    text = []
    for k in range(40):
        held = phrases[r.randrange(60)][2]
        lo = r.randint(0, max(0, len(held) - 20))
        text += held[lo : lo + r.randint(15, 30)] + [word() for _ in range(3)]
    want = np.zeros(len(text), bool)
    for _, _, held, (at,) in phrases:
        for i in range(len(text) - 4):
            if text[i : i + 5] == middle:
                lo, hi = 0, 5
                while lo < min(i, at) and text[i - lo - 1] == held[at - lo - 1]:
                    lo += 1
                while i + hi < len(text) and at + hi < len(held) and text[i + hi] == held[at + hi]:
                    hi += 1
                if lo + hi >= 20:
                    want[i - lo : i + hi] = True
    assert want.any() and not want.all()
    for many in (0, 16, 1000):
        monkeypatch.setattr(d, "_MANY", many)
        gone = np.zeros(len(text), bool)
        d._Automaton(phrases, 20).mark(10**6, text, gone)
        assert (gone == want).all(), many


def test_substring_dedup_of_nothing(empty):
    assert SubstringDedup().dedup(empty).collect() == []


def test_digest_is_of_the_kept_text(docs):
    r = SubstringDedup().dedup(docs).selectExpr("kept", "sha2(kept, 256) AS h").first()
    assert r.h == hashlib.sha256(r.kept.encode()).hexdigest()
