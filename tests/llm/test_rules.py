"""License scans, quality rules, chat formatting and the two classifiers."""

import hashlib
import re

import numpy as np

from inkstream.llm import queries as q
from inkstream.llm.chat_format import chat_format, turns_read_back
from inkstream.llm.license_scan import BASE, STEMS, license_scan, rules
from inkstream.llm.quality_classifier import FEATURES, AdditiveModel, QualityClassifier, features
from inkstream.llm.quality_rules import quality_rules
from inkstream.llm.toxicity import LEET, Deobfuscator, Toxicity, costs, count_trigrams, entries

from .conftest import LICENSE, texts


def test_rules_are_many_and_gated():
    assert len(rules()) >= 200
    for r in rules():
        re.compile(r.regex())


def test_base_phrases_equal_brute_force(docs):
    got = {r.doc_id: r for r in license_scan(docs).collect()}
    for i, t in enumerate(texts()):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = sorted((k, label) for p, label in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        hits = [h for h in got[i].hits if h.base]
        assert (got[i].n_words, len(hits)) == (len(w), len(at))
        assert (got[i].first_word, got[i].last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert {h.label for h in hits} == {x[1] for x in at}


def test_longer_and_better_detections_suppress(spark):
    df = spark.createDataFrame([(1, LICENSE), (2, "CC BY-SA 4.0 and mit license mit license"), (3, "the word license alone"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan(df).collect()}
    assert "gpl-3.0" in {d.label for d in got[1].detections} and "gpl" not in {d.label for d in got[1].detections}
    assert {d.label for d in got[2].detections} >= {"cc-by-sa-4.0", "mit"} and sum(h.base for h in got[2].hits) == 3
    assert not got[3].detections and not got[4].hits
    assert re.search(STEMS, LICENSE.lower())


def test_stems_are_found_across_any_break(spark):
    said = {"all-rights-reserved": "All rights\nreserved", "public-domain": "it is in the public\ndomain", "fair-use": "fair-use", "json": "the software  shall be used for good, not evil", "wtfpl": "do\nwhat the fuck you want to public license"}
    df = spark.createDataFrame(list(said.items()), "doc_id string, text string")
    for r in license_scan(df).collect():
        assert r.doc_id in {d.label for d in r.detections}, r.doc_id


def test_spellings_of_a_rule_fire(spark):
    said = {"OpenRAIL-M": "openrail", "Open RAIL": "openrail", "CreativeML Open RAIL-M license": "openrail", "beerware license": "beerware", "beer-ware license": "beerware", "Open Data Commons Database License 1.0": "odbl", "Open Database License": "odbl"}
    df = spark.createDataFrame(list(said.items()), "doc_id string, label string")
    got = {r.doc_id: {d.label for d in r.detections} for r in license_scan(df, text="doc_id").collect()}
    for text, label in said.items():
        assert any(x.startswith(label) for x in got[text]), (text, got[text])


def test_quality_counts_equal_brute_force(docs):
    for r in quality_rules(docs).collect():
        t = texts()[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        places = {}
        for i in range(len(w) - 7):
            places.setdefault(tuple(w[i : i + 8]), []).append(i)
        rep = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(rep) > 30 * len(w)) and (r.kept is False or not r.base_failed)


def test_chat_reads_back(spark):
    told = [(1, 0, "system", "be <b>&amp; [INST]"), (1, 1, "user", "hi\n"), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (2, 0, "assistant", ""), (2, 0, "assistant", None), (3, None, None, "x"), (3, 5, "to[o]l<", "y"), (None, 1, "user", "z")]
    told += [(4, i, ("user", "assistant")[i % 2], f"t{i}&#91;") for i in range(300)]
    df = spark.createDataFrame([(*x, 1.0, "k") for x in told], "conv_id long, turn long, role string, text string, chunk double, segments string").repartition(3)
    rows = {r.conv_id: r for r in chat_format(df).selectExpr("*", f"{turns_read_back('formatted')} AS back").collect()}
    for c in (1, 2, 3, 4, None):
        want = sorted((-1 if t is None else t, r or "", x or "") for i, t, r, x in told if i == c)
        assert [(b.role, b.text) for b in rows[c].back] == [x[1:] for x in want]
        assert "".join(s.text for s in rows[c].segments) == rows[c].formatted and rows[c].n_turns == len(want)
    assert [rows[c].valid for c in (1, 2, 3, 4)] == [True, False, False, True]
    assert sum(s.loss for s in rows[4].segments) == 150
    assert chat_format(df.limit(0)).collect() == []


def test_chat_query_digests(spark):
    r = q.op5_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars) == (2, len(said)) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = AdditiveModel(rounds=20).fit(x[:2000], y[:2000])
    assert (((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9) and (1, 0) in m.pairs
    assert AdditiveModel().fit(np.zeros((0, 2)), np.zeros(0)).score(np.ones((2, 2))).tolist() == [0.5, 0.5]


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = q.op7_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert got and np.mean([r.predicted == r.quality for r in got]) > 0.93


def test_classifiers_take_any_rows(docs, labels, empty):
    assert len(features(None)) == len(FEATURES)
    for op in (QualityClassifier(), Toxicity()):
        rows = op.scored(docs, labels).collect()
        assert len(rows) == len(texts()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= op.threshold) for r in rows)
        assert op.scored(empty, labels.limit(0)).collect() == []
    assert QualityClassifier().accepted(docs, labels).columns == docs.columns


def test_disguises_are_undone():
    words = "idiot stupid moron pathetic worthless disgusting clown trash loser scum the of and in this that".split()
    d = Deobfuscator(costs(count_trigrams([" ".join(words * 50).encode()])))
    got = d.restored("1d10t M0R0N st-up-id p@th3tic w0rthl3ss tr4sh cl0wn i d i o t l.o.s.e.r stuuuupid $cum!!")
    assert {"idiot", "moron", "stupid", "pathetic", "worthless", "trash", "clown", "loser", "scum"} <= got


def test_spelt_and_joined_words_are_all_restored():
    words = "idiot stupid moron pathetic worthless disgusting clown trash loser scum ass you are a the of and in this that".split()
    d = Deobfuscator(costs(count_trigrams([" ".join(words * 50).encode()])))
    for text, held in (
        ("s t u p i d i d i o t", {"stupid", "idiot"}),
        ("y o u a r e a m o r o n", {"you", "are", "moron"}),
        ("s t u p i d   i d i o t", {"stupid", "idiot"}),
        ("s-t-u-p-i-d i-d-i-o-t", {"stupid", "idiot"}),
        ("a s s", {"ass"}),
        ("st" + "u" * 40 + "pid", {"stupid"}),
        ("y0u-4re-a-5tup1d-1d10t-and-a-w0rthl3ss-cl0wn", {"stupid", "idiot", "clown"}),
        ("t h i s " * 40 + "m o r o n " + "t h i s " * 40 + "i d i o t", {"this", "moron", "idiot"}),
        ("-" * 200 + "abc", set()),
    ):
        assert held <= d.restored(text), text


def every_decoding(token, model, edge):
    """All outputs of the channel with their costs, by enumeration."""
    c, out = Deobfuscator, []

    def arcs(i):
        x = token[i]
        if x in LEET:
            return [(y, c.READ) for y in LEET[x]] + [("", c.DROP)] + ([(" ", c.READ + edge)] if edge is not None and not x.isalnum() else [])
        if x.isalpha():
            if i and token[i - 1] == x:
                more = i > 1 and token[i - 2] == x
                return [(x, c.MORE if more else c.TWICE), ("", c.LESS if more else c.ONCE)]
            return [(x, 0.0)]
        return [("", c.NOISE)] + ([(" ", c.NOISE + edge)] if edge is not None else [])

    def go(i, a, b, text, cost):
        if i == len(token):
            out.append((cost + model[a][b][0], text))
            return
        for y, price in arcs(i):
            if not y or (y == " " and not b):
                go(i + 1, a, b, text, cost + price)
            else:
                k = 0 if y == " " else ord(y) - 96
                go(i + 1, b, k, text + y, cost + price + model[a][b][k])

    go(0, 0, 0, "", 0.0)
    return out


def test_viterbi_equals_enumeration():
    words = "idiot stupid moron pathetic clown trash loser scum the of and in this that".split()
    model = costs(count_trigrams([" ".join(words * 20).encode()]))
    for token in ("1d10t", "m0r0n", "st-up1d", "tr4$h", "cl0wwwn", "5cum!", "l.0.s.e.r", "th3-0f"):
        for edge in (None, 0.0, -1.5):
            found = every_decoding(token, model, edge)
            assert Deobfuscator(model).decode(token, edge) in {t for cost, t in found if cost <= min(found)[0] + 1e-9}


def test_score_equals_a_plain_one(docs, labels):
    """The score recomputed from the model, one text at a time."""
    t = Toxicity(certain=2.0, purity=0.1, folds=2, held_out=5)
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(t._language_model(docs.select("doc_id", "text")))
    lexicon, base = t.fit(docs.select("doc_id", "text"), labels, model)
    assert lexicon
    d = Deobfuscator(model.value)
    for r in t.scored(docs, labels).collect():
        words = d.restored(texts()[r.doc_id]) if texts()[r.doc_id] else set()
        alone = {w: max((lexicon.get(e, 0.0) for e in (w, *(w[:n] + "*" for n in range(4, 10) if n < len(w)))), default=0.0) for w in words}
        pairs = {}
        for e in entries(words):
            if e.endswith("**") and e in lexicon:
                pairs[e[:4]] = max(pairs.get(e[:4], 0.0), lexicon[e])
        rest = (1 - base) * np.prod([1 - x for x in (*alone.values(), *pairs.values())])
        assert abs(r.score - (1 - rest)) < 1e-9


def test_tables_add_up_to_the_score():
    """The vectorised score against one that looks each feature up by itself."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    m = AdditiveModel(rounds=10, pair_rounds=5).fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    assert m.pairs
    for row, score in zip(x, m.score(x), strict=True):
        f = m.base + sum(m.tables[j][sum(v >= c for c in m.cuts[j])] for j, v in enumerate(row))
        f += sum(t[sum(row[i] >= c for c in m.coarse[i]), sum(row[j] >= c for c in m.coarse[j])] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
        assert abs(score - 1 / (1 + np.exp(-f))) < 1e-12


def test_classifier_query_scores_by_its_features(spark, docs, labels):
    op = QualityClassifier()
    model = op.fit(docs, labels)
    want = {i: float(model.score(np.array([features((t or "").encode())]))[0]) for i, t in enumerate(texts())}
    for r in op.scored(docs, labels).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-12 and r.predicted == (want[r.doc_id] >= op.threshold)
    assert {r.doc_id for r in op.accepted(docs, labels).collect()} == {i for i, s in want.items() if s >= op.threshold}


def test_only_ascii_letters_are_lowered(spark):
    df = spark.createDataFrame([(1, "MIT LICENSE"), (2, "m\u0130t license \u212a"), (3, "ÉA É")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan(df).collect()}
    assert got[1].first_word == 0 and not got[2].hits and got[3].n_words == 2


def test_many_hits_take_linear_time(spark):
    import time

    times = []
    for k in (8_000, 32_000):
        df = spark.createDataFrame([(1, "some words here mit license and gpl license version 2 " * k)], "doc_id long, text string")
        began = time.perf_counter()
        r = license_scan(df).selectExpr("size(hits) AS h", "size(detections) AS d", "last_word").first()
        times.append(time.perf_counter() - began)
        assert (r.h, r.last_word) == (2 * k, 10 * (k - 1) + 3)
    assert times[1] < 12 * times[0]


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = q.op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    tp = sum(r.predicted and r.toxic for r in got)
    assert tp / sum(r.toxic for r in got) >= 0.9 and tp / sum(r.predicted for r in got) >= 0.9
