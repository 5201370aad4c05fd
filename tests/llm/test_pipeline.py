"""The pipeline against a plain version of its stages, over the smallest tables."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p
from inkstream.llm.cluster import staged
from inkstream.llm.mixing import Mixing
from inkstream.llm.quality_classifier import QualityClassifier, features

from .test_sets import components, dedup

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def plain_accepted(spark, docs):
    """Documents whose own features the fitted tables score at the threshold or above, one at a time."""
    op = QualityClassifier(folds=5, held_out=0, threshold=0.3)
    model = op.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    return [(i, t) for i, t in rows_of(docs) if model.score(np.array([features((t or "").encode())]))[0] >= 0.3]


def plain_mixed(docs):
    """The words of each draw that the shards hold, by copy."""
    copies = {}
    for d in Mixing(weights=(5, 2, 1), share=1.5, most=2.0).dealt(docs).collect():
        copies.setdefault((d.doc_id, d.copy), []).append((d.start, d.length))
    texts, out = dict(rows_of(docs)), []
    for (i, _), parts in copies.items():
        words = (texts[i] or "").encode().split()
        whole = sum(n for _, n in parts) == len(words)
        out.append((i, texts[i] if whole else b" ".join(w for a, n in sorted(parts) for w in words[a : a + n]).decode()))
    return sorted(out)


def test_stages_equal_plain_ones(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES:
        before, known = docs, dict(rows_of(docs))
        docs = staged(stage(spark, docs, DATA))
        if name == "packing":
            break
        assert docs.columns == columns
        after = rows_of(docs)
        if name == "quality_classifier":
            assert after == plain_accepted(spark, before) and 0 < len(after) < len(known)
        elif name == "jaccard_join":
            assert {i for i, _ in after} == {i for i, (_, c) in components(list(known.items())).items() if c == i}
        elif name == "substring_dedup":
            want = dedup(list(known.items()))
            assert after == sorted((i, want[i][2] if want[i][1] else t) for i, t in known.items())
        elif name == "mixing":
            assert after == plain_mixed(before)
            assert all(r.n_chars == len(r.text or "") for r in docs.select("text", "n_chars").collect())
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in after)
    rows = docs.collect()
    assert sum(r.length for r in rows) == tokens and {r.doc_id for r in rows} == {i for i, _ in after}
    ends = {}
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    full = [sum(n for _, n in x) for x in ends.values()]
    assert all(sorted(x)[0][0] == 0 for x in ends.values()) and max(full) <= 4096 and sum(n < 4096 for n in full) <= 1


def test_run_is_the_last_stage(spark):
    assert p.run(spark, DATA).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
