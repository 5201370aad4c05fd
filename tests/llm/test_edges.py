"""Every operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import public_tokenizers
import pytest

import corpus_pipeline as p
from inkstream.llm.chat_format import chat_format
from inkstream.llm.cluster import shared_folder
from inkstream.llm.embedding_dedup import EmbeddingDedup
from inkstream.llm.jaccard_join import JaccardJoin
from inkstream.llm.license_scan import license_scan
from inkstream.llm.mixing import Mixing
from inkstream.llm.packing import Packing
from inkstream.llm.quality_classifier import QualityClassifier
from inkstream.llm.quality_rules import quality_rules
from inkstream.llm.substring_dedup import SubstringDedup
from inkstream.llm.toxicity import Toxicity

from .conftest import LONG, texts

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Names of results and of the operators' own columns.
CLASHING = "shard kept removed n_words n_removed bucket key draws rank copy start length size taken target source_size score predicted held_out component_id n_shingles component rep n hits detections words tie at many segments sequence_id offset ids spot part doc_tokens entry x y kin".split()

OPERATORS = {
    "license_scan": lambda d, labels: license_scan(d).select("doc_id", "n_words", "labels" if "labels" in d.columns else "first_word"),
    "quality_rules": lambda d, labels: quality_rules(d).select("doc_id", "n_words", "kept"),
    "toxicity": lambda d, labels: Toxicity().scored(d, labels).select("doc_id", "score", "predicted"),
    "packing": lambda d, labels: Packing(PATH, size=512).pack(d).groupBy("doc_id", "doc_tokens").agg({"length": "sum"}),
    "substring_dedup": lambda d, labels: SubstringDedup().dedup(d).select("doc_id", "n_words", "n_removed", "kept"),
    "quality_classifier": lambda d, labels: QualityClassifier().scored(d, labels).select("doc_id", "score", "predicted"),
    "jaccard_join": lambda d, labels: JaccardJoin().components(d),
    "mixing": lambda d, labels: Mixing(block=16).taken(d).select("doc_id", "size", "target", "taken"),
}


def clashing(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, "en", "ab"[(i or 0) % 2], len(t or ""), *("k" for _ in CLASHING)) for i, t in rows], schema).repartition(3)


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, labels, name):
    op = OPERATORS[name]
    rows = list(enumerate(texts()))
    got = op(clashing(spark, rows), labels).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows]
    again = op(clashing(spark, rows + [rows[3], rows[10], rows[0]]), labels).collect()
    assert {r.doc_id for r in again} == {i for i, _ in rows}
    if name != "packing":
        assert len(again) == len(rows) + 3
    if name in ("license_scan", "quality_rules", "substring_dedup", "jaccard_join"):
        assert {tuple(r) for r in again} == {tuple(r) for r in got}
    assert op(clashing(spark, rows).limit(0), labels).collect() == []
    assert op(clashing(spark, rows[:1]), labels).count() == 1


BIG = 2**53


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_without_an_id(spark, labels, name):
    """They neither crash nor change other rows, ids that doubles cannot hold included."""
    base = [(BIG + 1 + 2 * i, t) for i, t in enumerate(texts())]
    none = [(None, texts()[12]), (None, texts()[7]), (None, None)]
    op = OPERATORS[name]
    with_, without = (op(clashing(spark, rows).coalesce(1), labels).collect() for rows in (base + none, base))
    key = lambda rows: sorted(tuple(r) for r in rows if r.doc_id is not None)
    assert [r[0] for r in key(with_)] == [r[0] for r in key(without)] and len({r.doc_id for r in with_}) == len(base) + 1
    if name in ("license_scan", "quality_rules", "substring_dedup", "jaccard_join"):
        assert key(with_) == key(without)
    if name == "jaccard_join":
        assert all(r.component_id is None for r in with_ if r.doc_id is None) and len([r for r in with_ if r.doc_id is None]) == 3
        assert len({r.component_id for r in with_ if r.doc_id}) < len(base)
    if name == "substring_dedup":
        assert all(r.n_removed == 0 for r in with_ if r.doc_id is None)
    if name in ("toxicity", "quality_classifier"):
        full = (Toxicity if name == "toxicity" else QualityClassifier)().scored(clashing(spark, base + none), labels)
        assert full.where("held_out IS NULL").count() == 0


def test_vectors_without_an_id(spark):
    v = [[1.0, 0.0], [0.999, 0.01]]
    rows = [(BIG + 1, v[0], 0), (BIG + 3, v[1], 0), (None, v[0], 0), (None, v[1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1)
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in EmbeddingDedup().dedup(df).collect()]
    assert sorted(got, key=str) == sorted([(BIG + 1, 1, BIG + 1, True), (BIG + 3, 1, BIG + 1, False), (None, 0, None, True), (None, 0, None, True)], key=str)


def test_rows_of_one_id_with_different_texts(spark):
    t = [" ".join(f"q{i}{k}" for i in range(40)) for k in range(2)]
    df = spark.createDataFrame([(1, t[1]), (1, t[0]), (2, t[0]), (3, t[1])], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in JaccardJoin().components(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3)]  # the least text of id 1 counts


def test_repeated_vectors(spark):
    v = [[1.0, 0.0], [0.999, 0.01], [0.0, 1.0]]
    rows = [(1, v[0], 0), (1, v[0], 0), (2, v[1], 0), (3, v[2], 0), (4, v[0], 0), (4, v[2], 0)]
    df = spark.createDataFrame([(*x, "k", "k") for x in rows], "vec_id long, embedding array<double>, label int, cell string, home string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in EmbeddingDedup().dedup(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (4, 1, 3)]
    assert EmbeddingDedup().dedup(df.limit(0)).collect() == []


def test_long_conversations_with_one_turn_number(spark):
    rows = [(1, 0, "user", f"t{i % 50}") for i in range(3000)] + [(1, 0, "user", LONG)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, chunk string")
    got = chat_format(df).collect()
    assert len(got) == 1 and got[0].n_turns == 3001 and not got[0].valid
    assert chat_format(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", [s[0] for s in p.STAGES[:-1]])
def test_stages_take_any_rows(spark, tmp_path, name):
    """Each stage returns the columns of its documents, clashing ones included, and takes an empty table."""
    labels = [(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = list(enumerate(texts()))
    df = clashing(spark, rows + [rows[3], rows[10]])
    stage = dict(p.STAGES)[name]
    out = stage(spark, df, str(tmp_path))
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    got = out.collect()
    assert all(r[c] == "k" for r in got for c in CLASHING) and {r.doc_id for r in got} <= {i for i, _ in rows}
    if name == "substring_dedup":
        assert len(got) == len(rows) + 2
    if name == "jaccard_join":
        assert {r.doc_id for r in got} == {r.doc_id for r in JaccardJoin().components(df).collect() if r.doc_id == r.component_id}
    assert stage(spark, df.limit(0), str(tmp_path)).collect() == []


def test_only_tables_that_the_result_reads_stay(spark, docs):
    import os

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = JaccardJoin().components(docs)
    left = set(os.listdir(folder)) - before
    assert 0 < len(left) <= 4 and out.count() == len(texts())
