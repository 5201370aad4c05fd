"""The registered queries of this subpackage and their SQL: thin digests of the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import chat_format, turns_read_back, unescaped
from .embedding_dedup import EmbeddingDedup
from .jaccard_join import JaccardJoin
from .license_scan import BASE, license_scan, rules
from .mixing import Mixing
from .oracles import SEQUENCED, pii
from .packing import Packing
from .pii import KINDS, pii_spans
from .quality_classifier import QualityClassifier
from .quality_rules import RULES, STOP_WORDS, quality_rules
from .sequenced_changes import SequencedChanges, dense_numbers
from .substring_dedup import SubstringDedup
from .toxicity import Toxicity
from .whitening import Whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(_table(spark, sf_dir, "documents"))
    listed = lambda e: f"array_join(array_sort(array_distinct({e})), ',')"
    base = "transform(filter(hits, x -> x.base), x -> x.label)"
    return out.select(
        "doc_id",
        "n_words",
        F.expr("CAST(size(filter(hits, x -> x.base)) AS BIGINT)").alias("n_base"),
        "first_word",
        "last_word",
        F.expr(listed(base)).alias("base_labels"),
        F.expr(listed(f"concat({base}, transform(detections, x -> x.label))")).alias("labels"),
        F.expr("coalesce(array_max(transform(detections, x -> x.confidence)), 0.0D)").alias("score"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Toxicity(folds=3, held_out=1, threshold=0.7).scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Packing(tokenizer_path(), end=2, size=4096).pack(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{said}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{said}'")
    out = chat_format(turns.unionByName(extra)).select("conv_id", "n_turns", "formatted", "segments", "valid", F.expr(turns_read_back("formatted")).alias("turns"))
    told = "array_join(transform(turns, x -> concat(x.role, '\\n', x.text, '\\n')), '')"
    out = out.select("conv_id", "n_turns", "formatted", "valid", F.expr(told).alias("told"), F.expr(f"array_join(transform(filter(segments, x -> x.loss), x -> {unescaped('x.text')}), '')").alias("learnt"))
    return out.select(
        "conv_id",
        "n_turns",
        F.sha2("told", 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = SubstringDedup(size=20).dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = QualityClassifier(folds=5, held_out=0, threshold=0.3)
    return model.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(k=5, num=4, den=5).components(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Mixing(weights=(5, 2, 1), share=1.5, most=2.0).taken(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "draws", "shards")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EmbeddingDedup(cosine=0.98).dedup(_table(spark, sf_dir, "embeddings"))


def op11_sequenced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = dense_numbers(_table(spark, sf_dir, "client_changes").distinct(), "client_id", "seq", "n")
    hashed = F.crc32(F.col("change_id").cast("string"))
    changes = changes.where(F.col("valid_at").isNotNull() & (hashed % 11 != 0))
    changes = changes.withColumn("day", (F.unix_date(F.to_date("valid_at")) + 2 * (hashed % 4)).cast("int"))
    part = F.least(F.lit(8), F.greatest(F.lit(1), 1 + F.floor((F.col("day") - 19723) * 8 / 160)))
    applier = SequencedChanges("client_id", "n", "day", "change_id", "op", ("city", "balance"), patience=5)
    out = applier.applied(changes.withColumn("part", part), "part", 8)
    return out.select(
        "change_id",
        "client_id",
        F.when(F.col("applied"), "applied").otherwise("rejected").alias("status"),
        "batch",
        "missed",
        "city",
        F.floor(100 * F.col("balance") + 0.5).cast("long").alias("cents"),
        "current",
    )


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_spans(_table(spark, sf_dir, "documents")).select("doc_id", "spans")
    count = lambda kind: F.expr(f"CAST(size(filter(spans, s -> s.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}")
    listed = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return out.select(
        "doc_id",
        *(count(k.name) for k in KINDS if k.base),
        F.sha2(F.expr(listed.format("filter(spans, s -> s.base)")), 256).alias("base_sha256"),
        F.expr(listed.format("spans")).alias("spans"),
        F.expr("coalesce(array_max(transform(spans, s -> s.score)), 0.0D)").alias("score"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Whitening(scale=64, offset=1_000_000, components=32).whitened(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_license_scan, op2_quality_rules, op3_toxicity, op4_packing, op5_chat_format, op6_substring_dedup)
    then = (op7_quality_classifier, op8_jaccard_join, op9_mixing, op10_embedding_dedup, op11_sequenced_changes, op12_pii, op13_whitening)
    return {f.__name__: f for f in (*first, *then)}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM win),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, rank() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM keyed) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM later)),
lists AS (SELECT doc_id, list(j) AS g FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
 sha256(CASE WHEN len(w) = 0 THEN '' ELSE array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(coalesce(g, CAST([] AS BIGINT[])), i)], ' ') END) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""

_OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"coalesce({_LOWER}, '')")} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(reach.y), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id
"""




def _op1() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({q(r.label)}, {q(r.regex())}, {r.priority}, {r.confidence}::DOUBLE, {r.base})" for r in rules())
    stem = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
norm AS (SELECT doc_id, len(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS n_words, ' ' || trim(regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{stem}', '  ', 'g'), ' ') || ' ' AS s FROM d),
rule(label, regex, priority, confidence, base) AS (VALUES {values}),
cut AS (SELECT doc_id, s, r.*, regexp_extract_all(s, regex) AS m, string_split_regex(s, regex) AS p FROM norm JOIN rule r ON regexp_matches(s, r.regex)),
hit AS (SELECT doc_id, s, label, regex, priority, confidence, base, i, CAST(list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS BIGINT) + 1 AS a, length(m[i]) AS n FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM cut)),
kept AS (SELECT DISTINCT h.doc_id, h.label, h.confidence FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit g WHERE g.doc_id = h.doc_id AND g.a <= h.a AND g.a + g.n >= h.a + h.n AND g.priority <= h.priority
 AND (g.a < h.a OR g.n > h.n OR g.priority < h.priority OR g.label < h.label))),
b AS (SELECT doc_id, count(*) AS n_base, min(w) AS first_word, max(w) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM (SELECT doc_id, label, CAST((length(s[1:a - 1]) - length(replace(s[1:a - 1], ' ', ''))) // 2 AS BIGINT) AS w FROM hit WHERE base) GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM kept UNION SELECT doc_id, label FROM hit WHERE base) GROUP BY doc_id),
c AS (SELECT doc_id, max(confidence) AS score FROM kept GROUP BY doc_id)
SELECT norm.doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM norm LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def _op2() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]))
    failed = " OR ".join(f"coalesce({r.failed().replace('D)', ')').replace('D OR', ' OR').replace(' / ', ' * 1.0 / ')}, false)" for r in RULES)
    has = r"'[^\x20\x09-\x0D]'"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, {has})] AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(t) - length(replace(t, '!', '')) AS n_exclaims,
 len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len([x FOR x IN l IF regexp_matches(x, '^[ \t]*[-*•]')]) AS n_bullet_lines,
 len([x FOR x IN l IF regexp_matches(x, '(\.\.\.|…)[ \t]*$')]) AS n_ellipsis_lines, len([x FOR x IN w IF x IN ({stop})]) AS n_stop, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
 FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({failed}) AS kept FROM f
"""


_OP5 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS x, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS r,
 coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), '^') AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS after FROM c)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length(x) + CASE role WHEN 'system' THEN 16 WHEN 'user' THEN 18 WHEN 'assistant' THEN 20 ELSE 18 + length(r) END) AS BIGINT) AS formatted_chars,
 bool_and(CASE role WHEN 'system' THEN before = '^' WHEN 'user' THEN before IN ('^', 'system', 'assistant') WHEN 'assistant' THEN before = 'user' ELSE false END AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM e GROUP BY conv_id
"""

_OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT v.vec_id, coalesce(any_value(n.n), 0) AS n_links, least(v.vec_id, coalesce(min(reach.y), v.vec_id)) AS component_id, least(v.vec_id, coalesce(min(reach.y), v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.x = v.vec_id LEFT JOIN reach ON reach.x = v.vec_id GROUP BY v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": _op1(),
        "op2_quality_rules": _op2(),
        "op5_chat_format": _OP5,
        "op6_substring_dedup": _OP6,
        "op8_jaccard_join": _OP8,
        "op10_embedding_dedup": _OP10,
        "op11_sequenced_changes": SEQUENCED,
        "op12_pii": pii(),
    }
