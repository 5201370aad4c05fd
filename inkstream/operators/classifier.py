"""Rule-based author classification: template, structure, thinness and volume of an author's titles.

The live score and its offline twin differ on purpose and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that carry no content, weights, thresholds and sizes of both scores.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "for", "with",
    "at", "by", "from", "is", "are", "was", "were", "be", "as", "it", "this", "that",
    "i", "you", "we", "my", "your", "our", "me", "no", "not", "do",
)
WEIGHTS = {"template": 0.45, "structural": 0.20, "thinness": 0.20, "volume": 0.15}
THRESHOLD = 0.50
OFFLINE_THRESHOLD = 0.35
FLOOR, EVERY, SAMPLE = 50, 25, 64
THIN = 800.0
MAX_ATTEMPTS = 5
STATES = ("observing", "pending", "labeled", "rejected", "vetoed")


def is_stop_word(word: str) -> Column:
    return F.expr(f"{word} IN ({', '.join(map(repr, STOP_WORDS))})")


def normalized_title(col: str) -> Column:
    """Lower case, digit runs as '#', anything else as one space, 256 characters at most."""
    return F.expr(f"substring(trim(regexp_replace(regexp_replace(lower({col}), '[^a-z0-9]+', ' '), '[0-9]+', '#')), 1, 256)")


def content_words(normalized: str) -> Column:
    return F.expr(f"filter(split({normalized}, ' '), w -> length(w) > 1 AND w NOT IN ({', '.join(map(repr, STOP_WORDS))}))")


def ordered(docs: DataFrame) -> DataFrame:
    """(did, uri, i, norm, chars, empty, digit): an author's documents in the order they came, from 1."""
    w = Window.partitionBy("did").orderBy("indexed_at", "uri")
    t = docs.select("did", "uri", "indexed_at", F.coalesce("title", F.lit("")).alias("title"), F.length("content").alias("chars"))
    t = t.select("did", "uri", F.row_number().over(w).alias("i"), normalized_title("title").alias("norm"), "chars", "title")
    return t.select("did", "uri", "i", "norm", "chars", F.expr("trim(title) = ''").alias("empty"), F.expr("title RLIKE '[0-9]'").alias("digit"))


def scaffold_shares(titles: DataFrame, key: list[str]) -> DataFrame:
    """(key, template): the mean share of a title's content words that stand in at least half of the key's titles.

    Words are counted by key and word before anything is joined.  A title without content words counts as 0; one
    of three words at most, of which half are shared, counts as 1."""
    held = titles.select(*key, "uri", content_words("norm").alias("words"))
    n = held.groupBy(*key).agg(F.count("*").alias("n"))
    common = held.select(*key, F.explode(F.array_distinct("words")).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("c"))
    common = common.join(n, key).where("c * 2 >= n").select(*key, "word")
    each = held.select(*key, "uri", F.size("words").alias("size"), F.explode("words").alias("word"))
    hit = each.join(common, [*key, "word"]).groupBy(*key, "uri", "size").agg(F.count("*").alias("hit"))
    covered = hit.groupBy(*key).agg(F.sum(F.expr("CASE WHEN size <= 3 AND hit * 2 >= size THEN 1D ELSE hit / size END")).alias("covered"))
    return n.join(covered, key, "left").select(*key, F.expr("coalesce(covered, 0D) / n").alias("template"))


_CLAMP = "greatest(0D, least(1D, {}))"
_VOLUME = _CLAMP.format("(log10(greatest(n, 1)) - 2D) / 2D")


def composite(sums: DataFrame) -> DataFrame:
    """Adds structural, thinness, volume, score and promoted to rows of n, chars, empties, digits and template."""
    score = " + ".join(f"{w}D * {k}" for k, w in WEIGHTS.items())
    out = sums.select("*", F.expr("greatest(empties / n, digits / n)").alias("structural"), F.expr(_CLAMP.format(f"1D - chars / n / {THIN}D")).alias("thinness"), F.expr(_VOLUME).alias("volume"))
    return out.select("*", F.round(F.expr(score), 6).alias("score"), F.expr(f"1D - chars / n / {THIN}D > 0.9D AND volume > 0.3D").alias("promoted"))


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), F.sum("chars").alias("chars"), F.count_if("empty").alias("empties"), F.count_if("digit").alias("digits")]


def author_scores(docs: DataFrame, floor: int = FLOOR) -> DataFrame:
    """(did, n, template, structural, thinness, volume, score, promoted) of authors with `floor` documents or more."""
    rows = ordered(docs)
    sums = rows.groupBy("did").agg(*_sums()).where(f"n >= {floor}")
    template = scaffold_shares(rows.where(f"i <= {SAMPLE} AND norm <> ''"), ["did"])
    out = composite(sums.join(template, "did", "left").withColumn("template", F.coalesce("template", F.lit(0.0))))
    return out.select("did", "n", *(F.round(c, 6).alias(c) for c in WEIGHTS), "score", "promoted")


def curated_authors(recommends: DataFrame, documents: DataFrame, subscriptions: DataFrame, publications: DataFrame) -> DataFrame:
    """Authors with a recommended document or a subscribed publication, by exact uri."""
    a = documents.join(recommends.select(F.col("document_uri").alias("uri")).distinct(), "uri", "left_semi").select("did")
    b = publications.join(subscriptions.select(F.col("publication_uri").alias("uri")).distinct(), "uri", "left_semi").select("did")
    return a.unionByName(b).distinct()


def author_states(docs: DataFrame, curated: DataFrame, floor: int = FLOOR, every: int = EVERY) -> DataFrame:
    """(did, state, n, decided_at): what the rolling classifier says of each author.

    It looks at an author every `every` documents from `floor` on; the first look that reaches the threshold, or a
    thin and prolific author, decides and freezes: vetoed if curated, else pending.  Others are observed."""
    rows = ordered(docs).withColumn("step", F.expr(f"CAST((i + {every} - 1) div {every} AS INT)"))
    steps = rows.groupBy("did", "step").agg(*_sums())
    w = Window.partitionBy("did").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    so_far = steps.select("did", "step", *(F.sum(c).over(w).alias(c) for c in ("n", "chars", "empties", "digits")))
    looks = so_far.where(f"n = step * {every} AND n >= {floor}").withColumn("k", F.least("n", F.lit(SAMPLE)))
    sizes = looks.select("did", "k").distinct()
    titles = rows.where(f"i <= {SAMPLE} AND norm <> ''").join(sizes, "did").where("i <= k").select("did", "k", "uri", "norm")
    scored = composite(looks.join(scaffold_shares(titles, ["did", "k"]), ["did", "k"], "left").withColumn("template", F.coalesce("template", F.lit(0.0))))
    first = scored.where(f"score >= {THRESHOLD} OR promoted").groupBy("did").agg(F.min("n").alias("decided_at"))
    all_ = steps.groupBy("did").agg(F.sum("n").alias("n")).join(first, "did", "left")
    marked = all_.join(curated.select("did", F.lit(True).alias("c")).distinct(), "did", "left")
    return marked.select("did", F.expr("CASE WHEN decided_at IS NULL THEN 'observing' WHEN c THEN 'vetoed' ELSE 'pending' END").alias("state"), "n", "decided_at")


def summary(states: DataFrame, limit: int = 500) -> DataFrame:
    """(section, name, n): counts of every state, then the decided authors: labeled, pending, vetoed, rejected, largest first."""
    names = states.sparkSession.createDataFrame([(i, s) for i, s in enumerate(STATES)], "pos int, state string")
    counts = names.join(states.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select(F.lit("counts").alias("section"), F.col("pos").cast("long").alias("pos"), F.col("state").alias("name"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    place = "CASE state WHEN 'labeled' THEN 0 WHEN 'pending' THEN 1 WHEN 'vetoed' THEN 2 ELSE 3 END"
    top = states.where("state <> 'observing'").withColumn("p", F.expr(place)).orderBy("p", F.desc("n"), "did").limit(limit)
    authors = top.withColumn("pos", F.row_number().over(Window.orderBy("p", F.desc("n"), "did")).cast("long"))
    return counts.unionByName(authors.select(F.lit("authors").alias("section"), "pos", F.col("did").alias("name"), F.col("n").cast("long").alias("n")))


def next_pending(queue: DataFrame) -> DataFrame:
    """The pending author with the fewest attempts below the limit."""
    return queue.where(f"state = 'pending' AND attempts < {MAX_ATTEMPTS}").orderBy("attempts", "did").limit(1)


def _offline_norm(title: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({title}), '[0-9]+', '#'), r'[^\p{{L}}\p{{N}}_\s#]', ' '), r'\s+', ' '))"


def offline_scores(docs: DataFrame, curated: DataFrame, floor: int = 20, least: float = OFFLINE_THRESHOLD) -> DataFrame:
    """(did, n, template, structural, thinness, volume, score): the offline twin over all titles of live authors.

    The template is the larger of repeated titles and shared words, a title without words counts as shared; curated
    authors score 0; only scores from `least` on are emitted."""
    t = docs.where("coalesce(is_bridgyfed, 0) = 0").select("did", "uri", F.coalesce("title", F.lit("")).alias("title"), F.length("content").alias("chars"))
    t = t.withColumn("norm", F.expr(_offline_norm("title")))
    sums = t.groupBy("did").agg(F.count("*").alias("n"), F.avg("chars").alias("mean"), F.count_if(F.trim("title") == "").alias("empties"), F.count_if(F.col("title").rlike("[0-9]")).alias("digits"), F.count_distinct("norm").alias("kinds")).where(f"n >= {floor}")
    held = t.join(sums.select("did"), "did", "left_semi").select("did", "uri", F.array_distinct(content_words("norm")).alias("words"))
    common = held.select("did", F.explode("words").alias("word")).groupBy("did", "word").agg(F.count("*").alias("c")).join(sums.select("did", "n"), "did").where("c * 2 >= n").select("did", "word")
    hit = held.select("did", "uri", F.size("words").alias("size"), F.explode("words").alias("word")).join(common, ["did", "word"]).groupBy("did", "uri", "size").agg(F.count("*").alias("hit"))
    shared = hit.groupBy("did").agg(F.sum(F.expr("hit / size")).alias("s"))
    bare = held.groupBy("did").agg(F.count_if(F.size("words") == 0).alias("bare"))
    rows = sums.join(shared, "did", "left").join(bare, "did").join(curated.select("did", F.lit(True).alias("c")).distinct(), "did", "left")
    rows = rows.select(
        "did", "n",
        F.expr("greatest(1D - kinds / n, (coalesce(s, 0D) + bare) / n)").alias("template"),
        F.expr("greatest(digits / n, empties / n)").alias("structural"),
        F.expr(_CLAMP.format(f"1D - mean / {THIN}D")).alias("thinness"),
        F.expr(_VOLUME).alias("volume"), "c",
    )
    score = " + ".join(f"{w}D * {k}" for k, w in WEIGHTS.items())
    out = rows.withColumn("score", F.expr(f"CASE WHEN c THEN 0D ELSE round({score}, 6) END")).where(F.col("score") >= least)
    return out.select("did", "n", *(F.round(c, 6).alias(c) for c in WEIGHTS), "score")


def margin(scores: DataFrame, flags: DataFrame, keeps: DataFrame) -> DataFrame:
    """(worst_flag, best_keep, margin, separated) of known authors; those without a score are left out."""
    known = flags.select("did", F.lit(True).alias("flag")).unionByName(keeps.select("did", F.lit(False).alias("flag"))).join(scores, "did")
    out = known.agg(F.coalesce(F.min(F.expr("CASE WHEN flag THEN score END")), F.lit(1.0)).alias("worst_flag"), F.coalesce(F.max(F.expr("CASE WHEN NOT flag THEN score END")), F.lit(0.0)).alias("best_keep"), F.expr(f"coalesce(bool_and(flag = (score >= {OFFLINE_THRESHOLD})), true)").alias("separated"))
    return out.select("worst_flag", "best_keep", F.round(F.col("worst_flag") - F.col("best_keep"), 6).alias("margin"), "separated")


def verdicts(votes: DataFrame) -> DataFrame:
    """(model, did, verdict): two of the votes for machine, or two for human, decide; otherwise null."""
    g = votes.groupBy("model", "did").agg(F.count_if("vote").alias("machine"), F.count_if(~F.col("vote")).alias("human"))
    return g.select("model", "did", F.expr("CASE WHEN machine >= 2 THEN true WHEN human >= 2 THEN false END").alias("verdict"))


def judged(votes: DataFrame, truth: DataFrame) -> DataFrame:
    """(model, right, known): how many known authors each model's verdicts get right; no verdict is not right."""
    g = verdicts(votes).join(truth, "did")
    return g.groupBy("model").agg(F.count_if(F.expr("verdict <=> truth")).alias("right"), F.count("*").alias("known"))
