"""The map of the corpus: projection, density clusters with labels, sizes, label order and the overlay of a search."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store
from .classifier import STOP_WORDS
from .graph import components

# Weights of a publication's size, the lift of recommended documents, the zoom of a search.
COUNT_WEIGHT, SUBSCRIBER_WEIGHT = 0.06, 0.9
BOOST, BOOSTED = 6.0, 250
ZOOM_SPAN, ZOOM_LEAST, ZOOM_MOST, ZOOM_SINGLE, ZOOM_LIMIT = 0.3, 4.0, 15.0, 6.0, 500.0


def size_scores(publications: DataFrame, documents: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(uri, score): the root of the documents, faint, and of the subscribers, strong."""
    d = documents.groupBy(F.col("publication_uri").alias("uri")).agg(F.count("*").alias("n"))
    s = subscriptions.groupBy(F.col("publication_did").alias("did"), F.col("publication_rkey").alias("rkey")).agg(F.count_distinct("did").alias("subs"))
    rows = publications.select("uri", "did", "rkey").join(d, "uri", "left").join(s, ["did", "rkey"], "left")
    return rows.select("uri", F.round(COUNT_WEIGHT * F.sqrt(F.coalesce("n", F.lit(0))) + SUBSCRIBER_WEIGHT * F.sqrt(F.coalesce("subs", F.lit(0))), 6).alias("score"))


def label_order(documents: DataFrame, recommends: DataFrame) -> DataFrame:
    """(uri, weight): documents by the size of their publication; of the most recommended each goes above all others."""
    size = documents.where("base_path <> ''").groupBy("base_path").agg(F.count("*").alias("n"))
    top = recommends.groupBy(F.col("document_uri").alias("uri")).agg(F.count_distinct("did").alias("w")).join(documents.select("uri", F.coalesce("created_at", F.lit("")).alias("created_at")), "uri")
    top = top.orderBy(F.desc("w"), F.desc("created_at"), "uri").limit(BOOSTED).select("uri", "w")
    rows = documents.select("uri", "base_path").join(size, "base_path", "left").join(top, "uri", "left")
    return rows.select("uri", F.round(F.expr(f"ln(1 + coalesce(n, 0)) + CASE WHEN w IS NULL THEN 0D ELSE {BOOST}D + ln(1 + w) END"), 6).alias("weight"))


def search_overlay(hits: DataFrame, points: DataFrame) -> DataFrame:
    """(found, cx, cy, zoom) of a positioned list of hits: those on the map weigh by rank, and the zoom covers the furthest."""
    total = hits.agg(F.count("*").alias("total"))
    on = hits.join(points, "uri").crossJoin(F.broadcast(total)).withColumn("w", F.col("total") - F.col("pos") + 1)  # one row
    centre = on.agg(F.count("*").alias("found"), (F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("cx"), (F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("cy"))
    far = on.crossJoin(F.broadcast(centre)).groupBy("found", "cx", "cy").agg(F.max(F.expr("sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))")).alias("d"))
    zoom = f"greatest({ZOOM_LEAST}D, least({ZOOM_MOST}D, CASE WHEN d > 0 THEN least({ZOOM_LIMIT}D, {ZOOM_SPAN}D / d) ELSE {ZOOM_SINGLE}D END))"
    return far.select("found", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round(F.expr(zoom), 6).alias("zoom"))


def principal_axes(vectors: DataFrame, k: int, embedding: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes) of the vectors; sums and products of coordinates are added up by partition, dim x dim numbers reach the driver."""
    import pyarrow as pa

    def add(it):
        total = None
        for b in it:
            col = b[embedding]
            rows = [r for r in col.to_pylist() if r]
            if rows:
                x = np.array(rows, np.float64)
                one = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).reshape(-1)])
                total = one if total is None else total + one
        if total is not None:
            yield pa.record_batch({"at": pa.array(range(len(total)), pa.int32()), "v": pa.array(total)})

    rows = vectors.select(embedding).mapInArrow(add, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    flat = np.array([r.v for r in rows])
    dim = round((-1 + (1 + 4 * (len(flat) - 1)) ** 0.5) / 2) if len(flat) else 0
    if not dim:
        return np.zeros(0), np.zeros((k, 0))
    mean = flat[1 : 1 + dim] / flat[0]
    cov = flat[1 + dim :].reshape(dim, dim) / flat[0] - np.outer(mean, mean)
    _, axes = np.linalg.eigh(cov)
    axes = axes[:, ::-1][:, :k].T
    return mean, axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]


def projected(vectors: DataFrame, k: int, embedding: str = "embedding") -> DataFrame:
    """vectors with `axis`, their coordinates on the first k principal axes."""
    mean, axes = principal_axes(vectors, k, embedding)
    lit = lambda x: F.array(*(F.lit(float(v)) for v in x))
    dot = lambda a: F.aggregate(F.zip_with(F.zip_with(F.col(embedding), lit(mean), lambda v, m: v.cast("double") - m), lit(a), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    return vectors.withColumn("axis", F.array(*(dot(a) for a in axes)))


def scaled(points: DataFrame, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Each column spread over -1 to 1."""
    ends = points.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = points.crossJoin(F.broadcast(ends))  # one row
    for c in columns:
        out = out.withColumn(c, F.expr(f"CASE WHEN _hi_{c} > _lo_{c} THEN round(2 * ({c} - _lo_{c}) / (_hi_{c} - _lo_{c}) - 1, 6) ELSE 0D END"))
    return out.drop(*(f"_{n}_{c}" for c in columns for n in ("lo", "hi")))


#: Side of a cell in radii: all points of a cell are within the radius of each other, and points within it are at most two cells apart.
SIDE = 0.7
#: Cells from the origin up to which doubles tell cells apart; places beyond are an error.
FAR = float(1 << 40)
#: Pairs of points that are compared one by one to link cells, as a multiple of all dense points, and halvings of a cell at most before that.
COMPARED, HALVINGS = 16, 20


def _within(radius: float) -> Column:
    return (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy")) <= radius * radius


def _around(points: DataFrame) -> DataFrame:
    """Points in the 5 x 5 cells around their own, as (q, qx, qy, cx, cy)."""
    away = F.array(*(F.lit(d).cast("long") for d in range(-2, 3)))
    p = points.select(F.col("id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), "cx", "cy").withColumn("dx", F.explode(away)).withColumn("dy", F.explode(away))
    return p.select("q", "qx", "qy", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))


def _parts(points: DataFrame, level: int, side: str) -> DataFrame:
    """Cells halved `level` times, each with the number of its points and the box around them.  side is a letter that names the columns."""
    at = lambda c: F.floor(F.col(f"g{c}") * float(1 << level)).alias(f"{side}{c}")
    ends = (f(c).alias(f"{side}{c}{n}") for c in "xy" for n, f in (("0", F.min), ("1", F.max)))
    return points.groupBy(at("x"), at("y")).agg(F.count("*").alias(f"{side}n"), *ends)


def _bounds(pairs: DataFrame) -> DataFrame:
    """Pairs of parts with the squares of the least and the largest distance that their boxes allow.

    They are rounded as a distance of points is, and rounding keeps order, so they bound what is computed of points as well."""
    gap = lambda c: f"greatest(a{c}0 - b{c}1, b{c}0 - a{c}1, 0D)"
    span = lambda c: f"greatest(a{c}1 - b{c}0, b{c}1 - a{c}0)"
    square = lambda f: F.expr(f"{f('x')} * {f('x')} + {f('y')} * {f('y')}")
    return pairs.select("ax", "ay", "bx", "by", "an", "bn", square(gap).alias("least"), square(span).alias("most"))


def linked_cells(points: DataFrame, radius: float, kept: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(ax, ay, bx, by): pairs of neighbouring cells of points (gx, gy, x, y) that hold two points within the radius.

    Boxes around the points decide most pairs; what they leave open is decided by halves of the cells, and by single points
    where few are left, so the work follows the cells that are in use and not the pairs of points."""
    steps = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    near = F.explode(F.array(*(F.struct(F.lit(dx).cast("long").alias("x"), F.lit(dy).cast("long").alias("y")) for dx, dy in steps)))
    cells = kept(_parts(points, 0, "a"), "parts-0")
    other = cells.select(*(F.col(c).alias("b" + c[1:]) for c in cells.columns))
    meet = cells.withColumn("d", near).withColumns({"bx": F.col("ax") + F.col("d.x"), "by": F.col("ay") + F.col("d.y")}).drop("d").join(other, ["bx", "by"])
    r2, found, compared = radius * radius, None, COMPARED * (cells.agg(F.sum("an")).first()[0] or 0)
    for level in range(HALVINGS + 1):
        pairs = kept(_bounds(meet).where(F.col("least") <= r2), f"pairs-{level}")
        cell = [F.shiftright(c, level).alias(c) for c in ("ax", "ay", "bx", "by")]
        sure = pairs.where(F.col("most") <= r2).select(*cell).distinct()
        found = kept(sure if found is None else sure.unionByName(found), f"found-{level}")
        keys = [F.shiftright(c, level).alias(f"_{c}") for c in ("ax", "ay", "bx", "by")]
        told = found.select(*(F.col(c).alias(f"_{c}") for c in found.columns))
        open_ = kept(pairs.select("ax", "ay", "bx", "by", "an", "bn", *keys).join(told, [f"_{c}" for c in found.columns], "left_anti").select("ax", "ay", "bx", "by", "an", "bn"), f"open-{level}")
        left = open_.agg(F.sum(F.col("an").cast("double") * F.col("bn"))).first()[0] or 0.0
        if not left:
            return found
        if left <= compared or level == HALVINGS:
            break
        half = kept(_parts(points, level + 1, "a"), f"parts-{level + 1}").withColumns({"_ax": F.shiftright("ax", 1), "_ay": F.shiftright("ay", 1)})
        to = half.select(*(F.col(c).alias(c.replace("a", "b", 1)) for c in half.columns))
        meet = open_.select(*(F.col(c).alias(f"_{c}") for c in ("ax", "ay", "bx", "by"))).join(half, ["_ax", "_ay"]).join(to, ["_bx", "_by"])
    at = lambda side: [F.floor(F.col(f"g{c}") * float(1 << level)).alias(f"{side}{c}") for c in "xy"]
    single = open_.select("ax", "ay", "bx", "by").join(points.select(*at("a"), "x", "y"), ["ax", "ay"]).join(points.select(*at("b"), F.col("x").alias("qx"), F.col("y").alias("qy")), ["bx", "by"])
    return kept(found.unionByName(single.where(_within(radius)).select(*cell).distinct()), "found")


def density_clusters(points: DataFrame, radius: float, min_samples: int, min_size: int) -> DataFrame:
    """(id, x, y, cluster, core): density clusters by their least dense point; noise goes to the nearest centre.

    Dense points have min_samples others within the radius; linked ones form a cluster, to which points within the
    radius belong as well (of several clusters the least); clusters below min_size are noise.  core says whether a
    point was assigned and not only snapped.  One fixed radius stands for the hierarchy of densities.

    Points lie in cells no wider than the radius.  All points of a cell with enough of them are dense and all dense points of a
    cell are linked, so only points of cells that hold few are compared with those around, and cells are linked, not points.
    Rows of one id are one point in several places; rows without an id or a finite place link with nothing."""
    spark = points.sparkSession
    base = f"{store.folder(spark)}/clusters-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    finite = points.where("id IS NOT NULL AND abs(x) < double('Infinity') AND abs(y) < double('Infinity')")
    number = lambda c: F.when(F.abs(c) < FAR * radius * SIDE, F.col(c) / (radius * SIDE)).otherwise(F.raise_error(F.lit(f"{c} is more than {FAR:.0f} cells from 0")).cast("double"))
    placed = kept(finite.select("id", "x", "y", number("x").alias("gx"), number("y").alias("gy")).withColumns({"cx": F.floor("gx"), "cy": F.floor("gy")}), "placed")
    full = placed.groupBy("cx", "cy", "id").count().groupBy("cx", "cy").agg((F.sum("count") - F.max("count")).alias("others")).where(F.col("others") >= min_samples).select("cx", "cy")
    full = kept(full, "full")
    few = placed.join(full, ["cx", "cy"], "left_anti")
    counted = placed.join(_around(few), ["cx", "cy"]).where((F.col("id") != F.col("q")) & _within(radius)).groupBy("q").count().where(F.col("count") >= min_samples).select(F.col("q").alias("id"))
    ids = kept(placed.join(full, ["cx", "cy"], "left_semi").select("id").unionByName(counted).distinct(), "ids")
    dense = kept(placed.join(ids, "id", "left_semi"), "dense")
    cells = kept(dense.groupBy("cx", "cy").agg(F.min("id").alias("node")), "cells")
    pairs = linked_cells(dense, radius, kept)
    names = [cells.select(F.col("cx").alias(f"{s}x"), F.col("cy").alias(f"{s}y"), F.col("node").alias(n)) for s, n in (("a", "u"), ("b", "v"))]
    links = pairs.join(names[0], ["ax", "ay"]).join(names[1], ["bx", "by"]).select("u", "v")
    own = dense.select("id", "cx", "cy").join(cells, ["cx", "cy"]).select("id", "node")
    apart = own.groupBy("id").agg(F.min("node").alias("u"), F.collect_set("node").alias("v")).where("size(v) > 1").select("u", F.explode("v").alias("v"))
    found = components(cells.select("node"), links.unionByName(apart))
    dense = kept(dense.join(cells.join(found, "node"), ["cx", "cy"]).select("id", "x", "y", "cx", "cy", "component"), "found-of-points")
    edge = dense.select("x", "y", "cx", "cy", "component").join(_around(few.join(ids, "id", "left_anti")), ["cx", "cy"]).where(_within(radius)).groupBy(F.col("q").alias("id")).agg(F.min("component").alias("component"))
    member = dense.select("id", "component").distinct().unionByName(edge)
    large = member.groupBy("component").count().where(f"count >= {min_size}").select("component")
    member = kept(member.join(large, "component").select("id", F.col("component").alias("cluster")), "member")
    for name in store.names(spark, base):
        if name != "member":
            store.delete(spark, f"{base}/{name}")
    marked = points.join(member, "id", "left")
    centres = marked.where("cluster IS NOT NULL").groupBy("cluster").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    noise = marked.where("cluster IS NULL").select("id", "x", "y").crossJoin(centres.withColumnRenamed("cluster", "near"))
    d = F.round((F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my")), 12)
    snapped = noise.groupBy("id", "x", "y").agg(F.min(F.struct(d.alias("d"), "near"))["near"].alias("cluster"))
    return marked.where("cluster IS NOT NULL").select("id", "x", "y", "cluster", F.lit(True).alias("core")).unionByName(snapped.select("id", "x", "y", "cluster", F.lit(False).alias("core")))


def cluster_labels(members: DataFrame, titles: DataFrame, terms: int = 3, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(cluster, label): the words that tell a cluster's titles from the others'.

    Core members speak for a cluster, all of them where no core member has a title."""
    t = members.join(titles.where("coalesce(title, '') <> ''"), "id")
    has = t.where("core").select("cluster", F.lit(True).alias("has")).distinct()
    t = t.join(has, "cluster", "left").where("core OR has IS NULL")
    stop = ", ".join(map(repr, stop_words))
    words = t.select("cluster", F.explode(F.expr(f"filter(regexp_extract_all(lower(title), '[a-z0-9]+', 0), w -> length(w) >= 2 AND w NOT IN ({stop}))")).alias("word"))
    tf = words.groupBy("cluster", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    n = members.agg(F.count_distinct("cluster").alias("n"))
    scored = tf.join(df, "word").crossJoin(F.broadcast(n)).withColumn("s", F.round(F.expr("tf * (ln((1D + n) / (1D + df)) + 1)"), 6))  # one row
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("s"), "word"))).where(f"r <= {terms}")
    named = best.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), " ").alias("label"))
    return members.select("cluster").distinct().join(named, "cluster", "left").select("cluster", F.coalesce("label", F.concat(F.lit("cluster "), F.col("cluster").cast("string"))).alias("label"))


def place_of(uris: DataFrame, points: DataFrame) -> DataFrame:
    """(uri, found, x, y): a result's place on the map, if it has one."""
    return uris.join(points, "uri", "left").select("uri", F.col("x").isNotNull().alias("found"), "x", "y")
