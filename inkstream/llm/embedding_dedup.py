"""Embedding near-dedup: an exact metric range join on the unit sphere.

Vectors of one label and length link when their cosine, in double precision, reaches the threshold; that is
a Euclidean distance of at most r = sqrt(2 - 2 c) between unit vectors.  Null labels, null or zero vectors
and vectors with null or non-finite components link with nothing; nor does a row without an id.

Equal vectors are one class, counted before anything is exchanged.  Pivots, a sample by hash of each label's own
classes, divide it into cells: a class lives in the cell of its nearest pivot p, and visits the cell of a pivot q
of lower number if the bisecting plane of p and q is at most r away.  By the triangle inequality a partner cannot
be beyond that plane otherwise, so any two partners meet in the lower one of their two cells, and only there.
Cells work independently; a cell of many classes is cut into a grid of blocks of bounded size.  Pairs are counted
in the task, which returns each class's links and a spanning forest of them, never the pairs.

Random vectors of many dimensions are all nearly as far from one plane as from another, so visits grow with the
number of pivots; cells are therefore as large as a task can well compare.  An exact join of such vectors stays
quadratic within a label.

Of rows that share a vec_id the one of least label and vector counts, once, and each row gets its result.  Equal
cosines are no ties, since no order is made.  An empty table gives no rows; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import Forest, connected_components, lean, lean_group, staged, tidy

_USABLE = "label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"


def _matrix(col) -> np.ndarray:
    """Rows of equal length as doubles."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest_of(near: np.ndarray, left: np.ndarray, right: np.ndarray, forest: Forest) -> None:
    """Puts the links of a block (rows left, columns right) into the forest: each column is tied to the first of its
    rows, and each row to the first rows of its columns, distinct ones only."""
    row, col = np.nonzero(near)
    if not len(row):
        return
    first = near.argmax(axis=0)
    has = np.unique(col)
    for a, b in zip(left[first[has]].tolist(), right[has].tolist(), strict=True):
        forest.link(a, b)
    for k in np.unique(row * len(left) + first[col]).tolist():
        forest.link(int(left[k // len(left)]), int(left[k % len(left)]))


class EmbeddingDedup:
    """cell: classes that a pivot stands for; block: classes of a block's sides; max_pivots: pivots that are broadcast at most."""

    def __init__(self, cosine: float = 0.98, cell: int = 4096, block: int = 4096, max_pivots: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"):
        self.cosine, self.cell, self.block, self.max_pivots = cosine, cell, block, max_pivots
        self.vec_id, self.embedding, self.label = vec_id, embedding, label

    def _pivots(self, classes: DataFrame) -> dict[tuple, np.ndarray]:
        """Pivots of each (label, dim), in the order of a hash: two at least, one per `cell` classes, and a share of
        max_pivots at most.  Labels beyond that bound, the smallest, have none and are one cell each."""
        sizes = classes.groupBy("label", "dim").count()
        big = sizes.orderBy(F.desc("count"), "label", "dim").limit(self.max_pivots // 2).withColumn("want", F.expr(f"greatest(2, count div {self.cell})"))
        total = big.agg(F.sum("want")).first()[0] or 0
        share = max(1, -(-total // self.max_pivots))
        w = Window.partitionBy("label", "dim").orderBy("h", "rep")
        # Of each label the classes of least hash, thinned out by that hash before they are sorted.
        some = classes.join(big.withColumnRenamed("label", "_l").withColumnRenamed("dim", "_d"), F.expr("label <=> _l AND dim = _d")).withColumn("h", F.xxhash64("rep"))
        some = some.withColumn("k", F.expr(f"greatest(2, want div {share})")).where("(h / 18446744073709551616D + 0.5D) * count <= 4 * k + 40")
        rows = some.withColumn("r", F.row_number().over(w)).where("r <= k").select("label", "dim", "embedding", "r").collect()
        out: dict[tuple, list] = {}
        for r in sorted(rows, key=lambda r: r.r):
            out.setdefault((r.label, r.dim), []).append(r.embedding)
        return {k: _unit(np.array(v, np.float64)) for k, v in out.items()}

    @tidy
    def dedup(self, vectors: DataFrame) -> DataFrame:
        """(vec_id, n_links, component_id, kept)."""
        spark = vectors.sparkSession
        radius = math.sqrt(2 - 2 * self.cosine) + 1e-9
        v = vectors.select(F.col(self.vec_id).cast("long").alias("vec_id"), F.col(self.label).alias("label"), F.col(self.embedding).cast("array<double>").alias("embedding"))
        v = staged(v.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("least"), F.count("*").alias("rows")).select("vec_id", "least.*", "rows"))
        usable = f"vec_id IS NOT NULL AND coalesce({_USABLE}, false)"
        good = v.where(usable)
        classes = staged(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")).withColumn("dim", F.size("embedding")))
        held = spark.sparkContext.broadcast(self._pivots(classes))  # max_pivots vectors at most

        def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                dims, labels = b["dim"].to_pylist(), b["label"].to_pylist()
                groups: dict[tuple, list[int]] = {}
                for i, k in enumerate(zip(labels, dims, strict=True)):
                    groups.setdefault(k, []).append(i)
                for k, rows in groups.items():
                    t, p = b.take(pa.array(rows, pa.int64())), held.value.get(k)
                    if p is None:
                        at, cell, home = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
                    else:
                        dot = _unit(_matrix(t["embedding"])) @ p.T
                        near = dot.argmax(axis=1)
                        gap = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[near]  # from the nearest pivot to each
                        over = (dot.max(axis=1, keepdims=True) - dot) <= radius * gap + 1e-9
                        over &= np.arange(len(p)) < near[:, None]
                        over[np.arange(len(near)), near] = True
                        at, cell = np.nonzero(over)
                        home = near[at] == cell
                    t = t.take(pa.array(at))
                    yield pa.record_batch({"label": t["label"], "dim": t["dim"], "cell": pa.array(cell.astype(np.int64)), "home": pa.array(home), "rep": t["rep"], "many": t["many"], "embedding": t["embedding"]})

        kind = classes.schema["label"].dataType.simpleString()
        cells = staged(classes.select("label", "dim", "rep", "many", "embedding").mapInArrow(lean(place), f"label {kind}, dim int, cell long, home boolean, rep long, many long, embedding array<double>"))
        key = ["label", "dim", "cell"]
        sizes = cells.groupBy(*key).agg(F.expr(f"(count_if(home) + {self.block - 1}) div {self.block}").alias("rows"), F.expr(f"(count(*) + {self.block - 1}) div {self.block}").alias("cols")).where("rows > 0")
        dealt = cells.join(sizes, key)
        mod = lambda n: F.expr(f"pmod(xxhash64(rep), {n})")
        # A class at home is a row of the grid and, like the visitors, a column; in a grid of one block it goes once.
        homes = dealt.where("home AND rows * cols > 1").withColumn("i", mod("rows")).withColumn("j", F.explode(F.expr("sequence(0L, cols - 1)"))).withColumn("side", F.lit(0))
        members = dealt.withColumn("j", mod("cols")).withColumn("i", F.explode(F.expr("sequence(0L, rows - 1)"))).withColumn("side", F.expr("IF(rows * cols > 1, 1, 2)"))
        cosine = self.cosine

        def meet(t: pa.Table) -> pa.Table:
            x, rep, many, home, side = _matrix(t["embedding"]), *(t[c].to_numpy() for c in ("rep", "many", "home", "side"))
            norm = np.sqrt((x * x).sum(axis=1))
            if not np.isfinite(norm).all() or not norm.all():
                x = _unit(x)
                norm = np.ones(len(x))
            h, m = np.flatnonzero((side == 0) | ((side == 2) & home)), np.flatnonzero(side != 0)
            away = ~home[m]  # a visitor's links are counted here, those of a class at home in its own row
            links, back, forest = np.zeros(len(h), np.int64), np.zeros(len(m), np.int64), Forest()
            for lo in range(0, len(h), 256):
                a = h[lo : lo + 256]
                near = (x[a] @ x[m].T) / (norm[a][:, None] * norm[m]) >= cosine
                near &= rep[a][:, None] != rep[m]
                links[lo : lo + 256] = near @ many[m]
                back[away] += many[a] @ near[:, away]
                _forest_of(near, rep[a], rep[m], forest)
            u, w = forest.edges()
            some = np.flatnonzero(back)
            told = pa.table({"rep": np.concatenate([rep[h], rep[m[some]]]), "links": np.concatenate([links, back[some]])})
            none = lambda n: pa.nulls(n, pa.int64())
            return pa.concat_tables([
                told.append_column("u", none(len(told))).append_column("v", none(len(told))),
                pa.table({"rep": none(len(u)), "links": none(len(u)), "u": pa.array(u, pa.int64()), "v": pa.array(w, pa.int64())}),
            ])

        met = staged(homes.unionByName(members).groupBy(*key, "i", "j").applyInArrow(lean_group(meet), "rep long, links long, u long, v long"))
        links = met.where("rep IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
        comp = connected_components(met.where("u IS NOT NULL").select("u", "v"))
        found = classes.join(links, "rep", "left").join(comp, classes.rep == comp.node, "left")
        found = found.select("label", "embedding", F.expr("many - 1 + coalesce(links, 0)").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
        linked = good.join(found, ["label", "embedding"]).select("vec_id", "n_links", "component_id", "rows")
        alone = v.where(f"NOT ({usable})").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), "rows")
        out = linked.unionByName(alone).withColumn("kept", F.expr("coalesce(vec_id = component_id, true)"))
        return out.withColumn("rows", F.explode(F.expr("sequence(1L, rows)"))).drop("rows")
