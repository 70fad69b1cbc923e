"""Approximate nearest neighbours by cosine: cells of a coarse quantiser, several probes a vector.

A scope of more than ``leaf`` vectors is a cell that is split: up to about ``SAMPLE`` of its vectors, drawn by a hash of
the id, give at most ``BRANCHES`` unit centroids (spherical k-means within one task, its group bounded by the draw).
Every vector goes to its nearest centroid's cell, its home, and as a visitor to the next ``probes - 1`` ones. A cell that
is still above ``leaf`` vectors is split again in the same way, so a hot one becomes smaller cells and its visitors go
on to the cells inside that are nearest to them. In the end each vector is compared with the vectors at home in the
cells it visits, block by block as matrix products; the best ``neighbours`` of each product are merged by one window.

Vectors move in blocks of up to ``BLOCK``; a block meets the centroids of its cell by a join of one row a block, so
neither the centroids nor a scope must fit in one task. Scopes of at most ``leaf`` vectors are compared exactly.
Equal vectors of one scope are one row here (:func:`classes`), as copies can't be told apart by any quantiser.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut, drop_cut

#: Vectors of one block; a product is of two blocks.
BLOCK = 1024
#: Vectors of a cell that is not split.
LEAF = 4096
#: Vectors that a cell's centroids are fitted on, about.
SAMPLE = 8192
#: Centroids of one cell, at most.
BRANCHES = 256
#: Times a cell is split again, at most; beyond that its blocks are compared as they are.
DEPTH = 4
#: Steps of the fit.
STEPS = 8


def unit(rows) -> np.ndarray:
    """Unit vectors; a zero vector stays zero and is like nothing."""
    m = np.array(list(rows), np.float64)
    return np.divide(m, n := np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=n > 0)


def fit_centroids(vectors: np.ndarray, k: int) -> np.ndarray:
    """At most k unit centroids; the first are far-apart vectors of the draw, so equal draws give equal cells."""
    chosen, near = [0], vectors @ vectors[0]
    while len(chosen) < k:
        at = int(np.argmin(near))
        if near[at] >= 1 - 1e-9:
            break
        chosen.append(at)
        near = np.maximum(near, vectors @ vectors[at])
    centroids = vectors[chosen]
    for _ in range(STEPS):
        label = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, label, vectors)
        moved = unit(sums)
        centroids = np.where(np.linalg.norm(moved, axis=1, keepdims=True) > 0, moved, centroids)
    return centroids


def classes(vectors: DataFrame, id_col: str, scope_col: str, vector_col: str) -> DataFrame:
    """(rep, members): ``rep`` is the smallest id of equal vectors of a scope; rows of every id, with its ``rep``.

    The vectors of a scope are grouped by value, so copies cost one row a class from here on.
    """
    keys = [F.col(scope_col).alias("scope"), F.col(vector_col).alias("v")]
    reps = vectors.groupBy(*keys).agg(F.min(id_col).alias("rep"))
    rows = vectors.select(F.col(id_col).alias("id"), *keys)
    return rows.join(reps, rows["scope"].eqNullSafe(reps["scope"]) & (rows["v"] == reps["v"])).select("id", "rep", rows["scope"], rows["v"])


def _blocks(state: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """Rows of up to about BLOCK (id, v, home) of one cell."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    dealt = state.join(sizes, list(keys)).withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    return dealt.groupBy(*keys, "part").agg(F.collect_list(F.struct("id", "v", "home")).alias("rows"))


def _split(state: DataFrame, hot: DataFrame, leaf: int, probes: int) -> DataFrame:
    """The rows of the ``hot`` cells (cell, n) in cells within them."""
    kind = state.schema["id"].dataType.simpleString()
    branches = F.least(F.lit(BRANCHES), F.greatest(F.lit(2), F.ceil(F.col("n") / leaf))).cast("int")
    share = F.lit(float(SAMPLE)) / F.col("n")
    draw = F.pmod(F.xxhash64(F.lit("draw"), "id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = state.where("home").join(hot.withColumn("k", branches), "cell").where(draw < share).select("cell", "k", "id", "v")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        vectors = unit(pdf["v"])
        vectors = vectors[np.linalg.norm(vectors, axis=1) > 0]
        found = fit_centroids(vectors, int(pdf["k"].iloc[0])) if len(vectors) else np.zeros((1, len(pdf["v"].iloc[0])))
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "centroids": [found.astype(np.float32).tobytes()]})

    cells = drawn.groupBy("cell").applyInPandas(fit, "cell string, centroids binary")
    # a cell of which the draw took nothing keeps its rows in one cell below
    placed = _blocks(state, hot, "cell").join(cells, "cell", "left")

    def route(batches):
        for pdf in batches:
            for cell, rows, centroids in zip(pdf["cell"], pdf["rows"], pdf["centroids"], strict=True):
                ids, home = [r["id"] for r in rows], np.array([r["home"] for r in rows])
                vectors = unit([r["v"] for r in rows])
                if centroids is None:
                    near = np.zeros((len(rows), 1), np.int64)
                else:
                    c = np.frombuffer(centroids, np.float32).reshape(-1, vectors.shape[1])
                    near = np.argsort(-(vectors @ c.T), axis=1, kind="stable")[:, :probes]
                width = near.shape[1]
                first = np.tile(np.arange(width) == 0, len(rows))
                at = np.repeat(np.arange(len(rows)), width)
                yield pd.DataFrame({"cell": [f"{cell}/{c}" for c in near.ravel()], "id": [ids[i] for i in at], "v": [rows[i]["v"] for i in at], "home": first & home[at]})

    return placed.select("cell", "rows", "centroids").mapInPandas(route, f"cell string, id {kind}, v array<float>, home boolean")


def neighbour_pairs(vectors: DataFrame, threshold: float, neighbours: int = 20, probes: int = 8, leaf: int = LEAF) -> DataFrame:
    """(i, j, similarity), i < j, of pairs of one scope with a cosine of at least ``threshold`` that one finds from the other.

    ``vectors``: id, scope, v, each vector of a scope once. Each vector keeps its best ``neighbours``, among equals
    those of the smallest id.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    state = cut(vectors.select(F.coalesce(F.col("scope").cast("string"), F.lit("")).alias("cell"), "id", F.col("v").cast("array<float>").alias("v"), F.lit(True).alias("home")), "cells")
    for _ in range(DEPTH):
        sizes = cut(state.where("home").groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell-sizes", few=True)
        hot = sizes.where(F.col("n") > leaf)
        if hot.limit(1).count() == 0:
            break
        before, state = state, cut(state.join(hot.select("cell"), "cell", "left_anti").unionByName(_split(state, hot, leaf, probes)), "cells")
        drop_cut(before, sizes)
    at_home = state.where("home")
    homes = _blocks(at_home, at_home.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell").select("cell", F.col("rows").alias("b"))
    guests = _blocks(state, state.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell").select("cell", F.col("rows").alias("a"))

    def multiply(batches):
        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                ids_a, ids_b = [r["id"] for r in a], [r["id"] for r in b]
                order = sorted(range(len(ids_b)), key=ids_b.__getitem__)
                b, ids_b = [b[i] for i in order], [ids_b[i] for i in order]
                sim = unit(r["v"] for r in a) @ unit(r["v"] for r in b).T
                place = {x: i for i, x in enumerate(ids_b)}
                for r, x in enumerate(ids_a):
                    if x in place:
                        sim[r, place[x]] = -np.inf
                best = np.argsort(-sim, axis=1, kind="stable")[:, :neighbours]
                r, c = np.nonzero(np.take_along_axis(sim, best, 1) >= threshold)
                if len(r):
                    yield pd.DataFrame({"i": [ids_a[x] for x in r], "j": [ids_b[best[x, y]] for x, y in zip(r, c, strict=True)], "similarity": sim[r, best[r, c]]})

    found = guests.join(homes, "cell").select("a", "b").mapInPandas(multiply, f"i {kind}, j {kind}, similarity double")
    order = Window.partitionBy("i").orderBy(F.desc("similarity"), "j")
    # a vector meets another in one cell only, that where the other is at home
    top = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= neighbours)
    pairs = cut(top.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("similarity").alias("similarity")), "neighbour-pairs")
    drop_cut(state)
    return pairs
