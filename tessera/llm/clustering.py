"""Centroid clustering of integer vectors: exact distances from matrix products, exact means.

Every component becomes floor(scale * x). A block's squared distances are |x|² - 2 x·c + |c|², one BLAS product in
doubles. That is exact as long as all its sums stay below 2**53, which holds where components of vector and centroid
are below :func:`tame_bound`; vectors or centroids with larger components are compared in integers of any size,
and only they: a tame vector meets a large centroid only where that could be nearer. Sums, counts and inertia of the
blocks are combined by ``RDD.treeAggregate``, so the driver gets a few partial results of k x dim integers, however
many vectors there are. Centroids are k x dim integers and travel with the tasks.

Cases: vectors that are null, of another length than ``dim``, or with an entry that is null, NaN, infinite or no
32-bit float are dropped; rows that repeat count as often as they stand there; rows with a null id are clustered as
others and start no cluster as long as there are others; rows that share an id, and so a hash, are ordered by their
vector; with fewer than k vectors each starts a centroid; equally near centroids: the smaller number; an empty
centroid stays; distances and inertia that no long holds are null; an empty table gives no rows; other columns are
left out. Reruns give the same numbers, whatever the partitions.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vector_blocks import EXACT, fits_long, integers, kept, matrix, stored_blocks


def tame_bound(dim: int) -> int:
    """Components below it, of vectors and centroids, keep dim * (|x| + |c|)² and all that is summed below 2**53."""
    return max(1, math.isqrt((EXACT - 1) // max(dim, 1)) // 2)


class Centroids:
    """k integer vectors; those with tame components also as a matrix of doubles."""

    def __init__(self, rows: list[list[int]], dim: int):
        self.rows, self.dim, self.bound = rows, dim, tame_bound(dim)
        peaks = [max(map(abs, r), default=0) for r in rows]
        self.tame = np.array([i for i, p in enumerate(peaks) if p < self.bound], np.int64)
        self.large = [(i, float(p)) for i, p in enumerate(peaks) if p >= self.bound]
        self.matrix = np.array([rows[i] for i in self.tame], np.float64).reshape(len(self.tame), dim)
        self.squares = (self.matrix**2).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance as an integer, whether the vector is tame) of each row."""
        peak = np.abs(x).max(axis=1, initial=0)
        tame = peak < self.bound
        label, distance = np.full(len(x), len(self.rows), np.int64), np.full(len(x), None, object)
        if tame.any() and len(self.tame):
            t = x[tame]
            d = (t * t).sum(axis=1)[:, None] - 2 * (t @ self.matrix.T) + self.squares
            at = d.argmin(axis=1)
            label[tame], distance[tame] = self.tame[at], d[np.arange(len(t)), at].astype(np.int64).astype(object)
        for c, top in self.large:
            near = np.array([d is None or ((top - p) * (1 - 1e-9)) ** 2 <= d for d, p in zip(distance[tame], peak[tame], strict=True)], bool)
            self._compare(x, np.flatnonzero(tame)[near], c, label, distance)
        for c in range(len(self.rows)):
            self._compare(x, np.flatnonzero(~tame), c, label, distance)
        return label, distance, tame

    def _compare(self, x: np.ndarray, at: np.ndarray, c: int, label: np.ndarray, distance: np.ndarray) -> None:
        """Rows ``at`` go to centroid ``c`` where it is nearer, or as near with a smaller number."""
        if not len(at):
            return
        found = ((integers(x[at]) - np.array(self.rows[c], object)) ** 2).sum(axis=1)
        for i, d in zip(at, found, strict=True):
            if distance[i] is None or (d, c) < (distance[i], label[i]):
                label[i], distance[i] = c, d

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in self.rows]


def _totals(blocks: DataFrame, centroids: Centroids, scale: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(sums, counts, inertia) of each centroid's vectors, as integers of any size."""
    k, dim, code = len(centroids.rows), centroids.dim, blocks._code

    def add(total, row):
        x = matrix(row[0], code, dim, scale)
        label, distance, tame = centroids.nearest(x)
        member = (label[tame][None, :] == np.arange(k)[:, None]).astype(np.float64)
        sums = integers(member @ x[tame])  # at most BLOCK tame vectors: below 2**53
        for i in np.flatnonzero(~tame):
            sums[label[i]] += integers(x[i])
        inertia = [0] * k
        for c, d in zip(label, distance, strict=True):
            inertia[c] += d
        return merge(total, (sums, np.bincount(label, minlength=k), inertia))

    def merge(a, b):
        if a is None or b is None:
            return b if a is None else a
        return a[0] + b[0], a[1] + b[1], [x + y for x, y in zip(a[2], b[2], strict=True)]

    found = blocks.select("values").rdd.treeAggregate(None, add, merge)
    return found if found is not None else (np.zeros((k, dim), object), np.zeros(k, np.int64), [0] * k)


def cluster(rows: DataFrame, k: int, rounds: int, scale: int, dim: int, salt: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    The first centroids are the k vectors with the smallest SHA-256 of ``salt:id``. No vector is exchanged: a round
    reads the blocks once where they are and combines k x dim sums.
    """
    vectors = kept(rows, id_col, vector_col).where(F.size("v") == dim)
    blocks = stored_blocks(vectors, dim, "cluster-blocks")
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    first = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    centroids = Centroids([[math.floor(float(x) * scale) for x in r["v"]] for r in first], dim)
    for _ in range(rounds if first else 0):
        sums, counts, _inertia = _totals(blocks, centroids, scale)
        centroids = Centroids([[int(s) // int(n) for s in total] if n else old for total, n, old in zip(sums, counts, centroids.rows, strict=True)], dim)
    spent = _totals(blocks, centroids, scale)[2] if first else []
    inertia, total = [fits_long(x) for x in spent], fits_long(sum(spent))
    digests, code = centroids.digests(), blocks._code

    def assign(batches):
        for batch in batches:
            for ids, values in zip(batch.column(0), batch.column(1), strict=True):
                label, distance, _ = centroids.nearest(matrix(values.as_py(), code, dim, scale))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values, pa.array(label.astype(np.int32)), pa.array([fits_long(d) for d in distance], pa.int64()),
                        pa.array([inertia[c] for c in label], pa.int64()), pa.array([total] * len(label), pa.int64()), pa.array([digests[c] for c in label], pa.string()),
                    ],
                    names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    kind = rows.schema[id_col].dataType.simpleString()
    return blocks.mapInArrow(assign, f"`{id_col}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
