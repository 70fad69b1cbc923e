"""Embedding whitening from an exact integer scatter matrix.

Every entry c becomes the integer x = floor(scale * c) + offset. A shift, the offset itself unless another is given, is
subtracted before anything is multiplied: it moves no deviation and keeps the products small. Blocks give their sums and cross-products, by a matrix product in doubles where
all its sums stay below 2**53 and by integers of any size otherwise, and ``RDD.treeAggregate`` adds them without
bounds; the driver forms n XᵀX - SSᵀ exactly and only then divides by n² into doubles for ``eigh``. So neither the
order of the rows nor their number costs a digit before the decomposition, and reruns give the same axes. A second
pass measures how far the covariance of the whitened values is from the identity; the last one gives them.

Cases: vectors that are null or empty, or with an entry that is null, NaN, infinite or no 32-bit float are dropped; vectors
must have one length, so those of another length than most (among equals the larger) are dropped too; rows that
repeat count as often as they stand there, also with a null id; directions in which the vectors don't vary (all of
them for a single vector) have no whitened value and no row, so there may be fewer components than asked for; equal
eigenvalues give any axes of their space; a deviation that no long holds is null and stands in ``deviation_digits``
(else null); an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vector_blocks import EXACT, fits_long, integers, kept, matrix, stored_blocks


class Shifted:
    """x - shift of a block's entries, x = floor(scale * c) + offset, as integers in doubles."""

    def __init__(self, code: str, dim: int, scale: int, apart: int):
        self.code, self.dim, self.scale, self.apart = code, dim, scale, apart

    def __call__(self, values: bytes) -> np.ndarray:
        return matrix(values, self.code, self.dim, self.scale) + self.apart


def _scatter(blocks: DataFrame, dim: int, shifted: Shifted) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, cross-products) of the shifted vectors, as integers of any size."""

    def add(total, row):
        y = shifted(row[0])
        peak = int(np.abs(y).max(initial=0))
        if len(y) * peak * peak < EXACT:
            sums, cross = integers(y.sum(axis=0)), integers(y.T @ y)
        else:
            whole = integers(y)
            sums, cross = whole.sum(axis=0), whole.T @ whole
        return merge(total, (len(y), sums, cross))

    def merge(a, b):
        if a is None or b is None:
            return b if a is None else a
        return a[0] + b[0], a[1] + b[1], a[2] + b[2]

    found = blocks.select("values").rdd.treeAggregate(None, add, merge)
    return found if found is not None else (0, np.zeros(dim, object), np.zeros((dim, dim), object))


class Axes:
    """The leading components of a scatter: unit vectors, eigenvalues and their shares of the trace."""

    def __init__(self, n: int, sums: np.ndarray, cross: np.ndarray, most: int):
        self.n, self.sums = n, [int(s) for s in sums]
        dim = len(self.sums)
        exact = n * cross - np.outer(sums, sums)
        covariance = np.array([int(m) / (n * n) for m in exact.ravel()], np.float64).reshape(dim, dim)
        trace = sum(int(exact[i, i]) for i in range(dim)) / (n * n)
        values, vectors = np.linalg.eigh(covariance) if dim else (np.zeros(0), np.zeros((0, 0)))
        falling = np.argsort(-values, kind="stable")[:most]
        falling = falling[values[falling] > max(values.max(initial=0), 0) * max(dim, 1) * np.finfo(np.float64).eps]
        self.values, self.vectors = values[falling], vectors[:, falling]
        # the sign is free: the largest entry of each component is positive
        if dim:
            self.vectors = self.vectors * np.sign(self.vectors[np.abs(self.vectors).argmax(axis=0), np.arange(len(falling))])
        self.explained = self.values / trace if trace else self.values

    def deviations(self, y: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(x - S/n as doubles, sum of (n x - S)² exactly) of each row."""
        top = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums), default=0)
        if top < EXACT and y.shape[1] * top * top < 1 << 63:
            off = self.n * y - np.array(self.sums, np.float64)
            return off / self.n, [int(d) for d in (off.astype(np.int64) ** 2).sum(axis=1)]
        off = self.n * integers(y) - np.array(self.sums, object)
        return np.array([int(o) / self.n for o in off.ravel()], np.float64).reshape(off.shape), [int(d) for d in (off**2).sum(axis=1)]

    def whiten(self, off: np.ndarray) -> np.ndarray:
        return off @ self.vectors / np.sqrt(self.values)


def _identity_error(blocks: DataFrame, axes: Axes, shifted: Shifted) -> float:
    """Largest entry of covariance - identity of the whitened values; blocks are centred before they are multiplied."""

    def add(total, row):
        z = axes.whiten(axes.deviations(shifted(row[0]))[0])
        mean = z.mean(axis=0)
        return merge(total, (len(z), mean, (z - mean).T @ (z - mean)))

    def merge(a, b):
        if a is None or b is None:
            return b if a is None else a
        n, apart = a[0] + b[0], b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)

    n, _, scatter = blocks.select("values").rdd.treeAggregate(None, add, merge)
    return float(np.abs(scatter / n - np.eye(len(axes.values))).max(initial=0))


def whiten(rows: DataFrame, scale: int, offset: int, components: int, shift: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, deviation_digits), a row for each component.

    The fit is over all kept vectors. No vector is exchanged; the driver gets a few partial results of dim² integers.
    """
    vectors = kept(rows, id_col, vector_col)
    sizes = vectors.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes is not None else 0
    blocks = stored_blocks(vectors.where(F.size("v") == dim), dim, "whitening-blocks")
    shifted = Shifted(blocks._code, dim, scale, 0 if shift is None else offset - shift)
    n, sums, cross = _scatter(blocks, dim, shifted)
    axes = Axes(max(n, 1), sums, cross, components)
    error = _identity_error(blocks, axes, shifted) if len(axes.values) else 0.0
    k = len(axes.values)

    def give(batches):
        for batch in batches:
            for ids, values in zip(batch.column(0), batch.column(1), strict=True):
                off, deviation = axes.deviations(shifted(values.as_py()))
                m, at = len(off), np.repeat(np.arange(len(off)), k)
                long = pa.array([fits_long(d) for d in deviation], pa.int64())
                digits = pa.array([None if fits_long(d) is not None else str(d) for d in deviation], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                        long.take(pa.array(at)), pa.array(axes.whiten(off).ravel()), pa.array(np.tile(axes.explained, m)), pa.array(np.full(m * k, error)), digits.take(pa.array(at)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"],
                )

    kind = rows.schema[id_col].dataType.simpleString()
    return blocks.mapInArrow(give, f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_digits string")
