"""Blocks of vectors: a row holds the ids and the floats of up to ``BLOCK`` vectors, as much as NumPy takes at once.

The blocks are written to the shared folder, so that iterations read binary columns instead of making lists of floats
again, and a lost executor's part is read again. Vectors are kept where all their entries are finite 32-bit floats:
no entry at all, nulls, NaN, infinities and numbers beyond that range (in a column of doubles) drop the vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import BATCH_BYTES, batches_of, cut, spread

#: Vectors of one block, at most; blocks of long vectors hold fewer, so that a block has BATCH_BYTES at most.
BLOCK = 2048
#: The largest 32-bit float.
LARGEST = float(np.finfo(np.float32).max)
#: Integers below it are exact in a double, and so are sums that stay below it.
EXACT = 1 << 53


def finite(vector: Column) -> Column:
    """Whether a vector has entries and all are finite; NaN is above every number."""
    inside = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) <= LARGEST, F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & inside, F.lit(False))


def kept(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows whose vector is finite; other columns are left out."""
    small = rows.schema[vector_col].dataType.elementType.simpleString() == "float"
    vector = F.col(vector_col) if small else F.col(vector_col).cast("array<double>")
    return spread(rows.where(finite(F.col(vector_col))).select(F.col(id_col).alias("id"), vector.alias("v")))


def stored_blocks(vectors: DataFrame, dim: int, name: str) -> DataFrame:
    """(ids, values) blocks of ``kept`` vectors that all have ``dim`` entries; values are little-endian floats."""
    most = max(1, min(BLOCK, BATCH_BYTES // (8 * max(dim, 1))))
    kind = vectors.schema["id"].dataType.simpleString()
    small = vectors.schema["v"].dataType.elementType.simpleString() == "float"
    code = "<f4" if small else "<f8"

    def pack(batches):
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(code).reshape(batch.num_rows, dim)
            starts = range(0, batch.num_rows, most)
            ids = [batch.column(0).slice(i, most) for i in starts]
            offsets = np.cumsum([0, *(len(x) for x in ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(offsets, batch.column(0)), pa.array([values[i : i + most].tobytes() for i in starts], pa.binary())], names=["ids", "values"]
            )

    with batches_of(vectors.sparkSession, BATCH_BYTES):
        found = cut(vectors.mapInArrow(pack, f"ids array<{kind}>, values binary"), name)
    found._code = code
    return found


def matrix(values: bytes, code: str, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a block as integers in doubles; a 32-bit float times a scale below 2**29 is exact."""
    return np.floor(np.frombuffer(values, code).reshape(-1, dim).astype(np.float64) * scale)


def integers(floats: np.ndarray) -> np.ndarray:
    """Integers of any size instead of the doubles that hold them."""
    return np.array([int(x) for x in floats.ravel()], object).reshape(floats.shape)


def fits_long(value: int) -> int | None:
    """``value``, or None where no long holds it."""
    return int(value) if -(1 << 63) <= value < 1 << 63 else None
