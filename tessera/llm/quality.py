"""Quality scores by nearest-neighbour voting in a latent semantic space.

Terms of a text are its hashed words, the shapes of its words (runs of lower-case and upper-case letters and of
digits stand for one character; marks are kept) and bins of how often words repeat. Terms are weighted (log counts
and inverse document frequency for words), and a truncated singular value decomposition of the labelled sample gives
the latent axes. Every text is projected, its exact cosines with all labelled vectors are taken as blocks of a
matrix product, and the ``NEIGHBOURS`` nearest vote with their label, weighted by similarity and by class.

Labels are learnt from at most ``SAMPLE`` rows of each class, those of smallest hash of id and text: that bounds what
the driver gathers (sparse term vectors, not texts) and what is broadcast (2 * SAMPLE * AXES floats, 1 MB). Scores are
made for every row from its text alone.

Cases: null and empty texts, and texts like no labelled one, score the share of label 1 among the labels; repeated rows
score alike; of labelled texts that are equally near the first in the model's own order counts; labels of null or for
unknown documents are ignored; an id with several texts or labels contributes each;
without any label all scores are 0.5; empty tables give empty results; columns other than the two named pass through
``keep_good`` and are left out of ``scores``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, small_batches

#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE = 2000
AXES, NEIGHBOURS = 64, 25
WORD_TERMS, SHAPE_TERMS, BINS = 3072, 1024, 12
TERMS = WORD_TERMS + SHAPE_TERMS + 3 * BINS
#: Weights of the three kinds of terms in a vector.
KIND_WEIGHT = (0.5, 1.0, 1.0)
#: Texts that are handled together.
BLOCK_ROWS, BLOCK_BYTES = 250, 2 << 20
#: Votes are similarities to this power.
SHARPNESS = 8.0
THRESHOLD = 0.7


def _hashed(strings: pa.Array, terms: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(s) % terms for s in strings.to_pylist()), np.int64, len(strings))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def terms(texts: pa.Array) -> np.ndarray:
    """Raw term counts: words, shapes, and one bin each for repeats in a row, distinct words and distinct lines."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    out = np.zeros((n, TERMS), np.float32)
    lists = pc.ascii_split_whitespace(texts)
    at = np.asarray(lists.offsets).astype(np.int64)
    at -= at[0]
    flat = lists.flatten()
    row = np.repeat(np.arange(n), np.diff(at))
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    distinct = flat.dictionary_encode()
    code, row = np.asarray(distinct.indices).astype(np.int64)[full], row[full]
    if not len(code):
        return out
    words = distinct.dictionary
    word = _hashed(pc.utf8_lower(words), WORD_TERMS)
    shape = pc.replace_substring_regex(words, "\\p{Ll}+", "a")
    shape = pc.replace_substring_regex(shape, "\\p{Lu}+", "A")
    shape = pc.replace_substring_regex(shape, "[0-9]+", "0").dictionary_encode()
    shape = _hashed(shape.dictionary, SHAPE_TERMS)[np.asarray(shape.indices)]
    size = np.bincount(row, minlength=n)
    flat_size = n * TERMS
    out += np.bincount(row * TERMS + word[code], minlength=flat_size).reshape(n, TERMS).astype(np.float32)
    out += np.bincount(row * TERMS + WORD_TERMS + shape[code], minlength=flat_size).reshape(n, TERMS).astype(np.float32)
    same = np.bincount(row[1:][(code[1:] == code[:-1]) & (row[1:] == row[:-1])], minlength=n)
    kinds = np.bincount(np.unique(row * len(words) + code) // len(words), minlength=n)
    lines = pc.split_pattern(texts, "\n")
    n_lines = np.diff(np.asarray(lines.offsets))
    line = np.asarray(lines.flatten().dictionary_encode().indices).astype(np.int64)
    line_row = np.repeat(np.arange(n), n_lines)
    line_kinds = np.bincount(np.unique(line_row * (line.max() + 1) + line) // (line.max() + 1), minlength=n)
    some = np.maximum(size, 1)
    # distinct words fall with length: compared with the square root of the length
    ratios = (same / some, np.minimum(1, kinds / np.sqrt(some) / 16), line_kinds / np.maximum(n_lines, 1))
    for k, ratio in enumerate(ratios):
        bins = np.minimum(BINS - 1, (ratio * (BINS - 1)).astype(np.int64))
        out[np.flatnonzero(size), WORD_TERMS + SHAPE_TERMS + k * BINS + bins[size > 0]] = 1
    return out


def _weighted(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    a, b = WORD_TERMS, WORD_TERMS + SHAPE_TERMS
    parts = (np.log1p(raw[:, :a]) * idf, np.sqrt(raw[:, a:b]), raw[:, b:])
    return np.concatenate([w * _unit(p) for w, p in zip(KIND_WEIGHT, parts, strict=True)], axis=1)


def nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` largest values of each row; of equal ones at the border the first."""
    far = -cosines
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    border = np.take_along_axis(far, near, axis=1).max(axis=1, keepdims=True)
    for row in np.flatnonzero((far <= border).sum(axis=1) > k):
        near[row] = np.argsort(far[row], kind="stable")[:k]
    return near


class Model:
    """Axes, labelled vectors and votes; everything in it has a fixed largest size."""

    def __init__(self, raw: np.ndarray, labels: np.ndarray, share: float):
        df = (raw[:, :WORD_TERMS] > 0).sum(axis=0)
        self.idf = np.log((1 + len(raw)) / (1 + df)).astype(np.float32) + 1
        x = _weighted(raw, self.idf)
        # leading right singular vectors by subspace iteration: nothing larger than the sample itself is held
        basis = np.random.default_rng(0).standard_normal((x.shape[1], min(AXES + 16, *x.shape))).astype(np.float32)
        for _ in range(6):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        _, values, turn = np.linalg.svd(x @ basis, full_matrices=False)
        self.axes = (basis @ turn[: min(AXES, int((values > 1e-5).sum()))].T).astype(np.float32)
        self.points = _unit(x @ self.axes).astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.share = float(share)
        # classes are sampled alike: their votes count by their real shares
        real = np.where(labels == 1, share, 1 - share)
        seen = np.where(labels == 1, labels.mean(), 1 - labels.mean())
        self.votes = (real / np.maximum(seen, 1e-9)).astype(np.float32)

    def scores(self, texts: pa.Array) -> np.ndarray:
        raw = terms(texts)
        mine = _unit(_weighted(raw, self.idf) @ self.axes)
        cosines = mine @ self.points.T
        near = nearest(cosines, min(NEIGHBOURS, cosines.shape[1]))
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0) ** SHARPNESS * self.votes[near]
        total = weight.sum(axis=1)
        score = np.divide((weight * self.labels[near]).sum(axis=1), total, out=np.full(len(raw), self.share, np.float32), where=total > 1e-12)
        return np.clip(score.astype(np.float64), 0, 1)


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most BLOCK_ROWS rows and about BLOCK_BYTES of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        upto = (size[begin - 1] if begin else 0) + BLOCK_BYTES
        end = min(begin + BLOCK_ROWS, max(begin + 1, int(np.searchsorted(size, upto, side="right"))))
        yield batch.slice(begin, end - begin)
        begin = end


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """A model of the labelled rows among ``docs``; None where there is no label at all.

    The labels meet the ids first; texts are read again for the sample only.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # labels of documents that are not there go first; ids and labels are all that this exchange carries
    met = cut(known.join(rows.select("id"), "id", "left_semi"), "labels", few=True)
    counts = {r.label: r.n for r in met.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = [met.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for label in (0, 1)]
    chosen = first[0].unionByName(first[1])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch, 1):
                raw = terms(part.column(1))
                where = [np.flatnonzero(r).astype("<u2") for r in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([w.tobytes() for w in where], pa.binary()), pa.array([r[w].astype("<f4").tobytes() for r, w in zip(raw, where, strict=True)], pa.binary())], names=["label", "at", "value"])

    # an id may have many rows: the hash order goes on through the texts
    texts = rows.join(chosen, "id").orderBy(F.xxhash64("id", "text"), "label").limit(2 * SAMPLE).select("label", "text")
    found = texts.mapInArrow(vectors, "label int, at binary, value binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["label"], bytes(r["at"]), bytes(r["value"])))  # the model doesn't depend on their order
    raw = np.zeros((len(found), TERMS), np.float32)
    for i, r in enumerate(found):
        raw[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], "<f4")
    y = np.array([r["label"] for r in found])
    return Model(raw, y, counts.get(1, 0) / sum(counts.values()))


def scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score of every row; a narrow map."""
    if model is None:
        return docs.select(id_col, F.lit(0.5).alias("score"))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(part.column(1)), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns; all rows without a model."""
    if model is None:
        return docs
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # only texts go to the Python workers and only scores come back
    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            batch = pa.RecordBatch.from_arrays([texts.cast(pa.string())], names=["text"])
            yield pa.array(np.concatenate([np.zeros(0), *(shared.value.scores(part.column(0)) for part in _blocks(batch, 0))]), pa.float64())

    return docs.where(score(F.col(text_col).cast("string")) >= threshold)


def training_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels a model may be fitted on: crc32 of the id as text, modulo 4, is not 2."""
    return labels.where(~held_out(id_col))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
