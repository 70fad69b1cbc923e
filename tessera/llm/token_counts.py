"""Token counts by heap-and-linked-list byte-pair merging.

The count of a text is its number of initial symbols minus the merges made; no identifiers are emitted. The
vocabulary is a sentencepiece BPE model: symbols are code points of the text after blanks become ``▁`` and one
``▁`` is put in front; the adjacent pair whose joined piece has the best score (the lowest rank) is merged
first, the leftmost of equals; a symbol left outside the vocabulary counts as its UTF-8 bytes.

No piece of such a vocabulary holds ``▁`` after another character, so no merge crosses the start of a run of
``▁``: the text falls apart there into segments whose counts add up, and the count of a segment is remembered.
A model that breaks this rule, or has user-defined or unused pieces, byte fallback off or a normaliser of its
own, is refused rather than counted wrongly.

Cases: null text counts as empty; empty text has 0 tokens; a text of any length is counted whole; repeated rows
give repeated results; an empty table gives an empty result; other columns are left out of the result.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Segments remembered by each Python worker (about 150 MB at most); the memory is emptied beyond that.
MEMO_SEGMENTS = 600_000
#: Longer segments are counted but not remembered.
MEMO_LENGTH = 48


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            yield key >> 3, data[at : at + size]
            at += size


NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def load_scores(model: bytes) -> dict[str, float]:
    """Piece -> score of the pieces that merging can make; ValueError for models outside the supported kind."""
    scores: dict[str, float] = {}
    n_bytes, settings = 0, {}
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            kind = piece.get(3, NORMAL)
            if kind in (USER_DEFINED, UNUSED):
                raise ValueError("models with user-defined or unused pieces are not supported")
            n_bytes += kind == BYTE
            if kind == NORMAL:
                scores[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
        elif number == 3:
            settings = dict(_fields(value))
    # normaliser: no character map, a blank in front, blanks kept and escaped
    if n_bytes != 256 or settings.get(2) or not settings.get(3, 1) or settings.get(4, 1) or not settings.get(5, 1):
        raise ValueError("only byte-fallback models with the identity normaliser are supported")
    if any(BLANK in piece.lstrip(BLANK) for piece in scores):
        raise ValueError("a piece crosses a word boundary")
    return scores


def merged_count(segment: str, scores: dict[str, float]) -> int:
    """Tokens of one segment: a heap of candidate pairs over a doubly linked list of symbols."""
    symbols = list(segment)
    n = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    score = scores.get
    heap = [(-s, i, len(pair)) for i in range(n - 1) if (s := score(pair := symbols[i] + symbols[i + 1])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, size = heapq.heappop(heap)
        left, j = symbols[i], after[i]
        if not left or j >= n or len(left) + len(symbols[j]) != size:
            continue  # one of the two has been merged meanwhile
        joined = left + symbols[j]
        symbols[i], symbols[j] = joined, ""
        k = after[i] = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (s := score(pair := joined + symbols[k])) is not None:
                heapq.heappush(heap, (-s, i, len(pair)))
        if (h := before[i]) >= 0 and (s := score(pair := symbols[h] + joined)) is not None:
            heapq.heappush(heap, (-s, h, len(pair)))
    count = n - merges
    for symbol in symbols:
        if len(symbol) == 1 and symbol not in scores:
            count += len(symbol.encode("utf-8", "surrogatepass")) - 1
    return count


class _Memo(dict):
    """Count of ``▁`` + key, made on first use."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, word: str) -> int:
        count = merged_count(BLANK + word, self.scores)
        if len(word) <= MEMO_LENGTH:
            self[word] = count
        return count


class PieceCounter:
    """Counts the tokens of whole texts under one model."""

    def __init__(self, model: bytes):
        self.scores = load_scores(model)
        self.memo = _Memo(self.scores)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if BLANK in text:
            text = text.replace(BLANK, " ")
        words = text.split(" ")
        memo = self.memo
        if len(memo) > MEMO_SEGMENTS:
            memo.clear()
        if "" not in words:
            return sum(map(memo.__getitem__, words))
        total = blanks = 0
        for word in words:
            if not word:
                blanks += 1
            elif blanks:
                total += merged_count(BLANK * (blanks + 1) + word, self.scores)
                blanks = 0
            else:
                total += memo[word]
        return total + (merged_count(BLANK * blanks, self.scores) if blanks else 0)


_COUNTERS: dict[bytes, PieceCounter] = {}


def _counter(model: bytes) -> PieceCounter:
    """One counter a worker process, kept between tasks."""
    if model not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[model] = PieceCounter(model)
    return _COUNTERS[model]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes (UTF-8 length) and n_tokens of every row of ``docs``; a narrow map, no shuffle.

    ``model_path`` is read on the driver and its bytes (a few hundred kB, a property of the model) go out as a
    broadcast variable, so executors need no copy of the file.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    load_scores(model)  # refuse an unsupported model before the job starts
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            text = batch.column(1)
            n_bytes = pc.fill_null(pc.cast(pc.binary_length(text), pa.int64()), 0)
            n_tokens = pa.array((counter.count(x.as_py()) for x in text), pa.int64(), size=len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
