"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised: lower case, runs of characters other than letters and digits are one blank,
one blank at each end. An item of n characters may be found with up to ``rate * n`` edits (rounded down). It is
split into one piece more than that; of any text within the budget, at least one piece is there unchanged, so exact
piece hits (one automaton for all pieces) find every place worth looking at. There Myers' bit-parallel algorithm
gives the least edit distance, first of small runs of pieces and at last of the whole item: a run of p pieces
within p - 1 edits has a half for which the same holds, so some unchanged piece lies in such runs all the way up, and
a hit whose run fails is dropped early without loss. The first of these tests needs no distance: where a piece is
unchanged, the pieces beside it in its smallest run have the run's edits, so one of as many parts and one more is
unchanged too, moved by no more than the edits.

Items come to the driver in blocks of at most ``BLOCK_CHARS`` characters of text; each block is one broadcast and
one pass over the documents, whatever the size of the benchmark. Documents are never exchanged.

Cases: null and empty documents match nothing; null and empty items, and items without letters or digits, are no
items; an item shorter than 1/rate must be found exactly, as whole words; equal items are each reported; rows that
repeat an id are each matched; texts of any length are scanned whole; empty tables on either side work; extra columns
pass through ``decontaminated`` and are left out of ``matches``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.session import small_batches

#: Edits a character of an item. README has the share of changed items that are found at this and other rates.
RATE = 0.12
#: Characters of items in one block.
BLOCK_CHARS = 4_000_000

_NOT_WORD = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    """A blank, the words, a blank; or nothing for a text without words."""
    words = _NOT_WORD.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``budget + 1`` pieces of nearly equal length that make up the item."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def letters(pattern: str) -> dict[str, int]:
    """The places of each character of a pattern, as bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    return where


def myers(where: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the stretch of ``text`` nearest to a pattern of length ``m``, the first of equals.

    None beyond ``most``. One column of the dynamic-programming matrix is two integers of one bit a character.
    """
    mask, last = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = mask, 0, m
    best, end = (m, 0) if m <= most else (most + 1, -1)
    get = where.get
    for at, c in enumerate(text, 1):
        equal = get(c, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        rise = down | (~(across | up) & mask)
        fall = up & across
        if rise & last:
            distance += 1
        elif fall & last:
            distance -= 1
        rise, fall = (rise << 1) & mask, (fall << 1) & mask
        up, down = fall | (~(vertical | rise) & mask), rise & vertical
        if distance < best:
            best, end = distance, at
            if not best:
                break
    return (best, end) if best <= most else None


def runs(leaf: int, n: int) -> list[tuple[int, int]]:
    """Runs of pieces around piece ``leaf``, each twice as long as the one before, up to all ``n``."""
    begin, end, found = 0, n, []
    while end - begin > 1:
        found.append((begin, end))
        middle = (begin + end) // 2
        begin, end = (begin, middle) if leaf < middle else (middle, end)
    return found[::-1]


class Matcher:
    """One block of items and the automaton of their pieces."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items = [(item_id, form, int(rate * len(form))) for item_id, text in items if (form := normalised(text))]
        self.cuts = [[len(form) * i // (budget + 1) for i in range(budget + 2)] for _, form, budget in self.items]
        self.letters: dict[tuple[int, int, int], dict[str, int]] = {}
        self.around: dict[tuple[int, int], tuple[int, list[tuple[int, str]]]] = {}
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, form, budget) in enumerate(self.items):
            for leaf, (_, piece) in enumerate(pieces(form, budget)):
                found[piece].append((k, leaf))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), tuple(uses)))
        if found:
            self.automaton.make_automaton()

    def _where(self, k: int, a: int, b: int) -> dict[str, int]:
        if (k, a, b) not in self.letters:
            self.letters[k, a, b] = letters(self.items[k][1][a:b])
        return self.letters[k, a, b]

    def _near(self, k: int, leaf: int) -> tuple[int, list[tuple[int, str]]]:
        """(edits, parts) of the pieces beside ``leaf`` in its smallest run, split into one part more than their edits."""
        if (k, leaf) not in self.around:
            cuts, item = self.cuts[k], self.items[k][1]
            first, behind = runs(leaf, len(cuts) - 1)[0]
            a, b = (cuts[leaf + 1], cuts[behind]) if leaf == first else (cuts[first], cuts[leaf])
            edits = behind - first - 1
            places = [a + (b - a) * i // (edits + 1) for i in range(edits + 2)]
            self.around[k, leaf] = edits, [(x, item[x:y]) for x, y in zip(places, places[1:], strict=False)] if first in (leaf, leaf - (behind - first - 1)) else []
        return self.around[k, leaf]

    def _climb(self, k: int, leaf: int, start: int, form: str, most: int) -> tuple[int, int] | None:
        """(distance, end) of item ``k`` near ``start``, if all runs of pieces around ``leaf`` are within their edits."""
        cuts = self.cuts[k]
        # the neighbours of an unchanged piece are within their edits: one of their parts is there, moved by no more
        edits, parts = self._near(k, leaf)
        if parts and not any(form.find(part, max(0, start + at - edits), max(0, start + at + len(part) + edits)) >= 0 for at, part in parts):
            return None
        for first, behind in runs(leaf, len(cuts) - 1):
            a, b, budget = cuts[first], cuts[behind], behind - first - 1
            whole = behind - first == len(cuts) - 1
            begin = max(0, start + a - budget)
            hit = myers(self._where(k, a, b), b - a, form[begin : start + b + budget], min(budget, most) if whole else budget)
            if hit is None:
                return None
        return hit[0], begin + hit[1]

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item's place, distance, end in the normalised text) of every item found in ``text``."""
        form = normalised(text)
        if not form or not self.items:
            return []
        best: dict[int, tuple[int, int]] = {}
        for end, (length, uses) in self.automaton.iter(form):
            for k, leaf in uses:
                now = best.get(k)
                if now and not now[0]:
                    continue
                _, item, budget = self.items[k]
                start = end - length + 1 - self.cuts[k][leaf]
                if form.startswith(item, max(0, start)) and start >= 0:
                    best[k] = (0, start + len(item))
                elif budget and (hit := self._climb(k, leaf, start, form, now[0] - 1 if now else budget)):
                    best[k] = hit
        return [(k, *hit) for k, hit in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks; one partition at a time is on the driver."""
    held, size = [], 0
    for item, text in benchmark.select(item_col, F.col(text_col).cast("string")).orderBy(item_col).toLocalIterator():
        held.append((item, text or ""))
        size += len(text or "")
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _matcher(spark, items: list[tuple[object, str]], rate: float):
    """A broadcast of the items; each worker builds the automaton once a task."""
    shared = spark.sparkContext.broadcast(items)
    return lambda: Matcher(shared.value, rate)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(``id_col``, ``item_col``, distance, match_end): one row for each item found in a row of ``docs``."""
    small_batches(docs.sparkSession)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, item {item_kind}, distance int, match_end bigint"
    out = None
    for items in _blocks(benchmark, item_col, item_text_col):
        make = _matcher(docs.sparkSession, items, rate)

        def look(batches: Iterator[pa.RecordBatch], make=make) -> Iterator[pa.RecordBatch]:
            matcher = make()
            ids = [i for i, _, _ in matcher.items]
            for batch in batches:
                found = [(r, ids[k], d, e) for r, text in enumerate(batch.column(1)) for k, d, e in matcher.find(text.as_py())]
                if found:
                    row, item, distance, end = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item, item_type), pa.array(distance, pa.int32()), pa.array(end, pa.int64())], names=["id", "item", "distance", "match_end"])

        part = rows.mapInArrow(look, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def _clean(make):
    """A function of a text column: no item is found. Only texts go to the Python workers and only marks come back."""

    @F.arrow_udf("boolean")
    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = make()
        for texts in parts:
            yield pa.array([not matcher.find(x.as_py()) for x in texts], pa.bool_())

    return clean


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns; a narrow filter for each block."""
    small_batches(docs.sparkSession)
    for items in _blocks(benchmark, item_col, item_text_col):
        docs = docs.where(_clean(_matcher(docs.sparkSession, items, rate))(F.col(text_col).cast("string")))
    return docs
