"""URL filters: an exact Bloom filter cascade over the keys that a corpus holds.

A rule is a host, a path and a verdict; it fits a url whose host is the rule's or a subdomain of it and whose path
starts with the rule's, and the longest rule wins (of equally long ones that with the longer host). So a url has one
candidate key for each shape of a rule (number of host labels, length of path): that many labels of its host and
so many characters of its path. The keys of all urls are the universe.

Level 1 of a cascade is a Bloom filter of the listed keys; level 2 holds the keys of the universe that level 1 lets
through by mistake, level 3 the listed keys that level 2 lets through, and so on until a level makes no mistake. A
key's first level that doesn't hold it tells on which side it stands: for all keys of the universe and of the list
the answer is exact. Level 1 is sized by the list and the estimated number of keys (a rate of listed / keys / sqrt 2,
the others 1/2), so a cascade has a few bytes a listed key. A first cascade tells listed keys from the others, a
second one blocked keys from allowed ones among the listed.

Texts of keys never leave the JVM: their SHA-256 digests go to NumPy, levels take their positions from them. Filters
are put together from words combined before the exchange (``bit_or``) and broadcast while they stay below
``MAX_BYTES``; a list beyond that is met by a hash join of the candidate keys, pre-aggregated by url, with the same
result. A hot host costs its rows' probes and nothing else: urls are not exchanged.

Cases: a null url and one without ``://`` have an empty host and path and meet no rule; hosts keep ports and user
names, as they stand between ``://`` and the first of ``/?#``; only A-Z are lower-cased, in urls and rules; urls
without a rule get the verdict of what isn't listed, ``allow``; rows that repeat are judged each; a rule listed with both verdicts blocks; rules
with a null verdict or host, or another verdict, are refused; empty tables give empty results; an empty list allows all;
columns other than the two named are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import BATCH_BYTES, batches_of, cut, drop_cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
#: Bytes of all levels of a cascade that are broadcast; larger lists are joined.
MAX_BYTES = 32 << 20
#: Levels of a cascade; each holds about half of the level before the last, so 1e12 keys need some 40.
MAX_LEVELS = 100


def lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url, both empty where there is no ``://``."""
    mark = F.locate("://", url)
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return lower(host), path


def _labels(host: Column) -> Column:
    """Number of labels of a host: dots and one."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def rule_keys(rules: DataFrame) -> DataFrame:
    """(key, labels, size, block) of each distinct rule; ``rules``: host, path, verdict."""
    rows = rules.select(lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    wrong = rows.where("host IS NULL OR verdict IS NULL").limit(1).count() or rows.where(~F.col("verdict").isin(ALLOW, BLOCK)).limit(1).count()
    if wrong:
        raise ValueError("a rule needs a host and a verdict, allow or block")
    keyed = rows.select(F.concat("host", "path").alias("key"), _labels(F.col("host")).alias("labels"), F.length("path").alias("size"), (F.col("verdict") == BLOCK).alias("block"))
    return keyed.groupBy("key", "labels", "size").agg(F.bool_or("block").alias("block"))


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of a url that a rule of one of ``shapes`` could have, the longest first."""
    forms = F.array(*(F.struct(F.lit(n).alias("labels"), F.lit(size).alias("size")) for n, size in shapes)) if shapes else F.array().cast("array<struct<labels:int,size:int>>")
    there = F.filter(forms, lambda s: (s["labels"] <= _labels(host)) & (s["size"] <= F.length(path)) & (F.length(host) > 0))

    def key(s):
        end = F.call_function("substring_index", host, F.lit("."), -s["labels"])
        return F.struct((-F.length(end) - s["size"]).alias("order"), (-F.length(end)).alias("then"), F.concat(end, F.substring(path, F.lit(1), s["size"])).alias("key"))

    return F.transform(F.array_sort(F.transform(there, key)), lambda s: s["key"])


def digest(key: Column) -> Column:
    """Hexadecimal SHA-256 of a key."""
    return F.sha2(key.cast("binary"), 256)


class Level:
    """One Bloom filter: ``n`` keys at a rate ``p`` of false positives."""

    def __init__(self, number: int, n: int, p: float):
        self.number = number
        self.size = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2 / 64) * 64)
        self.hashes = max(1, round(self.size / max(n, 1) * math.log(2)))
        self.words: np.ndarray | None = None

    def positions(self, digests: np.ndarray) -> np.ndarray:
        """(keys, hashes) places; each level steps through them by hashes of its own."""
        with np.errstate(over="ignore"):
            start = digests[:, 0] + np.uint64(self.number) * digests[:, 2]
            step = (digests[:, 1] + np.uint64(self.number) * digests[:, 3]) | np.uint64(1)
            return (start[:, None] + np.arange(self.hashes, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(self.size)

    def holds(self, digests: np.ndarray) -> np.ndarray:
        at = self.positions(digests)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def _digests(binaries: pa.Array) -> np.ndarray:
    """(keys, 4) words of digests that lie one behind the other in a column of binaries."""
    binaries = binaries.cast(pa.large_binary())
    offsets = np.frombuffer(binaries.buffers()[1], np.int64)[binaries.offset : binaries.offset + len(binaries) + 1]
    raw = binaries.buffers()[2]
    return np.frombuffer(raw if raw is not None else b"", np.uint8)[offsets[0] : offsets[-1]].copy().view("<u8").reshape(-1, 4)


class Cascade:
    """Levels that alternate between listed keys and false positives; level numbers start at 1."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, digests: np.ndarray) -> np.ndarray:
        """Whether each key of the universe or of the list is listed."""
        answer = np.full(len(digests), len(self.levels) % 2 == 1)
        open_ = np.arange(len(digests))
        for level in self.levels:
            inside = level.holds(digests[open_])
            answer[open_[~inside]] = level.number % 2 == 0
            open_ = open_[inside]
        return answer


def _passing(marks: DataFrame, level: Level) -> DataFrame:
    """The digests (column ``mark``) that a level lets through."""
    held = marks.sparkSession.sparkContext.broadcast(level)

    def test(batches):
        for batch in batches:
            yield batch.filter(pa.array(held.value.holds(_digests(batch.column(0)))))

    return marks.mapInArrow(test, "mark binary")


def _fill(level: Level, marks: DataFrame) -> None:
    """Set the bits of all ``marks``; words are combined where they are made and the driver gets each once."""

    def places(batches):
        for batch in batches:
            at = level.positions(_digests(batch.column(0))).ravel()
            words, where = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(bits, where, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    found = marks.mapInArrow(places, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    level.words = np.zeros(level.size // 64, np.uint64)
    level.words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)


def cascade(listed: DataFrame, others: DataFrame, n_listed: int, n_others: int, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """The cascade that tells ``listed`` digests from ``others`` (column ``mark``; ``others`` may hold listed ones, which
    are not counted as mistakes, and any digest more than once). None where its levels would be larger than ``max_bytes``."""
    levels: list[Level] = []
    inside, outside, n_in, n_out = listed, others, n_listed, n_others
    state: list[DataFrame] = []
    while n_in or not levels:
        number = len(levels) + 1
        rate = min(0.5, max(n_in, 1) / max(n_out, 1) / math.sqrt(2)) if number == 1 else 0.5
        level = Level(number, n_in, rate)
        if sum(x.size for x in levels) // 8 + level.size // 8 > max_bytes:
            drop_cut(*state)
            return None
        if number > MAX_LEVELS:
            raise RuntimeError("two keys have one digest")
        _fill(level, inside)
        levels.append(level)
        passed = _passing(outside, level)
        if number == 1:  # the universe's keys stand there once a url: each once from here on, and without the listed ones
            passed = passed.distinct().join(listed, "mark", "left_anti")
        passed = cut(passed, "cascade-level", few=True)
        state.append(passed)
        # what passed is on the other side of the next level
        inside, outside, n_in, n_out = passed, inside, passed.count(), n_in
    drop_cut(*state)
    return Cascade(levels)


def _judged(urls: DataFrame, rules: DataFrame, universe: DataFrame, max_bytes: int) -> DataFrame | None:
    """``urls`` with ``at`` (place of the winning key in ``keys``, 0 for none) and ``blocks``; None where the filters are too large."""
    spark = urls.sparkSession
    listed = cut(rules.select(F.unhex(digest(F.col("key"))).alias("mark"), "block"), "rule-digests", few=True)
    n_listed, n_block = listed.agg(F.count(F.lit(1)), F.count_if("block")).first()
    n_keys = universe.agg(F.approx_count_distinct("mark")).first()[0]
    first = cascade(listed.select("mark"), universe, n_listed, max(n_keys - n_listed, 0), max_bytes)
    if first is None:
        return None
    second = cascade(listed.where("block").select("mark"), listed.where("NOT block").select("mark"), n_block, n_listed - n_block, max_bytes)
    if second is None:
        return None
    drop_cut(listed)
    held = spark.sparkContext.broadcast((first, second))

    @F.arrow_udf("struct<at:int,blocks:boolean>")
    def find(marks: pa.Array) -> pa.Array:
        in_list, blocked = held.value
        digests = _digests(marks)
        sizes = np.diff(np.frombuffer(marks.cast(pa.large_binary()).buffers()[1], np.int64)[marks.offset : marks.offset + len(marks) + 1]) // 32
        row, first_of = np.repeat(np.arange(len(marks)), sizes), np.cumsum(sizes) - sizes
        hits = np.flatnonzero(in_list.listed(digests))
        rows, where = np.unique(row[hits], return_index=True)
        best = hits[where]  # keys lie longest first, so a row's first hit wins
        at, blocks = np.zeros(len(marks), np.int32), np.zeros(len(marks), bool)
        at[rows], blocks[rows] = best - first_of[rows] + 1, blocked.listed(digests[best])
        return pa.StructArray.from_arrays([pa.array(at), pa.array(blocks)], names=["at", "blocks"])

    marked = urls.withColumn("marks", F.unhex(F.array_join(F.transform("keys", digest), "")))
    return marked.withColumn("found", find("marks")).withColumns({"at": F.col("found.at"), "blocks": F.col("found.blocks")})


def _joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by a hash join of each distinct list of keys with the rules, for lists of any size."""
    lists = urls.select("keys").where(F.size("keys") > 0).distinct()
    keys = lists.select("keys", F.posexplode("keys").alias("at", "key"))
    best = keys.join(rules.select("key", "block"), "key").groupBy("keys").agg(F.min(F.struct((F.col("at") + 1).alias("at"), F.col("block").alias("blocks"))).alias("found"))
    return urls.join(best, "keys", "left").withColumns({"at": F.coalesce("found.at", F.lit(0)), "blocks": F.coalesce("found.blocks", F.lit(False))})


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict) of every page.

    Passes over the urls: an estimate of the number of keys, level 1, the verdicts. The driver gets the rules' shapes
    (label counts times path lengths) and the filters, both of a checked size.
    """
    spark = pages.sparkSession
    listed = cut(rule_keys(rules), "rules", few=True)
    shapes = sorted((r["labels"], r["size"]) for r in listed.select("labels", "size").distinct().collect())
    host, path = host_and_path(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    split = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = split.withColumn("keys", candidates(F.col("host"), F.col("path"), shapes))
    universe = urls.select(F.explode("keys").alias("key")).select(F.unhex(digest(F.col("key"))).alias("mark"))
    with batches_of(spark, BATCH_BYTES):
        found = _judged(urls, listed, universe, max_bytes)
    if found is None:
        found = _joined(urls, listed)
    rule = F.when(F.col("at") > 0, F.get("keys", F.col("at") - 1))
    return found.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.when(F.col("blocks"), BLOCK).otherwise(ALLOW).alias("verdict"))
