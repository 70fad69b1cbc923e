"""N-gram Jaccard join by a token-group matrix.

A document is the set of its distinct word shingles. Two documents link when |A & B| >= threshold * |A | B|; the
result is each document's component under the links. No link is lost, whatever the data:

1. Sketch. Each set gets a digest, a bitmap of its hashed tokens and its bundles. A set's size puts it in a level;
   levels are so wide that linked sets are in the same or in neighbouring levels. In a level, tokens are dealt by
   hash into one part more than two linked sets can differ in, so linked sets have an equal part: a bundle, unless
   it is empty. If all their equal parts are empty, the two differ in every part that has tokens; a set with so few
   of those that a linked set may differ in all of them shows its first tokens in hash order too, so many that two
   such linked sets have one in common. A set shows its bundles at its own level and at the next.
2. Group. Sets that share bundles are put in one group by the smallest digest they meet; a group is split into
   chunks of at most ``CHUNK_DOCS`` sets and about ``CHUNK_TOKENS`` tokens. The matrix of bundles and chunks gives the pairs of
   chunks that may hold a link.
3. Bound. For each such pair the token unions of the chunks (as bitmaps) bound the overlap of every set with the
   other chunk, and the bitmaps of two sets bound their difference; a pair of chunks qualifies by the sets that
   pass both bounds.
4. Open. The tokens of those sets are made again from their texts, intersected exactly as blocks of a matrix
   product, and every pair of chunks gives its links as stars, not as pairs.
5. Components of the stars.

Equal sets are one set from step 1 on, so copies are never paired. Work on a large group of near copies that are not
equal grows with the square of its chunks: k chunks give up to k * k / 2 pairs of chunks (65,536 set pairs each), as
blocks of bounded size in separate tasks, and each pair carries the bitmaps of its two chunks.

Cases: null, empty and wordless texts have the empty set, link with nothing and are their own component (their id);
fewer words than ``n`` are one shingle, the whole sequence; rows that repeat an id are each judged by their own
text, in ``keep_one`` too; a null id is no component's id unless all of its rows have none; texts of any length are
used whole; empty tables give empty results; columns other than the two named are left out of ``components`` and
passed through by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.session import cut, drop_cut, row_hash, small_batches

CHUNK_DOCS, CHUNK_TOKENS = 256, 200_000
#: Bundles that the grouping step holds at a time, about.
TASK_BUNDLES = 500_000
#: Passes over the bundles, at most, and bundles of one at least: each exchanges a share of them, and its shuffle files go with it.
PASSES, PASS_BUNDLES = 4, 4_000_000
#: Bytes of bundles that are packed together, and sets: a set's number in a pack takes two bytes.
PACK_BYTES, PACK_SETS = 4 << 20, 1 << 16
#: Bytes of a bundle that travel; 56 bits with the one that tells guests. Chance hits are judged like other candidates.
BUNDLE_BYTES = 7
#: Chunks on one side of a tile of chunk pairs.
TILE = 64
#: Word hashes remembered by a worker; emptied beyond that.
MEMO_WORDS = 100_000

#: The blanks between words, [\\x20\\x09-\\x0D].
BLANKS = " \t\n\x0b\f\r"

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M3
    x = (x ^ (x >> np.uint64(27))) * _M1
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text; A-Z lower-cased, words between ASCII blanks."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > MEMO_WORDS:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64) * _M2
    for k in range(size):
        out = _mix(out + h[k : len(h) - size + 1 + k] * _M2)
    return np.unique(out)


def set_digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


class Levels:
    """Size levels and parts for a threshold. Level i holds sizes begin[i] .. begin[i + 1] - 1."""

    def __init__(self, threshold: Fraction):
        self.threshold = threshold
        self.begin = [1]
        self.n_parts: dict[int, int] = {}

    def _grow(self) -> None:
        self.begin.append(int(self.begin[-1] / self.threshold) + 1)

    def of(self, size: int) -> int:
        while self.begin[-1] <= size:
            self._grow()
        return bisect.bisect_right(self.begin, size) - 1

    def differ(self, total: int) -> int:
        """The most tokens in which two linked sets with ``total`` tokens together can differ."""
        return int((1 - self.threshold) / (1 + self.threshold) * total)

    def parts(self, level: int) -> int:
        if level not in self.n_parts:
            while len(self.begin) < level + 2:
                self._grow()
            self.n_parts[level] = self.differ(2 * (self.begin[level + 1] - 1)) + 1
        return self.n_parts[level]

    def first_tokens(self, size: int, level: int, guest: int, filled: int) -> int:
        """How many first tokens a set with ``filled`` non-empty parts must show for the links that parts may miss.

        These are links with a set that differs in all of the parts, so in ``filled`` tokens or more. Two linked sets
        with an overlap of o or more have a token in common among the first size - o + 1 of each.
        """
        k, t = self.parts(level), self.threshold
        if filled == k or filled > self.differ(size + min(self.begin[level + 1] - 1, int(size / t))):
            return 0
        least = self.begin[level] if guest else math.ceil(t * size)
        overlap = max(math.ceil(t / (1 + t) * (size + least)), math.ceil(t / (1 - t) * filled))
        return max(size - overlap + 1, 0)


def bundles(tokens: np.ndarray, levels: Levels) -> np.ndarray:
    """One 64-bit value for each non-empty part, at the own level and the next; the lowest bit tells which.

    Where empty parts may hide a link, first tokens (``Levels.first_tokens``) are bundles too.
    """
    own = levels.of(len(tokens))
    mixed, spread, out = _mix(tokens ^ _M2), _mix(tokens + _M1), []
    for guest in (0, 1):
        k = levels.parts(own + guest)
        part = (spread % np.uint64(k)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        begins = np.flatnonzero(np.diff(part, prepend=-1))
        # two sums of hashes: order doesn't matter, equal parts and only they agree
        total = np.add.reduceat(mixed[order], begins) ^ _mix(np.bitwise_xor.reduceat(tokens[order], begins))
        value = _mix(total + (part[begins] + ((own + guest) << 40)).astype(np.uint64) * _M2)
        first = tokens[: levels.first_tokens(len(tokens), own + guest, guest, len(begins))]
        value = np.concatenate([value, _mix(_mix(first ^ _M3) + np.uint64((own + guest) << 40))])
        out.append((value & ~np.uint64(1)) | np.uint64(guest))
    return np.concatenate(out)


def bitmap(tokens: np.ndarray) -> bytes:
    """Bits of the hashed tokens, at least four bits a token, a power of two."""
    size = 1 << max(6, (4 * len(tokens) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(_mix(tokens) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _unfold(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 0 and 1, folded to the smallest size among them."""
    size = min(map(len, bitmaps)) * 8
    rows = np.zeros((len(bitmaps), size), np.float32)
    for i, b in enumerate(bitmaps):
        bits = np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")
        rows[i] = bits.reshape(-1, size).max(axis=0)
    return rows


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def sketch(docs: DataFrame, n: int, threshold: Fraction, id_col: str, text_col: str) -> DataFrame:
    """(id, h: hash of the text, n, digest, bundles, bitmap) of every row; the last three are null for the empty set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(threshold)
        for batch in batches:
            for begin in range(0, batch.num_rows, 250):
                part = batch.slice(begin, 250)
                sets = [shingles(x.as_py(), n) for x in part.column(2)]
                columns = [
                    part.column(0),
                    part.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([bundles(s, levels).tobytes() if len(s) else None for s in sets], pa.binary()),
                    pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "n", "digest", "bundles", "bitmap"])

    rows = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("h"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(make, f"id {kind}, h bigint, n bigint, digest binary, bundles binary, bitmap binary")


def narrow(values: np.ndarray) -> bytes:
    """The low BUNDLE_BYTES bytes of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BUNDLE_BYTES].tobytes()


def widen(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // BUNDLE_BYTES, 8), np.uint8)
    wide[:, :BUNDLE_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, BUNDLE_BYTES)
    return wide.view("<u8").ravel().astype(np.uint64)


def _pack(parts: int, number: int = 0, of: int = 1):
    """Bundles dealt into parts, a few packed rows at a time: (part, bundles, owner among the digests, digests); every ``of``-th part only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, bytes] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            sizes = np.array([len(b) // 8 for b in held.values()])
            values = np.frombuffer(b"".join(held.values()), np.uint64) & np.uint64((1 << 8 * BUNDLE_BYTES) - 1)
            owner = np.repeat(np.arange(len(held), dtype=np.uint32), sizes)
            digests = np.frombuffer(b"".join(held), "V16")
            to = ((values >> np.uint64(1)) % np.uint64(parts)).astype(np.int64)
            here = np.flatnonzero(to % of == number)
            if not len(here):
                return
            order = here[np.argsort(to[here], kind="stable")]
            for piece in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                who, local = np.unique(owner[piece], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([int(to[piece[0]])], pa.int32()), pa.array([narrow(values[piece])], pa.binary()), pa.array([local.astype(np.uint16).tobytes()], pa.binary()), pa.array([digests[who].tobytes()], pa.binary())], names=["part", "bundles", "owner", "digests"])

        for batch in batches:
            for digest, b in zip(batch.column(0), batch.column(1), strict=True):
                if (d := digest.as_py()) not in held:
                    held[d] = b.as_py()
                    size += len(held[d])
                if size >= PACK_BYTES or len(held) == PACK_SETS:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return run


def _shared_of_part(values: list[np.ndarray], owner: list[np.ndarray], digests: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The bundles of one part that more than one set has: (bundle, digest, first)."""
    shift = np.cumsum([0, *(len(d) for d in digests[:-1])])
    raw = np.concatenate(digests)
    # packs repeat digests: equal ones get one number, in the order of their bytes
    high, low = raw.view(">u8").reshape(-1, 2).T.astype(np.uint64)
    by_digest = np.lexsort((low, high))
    new = np.ones(len(raw), bool)
    new[1:] = (np.diff(high[by_digest]) != 0) | (np.diff(low[by_digest]) != 0)
    number = np.empty(len(raw), np.int64)
    number[by_digest] = np.cumsum(new) - 1
    raw = raw[by_digest[new]]
    who = number[np.concatenate([o + s for o, s in zip(owner, shift, strict=True)])]
    all_values = np.concatenate(values)
    bundle, guest = all_values >> np.uint64(1), all_values & np.uint64(1)
    order = np.lexsort((who, bundle))
    bundle, guest, who = bundle[order], guest[order], who[order]
    fresh = np.ones(len(bundle), bool)
    fresh[1:] = (bundle[1:] != bundle[:-1]) | (who[1:] != who[:-1])
    bundle, guest, who = bundle[fresh], guest[fresh], who[fresh]
    begins = np.flatnonzero(np.diff(bundle, prepend=bundle[:1] ^ np.uint64(1)))
    sizes = np.diff(np.append(begins, len(bundle)))
    # two guests of a level link at their own level, where they share a bundle too
    useful = (sizes > 1) & (np.minimum.reduceat(guest, begins) == 0)
    keep = np.repeat(useful, sizes)
    first = np.repeat(who[begins], sizes)[keep]
    bundle, who = bundle[keep].astype(np.int64), who[keep]
    kind = pa.binary(16)
    for i in range(0, len(bundle), 20_000):
        digest, smallest = (pa.Array.from_buffers(kind, len(x), [None, pa.py_buffer(raw[x].tobytes())]).cast(pa.binary()) for x in (who[i : i + 20_000], first[i : i + 20_000]))
        yield pa.RecordBatch.from_arrays([pa.array(bundle[i : i + 20_000], pa.int64()), digest, smallest], names=["bundle", "digest", "first"])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted packed rows, one part at a time: equal bundles are in one part, and a part has about TASK_BUNDLES."""
    part, values, owner, digests = None, [], [], []
    for batch in batches:
        for p, v, o, d in zip(*batch.columns, strict=True):
            if (p := p.as_py()) != part and values:
                yield from _shared_of_part(values, owner, digests)
                values, owner, digests = [], [], []
            part = p
            values.append(widen(v.as_py()))
            owner.append(np.frombuffer(o.as_py(), np.uint16).astype(np.int64))
            digests.append(np.frombuffer(d.as_py(), "V16"))
    if values:
        yield from _shared_of_part(values, owner, digests)


def _shared_bundles(sketched: DataFrame) -> list[DataFrame]:
    """(bundle, digest, first): the sets that share a bundle with another, and the smallest digest of the bundle; written, a table a pass.

    Bundles travel packed; a task sorts the packed rows by part and holds one part of bundles at a time. Equal bundles are in one
    part and so in one pass: passes see all bundles, but only those of one are on disk twice.
    """
    spark = sketched.sparkSession
    total = int(sketched.agg(F.sum(F.octet_length("bundles")) / 8).first()[0] or 0)
    of = min(PASSES, total // PASS_BUNDLES + 1)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (TASK_BUNDLES * of) + 1)
    found = []
    for number in range(of):
        packed = sketched.where("digest IS NOT NULL").select("digest", "bundles").mapInArrow(_pack(tasks * of, number, of), "part int, bundles binary, owner binary, digests binary")
        found.append(cut(packed.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_match, "bundle bigint, digest binary, first binary"), "shared-bundles"))
    return found


def _chunk_pairs(lists: DataFrame) -> DataFrame:
    """(a, b) of all chunks a < b of each row's sorted array ``chunks``, each pair once.

    A long list, as that of a bundle that very many sets share, is cut into tiles of TILE by TILE chunks that are dealt out
    anew, so its pairs are not made by one task.
    """
    pairs = lambda left, right: F.filter(F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.struct(a.alias("a"), b.alias("b"))))), lambda p: p["a"] < p["b"])
    short = lists.where(F.size("chunks").between(2, TILE)).select(F.inline(pairs(F.col("chunks"), F.col("chunks"))))
    cut_up = F.transform(F.sequence(F.lit(0), F.floor((F.size("chunks") - 1) / TILE).cast("int")), lambda i: F.slice("chunks", i * TILE + 1, TILE))
    rows = lists.where(F.size("chunks") > TILE).select(cut_up.alias("tiles")).select(F.posexplode("tiles").alias("i", "left"), "tiles")
    tiles = rows.select("left", F.explode(F.slice("tiles", F.col("i") + 1, F.size("tiles"))).alias("right"))
    dealt = tiles.repartition(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return short.unionByName(dealt.select(F.inline(pairs(F.col("left"), F.col("right"))))).distinct()


def _prune(levels: Levels):
    """Step 3: of each pair of chunks, the sets that may link with a set of the other chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = float(levels.threshold)
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, left, right = (batch.column(k)[i].as_py() for k in range(4))
                one = a == b
                n_left, n_right = np.array([x["n"] for x in left]), np.array([x["n"] for x in right])
                bits = _unfold([x["bitmap"] for x in left] + ([] if one else [x["bitmap"] for x in right]))
                m, o = bits[: len(left)], bits if one else bits[len(left) :]
                # overlap with the union of the other chunk: tokens whose bit is not in the union are missing
                if one:
                    rows, cols = np.arange(len(left)), np.arange(len(right))
                else:
                    rows = np.flatnonzero((m @ (1 - o.max(axis=0))) <= n_left - np.ceil(n_left * t - 1e-9))
                    cols = np.flatnonzero((o @ (1 - m.max(axis=0))) <= n_right - np.ceil(n_right * t - 1e-9))
                if not len(rows) or not len(cols):
                    continue
                m, o = m[rows], o[cols]
                apart = m.sum(axis=1)[:, None] + o.sum(axis=1)[None, :] - 2 * (m @ o.T)
                most = np.floor((1 - t) / (1 + t) * (n_left[rows][:, None] + n_right[cols][None, :]) + 1e-6)
                close = apart <= most
                if one:
                    np.fill_diagonal(close, False)
                picked = {left[rows[x]]["digest"] for x in np.flatnonzero(close.any(axis=1))} | {right[cols[x]]["digest"] for x in np.flatnonzero(close.any(axis=0))}
                if picked:
                    k = len(picked)
                    yield pa.RecordBatch.from_arrays([pa.array([a] * k, pa.int64()), pa.array([b] * k, pa.int64()), pa.array(sorted(picked), pa.binary())], names=["a", "b", "digest"])

    return run


def link_stars(digests: list[bytes], sets: list[np.ndarray], threshold: Fraction) -> list[tuple[bytes, bytes]]:
    """Links among the sets as (member, smallest member) of each group that they tie together; exact."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(k), sizes)
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    both = np.zeros((k, k), np.float64)
    width = 8192
    edges = np.searchsorted(where, np.arange(0, len(tokens) + width, width))
    for b in range(len(edges) - 1):
        block = np.zeros((k, width), np.float32)
        block[owner[edges[b] : edges[b + 1]], where[edges[b] : edges[b + 1]] - b * width] = 1
        both += block @ block.T
    both = np.rint(both).astype(np.int64)
    linked = both * threshold.denominator >= threshold.numerator * (sizes[:, None] + sizes[None, :] - both)
    label = np.arange(k)
    while True:  # smallest label among linked sets, until nothing changes
        new = np.where(linked, label[None, :], k).min(axis=1)
        new = np.minimum(new, label)
        if (new == label).all():
            break
        label = new[new]
    least: dict[int, bytes] = {}
    for d, x in zip(digests, label, strict=True):
        least[x] = min(least.get(x, d), d)
    return [(d, least[x]) for d, x in zip(digests, label, strict=True) if d != least[x]]


def components(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text", per_row: bool = False) -> DataFrame:
    """``id_col``, n_shingles and component_id (the smallest id reachable by links) of every row of ``docs``.

    ``per_row`` gives (id, h: hash of the text, component: a digest) of the rows with words instead.
    """
    levels = Levels(threshold)
    small_batches(docs.sparkSession)
    sketched = cut(sketch(docs, n, threshold, id_col, text_col), "shingle-sketch")
    passes = _shared_bundles(sketched)
    entries = reduce(DataFrame.unionByName, passes)
    # bundles have done their work, and are most of the sketch
    whole, sketched = sketched, cut(sketched.drop("bundles"), "shingle-sets")
    drop_cut(whole)
    grouped = entries.groupBy("digest").agg(F.min("first").alias("group"))
    # one row a set before the join: copies are combined ahead of the exchange and never meet in one task
    reps = sketched.where("digest IS NOT NULL").groupBy("digest").agg(F.max("n").alias("n"), F.max("bitmap").alias("bitmap"), F.min("id").alias("id"))
    members = cut(reps.join(grouped, "digest"), "group-members", few=True)
    chunks = members.groupBy("group").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK_DOCS, F.sum("n") / CHUNK_TOKENS)).alias("chunks"))
    placed = cut(members.join(chunks, "group").withColumn("chunk", F.xxhash64("group", F.pmod(F.xxhash64("digest"), "chunks"))), "chunks", few=True)
    content = cut(placed.groupBy("chunk").agg(F.collect_list(F.struct("digest", "n", "bitmap")).alias("sets")), "chunk-content", few=True)
    # the matrix of bundles and chunks: chunks that share bundles, each list of chunks once
    lists = entries.join(placed.select("digest", "chunk"), "digest").groupBy("bundle").agg(F.array_sort(F.collect_set("chunk")).alias("chunks")).where(F.size("chunks") > 1).select("chunks").distinct()
    within = content.where(F.size("sets") > 1).select(F.col("chunk").alias("a"), F.col("chunk").alias("b"))
    pairs = _chunk_pairs(cut(lists, "chunk-lists", few=True)).unionByName(within)
    left, right = (content.select(F.col("chunk").alias(c), F.col("sets").alias(s)) for c, s in (("a", "left_sets"), ("b", "right_sets")))
    opened = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "left_sets", "right_sets").mapInArrow(_prune(levels), "a bigint, b bigint, digest binary"), "opened", few=True)
    # tokens of the opened sets, from the text of one document of each
    wanted = opened.select("digest").distinct().join(placed.select("digest", "id"), "digest")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                sets = [shingles(x.as_py(), n) for x in part.column(1)]
                same = [set_digest(s) == d.as_py() for s, d in zip(sets, part.column(0), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(same)), pa.array([s.tobytes() for s, ok in zip(sets, same, strict=True) if ok], pa.binary())], names=["digest", "tokens"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    read = texts.join(wanted.hint("shuffle_hash"), texts["id"].eqNullSafe(wanted["id"])).select("digest", "text").mapInArrow(tokens, "digest binary, tokens binary")
    sets = read.dropDuplicates(["digest"])

    def stars(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = link_stars(list(rows["digest"]), [np.frombuffer(x, np.uint64) for x in rows["tokens"]], threshold)
        return pd.DataFrame(found, columns=["u", "v"])

    labels = connected_components(opened.join(sets, "digest").groupBy("a", "b").applyInPandas(stars, "u binary, v binary"))
    least = sketched.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first_id"))
    rooted = least.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "first_id", F.coalesce("component", "digest").alias("root"))
    rooted = cut(rooted, "rooted", few=True)
    drop_cut(*passes, members, placed, content, opened)
    if per_row:
        rows = sketched.where("digest IS NOT NULL").select("id", "h", "digest").join(rooted.select("digest", F.col("root").alias("component")), "digest").select("id", "h", "component")
        rows._reads = (sketched, rooted)
        return rows
    roots = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(roots, "root").select("digest", "component_id")
    out = sketched.select("id", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, and all rows of the empty set, which are linked with nothing.

    Rows are judged, not ids: of a component the row of the smallest id (null last) and text hash stays, and of rows
    that repeat both the one of the smallest hash of all columns. Texts meet the few heads in one exchange.
    """
    found = components(docs, n, threshold, id_col, text_col, per_row=True)
    # a bounded aggregate: a hot component is one partial row a task
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first")
    # written before texts are moved, so that sketches and texts aren't on disk together
    heads = cut(found.groupBy("component").agg(first).select(F.col("first.id").alias("__id"), F.col("first.h").alias("__h"), F.xxhash64("first.id").alias("__key")), "heads", few=True)
    drop_cut(*found._reads)
    # the id as a value that is never null: the join and the window have the same keys, and texts move once
    rows = docs.withColumns({"__hash": text_hash(text_col), "__id_hash": F.xxhash64(id_col), "__one": F.array(id_col)})
    keys = ["__id_hash", "__hash", "__one"]
    heads = heads.select(F.col("__key").alias("__id_hash"), F.col("__h").alias("__hash"), F.array("__id").alias("__one"))
    kept = rows.join(heads, keys, "left_semi")
    once = Window.partitionBy(*keys).orderBy(row_hash(docs))
    copies = kept.withColumn("__nth", F.row_number().over(once)).where("__nth = 1").select(*docs.columns)
    wordless = F.btrim(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(BLANKS)) == ""
    return copies.unionByName(docs.where(wordless))
