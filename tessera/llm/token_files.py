"""Token-ID files in Simple-8b word-aligned coding.

A word of 64 bits has a selector in its top 4 bits and a count of ids that the selector fixes, each in so many
bits (``COUNT``, ``WIDTH``). Selector 0 is the escape: the next word is one id of up to 64 bits, verbatim. Ids are
cut into blocks of ``BLOCK`` ids; a block begins on a word of its own, unused places of its last word are 0, and
the file keeps every block's word offset, so blocks are decoded at random and all at once with array operations.

File: magic, block size; words; then block offsets, document ids with validity, document starts, a trailer of
counts and the magic again. All integers are little-endian. Every attempt of a task writes a file of its own name,
renamed when complete; the manifest names the files of the attempts that Spark took, and nothing is replaced.

Cases: null and empty texts are documents that hold only the end id; texts of any length are encoded whole; rows
that repeat an id stand next to one another, ordered by text; a null id sorts first; an empty table gives no file
and an empty result; columns other than the two named are left out.
"""

from __future__ import annotations

import itertools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import batches_of, fresh_path, qualified

#: By selector: ids in a word, and bits of each. Fixed values of the coding; selector 0 is the escape.
COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTH = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.uint64)
BLOCK = 1024
MAGIC = b"S8BIDS1\n"
#: Ids held by a writer before they are coded.
SLAB = 1 << 20

_BITS16 = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    if not len(ids) or int(ids.max()) < 1 << 16:
        return _BITS16[ids.astype(np.int32)]
    out = np.zeros(ids.shape, np.uint8)
    for k in range(4):
        part = (ids >> np.uint64(16 * k)) & np.uint64(0xFFFF)
        out = np.where(part > 0, _BITS16[part] + np.uint8(16 * k), out)
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block) of unsigned ids; every block takes the fullest word that fits next."""
    ids = np.asarray(ids, np.uint64)
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    wide = int(COUNT[1])
    grid = np.zeros((n_blocks, BLOCK + wide), np.uint64)
    flat = np.zeros(n_blocks * BLOCK, np.uint64)
    flat[: len(ids)] = ids
    grid[:, :BLOCK] = flat.reshape(n_blocks, BLOCK)
    sizes = np.full(n_blocks, BLOCK)
    sizes[-1] = len(ids) - (n_blocks - 1) * BLOCK
    # most[i]: bits of the largest of the next c ids, for growing c; the last selector that fits is the fullest
    bits = _bits(flat).reshape(n_blocks, BLOCK)
    choice = np.where(bits > 60, 0, 15).astype(np.uint8)
    most, reach = bits, 1
    for selector in range(14, 0, -1):
        count = int(COUNT[selector])
        while reach < count:
            step = min(reach, count - reach)
            if most is bits:
                most = bits.copy()
            np.maximum(most[:, : BLOCK - step], most[:, step:].copy(), out=most[:, : BLOCK - step])
            reach += step
        np.copyto(choice, np.uint8(selector), where=most <= np.uint8(WIDTH[selector]))
    at, rows = np.zeros(n_blocks, np.int64), np.arange(n_blocks)
    took: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(rows):
        selector = choice[rows, at[rows]]
        took.append((rows, at[rows], selector))
        at[rows] += COUNT[selector]
        rows = rows[at[rows] < sizes[rows]]
    step = np.repeat(np.arange(len(took)), [len(x[0]) for x in took])
    row, pos, selector = (np.concatenate(x) for x in zip(*took, strict=True))
    per_row = np.bincount(row, minlength=n_blocks)
    escaped = selector == 0
    if escaped.any():  # words that are two long move what follows them
        order = np.lexsort((step, row))
        length = np.where(escaped, 2, 1)[order]
        place = np.empty(len(row), np.int64)
        place[order] = np.cumsum(length) - length
        per_row += np.bincount(row[escaped], minlength=n_blocks)
    else:
        place = (np.cumsum(per_row) - per_row)[row] + step
    offsets = np.cumsum(per_row) - per_row
    words = np.zeros(int(per_row.sum()), np.uint64)
    flat, first = grid.ravel(), row * grid.shape[1] + pos
    for s in range(16):
        mine = np.flatnonzero(selector == s)
        if not len(mine):
            continue
        to, begin = place[mine], first[mine]
        if s == 0:
            words[to + 1] = flat[begin]
            continue
        word = np.full(len(mine), s << 60, np.uint64)
        for k in range(int(COUNT[s]) if WIDTH[s] else 0):
            word |= flat[begin + k] << (np.uint64(k) * WIDTH[s])
        words[to] = word
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """All ids of the blocks that begin at ``offsets``; the last block may be short."""
    out = np.zeros(len(offsets) * BLOCK + int(COUNT[1]), np.uint64)
    if not len(offsets):
        return out[:0]
    selector = (words >> np.uint64(60)).astype(np.int64)
    # words that follow an escape are ids: among words that look like escapes, blocks tell where a run begins
    is_id = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0):
        if not is_id[i]:
            is_id[i + 1] = True
    heads = np.flatnonzero(~is_id)
    counts = COUNT[selector[heads]]
    before = np.cumsum(counts) - counts
    first = np.searchsorted(heads, offsets)
    block = np.searchsorted(offsets, heads, side="right") - 1
    place = before - before[first][block] + block * BLOCK
    # blocks one after another: unused places of a block's last word are overwritten by the next block
    for s in range(16):
        mine = np.flatnonzero(selector[heads] == s)
        if not len(mine):
            continue
        if s == 0:
            out[place[mine]] = words[heads[mine] + 1]
            continue
        if not WIDTH[s]:
            continue
        mask = np.uint64((1 << int(WIDTH[s])) - 1)
        limit = (block[mine] + 1) * BLOCK
        for k in range(int(COUNT[s])):
            to = place[mine] + k
            ok = to < limit
            out[to[ok]] = (words[heads[mine]][ok] >> (np.uint64(k) * WIDTH[s])) & mask
    return out[:n_ids]


def _open(path: str):
    """(file system, path in it) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer:
    """Writes one file of documents, slab by slab."""

    def __init__(self, path: str):
        self.fs, self.path = _open(path)
        self.temporary = f"{self.path}.part"
        self.file = self.fs.open_output_stream(self.temporary)
        self.file.write(MAGIC + struct.pack("<II", BLOCK, 0))
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_words = 0
        self.offsets: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.starts: list[int] = []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents one after another: their ids, and the number of ids of each."""
        self.doc_ids += doc_ids
        self.starts += (np.cumsum(lengths) - lengths + self.n_ids + self.n_held).tolist()
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= SLAB:
            self._code(self.n_held // BLOCK * BLOCK)

    def _code(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for begin in range(0, n, SLAB):
            words, offsets = encode(ids[begin : min(n, begin + SLAB)])
            self.file.write(words.astype("<u8").tobytes())
            self.offsets.append(offsets + self.n_words)
            self.n_words += len(words)
        self.n_ids += n
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._code(self.n_held)
        offsets = np.concatenate(self.offsets) if self.offsets else np.zeros(0, np.int64)
        valid = np.array([x is not None for x in self.doc_ids], np.uint8)
        ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        tail = (len(offsets), len(ids), self.n_ids, self.n_words)
        self.file.write(offsets.astype("<u8").tobytes() + ids.tobytes() + valid.tobytes() + np.array(self.starts, "<u8").tobytes() + struct.pack("<4Q", *tail) + MAGIC)
        self.file.close()
        self.fs.move(self.temporary, self.path)


def read_file(path: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc id, start in the file, ids) of each document of a file, decoded a few hundred blocks at a time."""
    system, at = _open(path)
    with system.open_input_file(at) as file:
        size = file.size()
        file.seek(size - 40)
        *tail, magic = struct.unpack("<4Q8s", file.read(40))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {path}")
        n_blocks, n_docs, n_ids, n_words = tail
        file.seek(16 + 8 * n_words)
        foot = file.read(size - 40 - 16 - 8 * n_words)
        offsets = np.frombuffer(foot, "<u8", n_blocks).astype(np.int64)
        doc_ids = np.frombuffer(foot, "<i8", n_docs, 8 * n_blocks)
        valid = np.frombuffer(foot, "u1", n_docs, 8 * (n_blocks + n_docs))
        starts = np.append(np.frombuffer(foot, "<u8", n_docs, 8 * (n_blocks + n_docs) + n_docs).astype(np.int64), n_ids)
        parts, have, doc = [], 0, 0
        file.seek(16)
        for b in range(0, max(n_blocks, 1), 512):
            e = min(b + 512, n_blocks)
            last = offsets[e] if e < n_blocks else n_words
            if e > b:
                words = np.frombuffer(file.read(8 * int(last - offsets[b])), "<u8")
                parts.append(decode(words, offsets[b:e] - offsets[b], min(n_ids, e * BLOCK) - b * BLOCK))
                have += len(parts[-1])
            if doc < n_docs and starts[doc + 1] <= have:
                ids = np.concatenate(parts)
                base = have - len(ids)
                while doc < n_docs and starts[doc + 1] <= have:
                    yield int(doc_ids[doc]) if valid[doc] else None, int(starts[doc]), ids[starts[doc] - base : starts[doc + 1] - base]
                    doc += 1
                parts = [ids[starts[doc] - base :]]


#: Input of one file, as Spark estimates it before the exchange; files at most, where it can't tell.
FILE_BYTES, MAX_FILES = 128 << 20, 2_000_000
#: Documents in a batch of digests.
DIGEST_ROWS = 10_000
#: Bytes of text that are encoded together.
PIECE_BYTES = 32 << 20

#: Every white space, in RE2's notation.
_WHITE = "[\\t-\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_WHITE_BLANK = _WHITE + " |  "
#: Letters, then marks: the pre-tokenizer splits between the two.
_STEM = "^(?P<a> [A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<b>[!-/:-@\\[-`{-~]+)$"


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of ``values`` that begin at ``starts``, one after another."""
    upto = np.cumsum(sizes)
    index = np.repeat((starts - upto + sizes).astype(np.int64), sizes)
    index += np.arange(len(index))
    return values[index]


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees every distinct word of a batch once.

    A byte-level BPE splits a text before every blank that follows a non-blank, whatever comes after, and between
    letters and the marks behind them. The words between those places are made distinct by Arrow and encoded by the
    library, and ids are put together by array operations. A text in which white space stands before a blank is
    given to the library as a whole.
    """

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        vocab = self.library.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token: one character of its name each
        for token, i in vocab.items():
            self.width[i] = len(token)

    def _ask(self, words: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of words, as parts one after another, and the number of ids of each word.

        Words without inner white space are one text for the library, cut again by the byte lengths of its tokens.
        """
        parts, counts = [], []
        step = 20_000
        for i in range(0, len(words), step):
            part = words.slice(i, step)
            if pc.any(pc.match_substring_regex(part, "^$|^[^ ]|^ $|. |" + _WHITE)).as_py():
                found = [x.ids for x in self.library.encode_batch_fast(part.to_pylist(), add_special_tokens=False)]
                parts.append(np.array([i for ids in found for i in ids], np.uint32))
                counts.append(np.array([len(ids) for ids in found], np.int64))
                continue
            ids = np.array(self.library.encode_batch_fast(["".join(part.to_pylist())], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.width[ids])
            to = np.cumsum(pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.searchsorted(ends, to) + 1
            if len(ids) != cuts[-1] or (ends[cuts - 1] != to).any():
                raise ValueError("the tokenizer is not byte-level")
            parts.append(ids)
            counts.append(np.diff(cuts, prepend=0))
        return parts, np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each): stems and marks are asked for apart, once."""
        cut = pc.extract_regex(words, _STEM)
        whole = pc.if_else(pc.is_null(cut), words, pc.struct_field(cut, "a"))
        heads = whole.dictionary_encode()
        tails = pc.struct_field(cut, "b").dictionary_encode()
        # words with white space inside are few: they go last, so that the others are encoded as one text
        forms = pa.concat_arrays([heads.dictionary, tails.dictionary.cast(pa.string())])
        plain = pc.match_substring_regex(forms, "^ ?[^ ]+$")
        plain = pc.and_(plain, pc.invert(pc.match_substring_regex(forms, _WHITE)))
        plain = pc.and_(plain, pc.starts_with(forms, " ")).to_numpy(zero_copy_only=False).astype(bool)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        parts, counts = [], []
        for half in (order[:n], order[n:]):
            ids, sizes = self._ask(forms.take(pa.array(half)))
            parts += ids
            counts.append(sizes)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        sizes = np.zeros(len(forms), np.int64)
        sizes[order] = np.concatenate(counts)
        starts = np.zeros(len(forms), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        head = np.asarray(heads.indices).astype(np.int64)
        tail = pc.fill_null(tails.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        tail = np.where(tail < 0, -1, tail + len(heads.dictionary))
        pair = np.stack([head, tail], axis=1).ravel()
        return _gather(ids, np.append(starts, 0)[pair], np.append(sizes, 0)[pair]), sizes[head] + np.append(sizes, 0)[tail]

    def encode_batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with ``end_id`` after each, number of ids of each text)."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        odd = pc.match_substring_regex(texts, _WHITE_BLANK)
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        at = np.asarray(lists.offsets).astype(np.int64)
        at -= at[0]
        flat = lists.flatten()
        distinct = flat.dictionary_encode()
        words = pc.binary_join_element_wise("", distinct.dictionary, " ")
        heads = pc.if_else(odd, texts, flat.take(pa.array(at[:-1])))
        codes = np.asarray(distinct.indices).astype(np.int64)
        codes[at[:-1]] = len(words) + np.arange(n)
        codes = np.insert(codes, at[1:], len(words) + n)
        table, sizes = self._table(words)
        first, more = self._ask(heads)
        table = np.concatenate([table, *first, np.array([end_id], np.uint32)])
        sizes = np.concatenate([sizes, more, [1]])
        starts = np.cumsum(sizes) - sizes
        out = sizes[codes]
        ids = _gather(table, starts[codes], out)
        ends = np.cumsum(out)[at[1:] + np.arange(n)]
        return ids, np.diff(ends, prepend=0)

    def pieces(self, batch: pa.RecordBatch, end_id: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """(document ids, ids, number of ids of each) of a batch's rows, about PIECE_BYTES of text at a time."""
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            before = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, before + PIECE_BYTES, side="right")))
            part = batch.slice(begin, end - begin)
            yield part.column(0).to_pylist(), *self.encode_batch(part.column(1), end_id)
            begin = end


_ENCODERS: dict[str, Encoder] = {}


def _encoder(tokenizer: str) -> Encoder:
    if tokenizer not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]


def write_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int, int]]:
    """Write the ids of all documents in ascending id order; gives (path, first id's place, ids, documents) of each file.

    One exchange: texts are dealt out by ranges of (id, text hash), so that a repeated id can be split. Files are
    named by range, and there are so many that none holds much more than FILE_BYTES of input. What the driver gets is
    one row a file.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = spark.sparkContext.broadcast(file.read())  # a property of the tokenizer: 2 MB

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer.value)
        path = f"{folder}/ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.s8b"
        writer = None
        for batch in batches:
            for doc_ids, ids, lengths in encoder.pieces(batch, end_id):
                writer = writer or Writer(path)
                writer.add(doc_ids, ids, lengths)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_ids": [writer.n_ids], "n_docs": [len(writer.doc_ids)]})

    system, at = _open(folder)
    system.create_dir(at, recursive=True)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // FILE_BYTES, MAX_FILES))
    dealt = rows.repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    # the encoder sees each distinct word of a batch once: a batch is as large as what it encodes together
    with batches_of(spark, PIECE_BYTES):
        found = sorted(dealt.mapInArrow(write, "path string, n_ids bigint, n_docs bigint").collect())
    manifest, start = [], 0
    for path, n_ids, n_docs in found:
        manifest.append((path, start, n_ids, n_docs))
        start += n_ids
    return manifest


def read_digests(spark, manifest: list[tuple[str, int, int, int]], id_col: str = "doc_id") -> DataFrame:
    """``id_col``, start, n_tokens and ids_crc32 of every document, from the files. One task a file."""
    rows = spark.createDataFrame([(m[0], m[1]) for m in manifest], "path string, base bigint")
    names = ["id", "start", "n_tokens", "ids_crc32"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0), batch.column(1), strict=True):
                found = ((d, base.as_py() + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in read_file(path.as_py()))
                while some := list(itertools.islice(found, DIGEST_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names=names)

    if manifest:
        rows = rows.repartition(len(manifest))
    return rows.mapInArrow(read, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files (below the shared folder by default) and give the digests read back from them."""
    spark = docs.sparkSession
    return read_digests(spark, write_files(docs, folder or fresh_path(spark, "token-files"), tokenizer_path, 0, id_col, text_col), id_col)
