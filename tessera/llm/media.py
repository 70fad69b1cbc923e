"""Media columns in ISO base-media containers.

``mux`` stores a payload losslessly as 8-bit samples of one track in a container of nested boxes; ``probe``
walks the boxes of any such container, decodes the sample tables and gives, for each track, codec, duration and
the byte ranges of the keyframes, which ``store`` keeps in columns beside the media. The payload itself is not
decoded. ``read_samples`` takes the stored bytes back by the ranges of the sample table. Sample tables are arrays, and
samples of one size are never listed one by one, so a payload of a gigabyte takes a few megabytes beside itself.

Cases: a null payload is an empty one; an empty payload is padded to one block; equal payloads give equal files
(no clocks inside); a truncated or foreign file gives ``error`` and no tracks instead of a crash; a file of any
length is walked by box headers alone; repeated rows give repeated results; an empty table an empty result;
columns of ``docs`` other than the two named are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, small_batches

#: Bytes of one sample, samples of one chunk, samples from one keyframe to the next, samples a second.
SAMPLE, CHUNK, KEY_EVERY, RATE = 64, 64, 16, 8000
CODEC = b"raw "
#: Bytes of media that one Arrow batch holds at most, one row at least.
BATCH_BYTES = 8 << 20
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def padded(payload: bytes | None, block: int = SAMPLE) -> bytes:
    """The payload with bytes 0 up to a positive multiple of ``block``."""
    payload = payload or b""
    return payload.ljust(max(1, -(-len(payload) // block)) * block, b"\0")


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_BRAND = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")


def mux(payload: bytes) -> bytes:
    """A container with ``payload`` (a positive multiple of SAMPLE bytes) as the samples of one sound track."""
    n = len(payload) // SAMPLE
    if not n or len(payload) % SAMPLE:
        raise ValueError(f"the payload must be a positive multiple of {SAMPLE} bytes")
    long_form = len(payload) + (1 << 20) + n >= 1 << 32
    ticks = n * SAMPLE
    chunks, last = -(-n // CHUNK), n % CHUNK or CHUNK
    runs = [(1, CHUNK)] if last == CHUNK else [(1, last)] if chunks == 1 else [(1, CHUNK), (chunks, last)]

    def moov(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK * SAMPLE)
        keys = np.arange(1, n + 1, KEY_EVERY)
        entry = _box(CODEC, struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
        offsets = _full(b"co64", struct.pack(">I", chunks), at.astype(">u8").tobytes()) if long_form else _full(b"stco", struct.pack(">I", chunks), at.astype(">u4").tobytes())
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            offsets,
            _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, ticks, 0x55C4, 0), version=1), _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"payload\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, ticks, 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=3)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, ticks, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 16 if long_form else 8
    first = len(_BRAND) + len(moov(0)) + head
    size = head + len(payload)
    mdat = struct.pack(">I4sQ", 1, b"mdat", size) if long_form else struct.pack(">I4s", size, b"mdat")
    return b"".join((_BRAND, moov(first), mdat, payload))


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of box kinds, begin and end of the body) of every box, outer before inner."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box header is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            body += 16
        if body > start + size or start + size > end:
            raise ValueError("a box ends outside its parent")
        yield (*path, kind), body, start + size
        if kind in CONTAINERS:
            yield from walk(data, body, start + size, (*path, kind))
        start += size


def _table(data: bytes, at: int, end: int, kind: str, width: int = 1) -> np.ndarray:
    """Entries of a full box that holds a count and so many rows of ``width`` numbers, as an array."""
    (count,) = struct.unpack_from(">I", data, at + 4)
    if at + 8 + count * width * np.dtype(kind).itemsize > end:
        raise ValueError("a table is cut off")
    found = np.frombuffer(data, kind, count * width, at + 8).astype(np.int64)
    return found.reshape(-1, width) if width > 1 else found


class _Track:
    """The sample tables of one track. Samples of one size, as most sound has, are never listed one by one."""

    def __init__(self):
        self.boxes: dict[bytes, tuple[int, int]] = {}

    def sizes(self, data: bytes) -> tuple[int, int, np.ndarray | None]:
        """(number of samples, their size, or 0 and an array of their sizes)."""
        if b"stz2" in self.boxes:
            at, end = self.boxes[b"stz2"]
            width, count = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
            raw = np.frombuffer(data, np.uint8, end - at - 12, at + 12)
            found = np.stack([raw >> 4, raw & 15], axis=1).ravel() if width == 4 else raw if width == 8 else raw[: len(raw) // 2 * 2].view(">u2")
        else:
            at, end = self.boxes[b"stsz"]
            size, count = struct.unpack_from(">II", data, at + 4)
            if size:
                return count, size, None
            if at + 12 + 4 * count > end:
                raise ValueError("a table is cut off")
            found = np.frombuffer(data, ">u4", count, at + 12)
        if len(found) < count:
            raise ValueError("a table is cut off")
        return count, 0, found[:count].astype(np.int64)

    def read(self, data: bytes) -> None:
        """Chunks from stsz or stz2, stsc and stco or co64: offset, first sample and bytes of each."""
        self.n, self.size, sizes = self.sizes(data)
        self.chunks = _table(data, *self.boxes[b"co64"], ">u8") if b"co64" in self.boxes else _table(data, *self.boxes[b"stco"], ">u4")
        runs = _table(data, *self.boxes[b"stsc"], ">u4", 3)
        first = np.append(runs[:, 0] - 1, len(self.chunks))
        if len(runs) and (first[0] != 0 or (np.diff(first) < 0).any()):
            raise ValueError("the sample tables disagree")
        upto = np.cumsum(np.repeat(runs[:, 1], np.diff(first)) if len(runs) else np.zeros(0, np.int64))
        if (int(upto[-1]) if len(upto) else 0) < self.n:
            raise ValueError("the sample tables disagree")
        upto = np.minimum(upto, self.n)
        self.first = np.concatenate([[0], upto[:-1]]).astype(np.int64)
        self.ends = None if sizes is None else np.concatenate([[0], np.cumsum(sizes)])
        self.bytes = (upto - self.first) * self.size if sizes is None else self.ends[upto] - self.ends[self.first]
        if int(self.bytes.sum()) > len(data):
            raise ValueError("samples take more than the file")
        if len(self.chunks) and ((self.chunks + self.bytes)[self.bytes > 0] > len(data)).any():
            raise ValueError("a sample ends outside the file")

    def locate(self, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, sizes) of samples, which are counted from 0."""
        if len(samples) and (samples.min() < 0 or samples.max() >= self.n):
            raise ValueError("a keyframe is no sample")
        chunk = np.searchsorted(self.first, samples, side="right") - 1
        if self.ends is None:
            return self.chunks[chunk] + (samples - self.first[chunk]) * self.size, np.full(len(samples), self.size, np.int64)
        return self.chunks[chunk] + self.ends[samples] - self.ends[self.first[chunk]], self.ends[samples + 1] - self.ends[samples]


def _tracks(data: bytes) -> list[_Track]:
    tracks: list[_Track] = []
    for path, begin, end in walk(data):
        if path[-1] == b"trak":
            tracks.append(_Track())
        elif b"trak" in path:
            tracks[-1].boxes[path[-1]] = (begin, end)
    return tracks


def probe(data: bytes | None) -> dict:
    """{"error", "tracks": [{codec, handler, timescale, duration, n_samples, offsets and sizes of the keyframes}]}."""
    try:
        found = []
        for track in _tracks(data or b""):
            box = track.boxes
            at = box[b"mdhd"][0]
            timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
            times = _table(data, *box[b"stts"], ">u4", 2)
            track.read(data)
            keys = _table(data, *box[b"stss"], ">u4") - 1 if b"stss" in box else np.arange(track.n)
            offsets, sizes = track.locate(keys)
            found.append(
                {
                    "codec": data[box[b"stsd"][0] + 12 : box[b"stsd"][0] + 16].decode("latin-1"),
                    "handler": data[box[b"hdlr"][0] + 8 : box[b"hdlr"][0] + 12].decode("latin-1"),
                    "timescale": timescale,
                    "duration": int((times[:, 0] * times[:, 1]).sum()) or duration,
                    "n_samples": track.n,
                    "offsets": offsets,
                    "sizes": sizes,
                }
            )
        return {"error": None if found else "no track", "tracks": found}
    except (ValueError, KeyError, IndexError, struct.error) as error:
        return {"error": f"{type(error).__name__}: {error}", "tracks": []}


def read_samples(data: bytes) -> bytes:
    """The stored payload: the bytes of the first track's samples, neighbouring chunks taken together."""
    track = _tracks(data)[0]
    track.read(data)
    begins, ends = track.chunks, track.chunks + track.bytes
    new = np.flatnonzero(np.concatenate([[True], begins[1:] != ends[:-1]])) if len(begins) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(begins)) - 1
    return b"".join(data[a:b] for a, b in zip(begins[new].tolist(), ends[last].tolist(), strict=True))


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about BATCH_BYTES by the length of column ``weigh``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weigh] or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


TRACK = "struct<codec:string,handler:string,timescale:bigint,duration:bigint,n_samples:bigint,keyframes:array<struct<offset:bigint,size:bigint>>>"


def _index_columns(found: list[dict]) -> list[pa.Array]:
    """error and tracks of probed files as Arrow columns, made from arrays."""
    tracks = [t for x in found for t in x["tracks"]]
    joined = lambda name: pa.array(np.concatenate([np.zeros(0, np.int64), *(t[name] for t in tracks)]), pa.int64())
    upto = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32())
    ranges = pa.StructArray.from_arrays([joined("offsets"), joined("sizes")], names=["offset", "size"])
    keyframes = pa.ListArray.from_arrays(upto([len(t["offsets"]) for t in tracks]), ranges)
    columns = [pa.array([t[n] for t in tracks], pa.string()) for n in ("codec", "handler")] + [pa.array([t[n] for t in tracks], pa.int64()) for n in ("timescale", "duration", "n_samples")]
    each = pa.StructArray.from_arrays([*columns, keyframes], names=["codec", "handler", "timescale", "duration", "n_samples", "keyframes"])
    return [pa.array([x["error"] for x in found], pa.string()), pa.ListArray.from_arrays(upto([len(x["tracks"]) for x in found]), each)]


def store(docs: DataFrame, id_col: str = "doc_id", payload_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes (unpadded), ``media`` and its index. A narrow map.

    ``media`` is each payload in its container; the index is what walking that container gives: ``error`` and ``tracks``
    with codec, duration and the byte ranges of the keyframes, so that a reader need not open the media for them.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field(0).type), ("n_bytes", pa.int64()), ("media", pa.binary())])
            rows = ((i.as_py(), x.as_py() or b"") for i, x in zip(batch.column(0), batch.column(1), strict=True))
            for part in _batches(((i, len(x), mux(padded(x))) for i, x in rows), schema, 2):
                yield pa.RecordBatch.from_arrays([*part.columns, *_index_columns([probe(x.as_py()) for x in part.column(2)])], names=[*schema.names, "error", "tracks"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(payload_col).cast("binary").alias("payload"))
    return rows.mapInArrow(make, f"id {kind}, n_bytes bigint, media binary, error string, tracks array<{TRACK}>").withColumnRenamed("id", id_col)


def index(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """``stored`` with ``error`` and ``tracks`` in place of the media bytes: the metadata columns of any media table.

    A column of ``stored`` that has one of these names keeps it; the new one gets an underscore.
    """
    small_batches(stored.sparkSession)
    others, names = [c for c in stored.columns if c != media_col], []
    for name in ("error", "tracks"):
        while name in {c.lower() for c in others}:
            name += "_"
        names.append(name)
    schema = ", ".join(f"`{c}` {stored.schema[c].dataType.simpleString()}" for c in others)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *_index_columns([probe(x.as_py()) for x in batch.column(len(others))])], names=[*others, *names])

    return stored.select(*others, media_col).mapInArrow(look, ", ".join(filter(None, [schema, f"{names[0]} string, {names[1]} array<{TRACK}>"])))


def features(tracks: pa.Array) -> list[str]:
    """Codec, rate, duration, samples and keyframes of each row's first track, with a digest of all keyframe ranges."""
    each = tracks.flatten()
    first = np.asarray(tracks.offsets)[:-1] - np.asarray(tracks.offsets)[0]
    codec, rate, duration, n = (each.field(i).to_pylist() for i in (0, 2, 3, 4))
    keyframes = each.field(5)
    at = np.asarray(keyframes.offsets)
    ranges = np.stack([np.asarray(keyframes.values.field(i)) for i in (0, 1)], axis=1).astype("<i8")
    return [f"{codec[i].strip()}/{rate[i]}/{duration[i]}/{n[i]}/{at[i + 1] - at[i]}/{zlib.crc32(ranges[at[i] : at[i + 1]].tobytes()):08x}" for i in first.tolist()]


def stored_digests(docs: DataFrame, id_col: str = "doc_id", payload_col: str = "text") -> DataFrame:
    """Store every payload as a written media column with its index, read both back and digest what was read."""
    kind = docs.schema[id_col].dataType.simpleString()
    media = cut(store(docs, id_col, payload_col), "media")
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in (x.as_py() for x in batch.column(2)):
                payload = read_samples(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-SAMPLE:]), len(data), hashlib.sha256(data).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True)), pa.array(features(batch.column(3)) if rows else [], pa.string())], names=names)

    schema = f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select(F.col(id_col).alias("id"), "n_bytes", "media", "tracks").mapInArrow(digest, schema).withColumnRenamed("id", id_col)
