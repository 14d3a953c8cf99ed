"""Media columns: documents stored as samples of ISO media files, and what the boxes of such files say.

``iso_file`` writes one audio track of 8-bit samples; ``read_iso`` walks the nested boxes of any ISO media file, decodes
its sample tables (stsd, stts, stsc, stsz, stco or co64, stss) and gives codec, duration and the byte ranges of key
frames, without decoding a payload. A malformed file gives what its sound boxes say; missing tables count as empty.

Null and empty texts store one frame of spaces; repeated rows give equal results; an empty table gives an empty one;
other columns are dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import arrow_schema, text_slices

FRAME = 192
RATE = 8000
#: Frames from one key frame to the next.
KEY_EVERY = 32
#: Frames in a chunk.
CHUNK = 8
#: Boxes that hold boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf")


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def iso_file(payload: bytes, frame: int = FRAME, rate: int = RATE) -> bytes:
    """A file of 8-bit samples, ``frame`` of them a frame; the payload is stored as it is."""
    frames, rest = divmod(len(payload), frame)
    assert frames and not rest, "whole frames only"
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ticks = frames * frame
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")
    start = len(ftyp) + (8 if len(payload) + 8 < 1 << 32 else 16)  # of the payload: the media data comes first
    chunks = -(-frames // CHUNK)
    runs = [(1, min(CHUNK, frames))]
    if chunks > 1 and frames % CHUNK:
        runs.append((chunks, frames % CHUNK))
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, (rate & 0xFFFF) << 16))
    keys = range(1, frames + 1, KEY_EVERY)
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, frames, frame)),
        full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, n, 1) for first, n in runs)),
        full(b"stsz", struct.pack(">II", frame, frames)),
        full(b"co64", struct.pack(f">I{chunks}Q", chunks, *range(start, start + chunks * CHUNK * frame, CHUNK * frame))),
    )
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    mdia = box(
        b"mdia",
        full(b"mdhd", struct.pack(">QQIQHH", 0, 0, rate, ticks, 0x55C4, 0), version=1),
        full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
        box(b"minf", full(b"smhd", bytes(4)), dinf, stbl),
    )
    tkhd = full(b"tkhd", struct.pack(">QQIIQ8xhhhH", 0, 0, 1, 0, ticks, 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=3)
    mvhd = full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, rate, ticks, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2), version=1)
    return ftyp + box(b"mdat", payload) + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


@dataclass
class Track:
    """What the boxes of a track say; samples and key frames are (offset, size) in the file."""

    kind: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    tables: dict[bytes, list] = field(default_factory=dict)

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def samples(self) -> list[tuple[int, int]]:
        sizes, offsets, runs = (self.tables.get(k, []) for k in (b"stsz", b"stco", b"stsc"))
        found, at, n = [], 0, 0
        per_chunk = {first: count for first, count, _ in runs}
        for chunk, offset in enumerate(offsets, 1):
            n = per_chunk.get(chunk, n)
            for size in sizes[at : at + n]:
                found.append((offset, size))
                offset += size
            at += n
        return found

    def key_frames(self) -> list[tuple[int, int]]:
        """Without a table of key frames every sample is one."""
        samples = self.samples()
        keys = self.tables.get(b"stss")
        return samples if keys is None else [samples[k - 1] for k in keys if 0 < k <= len(samples)]


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start and end of the body) of the boxes between two places; stops where a size is impossible."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def read_iso(data: bytes) -> list[Track]:
    view, tracks = memoryview(data), []

    def numbers(form: str, at: int, end: int, most: int) -> list[tuple]:
        step = struct.calcsize(form)
        return list(struct.iter_unpack(form, view[at : at + min(most, (end - at) // step) * step]))

    def leaf(track: Track, kind: bytes, at: int, stop: int) -> None:
        version, count = view[at], struct.unpack_from(">I", view, at + 4)[0]
        if kind == b"mdhd" and stop - at >= (32 if version else 20):
            track.timescale, track.duration = struct.unpack_from(">IQ" if version else ">II", view, at + (20 if version else 12))
        elif kind == b"hdlr" and stop - at >= 12:
            track.kind = bytes(view[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd" and stop - at >= 16:
            track.codec = bytes(view[at + 12 : at + 16]).decode("latin-1").strip()
        elif kind == b"stsz" and stop - at >= 12:
            number = struct.unpack_from(">I", view, at + 8)[0]
            if not count:
                track.tables[kind] = [x for (x,) in numbers(">I", at + 12, stop, number)]
            elif count * number <= len(data):  # more samples than the file can hold: not sound
                track.tables[kind] = [count] * number
        elif kind in (b"stco", b"co64"):
            track.tables[b"stco"] = [x for (x,) in numbers(">Q" if kind == b"co64" else ">I", at + 8, stop, count)]
        elif kind == b"stss":
            track.tables[kind] = [x for (x,) in numbers(">I", at + 8, stop, count)]
        elif kind in (b"stts", b"stsc"):
            track.tables[kind] = numbers(">II" if kind == b"stts" else ">III", at + 8, stop, count)

    open_ = [boxes(view, 0, len(data))]  # from the file inwards
    while open_:
        kind, at, stop = next(open_[-1], (None, 0, 0))
        if kind is None:
            open_.pop()
            continue
        if kind == b"trak":
            tracks.append(Track())
        if kind in CONTAINERS:
            open_.append(boxes(view, at, stop))
        elif tracks and stop - at >= 8:
            leaf(tracks[-1], kind, at, stop)
    return tracks


def ranges(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of runs of samples that touch."""
    found: list[tuple[int, int]] = []
    for start, size in spans:
        if found and found[-1][1] == start:
            found[-1] = (found[-1][0], start + size)
        else:
            found.append((start, start + size))
    return found


def payload_of(data: bytes, track: Track) -> bytes:
    return b"".join(data[a:b] for a, b in ranges(track.samples()))


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
STORED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("codec", T.StringType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("key_frames", SPAN),
    T.StructField("media", T.BinaryType()),
])


def media_columns(docs: DataFrame, with_media: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as an ISO media file, read the file back through its boxes, and describe it.

    feature: codec, seconds, samples, key frames and their first and last byte ranges. ``with_media`` adds the files.
    """
    schema = STORED if with_media else T.StructType(STORED.fields[:-1])
    out = arrow_schema(schema)

    def one(key: int | None, text: str | None) -> tuple:
        raw = (text or "").encode()
        media = iso_file(raw + b" " * (-len(raw) % FRAME or (0 if raw else FRAME)))
        track = read_iso(media)[0]
        back, keys = payload_of(media, track), track.key_frames()
        said = f"{track.codec};{track.seconds:.6f}s;{len(track.tables[b'stsz'])} samples;{len(keys)} key frames;{keys[0][0]}-{sum(keys[0])};{keys[-1][0]}-{sum(keys[-1])}"
        spans = [{"start": a, "end": a + n} for a, n in keys]
        row = (key, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), said, track.codec, track.seconds, spans, media)
        return row if with_media else row[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = [one(k, t) for k, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def describe_media(files: DataFrame, key: str, data: str) -> DataFrame:
    """Codec, seconds and key-frame byte ranges of the ISO media files in a binary column; nulls and other bytes give none."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("track", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("codec", T.StringType()), T.StructField("seconds", T.DoubleType()), T.StructField("samples", T.LongType()), T.StructField("key_frames", SPAN)])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n, t.kind, t.codec, t.seconds, len(t.tables.get(b"stsz", [])), [{"start": a, "end": a + s} for a, s in t.key_frames()]) for k, d in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist()) for n, t in enumerate(read_iso(d or b""))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return files.select(F.col(key).cast("string").alias("key"), F.col(data).alias("data")).mapInArrow(run, schema)
