"""Media columns: what ISO media containers (MP4, MOV, M4A) say of themselves.

Nested boxes are walked and the sample tables decoded; payloads are never decoded, nor
even read but for their position.  A writer of plain containers is here too, for tests and
for tables that carry no media of their own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.kernels import byte_slices
from attestra.llm.tables import documents_only, table

_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts"}
_SLICE_BYTES = 8 << 20


class Malformed(ValueError):
    """The bytes are not a container that can be described."""


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of the payload, end) of the boxes from start to end, none nested."""
    at = start
    while at < end:
        if end - at < 8:
            raise Malformed("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise Malformed("a box header is cut short")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            head += 16
        if size < head or at + size > end:
            raise Malformed(f"box {kind.decode('latin-1')} does not fit")
        yield kind, at + head, at + size
        at += size


def _leaves(data: memoryview, start: int, end: int) -> dict[bytes, list[tuple[int, int]]]:
    """The boxes between start and end that hold no others, by type, however deep they lie."""
    found: dict[bytes, list[tuple[int, int]]] = {}
    open_ = [boxes(data, start, end)]
    while open_:
        box = next(open_[-1], None)
        if box is None:
            open_.pop()
        elif box[0] in _NESTED:
            open_.append(boxes(data, box[1], box[2]))
        else:
            found.setdefault(box[0], []).append(box[1:])
    return found


def _numbers(data: memoryview, at: tuple[int, int], dtype: str, skip: int, width: int = 1, count_at: int = 4) -> np.ndarray:
    """A table of big-endian numbers, ``width`` in a row, whose row count is at count_at and which begins at skip."""
    a, b = at
    if b - a < skip:
        raise Malformed("a sample table is cut short")
    n = struct.unpack_from(">I", data, a + count_at)[0]
    if n * width * np.dtype(dtype).itemsize > b - a - skip:
        raise Malformed("a sample table is cut short")
    return np.frombuffer(data, dtype, n * width, a + skip).astype(np.int64).reshape(n, width)


def _sizes(data: memoryview, t: dict) -> tuple[int, np.ndarray | int]:
    """How many samples there are, and their sizes: an array, or the one size of all."""
    if b"stsz" in t:
        a, b = t[b"stsz"][0]
        if b - a < 12:
            raise Malformed("a sample table is cut short")
        fixed, n = struct.unpack_from(">II", data, a + 4)
        if fixed:
            if n * fixed > len(data):
                raise Malformed("the samples are larger than the file")
            return n, fixed
        sizes = _numbers(data, (a, b), ">u4", 12, 1, 8)[:, 0]
        return len(sizes), sizes
    if b"stz2" in t:
        a, b = t[b"stz2"][0]
        if b - a < 12:
            raise Malformed("a sample table is cut short")
        bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        if bits not in (4, 8, 16) or (n * bits + 7) // 8 > b - a - 12:
            raise Malformed("a compact sample table is cut short")
        if bits == 4:
            raw = np.frombuffer(data, np.uint8, (n + 1) // 2, a + 12)
            return n, np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
        return n, np.frombuffer(data, f">u{bits // 8}", n, a + 12).astype(np.int64)
    return 0, 0


def _total(runs: np.ndarray) -> int:
    """The sum of the products of two numbers under 2**32 each, however many."""
    products = runs[:, 0].astype(np.uint64) * runs[:, 1].astype(np.uint64)
    high, low = products >> np.uint64(32), products & np.uint64(0xFFFFFFFF)
    return (int(high.sum()) << 32) + int(low.sum())


def _track(data: memoryview, start: int, end: int, number: int) -> dict:
    t = _leaves(data, start, end)
    none = np.zeros(0, np.int64)
    out = {"track": number, "kind": None, "codec": None, "duration": None, "samples": 0, "keyframes": (none, none)}
    if b"tkhd" in t:
        a, b = t[b"tkhd"][0]
        at = 20 if data[a] == 1 else 12
        if b - a < at + 4:
            raise Malformed("tkhd is cut short")
        out["track"] = struct.unpack_from(">I", data, a + at)[0]
    if b"hdlr" in t and t[b"hdlr"][0][1] - t[b"hdlr"][0][0] >= 12:
        a = t[b"hdlr"][0][0]
        out["kind"] = bytes(data[a + 8 : a + 12]).decode("latin-1")
    if b"stsd" in t:
        a, b = t[b"stsd"][0]
        if b - a >= 16 and struct.unpack_from(">I", data, a + 4)[0]:
            out["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1")
    scale = 0
    if b"mdhd" in t:
        a, b = t[b"mdhd"][0]
        wide = data[a] == 1
        if b - a < (32 if wide else 20):
            raise Malformed("mdhd is cut short")
        scale, length = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
        unknown = length == (2**64 - 1 if wide else 2**32 - 1)
        if b"stts" in t:
            runs = _numbers(data, t[b"stts"][0], ">u4", 8, 2)
            if len(runs):
                length, unknown = _total(runs), False
        if scale and not unknown:
            out["duration"] = length / scale
    n, sizes = _sizes(data, t)
    out["samples"] = n
    if not n:
        return out
    if b"stco" in t:
        chunks = _numbers(data, t[b"stco"][0], ">u4", 8)[:, 0]
    elif b"co64" in t:
        chunks = _numbers(data, t[b"co64"][0], ">u8", 8)[:, 0]
    else:
        raise Malformed("samples without chunk offsets")
    if b"stsc" not in t:
        raise Malformed("samples without a chunk map")
    runs = _numbers(data, t[b"stsc"][0], ">u4", 8, 3)
    if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks):
        raise Malformed("the chunk map is out of order")
    per = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0], len(chunks) + 1]))
    if per.sum() != n:
        raise Malformed("the chunk map and the sample count differ")
    first = np.cumsum(per) - per
    keys = np.arange(n)
    if b"stss" in t:
        keys = _numbers(data, t[b"stss"][0], ">u4", 8)[:, 0] - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= n):
            raise Malformed("a keyframe has no sample")
    # a sample lies behind those before it in its chunk; empty chunks hold none
    chunk = np.searchsorted(first, keys, "right") - 1
    if isinstance(sizes, int):
        starts = chunks[chunk] + (keys - first[chunk]) * sizes
        ends = starts + sizes
    else:
        before = np.cumsum(sizes) - sizes
        starts = chunks[chunk] + before[keys] - before[first[chunk]]
        ends = starts + sizes[keys]
    if len(keys) and (starts.min() < 0 or ends.max() > len(data)):
        raise Malformed("a keyframe lies outside the file")
    out["keyframes"] = starts, ends
    return out


def _tracks(content: bytes | memoryview | None) -> tuple[list[dict] | None, str | None]:
    if content is None:
        return None, None
    data = memoryview(content)
    try:
        tracks, any_moov = [], False
        for kind, a, b in boxes(data, 0, len(data)):
            if kind == b"moov":
                any_moov = True
                tracks += [_track(data, x, y, 0) for k, x, y in boxes(data, a, b) if k == b"trak"]
        if not any_moov:
            raise Malformed("no moov box")
        return tracks, None
    except (ValueError, struct.error, IndexError, OverflowError) as e:
        return None, str(e)


def describe(content: bytes | memoryview | None) -> tuple[list[dict] | None, str | None]:
    """(tracks, error) of one file: the tracks of its moov box, or none and what is wrong.  Null has neither."""
    tracks, error = _tracks(content)
    ranges = lambda k: [{"first_byte": a, "end_byte": b} for a, b in zip(k[0].tolist(), k[1].tolist(), strict=True)]
    return None if tracks is None else [t | {"keyframes": ranges(t["keyframes"])} for t in tracks], error


def _column(files: list[list[dict] | None]) -> pa.Array:
    """The column of tracks; keyframes go from arrays to Arrow as they are."""
    flat = [t for f in files for t in f or []]
    keys = [t["keyframes"] for t in flat]
    at = np.cumsum([0, *(len(k[0]) for k in keys)])
    join = lambda i: pa.array(np.concatenate([np.zeros(0, np.int64), *(k[i] for k in keys)]))
    frames = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([join(0), join(1)], ["first_byte", "end_byte"]))
    kinds = (("track", pa.int64()), ("kind", pa.string()), ("codec", pa.string()), ("duration", pa.float64()), ("samples", pa.int64()))
    tracks = pa.StructArray.from_arrays([*(pa.array([t[c] for t in flat], k) for c, k in kinds), frames], [*(c for c, _ in kinds), "keyframes"])
    ends = np.cumsum([0, *(len(f or []) for f in files)])
    # an offset that is null makes its entry null
    offsets = pa.array([None if i < len(files) and files[i] is None else int(x) for i, x in enumerate(ends)], pa.int32())
    return pa.ListArray.from_arrays(offsets, tracks)


TRACKS = "array<struct<track:bigint,kind:string,codec:string,duration:double,samples:bigint,keyframes:array<struct<first_byte:bigint,end_byte:bigint>>>>"


def media_columns(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, tracks, error) of each row of files, whose column ``content`` holds whole container files.

    A track has its number, kind (vide, soun, ..), codec (the sample entry's type), duration
    in seconds, sample count and the byte range [first_byte, end_byte) of each keyframe, in
    the order of samples.  Where a track has no table of keyframes, all samples are.

    Defined cases: null content gives null tracks and no error; empty, cut or foreign bytes,
    tables that promise more samples than the file has bytes and keyframes outside the file
    give null tracks and an error that says why, never a failed job; boxes may be nested to
    any depth, and sums of durations don't overflow; a file with no tracks
    gives an empty list; durations that the file calls unknown are null; fragments outside
    moov are not read; repeated rows give a row each; an empty table gives no rows; other
    columns are ignored.
    """
    src = documents_only(files, key, content).select(F.col(f"`{key}`"), F.col(f"`{content}`").cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "content", _SLICE_BYTES):
            found = [_tracks(None if not x.is_valid else x.as_buffer()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), _column([t for t, _ in found]), pa.array([e for _, e in found], pa.string())], [key, "tracks", "error"])

    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, tracks {TRACKS}, error string")


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0) -> bytes:
    return _box(kind, bytes([version, 0, 0, 0]), *parts)


def write_track(number: int, kind: bytes, codec: bytes, timescale: int, delta: int, sizes: list[int], chunks: list[int], per_chunk: int, keyframes: list[int] | None) -> bytes:
    """A trak box whose chunks at the given offsets hold ``per_chunk`` samples each, the last one the rest."""
    n = len(sizes)
    rest = n - per_chunk * (len(chunks) - 1) if chunks else 0
    runs = []
    if len(chunks) > 1 or chunks and rest == per_chunk:
        runs.append((1, per_chunk, 1))
    if chunks and rest != per_chunk:
        runs.append((len(chunks), rest, 1))
    u4 = lambda xs: np.asarray(xs, ">u4").tobytes()
    tables = [
        _full(b"stsd", struct.pack(">I", 1), _box(codec, b"\0" * 8)),
        _full(b"stts", struct.pack(">III", 1, n, delta)) if n else _full(b"stts", struct.pack(">I", 0)),
        _full(b"stsc", struct.pack(">I", len(runs)), u4([x for r in runs for x in r])),
        _full(b"stsz", struct.pack(">II", 0, n), u4(sizes)),
        _full(b"stco", struct.pack(">I", len(chunks)), u4(chunks)),
    ]
    if keyframes is not None:
        tables.insert(2, _full(b"stss", struct.pack(">I", len(keyframes)), u4([k + 1 for k in keyframes])))
    return _box(
        b"trak",
        _full(b"tkhd", struct.pack(">IIII", 0, 0, number, 0), b"\0" * 64),
        _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, timescale, n * delta, 0, 0)), _full(b"hdlr", b"\0" * 4, kind, b"\0" * 13), _box(b"minf", _box(b"stbl", *tables))),
    )


#: Containers made of text: a video track of SAMPLE bytes a sample, CHUNK samples a chunk and a keyframe every KEY samples, then an audio track.
SAMPLE, CHUNK, KEY, DELTA, SCALE = 512, 4, 12, 3000, 90000
AUDIO_SAMPLE, AUDIO_DELTA, AUDIO_SCALE = 16, 1024, 48000
_FTYP = _box(b"ftyp", b"isom\0\0\2\0isom")
PAYLOAD = len(_FTYP) + 8


def _cut(n: int, size: int) -> list[int]:
    return [size] * (n // size) + ([n % size] if n % size else [])


def write_container(video: bytes, audio: bytes, video_codec: bytes) -> bytes:
    v, a = _cut(len(video), SAMPLE), _cut(len(audio), AUDIO_SAMPLE)
    moov = _box(
        b"moov",
        _full(b"mvhd", struct.pack(">IIII", 0, 0, 1000, 0), b"\0" * 80),
        write_track(1, b"vide", video_codec, SCALE, DELTA, v, list(range(PAYLOAD, PAYLOAD + len(video), SAMPLE * CHUNK)), CHUNK, list(range(0, len(v), KEY))),
        write_track(2, b"soun", b"mp4a", AUDIO_SCALE, AUDIO_DELTA, a, [PAYLOAD + len(video)] if a else [], len(a), None),
    )
    return _FTYP + _box(b"mdat", video, audio) + moov


def pages_as_media(pages: DataFrame) -> DataFrame:
    """(page_id, content): each page as a container, its html as the payload of a video track and its url as that of an audio track."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [write_container(h or b"", u or b"", b"hvc1" if (p or 0) % 2 else b"avc1") for p, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["page_id", "content"])

    return pages.select("page_id", F.col("url").cast("binary").alias("url"), F.col("html").cast("binary").alias("html")).mapInArrow(run, "page_id bigint, content binary")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each keyframe of each page as media; a track without samples has one row, with a null keyframe."""
    described = media_columns(pages_as_media(table(spark, sf_dir, "pages")), "page_id")
    tracks = described.select("page_id", "error", F.explode_outer("tracks").alias("t"))
    return tracks.select("page_id", "error", "t.track", "t.kind", "t.codec", "t.duration", "t.samples", F.posexplode_outer("t.keyframes").alias("keyframe", "k")).select("page_id", "error", "track", "kind", "codec", "duration", "samples", "keyframe", "k.first_byte", "k.end_byte")


_ORACLE = f"""
WITH p AS (SELECT page_id, strlen(html) AS v, strlen(url) AS a FROM pages),
t AS (
  SELECT page_id, 1::BIGINT AS track, 'vide' AS kind, CASE WHEN page_id % 2 = 0 THEN 'avc1' ELSE 'hvc1' END AS codec,
    ceil(v / {SAMPLE}.0)::BIGINT AS samples, {DELTA} AS delta, {SCALE} AS scale, {PAYLOAD} AS base, v AS bytes, {SAMPLE} AS one, {KEY} AS every FROM p
  UNION ALL
  SELECT page_id, 2, 'soun', 'mp4a', ceil(a / {AUDIO_SAMPLE}.0)::BIGINT, {AUDIO_DELTA}, {AUDIO_SCALE}, {PAYLOAD} + v, a, {AUDIO_SAMPLE}, 1 FROM p)
SELECT page_id, NULL::VARCHAR AS error, track, kind, codec, (samples * delta)::DOUBLE / scale AS duration, samples, (s // every)::INT AS keyframe,
  (base + s * one)::BIGINT AS first_byte, (base + least((s + 1) * one, bytes))::BIGINT AS end_byte
FROM (SELECT *, unnest(range(0, greatest(samples, 1), every)) AS s FROM t)
"""

QUERIES = {"op9_media": op9_media}
ORACLE = {"op9_media": _ORACLE}
