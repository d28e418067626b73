"""Media columns: ISO base media containers (MP4 and QuickTime family), read without decoding payloads.

``walk`` goes through nested boxes by their headers (32-bit sizes, 64-bit sizes, and size 0, which runs to the end);
``tracks`` decodes each track's sample tables (stsd, mdhd, stts, stsc, stsz, stco or co64, stss) into numpy arrays: codec,
duration, and for each sample its byte range; a track without stss has only keyframes. No sample byte is looked at.

``wrap`` stores a payload of fixed-size samples losslessly as one track of 8-bit grey frames (codec ``raw ``, 24 x 24
pixels, so 576 bytes a sample, ``KEY_EVERY`` samples from keyframe to keyframe), and ``payload`` reads it
back by the byte ranges that the tables give.

Everything is a function of one row, so there is no shuffle and no key can be hot; memory is a slice of rows, or one row.

Defined results: a null, empty or broken container has tracks, codec, duration and ranges null and ``error`` set; boxes that
overrun their parent, are nested over ``DEPTH`` deep, or have tables that point outside it are broken. So has one whose samples lie in movie fragments (``moof``), which are not decoded. A null text is stored as an empty one: one sample of padding. Equal texts give equal
containers. Other columns are kept; clashing names are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, tidy, utf8

SIDE, SAMPLE, KEY_EVERY, RATE, CHUNK, DEPTH = 24, 576, 16, 25, 64, 16
_PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


def walk(data, start: int = 0, end: int | None = None, path: tuple = ()):
    """Yields (path, start, end) of every box's contents, parents first; an error below ``DEPTH`` levels."""
    if len(path) > DEPTH:
        raise ValueError("boxes are nested too deep")
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind, head = *struct.unpack_from(">I4s", data, start), 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box header is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} overruns its parent")
        yield (*path, kind), start + head, start + size
        if kind in _PARENTS:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


def _table(data, at: int, end: int, columns: int, kind: str = ">u4") -> np.ndarray:
    n = struct.unpack_from(">I", data, at + 4)[0]
    size = np.dtype(kind).itemsize * columns * n
    if at + 8 + size > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, dtype=kind, count=n * columns, offset=at + 8).astype(np.int64).reshape(n, columns)


def tracks(data) -> list[dict]:
    """For each track: codec, timescale, duration, sample offsets and sizes, and the keyframes (from 0)."""
    out: list[dict] = []
    split = later = False
    for path, a, b in walk(data):
        kind = path[-1]
        split, later = split or path == (b"moof",), later or path == (b"moov", b"mvex")
        if kind == b"trak":
            out.append({"codec": None, "timescale": 0, "duration": 0})
        elif b"trak" not in path[:-1]:
            continue
        elif kind == b"mdhd":
            wide = data[a] == 1
            out[-1]["timescale"], out[-1]["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
        elif kind == b"stsd":
            out[-1]["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1")
        elif kind == b"stsz":
            fixed, n = struct.unpack_from(">II", data, a + 4)
            if fixed * n > len(data):
                raise ValueError("samples lie outside the container")
            out[-1]["sizes"] = np.full(n, fixed, dtype=np.int64) if fixed else _table(data, a + 4, b, 1).ravel()
        elif kind in (b"stco", b"co64"):
            out[-1]["chunks"] = _table(data, a, b, 1, ">u4" if kind == b"stco" else ">u8").ravel()
        elif kind == b"stsc":
            out[-1]["runs"] = _table(data, a, b, 3)
        elif kind == b"stts":
            out[-1]["times"] = _table(data, a, b, 2)
        elif kind == b"stss":
            out[-1]["keys"] = _table(data, a, b, 1).ravel() - 1
    if split or later and not any(len(t.get("sizes", ())) for t in out):
        raise ValueError("samples lie in movie fragments")
    for t in out:
        sizes, chunks, runs = t.setdefault("sizes", np.zeros(0, dtype=np.int64)), t.pop("chunks", np.zeros(0, dtype=np.int64)), t.pop("runs", np.zeros((0, 3), dtype=np.int64))
        last = np.append(runs[1:, 0], len(chunks) + 1) - runs[:, 0]
        if (last < 0).any():
            raise ValueError("chunk runs are out of order")
        per_chunk = np.repeat(runs[:, 1], last)
        if per_chunk.sum() != len(sizes) or len(per_chunk) != len(chunks):
            raise ValueError("sample tables disagree")
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(per_chunk) - per_chunk
        of = np.repeat(np.arange(len(chunks)), per_chunk)
        t["offsets"] = chunks[of] + before - before[first[of]] if len(sizes) else sizes
        if len(sizes) and int((t["offsets"] + sizes).max()) > len(data):
            raise ValueError("samples lie outside the container")
        t.setdefault("keys", np.arange(len(sizes)))
        if len(t["keys"]) and not 0 <= int(t["keys"].min()) <= int(t["keys"].max()) < len(sizes):
            raise ValueError("a keyframe is no sample")
        t["ticks"] = int(t["times"].prod(axis=1).sum()) if "times" in t else 0
    return out


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, bytes(4), *parts)


def wrap(payload: bytes) -> bytes:
    """A container with payload, a positive multiple of SAMPLE bytes, as its one track's samples."""
    n = len(payload) // SAMPLE
    if not n or len(payload) % SAMPLE:
        raise ValueError(f"needs a positive multiple of {SAMPLE} bytes")
    kind = _box(b"ftyp", b"qt  ", bytes(4), b"qt  ")
    wide = len(payload) + 16 > 0xFFFFFFFF
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    starts = len(kind) + len(head) + np.arange(0, n, CHUNK, dtype=np.int64) * SAMPLE
    runs = [(1, min(n, CHUNK), 1)] + ([(len(starts), n % CHUNK, 1)] if n > CHUNK and n % CHUNK else [])
    keys = np.arange(0, n, KEY_EVERY) + 1
    entry = _box(b"raw ", bytes(6), struct.pack(">H16xHHIIIH32xHh", 1, SIDE, SIDE, 72 << 16, 72 << 16, 0, 1, 40, -1))
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, 1)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", SAMPLE, n)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", len(starts)), starts.astype(">u8" if wide else ">u4").tobytes()),
        _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
    )
    minf = _box(b"minf", _full(b"vmhd", bytes(8)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1"))), stbl)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(13)), minf)
    one = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    tkhd = _box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), one, struct.pack(">II", SIDE << 16, SIDE << 16))
    mvhd = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n, 1 << 16, 256), one, bytes(24), struct.pack(">I", 2))
    return b"".join([kind, head, payload, _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))])


def payload(data, track: dict) -> bytes:
    """The samples of a track, in order."""
    off, size = track["offsets"], track["sizes"]
    if not len(off):
        return b""
    cut = np.flatnonzero(off[1:] != off[:-1] + size[:-1]) + 1
    first, last = np.append(0, cut), np.append(cut, len(off)) - 1
    return b"".join(bytes(data[a:b]) for a, b in zip(off[first].tolist(), (off[last] + size[last]).tolist()))


def keyframe_ranges(track: dict) -> list[tuple[int, int]]:
    """Start and end of the bytes of each keyframe."""
    at = track["offsets"][track["keys"]]
    return list(zip(at.tolist(), (at + track["sizes"][track["keys"]]).tolist()))


_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_TRACK = [T.StructField("codec", T.StringType()), T.StructField("duration", T.DoubleType()), T.StructField("samples", T.LongType()), T.StructField("keyframes", _RANGES)]
_NEW = [*_TRACK, T.StructField("tracks", T.ArrayType(T.StructType(_TRACK))), T.StructField("error", T.StringType())]


def _described(track: dict) -> dict:
    return {"codec": track["codec"], "duration": track["duration"] / track["timescale"] if track["timescale"] else None, "samples": len(track["sizes"]), "keyframes": [{"start": a, "stop": b} for a, b in keyframe_ranges(track)]}


def describe(data) -> dict:
    """tracks: codec, duration in seconds, number of samples and keyframe byte ranges of each track, in order; the first one's also by themselves; error where there are none."""
    none = dict.fromkeys(("codec", "duration", "samples", "keyframes", "tracks"))
    if not data:
        return none | {"error": "empty"}
    try:
        found = tracks(data)
    except (ValueError, struct.error, IndexError, OverflowError) as e:
        return none | {"error": str(e)}
    if not found:
        return none | {"error": "no track"}
    all_of = [_described(t) for t in found]
    return all_of[0] | {"tracks": all_of, "error": None}


def media_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """df with tracks (a struct of codec, duration, samples and keyframes for each), those four of the first track, and error of the containers in a binary column."""
    kept = [f for f in df.schema.fields if f.name not in {x.name for x in _NEW}]
    track = [pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
    kinds = [*track, pa.list_(pa.struct([(f.name, k) for f, k in zip(_TRACK, track)])), pa.string()]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                rows = [describe(x.as_buffer().to_pybytes() if x.is_valid else None) for x in part.column(media)]
                new = [pa.array([r[f.name] for r in rows], k) for f, k in zip(_NEW, kinds)]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + new, names=[f.name for f in kept] + [f.name for f in _NEW])

    return df.mapInArrow(tidy(run), T.StructType(kept + _NEW))


def store_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with ``media``: the text's UTF-8 bytes, padded by 255 to a positive multiple of SAMPLE, in a container."""
    kept = [f for f in df.schema.fields if f.name not in (text, "media", "n_bytes")]

    def run(batches):
        for part, data, off in _byte_rows(batches, text):
            rows = [data[a:b].tobytes() for a, b in zip(off[:-1], off[1:])]
            media = pa.array([wrap(padded(r)) for r in rows], pa.large_binary()).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(list(map(len, rows)), pa.int64()), media], names=[*(f.name for f in kept), "n_bytes", "media"])

    return df.mapInArrow(tidy(run), T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (max(SAMPLE, -len(raw) // SAMPLE * -SAMPLE) - len(raw))


def _byte_rows(batches, text):
    for b in batches:
        data, off = utf8(b.column(text))
        for i, j in slices(off):
            yield b.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]


def media_digests(df: DataFrame, media: str = "media") -> DataFrame:
    """df without its media (as store_texts made it), with what is read back from it: payload (of all tracks, in order) and container sizes and hashes, and the features of each track."""
    new = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    kept = [f for f in df.schema.fields if f.name != media and f.name not in dict(new)]

    def one(data: bytes) -> tuple:
        found = tracks(data)
        back = b"".join(payload(data, t) for t in found)
        feature = "|".join(f"codec={(d['codec'] or '').strip()};duration={'' if d['duration'] is None else format(d['duration'], '.2f')};samples={d['samples']};keyframes={','.join(f'{k['start']}-{k['stop']}' for k in d['keyframes'])}" for d in map(_described, found))
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                rows = [one(x.as_buffer().to_pybytes()) for x in part.column(media)]
                cols = [pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + cols, names=[f.name for f in kept] + [n for n, _ in new])

    return df.mapInArrow(tidy(run), T.StructType([*kept, *(T.StructField(n, t) for n, t in new)]))
