"""Record files (``bf``): a file header, data blocks, and an index of field headers. Read and written as a Spark data source.

After ``register(spark)``, ``spark.read.format("bf").load("/data/*.bf")`` gives one row a record: its header, ``file_idx`` and ``rec_idx``, and ``data`` as array of double (null for text
and bytes, which are in ``raw``). Files are cut in ranges of records, so a large file is read by many tasks; equality filters on header columns
are pushed down to the index, of which a range reads its own headers only, and the data of records that they drop is not read. Records go on in Arrow batches of about ``BATCH_BYTES``. With the option ``data`` set to ``false`` no data is read at all.

``df.write.format("bf").mode("append").save(folder)`` writes a file for each task under ``_temporary``; the commit of the whole job moves the files of the attempts that count to the folder, so attempts that ran twice, were lost or failed
leave nothing that is read. ``dtype`` gives each record's storage type. Compressed types fall back to plain ones where compression does not save bytes. Null and blank texts are empty.

``fetched`` adds the data to headers that were chosen before, by reading those records only. Paths may have any scheme that pyarrow's file systems know (``file``, ``hdfs``, ``s3`` and others), or none for a mounted folder.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

from .codec import compress, inflate

#: Fixed values of the format: magic, version, and layouts of the file and field headers.
MAGIC, VERSION, FILE_HEADER, FIELD_HEADER = 0x45454642, 2, "<qqiIII", "<qq15i2s4s12scc"
#: Fixed values of the format: storage types by code, and the width of their elements.
TYPES = ["STRING", "BINARY", "INT8", "INT16", "INT32", "INT64", "UINT8", "UINT16", "UINT32", "UINT64", "FLOAT32", "FLOAT64", "CFLOAT32", "CFLOAT64"]
NUMPY = {"INT8": "i1", "INT16": "<i2", "INT32": "<i4", "INT64": "<i8", "UINT8": "u1", "UINT16": "<u2", "UINT32": "<u4", "UINT64": "<u8", "FLOAT32": "<f4", "FLOAT64": "<f8"}

INTS = ["dateo", "deet", "npas", "nbits", "datyp", "ip1", "ip2", "ip3", "ni", "nj", "nk", "ig1", "ig2", "ig3", "ig4"]
HEADER = [*INTS, "typvar", "nomvar", "etiket", "grtyp"]
SCHEMA = "file_idx int, rec_idx int, file string, offset bigint, nbytes bigint, dtype string, " + ", ".join(f"{c} int" for c in INTS) + ", typvar string, nomvar string, etiket string, grtyp string, data array<double>, raw binary"
RANGE, BATCH_BYTES = 256, 16 << 20
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "binary": pa.binary()}
_ARROW = {c.split()[0]: _KINDS[c.split()[1]] for c in SCHEMA.split(", ")}
_FILE, _FIELD = struct.calcsize(FILE_HEADER), struct.calcsize(FIELD_HEADER)


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _open(path: str):
    fs, inner = place(path)
    return fs.open_input_file(inner)


def listed(path: str) -> list[str]:
    """The files of a path: a file, the ``.bf`` files of a folder, or those whose name fits a pattern."""
    fs, inner = place(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if not any(c in inner for c in "*?["):
        info = fs.get_file_info(inner)
        if info.type == pafs.FileType.File:
            return [path]
        found = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)) if info.type == pafs.FileType.Directory else []
        return [head + f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(".bf")]
    fixed = inner
    while any(c in fixed for c in "*?["):
        fixed = posixpath.dirname(fixed)
    deep = inner.count("/") - fixed.rstrip("/").count("/") > 1
    found = fs.get_file_info(pafs.FileSelector(fixed or ".", allow_not_found=True, recursive=deep))
    return [head + f.path for f in found if f.type == pafs.FileType.File and "/_temporary/" not in f.path and f.path.count("/") == inner.count("/") and all(fnmatch.fnmatchcase(a, b) for a, b in zip(f.path.split("/"), inner.split("/")))]


def index_place(path: str) -> tuple[int, int]:
    """Where a file's field headers begin, and their number; an error if it isn't a record file, or is cut off."""
    with _open(path) as f:
        size = f.size()
        head = f.read(_FILE)
        if len(head) < _FILE:
            raise ValueError(f"{path}: no file header")
        offset, whole, magic, version, fsize, hsize = struct.unpack(FILE_HEADER, head)
        if magic != MAGIC or version != VERSION or whole != size or fsize != _FILE or hsize != _FIELD:
            raise ValueError(f"{path}: not a record file of version {VERSION}, or cut off")
        f.seek(offset)
        n = struct.unpack("<i", f.read(4))[0]
    if n < 0 or offset + 4 + n * _FIELD > size:
        raise ValueError(f"{path}: its index is cut off")
    return offset + 4, n


def index(path: str, at: int | None = None, first: int = 0, last: int | None = None) -> list[dict]:
    """The field headers of a file, or those from first to before last, where its headers begin at ``at``."""
    if at is None:
        at, last = index_place(path)
    with _open(path) as f:
        f.seek(at + first * _FIELD)
        raw = f.read((last - first) * _FIELD)
    out = []
    for v in struct.iter_unpack(FIELD_HEADER, raw):
        h = {"offset": v[0], "nbytes": v[1]} | dict(zip(INTS, v[2:17]))
        h |= {c: b.split(b"\0")[0].decode("latin-1").rstrip() for c, b in zip(HEADER[-4:], v[17:21])}
        h["dtype"] = TYPES[h["datyp"]] if 0 <= h["datyp"] < len(TYPES) else "NOTYPE"
        out.append(h)
    return out


def values(raw: bytes, dtype: str, count: int):
    """Data of a record as an array of doubles, or None for text and bytes."""
    if dtype in ("CFLOAT32", "CFLOAT64"):
        return inflate(raw, count, "f4" if dtype == "CFLOAT32" else "f8").astype(np.float64)
    if dtype in NUMPY:
        return np.frombuffer(raw, dtype=NUMPY[dtype], count=count).astype(np.float64)
    return None


class _Range(InputPartition):
    def __init__(self, file_idx: int, path: str, at: int, first: int, last: int):
        self.file_idx, self.path, self.at, self.first, self.last = file_idx, path, at, first, last


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(p for part in options.get("path", "").split(",") if part for p in listed(part))
        self.with_data, self.wanted = options.get("data", "true").lower() != "false", {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in (*HEADER, "dtype"):
                self.wanted[f.attribute[0]] = f.value
            yield f  # Spark checks again: a pushed filter only saves reading

    def partitions(self):
        out = []
        for k, p in enumerate(self.paths):
            at, n = index_place(p)
            out += [_Range(k, p, at, a, min(a + RANGE, n)) for a in range(0, n, RANGE)]
        return out or [_Range(0, "", 0, 0, 0)]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        rows, held = [], 0
        with _open(part.path) as f:
            for k, h in enumerate(index(part.path, part.at, part.first, part.last), part.first):
                if any(h[c] != v for c, v in self.wanted.items()):
                    continue
                h |= {"file_idx": part.file_idx, "rec_idx": k, "file": part.path, "data": None, "raw": None}
                if self.with_data:
                    f.seek(h["offset"])
                    raw = f.read(h["nbytes"])
                    h["data"] = values(raw, h["dtype"], h["ni"] * h["nj"] * h["nk"])
                    h["raw"] = raw if h["data"] is None else None
                    held += h["nbytes"] if h["data"] is None else h["data"].nbytes
                rows.append(h)
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    """Records as one Arrow batch; the arrays of data are joined, not made into lists."""
    cols = {}
    for name, kind in _ARROW.items():
        if name == "data":
            got = [r["data"] for r in rows]
            size = np.cumsum([0, *(0 if d is None else len(d) for d in got)])
            flat = pa.array(np.concatenate([d for d in got if d is not None] or [np.zeros(0)]))
            cols[name] = pa.ListArray.from_arrays(pa.array(size, pa.int32()), flat, mask=pa.array([d is None for d in got]))
        else:
            cols[name] = pa.array([r[name] for r in rows], kind)
    return pa.RecordBatch.from_pydict(cols)


class _Commit(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceWriter):
    def __init__(self, options, schema, overwrite: bool):
        self.folder, self.names = options["path"].rstrip("/"), schema.names
        self.temporary = f"{self.folder}/_temporary/{uuid.uuid4().hex}"
        self.old = listed(self.folder) if overwrite else []

    def write(self, rows):
        name = f"{self.temporary}/part-{uuid.uuid4().hex}.bf"
        fs, inner = place(name)
        fs.create_dir(posixpath.dirname(inner), recursive=True)
        heads, at = [], _FILE
        with fs.open_output_stream(inner) as f, tempfile.TemporaryFile() as own:  # the file header, which comes first, states where the index begins
            for r in rows:
                d = {c: r[c] for c in self.names}
                dtype, raw = packed(d)
                heads.append(field_header(d, dtype, at, len(raw)))
                own.write(raw)
                at += len(raw)
            f.write(struct.pack(FILE_HEADER, at, at + 4 + len(heads) * _FIELD, MAGIC, VERSION, _FILE, _FIELD))
            own.seek(0)
            while block := own.read(BATCH_BYTES):
                f.write(block)
            f.write(struct.pack("<i", len(heads)) + b"".join(heads))
        return _Commit(name)

    def commit(self, messages):
        for m in messages:
            fs, inner = place(m.path)
            fs.move(inner, f"{place(self.folder)[1]}/{posixpath.basename(inner)}")
        for p in self.old:
            fs, inner = place(p)
            fs.delete_file(inner)
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        fs, inner = place(self.temporary)
        if fs.get_file_info(inner).type == pafs.FileType.Directory:
            fs.delete_dir(inner)
        above = posixpath.dirname(inner)
        if fs.get_file_info(above).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(above)):
            fs.delete_dir(above)


def packed(d: dict) -> tuple[str, bytes]:
    """Storage type and bytes of a record; plain where compression doesn't save any."""
    dtype = d.get("dtype") or "FLOAT32"
    if dtype in ("STRING", "BINARY"):
        return dtype, bytes(d.get("raw") or b"")
    plain = dtype.removeprefix("C")
    a = np.array(d.get("data") or [], dtype=np.float64).astype(NUMPY[plain])
    if plain != dtype:
        raw = compress(a)
        if len(raw) < a.nbytes:
            return dtype, raw
    return plain, a.tobytes()


def field_header(d: dict, dtype: str, offset: int, nbytes: int) -> bytes:
    width = {"CFLOAT32": 4, "CFLOAT64": 8, "STRING": 1, "BINARY": 1}.get(dtype) or np.dtype(NUMPY[dtype]).itemsize
    n = {c: int(d.get(c) or 0) for c in INTS} | {"nbits": width * 8, "datyp": TYPES.index(dtype)}
    for c in ("ni", "nj", "nk"):
        n[c] = n[c] or 1
    text = [str(d.get(c) or "").rstrip().encode("latin-1", "replace") for c in HEADER[-4:]]
    return struct.pack(FIELD_HEADER, offset, nbytes, *(n[c] for c in INTS), text[0][:2], text[1][:4], text[2][:12], text[3][:1] or b"\0", b"\0")


class BinaryFields(DataSource):
    """The data source; register it with ``register``."""

    @classmethod
    def name(cls):
        return "bf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema, overwrite)


def fetched(headers: DataFrame) -> DataFrame:
    """headers (rows of the source read with data false, with its columns and others) with their data: each task reads the records of its own rows, and no others, from their files' byte ranges."""
    names = headers.columns
    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'data' else 'binary' if f.name == 'raw' else f.dataType.simpleString()}" for f in headers.schema.fields)

    def run(batches):
        for b in batches:
            cols = {n: b.column(n) for n in names}
            for low in range(0, b.num_rows, 64):
                part = {n: c.slice(low, 64) for n, c in cols.items()}
                rows = [dict(zip(("file", "offset", "nbytes", "dtype", "ni", "nj", "nk"), v)) for v in zip(*(part[n].to_pylist() for n in ("file", "offset", "nbytes", "dtype", "ni", "nj", "nk")))]
                for r in rows:
                    with _open(r["file"]) as f:
                        f.seek(r["offset"])
                        raw = f.read(r["nbytes"])
                    r["data"] = values(raw, r["dtype"], r["ni"] * r["nj"] * r["nk"])
                    r["raw"] = raw if r["data"] is None else None
                part |= {n: pa.array([r[n] for r in rows], _ARROW[n]) for n in ("data", "raw") if n in part}
                yield pa.RecordBatch.from_arrays([part[n] for n in names], names=names)

    return headers.mapInArrow(run, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it push filters down to Python sources, without which Spark refuses this reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BinaryFields)
