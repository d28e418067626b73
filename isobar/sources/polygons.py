"""Polygon text files: the number of contours, then for each its number of vertices, a hole flag (0 or 1) and its vertices, all apart by white space.

A polygon is array<struct<hole, pts>>, as in ``functions.rings``. A file holds one polygon; ``write`` puts each in a folder of its own id, so that files are read and written by as many tasks as there are, each at once and again if a task is lost.
Files of whole ids are written and read in Python, as Spark's own files take many times as long for each: tasks write under ``_temporary``, and the folders of those attempts that count are moved in the end. To read, the driver lists the folders' names, and tasks open them.
Other ids, folders of other layouts and file systems that pyarrow doesn't know go through Spark's own text files.
Numbers are written so that reading gives the same doubles. A text that is cut off, holds other things than numbers, or goes on after its last contour gives an error instead of a polygon.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.functions.rings import bound

from .bf import place

_POLYGON = "array<struct<hole: boolean, pts: array<struct<x: double, y: double>>>>"


def to_text(polygon: Column, flags: bool = True) -> Column:
    """The text of a polygon, with or without hole flags; a null polygon has no contours."""
    vertex = lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"))
    head = lambda r: [F.size(r.pts).cast("string"), *([F.when(r.hole, "1").otherwise("0")] if flags else [])]
    contours = F.transform(polygon, lambda r: F.concat_ws("\n", *head(r), F.transform(r.pts, vertex)))
    return F.when(polygon.isNull(), "0").otherwise(F.concat_ws("\n", F.size(polygon).cast("string"), contours))


def from_text(text: Column, flags: bool = True) -> Column:
    """struct<polygon, error> of a text; without flags no contour is a hole."""
    return bound(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda words: _parsed(words, flags))


def _parsed(words: Column, flags: bool) -> Column:
    number = lambda k: F.try_element_at(words, k).try_cast("double")
    count = lambda k: F.try_element_at(words, k).try_cast("int")
    start = F.struct(F.lit(2).alias("at"), F.array().cast(_POLYGON).alias("rings"))
    skip = 2 if flags else 1

    def contour(s: Column, _) -> Column:
        n = F.when(count(s.at) >= 0, count(s.at))
        n = F.when(n <= (F.size(words) - s.at - skip + 1) / 2, n)  # no more vertices than there are words left
        pts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.struct(number(s.at + skip + 2 * k).alias("x"), number(s.at + skip + 1 + 2 * k).alias("y"))))
        pts = F.coalesce(pts, F.when(n == 0, F.array().cast("array<struct<x: double, y: double>>")))
        hole = F.when(count(s.at + 1).isin(0, 1), count(s.at + 1) == 1) if flags else F.lit(False)
        whole = F.forall(pts, lambda p: p.x.isNotNull() & p.y.isNotNull()) & hole.isNotNull()
        ring = F.when(whole, F.array(F.struct(hole.alias("hole"), pts.alias("pts"))))
        return F.struct((s.at + skip + 2 * n).alias("at"), F.concat(s.rings, ring).cast(_POLYGON).alias("rings"))

    contours = F.when(count(F.lit(1)) > 0, F.sequence(F.lit(1), F.greatest(F.least(count(F.lit(1)), F.size(words)), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return bound(F.aggregate(contours, start, contour), lambda end: _checked(words, count(F.lit(1)), end))


def _checked(words: Column, n: Column, end: Column) -> Column:
    error = F.when(F.coalesce(n, F.lit(-1)) < 0, "no number of contours").when(end.rings.isNull() | (F.size(end.rings) != n), "cut off, or not a number").when(end.at != F.size(words) + 1, "more than its contours")
    return F.struct(F.when(error.isNull(), end.rings).alias("polygon"), error.alias("error"))


def write(df: DataFrame, path: str, id_column: str = "id", polygon: str = "polygon", flags: bool = True, mode: str = "errorifexists") -> None:
    """A file of each polygon under a folder of its id."""
    write_texts(df.select(id_column, to_text(F.col(polygon), flags).alias("text")), path, mode)


def write_texts(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A file of each text under a folder of its id, the first column."""
    key, found = df.schema[0], _place(df.sparkSession, path)
    if found is None or not isinstance(key.dataType, T.IntegralType) or not re.fullmatch(r"\w+", key.name) or mode not in ("append", "overwrite", "ignore", "error", "errorifexists"):
        df.write.mode(mode).partitionBy(key.name).text(path)
        return
    fs, root = found[0], found[1]
    if mode != "append" and fs.get_file_info(root).type != pafs.FileType.NotFound:
        if mode == "ignore":
            return
        if mode != "overwrite":
            raise AnalysisException(f"[PATH_ALREADY_EXISTS] Path {path} already exists. Set mode as 'overwrite' to overwrite the existing path.")
    job = uuid.uuid4().hex
    staging = f"{root}/_temporary/{job}"
    fs.create_dir(staging)
    try:
        done = df.mapInArrow(partial(_put, fs, staging, key.name, job), "folder string").collect()
        if mode == "overwrite":
            for old in fs.get_file_info(pafs.FileSelector(root)):
                if old.base_name != "_temporary":
                    fs.delete_dir(old.path) if old.type == pafs.FileType.Directory else fs.delete_file(old.path)
        folders = [f.path for r in done for f in fs.get_file_info(pafs.FileSelector(r.folder))]
        there = {f.base_name for f in fs.get_file_info(pafs.FileSelector(root))}
        fresh: dict[str, str] = {}
        for f in folders:
            fresh.setdefault(posixpath.basename(f), f)
        whole = [f for n, f in fresh.items() if n not in there]  # moved as they are; what follows for the same id is moved file by file
        rest = sorted({*folders} - {*whole})
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: fs.move(f, f"{root}/{posixpath.basename(f)}"), whole))
            list(pool.map(lambda f: [fs.move(x.path, f"{root}/{posixpath.basename(f)}/{x.base_name}") for x in fs.get_file_info(pafs.FileSelector(f))], rest))
        fs.open_output_stream(f"{root}/_SUCCESS").close()
    finally:
        fs.delete_dir(staging)
        if not fs.get_file_info(pafs.FileSelector(f"{root}/_temporary")):
            fs.delete_dir(f"{root}/_temporary")


def _put(fs: pafs.FileSystem, staging: str, name: str, job: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Writes the files of a task under a folder of the attempt, and gives that folder."""
    task, n = TaskContext.get(), 0
    folder = f"{staging}/{task.partitionId()}-{task.taskAttemptId()}"
    fs.create_dir(folder)
    for b in batches:
        for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = f"{folder}/{name}={_NULL if k is None else k}"
            fs.create_dir(own, recursive=False)
            with fs.open_output_stream(f"{own}/part-{task.partitionId():05d}-{n}-{job}.txt", compression=None) as f:
                f.write(f"{text or ''}\n".encode())
            n += 1
    yield pa.record_batch([pa.array([folder])], names=["folder"])


_NULL = "__HIVE_DEFAULT_PARTITION__"


def _place(spark: SparkSession, path: str) -> tuple[pafs.FileSystem, str, str] | None:
    """The file system of a path, the path in it and its URI, or None if pyarrow doesn't know it or it is a pattern."""
    if any(c in path for c in "*?[{"):
        return None
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p)
    uri = re.sub("^file:///", "file:/", p.toUri().toString())  # as in _metadata.file_path
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), p.toUri().getPath(), uri
    try:
        return *place(p.toString()), uri
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return None


def read(spark: SparkSession, path: str, flags: bool = True) -> DataFrame:
    """file, polygon and error of every file under the path, and the ids of folders written by ``write``."""
    t = _texts(spark, path)
    if t is None:
        t = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    t = t.withColumn("_read", from_text(F.col("value"), flags))
    return t.select(*[c for c in t.columns if c not in ("value", "_read")], "_read.polygon", "_read.error")


def _texts(spark: SparkSession, path: str) -> DataFrame | None:
    """value, id and file of the files in folders of whole ids; None if the path holds other things too."""
    found = _place(spark, path)
    if found is None or found[0].get_file_info(found[1]).type != pafs.FileType.Directory or spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") != "true":
        return None
    fs, root, uri = found
    held = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name[0] not in "_."]
    ids = [re.fullmatch(rf"(\w+)=(-?\d{{1,18}}|{_NULL})", f.base_name) if f.type == pafs.FileType.Directory else None for f in held]
    if not ids or None in ids or len({m[1] for m in ids}) > 1 or any(f.type == pafs.FileType.Directory for f in fs.get_file_info(pafs.FileSelector(held[0].path))):
        return None
    numbers = [None if m[2] == _NULL else int(m[2]) for m in ids]
    if all(k is None for k in numbers):
        return None
    kind = "int" if all(k is None or -(2**31) <= k < 2**31 for k in numbers) else "bigint"
    names = spark.createDataFrame(pa.table({"folder": [m[0] for m in ids], "id": pa.array(numbers, pa.int64())}))
    return names.mapInArrow(partial(_got, fs, root, uri, ids[0][1], pa.int32() if kind == "int" else pa.int64()), f"value string, {ids[0][1]} {kind}, file string")


#: Texts that go on to Spark at once: so many, or of so many bytes.
_MANY, _BYTES = 4096, 16 << 20


def _got(fs: pafs.FileSystem, root: str, uri: str, name: str, kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    batch = lambda: pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.string())], names=["value", name, "file"])
    for b in batches:
        for folder, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for f in fs.get_file_info(pafs.FileSelector(f"{root}/{folder}")):
                if f.base_name[0] in "_.":
                    continue
                if f.type == pafs.FileType.Directory:
                    raise ValueError(f"{f.path}: a folder beside files")
                with fs.open_input_stream(f.path) as s:
                    text = s.read()
                rows.append((text.decode(errors="replace"), k, f"{uri}/{folder}/{quote(f.base_name)}"))
                size += len(text)
                if len(rows) >= _MANY or size >= _BYTES:
                    yield batch()
                    rows, size = [], 0
    if rows:
        yield batch()
