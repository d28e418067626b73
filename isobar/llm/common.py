"""Helpers shared by the operators of this subpackage.

Text work is done on whole Arrow batches: ``utf8`` exposes the bytes of a string column as one numpy
array and ``slices`` cuts it into runs of rows of bounded size, so that memory follows the slice and
not the batch. Words are the runs ``[^\\x20\\x09-\\x0D]+`` of the text after A-Z are lower-cased.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
SAMPLE_BYTES, BROADCAST_ROWS = 256 << 20, 1 << 18
_own_dir: list[str] = []

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)  # masks of the first k bytes of a block


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only where none is set, which a cluster must not do."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="isobar-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and any executor can read it. Shuffle files of the job go when it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, names) -> dict[str, str]:
    """For each name one that no column of df has."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return {n: f"{mark}{n}" for n in names}


def tidy(run):
    """run, a function of an iterator of batches, so that its worker, which others use after it, gives memory back at its end."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def trim() -> None:
    """Gives memory that is free back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the row offsets into them; a null is an empty text."""
    col = pc.fill_null(col, "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offsets, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(offsets, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (i, j) of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that are not in space; the offsets index data."""
    if not len(data):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    inside = ~space[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    first, last = off[:-1][full], off[1:][full] - 1
    start[first] = inside[first]
    end[last] = inside[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word, from its blocks of 8 bytes: each is mixed with its place, so no words that differ are alike by their structure."""
    if not len(s):
        return np.zeros(0, dtype=np.uint64)
    raw = np.concatenate([_LOWER[data] if lower else data, np.zeros(8, dtype=np.uint8)])
    blocks = np.ndarray(len(data) + 1, dtype="<u8", buffer=raw, strides=(1,))
    size = e - s
    out = mix((blocks[s] & _BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * _BASE)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        first = np.cumsum(more) - more
        place = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        x = blocks[np.repeat(s[long], more) + 8 * place] & _BYTES[np.minimum(np.repeat(size[long], more) - 8 * place, 8)]
        out[long] = mix(out[long] + np.add.reduceat(mix(x ^ mix(place.astype(np.uint64) * _BASE)), first))
    return out


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of n words; a row of 1 to n - 1 words has its whole sequence as one."""
    odd = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(n)]
    count = np.bincount(row, minlength=n_rows)
    if len(h) >= n:
        out = h[: len(h) - n + 1] * odd[0]
        for k in range(1, n):
            out = out + h[k : len(h) - n + 1 + k] * odd[k]
        ok = row[: len(h) - n + 1] == row[n - 1 :]
        out, rows = mix(out[ok]), row[: len(h) - n + 1][ok]
    else:
        out, rows = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        first = np.cumsum(count) - count
        extra = np.array([int(count[r]) for r in few], dtype=np.uint64)
        for k in range(n - 1):
            has = count[few] > k
            extra[has] = extra[has] + h[first[few][has] + k] * odd[k]
        out, rows = np.concatenate([out, mix(extra ^ np.uint64(0x5851F42D4C957F2D))]), np.concatenate([rows, few])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def row_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row the sorted distinct shingle hashes."""
    s, e, row = words(data, off)
    out, rows = shingles(word_hashes(data, s, e), row, len(off) - 1, n)
    cut = np.searchsorted(rows, np.arange(len(off)))
    return [np.unique(out[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, per_class: int) -> DataFrame:
    """At most per_class rows (doc_id, y, text, prior, spread) of each class, or all; learning ends with them.

    Of a class, those ids are taken whose hash, spread, is smallest; one text of each, that of the smallest hash. prior is the share of the class among all labelled ids of the fold.
    A doc_id with several labels has its largest; null labels and ids are left out.
    """
    y = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & fold).groupBy("doc_id").agg(F.max(label).cast("string").alias("y"))
    return sampled(docs.select("doc_id", "text"), y, ["doc_id"], per_class)


def sampled(docs: DataFrame, y: DataFrame, on: list[str], per_class: int, most: int | None = None) -> DataFrame:
    """The sample of docs for the classes of y (doc_id, y), joined by the columns on; of many classes per_class is ``most`` dealt evenly, at least 1. No class is left out."""
    counts = y.groupBy(F.col("y").alias("c")).agg(F.count("*").alias("n"))
    total, classes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    per_class = max(1, min(per_class, most // max(1, classes))) if most else per_class
    few = lambda t, n: F.broadcast(t) if n <= BROADCAST_ROWS else t
    spread = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    near = y.withColumn("spread", spread).join(few(counts, classes), F.col("y") == F.col("c")).filter(F.col("spread") * F.col("n") < F.lit((2 * per_class + 20) << 30))
    rank = F.row_number().over(Window.partitionBy("y").orderBy("spread", "doc_id"))
    chosen = near.withColumn("rank", rank).filter(F.col("rank") <= per_class).select("doc_id", "y", "spread", (F.col("n") / F.lit(max(1, total))).alias("prior"))
    return docs.join(few(chosen, classes * per_class), on).groupBy("doc_id", "y", "prior", "spread").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fitted(sample: DataFrame, fit) -> bytes:
    """fit(texts as Arrow string array, y as list of str, prior as list of float) -> bytes, run in one task over a bounded sample.

    Only the sample goes to that task, sorted by spread; of a class it keeps texts until they have ``SAMPLE_BYTES`` over the number of classes, whole texts and at least one.
    """
    classes = max(1, sample.select("y").distinct().count())

    def run(batches):
        kept, held = [], {}
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()
            take = []
            for k, (y, n) in enumerate(zip(b.column("y").to_pylist(), size)):
                if held.get(y, 0) < SAMPLE_BYTES // classes:
                    held[y] = held.get(y, 0) + n
                    take.append(k)
            kept.append(b.take(pa.array(take, pa.int64())))
        t = pa.Table.from_batches(kept) if kept else None
        t = t.take(np.lexsort((t.column("spread").to_numpy(), t.column("doc_id").to_numpy()))) if t else None
        blob = fit(t.column("text").cast(pa.large_string()).combine_chunks() if t else pa.array([], pa.large_string()), t.column("y").to_pylist() if t else [], t.column("prior").to_pylist() if t else [])
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["model"])

    one = sample.select("doc_id", "text", "y", "prior", "spread").repartition(1).sortWithinPartitions("spread", "doc_id", "y")
    got = one.mapInArrow(tidy(run), "model binary").collect()
    return bytes(got[0]["model"]) if got else fit(pa.array([], pa.large_string()), [], [])  # a table without partitions runs no task


def crc_fold(column: str, mod: int) -> Column:
    """crc32 of the id's text, modulo mod."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(mod))
