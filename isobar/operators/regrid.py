"""Regridding by a stored index: weights from source to destination cells, filled once and applied to any number of fields, levels and times.

Weights are a sparse table (si, sj, di, dj, w): how much of the source cell's value the destination cell takes. A ``RegridIndex`` keeps such tables in a folder that all executors share, one Parquet partition for each
pair of grids, so that reading one touches nothing of the others; a fill replaces its partition as a whole, or leaves it as it was if it fails, and a second fill of the same pair does nothing. Applying is one join of the fields' cells with the index and
one aggregation by destination cell, with partial sums before the shuffle; it reads no geometry. A field of many levels and times meets the same index rows.

Weights come from places on the source grid (``bilinear``, ``nearest``), from boxes (fields.conservative_weights) or from the common parts of convex cells of two meshes (``conservative``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions import rings

from . import geometry, quadtree
from .globe import Globe


def nearest(places: DataFrame, x: str = "x", y: str = "y", globe: Globe | None = None) -> DataFrame:
    """Weights of destination cells (di, dj) at places on the source grid: 1 of the nearest cell, halves to the even side."""
    px, py = globe.place(F.col(x), F.col(y)) if globe else (F.col(x), F.col(y))
    p = places.withColumns({"si": F.rint(px).cast("long"), "sj": F.rint(py).cast("long"), "w": F.lit(1.0)})
    return _round(p, globe).select("si", "sj", "di", "dj", "w")


def bilinear(places: DataFrame, x: str = "x", y: str = "y", globe: Globe | None = None) -> DataFrame:
    """Weights of destination cells (di, dj) at places on the source grid: those of the four corners round it that are not 0."""
    px, py = globe.place(F.col(x), F.col(y)) if globe else (F.col(x), F.col(y))
    p = places.withColumns({"_x": px, "_y": py}).withColumns({"_i": F.floor("_x").cast("long"), "_j": F.floor("_y").cast("long")})
    fx, fy = F.col("_x") - F.col("_i"), F.col("_y") - F.col("_j")
    corner = lambda a, b: F.struct((F.col("_i") + a).alias("si"), (F.col("_j") + b).alias("sj"), ((fx if a else 1 - fx) * (fy if b else 1 - fy)).alias("w"))
    p = p.withColumn("c", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])))
    return _round(p.select("di", "dj", "c.*").filter("w > 0"), globe).select("si", "sj", "di", "dj", "w")


def _round(p: DataFrame, globe: Globe | None) -> DataFrame:
    """Source columns beyond the last one of a grid that goes round are those at its start."""
    if globe is None:
        return p
    _, wrap, turn, _ = globe.columns()
    return p.withColumn("si", F.when(wrap > 0, F.pmod("si", turn)).otherwise(F.col("si")))


def conservative(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Weights of source cells (si, sj, ring) over destination cells (di, dj, ring), both convex: the part of the source cell's area that lies in the destination cell.

    Candidates are pairs of cells whose boxes meet (quadtree.meetings); their common parts are cut out edge by edge, a batch of pairs at once (geometry.convex_areas). A source cell without area has no weights."""
    area = rings.area(F.col("sring"))
    s = source.select("si", "sj", F.col("ring").alias("sring")).repartition("si", "sj").withColumn("sbox", rings.envelope(F.col("sring"))).withColumn("sarea", area)
    d = destination.select("di", "dj", F.col("ring").alias("dring")).withColumn("dbox", rings.envelope(F.col("dring")))
    pairs = quadtree.meetings(s, d, "sbox", "dbox").select("si", "sj", "di", "dj", "sarea", "sring", "dring")
    return pairs.mapInArrow(_parts, pairs.select("si", "sj", "di", "dj", F.col("sarea").alias("w")).schema)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        with np.errstate(divide="ignore", invalid="ignore"):
            w = geometry.convex_areas(b.column("sring"), b.column("dring")) / b.column("sarea").to_numpy(zero_copy_only=False)
        some = (w > 0) & (w < np.inf)
        t = pa.RecordBatch.from_arrays([*(b.column(c) for c in ("si", "sj", "di", "dj")), pa.array(w)], ["si", "sj", "di", "dj", "w"])
        yield t.filter(pa.array(some))


class RegridIndex:
    """Weight tables by source and destination grid in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _partition(self, src: str, dst: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/dst={_escaped(dst)}/src={_escaped(src)}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, src: str, dst: str) -> bool:
        p, fs = self._partition(src, dst)
        return fs.exists(p)

    def fill(self, src: str, dst: str, weights: Callable[[], DataFrame], again: bool = False) -> bool:
        """Stores the weights of a pair of grids, unless they are there; whether it did. Rows of one source and destination cell are added up."""
        if self.has(src, dst) and not again:
            return False
        w = weights().groupBy("si", "sj", "di", "dj").agg(F.sum("w").alias("w"))
        w = w.select("*", F.lit(dst).alias("dst"), F.lit(src).alias("src"))
        w.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dst", "src").parquet(self.path)
        return True

    def weights(self, src: str, dst: str) -> DataFrame:
        w = self.spark.read.schema("si long, sj long, di long, dj long, w double, dst string, src string").parquet(self.path)
        return w.filter((F.col("dst") == dst) & (F.col("src") == src)).drop("dst", "src")

    def drop(self, src: str, dst: str) -> None:
        p, fs = self._partition(src, dst)
        fs.delete(p, True)

    def apply(self, field: DataFrame, src: str, dst: str, keys: list[str], how: str = "strict", value: Column | None = None) -> DataFrame:
        return apply(field, self.weights(src, dst), keys, how, value)


def _escaped(name: str) -> str:
    """The folder name that Spark gives a partition's value."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^" or ord(c) < 32 or ord(c) == 127 else c for c in name)


def apply(field: DataFrame, weights: DataFrame, keys: list[str], how: str = "strict", value: Column | None = None) -> DataFrame:
    """keys, di, dj and value: the sum of weight times value over a destination cell's source cells.

    ``strict``: null if any source cell of the destination cell is missing or null; ``there``: over those that are there, divided by their weights; ``sum``: their plain sum, as a conserved quantity needs."""
    v = F.col("v") if value is None else value
    f = field.select(*keys, F.col("i").alias("si"), F.col("j").alias("sj"), v.alias("_v")).filter("_v IS NOT NULL")
    out = f.join(weights, ["si", "sj"]).groupBy(*keys, "di", "dj").agg(F.sum(F.col("w") * F.col("_v")).alias("_s"), F.sum("w").alias("_w"), F.count("*").alias("_n"))
    s = F.col("_s")
    if how == "strict":
        out = out.join(weights.groupBy("di", "dj").agg(F.count("*").alias("_all")), ["di", "dj"])
        s = F.when(F.col("_n") == F.col("_all"), s)
    elif how == "there":
        s = s / F.nullif(F.col("_w"), F.lit(0.0))
    return out.select(*keys, "di", "dj", s.alias("value"))
