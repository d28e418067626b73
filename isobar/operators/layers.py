"""Vector layers onto grids: features (fid, ring or line, value) to cells (i, j), the unit squares round whole numbers.

A feature is dealt to the cells of its envelope within the grid, and its part of each is a closed formula on its vertices, inside the JVM; features then
meet by one aggregation of cells. ``parts`` can be kept as a table and used again for other modes and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions import rings


def parts(features: DataFrame, ni: int, nj: int, shape: str = "ring", length: bool = False, keep: tuple[str, ...] = (), whole: Column | None = None) -> DataFrame:
    """fid, the kept columns, i, j, part and whole: the area (or an open line's length) of each feature in each cell of a grid of ni x nj, and in all; cells without any have no row. A line along the sides of cells lies in those on both sides of it. ``whole`` can be given where it is known better than far from the origin (rounding errors of the vertices)."""
    g = F.col("g")
    own = rings.length(F.col(shape), closed=False) if length else rings.area(F.col(shape))
    e = features.select("fid", *keep, F.col(shape).alias("g"), rings.envelope(F.col(shape)).alias("e"), (own if whole is None else whole).alias("whole"))
    first, last = (lambda v: F.greatest(F.lit(0), F.ceil(v - 0.5) if length else F.floor(v + 0.5))), (lambda v, n: F.least(F.lit(n - 1), F.floor(v + 0.5)))
    e = e.filter((F.col("e.x1") >= -0.5) & (F.col("e.y1") >= -0.5) & (F.col("e.x0") <= ni - 0.5) & (F.col("e.y0") <= nj - 0.5))
    e = e if length else e.filter((F.col("e.x0") < ni - 0.5) & (F.col("e.y0") < nj - 0.5))
    e = e.withColumn("i", F.explode(F.sequence(first(F.col("e.x0")), last(F.col("e.x1"), ni)))).withColumn("j", F.explode(F.sequence(first(F.col("e.y0")), last(F.col("e.y1"), nj))))
    box = (F.col("i") - 0.5, F.col("j") - 0.5, F.col("i") + 0.5, F.col("j") + 0.5)
    part = rings.length_in_box(g, *box) if length else rings.area_in_box(g, *box)
    return e.select("fid", *keep, "i", "j", part.alias("part"), "whole").filter("part > 1E-12")


def _weight(mode: str) -> Column:
    return {"within": F.when(F.col("part") > 1 - 1e-9, 1.0), "intersect": F.lit(1.0), "aliased": F.col("part"), "conservative": F.col("part") / F.nullif(F.col("whole"), F.lit(0.0))}[mode]


def weights(held: DataFrame, mode: str) -> DataFrame:
    """fid, i, j and w of parts, by mode: the share of the cell (aliased) or of the feature (conservative), or 1 if the cell lies inside (within) or in any case (intersect)."""
    return held.select("fid", "i", "j", _weight(mode).alias("w")).filter("w IS NOT NULL")


def burn_modes(held: DataFrame, modes: dict[str, tuple[str, str, bool]], value: str = "value") -> DataFrame:
    """mode, i, j, v of several ways at once: from parts that kept their features' values, each named mode (weights' mode, how to combine, whether normalised; as in burn) is a column of one aggregation of cells."""
    v, columns = F.col(value).cast("double"), []
    for name, (mode, combine, normalised) in modes.items():
        w = _weight(mode)
        columns += [_combined(combine, v * w, w, normalised).alias(f"_v_{name}"), F.count(w).alias(f"_n_{name}")]
    out = held.groupBy("i", "j").agg(*columns)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("mode"), F.col(f"_v_{n}").alias("v"), F.col(f"_n_{n}").alias("n")) for n in modes]))
    return out.select("i", "j", each.alias("m")).filter("m.n > 0").select("m.mode", "i", "j", "m.v")


def _combined(combine: str, x: Column, w: Column, normalised: bool) -> Column:
    total = F.sum(x) / (F.nullif(F.sum(w), F.lit(0.0)) if normalised else F.lit(1.0))
    return {"sum": total, "average": F.avg(x), "min": F.min(x), "max": F.max(x), "replace": F.max_by(x, F.when(w.isNotNull(), F.col("fid")))}[combine]


def centroids(features: DataFrame, ni: int, nj: int, shape: str = "ring") -> DataFrame:
    """fid, i, j and w (1) of the cell that holds each feature's centroid; one on the line between two cells, but for rounding errors, belongs to the upper one."""
    at = lambda v: F.floor(F.col(v) + (0.5 + 1e-9))
    c = features.select("fid", rings.centroid(F.col(shape)).alias("c")).select("fid", at("c.x").alias("i"), at("c.y").alias("j"), F.lit(1.0).alias("w"))
    return c.filter((F.col("i") >= 0) & (F.col("i") < ni) & (F.col("j") >= 0) & (F.col("j") < nj))


def burn(weighted: DataFrame, features: DataFrame, value: Column, combine: str = "sum", normalised: bool = False) -> DataFrame:
    """i, j, v of the cells of features' weights: each feature's value times its weight, combined: sum, average, min, max or replace (the largest fid's); sums divided by the cell's weights if normalised."""
    p = weighted.join(features.select("fid", value.cast("double").alias("_v")), "fid")
    return p.groupBy("i", "j").agg(_combined(combine, F.col("_v") * F.col("w"), F.col("w"), normalised).alias("v"))


def cell_ring(i: Column, j: Column, steps: int = 1) -> Column:
    """Outline of a cell, with steps points a side, from its lower left corner round."""
    sides = [(-0.5, -0.5, 1, 0), (0.5, -0.5, 0, 1), (0.5, 0.5, -1, 0), (-0.5, 0.5, 0, -1)]
    return F.array(*[rings.point(i + (x + dx * k / steps), j + (y + dy * k / steps)) for x, y, dx, dy in sides for k in range(steps)])


def scan(cells: DataFrame, window: tuple[int, int, int, int], corners: bool = False) -> DataFrame:
    """The cells of a window (x0, y0, x1, y1, its ends included) in scan order, ``n`` from 0, with their place x, y, or with corners their four: ``c`` from 0, lower left first."""
    x0, y0, x1, y1 = window
    c = cells.filter(F.col("i").between(x0, x1) & F.col("j").between(y0, y1)).withColumn("n", (F.col("j") - y0) * (x1 - x0 + 1) + F.col("i") - x0)
    if not corners:
        return c.withColumns({"x": F.col("i").cast("double"), "y": F.col("j").cast("double")})
    return c.select("*", F.posexplode(cell_ring(F.col("i"), F.col("j"))).alias("c", "p")).withColumns({"x": F.col("p.x"), "y": F.col("p.y")}).drop("p")
