"""Gather interpolation: values of gridded cells (k, i, j, v) at points.

The corners of every grid square are brought together once, by one aggregation of cells dealt to the squares that they touch; points then meet
one row of their square. No join is on more than one row a point, and a grid that fits the broadcast threshold is broadcast by the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .globe import Globe, halo, inside


def squares(cells: DataFrame, keys: list[str], values: list[str] | None = None, level: str | None = None) -> DataFrame:
    """keys, i, j and, for each value (``v`` if none are named), a struct of the corners 00, 10, 01, 11 of the square from (i, j) to (i + 1, j + 1); with a level, of the eight corners 000 to 111 of the cube."""
    values, depth = values or ["v"], (0, 1) if level else (0,)
    d = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (0, 1) for b in (0, 1) for c in depth]))
    k = [(F.col(level) - F.col("d.c")).alias(level)] if level else []
    s = cells.withColumn("d", d).select(*keys, *k, (F.col("i") - F.col("d.a")).alias("i"), (F.col("j") - F.col("d.b")).alias("j"), "d", *values)
    name = lambda a, b, c: f"{a}{b}{c}" if level else f"{a}{b}"
    corner = lambda v, a, b, c: F.max(F.when((F.col("d.a") == a) & (F.col("d.b") == b) & (F.col("d.c") == c), F.col(v)))
    own = [*keys, *([level] if level else []), "i", "j"]
    return s.groupBy(*own).agg(*[F.struct(*[corner(v, a, b, c).alias(name(a, b, c)) for c in depth for a in (0, 1) for b in (0, 1)]).alias(f"_{v}") for v in values])


def _blend(corners: Column, fx: Column, fy: Column, end: str = "") -> Column:
    """Bilinear; a corner of weight 0 needn't exist."""
    right = lambda a, b: F.when(fx == 0, a).otherwise(a + (b - a) * fx)
    v = {n: corners[n + end] for n in ("00", "10", "01", "11")}
    low, high = right(v["00"], v["10"]), right(v["01"], v["11"])
    return F.when(fy == 0, low).otherwise(low + (high - low) * fy)


def bilinear(points: DataFrame, cells: DataFrame, keys: list[str], x: str = "x", y: str = "y", values: list[str] | None = None, globe: Globe | None = None) -> DataFrame:
    """points with ``value``, or with a column for each named value; null outside the grid or next to a missing cell. With a globe, whose columns (if it has any) both tables hold and are among the keys,
    places beyond an end or a pole are brought to the grid, and the last and the first column are neighbours."""
    cells = cells if globe is None else halo(cells, globe)
    p, px, py = _placed(points, x, y, globe)
    p = p.withColumns({"i": F.floor(px).cast("long"), "j": F.floor(py).cast("long")})
    j = p.join(squares(cells, keys, values), [*keys, "i", "j"], "left")
    fx, fy = px - F.col("i"), py - F.col("j")
    out = {v: _blend(F.col(f"_{v}"), fx, fy) for v in values} if values else {"value": _blend(F.col("_v"), fx, fy)}
    return j.withColumns(out).drop("i", "j", "_px", "_py", *[f"_{v}" for v in values or ["v"]])


def _placed(points: DataFrame, x: str, y: str, globe: Globe | None) -> tuple[DataFrame, Column, Column]:
    """points, and their places on the grid."""
    if globe is None:
        return points, F.col(x), F.col(y)
    px, py = globe.place(F.col(x), F.col(y))
    return points.withColumns({"_px": px, "_py": py}), F.col("_px"), F.col("_py")


def wind(points: DataFrame, cells: DataFrame, keys: list[str], factor: float = 1.0, globe: Globe | None = None, turn: bool = False) -> DataFrame:
    """points with u and v of a wind pair (cells' u, v) between cells, times a factor of unit, and speed and dir, the degrees that it blows from; cells without both don't count.
    On a globe, turn reverses the components for places beyond a pole, whose north is the other way; without it they are taken as they stand."""
    both = F.col("u").isNotNull() & F.col("v").isNotNull()
    w = bilinear(points, cells.filter(both), keys, values=["u", "v"], globe=globe)
    if globe is not None and turn:
        w = w.withColumns({c: F.when(globe.over(F.col("y")), -F.col(c)).otherwise(F.col(c)) for c in "uv"})
    w = w.withColumns({"u": F.col("u") * factor, "v": F.col("v") * factor})
    return w.withColumns({"speed": F.hypot("u", "v"), "dir": F.pmod(F.degrees(F.atan2(-F.col("u"), -F.col("v"))), F.lit(360.0))})


def curvilinear(hits: DataFrame, corners: DataFrame) -> DataFrame:
    """Points in quadrilaterals (nearest.quad_hits) with ``value`` from corners (qid, c0 to c3, in the quadrilateral's turn): bilinear, and over the corners that are there if some are missing."""
    u, v = F.col("u"), F.col("v")
    weight = [(1 - u) * (1 - v), (1 - u) * v, u * v, u * (1 - v)]
    there = [F.when(F.col(f"c{k}").isNotNull(), w).otherwise(0.0) for k, w in enumerate(weight)]
    total = there[0] + there[1] + there[2] + there[3]
    value = sum((F.coalesce(F.col(f"c{k}"), F.lit(0.0)) * w for k, w in enumerate(there)), F.lit(0.0)) / F.nullif(total, F.lit(0.0))
    return hits.join(corners, "qid").withColumn("value", value).drop("c0", "c1", "c2", "c3")


def sub_cells(cells: DataFrame, n: int) -> DataFrame:
    """The n x n places (i, j, part, x, y) of each cell at which a source is sampled: the centres of equal squares of the cell."""
    step = lambda c, k: F.col(c) - 0.5 + (F.col(k) + 0.5) / n
    s = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1)))).withColumns({"_a": F.col("part") % n, "_b": F.floor(F.col("part") / n)})
    return s.withColumns({"x": step("i", "_a"), "y": step("j", "_b")}).drop("_a", "_b")


def nearest(points: DataFrame, cells: DataFrame, keys: list[str], x: str = "x", y: str = "y", globe: Globe | None = None) -> DataFrame:
    """points with ``value`` of the nearest cell; halves go to the even side. With a globe, as in bilinear."""
    cells = cells if globe is None else halo(cells, globe)
    p, px, py = _placed(points, x, y, globe)
    p = p.withColumns({"i": F.rint(px).cast("long"), "j": F.rint(py).cast("long")})
    return p.join(cells.select(*keys, "i", "j", F.col("v").alias("value")), [*keys, "i", "j"], "left").drop("i", "j", "_px", "_py")


def trilinear(points: DataFrame, cells: DataFrame, x: str = "x", y: str = "y", z: str = "z", values: list[str] | None = None, globe: Globe | None = None) -> DataFrame:
    """points with ``value`` between the bilinear values of the levels below and above, or with a column for each named value, such as a vector's components. With a globe, as in bilinear."""
    cells = cells if globe is None else halo(cells, globe)
    p, px, py = _placed(points, x, y, globe)
    p = p.withColumns({"_k": F.floor(z).cast("long"), "i": F.floor(px).cast("long"), "j": F.floor(py).cast("long")})
    j = p.join(squares(cells.withColumnRenamed("k", "_k"), [], values, "_k"), ["_k", "i", "j"], "left")
    fx, fy, fz = px - F.col("i"), py - F.col("j"), F.col(z) - F.col("_k")

    def between(v: str) -> Column:
        low, high = _blend(F.col(f"_{v}"), fx, fy, "0"), _blend(F.col(f"_{v}"), fx, fy, "1")
        return F.when(fz == 0, low).otherwise(low + (high - low) * fz)

    out = {v: between(v) for v in values} if values else {"value": between("v")}
    return j.withColumns(out).drop("_k", "i", "j", "_px", "_py", *[f"_{v}" for v in values or ["v"]])


def neighbour_mean(cells: DataFrame, keys: list[str], centre: bool = True, globe: Globe | None = None) -> DataFrame:
    """For each cell the mean of the valid cells (v not null, mask not 0) of its 3 x 3 neighbourhood, with or without itself; on a globe, over its ends and poles."""
    if globe is not None:
        return inside(neighbour_mean(halo(cells, globe), keys, centre), globe)
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if centre or a or b]
    good = cells.filter(F.col("v").isNotNull() & (F.col("mask") != 0))
    d = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in near]))
    sums = good.withColumn("d", d).groupBy(*keys, (F.col("i") + F.col("d.a")).alias("i"), (F.col("j") + F.col("d.b")).alias("j")).agg(F.avg("v").alias("mean"))
    return cells.join(sums, [*keys, "i", "j"], "left")


def filled(cells: DataFrame, keys: list[str], globe: Globe | None = None) -> DataFrame:
    """cells with masked values replaced by the mean of their neighbourhood."""
    return neighbour_mean(cells, keys, globe=globe).withColumn("v", F.when(F.col("mask") == 0, F.col("mean")).otherwise(F.col("v"))).drop("mean")


def gradient(cells: DataFrame, keys: list[str], globe: Globe | None = None) -> DataFrame:
    """Central differences, lower minus upper neighbour, halved distance of one cell; the four neighbours come by one aggregation. On a globe, over its ends and poles."""
    if globe is not None:
        return inside(gradient(halo(cells, globe), keys), globe)
    sides = {"w": (1, 0), "e": (-1, 0), "s": (0, 1), "n": (0, -1)}
    d = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in sides.items()]))
    near = cells.withColumn("d", d).groupBy(*keys, (F.col("i") + F.col("d.a")).alias("i"), (F.col("j") + F.col("d.b")).alias("j")).agg(*[F.max(F.when(F.col("d.n") == n, F.col("v"))).alias(f"_{n}") for n in sides])
    return cells.join(near, [*keys, "i", "j"], "left").withColumns({"gx": (F.col("_w") - F.col("_e")) / 2, "gy": (F.col("_s") - F.col("_n")) / 2}).drop("_w", "_e", "_s", "_n")
