"""Tiles, brackets, columns in the vertical, time blends, quad keys and conservative weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiles(cells: DataFrame, keys: list[str], ni: int, nj: int, halo: int, width: int, height: int) -> DataFrame:
    """cells (i, j, v) dealt to tiles of ni x nj with halo cells around: tile number, origin (from 1) and place in the tile."""
    lo = lambda c, n: F.greatest(F.lit(0), F.floor((F.col(c) - halo) / n))
    hi = lambda c, n, m: F.least(F.lit((m - 1) // n), F.floor((F.col(c) + halo) / n))
    t = cells.withColumn("ti", F.explode(F.sequence(lo("i", ni), hi("i", ni, width)))).withColumn("tj", F.explode(F.sequence(lo("j", nj), hi("j", nj, height))))
    t = t.withColumns({"x0": F.greatest(F.lit(0), F.col("ti") * ni - halo), "y0": F.greatest(F.lit(0), F.col("tj") * nj - halo)})
    return t.select(*keys, (F.col("tj") * ((width - 1) // ni + 1) + F.col("ti") + 1).alias("tile"), (F.col("x0") + 1).alias("ig3"), (F.col("y0") + 1).alias("ig4"), (F.col("i") - F.col("x0")).alias("li"), (F.col("j") - F.col("y0")).alias("lj"), ((F.floor(F.col("i") / ni) == F.col("ti")) & (F.floor(F.col("j") / nj) == F.col("tj"))).alias("own"), "v")


def stitch(tiled: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of tiles, without their halos."""
    return tiled.filter("own").select(*keys, (F.col("ig3") - 1 + F.col("li")).alias("i"), (F.col("ig4") - 1 + F.col("lj")).alias("j"), "v")


def bracket(value: Column, levels: Column) -> Column:
    """Index from 0 of the last of ascending levels that is not above value; -1 before the first."""
    return F.size(F.filter(levels, lambda x: x <= value)) - 1


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, order: str = "t", span: int = 86400) -> DataFrame:
    """left (keys, at) with the last right row (keys, order, ...) at or before it; of right rows of one time, the largest in its other columns' order.

    Rows of a key meet in time order within spans of ``span`` by one union and one window, so a hot key is cut in spans, and none is multiplied; what a span begins with is the last right row of the spans before."""
    payload = F.struct(order, *[c for c in right.columns if c not in [*keys, order]])
    l_type, r_type = left.select(F.struct(*left.columns).alias("p")).schema["p"].dataType, right.select(payload.alias("p")).schema["p"].dataType
    u = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(r_type).alias("_r"))
    u = u.unionByName(right.select(*keys, F.col(order).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l_type).alias("_l"), payload.alias("_r"))).withColumn("_span", F.floor(F.col("_t") / span))
    ends = u.filter("_side = 0").groupBy(*keys, "_span").agg(F.max("_r").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ends = u.groupBy(*keys, "_span").agg(F.count("*").alias("_n")).join(ends, [*keys, "_span"], "left").withColumn("_early", F.last("_last", ignorenulls=True).over(before)).select(*keys, "_span", "_early")
    w = Window.partitionBy(*keys, "_span").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1").join(ends, [*keys, "_span"])
    return u.select("_l.*", F.coalesce("_r", "_early").alias("before"))


def time_blend(series: DataFrame, keys: list[str], at: str, value: str, seconds: int, span: int = 86400) -> DataFrame:
    """Values at multiples of ``seconds`` between consecutive rows of a series, linear in time; the earlier row's own time is included. Rows follow each other within spans of time; the last of a span is followed by the first of the next."""
    w = Window.partitionBy(*keys, "_span").orderBy(at)
    s = series.withColumn("_span", F.floor(F.col(at) / span))
    first = s.groupBy(*keys, "_span").agg(F.min(F.struct(F.col(at).alias("t"), F.col(value).alias("v"))).alias("_first"))
    first = first.withColumn("_next", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_span"))).drop("_first")
    s = s.withColumn("_n", F.lead(F.struct(F.col(at).alias("t"), F.col(value).alias("v"))).over(w)).join(first, [*keys, "_span"]).withColumn("_n", F.coalesce("_n", "_next")).filter("_n IS NOT NULL")
    s = s.withColumns({"t1": F.col("_n.t"), "v1": F.col("_n.v")})
    first = F.ceil(F.col(at) / seconds) * seconds
    s = s.withColumn("last", F.floor((F.col("t1") - 1) / seconds) * seconds).filter(first <= F.col("last"))
    s = s.withColumn("time", F.explode(F.sequence(first, F.col("last"), F.lit(seconds).cast("bigint"))))
    f = (F.col("time") - F.col(at)) / (F.col("t1") - F.col(at))
    return s.withColumn("blend", F.col(value) * (1 - f) + F.col("v1") * f).select(*keys, "time", "blend")


def column_interpolate(columns: DataFrame, targets: Column, how: str = "linear", lapse: tuple[float, float] | None = None) -> DataFrame:
    """columns with arrays z (ascending) and v, with ``out``: v at each target. how: linear, nearest, cubic (Lagrange on four), or derivatives (cubic through values v and slopes d). Beyond the ends v is held (clamped), or goes on by a lapse rate (below, above)."""

    def at(x: Column) -> Column:
        n, b = F.size("z"), bracket(x, F.col("z"))
        k = F.greatest(F.lit(0), F.least(b, n - 2))
        z = lambda d: F.element_at("z", k + 1 + d)
        v = lambda d: F.element_at("v", k + 1 + d)
        inner = F.when(n < 2, F.element_at("v", 1))
        line = v(0) + (v(1) - v(0)) * (x - z(0)) / F.nullif(z(1) - z(0), F.lit(0.0))
        if how == "nearest":
            mid = F.when(x - z(0) <= z(1) - x, v(0)).otherwise(v(1))
        elif how == "cubic":
            term = lambda d: v(d) * _product([(x - z(o)) / (z(d) - z(o)) for o in (-1, 0, 1, 2) if o != d])
            mid = F.when((k >= 1) & (k <= n - 3), term(-1) + term(0) + term(1) + term(2)).otherwise(line)
        elif how == "derivatives":
            d, h = (lambda k_: F.element_at("d", k + 1 + k_)), z(1) - z(0)
            f = (x - z(0)) / F.nullif(h, F.lit(0.0))
            mid = (1 + 2 * f) * (1 - f) * (1 - f) * v(0) + f * f * (3 - 2 * f) * v(1) + f * (1 - f) * (1 - f) * h * d(0) - f * f * (1 - f) * h * d(1)
        else:
            mid = line
        if lapse:
            low, high = F.element_at("v", 1) + lapse[0] * (x - F.element_at("z", 1)), F.element_at("v", n) + lapse[1] * (x - F.element_at("z", n))
            inner = F.when(x < F.element_at("z", 1), low).when(x > F.element_at("z", n), high).when(n < 2, F.element_at("v", 1))
        return inner.when(x <= F.element_at("z", 1), F.element_at("v", 1)).when(x >= F.element_at("z", n), F.element_at("v", n)).otherwise(mid)

    return columns.withColumn("out", F.transform(targets, at))


def _product(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out * p
    return out


def pressure_cube(surface: DataFrame, levels: list[float], kind: str, p0: str = "p0", log: bool = False) -> DataFrame:
    """A row for each row and level: k, level, pressure (or its logarithm)."""
    from isobar.functions import expr

    c = surface.select("*", F.posexplode(F.array(*[F.lit(float(v)) for v in levels])).alias("k", "level"))
    p = expr.column(expr.level_to_pressure(kind, "level", p0))
    return c.withColumn("pressure", F.log(p) if log else p)


def quad_key(x: Column, y: Column, box: tuple[float, float, float, float], depth: int) -> Column:
    """Digits 0 to 3 (south-west, south-east, north-west, north-east) of the nested half-open boxes down to depth; null outside."""
    x0, y0, x1, y1 = box
    n = 1 << depth
    qx, qy = F.floor((x - x0) / (x1 - x0) * n).cast("bigint"), F.floor((y - y0) / (y1 - y0) * n).cast("bigint")
    bit = lambda q, d: F.shiftright(q, depth - 1 - d).bitwiseAND(F.lit(1))
    key = F.concat(*[(bit(qx, d) + 2 * bit(qy, d)).cast("string") for d in range(depth)])
    return F.when((x >= x0) & (x < x1) & (y >= y0) & (y < y1), key)


def quad_neighbours(key: Column, corners: bool = False) -> Column:
    """Keys of the boxes of the same depth to the south, east, north and west of a quad key, then with corners south-west, south-east, north-east and north-west; null beyond the box of all."""
    digits = F.transform(F.split(key, ""), lambda c: c.cast("bigint"))
    number = lambda bit: F.aggregate(digits, F.lit(0).cast("bigint"), lambda s, d: s * 2 + F.shiftright(d, bit).bitwiseAND(F.lit(1)))
    depth, qx, qy = F.length(key), number(0), number(1)
    n = F.pow(F.lit(2.0), depth).cast("bigint")

    def at(dx: int, dy: int) -> Column:
        x, y = qx + dx, qy + dy
        digit = lambda k: F.floor(x / F.pow(F.lit(2.0), depth - k)).cast("bigint") % 2 + 2 * (F.floor(y / F.pow(F.lit(2.0), depth - k)).cast("bigint") % 2)
        whole = F.array_join(F.transform(F.sequence(F.lit(1), depth), lambda k: digit(k).cast("string")), "")
        return F.when((x >= 0) & (y >= 0) & (x < n) & (y < n), whole)

    return F.array(*[at(*d) for d in [(0, -1), (1, 0), (0, 1), (-1, 0)] + [(-1, -1), (1, -1), (1, 1), (-1, 1)] * corners])


def conservative_weights(source: DataFrame, dx: float, dy: float) -> DataFrame:
    """Source boxes (sid, x0, y0, x1, y1) over a regular destination grid: sid, i, j and the part of the source's area in the cell."""
    s = source.withColumn("i", F.explode(F.sequence(F.floor(F.col("x0") / dx), F.ceil(F.col("x1") / dx) - 1))).withColumn("j", F.explode(F.sequence(F.floor(F.col("y0") / dy), F.ceil(F.col("y1") / dy) - 1)))
    w = F.least("x1", (F.col("i") + 1) * dx) - F.greatest("x0", F.col("i") * dx)
    h = F.least("y1", (F.col("j") + 1) * dy) - F.greatest("y0", F.col("j") * dy)
    return s.withColumn("w", w * h / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).filter("w > 0").select("sid", "i", "j", "w")


def conservative(values: DataFrame, weights: DataFrame, normalised: bool = False) -> DataFrame:
    """Sum of value times weight a destination cell; divided by the sum of weights if normalised."""
    j = values.join(weights, "sid").groupBy("i", "j").agg(F.sum(F.col("value") * F.col("w")).alias("s"), F.sum("w").alias("f"))
    return j.select("i", "j", (F.col("s") / F.nullif(F.col("f"), F.lit(0.0)) if normalised else F.col("s")).alias("value"))


def pressure_to_hybrid(pressure: Column, p0: Column, ptop: float = 10.0, pref: float = 800.0, rcoef: float = 1.6, steps: int = 50) -> Column:
    """Hybrid level of a pressure, by halving [ptop / pref, 1] a fixed number of times: the formula rises with the level, so this can't diverge at the top as Newton's steps do."""
    rt = ptop / pref
    at = lambda level: pref * level + (p0 - pref) * F.pow(F.greatest(F.lit(0.0), (level - rt) / (1 - rt)), F.lit(rcoef))

    def halve(s, _):
        m = (s.lo + s.hi) / 2
        above = at(m) > pressure
        return F.struct(F.when(above, s.lo).otherwise(m).alias("lo"), F.when(above, m).otherwise(s.hi).alias("hi"))

    start = F.struct(F.lit(rt).alias("lo"), F.lit(1.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s.lo + s.hi) / 2)
