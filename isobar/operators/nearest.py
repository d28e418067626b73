"""Exact k nearest points by buckets of all sizes, the weighted means of them, and lookups in meshes of triangles and of quadrilaterals.

Each point starts with buckets as wide as its leaf of a quadtree over the targets (quadtree.leaves), whose leaves hold at most k targets, so what it meets follows k and not the number of targets, however these crowd. It meets the targets of the 3 x 3 buckets round it; if it
has k of them within the distance to the outer edge, no other can be nearer, and it is done. The others go on to buckets twice as wide, nine again; the widest nine hold every target. Points of all levels go through a
round together: targets are dealt to each level that there are points of. With a period, x goes round: buckets beyond one end are those at the other, and differences of half a period or more are taken the other way. Distances are squared degrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quadtree
from .shared import discard, stored


def around(d: Column, period: float | None) -> Column:
    """A difference of x, the short way round."""
    return d if period is None else F.when(d >= period / 2, d - period).when(d <= -period / 2, d + period).otherwise(d)


def _extent(points: DataFrame, targets: DataFrame) -> float:
    """The larger side of the box of all points and targets."""
    every = points.select("lon", "lat").unionByName(targets.select(F.col("tx").alias("lon"), F.col("ty").alias("lat")))
    x0, x1, y0, y1 = every.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    return max(x1 - x0, y1 - y0) if x0 is not None else 0.0


def k_nearest(points: DataFrame, targets: DataFrame, k: int, cell: float | None = None, period: float | None = 360.0) -> DataFrame:
    """points (id, lon, lat) with target (its id), d2 and rank from 1; ties go to the smaller target id. period is None on a plane. With cell, all points start with buckets of about that side instead of their leaves'."""
    t = targets.select(F.col("id").alias("target"), F.col("lon").alias("tx"), F.col("lat").alias("ty"))
    p, done = points.select("id", "lon", "lat"), None
    whole, wrap = period or max(_extent(p, t), cell or 1e-9), period is not None
    if cell:
        p = p.withColumn("level", F.lit(max(0, math.floor(math.log2(whole / cell)))))
    else:
        tree = stored(quadtree.leaves(t, whole, k, x="tx", y="ty", period=wrap), "leaves")
        known = quadtree.leaf_of(p, tree, whole, "lon", "lat", wrap).select("id", F.col("level").alias("l"))
        p = stored(p.join(known, "id", "left").select("id", "lon", "lat", F.coalesce("l", F.lit(0)).cast("int").alias("level")), "open")
        discard(tree)
    bucket = lambda c, period=False: quadtree.bucket(F.col(c), whole, F.col("level"), period)
    while True:
        levels = [r["level"] for r in p.select("level").distinct().collect()]
        n, size = F.pow(F.lit(2.0), "level").cast("bigint"), F.lit(float(whole)) / F.pow(F.lit(2.0), "level")
        xs = [F.pmod(bucket("lon", True) + d, n) if wrap else bucket("lon") + d for d in (-1, 0, 1)]
        near = p.withColumn("bx", F.explode(F.array_distinct(F.array(*xs)))).withColumn("by", F.explode(F.array(*[bucket("lat") + d for d in (-1, 0, 1)])))
        at = t.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumns({"bx": bucket("tx", wrap), "by": bucket("ty")})
        near = near.join(at, ["level", "bx", "by"])
        dx, dy = around(F.col("lon") - F.col("tx"), period), F.col("lat") - F.col("ty")
        order = Window.partitionBy("id").orderBy("d2", "target")
        got = near.withColumn("d2", dx * dx + dy * dy).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("id", "lon", "lat", "level", "target", "d2", "rank")
        if levels in ([], [0]):
            found = got.select("id", "target", "d2", "rank")
            return found if done is None else done.unionByName(found)
        x = F.pmod(F.col("lon"), F.lit(float(whole))) if wrap else F.col("lon")
        side = lambda v, c, period: [v - (bucket(c, period) - 1) * size, (bucket(c, period) + 2) * size - v]
        across = F.least(*side(x, "lon", wrap))
        edge = F.least(F.when(n > 3, across).otherwise(F.lit(float("inf"))) if wrap else across, *side(F.col("lat"), "lat", False))  # up to three buckets go all the way round
        sure = got.groupBy("id").agg(F.max("d2").alias("far"), F.count("*").alias("n"), F.first(edge).alias("edge"), F.first("level").alias("level"))
        sure = sure.filter((F.col("level") == 0) | (F.col("n") == k) & (F.col("far") < F.col("edge") * F.col("edge"))).select("id")
        found = stored(got.join(sure, "id", "left_semi").select("id", "target", "d2", "rank"), "near")
        done = found if done is None else done.unionByName(found)
        last, p = p, stored(p.filter("level > 0").join(found.select("id").distinct(), "id", "left_anti").withColumn("level", F.col("level") - 1), "open")
        discard(last)


def weighted(near: DataFrame, values: DataFrame, how: list[str]) -> DataFrame:
    """Barnes or Cressman means (``barnes``, ``cressman``) of ``value`` over each point's nearest, in one aggregation; the search radius is the farthest one's distance."""
    n = near.withColumn("r", F.max("d2").over(Window.partitionBy("id"))).join(values.select(F.col("id").alias("target"), "value"), "target")
    d, r = F.col("d2"), F.col("r")
    w = {"barnes": F.exp(-F.lit(14.2 * 3.141592653589793) * d * d / F.nullif(r * r, F.lit(0.0))), "cressman": (1.001 * r - d) / (1.001 * r + d)}
    w = {h: F.coalesce(w[h], F.lit(1.0)) for h in how}
    return n.groupBy("id").agg(*[(F.sum(w[h] * F.col("value")) / F.sum(w[h])).alias(h) for h in how])


def _met(points: DataFrame, shapes: DataFrame, corners: int) -> DataFrame:
    """Points with the shapes (corners x0.., y0..) whose box's buckets hold them."""
    ends = {f"{c}{n}": f(*[F.col(f"{c}{k}") for k in range(corners)]) for n, f in ((0, F.least), (1, F.greatest)) for c in "xy"}
    dealt = quadtree.box_buckets(shapes.withColumn("_box", F.struct(*[v.alias(k) for k, v in ends.items()])), "_box")
    return quadtree.point_buckets(points, dealt).join(dealt, ["level", "bx", "by"]).drop("level", "bx", "by", "_box")


def _first(hits: DataFrame, shape: str) -> DataFrame:
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(shape))).filter("_r = 1").drop("_r")


def triangle_hits(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """points (id, x, y) with the triangle (tid, corners x0..y2) that holds them and its barycentric weights b0, b1, b2; the smallest tid where several do.

    Triangles are dealt to the buckets of their size that their boxes touch (quadtree.box_buckets), so the join is an equality of buckets."""
    from isobar.functions import expr

    j = _met(points, triangles, 3)
    b = [expr.column(w) for w in expr.barycentric("x", "y", [(f"x{n}", f"y{n}") for n in range(3)])]
    j = j.withColumns({f"b{n}": b[n] for n in range(3)}).filter("b0 >= -1E-5 AND b1 >= -1E-5 AND b2 >= -1E-5")
    return _first(j, "tid")


def quad_hits(points: DataFrame, quads: DataFrame) -> DataFrame:
    """points (id, x, y) with the quadrilateral (qid, corners x0..y3 in turn, the first at (0, 0), the next at (0, 1)) of a curvilinear grid that holds them, and their place u, v in it; the smallest qid where several do."""
    from isobar.functions import expr

    j = _met(points, quads, 4)
    j = j.withColumn("_place", expr.column(expr.quad_place("x", "y", [(f"x{n}", f"y{n}") for n in range(4)]))).withColumns({c: F.col(f"_place.{c}") for c in "uv"}).drop("_place")
    j = j.filter("u BETWEEN -1E-9 AND 1.000000001D AND v BETWEEN -1E-9 AND 1.000000001D")
    return _first(j, "qid")
