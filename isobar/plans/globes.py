"""Queries over quadtrees that follow density, and over grids that go round: three references of the events' field, one with ends, one that goes round and one that repeats its first column."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar.operators import gather, gridref, quadtree
from isobar.operators.globe import Globe

from .grids import CELLS, LAT, LON, event_cells, points, query, r, read

GLOBE = Globe("ni", 24, "wrap")
KEYS = ["g", "k", "ni", "wrap"]


def _reference(df):
    """Grid g (0 to 2) with its columns ni and its wrap, which its longitudes tell: 16 columns 10 degrees apart, 16 that go round, and 17 of which the last repeats the first."""
    step = F.when(F.col("g") == 0, 10.0).otherwise(22.5)
    d = df.withColumn("ni", F.when(F.col("g") == 2, 17).otherwise(16))
    return d.withColumn("wrap", gridref.wrap_kind(gridref.uniform_axis(F.lit(-180.0), step, F.col("ni"))))


def _cells(spark, sf_dir):
    """The events' field on each grid; the third holds column 16 with other values, which the first column overrules."""
    c = event_cells(spark, sf_dir).withColumn("g", F.explode(F.array(*[F.lit(x) for x in range(3)])))
    last = c.filter("g = 2 AND i = 0").withColumns({"i": F.lit(16).cast("long"), "v": F.col("v")})
    return _reference(c.unionByName(last))


def _points(spark, sf_dir):
    """Places of all events, up to 8 columns beyond both ends and 4 rows beyond both poles."""
    e = read(spark, sf_dir, "events").selectExpr("event_id AS id", "CAST(event_id % 3 AS INT) AS g", "CAST(1 + event_id % 29 AS BIGINT) AS k", "CAST((event_id * 37) % 3200 AS DOUBLE) / 100 - 8 AS x", "CAST((event_id * 53) % 3100 AS DOUBLE) / 100 - 4 AS y", "CAST(1 + event_id % 28 AS DOUBLE) + CAST(event_id % 4 AS DOUBLE) / 4 AS z")
    return _reference(e)


_P = "p AS (SELECT event_id AS id, event_id % 3 AS g, 1 + event_id % 29 AS k, CAST((event_id * 37) % 3200 AS DOUBLE) / 100 - 8 AS x0, CAST((event_id * 53) % 3100 AS DOUBLE) / 100 - 4 AS y0, CAST(1 + event_id % 28 AS DOUBLE) + CAST(event_id % 4 AS DOUBLE) / 4 AS z FROM events), f AS (SELECT *, CASE WHEN g > 0 AND y0 < 0 THEN -y0 WHEN g > 0 AND y0 > 23 THEN 46 - y0 ELSE y0 END AS y, CASE WHEN g > 0 AND (y0 < 0 OR y0 > 23) THEN x0 + 8 ELSE x0 END AS x1 FROM p), q AS (SELECT *, CASE WHEN g = 0 THEN x1 WHEN x1 < 0 THEN x1 + 16 WHEN x1 >= 16 THEN x1 - 16 ELSE x1 END AS x FROM f)"
_AT = "LEFT JOIN cells {a} ON {a}.k = {k} AND {a}.i = {i} AND {a}.j = {j}"
_NEXT = "CASE WHEN q.g > 0 AND floor(x) = 15 THEN 0 ELSE floor(x) + 1 END"
_FOUR = " ".join([_AT.format(a="a", k="{k}", i="floor(x)", j="floor(y)"), _AT.format(a="b", k="{k}", i=_NEXT, j="floor(y)"), _AT.format(a="c", k="{k}", i="floor(x)", j="floor(y) + 1"), _AT.format(a="d", k="{k}", i=_NEXT, j="floor(y) + 1")])
_MIX = "CASE WHEN y = floor(y) THEN {low} ELSE {low} + ({high} - {low}) * (y - floor(y)) END".format(low="(CASE WHEN x = floor(x) THEN a.{v} ELSE a.{v} + (b.{v} - a.{v}) * (x - floor(x)) END)", high="(CASE WHEN x = floor(x) THEN c.{v} ELSE c.{v} + (d.{v} - c.{v}) * (x - floor(x)) END)")


@query("globe_bilinear", f"WITH {CELLS}, {_P} SELECT q.id, round({_MIX.format(v='v')}, 6) AS value FROM q {_FOUR.format(k='q.k')}")
def globe_bilinear(spark, sf_dir):
    return gather.bilinear(_points(spark, sf_dir), _cells(spark, sf_dir), KEYS, globe=GLOBE).select("id", r(F.col("value")).alias("value"))


@query("globe_nearest", f"WITH {CELLS}, {_P} SELECT q.id, round(a.v, 6) AS value FROM q LEFT JOIN cells a ON a.k = q.k AND a.j = round_even(y, 0) AND a.i = CASE WHEN q.g > 0 AND round_even(x, 0) = 16 THEN 0 ELSE round_even(x, 0) END")
def globe_nearest(spark, sf_dir):
    return gather.nearest(_points(spark, sf_dir), _cells(spark, sf_dir), KEYS, globe=GLOBE).select("id", r(F.col("value")).alias("value"))


@query("globe_trilinear", f"WITH {CELLS}, {_P}, lo AS (SELECT q.id, z, {_MIX.format(v='v')} AS v FROM q {_FOUR.format(k='floor(z)')} WHERE q.g = 1), hi AS (SELECT q.id, {_MIX.format(v='v')} AS v FROM q {_FOUR.format(k='(floor(z) + 1)')} WHERE q.g = 1) SELECT lo.id, round(CASE WHEN z = floor(z) THEN lo.v ELSE lo.v + (hi.v - lo.v) * (z - floor(z)) END, 6) AS value FROM lo JOIN hi ON lo.id = hi.id")
def globe_trilinear(spark, sf_dir):
    """The places of the grid that goes round, between levels."""
    p = _points(spark, sf_dir).filter("g = 1").drop("g", "k", "ni", "wrap")
    return gather.trilinear(p, event_cells(spark, sf_dir), globe=Globe(16, 24, 1)).select("id", r(F.col("value")).alias("value"))


_W = "wind AS (SELECT k, i, j, v * sin(radians(CAST(7 * i + j AS DOUBLE))) AS u, v * cos(radians(CAST(7 * i + j AS DOUBLE))) AS v FROM cells)"


@query("globe_wind", f"WITH {CELLS}, {_W}, {_P}, w AS (SELECT q.id, {_MIX.format(v='u')} AS u, {_MIX.format(v='v')} AS v FROM q {_FOUR.format(k='q.k').replace('JOIN cells', 'JOIN wind')}) SELECT id, round(u, 6) + 0 AS u, round(v, 6) + 0 AS v, round(sqrt(u * u + v * v), 6) AS speed FROM w")
def globe_wind(spark, sf_dir):
    turn = F.radians((7 * F.col("i") + F.col("j")).cast("double"))
    c = _cells(spark, sf_dir)
    c = c.withColumns({"u": F.col("v") * F.sin(turn), "v": F.col("v") * F.cos(turn)})
    out = gather.wind(_points(spark, sf_dir), c, KEYS, globe=GLOBE)
    return out.select("id", r(F.col("u")).alias("u"), r(F.col("v")).alias("v"), r(F.col("speed")).alias("speed"))


_BOX = "n AS (SELECT c.g, c.k, c.i, c.j, c.v, c.mask, a.di, b.dj, c.i + a.di AS x1, c.j + b.dj AS y1 FROM m c, (VALUES (-1), (0), (1)) a(di), (VALUES (-1), (0), (1)) b(dj)), o AS (SELECT *, CASE WHEN g > 0 AND y1 < 0 THEN -y1 WHEN g > 0 AND y1 > 23 THEN 46 - y1 ELSE y1 END AS y, CASE WHEN g > 0 THEN (x1 + CASE WHEN y1 < 0 OR y1 > 23 THEN 8 ELSE 0 END + 16) % 16 ELSE x1 END AS x FROM n)"
_GRIDS = f"{CELLS}, m AS (SELECT CAST(g AS INT) AS g, cells.*, CASE WHEN (i * 7 + j * 3 + k) % 5 = 0 THEN 0 ELSE 1 END AS mask FROM cells, range(3) t(g))"


@query("globe_fill", f"WITH {_GRIDS}, {_BOX} SELECT o.g, o.k, o.i, o.j, round(CASE WHEN o.mask = 0 THEN avg(e.v) ELSE o.v END, 6) AS v FROM o LEFT JOIN m e ON e.g = o.g AND e.k = o.k AND e.i = o.x AND e.j = o.y AND e.mask <> 0 GROUP BY o.g, o.k, o.i, o.j, o.mask, o.v")
def globe_fill(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("mask", F.when((F.col("i") * 7 + F.col("j") * 3 + F.col("k")) % 5 == 0, 0).otherwise(1))
    return gather.filled(c, KEYS, globe=GLOBE).select("g", "k", "i", "j", r(F.col("v")).alias("v"))


@query("globe_gradient", f"WITH {_GRIDS}, {_BOX}, e AS (SELECT o.g, o.k, o.i, o.j, di, dj, t.v AS w FROM o LEFT JOIN m t ON t.g = o.g AND t.k = o.k AND t.i = o.x AND t.j = o.y) SELECT g, k, i, j, round((max(w) FILTER (di = -1 AND dj = 0) - max(w) FILTER (di = 1 AND dj = 0)) / 2, 6) + 0 AS gx, round((max(w) FILTER (dj = -1 AND di = 0) - max(w) FILTER (dj = 1 AND di = 0)) / 2, 6) + 0 AS gy FROM e GROUP BY g, k, i, j")
def globe_gradient(spark, sf_dir):
    return gather.gradient(_cells(spark, sf_dir), KEYS, globe=GLOBE).select("g", "k", "i", "j", r(F.col("gx")).alias("gx"), r(F.col("gy")).alias("gy"))


_TREE = "n AS (SELECT CAST(level AS INT) AS level, CAST(floor(lon / 360 * 2 ** level) AS BIGINT) AS bx, CAST(floor(lat / 360 * 2 ** level) AS BIGINT) AS \"by\", CAST(count(*) AS BIGINT) AS n FROM t, range({depth} + 1) r(level) GROUP BY ALL), c AS (SELECT level + 1 AS level, 2 * bx + a AS bx, 2 * \"by\" + b AS \"by\" FROM n, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b) WHERE n > {most} AND level < {depth}), leaves AS (SELECT c.level, c.bx, c.\"by\", coalesce(n.n, 0) AS n FROM c LEFT JOIN n ON n.level = c.level AND n.bx = c.bx AND n.\"by\" = c.\"by\" WHERE coalesce(n.n, 0) <= {most} OR c.level = {depth} UNION ALL SELECT * FROM n WHERE level = 0 AND n <= {most})"


@query("quad_leaves", f"WITH t AS (SELECT {LON.format(k='c_custkey')} AS lon, {LAT.format(k='c_custkey')} AS lat FROM customer), {_TREE.format(depth=12, most=8)} SELECT * FROM leaves")
def quad_leaves(spark, sf_dir):
    """Leaves of at most 8 customers."""
    return quadtree.leaves(points(read(spark, sf_dir, "customer"), "c_custkey"), 360.0, 8, 12, "lon", "lat")


@query("quad_leaf_points", f"WITH t AS (SELECT {LON.format(k='s_suppkey')} AS lon, {LAT.format(k='s_suppkey')} AS lat FROM supplier), p AS (SELECT c_custkey AS id, {LON.format(k='c_custkey')} AS lon, {LAT.format(k='c_custkey')} AS lat FROM customer), {_TREE.format(depth=12, most=4)} SELECT p.id, l.level, l.bx, l.\"by\", l.n FROM p JOIN leaves l ON l.bx = floor(lon / 360 * 2 ** l.level) AND l.\"by\" = floor(lat / 360 * 2 ** l.level)")
def quad_leaf_points(spark, sf_dir):
    """Each customer's leaf of the suppliers' tree."""
    tree = quadtree.leaves(points(read(spark, sf_dir, "supplier"), "s_suppkey"), 360.0, 4, 12, "lon", "lat")
    p = points(read(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), "lon", "lat")
    return quadtree.leaf_of(p, tree, 360.0, "lon", "lat").select("id", "level", "bx", "by", "n")
