"""Queries over winds, curvilinear grids, vector layers, projections and rings, each with a separately written SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar.functions import expr, rings
from isobar.operators import fields, gather, gridref, layers, nearest

from .grids import CELLS, LAT, LON, PTS, _BILINEAR, _CORNERS, event_cells, event_points, points, query, r, read
from .registry import SQL
from .shapes import shapes


@query(
    "grid_wind",
    f"WITH {CELLS}, {PTS}, b AS (SELECT pts.id, ({_BILINEAR} - 240) * 0.514444e0 AS u, (120 - ({_BILINEAR}) / 2) * 0.514444e0 AS v FROM pts {_CORNERS.format(k='pts.k')}) "
    "SELECT id, round(u, 6) + 0 AS u, round(v, 6) + 0 AS v, round(sqrt(u * u + v * v), 6) AS speed FROM b",
)
def grid_wind(spark, sf_dir):
    c = event_cells(spark, sf_dir).select("k", "i", "j", (F.col("v") - 240).alias("u"), (120 - F.col("v") / 2).alias("v"))
    w = gather.wind(event_points(spark, sf_dir), c, ["k"], 0.514444)
    return w.select("id", r(F.col("u")).alias("u"), r(F.col("v")).alias("v"), r(F.col("speed")).alias("speed"))


@query(
    "fn_wind",
    # grid north is the course to the grid's pole, at latitude 90 - 30 and longitude 60 + 180
    f"WITH p AS (SELECT c_custkey AS id, radians({LON.format(k='c_custkey')}) AS o, radians({LAT.format(k='c_custkey')}) AS a, CAST(c_custkey % 21 AS DOUBLE) - 10 AS u, CAST(c_custkey % 13 AS DOUBLE) - 6 AS v FROM customer), "
    "n AS (SELECT *, atan2(sin(radians(240) - o) * cos(radians(60)), cos(a) * sin(radians(60)) - sin(a) * cos(radians(60)) * cos(radians(240) - o)) AS b FROM p) "
    "SELECT id, round(u * cos(b) + v * sin(b), 6) + 0 AS u, round(v * cos(b) - u * sin(b), 6) + 0 AS v FROM n",
)
def fn_wind(spark, sf_dir):
    """Winds along the axes of a rotated grid, turned to the east and north."""
    p = points(read(spark, sf_dir, "customer"), "c_custkey").selectExpr("c_custkey AS id", "lon", "lat", "CAST(c_custkey % 21 AS DOUBLE) - 10 AS u", "CAST(c_custkey % 13 AS DOUBLE) - 6 AS v")
    g = expr.rotate("lat", "lon", 30.0, 60.0)
    p = p.withColumns({"glat": expr.column(g[0]), "glon": expr.column(g[1])})
    u, v = expr.wind_unrotate("lat", "lon", "glat", "glon", "u", "v", 30.0, 60.0)
    return p.select("id", r(expr.column(u)).alias("u"), r(expr.column(v)).alias("v"))


@query("grid_trilinear_pair", f"SELECT id, round(value * 2 + 1, 10) AS u, round(5 - value, 10) AS w FROM ({SQL['grid_trilinear'].replace(', 6) AS value', ', 13) AS value')})")
def grid_trilinear_pair(spark, sf_dir):
    c = event_cells(spark, sf_dir).select("k", "i", "j", (F.col("v") * 2 + 1).alias("u"), (5 - F.col("v")).alias("w"))
    return gather.trilinear(event_points(spark, sf_dir), c, values=["u", "w"]).select("id", r(F.col("u"), 10).alias("u"), r(F.col("w"), 10).alias("w"))


@query(
    "grid_curvilinear",
    f"WITH p AS (SELECT c_custkey AS id, ({LAT.format(k='c_custkey')} + 85) / 10 AS b, ({LON.format(k='c_custkey')} + 180 - ({LAT.format(k='c_custkey')} + 85) / 5) / 10 AS a FROM customer), "
    "q AS (SELECT id, CAST(floor(a) AS BIGINT) AS i, CAST(floor(b) AS BIGINT) AS j, a - floor(a) AS u, b - floor(b) AS v FROM p WHERE a >= 0 AND a < 36 AND b >= 0 AND b < 17), "
    "c AS (SELECT q.*, d.i AS di, d.j AS dj, (CASE WHEN d.i = 1 THEN u ELSE 1 - u END) * (CASE WHEN d.j = 1 THEN v ELSE 1 - v END) AS w FROM q, (VALUES (0, 0), (0, 1), (1, 1), (1, 0)) d(i, j)), "
    "e AS (SELECT id, w, CASE WHEN (i + di + j + dj) % 13 = 0 THEN NULL ELSE CAST(((i + di) * 7 + (j + dj) * 3) % 11 AS DOUBLE) END AS f FROM c) "
    "SELECT id, round(sum(w * f) / nullif(sum(CASE WHEN f IS NULL THEN 0 ELSE w END), 0), 5) AS value FROM e GROUP BY id",
)
def grid_curvilinear(spark, sf_dir):
    """Points in a sheared lattice, some of whose corners are masked."""
    g = spark.range(36).withColumnRenamed("id", "i").crossJoin(spark.range(17).withColumnRenamed("id", "j"))
    turn = [(0, 0), (0, 1), (1, 1), (1, 0)]
    at = lambda d, e: ((F.col("i") + d) * 10.0 - 180 + (F.col("j") + e) * 2.0, (F.col("j") + e) * 10.0 - 85)
    quads = g.select((F.col("j") * 36 + F.col("i")).alias("qid"), *[c.alias(f"{n}{k}") for k, d in enumerate(turn) for n, c in zip("xy", at(*d))])
    f = lambda d, e: F.when((F.col("i") + d + F.col("j") + e) % 13 != 0, (((F.col("i") + d) * 7 + (F.col("j") + e) * 3) % 11).cast("double"))
    corners = g.select((F.col("j") * 36 + F.col("i")).alias("qid"), *[f(*d).alias(f"c{k}") for k, d in enumerate(turn)])
    p = points(read(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return gather.curvilinear(nearest.quad_hits(p, quads), corners).select("id", r(F.col("value"), 5).alias("value"))


# the shapes of the layer, L of two rectangles, in cells of 5 degrees; what a cell holds of each rectangle
_LAYER = f"""s AS (SELECT s_suppkey AS fid, s_acctbal AS value, ({LON.format(k='s_suppkey')} + 180) / 5 AS x, ({LAT.format(k='s_suppkey')} + 90) / 5 AS y, (4e0 + s_suppkey % 7) / 5 AS w, (3e0 + s_suppkey % 5) / 5 AS h FROM supplier),
g AS (SELECT i, j FROM range(73) a(i), range(37) b(j)),
o AS (SELECT s.*, i, j, greatest(0, least(x + w, i + 0.5e0) - greatest(x, i - 0.5e0)) * greatest(0, least(y + h / 2, j + 0.5e0) - greatest(y, j - 0.5e0))
  + greatest(0, least(x + w / 2, i + 0.5e0) - greatest(x, i - 0.5e0)) * greatest(0, least(y + h, j + 0.5e0) - greatest(y + h / 2, j - 0.5e0)) AS part,
  CASE WHEN y >= j - 0.5e0 AND y <= j + 0.5e0 THEN greatest(0, least(x + w, i + 0.5e0) - greatest(x, i - 0.5e0)) ELSE 0 END
  + CASE WHEN x + w >= i - 0.5e0 AND x + w <= i + 0.5e0 THEN greatest(0, least(y + h / 2, j + 0.5e0) - greatest(y, j - 0.5e0)) ELSE 0 END AS len
  FROM s JOIN g ON i + 0.5e0 >= x AND i - 0.5e0 <= x + w AND j + 0.5e0 >= y AND j - 0.5e0 <= y + h)"""


def _layer(spark, sf_dir):
    s = points(read(spark, sf_dir, "supplier"), "s_suppkey").withColumns({"x": (F.col("lon") + 180) / 5, "y": (F.col("lat") + 90) / 5, "w": (F.lit(4.0) + F.col("s_suppkey") % 7) / 5, "h": (F.lit(3.0) + F.col("s_suppkey") % 5) / 5})
    x, y, w, h = (F.col(c) for c in "xywh")
    zero = F.lit(0.0)
    ring = [(zero, zero), (w, zero), (w, h / 2), (w / 2, h / 2), (w / 2, h), (zero, h)]
    at = lambda ps: F.array(*[rings.point(x + a, y + b) for a, b in ps])
    return s.select(F.col("s_suppkey").alias("fid"), F.col("s_acctbal").alias("value"), at(ring).alias("ring"), at(ring[:3]).alias("line"), rings.area(F.array(*[rings.point(*p) for p in ring])).alias("area"))


@query(
    "layer_cells",
    f"WITH {_LAYER}, m AS (SELECT 'aliased' AS mode, i, j, sum(value * part) AS v FROM o WHERE part > 1e-12 GROUP BY i, j UNION ALL SELECT 'conservative', i, j, sum(value * part / (w * h * 0.75e0)) FROM o WHERE part > 1e-12 GROUP BY i, j "
    "UNION ALL SELECT 'normalised', i, j, sum(value * part) / sum(part) FROM (SELECT i, j, value, part / (w * h * 0.75e0) AS part FROM o WHERE part > 1e-12) GROUP BY i, j UNION ALL SELECT 'within', i, j, avg(value) FROM o WHERE part > 1 - 1e-9 GROUP BY i, j "
    "UNION ALL SELECT 'highest', i, j, max(value) FROM o WHERE part > 1e-12 GROUP BY i, j UNION ALL SELECT 'last', i, j, arg_max(value, fid) FROM o WHERE part > 1e-12 GROUP BY i, j UNION ALL SELECT 'length', i, j, sum(value * len / (w + h / 2)) FROM o WHERE len > 1e-12 GROUP BY i, j "
    "UNION ALL SELECT 'centroid', CAST(floor(x + (w / 2 * 2 + w / 4) / 3 + 0.5e0) AS BIGINT) AS ci, CAST(floor(y + (h / 4 * 2 + h * 3 / 4) / 3 + 0.5e0) AS BIGINT) AS cj, sum(value) FROM s WHERE floor(x + (w / 2 * 2 + w / 4) / 3 + 0.5e0) < 73 AND floor(y + (h / 4 * 2 + h * 3 / 4) / 3 + 0.5e0) < 37 GROUP BY ci, cj) "
    "SELECT mode, i, j, round(v, 7) + 0 AS v FROM m",
)
def layer_cells(spark, sf_dir):
    f = _layer(spark, sf_dir)
    ways = {"aliased": ("aliased", "sum", False), "conservative": ("conservative", "sum", False), "normalised": ("conservative", "sum", True), "within": ("within", "average", False), "highest": ("intersect", "max", False), "last": ("intersect", "replace", False)}
    out = layers.burn_modes(layers.parts(f, 73, 37, keep=("value",), whole=F.col("area")), ways)
    out = out.unionByName(layers.burn_modes(layers.parts(f, 73, 37, "line", length=True, keep=("value",)), {"length": ("conservative", "sum", False)}))
    out = out.unionByName(layers.burn(layers.centroids(f, 73, 37), f, F.col("value")).withColumn("mode", F.lit("centroid")))
    return out.select("mode", "i", "j", r(F.col("v"), 7).alias("v"))


@query(
    "grid_samples",
    f"WITH {CELLS}, s AS (SELECT k, i, j, a, b, CASE WHEN i >= 2 AND i <= 9 AND j >= 3 AND j <= 12 THEN (j - 3) * 8 + i - 2 END AS n FROM cells, range(3) x(a), range(3) y(b)) "
    "SELECT k, i, j, CAST(b * 3 + a AS INT) AS part, round(i - 0.5 + (a + 0.5) / 3, 9) AS x, round(j - 0.5 + (b + 0.5) / 3, 9) AS y, n FROM s WHERE n IS NOT NULL",
)
def grid_samples(spark, sf_dir):
    """The nine places at which each cell of a window is sampled."""
    c = layers.scan(event_cells(spark, sf_dir), (2, 3, 9, 12)).drop("x", "y")
    return gather.sub_cells(c, 3).select("k", "i", "j", "part", r(F.col("x"), 9).alias("x"), r(F.col("y"), 9).alias("y"), "n")


@query("grid_outlines", f"WITH {CELLS}, d AS (SELECT * FROM (VALUES (0, -0.5e0, -0.5e0), (1, 0.5e0, -0.5e0), (2, 0.5e0, 0.5e0), (3, -0.5e0, 0.5e0)) t(c, dx, dy)) SELECT k, (j - 1) * 3 + i - 4 AS n, CAST(c AS INT) AS c, i + dx AS x, j + dy AS y FROM cells, d WHERE i >= 4 AND i <= 6 AND j >= 1 AND j <= 20")
def grid_outlines(spark, sf_dir):
    """The corners of each cell of a window."""
    return layers.scan(event_cells(spark, sf_dir), (4, 1, 6, 20), corners=True).select("k", "n", "c", "x", "y")


@query(
    "grid_project",
    "WITH p AS (SELECT p_partkey, CAST(p_partkey % 41 AS DOUBLE) / 10 - 0.45 AS x, CAST(p_size % 36 AS DOUBLE) / 10 - 0.25 AS y FROM part), "
    "g AS (SELECT *, radians(CASE WHEN x < 1 THEN 10 * x WHEN x < 2 THEN 10 + 15 * (x - 1) ELSE 25 + 20 * (x - 2) END) AS o, radians(CASE WHEN y < 1 THEN -30 + 20 * y WHEN y < 2 THEN -10 + 10 * (y - 1) ELSE 20 * (y - 2) END) AS a FROM p), "
    "s AS (SELECT *, sin(a) * cos(radians(30)) + cos(a) * cos(o) * sin(radians(30)) AS z, atan2(cos(a) * sin(o), cos(a) * cos(o) * cos(radians(30)) - sin(a) * sin(radians(30))) AS l FROM g) "
    "SELECT p_partkey, round(degrees(asin(z)), 6) + 0 AS lat, round(degrees(atan2(sin(l + radians(60)), cos(l + radians(60)))), 6) + 0 AS lon, round(x, 6) AS x, round(y, 6) AS y, x <= 3.5 AND y >= -0.5 AS on_grid FROM s",
)
def grid_project(spark, sf_dir):
    """Places of a rotated grid with uneven axes to latitude and longitude, and back."""
    axis = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    p = read(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") % 41).cast("double") / 10 - 0.45).alias("x"), ((F.col("p_size") % 36).cast("double") / 10 - 0.25).alias("y"), axis(0, 10, 25, 45).alias("lons"), axis(-30, -10, 0, 20).alias("lats"))
    p = gridref.project(p, rotation=(30.0, 60.0)).drop("x", "y")
    return gridref.unproject(p, rotation=(30.0, 60.0)).select("p_partkey", r(F.col("lat")).alias("lat"), r(F.col("lon")).alias("lon"), r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), "on_grid")


@query(
    "grid_windows",
    f"WITH s AS (SELECT s_suppkey, {LON.format(k='s_suppkey')} AS lon0, {LAT.format(k='s_suppkey')} AS lat0 FROM supplier), b AS (SELECT *, CASE WHEN s_suppkey % 9 = 0 THEN lon0 + 360 ELSE lon0 + 25 END AS lon1, lat0 + 12 AS lat1 FROM s) "
    "SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE greatest(0, round((lon0 + 120) / 10, 9)) END AS i0, greatest(0, round((lat0 + 60) / 5, 9)) AS j0, CASE WHEN s_suppkey % 9 = 0 THEN 24 ELSE least(24, round((lon1 + 120) / 10, 9)) END AS i1, least(24, round((lat1 + 60) / 5, 9)) AS j1 FROM b",
)
def grid_windows(spark, sf_dir):
    """A box of latitudes and longitudes at each supplier, in places of a grid."""
    s = points(read(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    s = s.withColumns({"lon1": F.when(F.col("s_suppkey") % 9 == 0, F.col("lon0") + 360).otherwise(F.col("lon0") + 25), "lat1": F.col("lat0") + 12})
    s = s.withColumns({"lons": gridref.uniform_axis(F.lit(-120.0), F.lit(10.0), F.lit(25)), "lats": gridref.uniform_axis(F.lit(-60.0), F.lit(5.0), F.lit(25))})
    return gridref.index_box(s, ["s_suppkey"]).select("s_suppkey", *[r(F.col(c), 9).alias(c) for c in ("i0", "j0", "i1", "j1")])


@query(
    "grid_overlap",
    f"WITH s AS (SELECT s_suppkey, {LON.format(k='s_suppkey')} AS x, {LAT.format(k='s_suppkey')} AS y FROM supplier), b AS (SELECT s_suppkey, x + 6 * a AS x, y + 4 * c AS y FROM s, range(5) p(a), range(4) q(c) WHERE a IN (0, 4) OR c IN (0, 3)), "
    "u AS (SELECT s_suppkey, (x + 120) / 10 AS x, (y + 60) / 5 AS y FROM b), i AS (SELECT * FROM u WHERE x >= -0.5 AND x <= 24.5 AND y >= -0.5 AND y <= 24.5) "
    "SELECT s_suppkey, CAST(min(greatest(0, least(24, floor(x)))) AS INT) AS x0, CAST(min(greatest(0, least(24, floor(y)))) AS INT) AS y0, CAST(max(greatest(0, least(24, ceil(x)))) AS INT) AS x1, CAST(max(greatest(0, least(24, ceil(y)))) AS INT) AS y1 FROM i GROUP BY s_suppkey",
)
def grid_overlap(spark, sf_dir):
    """The window of a grid that covers a small grid at each supplier, by its border."""
    s = points(read(spark, sf_dir, "supplier"), "s_suppkey").crossJoin(spark.range(5).withColumnRenamed("id", "a")).crossJoin(spark.range(4).withColumnRenamed("id", "c")).filter("a IN (0, 4) OR c IN (0, 3)")
    s = s.withColumns({"lon": F.col("lon") + 6 * F.col("a"), "lat": F.col("lat") + 4 * F.col("c"), "lons": gridref.uniform_axis(F.lit(-120.0), F.lit(10.0), F.lit(25)), "lats": gridref.uniform_axis(F.lit(-60.0), F.lit(5.0), F.lit(25))})
    return gridref.overlap(s, ["s_suppkey"])


@query(
    "grid_pole_dims",
    "SELECT s_suppkey, CAST(j AS INT) AS j, round(CASE WHEN abs(lat) = 90 THEN pi() * 6371000 * radians(10) / 36 ELSE 2 * 6371000 * asin(cos(radians(lat)) * sin(radians(5))) END, 2) AS dx, round(6371000 * radians(10), 2) AS dy "
    "FROM (SELECT s_suppkey, j, j * 10e0 - 90 AS lat FROM supplier, range(19) b(j))",
)
def grid_pole_dims(spark, sf_dir):
    """Cell dimensions along each supplier's meridian, from pole to pole."""
    s = points(read(spark, sf_dir, "supplier"), "s_suppkey")
    g = s.select("s_suppkey", F.array("lon").alias("lons"), gridref.uniform_axis(F.lit(-90.0), F.lit(10.0), F.lit(19)).alias("lats"))
    return gridref.cell_dims(gridref.cells(g, ["s_suppkey"]), 10.0, 10.0).select("s_suppkey", "j", r(F.col("dx"), 2).alias("dx"), r(F.col("dy"), 2).alias("dy"))


@query(
    "mesh_areas",
    f"WITH g AS (SELECT DISTINCT CAST(floor(({LON.format(k='s_suppkey')} + 180) / 10) AS BIGINT) AS i, CAST(floor(({LAT.format(k='s_suppkey')} + 90) / 10) AS BIGINT) AS j FROM supplier), h AS (SELECT i, j, j * 10e0 - 90 AS y FROM g), "
    "t AS (SELECT [j * 37 + i, j * 37 + i + 1, (j + 1) * 37 + i + 1] AS v, radians(10) * (sin(radians(y + 10)) - sin(radians(y))) / 2 AS half FROM h "
    "UNION ALL SELECT [j * 37 + i, (j + 1) * 37 + i + 1, (j + 1) * 37 + i], radians(10) * (sin(radians(y + 10)) - sin(radians(y))) / 2 FROM h), u AS (SELECT unnest(v) AS vertex, half FROM t) SELECT vertex, round(sum(half) * 6371000 * 6371000 / 3, -3) AS area FROM u GROUP BY vertex",
)
def mesh_areas(spark, sf_dir):
    """Areas of the vertices of a mesh of two triangles in each 10 degree cell with suppliers; the diagonal cuts a cell's area in halves, and a third of each goes to its corners."""
    s = points(read(spark, sf_dir, "supplier"), "s_suppkey")
    g = s.select(F.floor((F.col("lon") + 180) / 10).alias("i"), F.floor((F.col("lat") + 90) / 10).alias("j")).distinct().withColumns({"x": F.col("i") * 10.0 - 180, "y": F.col("j") * 10.0 - 90})
    at = lambda k, d, e: [((F.col("j") + e) * 37 + F.col("i") + d).alias(f"v{k}"), (F.col("x") + 10 * d).alias(f"x{k}"), (F.col("y") + 10 * e).alias(f"y{k}")]
    t = g.select(*at(0, 0, 0), *at(1, 1, 0), *at(2, 1, 1)).unionByName(g.select(*at(0, 0, 0), *at(1, 1, 1), *at(2, 0, 1)))
    return gridref.mesh_areas(t).select("vertex", F.round("area", -3).alias("area"))


@query("grid_turned", "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 2 + 8 + 256 WHEN s_suppkey % 3 = 1 THEN 2 + 8 + 32 + 256 ELSE 2 + 8 + 64 + 256 END AS INT) AS mask FROM supplier")
def grid_turned(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(k == 2, "V").otherwise("Z").alias("grtyp"), gridref.uniform_axis(F.lit(-180.0), F.lit(10.0), F.lit(36)).alias("lons"), F.when(k == 0, 0.0).otherwise(0.5).alias("lean"))
    return s.select("s_suppkey", gridref.flags(F.col("grtyp"), F.col("lons"), gridref.turned((F.lit(-180.0), F.lit(-180.0) + F.col("lean")), (F.lit(170.0), F.lit(170.0)))).alias("mask"))


@query(
    "ring_wraps",
    f"WITH s AS (SELECT s_suppkey AS sid, {LON.format(k='s_suppkey')} AS x, 4e0 + s_suppkey % 7 AS w, 3e0 + s_suppkey % 5 AS h FROM supplier), "
    "o AS (SELECT *, greatest(0, x + w - 180) AS a, greatest(0, x + w / 2 - 180) AS b FROM s) SELECT sid, CAST(CASE WHEN a > 0 THEN 2 ELSE 1 END AS INT) AS parts, round(a * h / 2 + b * h / 2, 5) + 0 AS beyond, round(w * h * 0.75e0, 5) AS area FROM o",
)
def ring_wraps(spark, sf_dir):
    """Shapes cut at the date line; what lies beyond it."""
    s = shapes(spark, sf_dir).select("sid", rings.wrap_split(rings.wrap(F.col("ring"), -180.0, 180.0), -180.0, 180.0).alias("parts"), F.col("lon"))
    far = F.aggregate(F.filter("parts", lambda p: rings.envelope(p).x0 < F.col("lon") - 20), F.lit(0.0), lambda t, p: t + rings.area(p))
    whole = F.aggregate("parts", F.lit(0.0), lambda t, p: t + rings.area(p))
    return s.select("sid", F.size("parts").alias("parts"), r(far, 5).alias("beyond"), r(whole, 5).alias("area"))


@query(
    "ring_meetings",
    f"WITH s AS (SELECT s_suppkey AS sid, {LON.format(k='s_suppkey')} AS x, {LAT.format(k='s_suppkey')} AS y, 4e0 + s_suppkey % 7 AS w, 3e0 + s_suppkey % 5 AS h FROM supplier) "
    "SELECT sid, CAST(2 AS INT) AS n, round(x, 6) + 0 AS first_x, round(1 / (w + 2), 8) AS first_t, round((w / 2 + 1) / (w + 2), 8) AS last_t, true AS line, sid % 2 = 0 AS ray FROM s",
)
def ring_meetings(spark, sf_dir):
    """A level segment through the upper part of each shape, and lines that touch its envelope or point away from it."""
    s = shapes(spark, sf_dir).withColumn("e", rings.envelope(F.col("ring")))
    x, y, w, h = F.col("lon"), F.col("lat"), F.col("w"), F.col("h")
    a, b = rings.point(x - 1, y + h * 0.75), rings.point(x + w + 1, y + h * 0.75)
    s = s.withColumns({"m": rings.meeting_points(F.col("ring"), a, b), "line": rings.box_meets_line(F.col("e"), a, b)})
    away = F.when(F.col("sid") % 2 == 0, x + 1).otherwise(x - 3)
    s = s.withColumn("ray", rings.box_meets_line(F.col("e"), a, rings.point(away, y + h * 0.75), directed=True))
    return s.select("sid", F.size("m").alias("n"), r(F.col("m")[0].x).alias("first_x"), r(F.col("m")[0].t, 8).alias("first_t"), r(F.element_at("m", -1).t, 8).alias("last_t"), "line", "ray")


@query(
    "quad_neighbours",
    f"WITH p AS (SELECT c_custkey AS id, CAST(floor(({LON.format(k='c_custkey')} + 180) / 360 * 16) AS BIGINT) AS x, CAST(floor(({LAT.format(k='c_custkey')} + 90) / 180 * 16) AS BIGINT) AS y FROM customer), "
    "d AS (SELECT id, n, x + dx AS x, y + dy AS y FROM p, (VALUES (0, 0, -1), (1, 1, 0), (2, 0, 1), (3, -1, 0), (4, -1, -1), (5, 1, -1), (6, 1, 1), (7, -1, 1)) t(n, dx, dy)) "
    "SELECT id, CAST(n AS INT) AS n, CASE WHEN x BETWEEN 0 AND 15 AND y BETWEEN 0 AND 15 THEN concat(((x >> 3) & 1) + 2 * ((y >> 3) & 1), ((x >> 2) & 1) + 2 * ((y >> 2) & 1), ((x >> 1) & 1) + 2 * ((y >> 1) & 1), (x & 1) + 2 * (y & 1)) END AS key FROM d",
)
def quad_neighbours(spark, sf_dir):
    p = points(read(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), fields.quad_key(F.col("lon"), F.col("lat"), (-180.0, -90.0, 180.0, 90.0), 4).alias("k"))
    return p.select("id", F.posexplode(fields.quad_neighbours(F.col("k"), corners=True)).alias("n", "key"))


@query(
    "fn_heights",
    "SELECT p_partkey, round(CASE p_partkey % 5 WHEN 0 THEN 100e0 * p_size WHEN 1 THEN -100e0 * p_size WHEN 2 THEN p_retailprice / 10 * 10 + 100e0 * p_size WHEN 3 THEN 100e0 * p_size + p_retailprice - 100e0 * p_size * p_retailprice / 20000 END, 5) + 0 AS height, "
    "CASE p_partkey % 6 WHEN 0 THEN 'SIGMA' WHEN 1 THEN 'ETA' WHEN 2 THEN 'ETA' WHEN 3 THEN 'PRESSURE' WHEN 4 THEN 'HYBRID' END AS kind FROM part",
)
def fn_heights(spark, sf_dir):
    """Heights of levels over topography by kind, and the kinds of descriptor versions."""
    kind, level = "CAST(element_at(array(0, 7, 4, 8, 2), CAST(p_partkey % 5 AS INT) + 1) AS BIGINT)", "(100D * p_size)"
    version = "element_at(array(1001, 1002, 1003, 2001, 5005, 7), CAST(p_partkey % 6 AS INT) + 1)"
    return read(spark, sf_dir, "part").select("p_partkey", r(expr.column(expr.level_in_metres(kind, level, "(p_retailprice / 10)", "20000D")), 5).alias("height"), expr.column(expr.version_kind(version)).alias("kind"))


@query(
    "vertical_slopes",
    "WITH t AS (SELECT p_partkey, p_size / 10e0 AS c, unnest([0e0, 1, 1.5, 2.5, 3.5, 6, 7]) AS x, unnest([0, 1, 2, 3, 4, 5, 6]) AS n FROM part), f AS (SELECT *, least(6, greatest(1, x)) AS z FROM t) "
    "SELECT p_partkey, CAST(n AS INT) AS n, round(c * z ** 3 - 2 * z * z + z - 3 + CASE WHEN x < 1 THEN 0.5 * (x - 1) WHEN x > 6 THEN -0.25 * (x - 6) ELSE 0 END, 6) + 0 AS value FROM f",
)
def vertical_slopes(spark, sf_dir):
    """Cubics through values and slopes, which give a cubic back, with lapse rates beyond its ends."""
    z = [1.0, 2.0, 4.0, 6.0]
    c = F.col("p_size") / 10.0
    f, d = (lambda v: c * v**3 - 2 * v * v + v - 3), (lambda v: 3 * c * v * v - 4 * v + 1)
    p = read(spark, sf_dir, "part").select("p_partkey", F.array(*map(F.lit, z)).alias("z"), F.array(*map(f, z)).alias("v"), F.array(*map(d, z)).alias("d"))
    out = fields.column_interpolate(p, F.array(*[F.lit(x) for x in (0.0, 1.0, 1.5, 2.5, 3.5, 6.0, 7.0)]), "derivatives", (0.5, -0.25))
    return out.select("p_partkey", F.posexplode("out").alias("n", "value")).withColumn("value", r(F.col("value")))
