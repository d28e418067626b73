"""Queries over the grid operators, each with a separately written SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar.operators import catalog, fields, gather, nearest, scatter

from .registry import QUERIES, SQL

LON, LAT = "CAST(({k} * 7919) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - 180", "CAST(({k} * 104729) % 17000 AS DOUBLE) / CAST(100 AS DOUBLE) - 85"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def points(df, key: str):
    return df.withColumns({"lon": F.expr(LON.format(k=key)), "lat": F.expr(LAT.format(k=key))})


def r(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def event_cells(spark, sf_dir):
    """Field: i = user mod 16, j = hour, k = day; v the mean value."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("i"), F.hour("ts").cast("long").alias("j"), F.dayofmonth("ts").cast("long").alias("k"), "value")
    return e.groupBy("k", "i", "j").agg(F.avg("value").alias("v"))


CELLS = "cells AS (SELECT CAST(day(ts) AS BIGINT) AS k, user_id % 16 AS i, CAST(hour(ts) AS BIGINT) AS j, avg(value) AS v FROM events GROUP BY ALL)"
PTS = "pts AS (SELECT event_id AS id, CAST(1 + event_id % 29 AS BIGINT) AS k, CAST((event_id * 37) % 1600 AS DOUBLE) / 100 AS x, CAST((event_id * 53) % 2400 AS DOUBLE) / 100 AS y, CAST(1 + event_id % 28 AS DOUBLE) + CAST(event_id % 4 AS DOUBLE) / 4 AS z FROM events)"


def event_points(spark, sf_dir):
    return read(spark, sf_dir, "events").selectExpr("event_id AS id", "CAST(1 + event_id % 29 AS BIGINT) AS k", "CAST((event_id * 37) % 1600 AS DOUBLE) / 100 AS x", "CAST((event_id * 53) % 2400 AS DOUBLE) / 100 AS y", "CAST(1 + event_id % 28 AS DOUBLE) + CAST(event_id % 4 AS DOUBLE) / 4 AS z")


_C = f"c AS (SELECT c_acctbal AS v, CAST(round_even(({LON.format(k='c_custkey')} + 180) / 30, 0) AS BIGINT) AS ci, CAST(round_even(({LAT.format(k='c_custkey')} + 90) / 30, 0) AS BIGINT) AS cj FROM customer)"


def _customer_cells(spark, sf_dir):
    p = points(read(spark, sf_dir, "customer"), "c_custkey")
    return p.select("c_custkey", F.col("c_acctbal").alias("v"), F.rint((F.col("lon") + 180) / 30).cast("long").alias("ci"), F.rint((F.col("lat") + 90) / 30).cast("long").alias("cj"))


@query("grid_scatter_stats", f"WITH {_C} SELECT ci, cj, max(v) AS maximum, min(v) AS minimum, round(sum(v), 4) + 0 AS sum, round(avg(v), 4) + 0 AS average, count(v) AS count, round(avg(v * v), 2) + 0 AS square, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 4) + 0 AS circular FROM (SELECT *, degrees(atan2(avg(sin(radians(v))) OVER (PARTITION BY ci, cj), avg(cos(radians(v))) OVER (PARTITION BY ci, cj))) AS d FROM c) GROUP BY ci, cj, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 4)")
def grid_scatter_stats(spark, sf_dir):
    out = scatter.scatter(_customer_cells(spark, sf_dir), ["ci", "cj"], "v", list(scatter.MODES))
    return out.select("ci", "cj", "maximum", "minimum", r(F.col("sum"), 4).alias("sum"), r(F.col("average"), 4).alias("average"), "count", r(F.col("square"), 2).alias("square"), r(F.col("circular"), 4).alias("circular"))


@query("grid_scatter_variance", f"WITH {_C}, m AS (SELECT ci, cj, round(avg(v), 2) AS mean FROM c GROUP BY ci, cj) SELECT c.ci, c.cj, m.mean, round(avg((v - m.mean) * (v - m.mean)), 1) + 0 AS variance FROM c JOIN m ON c.ci = m.ci AND c.cj = m.cj GROUP BY c.ci, c.cj, m.mean")
def grid_scatter_variance(spark, sf_dir):
    c = _customer_cells(spark, sf_dir)
    means = c.groupBy("ci", "cj").agg(F.round(F.avg("v"), 2).alias("mean"))
    return scatter.variance(c, means, ["ci", "cj"], "v").select("ci", "cj", "mean", r(F.col("variance"), 1).alias("variance"))


@query("grid_class_counts", "SELECT l_suppkey % 20 AS cell, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS class_A, CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT) AS class_N, round(count(*) FILTER (l_returnflag = 'A') / count(*), 8) AS share_A, round(count(*) FILTER (l_returnflag = 'N') / count(*) FILTER (l_returnflag IN ('A', 'N')), 8) AS matched_N FROM lineitem GROUP BY 1")
def grid_class_counts(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("cell"), "l_returnflag")
    share = lambda c, how, name: F.round(scatter.class_columns("l_returnflag", ["A", "N"], how)[c], 8).alias(name)
    return li.groupBy("cell").agg(*scatter.class_columns("l_returnflag", ["A", "N"]), share(0, "all", "share_A"), share(1, "matched", "matched_N"))


@query("grid_class_lookup", "WITH lut AS (SELECT * FROM (VALUES ('A', 1, 1.0), ('N', 1, 0.5), ('N', 2, 0.5), ('R', 2, 1.0)) t(code, class, weight)) SELECT l_suppkey % 20 AS cell, class, CAST(sum(CAST(weight AS DOUBLE)) AS DOUBLE) AS weighted, count(*) AS n FROM lineitem JOIN lut ON l_returnflag = code GROUP BY 1, 2")
def grid_class_lookup(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("cell"), "l_returnflag")
    lut = spark.sql("SELECT * FROM VALUES ('A', 1, 1E0), ('N', 1, 0.5E0), ('N', 2, 0.5E0), ('R', 2, 1E0) AS t(code, class, weight)")
    return scatter.lookup_counts(li, ["cell"], "l_returnflag", lut)


@query("grid_multipass", "SELECT user_id % 16 AS cell, round(avg(value), 6) AS average, round(avg(value * value), 4) AS square, count(value) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def grid_multipass(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("cell"), "value", "ts")
    passes = [scatter.partial(e.filter(F.dayofmonth("ts") % 3 == d), ["cell"], "value") for d in range(3)]
    return scatter.finish(scatter.merge(*passes)).select("cell", r(F.col("average")).alias("average"), r(F.col("square"), 4).alias("square"), "n", "lo", "hi")


@query("grid_paste", f"WITH {CELLS}, p AS (SELECT k - 1 AS k, i + 2 AS i, j + 3 AS j, v, CAST(i AS DOUBLE) / 16 AS a FROM cells) SELECT b.k, b.i, b.j, round(CASE WHEN p.v IS NULL THEN b.v ELSE p.v * p.a + b.v * (1 - p.a) END, 9) AS v FROM cells b LEFT JOIN p ON b.k = p.k AND b.i = p.i AND b.j = p.j")
def grid_paste(spark, sf_dir):
    """Each day overlaid by the day after it."""
    c = event_cells(spark, sf_dir)
    patch = c.withColumn("a", F.col("i").cast("double") / 16).withColumn("k", F.col("k") - 1)
    return scatter.paste(c, patch, 2, 3, "a", ["k"]).withColumn("v", r(F.col("v"), 9))


@query("grid_set_value", "SELECT c_custkey, least(c_acctbal, 0e0 + c_nationkey * 100) AS lo, greatest(c_acctbal, 0e0 + c_nationkey * 100) AS hi, round(c_acctbal + c_nationkey * 100, 4) AS total, round((c_acctbal * 3 + c_nationkey * 100) / 4, 4) AS mean FROM customer")
def grid_set_value(spark, sf_dir):
    c, new = read(spark, sf_dir, "customer"), F.col("c_nationkey") * 100.0
    old = F.col("c_acctbal")
    return c.select("c_custkey", scatter.combine(old, new, "min").alias("lo"), scatter.combine(old, new, "max").alias("hi"), r(scatter.combine(old, new, "sum"), 4).alias("total"), r(scatter.combine(old, new, "average", F.lit(3)), 4).alias("mean"))


_CORNERS = "LEFT JOIN cells a ON a.k = {k} AND a.i = floor(x) AND a.j = floor(y) LEFT JOIN cells b ON b.k = {k} AND b.i = floor(x) + 1 AND b.j = floor(y) LEFT JOIN cells c ON c.k = {k} AND c.i = floor(x) AND c.j = floor(y) + 1 LEFT JOIN cells d ON d.k = {k} AND d.i = floor(x) + 1 AND d.j = floor(y) + 1"
_LOW, _HIGH = "CASE WHEN x = floor(x) THEN a.v ELSE a.v + (b.v - a.v) * (x - floor(x)) END", "CASE WHEN x = floor(x) THEN c.v ELSE c.v + (d.v - c.v) * (x - floor(x)) END"
_BILINEAR = f"CASE WHEN y = floor(y) THEN {_LOW} ELSE ({_LOW}) + (({_HIGH}) - ({_LOW})) * (y - floor(y)) END"


@query("grid_bilinear", f"WITH {CELLS}, {PTS} SELECT pts.id, round({_BILINEAR}, 6) AS value FROM pts {_CORNERS.format(k='pts.k')}")
def grid_bilinear(spark, sf_dir):
    return gather.bilinear(event_points(spark, sf_dir), event_cells(spark, sf_dir), ["k"]).select("id", r(F.col("value")).alias("value"))


@query("grid_nearest_cell", f"WITH {CELLS}, {PTS} SELECT pts.id, round(cells.v, 6) AS value FROM pts LEFT JOIN cells ON cells.k = pts.k AND cells.i = round_even(x, 0) AND cells.j = round_even(y, 0)")
def grid_nearest_cell(spark, sf_dir):
    return gather.nearest(event_points(spark, sf_dir), event_cells(spark, sf_dir), ["k"]).select("id", r(F.col("value")).alias("value"))


@query("grid_trilinear", f"WITH {CELLS}, {PTS}, lo AS (SELECT pts.id, z, {_BILINEAR} AS v FROM pts {_CORNERS.format(k='floor(z)')}), hi AS (SELECT pts.id, {_BILINEAR} AS v FROM pts {_CORNERS.format(k='(floor(z) + 1)')}) SELECT lo.id, round(CASE WHEN z = floor(z) THEN lo.v ELSE lo.v + (hi.v - lo.v) * (z - floor(z)) END, 6) AS value FROM lo JOIN hi ON lo.id = hi.id")
def grid_trilinear(spark, sf_dir):
    return gather.trilinear(event_points(spark, sf_dir), event_cells(spark, sf_dir)).select("id", r(F.col("value")).alias("value"))


_MASKED = f"{CELLS}, m AS (SELECT *, CASE WHEN (i * 7 + j * 3 + k) % 5 = 0 THEN 0 ELSE 1 END AS mask FROM cells)"


@query("grid_mask_fill", f"WITH {_MASKED} SELECT m.k, m.i, m.j, round(CASE WHEN m.mask = 0 THEN avg(n.v) ELSE m.v END, 6) AS v FROM m LEFT JOIN m n ON n.k = m.k AND abs(n.i - m.i) <= 1 AND abs(n.j - m.j) <= 1 AND n.mask <> 0 GROUP BY m.k, m.i, m.j, m.mask, m.v")
def grid_mask_fill(spark, sf_dir):
    c = event_cells(spark, sf_dir).withColumn("mask", F.when((F.col("i") * 7 + F.col("j") * 3 + F.col("k")) % 5 == 0, 0).otherwise(1))
    return gather.filled(c, ["k"]).select("k", "i", "j", r(F.col("v")).alias("v"))


@query("grid_gradient", f"WITH {CELLS} SELECT c.k, c.i, c.j, round((w.v - e.v) / 2, 6) + 0 AS gx, round((s.v - n.v) / 2, 6) + 0 AS gy FROM cells c LEFT JOIN cells w ON w.k = c.k AND w.i = c.i - 1 AND w.j = c.j LEFT JOIN cells e ON e.k = c.k AND e.i = c.i + 1 AND e.j = c.j LEFT JOIN cells s ON s.k = c.k AND s.i = c.i AND s.j = c.j - 1 LEFT JOIN cells n ON n.k = c.k AND n.i = c.i AND n.j = c.j + 1")
def grid_gradient(spark, sf_dir):
    return gather.gradient(event_cells(spark, sf_dir), ["k"]).select("k", "i", "j", r(F.col("gx")).alias("gx"), r(F.col("gy")).alias("gy"))


_NEAR = f"p AS (SELECT c_custkey AS id, {LON.format(k='c_custkey')} AS lon, {LAT.format(k='c_custkey')} AS lat FROM customer), t AS (SELECT s_suppkey AS id, {LON.format(k='s_suppkey')} AS lon, {LAT.format(k='s_suppkey')} AS lat, s_acctbal AS value FROM supplier), n AS (SELECT p.id, t.id AS target, t.value, least(abs(p.lon - t.lon), 360 - abs(p.lon - t.lon)) ** 2 + (p.lat - t.lat) ** 2 AS d2 FROM p, t), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, target) AS rank FROM n QUALIFY rank <= 5)"


def _stations(spark, sf_dir):
    t = points(read(spark, sf_dir, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("id"), "lon", "lat", F.col("s_acctbal").alias("value"))
    p = points(read(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), "lon", "lat")
    return nearest.k_nearest(p, t, 5), t


@query("near_points", f"WITH {_NEAR} SELECT id, target, round(d2, 6) AS d2, CAST(rank AS INT) AS rank FROM k")
def near_points(spark, sf_dir):
    return _stations(spark, sf_dir)[0].withColumn("d2", r(F.col("d2")))


@query("near_barnes", f"WITH {_NEAR}, r AS (SELECT *, max(d2) OVER (PARTITION BY id) AS r FROM k) SELECT id, round(sum(exp(-14.2 * pi() * d2 * d2 / (r * r)) * value) / sum(exp(-14.2 * pi() * d2 * d2 / (r * r))), 4) AS barnes, round(sum((1.001 * r - d2) / (1.001 * r + d2) * value) / sum((1.001 * r - d2) / (1.001 * r + d2)), 4) AS cressman FROM r GROUP BY id")
def near_barnes(spark, sf_dir):
    near, t = _stations(spark, sf_dir)
    return nearest.weighted(near, t, ["barnes", "cressman"]).select("id", r(F.col("barnes"), 4).alias("barnes"), r(F.col("cressman"), 4).alias("cressman"))


def _mesh(spark):
    """Two triangles a square of a 10 degree lattice."""
    g = spark.range(36).selectExpr("CAST(id AS DOUBLE) * 10 - 180 AS x", "id AS i").crossJoin(spark.range(18).selectExpr("CAST(id AS DOUBLE) * 10 - 90 AS y", "id AS j"))
    up = g.selectExpr("(j * 36 + i) * 2 AS tid", "x AS x0", "y AS y0", "x + 10 AS x1", "y AS y1", "x + 10 AS x2", "y + 10 AS y2")
    return up.unionByName(g.selectExpr("(j * 36 + i) * 2 + 1 AS tid", "x AS x0", "y AS y0", "x + 10 AS x1", "y + 10 AS y1", "x AS x2", "y + 10 AS y2"))


@query("mesh_lookup", f"WITH p AS (SELECT c_custkey AS id, {LON.format(k='c_custkey')} AS x, {LAT.format(k='c_custkey')} AS y FROM customer), g AS (SELECT i, j, CAST(i AS DOUBLE) * 10 - 180 AS x, CAST(j AS DOUBLE) * 10 - 90 AS y FROM range(36) a(i), range(18) b(j)), t AS (SELECT (j * 36 + i) * 2 AS tid, x AS x0, y AS y0, x + 10 AS x1, y AS y1, x + 10 AS x2, y + 10 AS y2 FROM g UNION ALL SELECT (j * 36 + i) * 2 + 1, x, y, x + 10, y + 10, x, y + 10 FROM g), w AS (SELECT id, tid, x0, x1, x2, ((x1 - x) * (y2 - y) - (x2 - x) * (y1 - y)) / 100 AS b0, ((x2 - x) * (y0 - y) - (x0 - x) * (y2 - y)) / 100 AS b1 FROM p JOIN t ON x >= least(x0, x1, x2) - 1e-3 AND x <= greatest(x0, x1, x2) + 1e-3 AND y >= least(y0, y1, y2) - 1e-3 AND y <= greatest(y0, y1, y2) + 1e-3) SELECT id, tid, round(b0, 6) + 0 AS b0, round(b1, 6) + 0 AS b1, round(b0 * x0 + b1 * x1 + (1 - b0 - b1) * x2, 6) + 0 AS value FROM w WHERE b0 >= -1e-5 AND b1 >= -1e-5 AND 1 - b0 - b1 >= -1e-5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY tid) = 1")
def mesh_lookup(spark, sf_dir):
    p = points(read(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    h = nearest.triangle_hits(p, _mesh(spark))
    return h.select("id", "tid", r(F.col("b0")).alias("b0"), r(F.col("b1")).alias("b1"), r(F.expr("b0 * x0 + b1 * x1 + b2 * x2")).alias("value"))


_HEAD = "h AS (SELECT o_orderkey AS rec, CASE o_custkey % 9 WHEN 0 THEN '>>  ' WHEN 1 THEN '^^' ELSE substr(o_orderpriority, 3, 4) END AS nomvar, o_orderstatus AS etiket, CASE WHEN o_orderkey % 6 = 0 THEN '@@' ELSE 'P' END AS typvar, o_custkey AS ip1, o_orderkey % 3 AS ip2, CAST(o_orderdate AS DATE) AS dateo, CAST(o_orderdate AS DATE) AS datev FROM orders)"


def headers(spark, sf_dir):
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey AS rec", "CASE o_custkey % 9 WHEN 0 THEN '>>  ' WHEN 1 THEN '^^' ELSE substr(o_orderpriority, 3, 4) END AS nomvar", "o_orderstatus AS etiket", "CASE WHEN o_orderkey % 6 = 0 THEN '@@' ELSE 'P' END AS typvar", "o_custkey AS ip1", "o_orderkey % 3 AS ip2", "CAST(o_orderdate AS DATE) AS dateo", "CAST(o_orderdate AS DATE) AS datev")


@query("catalog_find", f"WITH {_HEAD} SELECT rec, nomvar, ip1 FROM h WHERE rtrim(nomvar) = '>>' AND etiket = 'O' AND ip2 = 1 ORDER BY rec LIMIT 1")
def catalog_find(spark, sf_dir):
    return catalog.find(headers(spark, sf_dir), ["rec"], nomvar=">>", etiket="O", ip1=-1, ip2=1, typvar=" ").select("rec", "nomvar", "ip1")


@query("catalog_find_all", f"WITH {_HEAD} SELECT rec, nomvar, typvar FROM h WHERE etiket = 'F' AND ip2 = 2")
def catalog_find_all(spark, sf_dir):
    return catalog.find_all(headers(spark, sf_dir), etiket="F", ip2=2, nomvar="").select("rec", "nomvar", "typvar")


@query("catalog_next", f"WITH {_HEAD} SELECT rec, nomvar, CAST(row_number() OVER (PARTITION BY nomvar ORDER BY rec) AS INT) AS place FROM h WHERE etiket = 'O'")
def catalog_next(spark, sf_dir):
    return catalog.numbered(headers(spark, sf_dir), ["nomvar"], ["rec"], ranges=True, etiket="O").select("rec", "nomvar", "place")


@query("catalog_dates", f"WITH {_HEAD} SELECT DISTINCT datev FROM h WHERE ip2 = 0")
def catalog_dates(spark, sf_dir):
    return catalog.values(catalog.find_all(headers(spark, sf_dir), ip2=0), "datev")


@query("catalog_ips", f"WITH {_HEAD} SELECT DISTINCT ip1 FROM h WHERE etiket = 'P'")
def catalog_ips(spark, sf_dir):
    return catalog.values(catalog.find_all(headers(spark, sf_dir), etiket="P"), "ip1")


@query("catalog_copy_descriptors", f"WITH {_HEAD}, s AS (SELECT * FROM h WHERE rec % 2 = 0), t AS (SELECT DISTINCT nomvar, ip1, ip2 FROM h WHERE rec % 2 = 1) SELECT rec, s.nomvar, s.ip1 FROM s ANTI JOIN t ON s.nomvar = t.nomvar AND s.ip1 = t.ip1 AND s.ip2 = t.ip2 WHERE rtrim(s.nomvar) IN ('>>', '^^')")
def catalog_copy_descriptors(spark, sf_dir):
    h = headers(spark, sf_dir)
    return catalog.missing_descriptors(h.filter("rec % 2 = 0"), h.filter("rec % 2 = 1"), ["nomvar", "ip1", "ip2"]).select("rec", "nomvar", "ip1")


@query("catalog_first_readable", f"WITH {_HEAD} SELECT rec, nomvar FROM h WHERE rtrim(nomvar) NOT IN ('>>', '^^') AND typvar <> '@@' AND etiket = 'O' ORDER BY rec LIMIT 1")
def catalog_first_readable(spark, sf_dir):
    return catalog.first_readable(headers(spark, sf_dir), ["rec"], etiket="O").select("rec", "nomvar")


@query("catalog_link", f"WITH {_HEAD}, u AS (SELECT *, 0 AS f FROM h WHERE rec % 2 = 0 UNION ALL SELECT *, 1 FROM h WHERE rec % 2 = 1) SELECT CAST(f AS INT) AS file_idx, nomvar, count(*) AS n FROM u GROUP BY 1, 2")
def catalog_link(spark, sf_dir):
    h = headers(spark, sf_dir)
    return catalog.link(h.filter("rec % 2 = 0"), h.filter("rec % 2 = 1")).groupBy("file_idx", "nomvar").agg(F.count("*").alias("n"))


@query("catalog_conformance", f"WITH {_HEAD}, known AS (SELECT DISTINCT nomvar FROM h WHERE nomvar NOT LIKE '%U%') SELECT 'unknown' AS check, nomvar AS subject, count(*) AS n FROM h ANTI JOIN known USING (nomvar) GROUP BY nomvar UNION ALL SELECT 'duplicate', nomvar, CAST(sum(c) AS BIGINT) FROM (SELECT nomvar, count(*) AS c FROM h GROUP BY nomvar, etiket, ip1, datev HAVING c > 1) GROUP BY nomvar UNION ALL SELECT 'mixed_origin', nomvar, count(DISTINCT dateo) AS n FROM h GROUP BY nomvar HAVING n > 1")
def catalog_conformance(spark, sf_dir):
    h = headers(spark, sf_dir)
    return catalog.conformance(h, h.filter("nomvar NOT LIKE '%U%'").select("nomvar").distinct())


@query("field_tiles", f"WITH {CELLS}, o AS (SELECT a AS ti, b AS tj FROM range(4) x(a), range(6) y(b)) SELECT k, tj * 4 + ti + 1 AS tile, greatest(0, ti * 4 - 1) + 1 AS ig3, greatest(0, tj * 4 - 1) + 1 AS ig4, i - greatest(0, ti * 4 - 1) AS li, j - greatest(0, tj * 4 - 1) AS lj, (i >= ti * 4 AND i < ti * 4 + 4 AND j >= tj * 4 AND j < tj * 4 + 4) AS own, round(v, 6) AS v FROM cells JOIN o ON i >= ti * 4 - 1 AND i <= ti * 4 + 4 AND j >= tj * 4 - 1 AND j <= tj * 4 + 4")
def field_tiles(spark, sf_dir):
    return fields.tiles(event_cells(spark, sf_dir), ["k"], 4, 4, 1, 16, 24).withColumn("v", r(F.col("v")))


@query("field_stitch", f"WITH {CELLS} SELECT k, i, j, round(v, 6) AS v FROM cells")
def field_stitch(spark, sf_dir):
    t = fields.tiles(event_cells(spark, sf_dir), ["k"], 5, 7, 2, 16, 24)
    return fields.stitch(t, ["k"]).withColumn("v", r(F.col("v")))


@query("level_bracket", "WITH l AS (SELECT [1, 5, 10, 20, 35, 50] AS lv) SELECT p_partkey, CAST(len(list_filter(lv, lambda x: x <= p_size)) - 1 AS INT) AS below, CAST(CASE WHEN p_size < 1 OR p_size > 50 THEN -1 WHEN len(list_filter(lv, lambda x: x <= p_size)) = 6 THEN 5 WHEN p_size - lv[len(list_filter(lv, lambda x: x <= p_size))] <= lv[len(list_filter(lv, lambda x: x <= p_size)) + 1] - p_size THEN len(list_filter(lv, lambda x: x <= p_size)) - 1 ELSE len(list_filter(lv, lambda x: x <= p_size)) END AS INT) AS near FROM part, l")
def level_bracket(spark, sf_dir):
    lv = F.array(*[F.lit(v) for v in (1, 5, 10, 20, 35, 50)])
    b = fields.bracket(F.col("p_size"), lv)
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", b.alias("below"))
    k = F.col("below")
    near = F.when((F.col("p_size") < 1) | (F.col("p_size") > 50), -1).when(k == 5, 5).when(F.col("p_size") - F.try_element_at(lv, k + 1) <= F.try_element_at(lv, k + 2) - F.col("p_size"), k).otherwise(k + 1)
    return p.select("p_partkey", "below", near.cast("int").alias("near"))


@query("time_as_of", "WITH l AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, epoch_us(ts) // 1000000 AS t, event_id AS rid, value FROM events WHERE event_type = 'click'), m AS (SELECT l.event_id, q.t, q.rid, row_number() OVER (PARTITION BY l.event_id ORDER BY q.t DESC, q.rid DESC) AS n FROM l LEFT JOIN q ON q.user_id = l.user_id AND q.t <= l.t) SELECT event_id, CAST(t AS BIGINT) AS before_t FROM m WHERE n = 1")
def time_as_of(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "event_type", "value")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.filter("event_type = 'click'").select("user_id", "t", F.col("event_id").alias("rid"), "value")
    return fields.as_of(left, right, ["user_id"], "t").select("event_id", F.col("before.t").alias("before_t"))


@query("time_blend", "WITH s AS (SELECT user_id, epoch_us(ts) // 1000000 AS t, avg(value) AS v FROM events GROUP BY 1, 2), p AS (SELECT *, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)), g AS (SELECT *, unnest(generate_series(CAST(ceil(t / 21600) * 21600 AS BIGINT), CAST((t1 - 1) // 21600 * 21600 AS BIGINT), 21600)) AS time FROM p WHERE t1 IS NOT NULL) SELECT user_id, time, round(v * (1 - (time - t) / (t1 - t)) + v1 * ((time - t) / (t1 - t)), 6) AS blend FROM g")
def time_blend(spark, sf_dir):
    s = read(spark, sf_dir, "events").groupBy("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t")).agg(F.avg("value").alias("v"))
    return fields.time_blend(s, ["user_id"], "t", "v", 21600).withColumn("blend", r(F.col("blend")))


@query("vertical_cube", "SELECT p_partkey, CAST(k AS INT) AS k, round(10 + (950 + p_size - 10) * level, 6) AS pressure, round(ln(10 + (950 + p_size - 10) * level), 8) AS log_pressure FROM part, (VALUES (0, 0.1e0), (1, 0.5e0), (2, 0.85e0), (3, 1e0)) l(k, level)")
def vertical_cube(spark, sf_dir):
    c = fields.pressure_cube(read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 950).cast("double").alias("p0")), [0.1, 0.5, 0.85, 1.0], "ETA")
    return c.select("p_partkey", "k", r(F.col("pressure")).alias("pressure"), r(F.log("pressure"), 8).alias("log_pressure"))


@query("vertical_linear", "WITH c AS (SELECT p_partkey, [100e0, 250, 500, 850, 1000] AS z, [p_retailprice, p_size, 3e0 * p_size, p_retailprice / 2, 1e0] AS v FROM part), t AS (SELECT *, unnest([50e0, 100, 300, 700, 999, 1200]) AS x, unnest([0, 1, 2, 3, 4, 5]) AS n FROM c), b AS (SELECT *, greatest(1, least(len(list_filter(z, lambda y: y <= x)), 4)) AS k FROM t) SELECT p_partkey, CAST(n AS INT) AS n, round(CASE WHEN x <= z[1] THEN v[1] WHEN x >= z[5] THEN v[5] ELSE v[k] + (v[k + 1] - v[k]) * (x - z[k]) / (z[k + 1] - z[k]) END, 6) AS value, round(CASE WHEN x <= z[1] THEN v[1] WHEN x >= z[5] THEN v[5] WHEN x - z[k] <= z[k + 1] - x THEN v[k] ELSE v[k + 1] END, 6) AS near FROM b")
def vertical_linear(spark, sf_dir):
    d = lambda c: c.cast("double")
    c = read(spark, sf_dir, "part").select("p_partkey", F.array(*[F.lit(float(x)) for x in (100, 250, 500, 850, 1000)]).alias("z"), F.array("p_retailprice", d(F.col("p_size")), F.lit(3.0) * F.col("p_size"), F.col("p_retailprice") / 2, F.lit(1.0)).alias("v"))
    t = F.array(*[F.lit(float(x)) for x in (50, 100, 300, 700, 999, 1200)])
    a = fields.column_interpolate(c, t).withColumnRenamed("out", "lin")
    a = fields.column_interpolate(a, t, "nearest")
    return a.select("p_partkey", F.posexplode(F.arrays_zip("lin", "out")).alias("n", "x")).select("p_partkey", "n", r(F.col("x.lin")).alias("value"), r(F.col("x.out")).alias("near"))


@query("quad_keys", f"WITH p AS (SELECT c_custkey AS id, {LON.format(k='c_custkey')} AS x, {LAT.format(k='c_custkey')} AS y FROM customer), q AS (SELECT id, CAST(floor((x + 180) / 360 * 16) AS BIGINT) AS qx, CAST(floor((y + 90) / 180 * 16) AS BIGINT) AS qy FROM p), k AS (SELECT id, CAST((qx >> 3) & 1 | ((qy >> 3) & 1) * 2 AS VARCHAR) || CAST((qx >> 2) & 1 | ((qy >> 2) & 1) * 2 AS VARCHAR) || CAST((qx >> 1) & 1 | ((qy >> 1) & 1) * 2 AS VARCHAR) || CAST(qx & 1 | (qy & 1) * 2 AS VARCHAR) AS leaf FROM q) SELECT leaf, count(*) AS n, min(id) AS first FROM k GROUP BY leaf")
def quad_keys(spark, sf_dir):
    p = points(read(spark, sf_dir, "customer"), "c_custkey")
    return p.groupBy(fields.quad_key(F.col("lon"), F.col("lat"), (-180.0, -90.0, 180.0, 90.0), 4).alias("leaf")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


_BOX = f"s AS (SELECT s_suppkey AS sid, s_acctbal AS value, {LON.format(k='s_suppkey')} AS x0, {LAT.format(k='s_suppkey')} AS y0, {LON.format(k='s_suppkey')} + 17 AS x1, {LAT.format(k='s_suppkey')} + 9 AS y1 FROM supplier), g AS (SELECT i, j FROM range(-20, 22) a(i), range(-10, 12) b(j)), w AS (SELECT sid, value, i, j, (least(x1, (i + 1) * 10e0) - greatest(x0, i * 10e0)) * (least(y1, (j + 1) * 10e0) - greatest(y0, j * 10e0)) / ((x1 - x0) * (y1 - y0)) AS w FROM s JOIN g ON x0 < (i + 1) * 10 AND x1 > i * 10 AND y0 < (j + 1) * 10 AND y1 > j * 10)"


@query("grid_conservative", f"WITH {_BOX} SELECT i, j, round(sum(value * w), 4) + 0 AS total, round(sum(value * w) / sum(w), 4) + 0 AS mean FROM w WHERE w > 0 GROUP BY i, j")
def grid_conservative(spark, sf_dir):
    s = points(read(spark, sf_dir, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("sid"), F.col("s_acctbal").alias("value"), F.col("lon").alias("x0"), F.col("lat").alias("y0"), (F.col("lon") + 17).alias("x1"), (F.col("lat") + 9).alias("y1"))
    w = fields.conservative_weights(s, 10.0, 10.0)
    a = fields.conservative(s, w).select("i", "j", r(F.col("value"), 4).alias("total"))
    return a.join(fields.conservative(s, w, True).select("i", "j", r(F.col("value"), 4).alias("mean")), ["i", "j"])


_GRID_AT = "g AS (SELECT s_suppkey, least(60, greatest(-80, 10 * floor((" + LAT.format(k="s_suppkey") + ") / 10))) AS lat0 FROM supplier)"


@query("grid_cell_dims", f"WITH {_GRID_AT}, c AS (SELECT s_suppkey, CAST(i AS INT) AS i, CAST(j AS INT) AS j, lat0 + 10e0 * j AS lat FROM g, range(4) a(i), range(3) b(j)) SELECT s_suppkey, i, j, round(6371000 * acos(least(1, sin(radians(lat)) * sin(radians(lat)) + cos(radians(10)) * cos(radians(lat)) * cos(radians(lat)))), 2) AS dx, round(6371000 * radians(10), 2) AS dy FROM c")
def grid_cell_dims(spark, sf_dir):
    """A grid of 4 x 3 cells at each supplier."""
    from isobar.operators import gridref

    s = points(read(spark, sf_dir, "supplier"), "s_suppkey").withColumn("lat0", F.least(F.lit(60.0), F.greatest(F.lit(-80.0), 10.0 * F.floor(F.col("lat") / 10))))
    g = s.select("s_suppkey", gridref.uniform_axis(F.col("lon"), F.lit(10.0), F.lit(4)).alias("lons"), gridref.uniform_axis(F.col("lat0"), F.lit(10.0), F.lit(3)).alias("lats"))
    return gridref.cell_dims(gridref.cells(g, ["s_suppkey"]), 10.0, 10.0).select("s_suppkey", "i", "j", r(F.col("dx"), 2).alias("dx"), r(F.col("dy"), 2).alias("dy"))


@query("grid_flags", "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1 WHEN s_suppkey % 3 = 1 THEN 2 ELSE 0 END AS INT) AS wrap, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 2 + 8 + 256 WHEN s_suppkey % 3 = 1 THEN 1 + 8 + 16 + 256 ELSE 2 + 4 + 256 END AS INT) AS mask, -180e0 AS lon0 FROM supplier")
def grid_flags(spark, sf_dir):
    from isobar.operators import gridref

    k = F.col("s_suppkey") % 3
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(k == 0, "Z").when(k == 1, "Y").otherwise("#").alias("grtyp"), gridref.uniform_axis(F.lit(-180.0), F.lit(10.0), F.when(k == 0, 36).when(k == 1, 37).otherwise(20)).alias("lons"))
    return s.select("s_suppkey", gridref.wrap_kind(F.col("lons")).alias("wrap"), gridref.flags(F.col("grtyp"), F.col("lons")).alias("mask"), F.array_min("lons").alias("lon0"))


@query("grid_limits", f"SELECT s_nationkey, min({LAT.format(k='s_suppkey')}) AS lat0, min({LON.format(k='s_suppkey')}) AS lon0, max({LAT.format(k='s_suppkey')}) AS lat1, max({LON.format(k='s_suppkey')}) AS lon1 FROM supplier GROUP BY s_nationkey")
def grid_limits(spark, sf_dir):
    from isobar.operators import gridref

    return gridref.limits(points(read(spark, sf_dir, "supplier"), "s_suppkey"), ["s_nationkey"])


@query("text_codes", "SELECT p_partkey, list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS INT)) AS codes, p_name AS back FROM part")
def text_codes(spark, sf_dir):
    from isobar.operators import gridref

    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", gridref.encode_text(F.col("p_name")).alias("codes"))
    return p.select("p_partkey", "codes", gridref.decode_text(F.col("codes")).alias("back"))


@query("dict_modifiers", "WITH m AS (SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN 'E1MAX___NONE' WHEN 1 THEN 'E1GT10__H024' WHEN 2 THEN 'E1C90___NONE' ELSE 'E1LE5___D003' END AS m FROM part) SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' (maximum)' WHEN 1 THEN ' > 10 C between hour 1 and 24' WHEN 2 THEN ' (90th percentile)' ELSE ' <= 5 C between day 1 and 3' END AS short_en, CASE WHEN p_partkey % 2 = 1 THEN '%' ELSE 'C' END AS units, CASE WHEN p_partkey % 2 = 1 THEN 100e0 ELSE 60e0 END AS max FROM m")
def dict_modifiers(spark, sf_dir):
    from isobar.operators import dictionary

    k = F.col("p_partkey") % 4
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("short_fr"), F.col("p_name").alias("short_en"), F.lit("C").alias("units"), F.lit(-90.0).alias("min"), F.lit(60.0).alias("max"), F.when(k == 0, "E1MAX___NONE").when(k == 1, "E1GT10__H024").when(k == 2, "E1C90___NONE").otherwise("E1LE5___D003").alias("m"))
    return dictionary.modified(p, F.col("m")).select("p_partkey", "short_en", "units", "max")


@query("dict_search", "SELECT p_partkey AS id, lower(p_brand) AS name FROM part WHERE p_size % 32 & 16 <> 0 AND lower(p_type) = lower((SELECT min(p_type) FROM part)) ORDER BY name, id")
def dict_search(spark, sf_dir):
    from isobar.operators import dictionary

    p = read(spark, sf_dir, "part")
    first = p.agg(F.min("p_type")).first()[0]
    v = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), (F.col("p_size") % 32).alias("nature"), F.col("p_type").alias("origin"))
    return v.filter(dictionary.search(glob=True, state=16, origin=first.upper())).select("id", F.lower("name").alias("name"))


@query("dict_known", "WITH u AS (SELECT upper(event_type) AS name, count(*) AS n FROM events GROUP BY 1), d AS (SELECT DISTINCT upper(event_type) AS name FROM events WHERE event_type < 'p') SELECT u.name, u.n, d.name IS NOT NULL AS known FROM u LEFT JOIN d ON u.name = d.name")
def dict_known(spark, sf_dir):
    from isobar.operators import dictionary

    e = read(spark, sf_dir, "events")
    return dictionary.known_and_unknown(e.select(F.upper("event_type").alias("name")), e.filter("event_type < 'p'").select(F.col("event_type").alias("name")).distinct())


@query("order_select", "SELECT l_returnflag, CAST(list_sort(list(l_quantity))[101] AS DOUBLE) AS hundredth, count(DISTINCT l_shipdate) AS days, min(l_quantity) AS lo FROM lineitem GROUP BY 1")
def order_select(spark, sf_dir):
    """K-th smallest by the exact percentile's hash aggregation of value counts: no group's rows are gathered, only its distinct values."""
    li = read(spark, sf_dir, "lineitem")
    from pyspark.sql import Window

    c = li.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    w = Window.partitionBy("l_returnflag").orderBy("l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    k = c.withColumn("upto", F.sum("n").over(w)).filter("upto > 100").groupBy("l_returnflag").agg(F.min("l_quantity").alias("hundredth"))
    return li.groupBy("l_returnflag").agg(F.countDistinct("l_shipdate").alias("days"), F.min("l_quantity").alias("lo")).join(k, "l_returnflag")


@query("vertical_hybrid", "SELECT p_partkey, round(0.05 + (p_partkey % 19) / 20e0, 6) AS level FROM part")
def vertical_hybrid(spark, sf_dir):
    """Pressure of a hybrid level and back."""
    from isobar.functions import expr

    p = read(spark, sf_dir, "part").select("p_partkey", F.expr("950D + p_size").alias("p0"), F.expr("0.05D + (p_partkey % 19) / 20D").alias("s"))
    p = p.withColumn("p", expr.column(expr.level_to_pressure("HYBRID", "s", "p0")))
    return p.select("p_partkey", r(fields.pressure_to_hybrid(F.col("p"), F.col("p0"))).alias("level"))
