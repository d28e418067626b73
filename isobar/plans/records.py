"""Queries over record files, polygons with holes and sameness of grids, each with a separately written SQL text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from isobar import jobs
from isobar.functions import rings
from isobar.operators import descriptors, fields, geometry, gridref, reading
from isobar.operators.shared import folder
from isobar.sources import bf, polygons

from .grids import CELLS, LAT, LON, event_cells, points, query, r, read

_RECORDS = """WITH d AS (SELECT p_partkey, ['FLOAT32', 'FLOAT64', 'CFLOAT64', 'INT32', 'CFLOAT32'][p_partkey % 5 + 1] AS t, p_retailprice AS a, p_size / 8e0 AS b, p_brand FROM part),
v AS (SELECT *, CASE WHEN t LIKE '%32' AND t LIKE '%FLOAT%' THEN CAST(CAST(a AS FLOAT) AS DOUBLE) WHEN t = 'INT32' THEN trunc(a) ELSE a END AS x, CASE WHEN t = 'INT32' THEN trunc(b) ELSE b END AS y FROM d)"""


def _records(spark, sf_dir):
    """A record for each part, written by several tasks and read again."""
    bf.register(spark)
    kinds = F.array(*map(F.lit, ("FLOAT32", "FLOAT64", "CFLOAT64", "INT32", "CFLOAT32")))
    p = read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("ip1"), F.when(F.col("p_partkey") % 3 == 0, "GZ").otherwise("TT").alias("nomvar"), F.col("p_brand").alias("etiket"), F.lit("P").alias("typvar"), F.lit("Z").alias("grtyp"), F.lit(3).alias("ni"),
        F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")).alias("dtype"), F.array("p_retailprice", F.col("p_size") / 8.0, "p_retailprice").alias("data"),
    )
    path = f"{folder(spark)}/records-{uuid.uuid4().hex}"
    p.repartition(3, "ip1").write.format("bf").mode("append").save(path)
    return spark.read.format("bf").option("path", path)


@query("record_files", f"{_RECORDS} SELECT CAST(p_partkey AS INT) AS ip1, left(p_brand, 12) AS etiket, x AS first, y AS middle, CAST(3 AS INT) AS n FROM v WHERE p_partkey % 3 = 0")
def record_files(spark, sf_dir):
    got = _records(spark, sf_dir).load().filter("nomvar = 'GZ'")
    return got.select("ip1", "etiket", F.col("data")[0].alias("first"), F.col("data")[1].alias("middle"), F.size("data").alias("n"))


@query("record_headers", "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'GZ' ELSE 'TT' END AS nomvar, count(*) AS n, CAST(max(p_partkey) AS INT) AS last, CAST(count(*) * 3 AS BIGINT) AS points FROM part GROUP BY 1")
def record_headers(spark, sf_dir):
    """Headers only: no data is read."""
    return _records(spark, sf_dir).option("data", "false").load().groupBy("nomvar").agg(F.count("*").alias("n"), F.max("ip1").alias("last"), F.sum(F.col("ni") * F.col("nj") * F.col("nk")).alias("points"))


@query(
    "polygon_holes",
    f"WITH s AS (SELECT s_suppkey AS sid, {LON.format(k='s_suppkey')} AS x, 4e0 + s_suppkey % 7 AS w, 3e0 + s_suppkey % 5 AS h FROM supplier) "
    "SELECT sid, round(w * h * 0.75, 6) AS area, CAST(8 AS INT) AS vertices, CAST(1 AS INT) AS outer_rings, false AS holds_middle, true AS holds_rim, true AS holds_ring, true AS ring_within, true AS meets, false AS crosses, 3e0 AS distance, 5e0 AS corner, CAST(4 AS INT) AS cleaned FROM s",
)
def polygon_holes(spark, sf_dir):
    """A rectangle with a hole at each supplier: measures and predicates."""
    s = points(read(spark, sf_dir, "supplier"), "s_suppkey").withColumns({"w": F.lit(4.0) + F.col("s_suppkey") % 7, "h": F.lit(3.0) + F.col("s_suppkey") % 5})
    x, y, w, h = F.col("lon"), F.col("lat"), F.col("w"), F.col("h")
    outer, inner = rings.rectangle(x, y, x + w, y + h), rings.rectangle(x + w / 4, y + h / 4, x + w * 0.75, y + h * 0.75)
    s = s.select(F.col("s_suppkey").alias("sid"), "lon", "lat", "w", "h", outer.alias("o"), inner.alias("i"))
    s = s.withColumn("g", F.array(F.struct(F.lit(False).alias("hole"), F.col("o").alias("pts")), F.struct(F.lit(True).alias("hole"), F.col("i").alias("pts"))))
    o, i, g = F.col("o"), F.col("i"), F.col("g")
    return s.select(
        "sid", r(rings.polygon_area(g)).alias("area"), rings.vertex_count(g).alias("vertices"), rings.outer_count(g).alias("outer_rings"), rings.polygon_contains_point(g, x + w / 2, y + h / 2).alias("holds_middle"), rings.polygon_contains_point(g, x + w / 8, y + h / 2).alias("holds_rim"),
        rings.contains_ring(o, i).alias("holds_ring"), geometry.within(i, o).alias("ring_within"), rings.intersects(o, i).alias("meets"), rings.crosses(o, i).alias("crosses"), r(rings.distance_to(o, rings.point(x - 3, y + h / 2))).alias("distance"),
        r(rings.closest_vertex(o, rings.point(x - 3, y - 4)).d).alias("corner"), F.size(rings.clean(F.concat(o, F.slice(o, 4, 1)))).alias("cleaned"),
    )


@query("grid_same", "SELECT a.s_suppkey AS one, b.s_suppkey AS other, a.s_suppkey % 4 <> 3 AND a.s_suppkey % 4 = b.s_suppkey % 4 AND a.s_nationkey = b.s_nationkey AS same, abs(a.s_suppkey % 4 * 31) <= 91 AS valid FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 4")
def grid_same(spark, sf_dir):
    """References four apart: the same type and place, but point clouds, which never are the same."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, "ZLMY")), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("grtyp"), F.col("s_nationkey").alias("ig1"), (F.col("s_suppkey") % 4 * 31).cast("double").alias("lat0"))
    a, b = s.alias("a"), s.alias("b")
    j = a.join(b, F.col("b.s_suppkey") == F.col("a.s_suppkey") + 4)
    return j.select(F.col("a.s_suppkey").alias("one"), F.col("b.s_suppkey").alias("other"), gridref.same("a", "b", ["grtyp", "ig1"]).alias("same"), gridref.valid(F.col("a.lat0"), F.col("a.lat0")).alias("valid"))


_WIDTH, _HEIGHT, _TILE = 16, 24, (8, 12, 1)


def _tile_files(spark, sf_dir):
    """The events' field of every day as record files: four tiles with halos at each of two levels, the second twice the first, and masks of the same tiles at the first."""
    bf.register(spark)
    c = event_cells(spark, sf_dir).withColumn("m", F.when((F.col("i") * 7 + F.col("j") * 3 + F.col("k")) % 5 == 0, 0.0).otherwise(1.0))
    c = c.withColumn("r", F.explode(F.array(*[F.struct(F.lit(t).alias("typvar"), F.lit(p).alias("ip1"), v.alias("v")) for t, p, v in (("P@", 500, F.col("v")), ("P@", 850, 2 * F.col("v")), ("@@", 500, F.col("m")))])))
    ni, nj, halo = _TILE
    t = fields.tiles(c.select("k", "i", "j", "r.*"), ["k", "typvar", "ip1"], ni, nj, halo, _WIDTH, _HEIGHT)
    end = lambda start, n, side: F.least(F.lit(n), (F.floor((F.col(start) - 1 + halo) / side) + 1) * side + halo) - F.col(start) + 1
    t = t.withColumns({"w": F.when(F.col("ig3") == 1, F.least(F.lit(_WIDTH), F.lit(ni + halo))).otherwise(end("ig3", _WIDTH, ni)).cast("int"), "h": F.when(F.col("ig4") == 1, F.least(F.lit(_HEIGHT), F.lit(nj + halo))).otherwise(end("ig4", _HEIGHT, nj)).cast("int")})
    t = reading.dense(t.withColumn("n", F.col("lj") * F.col("w") + F.col("li")), ["k", "typvar", "ip1", "tile", "ig3", "ig4", "w", "h"], F.col("w") * F.col("h"))
    t = t.select(
        (F.col("k") * 86400).cast("int").alias("dateo"), F.lit("TT").alias("nomvar"), F.lit("RUN").alias("etiket"), "typvar", "ip1", F.col("tile").cast("int").alias("ip3"), F.col("ig3").cast("int").alias("ig3"),
        F.col("ig4").cast("int").alias("ig4"), F.lit("#").alias("grtyp"), F.col("w").alias("ni"), F.col("h").alias("nj"), F.lit(1).alias("nk"), F.lit("FLOAT64").alias("dtype"), "data",
    )
    path = f"{folder(spark)}/tiles-{uuid.uuid4().hex}"
    t.repartition(4, "dateo").write.format("bf").mode("append").save(path)
    return spark.read.format("bf").option("data", "false").load(path)


_AT = "q AS (SELECT n_nationkey AS id, (1 + n_nationkey) * 86400 + (n_nationkey % 4) * 21600 AS w FROM nation), b AS (SELECT id, w, max(k) FILTER (k * 86400 <= w) AS k0, min(k) FILTER (k * 86400 >= w) AS k1 FROM q, (SELECT DISTINCT k FROM cells) GROUP BY id, w)"


@query("field_at_times", f"WITH {CELLS}, {_AT}, m AS (SELECT *, (i * 7 + j * 3 + k) % 5 = 0 AS off FROM cells), f AS (SELECT *, CASE WHEN k1 > k0 THEN CAST(w - k0 * 86400 AS DOUBLE) / ((k1 - k0) * 86400) ELSE 0 END AS f FROM b WHERE k0 IS NOT NULL AND k1 IS NOT NULL), g AS (SELECT f.id, f.f, i, j FROM f JOIN m ON m.k = f.k0 UNION SELECT f.id, f.f, i, j FROM f JOIN m ON m.k = f.k1), t AS (SELECT g.id, g.i, g.j, g.f, x.v AS a, y.v AS b, x.off AS o, y.off AS p FROM g JOIN f ON f.id = g.id LEFT JOIN m x ON x.k = f.k0 AND x.i = g.i AND x.j = g.j LEFT JOIN m y ON y.k = f.k1 AND y.i = g.i AND y.j = g.j) SELECT id, CAST(l AS INT) AS ip1, i, j, round(CASE WHEN l = 500 AND (o OR (f > 0 AND p)) THEN NULL WHEN f = 0 THEN a ELSE a * (1 - f) + b * f END * CASE WHEN l = 500 THEN 0.5e0 ELSE 1 END, 6) AS value FROM t, (VALUES (500), (850)) z(l)")
def field_at_times(spark, sf_dir):
    """The tiled and masked fields at a time of each nation, halved."""
    requests = read(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "'TT' AS nomvar", "CAST((1 + n_nationkey) * 86400 + (n_nationkey % 4) * 21600 AS INT) AS at")
    out = reading.fields_at(_tile_files(spark, sf_dir), requests, 0.5, (_TILE[0], _TILE[1], _WIDTH))
    return out.select("id", "ip1", "i", "j", r(F.col("value")).alias("value"))


_KIND = "CASE WHEN s_suppkey % 12 = 3 THEN 'PRESSURE' WHEN s_suppkey % 3 = 0 THEN 'ETA' WHEN s_suppkey % 3 = 1 THEN 'SIGMA' ELSE 'HYBRID' END"


def _described(spark, sf_dir):
    """A set of fields for each supplier: its kind of levels, and in record files its descriptors: a table of one of five versions, a header of hybrid levels, a top pressure, or none."""
    bf.register(spark)
    s = read(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat('S', s_suppkey) AS etiket", f"{_KIND} AS kind")
    rows = "array(0D, 0D, 3D, 1000D + s_suppkey % 7 * 100, 80000D + s_suppkey % 3 * 1000, 1.6D, 1D + s_suppkey % 2, 0D, 0D, 100D, 9.5D, 1D, 200D, 9D, 0.5D, 300D, 8D, 0D)"
    toc = s.filter("s_suppkey % 4 = 0").selectExpr("etiket", "'!!' AS nomvar", "'X' AS typvar", "0 AS ip1", "element_at(array(1001, 1002, 1003, 5001, 5002), CAST(s_suppkey / 4 AS INT) % 5 + 1) AS ig1", "CAST(100 + s_suppkey % 50 AS INT) AS ig2", "3 AS ni", "6 AS nj", f"{rows} AS data")
    hy = s.filter("s_suppkey % 4 = 1 OR s_suppkey % 8 = 0").selectExpr("etiket", "'HY' AS nomvar", "'X' AS typvar", "CAST(10 + s_suppkey % 5 AS INT) AS ip1", "800 AS ig1", "1600 AS ig2", "1 AS ni", "1 AS nj", "array(0D) AS data")
    pt = s.filter("s_suppkey % 4 IN (1, 2)").selectExpr("etiket", "'PT' AS nomvar", "'P' AS typvar", "0 AS ip1", "0 AS ig1", "0 AS ig2", "1 AS ni", "1 AS nj", "array(12D + s_suppkey % 3) AS data")
    path = f"{folder(spark)}/levels-{uuid.uuid4().hex}"
    toc.unionByName(hy).unionByName(pt).withColumns({"dtype": F.lit("FLOAT64"), "nk": F.lit(1)}).repartition(3, "etiket").write.format("bf").mode("append").save(path)
    return descriptors.decoded(s, spark.read.format("bf").option("data", "false").load(path), ["etiket"])


_DECODED = f"""s AS (SELECT s_suppkey AS s, {_KIND} AS own FROM supplier),
a AS (SELECT *, own <> 'PRESSURE' AND s % 4 = 0 AS t, own <> 'PRESSURE' AND s % 4 = 1 AS h, own <> 'PRESSURE' AND s % 4 IN (2, 3) AS p, [1001, 1002, 1003, 5001, 5002][(s // 4) % 5 + 1] AS v FROM s),
d AS (SELECT s, CASE WHEN t THEN CASE v WHEN 1001 THEN 'SIGMA' WHEN 1002 THEN 'ETA' WHEN 1003 THEN 'ETA' ELSE 'HYBRID' END WHEN h AND own = 'SIGMA' THEN 'ETA' WHEN p AND s % 4 = 2 AND own = 'SIGMA' THEN 'ETA' ELSE own END AS kind,
  CAST(CASE WHEN t THEN v ELSE 0 END AS INT) AS version,
  CASE WHEN t AND v = 1001 THEN (100 + s % 50) / 10e0 WHEN t THEN (1000 + s % 7 * 100) * 0.01e0 WHEN h THEN 10e0 + s % 5 WHEN p AND own <> 'HYBRID' AND s % 4 = 2 THEN 12e0 + s % 3 WHEN p AND own <> 'HYBRID' THEN 10e0 END AS ptop,
  CASE WHEN t AND v < 1003 THEN 10e0 WHEN t THEN (80000 + s % 3 * 1000) * 0.01e0 WHEN h THEN 800e0 END AS pref, CASE WHEN t AND v < 1003 THEN 0e0 WHEN t OR h THEN 1.6e0 END AS rcoef0, CASE WHEN t AND v = 5002 THEN 1e0 + s % 2 WHEN t OR h THEN 0e0 END AS rcoef1 FROM a)"""


@query("level_descriptors", f"WITH {_DECODED} SELECT s AS s_suppkey, kind, version, round(ptop, 6) AS ptop, round(pref, 6) AS pref, round(rcoef0, 6) AS rcoef0, round(rcoef1, 6) AS rcoef1, CAST(CASE WHEN version > 0 THEN 3 END AS INT) AS n FROM d")
def level_descriptors(spark, sf_dir):
    d = _described(spark, sf_dir)
    return d.select("s_suppkey", "kind", "version", *[r(F.col(c)).alias(c) for c in ("ptop", "pref", "rcoef0", "rcoef1")], F.when(F.col("levels").isNotNull(), F.size("levels")).alias("n"))


@query("level_pressures", f"WITH {_DECODED}, l AS (SELECT d.*, CAST(ip AS INT) AS ip1, CASE WHEN kind = 'PRESSURE' THEN ip * 1e0 ELSE 1 - ip / 1000e0 END AS level, 950e0 + s % 90 AS p0 FROM d, (VALUES (100), (200), (300), (400)) i(ip)), c AS (SELECT *, CASE ip1 WHEN 100 THEN 9.5e0 WHEN 200 THEN 9e0 WHEN 300 THEN 8e0 END AS a, CASE ip1 WHEN 100 THEN 1e0 WHEN 200 THEN 0.5e0 WHEN 300 THEN 0e0 END AS b FROM l) SELECT s AS s_suppkey, ip1, round(CASE WHEN kind = 'PRESSURE' THEN level WHEN kind = 'SIGMA' THEN p0 * level WHEN kind = 'ETA' THEN ptop + (p0 - ptop) * level WHEN version = 5001 THEN a / 100 + b * p0 WHEN version = 5002 THEN exp(a + b * ln(p0 / pref)) / 100 WHEN pref IS NOT NULL THEN pref * level + (p0 - pref) * greatest(0, (level - ptop / pref) / (1 - ptop / pref)) ** rcoef0 END, 5) AS pressure FROM c")
def level_pressures(spark, sf_dir):
    """Four levels of each set, of which a table lacks one."""
    d = _described(spark, sf_dir).withColumn("ip1", F.explode(F.array(*map(F.lit, (100, 200, 300, 400)))))
    level = F.when(F.col("kind") == "PRESSURE", F.col("ip1").cast("double")).otherwise(1 - F.col("ip1") / 1000)
    p0 = F.lit(950.0) + F.col("s_suppkey") % 90
    return d.select("s_suppkey", "ip1", r(descriptors.pressure(level, F.col("ip1"), p0), 5).alias("pressure"))


@query("polygon_files", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 <> 9 THEN CAST(1 + s_suppkey % 2 AS INT) END AS contours, CASE WHEN s_suppkey % 10 <> 9 THEN CAST(4 + 3 * (s_suppkey % 2) AS INT) END AS vertices, CASE WHEN s_suppkey % 10 <> 9 THEN round((4e0 + s_suppkey % 7) * (3e0 + s_suppkey % 5) - CASE WHEN s_suppkey % 2 = 1 THEN 0.5e0 ELSE 0 END, 6) END AS area, s_suppkey % 10 = 9 AS broken FROM supplier")
def polygon_files(spark, sf_dir):
    """A rectangle at each supplier, every second one with a triangle as its hole, written as a file each and read again; the texts of a tenth are cut off."""
    s = read(spark, sf_dir, "supplier").repartition(spark.sparkContext.defaultParallelism, "s_suppkey")
    s = points(s, "s_suppkey").withColumns({"id": F.col("s_suppkey"), "w": F.lit(4.0) + F.col("s_suppkey") % 7, "h": F.lit(3.0) + F.col("s_suppkey") % 5})
    x, y = F.col("lon"), F.col("lat")
    outer = F.struct(F.lit(False).alias("hole"), rings.rectangle(x, y, x + F.col("w"), y + F.col("h")).alias("pts"))
    inner = F.struct(F.lit(True).alias("hole"), F.array(rings.point(x + 1, y + 1), rings.point(x + 2, y + 1), rings.point(x + 1, y + 2)).alias("pts"))
    s = s.withColumn("polygon", F.when(F.col("s_suppkey") % 2 == 1, F.array(outer, inner)).otherwise(F.array(outer)))
    path = f"{folder(spark)}/polygons-{uuid.uuid4().hex}"
    polygons.write(s.filter("id % 10 <> 9"), path)
    cut = s.filter("id % 10 = 9").withColumn("text", polygons.to_text(F.col("polygon"))).selectExpr("id", "left(text, length(text) - 24) AS text")
    polygons.write_texts(cut, path, "append")
    got, p = polygons.read(spark, path), F.col("polygon")
    return got.select(F.col("id").cast("bigint").alias("id"), F.when(p.isNotNull(), F.size(p)).alias("contours"), rings.vertex_count(p).alias("vertices"), r(rings.polygon_area(p)).alias("area"), F.col("error").isNotNull().alias("broken"))


@query("record_tiles", f"WITH {CELLS}, o AS (SELECT a AS ti, b AS tj FROM range(4) x(a), range(6) y(b)) SELECT k, CAST(tj * 4 + ti + 1 AS INT) AS tile, CAST(greatest(0, ti * 4 - 1) + 1 AS INT) AS ig3, CAST(greatest(0, tj * 4 - 1) + 1 AS INT) AS ig4, CAST(i - greatest(0, ti * 4 - 1) AS INT) AS li, CAST(j - greatest(0, tj * 4 - 1) AS INT) AS lj, round(v, 6) AS v FROM cells JOIN o ON i >= ti * 4 - 1 AND i <= ti * 4 + 4 AND j >= tj * 4 - 1 AND j <= tj * 4 + 4")
def record_tiles(spark, sf_dir):
    """The events' field of each day as one record, cut in tiles of 4 x 4 with a halo by slices of its array."""
    held = reading.dense(event_cells(spark, sf_dir).withColumn("n", F.col("j") * _WIDTH + F.col("i")), ["k"], F.lit(_WIDTH * _HEIGHT))
    records = held.select("k", "data", *[F.lit(v).alias(c) for c, v in (("ni", _WIDTH), ("nj", _HEIGHT), ("nk", 1), ("ip3", 0), ("ig3", 0), ("ig4", 0), ("grtyp", "Z"))])
    t = jobs.tiled(records, 4, 4, 1).select("k", F.col("ip3").alias("tile"), "ig3", "ig4", "ni", F.posexplode("data").alias("n", "v")).filter("NOT isnan(v)")
    return t.select("k", "tile", "ig3", "ig4", (F.col("n") % F.col("ni")).cast("int").alias("li"), F.floor(F.col("n") / F.col("ni")).cast("int").alias("lj"), r(F.col("v")).alias("v"))
