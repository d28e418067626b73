"""Queries that take their whole table: nothing is left out by a filter."""

import math

import pytest
from pyspark.sql import functions as F

from isobar.functions import expr
from isobar.operators import scatter
from isobar.plans import registry, scalars

from .test_queries import SF


def test_every_level_is_tiled_and_pasted(spark):
    days = {r.k for r in spark.read.parquet(f"{SF}/events.parquet").select(F.dayofmonth("ts").alias("k")).distinct().collect()}
    assert max(days) > 5
    for name in ("field_tiles", "grid_paste"):
        assert {r.k for r in registry.queries()[name](spark, SF).select("k").distinct().collect()} == days


def test_paste_keeps_levels_apart(spark):
    base = spark.createDataFrame([(k, i, 0, float(10 * k + i)) for k in (1, 2) for i in range(2)], "k long, i long, j long, v double")
    patch = spark.createDataFrame([(1, 0, 0, -1.0), (2, 0, 0, -2.0)], "k long, i long, j long, v double")
    assert {(r.k, r.i): r.v for r in scatter.paste(base, patch, 1, 0, keys=["k"]).collect()} == {(1, 0): 10.0, (1, 1): -1.0, (2, 0): 20.0, (2, 1): -2.0}


def test_radials_of_every_customer(spark):
    got = registry.queries()["fn_radials"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/customer.parquet").count()
    places = "SELECT * FROM VALUES (1L, 45.5D, -73.6D), (2L, 45.51D, -73.6D), (3L, 45.2D, 100D), (4L, -45.5D, 106.4D), (5L, 10D, 20D) AS t(id, lat, lon)"
    rows = {r.id: r for r in spark.sql(scalars._radials(expr.SPARK, places)).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    for k, r in rows.items():
        assert (r.ratio is None) == (r.across_km is None) == (k in (1, 4)), r
    assert (rows[5].across_km, rows[5].along_km, rows[5].foot_lat, rows[5].ratio) == (0, 0, 10, 0)


def test_radials_meet(spark):
    pairs = [((45.5, -73.6), (10, 20)), ((0, 0), (1, 1)), ((-30, 170), (20, -170)), ((60, 0), (-50, 10))]
    rows = [(*p, *q, *at) for p, q in pairs for at in [(50, -20), (-40, 100), (5, 179), (80, -100), (-60, -60)]]
    rad = [tuple(map(math.radians, r)) for r in rows]
    spark.createDataFrame(rad, "a double, o double, b double, p double, x double, y double").createOrReplaceTempView("radials")
    source = f"SELECT *, {expr.course_rad('a', 'o', 'x', 'y')} AS r, {expr.course_rad('b', 'p', 'x', 'y')} AS t FROM radials"
    for r in spark.sql(expr.radial_intersect(source, "a", "o", "b", "p", "r", "t")).collect():
        assert (r.met_lat, r.met_lon) == (pytest.approx(r.x, abs=1e-6), pytest.approx(r.y, abs=1e-6))
    none = "SELECT * FROM VALUES (0E0, 0E0, 0E0, 0.2E0, -0.8E0, 2.3E0), (0.1E0, 0.2E0, 0.1E0, 0.2E0, 0.8E0, -0.8E0) AS t(a, o, b, p, r, t)"
    assert [r.met_lat for r in spark.sql(expr.radial_intersect(none, "a", "o", "b", "p", "r", "t")).collect()] == [None, None]


def test_seconds_between_orders(spark):
    rows = registry.queries()["fn_between"](spark, SF).collect()
    orders = {r.o_orderkey: r for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("t")).collect()}
    last, want = {}, {}
    for k, r in sorted(orders.items(), key=lambda x: (x[1].t, x[0])):
        want[k] = r.t - last[r.o_custkey] if r.o_custkey in last else None
        last[r.o_custkey] = r.t
    assert {r.o_orderkey: r.between_s for r in rows} == want


def test_outcodes(spark):
    code = expr.outcode("x", "y", "0E0", "0E0", "2E0", "2E0")
    rows = spark.sql(f"SELECT x, y, {code} AS c FROM VALUES (1E0, 1E0), (0E0, 2E0), (-1E0, 1E0), (3E0, 1E0), (1E0, -1E0), (1E0, 3E0), (-1E0, -1E0), (3E0, 3E0) AS t(x, y)").collect()
    assert [r.c for r in rows] == [0, 0, 1, 2, 4, 8, 5, 10]
