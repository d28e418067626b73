"""Nearest points, series, layers and rings against plain versions, and sun and moon against another almanac's formulas."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from isobar.functions import expr, rings
from isobar.operators import catalog, descriptors, fields, gather, geometry, layers, nearest, scatter
from isobar.plans import scalars


def plain_nearest(points, targets, k, period):
    out = {}
    for i, x, y in points:
        d = []
        for t, u, v in targets:
            dx = abs(x - u)
            dx = min(dx, period - dx) if period else dx
            d.append((dx * dx + (y - v) ** 2, t))
        out[i] = sorted(d)[:k]
    return out


@pytest.mark.parametrize("period, cell", [(360.0, 7.0), (360.0, 400.0), (None, 40.0), (360.0, None), (None, None)])
def test_k_nearest(spark, period, cell):
    rng = random.Random(5)
    place = (lambda: (rng.choice([rng.uniform(-180, 180), rng.uniform(175, 180), rng.uniform(-180, -175)]), rng.uniform(-90, 90))) if period else (lambda: (rng.uniform(0, 1000), rng.uniform(0, 1000)))
    targets = [(k, *place()) for k in range(150)] + [(900, 179.9, 0.0), (901, -179.9, 0.0), (902, 170.0, 0.0)]
    points = [(k, *place()) for k in range(80)] + [(500, 179.9, 0.0), (501, -180.0, 0.0), (502, 180.0, 0.0), (503, 700.0 if not period else 0.0, 300.0 if not period else 89.0)]
    frame = lambda rows: spark.createDataFrame([(i, float(x), float(y)) for i, x, y in rows], "id long, lon double, lat double")
    want = plain_nearest(points, targets, 4, period)
    got = nearest.k_nearest(frame(points), frame(targets), 4, cell, period).collect()
    assert len(got) == 4 * len(points)
    for r in got:
        d, t = want[r.id][r.rank - 1]
        assert r.d2 == pytest.approx(d, abs=1e-9) and (t == r.target or d == pytest.approx(want[r.id][r.rank - 2][0], abs=1e-9) or r.rank == 4)
    few = nearest.k_nearest(frame(points), frame(targets[:2]), 4, cell, period).collect()
    assert len(few) == 2 * len(points)
    assert nearest.k_nearest(frame(points), frame(targets).limit(0), 4, cell, period).count() == 0
    assert nearest.k_nearest(frame(points).limit(0), frame(targets), 4, cell, period).count() == 0


def test_as_of_over_spans(spark):
    rng = random.Random(1)
    left = [(k % 3, rng.randrange(0, 5000), k) for k in range(200)]
    right = [(k % 4, rng.randrange(0, 5000), f"v{k}") for k in range(60)]
    l_, r_ = spark.createDataFrame(left, "g long, at long, n long"), spark.createDataFrame(right, "g long, t long, v string")
    for span in (100, 86400):
        got = {r.n: (r.before.t, r.before.v) if r.before else None for r in fields.as_of(l_, r_, ["g"], "at", span=span).collect()}
        assert got == {n: max(((t, v) for h, t, v in right if h == g and t <= at), default=None) for g, at, n in left}


def test_time_blend_over_spans(spark):
    rng = random.Random(2)
    rows = [(g, t, float(rng.randrange(100))) for g in range(3) for t in sorted(rng.sample(range(5000), 12))]
    df = spark.createDataFrame(rows, "g long, t long, v double")
    want = {}
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        for (_, a, v), (_, b, w) in zip(own, own[1:]):
            want |= {(g, x): v + (w - v) * (x - a) / (b - a) for x in range(-(-a // 50) * 50, b, 50)}
    for span in (300, 86400):
        got = {(r.g, r.time): r.blend for r in fields.time_blend(df, ["g"], "t", "v", 50, span).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_conservative_layers_keep_values(spark):
    rng = random.Random(3)
    shapes = []
    for k in range(30):
        cx, cy, n = rng.uniform(2, 8), rng.uniform(2, 8), rng.randint(3, 9)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        if max(b - a for a, b in zip(turns, [*turns[1:], turns[0] + 2 * math.pi])) < 3:
            shapes.append((k, [{"x": cx + 1.7 * math.cos(t), "y": cy + 1.7 * math.sin(t)} for t in turns], rng.uniform(1, 9)))
    f = spark.createDataFrame(shapes, "fid long, ring array<struct<x: double, y: double>>, value double")
    held = layers.parts(f, 11, 11)
    sums = {r.fid: (r.a, r.whole) for r in held.groupBy("fid").agg(F.sum("part").alias("a"), F.first("whole").alias("whole")).collect()}
    assert len(sums) == len(shapes) and all(a == pytest.approx(w) for a, w in sums.values())
    total = layers.burn(layers.weights(held, "conservative"), f, F.col("value")).agg(F.sum("v")).first()[0]
    assert total == pytest.approx(sum(v for _, _, v in shapes))
    line = spark.createDataFrame([(1, [{"x": 0.2, "y": 0.3}, {"x": 5.7, "y": 4.1}, {"x": 5.7, "y": 9.0}])], "fid long, ring array<struct<x: double, y: double>>")
    r = layers.parts(line, 11, 11, length=True).agg(F.sum("part").alias("a"), F.first("whole").alias("w")).first()
    assert r.a == pytest.approx(r.w) == pytest.approx(math.hypot(5.5, 3.8) + 4.9)


def test_wrap_split_keeps_area(spark):
    ring = [{"x": x, "y": y} for x, y in [(170.0, 0.0), (-175.0, -3.0), (-165.0, 5.0), (176.0, 9.0)]]
    df = spark.createDataFrame([(1, ring), (2, [{"x": p["x"] / 10, "y": p["y"]} for p in ring])], "id int, ring array<struct<x: double, y: double>>")
    got = {r.id: r for r in df.select("id", rings.wrap_split(F.col("ring"), -180.0, 180.0).alias("parts"), rings.area(rings.unwrapped(F.col("ring"), 360.0)).alias("whole")).collect()}
    area = lambda p: abs(sum(a.x * b.y - b.x * a.y for a, b in zip(p, [*p[1:], p[0]]))) / 2
    assert len(got[1].parts) == 2 and len(got[2].parts) == 1
    for r in got.values():
        assert sum(map(area, r.parts)) == pytest.approx(r.whole) and all(-180 <= q.x <= 180 for p in r.parts for q in p)


def test_variance_of_large_means(spark):
    df = spark.createDataFrame([(1, 1e9 + d) for d in (-1.0, 0.0, 1.0)] + [(2, 5.0)], "c int, v double")
    means = spark.createDataFrame([(1, 1e9), (2, 3.0)], "c int, mean double")
    assert {r.c: r.variance for r in scatter.variance(df, means, ["c"], "v").collect()} == {1: pytest.approx(2 / 3), 2: 4.0}


def test_wind_direction(spark):
    cells = spark.createDataFrame([(i, j, 0.0, -10.0) for i in range(2) for j in range(2)], "i long, j long, u double, v double").withColumn("k", F.lit(1))
    r = gather.wind(spark.createDataFrame([(1, 1, 0.5, 0.5)], "id int, k int, x double, y double"), cells, ["k"]).first()
    assert (r.speed, r.dir) == (pytest.approx(10.0), pytest.approx(0.0))


def test_sun_and_moon_against_low_precision_almanac(spark):
    """The Astronomical Almanac's low-precision formulas: the sun to 0.01, the moon to 0.3 degrees, in declination and hour angle."""
    at = [datetime.datetime(1988, 7, 27, tzinfo=datetime.UTC) + datetime.timedelta(days=137.31 * k) for k in range(60)]
    source = "SELECT * FROM VALUES " + ", ".join(f"({k}, {int(t.timestamp())}L)" for k, t in enumerate(at)) + " AS t(id, s)"
    rad, deg = math.radians, math.degrees
    for r in spark.sql(scalars.sky(expr.SPARK, source)).collect():
        n = at[r.id].timestamp() / 86400 + 2440587.5 - 2451545.0
        g, q = rad(357.528 + 0.9856003 * n), 280.460 + 0.9856474 * n
        lam, tilt = rad(q + 1.915 * math.sin(g) + 0.020 * math.sin(2 * g)), rad(23.439 - 4e-7 * n)
        ra, de = math.atan2(math.cos(tilt) * math.sin(lam), math.cos(lam)), math.asin(math.sin(tilt) * math.sin(lam))
        gst = rad(280.46062 + 360.98564737 * n)
        turn = lambda x: (x + 180) % 360 - 180
        assert abs(r.sun_lat - deg(de)) < 0.03 and abs(turn(r.sun_lon - deg(ra - gst))) < 0.06
        c = n / 36525
        s = lambda a, b: math.sin(rad(a + b * c))
        ml = 218.32 + 481267.881 * c + 6.29 * s(135.0, 477198.87) - 1.27 * s(259.3, -413335.36) + 0.66 * s(235.7, 890534.22) + 0.21 * s(269.9, 954397.74) - 0.19 * s(357.5, 35999.05) - 0.11 * s(186.5, 966404.03)
        mb = 5.13 * s(93.3, 483202.02) + 0.28 * s(228.2, 960400.89) - 0.28 * s(318.3, 6003.15) - 0.17 * s(217.6, -407332.21)
        lam, beta = rad(ml), rad(mb)
        de = math.asin(math.sin(beta) * math.cos(tilt) + math.cos(beta) * math.sin(tilt) * math.sin(lam))
        ra = math.atan2(math.sin(lam) * math.cos(tilt) - math.tan(beta) * math.sin(tilt), math.cos(lam))
        assert abs(r.moon_lat - deg(de)) < 0.5 and abs(turn(r.moon_lon - deg(ra - gst))) < 0.8


def test_numbers_by_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(10**6), k) for k in range(500)]
    df = spark.createDataFrame(rows, "nomvar string, ip1 long, rec long").repartition(4)
    want = {(r.rec, r.place) for r in catalog.numbered(df, ["nomvar"], ["ip1", "rec"]).collect()}
    assert {(r.rec, r.place) for r in catalog.numbered(df, ["nomvar"], ["ip1", "rec"], ranges=True).collect()} == want and len(want) == 500


def test_fold_of_a_hot_group(spark):
    box = lambda x, y: [[{"x": x, "y": y}, {"x": x + 1.0, "y": y}, {"x": x + 1.0, "y": y + 1.0}, {"x": x, "y": y + 1.0}]]
    df = spark.createDataFrame([(1, box(float(i), float(j))) for i in range(4) for j in range(3)] + [(1, box(0.5, 0.5)), (2, box(0.0, 0.0))], "g int, rings array<array<struct<x: double, y: double>>>")
    out = geometry.fold(df, ["g"], "rings", "union", 4)
    areas = {r.g: r.a for r in out.select("g", F.aggregate("rings", F.lit(0.0), lambda t, p: t + rings.signed_area(p)).alias("a")).collect()}
    assert areas == {1: pytest.approx(12.0), 2: pytest.approx(1.0)}
    with pytest.raises(ValueError):
        geometry.fold(df, ["g"], "rings", "difference")


def test_queries_leave_views_alone(spark):
    spark.range(3).createOrReplaceTempView("orders")
    assert "between_s" in scalars.QUERIES["fn_between"](spark, "/root/testdata/sf0.001").columns
    assert spark.table("orders").count() == 3 and [t.name for t in spark.catalog.listTables() if t.name.startswith("orders_")] == []
    spark.catalog.dropTempView("orders")


def test_pressure_of_levels_that_a_table_lacks(spark):
    columns = "id long, kind string, version int, ptop double, pref double, rcoef0 double, rcoef1 double, levels array<struct<ip: int, a: double, b: double>>, ip1 int"
    table, empty = [(100, 9.5, 1.0), (200, 9.0, 0.5)], []
    rows = [(k, "HYBRID", v, 10.0, 800.0, 1.6, 0.0, levels, ip1) for k, (v, levels, ip1) in enumerate([(5001, table, 200), (5001, table, 400), (5002, table, 100), (5002, table, 400), (5001, empty, 100), (5002, None, 100)])]
    got = spark.createDataFrame(rows, columns).select("id", descriptors.pressure(F.lit(0.9), F.col("ip1"), F.lit(1000.0)).alias("p")).collect()
    want = [0.09 + 500, None, math.exp(9.5 + math.log(1000 / 800)) / 100, None, None, None]
    assert [r.p for r in sorted(got)] == [None if w is None else pytest.approx(w) for w in want]
