"""The regrid index against direct regridding, and convex clipping against areas from plain geometry."""

import random

import pytest
from pyspark.sql import functions as F

from isobar.functions import rings
from isobar.operators import gather, regrid
from isobar.operators.globe import Globe

RING = "array<struct<x: double, y: double>>"


def plain_clip(ring, by):
    area = lambda g: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(g, g[1:] + g[:1])) / 2
    by = by if area(by) > 0 else by[::-1]
    for a, b in zip(by, by[1:] + by[:1]):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: E731, B023
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            if side(p) >= 0:
                out.append(p)
            if side(p) * side(q) < 0:
                t = side(p) / (side(p) - side(q))
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = out
        if not ring:
            return 0.0
    return abs(area(ring))


def test_clip_of_convex_rings(spark):
    rng = random.Random(1)
    from math import cos, pi, sin

    def ring(n):
        x, y, r = rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(0.3, 3)
        return [(x + r * cos(a), y + r * sin(a)) for a in sorted(rng.uniform(0, 2 * pi) for _ in range(n))][:: rng.choice([1, -1])]

    pairs = [(k, ring(rng.randint(3, 6)), ring(rng.randint(3, 6))) for k in range(120)]
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    pairs += [(200, square, square), (201, square, [(x + 2, y) for x, y in square]), (202, square, [(x / 2 + 0.5, y / 2 + 0.5) for x, y in square]), (203, [(x / 2 + 0.5, y / 2 + 0.5) for x, y in square], square)]
    df = spark.createDataFrame(pairs, f"id long, a {RING}, b {RING}")
    got = {r.id: r.w for r in df.select("id", rings.area(rings.clip_convex(F.col("a"), F.col("b"))).alias("w")).collect()}
    for k, a, b in pairs:
        assert got[k] == pytest.approx(plain_clip(a, b), abs=1e-9)
    assert (got[200], got[201], got[202], got[203]) == (4.0, 0.0, 1.0, 1.0)


def grids(spark):
    rng = random.Random(2)
    cells = spark.createDataFrame([(k, t, i, j, rng.random()) for k in range(3) for t in range(2) for i in range(8) for j in range(6) if (i, j, k) != (3, 2, 1)], "k long, t long, i long, j long, v double")
    places = spark.createDataFrame([(d, d % 7, rng.uniform(0, 8), rng.uniform(0, 5)) for d in range(60)] + [(90, 0, 2.0, 3.0), (91, 0, 7.5, 5.0), (92, 0, 3.0, 2.5)], "di long, dj long, x double, y double")
    return cells, places


@pytest.mark.parametrize("how", ["bilinear", "nearest"])
def test_index_equals_direct_regridding(spark, tmp_path, how):
    cells, places = grids(spark)
    globe, index, calls = Globe(8, 6, 1), regrid.RegridIndex(spark, f"{tmp_path}/index"), []
    make = lambda: calls.append(1) or getattr(regrid, how)(places, globe=globe)
    assert not index.has("a/b", "c d") and index.fill("a/b", "c d", make) and not index.fill("a/b", "c d", make) and index.has("a/b", "c d") and len(calls) == 1
    index.fill("other", "c d", lambda: getattr(regrid, how)(places.limit(3)))
    got = {(r.k, r.t, r.di): r.value for r in index.apply(cells, "a/b", "c d", ["k", "t"]).collect()}
    points = places.crossJoin(spark.range(3).withColumnRenamed("id", "k")).crossJoin(spark.range(2).withColumnRenamed("id", "t"))
    direct = (gather.bilinear if how == "bilinear" else gather.nearest)(points, cells, ["k", "t"], globe=globe)
    for r in direct.collect():
        assert got.get((r.k, r.t, r.di)) == (None if r.value is None else pytest.approx(r.value, abs=1e-12))
    assert index.weights("other", "c d").select("di").distinct().count() == 3
    plan = index.apply(cells, "a/b", "c d", ["k", "t"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and not any(c in plan for c in ("ring", "LocalTableScan [di", " x#", " y#"))
    assert index.fill("other", "c d", lambda: getattr(regrid, how)(places.limit(5)), again=True) and index.weights("other", "c d").select("di").distinct().count() == 5
    assert index.weights("a/b", "c d").select("di").distinct().count() == places.count()
    index.drop("other", "c d")
    assert not index.has("other", "c d") and index.has("a/b", "c d")


def test_missing_source_cells(spark):
    weights = spark.createDataFrame([(0, 0, 1, 1, 0.25), (1, 0, 1, 1, 0.75), (2, 0, 2, 1, 1.0)], "si long, sj long, di long, dj long, w double")
    field = spark.createDataFrame([(7, 0, 0, 4.0), (7, 1, 0, None), (7, 2, 0, 5.0), (8, 0, 0, 4.0), (8, 1, 0, 8.0), (8, 9, 9, 1.0)], "k long, i long, j long, v double")
    for how, want in (("strict", {(7, 1): None, (7, 2): 5.0, (8, 1): 7.0}), ("there", {(7, 1): 4.0, (7, 2): 5.0, (8, 1): 7.0}), ("sum", {(7, 1): 1.0, (7, 2): 5.0, (8, 1): 7.0})):
        assert {(r.k, r.di): r.value for r in regrid.apply(field, weights, ["k"], how).collect()} == want
    assert regrid.apply(field.limit(0), weights, ["k"]).count() == 0


def test_totals_are_conserved_between_meshes(spark):
    rng = random.Random(3)
    bend = lambda i, j: (i + 0.3 * ((j * 7) % 3) / 3, j + 0.2 * ((i * 5) % 4) / 4)
    quads = [(i, j, [bend(i, j), bend(i + 1, j), bend(i + 1, j + 1), bend(i, j + 1)], rng.uniform(-5, 5)) for i in range(6) for j in range(6)]
    big = [(i, j, [(x, y) for x, y in ((2.5 * i - 1, 2.5 * j - 1), (2.5 * i + 1.5, 2.5 * j - 1), (2.5 * i + 1.5, 2.5 * j + 1.5), (2.5 * i - 1, 2.5 * j + 1.5))]) for i in range(4) for j in range(4)]
    source = spark.createDataFrame(quads, f"si long, sj long, ring {RING}, v double")
    w = regrid.conservative(source, spark.createDataFrame(big, f"di long, dj long, ring {RING}"))
    sums = w.groupBy("si", "sj").agg(F.sum("w").alias("w")).collect()
    assert len(sums) == 36 and all(abs(r.w - 1) < 1e-9 for r in sums)
    out = regrid.apply(source.select(F.col("si").alias("i"), F.col("sj").alias("j"), "v"), w, [], "sum")
    assert out.agg(F.sum("value")).first()[0] == pytest.approx(sum(q[3] for q in quads), abs=1e-9)
    got = {(r.si, r.sj, r.di, r.dj): r.w for r in w.collect()}
    for i, j, ring, _ in quads:
        for a, b, cell in big:
            assert got.get((i, j, a, b), 0.0) == pytest.approx(plain_clip(ring, cell) / plain_clip(ring, ring), abs=1e-9)
