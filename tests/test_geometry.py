import math
import random

import pytest
from pyspark.sql import functions as F

from isobar.functions import rings
from isobar.operators import geometry as g


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def area(r):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, [*r[1:], *r[:1]])) / 2


@pytest.mark.parametrize("op, want", [("intersection", 4), ("union", 20), ("difference", 12), ("xor", 16)])
def test_boxes(op, want):
    assert sum(map(area, g.clip([box(0, 0, 4, 4)], [box(2, 1, 4, 2)], op))) == pytest.approx(want)


def test_random_polygons_agree():
    rng = random.Random(3)
    for _ in range(150):
        star = lambda: [[(rng.uniform(-1, 1) + rng.uniform(0.5, 4) * math.cos(k), rng.uniform(0.5, 4) * math.sin(k)) for k in range(6)]]
        p, q = star(), star()
        a = {op: g.trapezoid_area(g.trapezoids(p, q, op)) for op in g.OPS}
        assert a["union"] == pytest.approx(a["intersection"] + a["xor"], abs=1e-6)
        for op in g.OPS:
            assert sum(map(area, g.clip(p, q, op))) == pytest.approx(a[op], abs=1e-4)


def test_hole_and_explode():
    r = g.clip([box(0, 0, 4, 4)], [box(1, 1, 1, 1)], "difference")
    assert sorted(map(area, r)) == [-1, 16] and len(g.explode_multi(r)) == 1


def test_simplify_raster_and_lines():
    assert g.simplify([(0, 0), (1, 0.01), (2, 0), (2, 2)], 0.1) == [(0, 0), (2, 0), (2, 2)]
    assert g.rasterise([box(0.5, 0.5, 3, 2)], 10, 10) == [(i, j) for j in (1, 2) for i in (1, 2, 3)]
    assert g.clip_line([(-1, 1), (5, 1)], [box(0, 0, 4, 4)]) == [[(0.0, 1.0), (4.0, 1.0)]]
    assert g.line_cells(0, 0, 3, 1)[0] == (0, 0) and g.line_cells(0, 0, 3, 1)[-1] == (3, 1)


def test_ring_functions(spark):
    df = spark.range(1).select(rings.rectangle(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(2.0)).alias("r"))
    p = rings.point(F.lit(5.0), F.lit(1.0))
    row = df.select(rings.area(F.col("r")), rings.length(F.col("r")), rings.distance_to(F.col("r"), p), rings.contains_point(F.col("r"), F.lit(1.0), F.lit(1.0)), rings.closest_vertex(F.col("r"), p)["x"], F.size(rings.clean(F.concat("r", F.slice("r", 4, 1))))).first()
    assert tuple(row) == (8.0, 12.0, 1.0, True, 4.0, 4)


def test_edges_that_bend_get_vertices(spark):
    """A long edge along a parallel keeps to its projection within the tolerance, a straight one stays as it is, and a step over the date line is short."""
    import math

    from pyspark.sql import functions as F

    from isobar.functions import expr, rings

    kind = "array<struct<x: double, y: double>>"
    df = spark.createDataFrame([(1, [(0.0, 60.0), (80.0, 60.0), (80.0, 61.0), (0.0, 61.0)]), (2, [(170.0, 0.0), (175.0, 0.0), (175.0, 1.0)])], f"id int, ring {kind}")
    turn = lambda x, y: expr.rotate(y, x, 40.0, 15.0)[::-1]
    got = {r.id: r for r in df.select("id", "ring", rings.projected("ring", turn, 0.001, 360.0).alias("fine"), rings.projected("ring", turn).alias("plain"), rings.projected("ring", lambda x, y: expr.affine([1.0, 2.0, 0.0, 0.0, 0.0, 2.0], x, y), 0.001).alias("same")).collect()}
    assert len(got[1].same) == 4 and len(got[2].same) == 3 and len(got[1].plain) == 4 and len(got[1].fine) > 40
    kept = {(round(p.x, 9), round(p.y, 9)) for p in got[1].fine}
    assert all((round(p.x, 9), round(p.y, 9)) in kept for p in got[1].plain)
    ct, st, cp, sp = (f(math.radians(a)) for a, f in ((40, math.cos), (40, math.sin), (15, math.cos), (15, math.sin)))

    def plain(x, y):
        a, b = math.radians(y), math.radians(x)
        v = math.cos(b) * math.cos(a), math.sin(b) * math.cos(a), math.sin(a)
        return math.degrees(math.atan2(cp * v[1] - sp * v[0], ct * cp * v[0] + ct * sp * v[1] + st * v[2])), math.degrees(math.asin(ct * v[2] - st * cp * v[0] - st * sp * v[1]))

    fine = [(p.x, p.y) for p in got[1].fine]
    for k in range(500):
        x, y = plain(80 * k / 500, 60.0)
        near = min(abs((q[0] - p[0]) * (p[1] - y) - (p[0] - x) * (q[1] - p[1])) / math.dist(p, q) for p, q in zip(fine, fine[1:]) if min(p[0], q[0]) - 1e-9 <= x <= max(p[0], q[0]) + 1e-9)
        assert near < 0.0015
    assert df.select(F.size(rings.projected("ring", lambda x, y: (f"({x} + 8 - 360 * floor(({x} + 188) / 360))", y), 0.01, 360.0)).alias("n")).collect()[1].n == 3
