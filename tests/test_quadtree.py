"""Quadtrees that follow density and buckets of all sizes, against plain splitting and comparing of all pairs."""

import random

from pyspark.sql import functions as F

from isobar.operators import nearest, quadtree


def plain_leaves(points, node, side, most, depth):
    level, bx, by = node
    size = side / 2**level
    own = [(x, y) for x, y in points if bx * size <= x < (bx + 1) * size and by * size <= y < (by + 1) * size]
    if len(own) <= most or level == depth:
        return {node: len(own)}
    out = {}
    for a in (0, 1):
        for b in (0, 1):
            out |= plain_leaves(own, (level + 1, 2 * bx + a, 2 * by + b), side, most, depth)
    return out


def test_leaves_follow_density(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(0, 64), rng.uniform(0, 64)) for _ in range(200)] + [(10 + rng.gauss(0, 0.2), 20 + rng.gauss(0, 0.2)) for _ in range(400)] + [(50.0, 50.0)] * 30
    df = spark.createDataFrame([(float(x), float(y)) for x, y in rows] + [(None, 1.0), (1.0, None)], "x double, y double")
    got = {(r.level, r.bx, r.by): r.n for r in quadtree.leaves(df, 64.0, 6, 9).collect()}
    assert got == plain_leaves(rows, (0, 0, 0), 64.0, 6, 9)
    assert sum(got.values()) == 630 and all(n <= 6 or level == 9 for (level, _, _), n in got.items()) and max(level for level, _, _ in got) == 9
    own = quadtree.leaf_of(df, quadtree.leaves(df, 64.0, 6, 9), 64.0)
    assert own.count() == 630 and own.groupBy("level", "bx", "by").agg(F.count("*").alias("m"), F.max("n").alias("n")).filter("m <> n").count() == 0
    assert quadtree.leaves(df.limit(0), 64.0, 6).count() == 0


def test_points_meet_few_targets_in_a_crowd(spark):
    """What a point meets in its first round follows k and hardly the number of targets, here ten times as many."""
    rng, met = random.Random(2), []
    for n in (300, 3000):
        rows = [(i, 100 + rng.gauss(0, 0.5), 10 + rng.gauss(0, 0.5)) for i in range(n)] + [(n + i, rng.uniform(-180, 180), rng.uniform(-85, 85)) for i in range(100)]
        t = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in rows], "id long, tx double, ty double")
        tree = quadtree.leaves(t, 360.0, 5, x="tx", y="ty", period=True)
        p = quadtree.leaf_of(t.filter("id % 3 = 0"), tree, 360.0, "tx", "ty", True)
        near = p.withColumn("bx", F.explode(F.array(*[F.col("bx") + d for d in (-1, 0, 1)]))).withColumn("by", F.explode(F.array(*[F.col("by") + d for d in (-1, 0, 1)])))
        at = quadtree.leaf_of(t, tree, 360.0, "tx", "ty", True).select("level").distinct()
        at = t.select("tx", "ty").join(at).withColumns({"bx": quadtree.bucket(F.col("tx"), 360.0, F.col("level"), True), "by": quadtree.bucket(F.col("ty"), 360.0, F.col("level"))})
        met.append(near.join(at, ["level", "bx", "by"]).count() / p.count())
    assert met[1] < 2 * met[0] < 100


def test_boxes_of_all_sizes_meet_once(spark):
    rng = random.Random(3)
    boxes = []
    for k in range(160):
        x, y, size = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.0, 0.01, 0.3, 2.0, 9.0, 70.0])
        boxes.append((k, (x, y, x + size * rng.random(), y + size * rng.random())))
    boxes += [(200, (0.0, 0.0, 8.0, 8.0)), (201, (8.0, 8.0, 16.0, 16.0)), (202, (-8.0, -8.0, 0.0, 0.0))]
    kind = "struct<x0: double, y0: double, x1: double, y1: double>"
    left, right = spark.createDataFrame(boxes, f"a long, e {kind}"), spark.createDataFrame(boxes, f"b long, f {kind}")
    got = [(r.a, r.b) for r in quadtree.meetings(left, right, "e", "f").collect()]
    meet = lambda p, q: p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]
    assert sorted(got) == sorted((a, b) for a, p in boxes for b, q in boxes if meet(p, q))
    most = quadtree.box_buckets(left, "e").groupBy("a").count().agg(F.max("count")).first()[0]
    assert most <= 4
    points = spark.createDataFrame([(k, float(rng.uniform(-60, 60)), float(rng.uniform(-60, 60))) for k in range(200)], "id long, x double, y double")
    dealt = quadtree.box_buckets(left, "e")
    hits = quadtree.point_buckets(points, dealt).join(dealt, ["level", "bx", "by"]).filter("x BETWEEN e.x0 AND e.x1 AND y BETWEEN e.y0 AND e.y1")
    want = {(r.id, a) for r in points.collect() for a, p in boxes if p[0] <= r.x <= p[2] and p[1] <= r.y <= p[3]}
    found = [(r.id, r.a) for r in hits.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_nearest_in_a_crowd_and_far_from_it(spark):
    rng = random.Random(4)
    targets = [(i, 20 + rng.gauss(0, 0.01), 30 + rng.gauss(0, 0.01)) for i in range(300)] + [(400, 20.0, 30.0)] * 1 + [(500 + i, 25.0, 35.0) for i in range(9)]
    points = [(0, 20.0, 30.0), (1, -170.0, -80.0), (2, 25.0, 35.0), (3, 20.02, 30.01)]
    frame = lambda rows: spark.createDataFrame([(i, float(x), float(y)) for i, x, y in rows], "id long, lon double, lat double")
    got = {}
    for r in nearest.k_nearest(frame(points), frame(targets), 4).collect():
        got.setdefault(r.id, []).append((r.rank, r.target))
    for i, x, y in points:
        want = sorted((min(abs(x - a), 360 - abs(x - a)) ** 2 + (y - b) ** 2, t) for t, a, b in targets)[:4]
        assert [t for _, t in sorted(got[i])] == [t for _, t in want]
