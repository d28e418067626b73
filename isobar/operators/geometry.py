"""Polygon set operations and other kernels that higher-order functions can't express, as Arrow-batched functions.

Clipping cuts the plane in horizontal bands at every vertex and every crossing of edges. Within a band edges don't cross, so from left to right the
even-odd state of both polygons gives the result's trapezoids. These are the strips; for rings, the trapezoids' sides and the parts of band borders with the result on
one side only are chained, keeping the inside to the left. Coordinates are taken to ``PLACES`` decimals, and band borders closer than a tenth of that are one.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quadtree

RING = "array<struct<x: double, y: double>>"
RINGS = f"array<{RING}>"
_ARROW_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
PLACES = 7
OPS = {"difference": lambda a, b: a and not b, "intersection": lambda a, b: a and b, "xor": lambda a, b: a != b, "union": lambda a, b: a or b}


def _edges(rings, who):
    for ring in rings:
        ring = [(round(x, PLACES), round(y, PLACES)) for x, y in ring]
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]]):
            if ay != by:
                yield (ax, ay, bx, by, who) if ay < by else (bx, by, ax, ay, who)


def _x(e, y):
    ax, ay, bx, by, _ = e
    return ax if y == ay else bx if y == by else ax + (bx - ax) * (y - ay) / (by - ay)


def trapezoids(a: list, b: list, op: str) -> list[tuple]:
    """(y0, y1, left at y0, left at y1, right at y0, right at y1) of a op b; polygons are lists of rings of (x, y), even-odd."""
    inside, es = OPS[op], [*_edges(a, 0), *_edges(b, 1)]
    ys = {y for e in es for y in (e[1], e[3])}
    for i, e in enumerate(es):
        for f in es[:i]:
            if max(e[1], f[1]) < min(e[3], f[3]):
                se, sf = (e[2] - e[0]) / (e[3] - e[1]), (f[2] - f[0]) / (f[3] - f[1])
                if se != sf:
                    y = (f[0] - sf * f[1] - e[0] + se * e[1]) / (se - sf)
                    if max(e[1], f[1]) < y < min(e[3], f[3]):
                        ys.add(y)
    out = []
    near, bounds = 0.1**PLACES / 10, sorted({y for e in es for y in (e[1], e[3])})
    for y in sorted(ys):
        at = bisect.bisect(bounds, y)
        if all(abs(y - v) > near for v in bounds[max(0, at - 1) : at + 1]):
            bounds.insert(at, y)
    for y0, y1 in pairwise(bounds):
        live = sorted((_x(e, y0) + _x(e, y1), k) for k, e in enumerate(es) if e[1] <= y0 and e[3] >= y1)
        state, left = [False, False], None
        for _, k in live:
            was = inside(*state)
            state[es[k][4]] = not state[es[k][4]]
            now = inside(*state)
            if now and not was:
                left = es[k]
            elif was and not now:
                t = (y0, y1, _x(left, y0), _x(left, y1), _x(es[k], y0), _x(es[k], y1))
                if t[4] - t[2] > 1e-12 or t[5] - t[3] > 1e-12:
                    out.append(t)
    return out


def trapezoid_area(ts: list[tuple]) -> float:
    return sum((y1 - y0) * ((r0 - l0) + (r1 - l1)) / 2 for y0, y1, l0, l1, r0, r1 in ts)


def to_rings(ts: list[tuple]) -> list[list[tuple[float, float]]]:
    """Rings round trapezoids: outer ones counterclockwise, holes clockwise, without vertices on straight lines."""
    key = lambda x, y: (round(x, 9) + 0.0, round(y, 9) + 0.0)
    nxt: dict = defaultdict(list)
    levels: dict = defaultdict(lambda: ([], []))
    for y0, y1, l0, l1, r0, r1 in ts:
        nxt[key(l1, y1)].append(key(l0, y0))
        nxt[key(r0, y0)].append(key(r1, y1))
        levels[round(y0, 9)][1].extend((l0, r0))
        levels[round(y1, 9)][0].extend((l1, r1))
    for y, (below, above) in levels.items():
        events = sorted({round(x, 9) + 0.0 for x in (*below, *above)})
        on = lambda xs, m: sum(xs[i] <= m < xs[i + 1] for i in range(0, len(xs), 2)) % 2 == 1
        for p, q in pairwise(events):
            m = (p + q) / 2
            b, a = on(below, m), on(above, m)
            if b and not a:
                nxt[key(q, y)].append(key(p, y))
            elif a and not b:
                nxt[key(p, y)].append(key(q, y))
    out = []
    for start in list(nxt):
        while nxt[start]:
            ring, at = [start], nxt[start].pop()
            while at != start and nxt[at]:
                ring.append(at)
                if len(nxt[at]) > 1:  # the sharpest turn to the left keeps rings that touch apart
                    (px, py), (qx, qy) = ring[-2], at
                    back = math.atan2(py - qy, px - qx)
                    nxt[at].sort(key=lambda t: (back - math.atan2(t[1] - qy, t[0] - qx)) % (2 * math.pi))
                    at = nxt[at].pop(0)
                else:
                    at = nxt[at].pop()
            ring = [p for p, b, c in zip(ring, [ring[-1], *ring[:-1]], [*ring[1:], ring[0]]) if abs((p[0] - b[0]) * (c[1] - p[1]) - (p[1] - b[1]) * (c[0] - p[0])) > 1e-9]
            if len(ring) > 2:
                out.append(ring)
    return out


def clip(a: list, b: list, op: str) -> list:
    return to_rings(trapezoids(a, b, op))


def simplify(pts: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Vertices at least tolerance apart, then those that lie farther than tolerance from the line between kept ones."""
    kept = pts[:1]
    for p in pts[1:]:
        if (p[0] - kept[-1][0]) ** 2 + (p[1] - kept[-1][1]) ** 2 >= tolerance * tolerance:
            kept.append(p)
    if pts and kept[-1] != pts[-1]:
        kept.append(pts[-1])
    mark, stack = {0, len(kept) - 1}, [(0, len(kept) - 1)]
    while stack:
        i, j = stack.pop()
        (ax, ay), (bx, by) = kept[i], kept[j]
        dx, dy = bx - ax, by - ay
        n, far, at = dx * dx + dy * dy, tolerance, -1
        for k in range(i + 1, j):
            px, py = kept[k][0] - ax, kept[k][1] - ay
            t = min(1.0, max(0.0, (px * dx + py * dy) / n)) if n else 0.0
            d = math.hypot(px - t * dx, py - t * dy)
            if d > far:
                far, at = d, k
        if at >= 0:
            mark.add(at)
            stack += [(i, at), (at, j)]
    return [kept[k] for k in sorted(mark)]


def rasterise(rings: list, width: int, height: int) -> list[tuple[int, int]]:
    """Cells (i, j) whose centre lies inside, by scan lines."""
    es, out = list(_edges(rings, 0)), []
    for j in range(height):
        xs = sorted(_x(e, j) for e in es if e[1] <= j < e[3])
        for a, b in zip(xs[::2], xs[1::2]):
            out += [(i, j) for i in range(max(0, math.ceil(a)), min(width - 1, math.ceil(b) - 1) + 1)]
    return out


def line_cells(x0: float, y0: float, x1: float, y1: float) -> list[tuple[int, int]]:
    """Cells along a segment, one for each step of its longer side."""
    n = max(1, round(max(abs(round(x1) - round(x0)), abs(round(y1) - round(y0)))))
    a, b = (round(x0), round(y0)), (round(x1), round(y1))
    return [(round(a[0] + (b[0] - a[0]) * k / n), round(a[1] + (b[1] - a[1]) * k / n)) for k in range(n + 1)]


def split(rings: list, most: int) -> list[list]:
    """Halved across the longer side until a part has at most ``most`` vertices."""
    if sum(map(len, rings)) <= most or not rings:
        return [rings] if rings else []
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
    if x1 - x0 >= y1 - y0:
        m = (x0 + x1) / 2
        halves = [[[(x0, y0), (m, y0), (m, y1), (x0, y1)]], [[(m, y0), (x1, y0), (x1, y1), (m, y1)]]]
    else:
        m = (y0 + y1) / 2
        halves = [[[(x0, y0), (x1, y0), (x1, m), (x0, m)]], [[(x0, m), (x1, m), (x1, y1), (x0, y1)]]]
    parts = [clip(rings, h, "intersection") for h in halves]
    if any(sum(map(len, p)) >= sum(map(len, rings)) for p in parts) and x1 - x0 < 1e-6:
        return [rings]
    return [s for p in parts for s in split(p, most)]


def clip_line(line: list, rings: list) -> list[list[tuple[float, float]]]:
    """The parts of a line inside a polygon."""
    es, out = [(a, b) for ring in rings for a, b in zip(ring, [*ring[1:], *ring[:1]])], []
    for (ax, ay), (bx, by) in pairwise(line):
        cut = {0.0, 1.0}
        for (cx, cy), (dx, dy) in es:
            d = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if d:
                t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / d, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / d
                if 0 <= t <= 1 and 0 <= u <= 1:
                    cut.add(t)
        for t, u in pairwise(sorted(cut)):
            mx, my = ax + (bx - ax) * (t + u) / 2, ay + (by - ay) * (t + u) / 2
            if sum(e[1] <= my < e[3] and mx < _x(e, my) for e in _edges(rings, 0)) % 2:
                p, q = (ax + (bx - ax) * t, ay + (by - ay) * t), (ax + (bx - ax) * u, ay + (by - ay) * u)
                if out and out[-1][-1] == p:
                    out[-1].append(q)
                else:
                    out.append([p, q])
    return out


def explode_multi(rings: list) -> list[list]:
    """Single polygons: each outer ring (counterclockwise) with the holes whose first vertex lies in it and in no smaller one."""
    area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, [*r[1:], *r[:1]])) / 2
    outer = sorted((r for r in rings if area(r) > 0), key=area)
    out = [[r] for r in outer]
    for h in (r for r in rings if area(r) <= 0):
        x, y = h[0]
        home = next((k for k, o in enumerate(outer) if sum(e[1] <= y < e[3] and x < _x(e, y) for e in _edges([o], 0)) % 2), None)
        if home is not None:
            out[home].append(h)
    return out


def _plain(rings):
    return [[(p["x"], p["y"]) for p in r] for r in rings] if rings is not None else []


def _structs(rings):
    return [[{"x": x, "y": y} for x, y in r] for r in rings]


def clip_udf(op: str):
    """Column function (a, b) of two array<ring> to the rings of a op b."""

    @F.pandas_udf(RINGS)
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_structs(clip(_plain(x), _plain(y), op)) for x, y in zip(a, b)])

    return f


def clip_area_udf(op: str):
    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([trapezoid_area(trapezoids(_plain(x), _plain(y), op)) for x, y in zip(a, b)], dtype="float64")

    return f


def holders(points: DataFrame, shapes: DataFrame, ring: str = "ring") -> DataFrame:
    """points (x, y and more columns) with the other columns of every shape that holds them (rings.contains_point).

    A ring is cut in bands (rings.bands), so that a point meets one band of a ring, and nearly all bands have two edges: whether the point lies between them is arithmetic on columns, which Spark compiles. Bands of more edges count them. Bands are dealt to
    buckets a few times smaller than they are, of which they take up to 81; points meet those of their bucket."""
    from isobar.functions import rings

    keep = [c for c in shapes.columns if c != ring]
    b = shapes.select(*keep, F.explode(rings.bands(F.col(ring))).alias("b")).filter(F.size("b.e") > 1)
    slack = lambda v: 1e-9 * (F.abs(v) + 1)
    xs = F.flatten(F.transform("b.e", lambda e: F.array(e.a.x, e.b.x)))
    b = b.withColumn("_x", F.struct(F.array_min(xs).alias("a"), F.array_max(xs).alias("b")))
    box = F.struct((F.col("_x.a") - slack(F.col("_x.a"))).alias("x0"), F.col("b.lo").alias("y0"), (F.col("_x.b") + slack(F.col("_x.b"))).alias("x1"), F.col("b.hi").alias("y1"))
    b = b.withColumn("_box", box).drop("_x")
    line = lambda k: [v.alias(f"_{n}{k}") for n, v in (("x", F.col("b.e")[k].a.x), ("y", F.col("b.e")[k].a.y), ("u", F.col("b.e")[k].b.x - F.col("b.e")[k].a.x), ("v", F.col("b.e")[k].b.y - F.col("b.e")[k].a.y))]
    two = quadtree.box_buckets(b.filter(F.size("b.e") == 2).select(*keep, "_box", F.col("b.lo").alias("_lo"), F.col("b.hi").alias("_hi"), *line(0), *line(1)), "_box", 3).drop("_box")
    left_of = lambda k: F.col("x") < F.col(f"_u{k}") * (F.col("y") - F.col(f"_y{k}")) / F.col(f"_v{k}") + F.col(f"_x{k}")
    held = (F.col("y") >= F.col("_lo")) & (F.col("y") < F.col("_hi")) & (left_of(0) != left_of(1))
    columns = [*points.columns, *keep]
    out = quadtree.point_buckets(points, two).join(two, ["level", "bx", "by"]).filter(held).select(*columns)
    more = b.filter(F.size("b.e") > 2)
    if more.isEmpty():
        return out
    more = quadtree.box_buckets(more.select(*keep, "_box", F.col("b.lo").alias("_lo"), F.col("b.hi").alias("_hi"), F.col("b.e").alias("_e")), "_box", 3).drop("_box")
    left = F.size(F.filter("_e", lambda e: F.col("x") < (e.b.x - e.a.x) * (F.col("y") - e.a.y) / (e.b.y - e.a.y) + e.a.x))
    rest = quadtree.point_buckets(points, more).join(more, ["level", "bx", "by"]).filter((F.col("y") >= F.col("_lo")) & (F.col("y") < F.col("_hi"))).filter(left % 2 == 1)
    return out.unionByName(rest.select(*columns))


PAIRS = 1 << 14


def crossings(shapes: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """one and other: keys of any two shapes whose edges meet, the lesser first, once each.

    Shapes come together by bucket (quadtree.self_meetings) with their vertices once, not once for each pair; pairs are made in arrays there, a bounded number at a time, and only their keys come back."""
    from isobar.functions import rings

    s = shapes.select(F.col(key).alias("k"), F.col(ring).alias("r")).withColumn("e", rings.envelope(F.col("r")))
    out = s.select(F.col("k").alias("one"), F.col("k").alias("other")).schema
    return quadtree.self_meetings(s, "e").groupBy("level", "bx", "by").applyInArrow(_crossings, out)


def _crossings(group: pa.Table) -> pa.Table:
    g = group.combine_chunks()
    column = lambda c: g.column(c).combine_chunks()
    keys, own, ring = column("k"), g.column("own").to_numpy(zero_copy_only=False), column("r")
    box = np.stack([column("e").field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")])
    side, bx, by = 2.0 ** -g.column("level")[0].as_py(), g.column("bx")[0].as_py(), g.column("by")[0].as_py()
    p, count = _flat(ring)
    e = np.concatenate([p, p[_after(np.repeat(np.arange(len(count)), count))]], axis=1)
    first, rank = np.cumsum(count) - count, pc.rank(keys, tiebreaker="dense").to_numpy()
    at, found = np.flatnonzero(own), []
    step = max(1, (16 * PAIRS) // max(1, len(at)))
    for start in range(0, len(rank), step):
        a = np.arange(start, min(start + step, len(rank)))
        x, y = np.maximum.outer(box[0, a], box[0, at]), np.maximum.outer(box[1, a], box[1, at])
        meet = (x <= np.minimum.outer(box[2, a], box[2, at])) & (y <= np.minimum.outer(box[3, a], box[3, at]))
        i, j = np.nonzero(meet)
        here = (np.floor(x[i, j] / side) == bx) & (np.floor(y[i, j] / side) == by)
        i, j = a[i[here]], at[j[here]]
        once = (~own[i] | (rank[i] < rank[j])) & (rank[i] != rank[j])
        i, j = i[once], j[once]
        for n in range(0, len(i), PAIRS):
            u, v = i[n : n + PAIRS], j[n : n + PAIRS]
            hit = _rings_meet(e, first, count, u, v)
            found.append(np.stack([u[hit], v[hit]]))
    i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    lesser = rank[i] < rank[j]
    return pa.table([keys.take(pa.array(np.where(lesser, i, j))), keys.take(pa.array(np.where(lesser, j, i)))], names=["one", "other"])


def _rings_meet(e: np.ndarray, first: np.ndarray, count: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether any edges (ax, ay, bx, by) of rings u and v meet, pair by pair, as rings.segments_meet; a pair that meets is not looked at again."""
    hit, left = np.zeros(len(u), dtype=bool), np.arange(len(u))
    lo, hi = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    for m in range(int(count[u].max(initial=0))):
        left = left[~hit[left] & (m < count[u[left]])]
        s = first[u[left]] + m
        for n in range(int(count[v[left]].max(initial=0))):
            t = first[v[left]] + np.minimum(n, count[v[left]] - 1)
            near = np.flatnonzero((n < count[v[left]]) & (lo[s, 0] <= hi[t, 0]) & (lo[t, 0] <= hi[s, 0]) & (lo[s, 1] <= hi[t, 1]) & (lo[t, 1] <= hi[s, 1]))
            if len(near):
                hit[left[near]] |= _segments_meet(e[s[near]], e[t[near]])
    return hit


def _segments_meet(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    a, b, c, d = f[:, :2].T, f[:, 2:].T, g[:, :2].T, g[:, 2:].T
    turn = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    on = lambda p, q, r: (r >= np.minimum(p, q)).all(axis=0) & (r <= np.maximum(p, q)).all(axis=0)
    t1, t2, t3, t4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    return (t1 * t2 < 0) & (t3 * t4 < 0) | (t1 == 0) & on(a, b, c) | (t2 == 0) & on(a, b, d) | (t3 == 0) & on(c, d, a) | (t4 == 0) & on(c, d, b)


def convex_areas(one: pa.ListArray, other: pa.ListArray) -> np.ndarray:
    """Areas of the common parts of convex rings, pair by pair: each ring is cut along the other's edges, one after the other, all pairs at once; vertices lie in one array, those of a ring after each other.

    Places are taken from the other ring's first vertex, so that areas far from the origin keep their digits. 0 where a ring is null or empty."""
    n, (p, count), (e, sides) = len(one), _flat(one), _flat(other)
    first, some = np.cumsum(sides) - sides, (count > 0) & (sides > 0)
    origin = np.zeros((n, 2))
    origin[some] = e[first[some]]
    row = np.repeat(np.arange(n), count)
    p, row = (p - origin[row])[some[row]], row[some[row]]
    e = e - np.repeat(origin, sides, axis=0)
    turn = np.sign(_areas(e, np.repeat(np.arange(n), sides), n))
    for k in range(int(sides.max(initial=0))):
        has = k < sides[row]
        a = e[np.where(has, first[row] + k, 0)]
        b = e[np.where(has, first[row] + (k + 1) % np.maximum(sides[row], 1), 0)]
        d = b - a
        side = np.where(has, turn[row] * (d[:, 0] * (p[:, 1] - a[:, 1]) - d[:, 1] * (p[:, 0] - a[:, 0])), 1.0)
        after = _after(row)
        q = np.where(has, turn[row] * (d[:, 0] * (p[after, 1] - a[:, 1]) - d[:, 1] * (p[after, 0] - a[:, 0])), 1.0)
        own, meet = side >= 0, ((side > 0) & (q < 0)) | ((side < 0) & (q > 0))
        at = np.cumsum(own.astype(np.int64) + meet) - meet - own
        out, to = np.empty((int(own.sum() + meet.sum()), 2)), np.empty(int(own.sum() + meet.sum()), dtype=np.int64)
        out[at[own]], to[at[own]] = p[own], row[own]
        t = (side[meet] / (side[meet] - q[meet]))[:, None]
        place = at[meet] + own[meet]
        out[place], to[place] = p[meet] + t * (p[after[meet]] - p[meet]), row[meet]
        p, row = out, to
    return np.abs(_areas(p, row, n))


def _flat(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of all rings (n x 2), and how many each has; none of a null one."""
    v = rings.flatten()
    count = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.stack([v.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1).astype(float).reshape(-1, 2), count


def _after(row: np.ndarray) -> np.ndarray:
    """Where the next vertex of the same ring lies, which is the first one after the last."""
    n = len(row)
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if n else np.empty(0, dtype=np.int64)
    after = np.arange(1, n + 1)
    after[np.r_[start[1:], n][: len(start)] - 1] = start
    return after


def _areas(p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Signed areas of n rings."""
    q = p[_after(row)]
    return np.bincount(row, weights=p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1], minlength=n) / 2


def strips_udf(op: str):
    """As clip_udf, to triangle strips of four vertices."""

    @F.pandas_udf(RINGS)
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_structs([[(l0, y0), (r0, y0), (l1, y1), (r1, y1)] for y0, y1, l0, l1, r0, r1 in trapezoids(_plain(x), _plain(y), op)]) for x, y in zip(a, b)])

    return f


def fold(df: DataFrame, keys: list[str], geometry: str, op: str, parts: int = 64) -> DataFrame:
    """keys with the rings of all geometries of a group together, by union, intersection or xor: first in parts of a group, then the parts, so no task gets a whole hot group. Null geometries don't count."""
    if op == "difference":
        raise ValueError("a difference depends on the order")

    def one(group: pa.Table) -> pa.Table:
        total: list | None = None
        for x in group.column(geometry).to_pylist():
            if x is not None:
                total = _plain(x) if total is None else clip(total, _plain(x), op)
        cols = [group.column(k).slice(0, 1) for k in group.column_names if k != geometry]
        return pa.table([*cols, pa.array([_structs(total) if total is not None else None], _ARROW_RINGS)], names=[*(k for k in group.column_names if k != geometry), geometry])

    d = df.select(*keys, F.pmod(F.xxhash64(F.to_json(geometry)), F.lit(parts)).alias("_part"), geometry)
    some = d.groupBy(*keys, "_part").applyInArrow(one, d.schema).drop("_part")
    return some.groupBy(*keys).applyInArrow(one, some.schema)


def simplify_udf(tolerance: float):
    @F.pandas_udf(RING)
    def f(a: pd.Series) -> pd.Series:
        return pd.Series([_structs([simplify([(p["x"], p["y"]) for p in r], tolerance)])[0] if r is not None else None for r in a])

    return f


def raster_udf(width: int, height: int):
    @F.pandas_udf("array<struct<i: bigint, j: bigint>>")
    def f(a: pd.Series) -> pd.Series:
        return pd.Series([[{"i": i, "j": j} for i, j in rasterise(_plain(x), width, height)] for x in a])

    return f


def split_udf(most: int):
    @F.pandas_udf(f"array<{RINGS}>")
    def f(a: pd.Series) -> pd.Series:
        return pd.Series([[_structs(p) for p in split(_plain(x), most)] for x in a])

    return f


def within(a: Column, b: Column) -> Column:
    """Ring a lies in ring b: every vertex does, and no edges cross."""
    from isobar.functions import rings

    return rings.contains_ring(b, a) & ~rings.crosses(a, b)
