"""Rings as arrays of struct<x, y>, not repeating their first vertex: measures and predicates by higher-order functions, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.cast("double").alias("x"), F.lit(y).cast("double").alias("y") if not isinstance(y, Column) else y.cast("double").alias("y"))


def rectangle(x0, y0, x1, y1) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it: functions of arrays share nothing."""
    return F.transform(F.array(value), f)[0]


def edges(ring: Column) -> Column:
    """array<struct<a, b>> of consecutive vertices, closed."""
    return bound(ring, lambda r: F.transform(r, lambda p, i: F.struct(p.alias("a"), F.element_at(r, (i + 1) % F.size(r) + 1).alias("b"))))


def _total(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, e: s + f(e))


def signed_area(ring: Column) -> Column:
    return _total(edges(ring), lambda e: e.a.x * e.b.y - e.b.x * e.a.y) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def polygon_area(rings: Column) -> Column:
    """Of array<struct<hole, pts>>: outer rings less holes."""
    return F.aggregate(rings, F.lit(0.0), lambda s, r: s + F.when(r.hole, -area(r.pts)).otherwise(area(r.pts)))


def vertex_count(rings: Column) -> Column:
    return F.aggregate(rings, F.lit(0), lambda s, r: s + F.size(r.pts))


def outer_count(rings: Column) -> Column:
    return F.size(F.filter(rings, lambda r: ~r.hole))


def length(ring: Column, closed: bool = True) -> Column:
    e = edges(ring)
    e = e if closed else F.slice(e, 1, F.greatest(F.size(e) - 1, F.lit(0)))
    return _total(e, lambda s: F.hypot(s.b.x - s.a.x, s.b.y - s.a.y))


def envelope(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def clip_convex(ring: Column, by: Column) -> Column:
    """The part of a convex ring within another one, of either turn: cut along the other's edges, one after the other; empty if nothing is left."""

    def cut(left: Column, e: Column, turn: Column) -> Column:
        side = lambda p: turn * ((e.b.x - e.a.x) * (p.y - e.a.y) - (e.b.y - e.a.y) * (p.x - e.a.x))

        def step(s: Column) -> Column:
            def parts(v: Column) -> Column:
                p, q = v.p, v.q
                t = p / (p - q)
                meet = F.array(point(s.a.x + t * (s.b.x - s.a.x), s.a.y + t * (s.b.y - s.a.y)))
                own = F.when(p >= 0, F.array(point(s.a.x, s.a.y))).otherwise(F.array().cast("array<struct<x: double, y: double>>"))
                return F.when(((p > 0) & (q < 0)) | ((p < 0) & (q > 0)), F.concat(own, meet)).otherwise(own)

            return bound(F.struct(side(s.a).alias("p"), side(s.b).alias("q")), parts)

        return F.flatten(F.transform(edges(left), step))

    whole = F.transform(ring, lambda p: point(p.x, p.y))
    return bound(F.signum(signed_area(by)), lambda turn: F.aggregate(edges(by), whole, lambda left, e: cut(left, e, turn)))


def projected(ring: str, to, tolerance: float | None = None, period: float | None = None, most: int = 1024) -> Column:
    """The ring of that name in another reference. ``to`` takes the SQL texts of x and y and gives those of the new ones (expr.rotate, radar_unproject and others do). With a tolerance, an edge that bends gets as many more vertices as keep it, by what its quarter points lie off,
    within tolerance of the straight line: the bend falls with the square of the number of parts, of which an edge has ``most`` at most. With a period, x goes round, and a step across its ends is the short way."""
    at = lambda e, t: "named_struct('x', {}, 'y', {})".format(*(f"CAST({v} AS DOUBLE)" for v in to(f"({e}.a.x + {t} * ({e}.b.x - {e}.a.x))", f"({e}.a.y + {t} * ({e}.b.y - {e}.a.y))")))
    if tolerance is None:
        return F.expr(f"transform({ring}, p -> named_struct('x', CAST({to('p.x', 'p.y')[0]} AS DOUBLE), 'y', CAST({to('p.x', 'p.y')[1]} AS DOUBLE)))")
    own = f"transform({ring}, (p, i) -> named_struct('a', p, 'b', element_at({ring}, (i + 1) % size({ring}) + 1)))"
    probes = f"transform({own}, e -> named_struct('a', e.a, 'b', e.b, 'p', array({', '.join(at('e', t) for t in ('0E0', '0.25E0', '0.5E0', '0.75E0', '1E0'))})))"
    short = lambda d: f"({d})" if period is None else f"(pmod({d} + {period / 2}D, {period}D) - {period / 2}D)"
    off = lambda k: f"hypot({short(f's.p[{k}].x - s.p[0].x')} - {k / 4}D * {short('s.p[4].x - s.p[0].x')}, s.p[{k}].y - s.p[0].y - {k / 4}D * (s.p[4].y - s.p[0].y))"
    parts = f"CAST(least({most}, greatest(1, ceil(sqrt(greatest({off(1)}, {off(2)}, {off(3)}) / {tolerance}D)))) AS INT)"
    counted = f"transform({probes}, s -> named_struct('a', s.a, 'b', s.b, 'n', {parts}))"
    return F.expr(f"flatten(transform({counted}, e -> transform(sequence(0, e.n - 1), k -> {at('e', '(k / e.n)')})))")


def centroid(ring: Column) -> Column:
    w = lambda e: e.a.x * e.b.y - e.b.x * e.a.y
    six = F.nullif(6 * signed_area(ring), F.lit(0.0))
    return point(_total(edges(ring), lambda e: (e.a.x + e.b.x) * w(e)) / six, _total(edges(ring), lambda e: (e.a.y + e.b.y) * w(e)) / six)


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd: an edge counts if the point's height is at or above its lower end and below its upper end, and it lies to the right."""
    hit = lambda e: ((e.a.y <= y) & (y < e.b.y) | (e.b.y <= y) & (y < e.a.y)) & (x < (e.b.x - e.a.x) * (y - e.a.y) / F.nullif(e.b.y - e.a.y, F.lit(0.0)) + e.a.x)
    return F.size(F.filter(edges(ring), hit)) % 2 == 1


def bands(ring: Column) -> Column:
    """array<struct<lo, hi, e>> of the bands between neighbouring heights of vertices, and the edges across each: a point at lo or above, but below hi, meets just these by the rule of contains_point."""
    heights = F.array_sort(F.array_distinct(F.transform(ring, lambda p: p.y)))
    across = lambda s, lo, hi: F.filter(s, lambda e: (e.a.y <= lo) & (e.b.y >= hi) | (e.b.y <= lo) & (e.a.y >= hi))

    def cut(v: Column) -> Column:
        pairs = F.transform(v.h, lambda lo, i: F.struct(lo.alias("lo"), F.try_element_at(v.h, i + 2).alias("hi")))
        return F.transform(F.filter(pairs, lambda b: b.hi.isNotNull()), lambda b: F.struct(b.lo.alias("lo"), b.hi.alias("hi"), across(v.e, b.lo, b.hi).alias("e")))

    return bound(F.struct(heights.alias("h"), edges(ring).alias("e")), cut)


def polygon_contains_point(rings: Column, x: Column, y: Column) -> Column:
    """In an outer ring and in no hole."""
    return F.exists(rings, lambda r: ~r.hole & contains_point(r.pts, x, y)) & ~F.exists(rings, lambda r: r.hole & contains_point(r.pts, x, y))


def contains_ring(outer: Column, inner: Column) -> Column:
    """Every vertex of inner lies in outer."""
    return F.forall(inner, lambda p: contains_point(outer, p.x, p.y))


def segments_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Proper or touching intersection of segments ab and cd, by the signs of four turns."""
    turn = lambda p, q, r: F.signum((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x))
    on = lambda p, q, r: (r.x >= F.least(p.x, q.x)) & (r.x <= F.greatest(p.x, q.x)) & (r.y >= F.least(p.y, q.y)) & (r.y <= F.greatest(p.y, q.y))
    t1, t2, t3, t4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    return (t1 * t2 < 0) & (t3 * t4 < 0) | (t1 == 0) & on(a, b, c) | (t2 == 0) & on(a, b, d) | (t3 == 0) & on(c, d, a) | (t4 == 0) & on(c, d, b)


def crosses(one: Column, other: Column) -> Column:
    """Any pair of edges meets."""
    return F.exists(edges(one), lambda e: F.exists(edges(other), lambda f: segments_meet(e.a, e.b, f.a, f.b)))


def intersects(one: Column, other: Column) -> Column:
    """Edges meet, or one holds the other's first vertex."""
    p, q = one[0], other[0]
    return crosses(one, other) | contains_point(one, q.x, q.y) | contains_point(other, p.x, p.y)


def boxes_meet(e: Column, f: Column) -> Column:
    """The prefilter of joins."""
    return (e.x0 <= f.x1) & (f.x0 <= e.x1) & (e.y0 <= f.y1) & (f.y0 <= e.y1)


def segment_distance(a: Column, b: Column, p: Column) -> Column:
    """From p to the segment ab."""
    dx, dy = b.x - a.x, b.y - a.y
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((p.x - a.x) * dx + (p.y - a.y) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    return F.hypot(p.x - a.x - t * dx, p.y - a.y - t * dy)


def distance_to(ring: Column, p: Column) -> Column:
    return F.array_min(F.transform(edges(ring), lambda e: segment_distance(e.a, e.b, p)))


def closest_vertex(ring: Column, p: Column) -> Column:
    """struct<d, x, y> of the nearest vertex."""
    return F.array_min(F.transform(ring, lambda q: F.struct(F.hypot(q.x - p.x, q.y - p.y).alias("d"), q.x.alias("x"), q.y.alias("y"))))


def clean(ring: Column) -> Column:
    """Without vertices equal to the one before."""
    return F.filter(ring, lambda p, i: (i == 0) | ~(p == F.element_at(ring, F.greatest(i, F.lit(1)))))


def smallest_angle(ring: Column) -> Column:
    """Smallest angle between neighbouring edges, in degrees."""
    n = F.size(ring)

    def at(p, i):
        a, b = F.element_at(ring, (i + n - 1) % n + 1), F.element_at(ring, (i + 1) % n + 1)
        ux, uy, vx, vy = a.x - p.x, a.y - p.y, b.x - p.x, b.y - p.y
        c = (ux * vx + uy * vy) / F.nullif(F.hypot(ux, uy) * F.hypot(vx, vy), F.lit(0.0))
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))

    return F.array_min(F.transform(ring, at))


def wrap(ring: Column, low: float, high: float) -> Column:
    """Every x brought into [low, high)."""
    return F.transform(ring, lambda p: point(F.pmod(p.x - low, F.lit(high - low)) + low, p.y))


def on_side(p: Column, lon: Column) -> Column:
    """A place in degrees by that one of its names that lies less than a quarter turn from a meridian: x off by whole turns, or beyond the pole, where y is over 90."""
    near = lambda x: x + 360 * F.rint((lon - x) / 360)
    across = F.abs(near(p.x) - lon) > 90
    return point(near(F.when(across, p.x + 180).otherwise(p.x)), F.when(across, F.when(p.y < 0, -180.0).otherwise(180.0) - p.y).otherwise(p.y))


def coordinate_limit(ring: Column, axis: str, how: str) -> Column:
    v = F.transform(ring, lambda p: p[axis])
    return {"min": F.array_min(v), "max": F.array_max(v), "avg": F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)}[how]


def area_in_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of the part of a ring inside a box: each edge counts the area between it and the first vertex's height in the box, over the box's width, with the sign of its run."""
    base = F.greatest(y0, F.least(y1, ring[0].y))

    def under(t: Column) -> Column:  # integral of the height in the box up to t
        h = F.greatest(F.lit(0.0), F.least(t, y1) - y0)
        return h * h / 2 + (y1 - y0) * F.greatest(F.lit(0.0), t - y1)

    def below(e: Column) -> Column:
        xs, xe = F.greatest(x0, F.least(x1, e.a.x)), F.greatest(x0, F.least(x1, e.b.x))
        slope = (e.b.y - e.a.y) / F.nullif(e.b.x - e.a.x, F.lit(0.0))
        ys, ye = e.a.y + slope * (xs - e.a.x), e.a.y + slope * (xe - e.a.x)
        level = F.greatest(y0, F.least(y1, (ys + ye) / 2)) - base
        mean = F.when(F.abs(ye - ys) < 1e-12 * (F.abs(ys) + F.abs(ye) + 1), level).otherwise((under(ye) - under(ys)) / (ye - ys) - (base - y0))
        return F.coalesce((xe - xs) * mean, F.lit(0.0))

    return F.abs(_total(edges(ring), below))


def _cut(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """Where along a segment (from 0 to 1) a box begins and ends to hold it."""
    low, high = F.lit(0.0), F.lit(1.0)
    for a, d, lo, hi in ((e.a.x, e.b.x - e.a.x, x0, x1), (e.a.y, e.b.y - e.a.y, y0, y1)):
        n = F.nullif(d, F.lit(0.0))
        s, t = (lo - a) / n, (hi - a) / n
        none = (d == 0) & ((a < lo) | (a > hi))
        low = F.when(none, 2.0).otherwise(F.greatest(low, F.coalesce(F.least(s, t), F.lit(0.0))))
        high = F.least(high, F.coalesce(F.greatest(s, t), F.lit(1.0)))
    return low, high


def length_in_box(line: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Length of the part of an open line inside a box."""
    segments = F.slice(edges(line), 1, F.greatest(F.size(line) - 1, F.lit(0)))

    def held(e: Column) -> Column:
        low, high = _cut(e, x0, y0, x1, y1)
        return F.greatest(F.lit(0.0), high - low) * F.hypot(e.b.x - e.a.x, e.b.y - e.a.y)

    return _total(segments, held)


def meeting_points(ring: Column, a: Column, b: Column) -> Column:
    """array<struct<t, x, y>> of the points where the segment ab meets the ring's edges, in order along it; edges that run alongside give none."""

    def at(e: Column) -> Column:
        ux, uy, vx, vy = b.x - a.x, b.y - a.y, e.b.x - e.a.x, e.b.y - e.a.y
        d = F.nullif(ux * vy - uy * vx, F.lit(0.0))
        t, s = ((e.a.x - a.x) * vy - (e.a.y - a.y) * vx) / d, ((e.a.x - a.x) * uy - (e.a.y - a.y) * ux) / d
        return F.when((t >= 0) & (t <= 1) & (s >= 0) & (s <= 1), F.struct(t.alias("t"), (a.x + t * ux).alias("x"), (a.y + t * uy).alias("y")))

    return F.array_distinct(F.array_sort(F.filter(F.transform(edges(ring), at), lambda p: p.isNotNull())))


def box_meets_line(e: Column, a: Column, b: Column, directed: bool = False) -> Column:
    """An infinite line through a and b, or one that begins at a, touches the sides of an envelope."""
    ring = F.array(point(e.x0, e.y0), point(e.x1, e.y0), point(e.x1, e.y1), point(e.x0, e.y1))

    def hit(s: Column) -> Column:
        ux, uy, vx, vy = b.x - a.x, b.y - a.y, s.b.x - s.a.x, s.b.y - s.a.y
        d = F.nullif(ux * vy - uy * vx, F.lit(0.0))
        f, t = ((s.a.x - a.x) * vy - (s.a.y - a.y) * vx) / d, ((s.a.x - a.x) * uy - (s.a.y - a.y) * ux) / d
        return F.coalesce((t >= 0) & (t <= 1) & ((f >= 0) if directed else F.lit(True)), F.lit(False))

    return F.exists(edges(ring), hit)


def unwrapped(ring: Column, span: float) -> Column:
    """The ring with every vertex within half a span of the one before, so that it doesn't jump."""
    start = F.struct(F.array().cast("array<struct<x: double, y: double>>").alias("out"), F.lit(0.0).alias("off"), ring[0].x.alias("last"))

    def step(s: Column, p: Column) -> Column:
        d = p.x + s.off - s.last
        off = s.off + F.when(d >= span / 2, -span).when(d <= -span / 2, span).otherwise(0.0)
        return F.struct(F.concat(s.out, F.array(point(p.x + off, p.y))).alias("out"), off.alias("off"), (p.x + off).alias("last"))

    return F.aggregate(ring, start, step, lambda s: s.out)


def clipped_x(ring: Column, x: Column | float, above: bool) -> Column:
    """The part of a ring on one side of a line of constant x."""
    x = x if isinstance(x, Column) else F.lit(float(x))

    def part(e: Column) -> Column:
        a, b = (e.a.x >= x, e.b.x >= x) if above else (e.a.x <= x, e.b.x <= x)
        cut = F.array(point(x, e.a.y + (x - e.a.x) * (e.b.y - e.a.y) / F.nullif(e.b.x - e.a.x, F.lit(0.0))))
        own = F.array(point(e.a.x, e.a.y))
        return F.when(a & b, own).when(a, F.concat(own, cut)).when(b, cut).otherwise(F.array().cast("array<struct<x: double, y: double>>"))

    return F.flatten(F.transform(edges(ring), part))


def wrap_split(ring: Column, low: float, high: float) -> Column:
    """array of rings: a ring that crosses the wrap line, cut there, each part in [low, high]."""
    span = high - low
    back = lambda r, k: F.transform(r, lambda p: point(p.x - k * span, p.y))
    parts = lambda u: F.array(*[back(clipped_x(clipped_x(u, low + k * span, True), high + k * span, False), k) for k in (-1, 0, 1)])
    return F.filter(bound(unwrapped(ring, span), parts), lambda r: (F.size(r) > 2) & (area(r) > 0))
