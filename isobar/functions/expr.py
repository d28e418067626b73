"""Scalar functions as SQL expressions, for Spark's dialect or, for checks, another engine's.

Every function takes SQL texts of its arguments and gives the SQL text of the result, so it runs inside Spark's generated code;
``column`` makes a Column of it. Angles of ``lat``/``lon`` arguments are in degrees unless said otherwise.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6371000.0
TWO_PI = 2 * math.pi


def num(x: float) -> str:
    """A DOUBLE literal in any dialect."""
    x = float(x)
    t = repr(x)
    return t if "e" in t else f"{t}E0"


class Spark:
    """Names that differ by dialect."""

    def rint(self, x: str) -> str:
        return f"rint({x})"

    def trunc(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def floor(self, x: str) -> str:
        return f"CAST(floor({x}) AS DOUBLE)"

    def ceil(self, x: str) -> str:
        return f"CAST(ceil({x}) AS DOUBLE)"

    def array(self, *x: str) -> str:
        return f"array({', '.join(x)})"

    def at(self, a: str, i: str) -> str:
        return f"element_at({a}, CAST({i} AS INT))"

    def lambda1(self, v: str, body: str) -> str:
        return f"{v} -> {body}"

    def transform(self, a: str, v: str, body: str) -> str:
        return f"transform({a}, {v} -> {body})"

    def filter(self, a: str, v: str, body: str) -> str:
        return f"filter({a}, {v} -> {body})"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def seq(self, a: str, b: str) -> str:
        return f"sequence(CAST({a} AS BIGINT), CAST({b} AS BIGINT))"

    def total(self, a: str) -> str:
        return f"aggregate({a}, CAST(0 AS DOUBLE), (s, x) -> s + x)"

    def explode(self, a: str) -> str:
        return f"explode({a})"

    def seconds(self, ts: str) -> str:
        return f"unix_seconds(CAST({ts} AS TIMESTAMP))"

    def timestamp(self, seconds: str) -> str:
        return f"timestamp_seconds({seconds})"

    def date_text(self, ts: str, spark_format: str, other: str) -> str:
        return f"date_format({ts}, '{spark_format}')"

    def day_number(self, y: str, m: str, d: str) -> str:
        return f"CAST(datediff(make_date(CAST({y} AS INT), CAST({m} AS INT), CAST({d} AS INT)), DATE'1970-01-01') AS BIGINT)"

    def matches(self, s: str, pattern: str) -> str:
        return f"rlike({s}, concat('(?i)', {pattern}))"

    def extract(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({s}, '{pattern}', {group})"

    def replace_all(self, s: str, pattern: str, by: str) -> str:
        return f"regexp_replace({s}, '{pattern}', '{by}')"

    def ascii(self, s: str) -> str:
        return f"ascii({s})"

    def bits(self, x: str) -> str:
        return f"CAST(bit_count(CAST({x} AS BIGINT)) AS BIGINT)"

    def binary_length(self, x: str) -> str:
        """Length of a non-negative long in base 2, without leading zeros."""
        return f"CAST(length(bin(CAST({x} AS BIGINT))) AS BIGINT)"

    def shl(self, x: str, n: str) -> str:
        return f"shiftleft(CAST({x} AS BIGINT), CAST({n} AS INT))"

    def shr(self, x: str, n: str) -> str:
        return f"shiftright(CAST({x} AS BIGINT), CAST({n} AS INT))"

    def format_number(self, x: str, width: int, digits: int) -> str:
        return f"format_string('%{width}.{digits}f', {x})"


class Duck(Spark):
    """The dialect of the engine that results are checked with."""

    def rint(self, x):
        return f"round_even({x}, 0)"

    def trunc(self, x):
        return f"CAST(trunc({x}) AS BIGINT)"

    def array(self, *x):
        return f"[{', '.join(x)}]"

    def at(self, a, i):
        return f"({a})[CAST({i} AS BIGINT)]"

    def transform(self, a, v, body):
        return f"list_transform({a}, lambda {v}: {body})"

    def filter(self, a, v, body):
        return f"list_filter({a}, lambda {v}: {body})"

    def size(self, a):
        return f"CAST(len({a}) AS BIGINT)"

    def seq(self, a, b):
        return f"generate_series(CAST({a} AS BIGINT), CAST({b} AS BIGINT))"

    def total(self, a):
        return f"coalesce(list_sum({a}), 0)"

    def explode(self, a):
        return f"unnest({a})"

    def seconds(self, ts):
        return f"CAST(floor(epoch({ts})) AS BIGINT)"

    def timestamp(self, seconds):
        return f"make_timestamp(CAST({seconds} AS BIGINT) * 1000000)"

    def date_text(self, ts, spark_format, other):
        return f"strftime({ts}, '{other}')"

    def day_number(self, y, m, d):
        return f"CAST(make_date(CAST({y} AS BIGINT), CAST({m} AS BIGINT), CAST({d} AS BIGINT)) - DATE'1970-01-01' AS BIGINT)"

    def matches(self, s, pattern):
        return f"regexp_matches({s}, {pattern}, 'i')"

    def replace_all(self, s, pattern, by):
        return f"regexp_replace({s}, '{pattern}', '{by}', 'g')"

    def binary_length(self, x):
        return f"CAST(length(format('{{:b}}', CAST({x} AS BIGINT))) AS BIGINT)"

    def shl(self, x, n):
        return f"(CAST({x} AS BIGINT) << CAST({n} AS INT))"

    def shr(self, x, n):
        return f"(CAST({x} AS BIGINT) >> CAST({n} AS INT))"

    def format_number(self, x, width, digits):
        return f"printf('%{width}.{digits}f', {x})"


SPARK, DUCK = Spark(), Duck()


def column(sql: str) -> Column:
    return F.expr(sql)


# --- numbers ---------------------------------------------------------------------------------------------------------


def clamp(x, lo, hi):
    return f"least({hi}, greatest({lo}, {x}))"


def outcode(x, y, x0, y0, x1, y1):
    """Sides of a box that a point is beyond: 1 left, 2 right, 4 below, 8 above."""
    return f"(CASE WHEN {x} < {x0} THEN 1 WHEN {x} > {x1} THEN 2 ELSE 0 END + CASE WHEN {y} < {y0} THEN 4 WHEN {y} > {y1} THEN 8 ELSE 0 END)"


def lerp(a, b, f):
    return f"({a} + ({b} - {a}) * ({f}))"


def fraction(x, a, b):
    """Place of x between a and b; one half if they are equal."""
    return f"(CASE WHEN {a} = {b} THEN 0.5E0 ELSE ({x} - {a}) / nullif({b} - {a}, 0) END)"


def between_any(x, a, b):
    """x lies between two different values, in either order."""
    return f"({a} <> {b} AND (({x} >= {a} AND {x} <= {b}) OR ({x} <= {a} AND {x} >= {b})))"


def round_half_up(e: Spark, x):
    """Towards zero after adding one half."""
    return e.trunc(f"({x} + 0.5E0)")


def order(e: Spark, x):
    return f"(CASE WHEN {x} = 0 THEN 1E0 ELSE {e.floor(f'log10(abs({x}))')} END)"


def range_order(e: Spark, x):
    return f"(CASE WHEN {x} = 0 THEN 1E0 ELSE {e.ceil(f'log10(abs({x})) - 0.25E0')} END)"


def range_increment(x):
    return f"pow(10E0, {x} - 1)"


def cubic(x0, x1, x2, x3, f):
    """Cubic through four values, at f between the inner two."""
    a0 = f"({x3} - {x2} - {x0} + {x1})"
    return f"({a0} * {f} * {f} * {f} + ({x0} - {x1} - {a0}) * {f} * {f} + ({x2} - {x0}) * {f} + {x1})"


def hermite(x0, x1, x2, x3, f, tension, bias):
    """Hermite spline between x1 and x2 with tension and bias."""
    m0 = f"((({x1} - {x0}) * (1 + {bias}) + ({x2} - {x1}) * (1 - {bias})) * (1 - {tension}) / 2)"
    m1 = f"((({x2} - {x1}) * (1 + {bias}) + ({x3} - {x2}) * (1 - {bias})) * (1 - {tension}) / 2)"
    f2, f3 = f"({f} * {f})", f"({f} * {f} * {f})"
    return f"((2 * {f3} - 3 * {f2} + 1) * {x1} + ({f3} - 2 * {f2} + {f}) * {m0} + ({f3} - {f2}) * {m1} + (3 * {f2} - 2 * {f3}) * {x2})"


def leading_zeros(e: Spark, x, width: int):
    """Of a positive number below 2^63."""
    return f"({width} - {e.binary_length(x)})"


def trailing_zeros(e: Spark, x):
    return e.bits(f"((({x}) & (-({x}))) - 1)")


def highest_bit(e: Spark, x):
    return f"({e.binary_length(x)} - 1)"


# --- vectors and matrices: a vector is a list of three texts ---------------------------------------------------------


def dot(a, b):
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"


def norm(a):
    return f"sqrt({dot(a, a)})"


def cross(a, b):
    return [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]


def unit(a):
    """Null for the zero vector."""
    return [f"({x} / nullif({norm(a)}, 0))" for x in a]


def plane_hit(direction, pixel, height):
    """(whether a ray meets the plane z = height, x, y): the pixel moved back along the direction; 999 where they run alongside."""
    t = f"(({pixel[2]} - {height}) / nullif({direction[2]}, 0))"
    return f"({direction[2]} <> 0)", *(f"(CASE WHEN {direction[2]} <> 0 THEN {pixel[k]} - {direction[k]} * {t} ELSE 999E0 END)" for k in range(2))


def sphere_hit(direction, a, pixel, radius2):
    """(whether a ray meets a sphere of squared radius round the origin, x, y): the pixel moved back to the far meeting point; 999 on a miss. a is twice the squared length of the direction."""
    b = f"(2 * {dot(direction, pixel)})"
    delta = f"({b} * {b} - 2 * ({a}) * ({dot(pixel, pixel)} - {radius2}))"
    t = f"(({b} + sqrt(greatest({delta}, 0E0))) / ({a}))"
    return f"({delta} > 0)", *(f"(CASE WHEN {delta} > 0 THEN {pixel[k]} - {direction[k]} * {t} ELSE 999E0 END)" for k in range(2))


def matrix_product(a, b):
    """Of square matrices as lists of rows."""
    return [[dot(row, [r[j] for r in b]) for j in range(len(b))] for row in a]


def determinant(m):
    if len(m) == 1:
        return m[0][0]
    minor = lambda j: [[*r[:j], *r[j + 1 :]] for r in m[1:]]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {m[0][j]} * {determinant(minor(j))}" for j in range(len(m))) + ")"


# --- sphere ----------------------------------------------------------------------------------------------------------


def rad(x):
    return f"radians({x})"


def distance_rad(la0, lo0, la1, lo1, radius: float = EARTH_RADIUS):
    """Great-circle distance in metres of points in radians."""
    return f"({num(radius)} * acos({clamp(f'sin({la0}) * sin({la1}) + cos({lo0} - {lo1}) * cos({la0}) * cos({la1})', '-1E0', '1E0')}))"


def distance(lat0, lon0, lat1, lon1):
    return distance_rad(rad(lat0), rad(lon0), rad(lat1), rad(lon1))


def course_rad(la0, lo0, la1, lo1):
    """Initial course, westward positive, in radians."""
    return f"(atan2(sin({lo0} - {lo1}) * cos({la1}), cos({la0}) * sin({la1}) - sin({la0}) * cos({la1}) * cos({lo0} - {lo1})) % {num(TWO_PI)})"


def haversine_rad(la0, lo0, la1, lo1):
    """Angle between points in radians, exact for close ones too."""
    return f"(2 * asin(least(1E0, sqrt(pow(sin(({la0} - {la1}) / 2), 2) + cos({la0}) * cos({la1}) * pow(sin(({lo0} - {lo1}) / 2), 2)))))"


def radial_intersect(source, la0, lo0, la1, lo1, course0, course1):
    """source (a query) with met_lat and met_lon, in radians, where radials from two points meet; null where they don't, or where the points are one or opposite; at a pole the first point's longitude. Courses are westward positive."""
    for step in (
        {"_d": haversine_rad(la0, lo0, la1, lo1), "_t0": f"({course0}) - {course_rad(la0, lo0, la1, lo1)}", "_t1": f"{course_rad(la1, lo1, la0, lo0)} - ({course1})"},
        {"_met": "sin(_t0) * sin(_t1) > 1E-7 AND sin(_d) > 1E-7", "_s": "abs(sin(_t0)) * abs(sin(_t1))"},
        {"_far": "atan2(sin(_d) * _s, cos(_t1) + cos(_t0) * (_s * cos(_d) - cos(_t0) * cos(_t1)))"},
        {"_lat": f"asin({clamp(f'sin({la0}) * cos(_far) + cos({la0}) * sin(_far) * cos({course0})', '-1E0', '1E0')})"},
        {"_lon": f"CASE WHEN cos(_lat) < 1E-6 THEN {lo0} ELSE {lo0} - atan2(sin({course0}) * sin(_far) * cos({la0}), cos(_far) - sin({la0}) * sin(_lat)) END"},
        {"met_lat": "CASE WHEN _met THEN _lat END", "met_lon": f"CASE WHEN _met THEN {wrap_lon_rad('_lon')} END"},
    ):
        source = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM ({source}) s"
    return source


def course(lat0, lon0, lat1, lon1):
    return course_rad(rad(lat0), rad(lon0), rad(lat1), rad(lon1))


def wrap_lon(lon):
    return f"(CASE WHEN {lon} > 180 THEN {lon} - 360 WHEN {lon} < -180 THEN {lon} + 360 ELSE {lon} END)"


def meridian(lon):
    """A rounded longitude, 180 for -180: rounding errors leave a place on that meridian on either side of it."""
    return f"(CASE WHEN {lon} = -180 THEN 180E0 ELSE {lon} END)"


def wrap_lon_rad(lon):
    p, t = num(math.pi), num(TWO_PI)
    return f"(CASE WHEN {lon} > {p} THEN (({lon} + {p}) % {t}) - {p} WHEN {lon} <= -{p} THEN (({lon} - {p}) % {t}) + {p} ELSE {lon} END)"


def within(lat0, lon0, lat1, lon1, lat, lon):
    """Point in a box that may cross the date line."""
    d = f"({lon1} - {lon0})"
    return f"({lat} >= {lat0} AND {lat} <= {lat1} AND (CASE WHEN {d} <= 180 THEN {lon} >= {lon0} AND {lon} <= {lon1} ELSE ({lon} <= {lon0} AND {d} > -180) OR ({lon} >= {lon1} AND {d} < 180) END))"


def rotate(lat, lon, theta: float, phi: float):
    """(lat, lon) in a system whose pole is turned by theta and phi degrees."""
    ct, st, cp, sp = (num(f(math.radians(a))) for a, f in ((theta, math.cos), (theta, math.sin), (phi, math.cos), (phi, math.sin)))
    x, y, z = f"cos({rad(lon)}) * cos({rad(lat)})", f"sin({rad(lon)}) * cos({rad(lat)})", f"sin({rad(lat)})"
    xr, yr, zr = f"({ct} * {cp} * {x} + {ct} * {sp} * {y} + {st} * {z})", f"({cp} * {y} - {sp} * {x})", f"({ct} * {z} - {st} * {cp} * {x} - {st} * {sp} * {y})"
    return f"degrees(asin({clamp(zr, '-1E0', '1E0')}))", f"degrees(atan2({yr}, {xr}))"


def unrotate(lat, lon, theta: float, phi: float):
    """The inverse of rotate."""
    ct, st, cp, sp = (num(f(math.radians(a))) for a, f in ((theta, math.cos), (theta, math.sin), (phi, math.cos), (phi, math.sin)))
    x, y, z = f"cos({rad(lon)}) * cos({rad(lat)})", f"sin({rad(lon)}) * cos({rad(lat)})", f"sin({rad(lat)})"
    xr, yr, zr = f"({ct} * {cp} * {x} - {sp} * {y} - {st} * {cp} * {z})", f"({ct} * {sp} * {x} + {cp} * {y} - {st} * {sp} * {z})", f"({st} * {x} + {ct} * {z})"
    return f"degrees(asin({clamp(zr, '-1E0', '1E0')}))", f"degrees(atan2({yr}, {xr}))"


def radar_project(x, y, lat0: float, lon0: float, res_r: float, res_a: float, cos_sweep: float = 1.0):
    """(lat, lon) of azimuth step x and range bin y of a radar."""
    a, d = rad(f"({x} * {num(res_a)})"), f"({y} * {num(res_r * cos_sweep * 0.00000015706707756635)})"
    s0, c0 = num(math.sin(math.radians(lat0))), num(math.cos(math.radians(lat0)))
    lat = f"asin({clamp(f'{s0} * cos({d}) + {c0} * sin({d}) * cos({a})', '-1E0', '1E0')})"
    lon = f"((({num(math.radians(lon0))} + atan2(sin({a}) * sin({d}) * {c0}, cos({d}) - {s0} * sin({lat})) + {num(math.pi)}) % {num(TWO_PI)}) - {num(math.pi)})"
    return f"degrees({lat})", f"degrees({lon})"


def radar_unproject(lat, lon, lat0: float, lon0: float, res_r: float, res_a: float, cos_sweep: float = 1.0):
    """(azimuth step, range bin) of a point."""
    la0, lo0 = num(math.radians(lat0)), num(math.radians(lon0))
    c = f"(-degrees({course_rad(la0, lo0, rad(lat), rad(lon))}))"
    return f"((CASE WHEN {c} < 0 THEN {c} + 360 ELSE {c} END) / {num(res_a)})", f"({distance_rad(la0, lo0, rad(lat), rad(lon))} / {num(res_r * cos_sweep)})"


def radar_height(elevation: float, sweep_deg, bin_, res_r: float):
    return f"({num(elevation)} + sin({rad(sweep_deg)}) * {bin_} * {num(res_r)})"


def affine(t: list[float], x, y):
    """(X, Y) of the transform t of six numbers."""
    return f"({num(t[0])} + {num(t[1])} * {x} + {num(t[2])} * {y})", f"({num(t[3])} + {num(t[4])} * {x} + {num(t[5])} * {y})"


def affine_inverse(t: list[float], x, y):
    det = t[1] * t[5] - t[2] * t[4]
    return f"(({num(t[5])} * ({x} - {num(t[0])}) - {num(t[2])} * ({y} - {num(t[3])})) / {num(det)})", f"(({num(t[1])} * ({y} - {num(t[3])}) - {num(t[4])} * ({x} - {num(t[0])})) / {num(det)})"


def barycentric(x, y, p):
    """Weights of a point for a triangle of three (x, y) pairs of texts."""
    (x0, y0), (x1, y1), (x2, y2) = p
    w = f"nullif(({x1} - {x0}) * ({y2} - {y0}) - ({x2} - {x0}) * ({y1} - {y0}), 0)"
    b0 = f"((({x1} - {x}) * ({y2} - {y}) - ({x2} - {x}) * ({y1} - {y})) / {w})"
    b1 = f"((({x2} - {x}) * ({y0} - {y}) - ({x0} - {x}) * ({y2} - {y})) / {w})"
    return b0, b1, f"(1 - {b0} - {b1})"


def wind_unrotate(lat, lon, glat, glon, u, v, theta: float, phi: float):
    """(u, v) to the east and north at (lat, lon) of a wind along the axes of a rotated grid, where the point is (glat, glon): the wind as a vector in space, turned back."""
    ct, st, cp, sp = (num(f(math.radians(a))) for a, f in ((theta, math.cos), (theta, math.sin), (phi, math.cos), (phi, math.sin)))
    a, b = rad(glat), rad(glon)
    x, y, z = f"(-{u} * sin({b}) - {v} * sin({a}) * cos({b}))", f"({u} * cos({b}) - {v} * sin({a}) * sin({b}))", f"({v} * cos({a}))"
    xr, yr, zr = f"({ct} * {cp} * {x} - {sp} * {y} - {st} * {cp} * {z})", f"({ct} * {sp} * {x} + {cp} * {y} - {st} * {sp} * {z})", f"({st} * {x} + {ct} * {z})"
    a, b = rad(lat), rad(lon)
    return f"({yr} * cos({b}) - {xr} * sin({b}))", f"({zr} * cos({a}) - ({xr} * cos({b}) + {yr} * sin({b})) * sin({a}))"


def spherical_triangle_area(p):
    """Area in square metres of a triangle of three (lon, lat) pairs, each side as a line of latitude and longitude."""
    s = " + ".join(f"({rad(p[(k + 1) % 3][0])} - {rad(p[k][0])}) * (2 + sin({rad(p[k][1])}) + sin({rad(p[(k + 1) % 3][1])}))" for k in range(3))
    return f"(abs({s}) * {num(EARTH_RADIUS * EARTH_RADIUS / 2)})"


# --- levels ----------------------------------------------------------------------------------------------------------

#: Names and units by code of level kind; codes that are not listed are NIL.
LEVEL_KINDS = {0: ("MASL", "m"), 1: ("SIGMA", "sg"), 2: ("PRESSURE", "mb"), 3: ("UNDEFINED", "-"), 4: ("MAGL", "m"), 5: ("HYBRID", "hy"), 6: ("THETA", "th"), 7: ("MBSL", "m-"), 8: ("GALCHEN", "m"), 9: ("COUNT", "nb"), 10: ("HOUR", "hr"), 11: ("ANGLE", "dg"), 15: ("INT", "i"), 17: ("IDX", "x"), 21: ("MPRES", "mp")}


def level_name(kind):
    return "(CASE " + " ".join(f"WHEN {kind} = {k} THEN '{n}'" for k, (n, _) in LEVEL_KINDS.items()) + " ELSE 'NIL' END)"


def level_unit(kind):
    return "(CASE " + " ".join(f"WHEN {kind} = {k} THEN '{u}'" for k, (_, u) in LEVEL_KINDS.items()) + " ELSE '--' END)"


def level_to_pressure(kind: str, level, p0, ptop: float = 10.0, pref: float = 800.0, rcoef: float = 1.6):
    """Pressure of a level of kind PRES, SIGMA, ETA or HYBRID, in the unit of p0."""
    rt = num(ptop / pref)
    return {
        "PRES": f"({level})",
        "SIGMA": f"({p0} * {level})",
        "ETA": f"({num(ptop)} + ({p0} - {num(ptop)}) * {level})",
        "HYBRID": f"({num(pref)} * {level} + ({p0} - {num(pref)}) * pow(greatest(0E0, ({level} - {rt}) / (1 - {rt})), {num(rcoef)}))",
    }[kind]


def pressure_to_level(kind: str, pressure, p0, ptop: float = 10.0):
    """The inverse in closed form, for PRES, SIGMA and ETA."""
    return {"PRES": f"({pressure})", "SIGMA": f"({pressure} / nullif({p0}, 0))", "ETA": f"(({pressure} - {num(ptop)}) / nullif({p0} - {num(ptop)}, 0))"}[kind]


def pressure_to_metres(p):
    """Height in the standard atmosphere."""
    return (
        f"(CASE WHEN {p} > 226.3203E0 THEN 44330.8E0 * (1 - pow({p} / 1013.25E0, 0.190263E0)) WHEN {p} > 54.749E0 THEN 11000E0 - 6341.624E0 * ln({p} / 226.3202E0)"
        f" WHEN {p} > 8.68E0 THEN 20000E0 + 216650E0 * (pow({p} / 54.749E0, -0.0292173E0) - 1) WHEN {p} > 0 THEN 32000E0 + 81660.7E0 * (pow({p} / 8.680157E0, -0.0819469E0) - 1) ELSE 0E0 END)"
    )


def sigma_to_metres(s):
    return f"(CASE WHEN {s} > 0 THEN -8409.1E0 * ln({s}) ELSE -8409.1E0 * ln(1E-32) END)"


def eta_to_metres(s):
    return f"(-8409.1E0 * ln({s} + 1E-32))"


def level_to_metres(kind, level):
    """Height of a level by the code of its kind."""
    return f"(CASE WHEN {kind} IN (0, 3, 4, 8, 11) THEN {level} WHEN {kind} = 7 THEN -{level} WHEN {kind} = 1 THEN {sigma_to_metres(level)} WHEN {kind} IN (5, 32) THEN {eta_to_metres(level)} WHEN {kind} = 2 THEN {pressure_to_metres(level)} ELSE 0E0 END)"


def level_in_metres(kind, level, gz, top):
    """Height above the sea of a level over the topography gz (decametres), by kind: above the sea, below it, above ground, or Gal-Chen coordinates under a top; null for others."""
    return f"(CASE WHEN {kind} = 0 THEN {level} WHEN {kind} = 7 THEN -{level} WHEN {kind} = 4 THEN {gz} * 10E0 + {level} WHEN {kind} = 8 THEN {level} * (1 - {gz} * 10E0 / {top}) + {gz} * 10E0 END)"


#: Kinds of level by the version of a vertical descriptor (first and last version of a kind).
VERSION_KINDS = [(1001, 1001, "SIGMA"), (1002, 1003, "ETA"), (2001, 2001, "PRESSURE"), (5001, 5100, "HYBRID")]


def version_kind(version):
    return "(CASE " + " ".join(f"WHEN {version} BETWEEN {a} AND {b} THEN '{k}'" for a, b, k in VERSION_KINDS) + " END)"


# --- text ------------------------------------------------------------------------------------------------------------


def dirname_join(e: Spark, path, file):
    """The folder of path, and file in it."""
    return f"concat(CASE WHEN {path} LIKE '%/%' THEN {e.replace_all(path, '/[^/]*$', '')} ELSE '' END, '/', {file})"


def index_suffix(e: Spark, s):
    """Number of the first ``(n)`` of s, or -1; and s without its parentheses."""
    got = e.extract(s, r"[(]([0-9]+)[)]", 1)
    return f"(CASE WHEN {got} = '' THEN -1 ELSE CAST(nullif({got}, '') AS BIGINT) END)", f"(CASE WHEN {s} LIKE '%(%' AND {s} LIKE '%)%' THEN {e.replace_all(s, '[(][^)]*[)]', '')} ELSE {s} END)"


def token_count(e: Spark, s, sep: str):
    """Tokens between runs of sep in the first line of s, its first character aside."""
    return f"CAST(length({e.replace_all(e.replace_all(e.extract(f'substr({s}, 2)', '^[^\\n]*').replace(chr(10), ''), f'[^{sep}]+', 'x'), f'{sep}', '')}) AS BIGINT)"


def replace_char(s, a: str, b: str):
    """a by b, but for the first character."""
    return f"concat(substr({s}, 1, 1), translate(substr({s}, 2), '{a}', '{b}'))"


# --- time ------------------------------------------------------------------------------------------------------------


def julian_day(e: Spark, y, m, d):
    """Julian day at midnight."""
    return f"({e.day_number(y, m, d)} + 2440587.5E0)"


def valid_date(origin_seconds, deet, npas):
    """Validity time in seconds; 0 without origin."""
    return f"(CASE WHEN {origin_seconds} = 0 THEN 0 ELSE {origin_seconds} + CAST({deet} AS BIGINT) * ({npas}) END)"


# --- sun and moon (epoch 1990 January 0.0) ---------------------------------------------------------------------------

EPS_G, OMEGA_G, ECCENTRICITY, OBLIQUITY = math.radians(279.403303), math.radians(282.768422), 0.016713, math.radians(23.440592)
MOON_LONGITUDE, MOON_PERIGEE, MOON_NODE, MOON_INCLINATION, SIDEREAL_MONTH, TROPICAL_YEAR = math.radians(318.351648), math.radians(36.340410), math.radians(318.510107), math.radians(5.145396), 27.3217, 365.242191
EPOCH_1990 = 631065600


def days_1990(seconds):
    return f"(({seconds} - {EPOCH_1990}) / 86400E0)"


def mean_anomaly(days):
    n = f"({num(TWO_PI / TROPICAL_YEAR)} * {days})"
    return f"((({n} % {num(TWO_PI)}) + {num(TWO_PI)}) % {num(TWO_PI)} + {num(EPS_G - OMEGA_G)})"


def kepler(m, steps: int = 4):
    """Eccentric anomaly; each step is Newton's, from the mean anomaly (four reach 1e-10 at this eccentricity)."""
    e, x = num(ECCENTRICITY), f"({m})"
    names = [x]
    for _ in range(steps):
        names.append(f"({names[-1]} - ({names[-1]} - {e} * sin({names[-1]}) - {x}) / (1 - {e} * cos({names[-1]})))")
    return names[-1]


def true_longitude(eccentric):
    return f"(2 * atan({num(math.sqrt((1 + ECCENTRICITY) / (1 - ECCENTRICITY)))} * tan({eccentric} / 2)) + {num(OMEGA_G)})"


def equatorial(lam, beta):
    """(right ascension, declination) in radians."""
    s, c = num(math.sin(OBLIQUITY)), num(math.cos(OBLIQUITY))
    return f"atan2(sin({lam}) * {c} - tan({beta}) * {s}, cos({lam}))", f"asin({clamp(f'sin({beta}) * {c} + cos({beta}) * {s} * sin({lam})', '-1E0', '1E0')})"


def sidereal_hours(e: Spark, seconds):
    """Greenwich mean sidereal time."""
    day = e.floor(f"({seconds} / 86400E0)")
    t = f"(({day} + 2440587.5E0 - 2451545) / 36525)"
    t0 = f"(({t} + 2.5862E-5) * {t} + 2400.051336E0) * {t} + 6.697374558E0"
    return f"(((((({t0}) % 24) + 24) % 24) + ({seconds} - {day} * 86400) / 3600E0 * 1.002737909E0) % 24)"


def normal_angle(x):
    """In [-pi, pi), for any angle."""
    return f"(((({x} + {num(math.pi)}) % {num(TWO_PI)}) + {num(TWO_PI)}) % {num(TWO_PI)} - {num(math.pi)})"


def quad_steps(x, y, corners) -> list[dict[str, str]]:
    """Columns to add, a list at a time, that end in ``v`` and ``u``: the place in a quadrilateral whose corners (x, y) are at (0, 0), (0, 1), (1, 1) and (1, 0), by the root of the bilinear map's quadratic in v within [0, 1]."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners
    return [
        {"_ex": f"{x3} - {x0}", "_ey": f"{y3} - {y0}", "_fx": f"{x1} - {x0}", "_fy": f"{y1} - {y0}", "_gx": f"{x0} - {x3} + {x2} - {x1}", "_gy": f"{y0} - {y3} + {y2} - {y1}", "_hx": f"{x} - {x0}", "_hy": f"{y} - {y0}"},
        {"_k2": "_gx * _fy - _gy * _fx", "_k1": "_ex * _fy - _ey * _fx + _hx * _gy - _hy * _gx", "_k0": "_hx * _ey - _hy * _ex"},
        {"_disc": "sqrt(greatest(0E0, _k1 * _k1 - 4 * _k2 * _k0))"},
        {"_low": "(-_k1 - _disc) / nullif(2 * _k2, 0)"},
        {"v": "CASE WHEN abs(_k2) < 1E-12 THEN -_k0 / nullif(_k1, 0) WHEN _low >= -1E-9 AND _low <= 1.000000001E0 THEN _low ELSE (-_k1 + _disc) / nullif(2 * _k2, 0) END"},
        {"_dx": "_ex + _gx * v", "_dy": "_ey + _gy * v"},
        {"u": "CASE WHEN abs(_dx) > abs(_dy) THEN (_hx - _fx * v) / nullif(_dx, 0) ELSE (_hy - _fy * v) / nullif(_dy, 0) END"},
    ]


def quad_inverse(source: str, x, y, corners) -> str:
    """source (a query) with u and v (quad_steps)."""
    for step in quad_steps(x, y, corners):
        source = f"SELECT *, {', '.join(f'{t} AS {k}' for k, t in step.items())} FROM ({source}) q"
    return source


def quad_place(x, y, corners) -> str:
    """struct<.., v, u> of quad_steps as one expression; each step is a lambda's variable, so that the text stays short however the planner moves it."""
    first, *steps = quad_steps(x, y, corners)
    pairs, names = (lambda d: ", ".join(f"'{k}', {t}" for k, t in d.items())), list(first)
    text = f"array(named_struct({pairs(first)}))"
    for step in steps:
        fields = {n: f"q.{n}" for n in names} | {k: re.sub(r"\b(_\w+|v)\b", r"q.\1", t) for k, t in step.items()}
        names += list(step)
        text = f"transform({text}, q -> named_struct({pairs(fields)}))"
    return f"element_at({text}, 1)"
