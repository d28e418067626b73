"""Queries over the scalar functions. One text each, in either dialect."""

from __future__ import annotations

import math
import re
import uuid

from isobar.functions import expr as x
from isobar.functions.expr import DUCK, SPARK, num

from .registry import QUERIES, SQL




def r(e: str, digits: int = 6) -> str:
    return f"(round({e}, {digits}) + 0E0)"


def columns(named: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in named.items())


def register(name: str, tables: str, build) -> None:
    """build(dialect) gives the query's text."""

    def run(spark, sf_dir):
        text, views = build(SPARK), {t: f"{t}_{uuid.uuid4().hex}" for t in tables.split()}
        for t, view in views.items():  # names of their own, so that no view of the session is touched
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createTempView(view)
            text = re.sub(rf"\bFROM {t}\b", f"FROM {view}", text)
        out = spark.sql(text)
        for view in views.values():
            spark.catalog.dropTempView(view)
        return out

    QUERIES[name], SQL[name] = run, build(DUCK)


def points(e, table: str = "customer", key: str = "c_custkey") -> str:
    """Derived coordinates: the same doubles in any engine."""
    return f"SELECT {key} AS id, CAST(({key} * 7919) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - 180 AS lon, CAST(({key} * 104729) % 17000 AS DOUBLE) / CAST(100 AS DOUBLE) - 85 AS lat FROM {table}"


def _numbers(e):
    q, p = "l_quantity", "l_extendedprice"
    a, b = "l_tax", "l_discount"
    c = {
        "clamped": x.clamp(q, "10E0", "40E0"), "blended": r(x.lerp(q, p, a)), "part_of": r(x.fraction(q, a, p)), "part_equal": x.fraction(q, b, b), "bracketed": x.between_any(q, a, "25E0"), "rounded": x.round_half_up(e, p),
        "magnitude": x.order(e, p), "span": x.range_order(e, p), "step": r(x.range_increment(x.order(e, p))), "even": e.rint(f"({q} / 2)"), "index2": "l_linenumber * 1000 + l_suppkey % 1000", "log2": r("log10(l_quantity) / 0.301029995663981198017E0"),
    }
    return f"SELECT l_orderkey, l_linenumber, {columns(c)} FROM lineitem"


def _curves(e):
    w = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    v = [f"lag(value, 1) {w}", "value", f"lead(value, 1) {w}", f"lead(value, 2) {w}"]
    inner = f"SELECT event_id, {v[0]} AS v0, {v[1]} AS v1, {v[2]} AS v2, {v[3]} AS v3, CAST(event_id % 10 AS DOUBLE) / 10 AS f FROM events"
    c = {"cubic": r(x.cubic("v0", "v1", "v2", "v3", "f"), 9), "hermite": r(x.hermite("v0", "v1", "v2", "v3", "f", "0.25E0", "0.5E0"), 9)}
    return f"SELECT event_id, {columns(c)} FROM ({inner}) t"  # null at the ends of a track


def _bits(e):
    k = "(o_orderkey * 2654435761 % 4294967296 + 1)"
    c = {"ones": e.bits(k), "lead32": x.leading_zeros(e, k, 32), "lead64": x.leading_zeros(e, k, 64), "trail": x.trailing_zeros(e, k), "top": x.highest_bit(e, k), "key": f"({e.shl('o_custkey', '32')} | o_orderkey)", "file": f"(({e.shl('o_custkey', '32')} | o_orderkey) & 2147483647)", "rec": e.shr(f"({e.shl('o_custkey', '32')} | o_orderkey)", "32")}
    return f"SELECT o_orderkey, {columns(c)} FROM orders"


def _vectors(e):
    a, b = ["p_retailprice", "CAST(p_size AS DOUBLE)", "CAST(p_partkey % 17 AS DOUBLE)"], ["1.5E0", "CAST(p_partkey % 5 AS DOUBLE)", "(CAST(p_size % 7 AS DOUBLE) - 3)"]
    u, n, cr = x.unit(a), x.unit(x.cross(a, b)), x.cross(a, b)
    c = {"dot": r(x.dot(a, b)), "norm": r(x.norm(a)), "dist": r(x.norm([f"({p} - {q})" for p, q in zip(a, b)]))} | {f"unit{i}": r(u[i]) for i in range(3)} | {f"cross{i}": r(cr[i]) for i in range(3)} | {f"normal{i}": r(n[i]) for i in range(3)} | {f"mid{i}": r(f"(({a[i]} + {b[i]}) / 2)") for i in range(3)} | {f"hi{i}": f"greatest({a[i]}, {b[i]})" for i in range(3)}
    plane, ray = x.plane_hit(b, a, "5E0"), x.sphere_hit(b, f"(2 * {x.dot(b, b)})", a, "1440000E0")
    c |= {"plane_hit": plane[0], "plane_x": r(plane[1]), "plane_y": r(plane[2]), "sphere_hit": ray[0], "sphere_x": r(ray[1], 5), "sphere_y": r(ray[2], 5)}
    return f"SELECT p_partkey, {columns(c)} FROM part"


def _matrices(e):
    m = [[f"CAST((p_partkey * {3 + i} + p_size * {j + 1}) % {7 + i + j} AS DOUBLE)" for j in range(4)] for i in range(4)]
    ca, sa = num(math.cos(0.5)), num(math.sin(0.5))
    k = [["1E0", "0E0", "0E0", "2E0"], ["0E0", ca, f"-{sa}", "0E0"], ["0E0", sa, ca, "0E0"], ["0E0", "0E0", "0E0", "1E0"]]
    p = x.matrix_product(m, k)
    c = {f"m{i}{j}": r(p[i][j]) for i in range(4) for j in range(4)} | {"det": r(x.determinant(m))} | {f"v{j}": r(x.dot(["1E0", "CAST(p_size AS DOUBLE)", "3E0"], [m[i][j] for i in range(3)])) for j in range(3)}
    return f"SELECT p_partkey, {columns(c)} FROM part"


def _sphere(e):
    ro = x.rotate("lat", "lon", 30.0, 60.0)
    un = x.unrotate("rlat", "rlon", 30.0, 60.0)
    ra = x.radar_unproject("lat", "lon", 45.5, -73.6, 500.0, 0.5)
    rp = x.radar_project("az", "bin", 45.5, -73.6, 500.0, 0.5)
    t = [10.0, 0.5, 0.1, -20.0, 0.05, 0.25]
    af, ai = x.affine(t, "lon", "lat"), x.affine_inverse(t, "ax", "ay")
    a = f"SELECT id, lat, lon, {ro[0]} AS rlat, {ro[1]} AS rlon, {ra[0]} AS az, {ra[1]} AS bin, {af[0]} AS ax, {af[1]} AS ay FROM ({points(e)}) p"
    c = {
        "metres": r(x.distance("lat", "lon", "45.5E0", "-73.6E0"), 3), "bearing": r(f"degrees({x.course('lat', 'lon', '45.5E0', '(-73.6E0)')})", 5), "wrapped": r(x.wrap_lon("(lon + 200)")), "wrapped_rad": r(x.wrap_lon_rad("radians(lon + 200)")),
        "in_box": x.within("-40E0", "-20E0", "60E0", "100E0", "lat", "lon"), "in_dateline_box": x.within("-40E0", "-170E0", "60E0", "170E0", "lat", "lon"), "clamped_lat": x.clamp("(lat * 2)", "-90E0", "90E0"), "rlat": r("rlat"), "rlon": r("rlon"), "back_lat": r(un[0], 5), "back_lon": x.meridian(r(un[1], 5)),
        "az": r("az", 4), "bin": r("bin", 4), "radar_lat": r(rp[0], 4), "sweep_height": r(x.radar_height(120.0, "2.5E0", "floor(bin)", 500.0), 3), "ax": r("ax"), "ay": r("ay"), "inv_x": r(ai[0]), "inv_y": r(ai[1]), "grid_x": r("(lon + 180) / 30"), "default_lat": r("lat / 180"),
    }
    return f"SELECT id, {columns(c)} FROM ({a}) q"


def _radials(e, places=None):
    """Course crossing of two radials, and the foot of a point on a great circle (flat formulas of the sphere, in radians). A great circle through the fixed point is undefined, and its columns are null, where the point is that point or its antipode. Crossing of radials from both with two courses."""
    a = f"SELECT id, radians(lat) AS a1, radians(lon) AS o1, radians(45.5E0) AS a2, radians(-73.6E0) AS o2, radians(10E0) AS a3, radians(20E0) AS o3, radians(CAST((id * 37) % 360 AS DOUBLE)) AS r1, radians(CAST((id * 53) % 360 AS DOUBLE)) AS r2 FROM ({places or points(e)}) p"
    b = f"SELECT *, {x.course_rad('a1', 'o1', 'a2', 'o2')} AS c12, {x.course_rad('a1', 'o1', 'a3', 'o3')} AS c13, {x.haversine_rad('a1', 'o1', 'a3', 'o3')} AS d13, {x.haversine_rad('a1', 'o1', 'a2', 'o2')} AS d12 FROM ({a}) a"
    c = f"SELECT *, sin(d12) > 1E-7 AS ok, asin({x.clamp('sin(d13) * sin(c13 - c12)', '-1E0', '1E0')}) AS across, atan2(sin(d13) * cos(c13 - c12), cos(d13)) AS along FROM ({b}) b"
    f = f"SELECT *, asin({x.clamp('sin(a1) * cos(along) + cos(a1) * sin(along) * cos(c12)', '-1E0', '1E0')}) AS af FROM ({c}) c"
    out = {"across_km": ("across * 6371", 2), "along_km": ("along * 6371", 2), "foot_lat": ("degrees(af)", 3), "ratio": ("along / d12", 4)}
    out = {k: f"CASE WHEN ok THEN {r(*v)} END" for k, v in out.items()} | {"cross_lat": r("degrees(met_lat)", 3), "cross_lon": r("degrees(met_lon)", 3)}
    return f"SELECT id, {columns(out)} FROM ({x.radial_intersect(f, 'a1', 'o1', 'a2', 'o2', 'r1', 'r2')}) g"


def _levels(e):
    a = "SELECT p_partkey, CAST(950 + p_size AS DOUBLE) AS p0, CAST(1 + p_partkey % 20 AS DOUBLE) / 20 AS s, CAST(p_partkey % 33 AS BIGINT) AS kind FROM part"
    c = {f"pres_{k.lower()}": r(x.level_to_pressure(k, "s" if k != "PRES" else "(s * 1000)", "p0")) for k in ("PRES", "SIGMA", "ETA")} | {"pres_hybrid": r(x.level_to_pressure("HYBRID", "greatest(s, 0.05E0)", "p0"))}
    c |= {f"level_{k.lower()}": r(x.pressure_to_level(k, "(s * 900)", "p0")) for k in ("PRES", "SIGMA", "ETA")}
    c |= {"height": r(x.level_to_metres("kind", "s"), 4), "height_pres": r(x.pressure_to_metres("(s * 1000)"), 4), "name": x.level_name("kind"), "unit": x.level_unit("kind"), "log_pres": r("ln(p0 * s)"), "label": f"concat(' ', {e.format_number('s', 8, 4)}, ' ', {x.level_unit('kind')})"}
    return f"SELECT p_partkey, {columns(c)} FROM ({a}) a"


def _text(e):
    idx = x.index_suffix(e, "concat(p_name, '(', CAST(p_size AS STRING), ')')")
    idx2 = x.index_suffix(e, "p_name")
    c = {
        "trimmed": "trim(BOTH 'o' FROM p_name)", "replaced": x.replace_char("p_name", "a", "_"), "path": x.dirname_join(e, "concat('/data/', p_brand, '/', p_name)", "p_type"), "joined": "concat(coalesce(p_name, ''), coalesce(p_brand, ''))", "index_of": idx[0], "rest": idx[1], "no_index": idx2[0],
        "tokens": x.token_count(e, "p_name", " "), "bounded": "substr(p_name, 1, 7)", "matched": e.matches("p_type", "'^[a-p].*(steel|brass)'"), "fixed_size": "CAST(length(rtrim(concat(p_brand, '   '))) AS BIGINT)", "folded": "translate(concat('éàç', p_name), 'éèêëàâäçîïôöùûü', 'eeeeaaaciioouuu')",
        "codes": f"concat(CAST({e.ascii('p_name')} AS STRING), '-', chr(CAST(65 + p_size % 26 AS INT)))",
    }
    sql = f"SELECT p_partkey, {columns(c)} FROM part"
    return sql if e is SPARK else sql.replace("AS STRING", "AS VARCHAR").replace("trim(BOTH 'o' FROM p_name)", "trim(p_name, 'o')")


def _dates(e):
    y, m, d, s = "CAST(year(o_orderdate) AS BIGINT)", "CAST(month(o_orderdate) AS BIGINT)", "CAST(day(o_orderdate) AS BIGINT)", e.seconds("o_orderdate")
    c = {
        "seconds": s, "yyyymmdd": f"({y} * 10000 + {m} * 100 + {d})", "hhmmss": "CAST(hour(o_orderdate) * 10000 + minute(o_orderdate) * 100 + second(o_orderdate) AS BIGINT)", "julian": x.julian_day(e, y, m, d), "day_of_year": f"({e.day_number(y, m, d)} - {e.day_number(y, '1', '1')} + 1)",
        "from_julian": e.timestamp(f"({e.day_number(y, '1', '1')} + o_custkey % 365) * 86400 + 3723"), "encoded": e.timestamp(s), "formatted": e.date_text("o_orderdate", "yyyy/MM/dd HH:mm", "%Y/%m/%d %H:%M"), "valid": x.valid_date(s, "3600", "o_custkey % 48"), "no_origin": x.valid_date("0", "3600", "5"),
    }
    return f"SELECT o_orderkey, {columns(c)} FROM orders"


def sky(e, source: str) -> str:
    """From rows (id, s): overhead positions of sun and moon at s seconds; stages so that no text grows."""
    q = f"SELECT id, s, {x.days_1990('s')} AS d, {x.mean_anomaly(x.days_1990('s'))} AS ms FROM ({source}) s0"
    q = f"SELECT *, ms AS e0 FROM ({q}) s1"
    for k in range(4):
        q = f"SELECT *, e{k} - (e{k} - {num(x.ECCENTRICITY)} * sin(e{k}) - ms) / (1 - {num(x.ECCENTRICITY)} * cos(e{k})) AS e{k + 1} FROM ({q}) k{k}"
    q = f"SELECT *, {x.true_longitude('e4')} AS lam, {x.sidereal_hours(e, 's')} AS gst FROM ({q}) s2"
    ra, de = x.equatorial("lam", "0E0")
    q = f"SELECT *, degrees({de}) AS sun_lat, degrees({x.normal_angle(f'({ra} - {num(math.pi / 12)} * gst)')}) AS sun_lon FROM ({q}) s3"
    dg = lambda v: num(math.radians(v))
    q = f"SELECT *, {x.normal_angle(f'(((d / {num(x.SIDEREAL_MONTH)}) % 1) * {num(x.TWO_PI)} + {num(x.MOON_LONGITUDE)})')} AS l0 FROM ({q}) m0"
    q = f"SELECT *, {x.normal_angle(f'(l0 - {dg(0.1114041)} * d - {num(x.MOON_PERIGEE)})')} AS m1, {x.normal_angle(f'({num(x.MOON_NODE)} - {dg(0.0529539)} * d)')} AS n0 FROM ({q}) m1q"
    q = f"SELECT *, {dg(1.2739)} * sin(2 * (l0 - lam) - m1) AS ev, {dg(0.1858)} * sin(ms) AS ae FROM ({q}) m2q"
    q = f"SELECT *, m1 + ev - ae - {dg(0.37)} * sin(ms) AS m2 FROM ({q}) m3q"
    q = f"SELECT *, l0 + ev + {dg(6.2886)} * sin(m2) - ae + {dg(0.214)} * sin(2 * m2) AS l1, n0 - {dg(0.16)} * sin(ms) AS n1 FROM ({q}) m4q"
    q = f"SELECT *, l1 + {dg(0.6583)} * sin(2 * (l1 - lam)) - n1 AS l2 FROM ({q}) m5q"
    ci, si = num(math.cos(x.MOON_INCLINATION)), num(math.sin(x.MOON_INCLINATION))
    q = f"SELECT *, {x.normal_angle(f'(n1 + atan2(sin(l2) * {ci}, cos(l2)))')} AS ml, asin(sin(l2) * {si}) AS mb FROM ({q}) m6q"
    ra, de = x.equatorial("ml", "mb")
    q = f"SELECT *, degrees({de}) AS moon_lat, degrees({x.normal_angle(f'({ra} - {num(math.pi / 12)} * gst)')}) AS moon_lon FROM ({q}) m7q"
    return q


def _sky(e):
    c = {"sun_lat": r("sun_lat", 5), "sun_lon": r("sun_lon", 5), "moon_lat": r("moon_lat", 4), "moon_lon": r("moon_lon", 4), "sidereal": r("gst", 6), "longitude": r("degrees(lam)", 5)}
    return f"SELECT id, {columns(c)} FROM ({sky(e, f'SELECT event_id AS id, {e.seconds("ts")} AS s FROM events')}) z"


def storage_type(datyp: str, width: str) -> str:
    """Storage type of a standard data type code and a width in bytes."""
    sized = lambda p, names, d: "CASE " + " ".join(f"WHEN {width} = {w} THEN '{p}{n}'" for w, n in names) + f" ELSE '{p}{d}' END"
    ints = [(1, 8), (2, 16), (4, 32), (8, 64)]
    return (
        f"(CASE WHEN {datyp} = 0 THEN 'BINARY' WHEN {datyp} IN (2, 130) THEN {sized('UINT', ints, 32)} WHEN {datyp} IN (4, 132) THEN {sized('INT', ints, 32)} WHEN {datyp} IN (1, 5) THEN {sized('FLOAT', ints[2:], 32)}"
        f" WHEN {datyp} IN (133, 134) THEN {sized('CFLOAT', ints[2:], 32)} WHEN {datyp} IN (3, 7) THEN 'STRING' ELSE 'NOTYPE' END)"
    )


def _storage(e):
    d = "CAST(CASE o_orderkey % 11 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 130 WHEN 3 THEN 4 WHEN 4 THEN 132 WHEN 5 THEN 1 WHEN 6 THEN 5 WHEN 7 THEN 133 WHEN 8 THEN 134 WHEN 9 THEN 7 ELSE 99 END AS BIGINT)"
    w = "CAST(CASE o_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE -1 END AS BIGINT)"
    c = {"kind": storage_type(d, w), "as_byte": f"CAST({e.trunc('o_totalprice')} % 128 AS BIGINT)", "as_int": e.trunc("o_totalprice"), "as_float": r("CAST(CAST(o_custkey AS FLOAT) AS DOUBLE)")}
    return f"SELECT o_orderkey, {columns(c)} FROM orders"


for _name, _tables, _build in [
    ("fn_numbers", "lineitem", _numbers), ("fn_curves", "events", _curves), ("fn_bits", "orders", _bits), ("fn_vectors", "part", _vectors), ("fn_matrices", "part", _matrices), ("fn_sphere", "customer", _sphere), ("fn_radials", "customer", _radials),
    ("fn_levels", "part", _levels), ("fn_text", "part", _text), ("fn_dates", "orders", _dates), ("fn_sun_moon", "events", _sky), ("fn_storage_types", "orders", _storage),
]:
    register(_name, _tables, _build)


def _between(e):
    """Seconds between a customer's orders."""
    s = e.seconds("o_orderdate")
    return f"SELECT o_orderkey, CAST({s} - lag({s}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DOUBLE) AS between_s FROM orders"


register("fn_between", "orders", _between)


def _outcodes(e):
    return f"SELECT id, CAST({x.outcode('lon', 'lat', '-90E0', '-40E0', '60E0', '50E0')} AS BIGINT) AS code FROM ({points(e)}) p"


register("fn_outcodes", "customer", _outcodes)


def _quads(e):
    """Places in a quadrilateral, mapped forward and back."""
    q = [("0E0", "0E0"), ("1E0", "5E0"), ("7E0", "6E0"), ("5E0", "-1E0")]
    u, v = "(CAST(p_partkey % 21 AS DOUBLE) / 20)", "(CAST(p_size % 11 AS DOUBLE) / 10)"
    f = lambda k: f"({q[0][k]} * (1 - {u}) * (1 - {v}) + {q[1][k]} * (1 - {u}) * {v} + {q[2][k]} * {u} * {v} + {q[3][k]} * {u} * (1 - {v}))"
    place = x.quad_inverse(f"SELECT p_partkey, {f(0)} AS x, {f(1)} AS y FROM part", "x", "y", q)
    return f"SELECT p_partkey, {r('x')} AS x, {r('y')} AS y, {r('u')} AS u, {r('v')} AS v FROM ({place}) t"


register("fn_quads", "part", _quads)
