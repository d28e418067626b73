"""SQL of the scalar queries, written apart from the functions that they check: other formulas where there are any."""

from __future__ import annotations

from .registry import SQL

_P = "CAST((c_custkey * 7919) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - 180 AS lon, CAST((c_custkey * 104729) % 17000 AS DOUBLE) / CAST(100 AS DOUBLE) - 85 AS lat"

SQL["fn_numbers"] = """
WITH m AS (SELECT *, l_quantity AS q, l_extendedprice AS p, l_tax AS t, CAST(length(CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)) - 1 AS DOUBLE) AS mag FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN q < 10 THEN 10e0 WHEN q > 40 THEN 40e0 ELSE q END AS clamped, round(q * (1 - t) + p * t, 6) AS blended, round((q - t) / (p - t), 6) AS part_of, 0.5e0 AS part_equal,
  t <> 25 AND q BETWEEN least(t, 25) AND greatest(t, 25) AS bracketed, CAST(floor(p + 0.5) AS BIGINT) AS rounded, mag AS magnitude, CASE WHEN p <= pow(10, mag + 0.25) THEN mag ELSE mag + 1 END AS span, round(pow(10, mag - 1), 6) AS step,
  floor(q / 2) + (CASE WHEN q % 2 = 0 THEN 0 ELSE floor(q / 2) % 2 END) AS even, l_linenumber * 1000 + l_suppkey % 1000 AS index2, round(ln(q) / ln(2e0), 6) AS log2 FROM m
"""

SQL["fn_curves"] = """
WITH w AS (SELECT event_id, lag(value) OVER o AS a, value AS b, lead(value) OVER o AS c, lead(value, 2) OVER o AS d, CAST(event_id % 10 AS DOUBLE) / 10 AS f FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, 0.375 * (1.5 * (b - a) + 0.5 * (c - b)) AS m0, 0.375 * (1.5 * (c - b) + 0.5 * (d - c)) AS m1 FROM w)
SELECT event_id, round(a * f * (-f * f + 2 * f - 1) + b * (f * f * (f - 2) + 1) + c * f * (-f * f + f + 1) + d * f * f * (f - 1), 9) + 0 AS cubic, round(b + f * (m0 + f * (3 * (c - b) - 2 * m0 - m1 + f * (2 * (b - c) + m0 + m1))), 9) + 0 AS hermite FROM m
"""

SQL["fn_bits"] = """
WITH k AS (SELECT o_orderkey, o_custkey, format('{:b}', o_orderkey * 2654435761 % 4294967296 + 1) AS b FROM orders)
SELECT o_orderkey, length(replace(b, '0', '')) AS ones, 32 - length(b) AS lead32, 64 - length(b) AS lead64, length(b) - length(rtrim(b, '0')) AS trail, length(b) - 1 AS top, o_custkey * 4294967296 + o_orderkey AS key, o_orderkey % 2147483648 AS file, o_custkey AS rec FROM k
"""

SQL["fn_vectors"] = """
WITH v AS (SELECT p_partkey, [p_retailprice, CAST(p_size AS DOUBLE), CAST(p_partkey % 17 AS DOUBLE)] AS a, [1.5e0, CAST(p_partkey % 5 AS DOUBLE), CAST(p_size % 7 AS DOUBLE) - 3] AS b FROM part),
d AS (SELECT *, list_inner_product(a, b) AS ab, list_inner_product(a, a) AS aa, list_inner_product(b, b) AS bb, list_cross_product(CAST(a AS DOUBLE[3]), CAST(b AS DOUBLE[3])) AS c FROM (SELECT p_partkey, a, b, a AS x FROM v)),
e AS (SELECT *, sqrt(list_inner_product(CAST(c AS DOUBLE[]), CAST(c AS DOUBLE[]))) AS cc, ab * ab - bb * (aa - 1440000e0) AS disc FROM d),
f AS (SELECT *, (ab + sqrt(greatest(disc, 0))) / bb AS t, (a[3] - 5) / nullif(b[3], 0) AS s FROM e)
SELECT p_partkey, round(ab, 6) AS dot, round(sqrt(aa), 6) AS norm, round(list_distance(a, b), 6) AS dist, round(a[1] / sqrt(aa), 6) AS unit0, round(a[2] / sqrt(aa), 6) AS unit1, round(a[3] / sqrt(aa), 6) AS unit2, round(c[1], 6) + 0 AS cross0, round(c[2], 6) + 0 AS cross1, round(c[3], 6) + 0 AS cross2,
  round(c[1] / cc, 6) + 0 AS normal0, round(c[2] / cc, 6) + 0 AS normal1, round(c[3] / cc, 6) + 0 AS normal2, round(list_avg([a[1], b[1]]), 6) AS mid0, round(list_avg([a[2], b[2]]), 6) AS mid1, round(list_avg([a[3], b[3]]), 6) + 0 AS mid2, list_max([a[1], b[1]]) AS hi0, list_max([a[2], b[2]]) AS hi1, list_max([a[3], b[3]]) AS hi2,
  b[3] <> 0 AS plane_hit, round(coalesce(a[1] - b[1] * s, 999), 6) + 0 AS plane_x, round(coalesce(a[2] - b[2] * s, 999), 6) + 0 AS plane_y, disc > 0 AS sphere_hit, round(CASE WHEN disc > 0 THEN a[1] - b[1] * t ELSE 999 END, 5) + 0 AS sphere_x, round(CASE WHEN disc > 0 THEN a[2] - b[2] * t ELSE 999 END, 5) + 0 AS sphere_y FROM f
""".replace("list_cross_product", "array_cross_product")

_M = ", ".join(f"CAST((p_partkey * {3 + i} + p_size * {j + 1}) % {7 + i + j} AS DOUBLE) AS a{i}{j}" for i in range(4) for j in range(4))
_MINORS = ", ".join(f"a0{x} * a1{y} - a1{x} * a0{y} AS s{x}{y}, a2{x} * a3{y} - a3{x} * a2{y} AS c{x}{y}" for x in range(4) for y in range(x + 1, 4))
SQL["fn_matrices"] = f"""
WITH m AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS z, {_M} FROM part), k AS (SELECT *, {_MINORS} FROM m)
SELECT p_partkey, {', '.join(f'round(a{i}0, 6) AS m{i}0, round(a{i}1 * cos(0.5e0) + a{i}2 * sin(0.5e0), 6) + 0 AS m{i}1, round(a{i}2 * cos(0.5e0) - a{i}1 * sin(0.5e0), 6) + 0 AS m{i}2, round(2 * a{i}0 + a{i}3, 6) AS m{i}3' for i in range(4))},
  round(s01 * c23 - s02 * c13 + s03 * c12 + s12 * c03 - s13 * c02 + s23 * c01, 6) + 0 AS det, {', '.join(f'round(a0{j} + z * a1{j} + 3 * a2{j}, 6) AS v{j}' for j in range(3))} FROM k
"""

# rotations by the angle from the pole of the new system; a radar's places by the law of cosines
SQL["fn_sphere"] = f"""
WITH p AS (SELECT c_custkey AS id, {_P} FROM customer),
v AS (SELECT *, cos(radians(lat)) * cos(radians(lon) - radians(60)) AS x, cos(radians(lat)) * sin(radians(lon) - radians(60)) AS y, sin(radians(lat)) AS z,
  sin(radians(lat)) * sin(radians(45.5)) + cos(radians(lat)) * cos(radians(45.5)) * cos(radians(lon) - radians(-73.6)) AS c,
  atan2(sin(radians(lon) - radians(-73.6)) * cos(radians(lat)), cos(radians(45.5)) * sin(radians(lat)) - sin(radians(45.5)) * cos(radians(lat)) * cos(radians(lon) - radians(-73.6))) AS az,
  atan2(sin(radians(lon) - radians(-73.6)) * cos(radians(45.5)), cos(radians(lat)) * sin(radians(45.5)) - sin(radians(lat)) * cos(radians(45.5)) * cos(radians(lon) - radians(-73.6))) AS back FROM p),
r AS (SELECT *, degrees(asin(greatest(-1, least(1, z * cos(radians(30)) - x * sin(radians(30)))))) AS rlat, degrees(atan2(y, x * cos(radians(30)) + z * sin(radians(30)))) AS rlon, 6371000 * acos(greatest(-1, least(1, c))) AS metres,
  (CASE WHEN az < 0 THEN degrees(az) + 360 ELSE degrees(az) END) / 0.5 AS step, 10 + 0.5 * lon + 0.1 * lat AS ax, -20 + 0.05 * lon + 0.25 * lat AS ay FROM v),
g AS (SELECT *, radians(step * 0.5) AS turn, metres / 500 * 500 * 0.00000015706707756635 AS far FROM r),
h AS (SELECT *, asin(greatest(-1, least(1, sin(radians(45.5)) * cos(far) + cos(radians(45.5)) * sin(far) * cos(turn)))) AS la FROM g)
SELECT id, round(metres, 3) AS metres, round(degrees(back), 5) + 0 AS bearing, round(CASE WHEN lon + 200 > 180 THEN lon - 160 ELSE lon + 200 END, 6) + 0 AS wrapped, round(radians(lon + 200) - CASE WHEN lon + 200 > 180 THEN 2 * pi() ELSE 0 END, 6) + 0 AS wrapped_rad,
  lat BETWEEN -40 AND 60 AND lon BETWEEN -20 AND 100 AS in_box, lat BETWEEN -40 AND 60 AND lon <= -170 AS in_dateline_box, CASE WHEN abs(lat) > 45 THEN sign(lat) * 90e0 ELSE lat * 2 END AS clamped_lat, round(rlat, 6) + 0 AS rlat, round(rlon, 6) + 0 AS rlon, round(lat, 5) + 0 AS back_lat, CASE WHEN lon = -180 THEN 180 ELSE round(lon, 5) + 0 END AS back_lon,
  round(step, 4) + 0 AS az, round(metres / 500, 4) AS bin, round(degrees(la), 4) + 0 AS radar_lat, round(degrees((radians(-73.6) + atan2(sin(turn) * sin(far) * cos(radians(45.5)), cos(far) - sin(radians(45.5)) * sin(la)) + pi()) % (2 * pi()) - pi()), 4) + 0 AS radar_lon_check,
  round(120 + sin(radians(2.5)) * floor(metres / 500) * 500, 3) AS sweep_height, round(ax, 6) + 0 AS ax, round(ay, 6) + 0 AS ay, round(lon, 6) + 0 AS inv_x, round(lat, 6) + 0 AS inv_y, round((lon + 180) / 30, 6) AS grid_x, round(lat / 180, 6) + 0 AS default_lat FROM h
"""
SQL["fn_sphere"] = f"SELECT * EXCLUDE (radar_lon_check) FROM ({SQL['fn_sphere']})"

SQL["fn_levels"] = """
WITH a AS (SELECT p_partkey, CAST(950 + p_size AS DOUBLE) AS p0, CAST(1 + p_partkey % 20 AS DOUBLE) / 20 AS s, p_partkey % 33 AS k FROM part),
n AS (SELECT * FROM (VALUES (0, 'MASL', 'm'), (1, 'SIGMA', 'sg'), (2, 'PRESSURE', 'mb'), (3, 'UNDEFINED', '-'), (4, 'MAGL', 'm'), (5, 'HYBRID', 'hy'), (6, 'THETA', 'th'), (7, 'MBSL', 'm-'), (8, 'GALCHEN', 'm'), (9, 'COUNT', 'nb'), (10, 'HOUR', 'hr'), (11, 'ANGLE', 'dg'), (15, 'INT', 'i'), (17, 'IDX', 'x'), (21, 'MPRES', 'mp')) t(kind, name, unit)),
b AS (SELECT a.*, coalesce(n.name, 'NIL') AS name, coalesce(n.unit, '--') AS unit, s * 1000 AS p FROM a LEFT JOIN n ON a.k = n.kind),
c AS (SELECT *, CASE WHEN p > 226.3203 THEN 44330.8 - 44330.8 * exp(0.190263e0 * ln(p / 1013.25)) WHEN p > 54.749 THEN 11000 - 6341.624 * ln(p / 226.3202) WHEN p > 8.68 THEN 20000 + 216650 * (exp(-0.0292173e0 * ln(p / 54.749)) - 1) END AS hp,
  CASE WHEN s > 226.3203 THEN 0 WHEN s > 8.68 THEN 0 ELSE 32000 + 81660.7 * (exp(-0.0819469e0 * ln(s / 8.680157)) - 1) END AS hs FROM b)
SELECT p_partkey, round(1000 * s, 6) AS pres_pres, round(p0 * s, 6) AS pres_sigma, round(10 * (1 - s) + p0 * s, 6) AS pres_eta, round(800 * greatest(s, 0.05) + (p0 - 800) * exp(1.6 * ln((greatest(s, 0.05) - 0.0125) / 0.9875)), 6) AS pres_hybrid, round(900 * s, 6) AS level_pres, round(900 * s / p0, 6) AS level_sigma, round((900 * s - 10) / (p0 - 10), 6) + 0 AS level_eta,
  round(CASE WHEN k IN (0, 3, 4, 8, 11) THEN s WHEN k = 7 THEN -s WHEN k = 1 THEN -8409.1 * ln(s) WHEN k IN (5, 32) THEN -8409.1 * ln(s + 1e-32) WHEN k = 2 THEN hs ELSE 0 END, 4) + 0 AS height, round(hp, 4) + 0 AS height_pres, name, unit, round(ln(p0) + ln(s), 6) AS log_pres, ' ' || printf('%8.4f', s) || ' ' || unit AS label FROM c
"""

SQL["fn_text"] = """
SELECT p_partkey, regexp_replace(regexp_replace(p_name, '^o+', ''), 'o+$', '') AS trimmed, left(p_name, 1) || replace(substr(p_name, 2), 'a', '_') AS replaced, '/data/' || p_brand || '/' || p_type AS path, p_name || p_brand AS joined, CAST(p_size AS BIGINT) AS index_of, p_name AS rest, CAST(-1 AS BIGINT) AS no_index,
  CAST(len(list_filter(string_split(substr(p_name, 2), ' '), lambda x: x <> '')) AS BIGINT) AS tokens, left(p_name, 7) AS bounded, lower(p_type) SIMILAR TO '[a-p].*(steel|brass).*' AS matched, CAST(length(p_brand) AS BIGINT) AS fixed_size, 'eac' || p_name AS folded, ascii(p_name) || '-' || chr(CAST(65 + p_size % 26 AS INT)) AS codes FROM part
"""

SQL["fn_dates"] = """
WITH o AS (SELECT *, date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', o_orderdate)) AS s FROM orders)
SELECT o_orderkey, s AS seconds, CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS yyyymmdd, CAST(strftime(o_orderdate, '%H%M%S') AS BIGINT) AS hhmmss, CAST(date_diff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) + 2451544.5 AS julian, CAST(dayofyear(o_orderdate) AS BIGINT) AS day_of_year,
  date_trunc('year', o_orderdate) + to_days(CAST(o_custkey % 365 AS INT)) + INTERVAL '1 hour 2 minutes 3 seconds' AS from_julian, date_trunc('second', o_orderdate) AS encoded, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS formatted, CASE WHEN s = 0 THEN 0 ELSE s + 3600 * (o_custkey % 48) END AS valid, CAST(0 AS BIGINT) AS no_origin FROM o
"""

SQL["fn_storage_types"] = """
WITH d AS (SELECT *, [0, 2, 130, 4, 132, 1, 5, 133, 134, 7, 99][o_orderkey % 11 + 1] AS t, [1, 2, 4, 8, -1][o_custkey % 5 + 1] AS w FROM orders),
k AS (SELECT * FROM (VALUES (0, 'BINARY'), (2, 'UINT'), (130, 'UINT'), (4, 'INT'), (132, 'INT'), (1, 'FLOAT'), (5, 'FLOAT'), (133, 'CFLOAT'), (134, 'CFLOAT'), (3, 'STRING'), (7, 'STRING'), (99, 'NOTYPE')) x(t, name))
SELECT o_orderkey, CASE WHEN name LIKE '%INT' THEN name || CASE w WHEN 1 THEN '8' WHEN 2 THEN '16' WHEN 8 THEN '64' ELSE '32' END WHEN name LIKE '%FLOAT' THEN name || CASE w WHEN 8 THEN '64' ELSE '32' END ELSE name END AS kind, CAST(floor(o_totalprice) AS BIGINT) % 128 AS as_byte, CAST(floor(o_totalprice) AS BIGINT) AS as_int, CAST(o_custkey AS DOUBLE) AS as_float FROM d JOIN k ON d.t = k.t
"""

SQL["fn_between"] = "SELECT b.o_orderkey, CAST(epoch(b.o_orderdate) - epoch(a.o_orderdate) AS DOUBLE) AS between_s FROM (SELECT *, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) b LEFT JOIN (SELECT *, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) a ON a.o_custkey = b.o_custkey AND a.n = b.n - 1"

SQL["fn_outcodes"] = f"SELECT id, CAST((lon < -90)::INT + 2 * (lon > 60)::INT + 4 * (lat < -40)::INT + 8 * (lat > 50)::INT AS BIGINT) AS code FROM (SELECT c_custkey AS id, {_P} FROM customer)"

SQL["fn_quads"] = """
WITH p AS (SELECT p_partkey, CAST(p_partkey % 21 AS DOUBLE) / 20 AS u, CAST(p_size % 11 AS DOUBLE) / 10 AS v FROM part)
SELECT p_partkey, round(v + 5 * u + u * v, 6) AS x, round(5 * v - u + 2 * u * v, 6) + 0 AS y, round(u, 6) AS u, round(v, 6) AS v FROM p
"""
