"""Queries that fill a regrid index from given tables and apply it to fields of many levels. Where values can lie just between two rounded ones, both sides add a little before rounding."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from isobar.functions import rings
from isobar.operators import regrid
from isobar.operators.globe import Globe
from isobar.operators.shared import folder

from .grids import CELLS, LAT, LON, event_cells, points, query, r, read

# Customers' places on the events' grid: within it, and on one that goes round also beyond its last column.
_PLACES = "pl AS (SELECT c_custkey AS di, c_nationkey AS dj, CAST((c_custkey * 37) % 1600 AS DOUBLE) / 100 AS x, CAST((c_custkey * 53) % 2300 AS DOUBLE) / 100 AS y FROM customer)"


def _places(spark, sf_dir):
    return read(spark, sf_dir, "customer").selectExpr("c_custkey AS di", "CAST(c_nationkey AS BIGINT) AS dj", "CAST((c_custkey * 37) % 1600 AS DOUBLE) / 100 AS x", "CAST((c_custkey * 53) % 2300 AS DOUBLE) / 100 AS y")


def _index(spark) -> regrid.RegridIndex:
    return regrid.RegridIndex(spark, f"{folder(spark)}/regrid-{uuid.uuid4().hex}")


_FOUR = "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(a, b)"
_WEIGHT = "(CASE WHEN d.a = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE WHEN d.b = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END)"


def _applied(column: str) -> str:
    return f"WITH {CELLS}, {_PLACES}, w AS (SELECT di, dj, CAST({column} AS BIGINT) AS i, CAST(floor(y) AS BIGINT) + d.b AS j, {_WEIGHT} AS w FROM pl, {_FOUR} WHERE {_WEIGHT} > 0), t AS (SELECT w.di, w.dj, c.k, sum(w.w * c.v) AS s, count(*) AS n FROM w JOIN cells c ON c.i = w.i AND c.j = w.j GROUP BY ALL) SELECT t.k, t.di, t.dj, round(CASE WHEN t.n = a.n THEN t.s END, 6) AS value FROM t JOIN (SELECT di, dj, count(*) AS n FROM w GROUP BY ALL) a ON a.di = t.di AND a.dj = t.dj"


@query("regrid_bilinear", _applied("(floor(x) + d.a) % 16"))
def regrid_bilinear(spark, sf_dir):
    """The events' field of every day at the customers' places, on a grid that goes round; the index is filled once and asked to be filled again."""
    index = _index(spark)
    for _ in range(2):
        index.fill("events", "customers", lambda: regrid.bilinear(_places(spark, sf_dir), globe=Globe(16, 24, 1)))
    return index.apply(event_cells(spark, sf_dir), "events", "customers", ["k"]).select("k", "di", "dj", r(F.col("value")).alias("value"))


@query("regrid_nearest", f"WITH {CELLS}, {_PLACES} SELECT c.k, di, dj, round(c.v, 6) AS value, round(2 * c.v, 6) AS twice FROM pl JOIN cells c ON c.i = round_even(x, 0) AND c.j = round_even(y, 0)")
def regrid_nearest(spark, sf_dir):
    """Two fields through one index."""
    index, c = _index(spark), event_cells(spark, sf_dir)
    index.fill("events", "customers", lambda: regrid.nearest(_places(spark, sf_dir)))
    both = [index.apply(c, "events", "customers", ["k"], value=v).withColumnRenamed("value", n) for v, n in ((F.col("v"), "value"), (2 * F.col("v"), "twice"))]
    return both[0].join(both[1], ["k", "di", "dj"]).select("k", "di", "dj", r(F.col("value")).alias("value"), r(F.col("twice")).alias("twice"))


def _sheared(u, v):
    """A point of a lattice that leans both ways."""
    return rings.point(u + v / 2, v - u / 4)


def _cell(u0, v0, u1, v1):
    return F.array(_sheared(u0, v0), _sheared(u1, v0), _sheared(u1, v1), _sheared(u0, v1))


_LEAN = f"s AS (SELECT s_suppkey AS si, s_acctbal AS v, {LON.format(k='s_suppkey')} AS u0, {LAT.format(k='s_suppkey')} AS v0, 4e0 + s_suppkey % 23 AS w, 3e0 + s_suppkey % 11 AS h FROM supplier), o AS (SELECT si, v, CAST(i AS BIGINT) AS di, CAST(j AS BIGINT) AS dj, greatest(0, least(u0 + w, 10 * i + 10) - greatest(u0, 10 * i)) * greatest(0, least(v0 + h, 10 * j + 10) - greatest(v0, 10 * j)) / (w * h) AS part FROM s, range(-18, 21) a(i), range(-9, 10) b(j))"


def _leaning(spark, sf_dir):
    """Parallelograms of the suppliers, and the parallelograms of a lattice over all of them, which are dealt from the suppliers' extent."""
    s = points(read(spark, sf_dir, "supplier"), "s_suppkey").withColumns({"w": F.lit(4.0) + F.col("s_suppkey") % 23, "h": F.lit(3.0) + F.col("s_suppkey") % 11})
    source = s.select(F.col("s_suppkey").alias("si"), F.lit(0).cast("long").alias("sj"), _cell(F.col("lon"), F.col("lat"), F.col("lon") + F.col("w"), F.col("lat") + F.col("h")).alias("ring"), F.col("s_acctbal").alias("v"))
    span = lambda c, d: F.explode(F.sequence(F.floor(F.col(c) / 10), F.floor((F.col(c) + F.col(d)) / 10)))
    cells = s.withColumn("di", span("lon", "w")).withColumn("dj", span("lat", "h")).select("di", "dj").distinct()
    return source, cells.withColumn("ring", _cell(F.col("di") * 10.0, F.col("dj") * 10.0, F.col("di") * 10.0 + 10, F.col("dj") * 10.0 + 10))


@query("mesh_weights", f"WITH {_LEAN} SELECT si, di, dj, round(part + 1e-10, 7) AS w FROM o WHERE part > 1e-9")
def mesh_weights(spark, sf_dir):
    """Parts of leaning cells in the cells of a leaning lattice."""
    return regrid.conservative(*_leaning(spark, sf_dir)).filter("w > 1e-9").select("si", "di", "dj", r(F.col("w") + 1e-10, 7).alias("w"))


@query("mesh_conservative", f"WITH {_LEAN} SELECT di, dj, round(sum(v * part) + 1e-7, 3) + 0 AS total, round(sum(v * part) / sum(part) + 1e-7, 3) + 0 AS mean FROM o WHERE part > 1e-9 GROUP BY di, dj")
def mesh_conservative(spark, sf_dir):
    """The suppliers' balances on the lattice, by an index of common areas: as sums and as means."""
    index, (source, lattice) = _index(spark), _leaning(spark, sf_dir)
    index.fill("suppliers", "lattice", lambda: regrid.conservative(source, lattice).filter("w > 1e-9"))
    field = source.select(F.col("si").alias("i"), F.col("sj").alias("j"), "v")
    total, mean = (index.apply(field, "suppliers", "lattice", [], how).withColumnRenamed("value", n) for how, n in (("sum", "total"), ("there", "mean")))
    return total.join(mean, ["di", "dj"]).select("di", "dj", r(F.col("total") + 1e-7, 3).alias("total"), r(F.col("mean") + 1e-7, 3).alias("mean"))


@query("mesh_conserved", "SELECT s_suppkey AS si, true AS whole FROM supplier")
def mesh_conserved(spark, sf_dir):
    """Whether the weights of each source cell sum to 1 within 1e-9, over triangles instead of the lattice's cells."""
    source, lattice = _leaning(spark, sf_dir)
    corners = [F.col("ring")[k] for k in range(4)]
    halves = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.array(*[corners[k] for k in c]).alias("ring")) for n, c in ((0, (0, 1, 2)), (1, (2, 3, 0)))]))
    triangles = lattice.withColumn("t", halves).select((2 * F.col("di") + F.col("t.n")).alias("di"), "dj", F.col("t.ring").alias("ring"))
    w = regrid.conservative(source, triangles).groupBy("si").agg(F.sum("w").alias("w"))
    return w.select("si", (F.abs(F.col("w") - 1) < 1e-9).alias("whole"))
