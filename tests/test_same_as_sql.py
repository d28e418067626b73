"""Queries on rows of which the small tables have none, against their SQL."""

import os
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from isobar.functions import rings
from isobar.operators import geometry
from isobar.plans import registry
from isobar.sources import polygons

from .test_queries import plain


def differences(spark, tmp_path, name, **tables):
    """Rows that only the query or only its SQL gives, on tables of the given columns: lists, or one value for all rows."""
    con = duckdb.connect()
    for table, columns in tables.items():
        n = max(len(v) for v in columns.values() if isinstance(v, list))
        rows = list(zip(*[v if isinstance(v, list) else [v] * n for v in columns.values()]))
        types = ["bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string" for v in rows[0]]
        spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(columns, types))).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    sql = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in sql.description].index(c) for c in columns]
    want = sorted(str([plain(r[k]) for k in at]) for r in sql.fetchall())
    assert want
    return [r for r in got if r not in want], [r for r in want if r not in got]


def test_the_meridian_of_180_degrees_has_one_name(spark, tmp_path):
    assert differences(spark, tmp_path, "fn_sphere", customer={"c_custkey": [72000, 36000, 1]}) == ([], [])


def test_vertices_beyond_the_pole_come_back(spark, tmp_path):
    """Heights of up to 92 degrees, and a ring of plain ones."""
    assert differences(spark, tmp_path, "ring_projected_back", supplier={"s_suppkey": [218, 299, 598, 1414, 7]}) == ([], [])


def test_shapes_whose_centroids_and_sides_lie_between_cells(spark, tmp_path):
    keys = list(range(600))
    assert differences(spark, tmp_path, "layer_cells", supplier={"s_suppkey": keys, "s_acctbal": [k * 7919 % 1000003 / 100 for k in keys]}) == ([], [])


def test_common_parts_of_many_cells_in_one_go():
    """All pairs by arrays, and null or empty rings, which have no part."""
    rings = [[(k % 7 + 0.0, 0.0), (k % 7 + 4.0, 1.0), (k % 7 + 4.0, 5.0), (k % 7 + 0.0, 4.0)] for k in range(20000)]
    arrow = lambda rs: pa.array([r and [{"x": x, "y": y} for x, y in r] for r in rs], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    cut = [[(2.0, 0.0), (2.0, 9.0), (5.0, 9.0), (5.0, 0.0)]] * len(rings)
    got = geometry.convex_areas(arrow(rings), arrow(cut))
    assert got.tolist() == [4.0 * max(0, min(k % 7 + 4, 5) - max(k % 7, 2)) for k in range(len(rings))]
    assert geometry.convex_areas(arrow([None, [], cut[0], cut[0]]), arrow([cut[0], cut[0], None, rings[0]])).tolist() == [0.0, 0.0, 0.0, 8.0]


def test_a_ring_is_made_once(spark):
    """The plan of an area names the ring it is taken of once, not once for each vertex to be looked up."""
    ring = rings.clip_convex(F.col("r"), F.col("b"))
    plan = spark.range(1).select(rings.rectangle(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(2.0)).alias("r"), rings.rectangle(F.lit(1.0), F.lit(1.0), F.lit(9.0), F.lit(9.0)).alias("b"))
    assert plan.select(rings.area(ring).alias("a")).first().a == 3.0
    once, area = (str(spark.range(1).select(F.lit(None).cast("array<struct<x: double, y: double>>").alias("r"), F.lit(None).cast("array<struct<x: double, y: double>>").alias("b")).select(c.alias("c"))._jdf.queryExecution().analyzed()) for c in (ring, rings.area(ring)))
    assert area.count("aggregate(") <= once.count("aggregate(") + 1


def test_a_ring_to_be_split_is_unwrapped_once(spark):
    df = spark.range(1).select(rings.rectangle(F.lit(179.0), F.lit(0.0), F.lit(182.0), F.lit(2.0)).alias("r"))
    got = df.select(rings.wrap_split(rings.wrap(F.col("r"), -180.0, 180.0), -180.0, 180.0).alias("parts")).select(F.transform("parts", rings.area).alias("a"))
    assert sorted(got.first().a) == [2.0, 4.0]
    plan = str(spark.range(1).select(F.lit(None).cast("array<struct<x: double, y: double>>").alias("r")).select(rings.wrap_split(F.col("r"), -180.0, 180.0).alias("c"))._jdf.queryExecution().analyzed())
    assert plan.count("aggregate(") == 2  # the one that unwraps, and the one of the areas


def test_points_in_rings_that_cross_themselves(spark):
    """Bands of two edges and of more, at heights of vertices too."""
    rng = random.Random(5)
    ring = lambda n: [(rng.randint(-8, 8) / 2, rng.randint(-8, 8) / 2) for _ in range(n)]
    shapes = spark.createDataFrame([(k, ring(3 + k % 7)) for k in range(40)], f"sid long, ring {geometry.RING}")
    points = spark.createDataFrame([(k, rng.randint(-9, 9) / 2, rng.randint(-9, 9) / 2) for k in range(300)], "id long, x double, y double")
    want = points.crossJoin(shapes).filter(rings.contains_point(F.col("ring"), F.col("x"), F.col("y"))).select("id", "sid").collect()
    got = geometry.holders(points, shapes).select("id", "sid").collect()
    assert len(want) > 500 and sorted(got) == sorted(want)


def test_rings_of_all_sizes_that_cross(spark):
    rng = random.Random(6)
    ring = lambda n, x, y, w: [(x + w * rng.randint(-4, 4), y + w * rng.randint(-4, 4)) for _ in range(n)]
    shapes = spark.createDataFrame([(k * 37 % 101, ring(3 + k % 5, rng.randint(-9, 9), rng.randint(-9, 9), (1.0, 0.25, 4.0)[k % 3])) for k in range(101)], f"sid long, ring {geometry.RING}")
    o = shapes.select(F.col("sid").alias("other"), F.col("ring").alias("ring2"))
    want = shapes.crossJoin(o).filter((F.col("sid") < F.col("other")) & rings.crosses(F.col("ring"), F.col("ring2"))).select("sid", "other").collect()
    got = geometry.crossings(shapes, "sid").collect()
    assert len(want) > 100 and sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)


def test_polygon_files_are_as_spark_would_find_them(spark, tmp_path):
    """Written without Spark's own text files, but in the same folders: more files of an id, other modes, and ids and file names as Spark gives them."""
    path, one = f"{tmp_path}/some polygons", "1\n3\n0\n0.0 0.0\n1.0 0.0\n0.0 1.0"
    texts = lambda *rows: spark.createDataFrame(rows, "id long, text string").repartition(3)
    polygons.write_texts(texts((1, one), (-2, one), (3, "1 3 0"), (4, None)), path)
    assert not os.path.exists(f"{path}/_temporary") and os.path.exists(f"{path}/_SUCCESS")
    with pytest.raises(AnalysisException):
        polygons.write_texts(texts((1, one)), path)
    polygons.write_texts(texts((1, one), (2**40, one)), path, "append")
    want = spark.read.text(path, wholetext=True).selectExpr("id", "_metadata.file_path AS file")
    got = polygons.read(spark, path)
    assert got.schema["id"] == want.schema["id"] and sorted(got.select("id", "file").collect()) == sorted(want.collect())
    assert sorted((r.id, r.error is None) for r in got.collect()) == [(-2, True), (1, True), (1, True), (3, False), (4, False), (2**40, True)]
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    polygons.write_texts(texts((7, one)), path, "overwrite")
    assert [r.id for r in polygons.read(spark, path).collect()] == [7]
    polygons.write_texts(spark.createDataFrame([("a b", one)], "id string, text string"), f"{tmp_path}/named")
    assert [(r.id, r.error) for r in polygons.read(spark, f"{tmp_path}/named").collect()] == [("a b", None)]
