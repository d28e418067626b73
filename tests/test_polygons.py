"""Polygon text files: laid out by hand, broken in several ways, and written and read again."""

import pytest
from pyspark.sql import functions as F

from isobar.sources import polygons

KIND = "array<struct<hole: boolean, pts: array<struct<x: double, y: double>>>>"


@pytest.mark.parametrize("text, want", [
    ("1\n3\n0\n 0.0 0.0\n 1.5 -0.0\n 1e-3 2\n", [(False, [(0.0, 0.0), (1.5, -0.0), (0.001, 2.0)])]),
    ("2 3 0 0 0 1 0 0 1 3 1 5 5 6 5 5 6", [(False, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]), (True, [(5.0, 5.0), (6.0, 5.0), (5.0, 6.0)])]),
    ("1 0 0", [(False, [])]), ("0\n", []),
    ("", "no number of contours"), ("x", "no number of contours"), ("-1", "no number of contours"), (None, "no number of contours"),
    ("1 3 0 0 0 1 0 0", "cut off, or not a number"), ("1 3 2 0 0 1 0 0 1", "cut off, or not a number"), ("1 3 0 0 0 1 a 0 1", "cut off, or not a number"), ("2 3 0 0 0 1 0 0 1", "cut off, or not a number"), ("1 999999999 0 0 0", "cut off, or not a number"), ("999999999 3 0 0 0 1 0 0 1", "cut off, or not a number"), ("1 -3 0 0 0", "cut off, or not a number"),
    ("1 3 0 0 0 1 0 0 1 7", "more than its contours"), ("0 1", "more than its contours"),
])
def test_texts(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(polygons.from_text(F.col("t")).alias("r")).first().r
    if isinstance(want, str):
        assert r.polygon is None and r.error == want
    else:
        assert r.error is None and [(c.hole, [tuple(p) for p in c.pts]) for c in r.polygon] == want


def test_round_trip(spark, tmp_path):
    rows = [(1, [(False, [(0.1, 1e300), (1 / 3, -2.5), (5e-324, 0.0)]), (True, [(1.0, 2.0)])]), (2, []), (3, None), (4, [(False, [])])]
    df = spark.createDataFrame(rows, f"id int, polygon {KIND}").repartition(2)
    polygons.write(df, f"{tmp_path}/out")
    got = {r.id: r for r in polygons.read(spark, f"{tmp_path}/out").collect()}
    plain = lambda p: [(c.hole, [tuple(v) for v in c.pts]) for c in p]
    assert {k: plain(r.polygon) for k, r in got.items()} == {1: rows[0][1], 2: [], 3: [], 4: rows[3][1]} and all(r.error is None for r in got.values())
    polygons.write(df.filter("id = 1"), f"{tmp_path}/plain", flags=False)
    assert [c.hole for c in polygons.read(spark, f"{tmp_path}/plain", flags=False).first().polygon] == [False, False]
