"""Halos and places of grids that go round, against plain index arithmetic."""

import pytest

from isobar.operators import gather
from isobar.operators.globe import Globe, halo, inside


def cell(i, j, ni, nj, wrap):
    """The cell that a place beyond the edges stands for, and whether it lies over a pole."""
    over = j < 0 or j > nj - 1
    if over:
        j, i = (-j if j < 0 else 2 * (nj - 1) - j), i + ni // 2
    return i % (ni - wrap + 1), j, over


@pytest.mark.parametrize("ni,nj,wrap,width", [(8, 5, 1, 1), (9, 5, 2, 2), (8, 6, 1, 3), (7, 4, 0, 2)])
def test_halo(spark, ni, nj, wrap, width):
    values = {(i, j): float(10 * i + j + 1) for i in range(ni) for j in range(nj)}
    cells = spark.createDataFrame([(i, j, v, v) for (i, j), v in values.items()], "i long, j long, v double, u double")
    got = {(r.i, r.j): (r.v, r.u) for r in halo(cells, Globe(ni, nj, wrap), width, turned=("u",)).collect()}
    turn = ni - wrap + 1
    if wrap == 0:
        assert got == {k: (v, v) for k, v in values.items()}
        return
    want = {}
    for i in range(-width, turn + width):
        for j in range(-width, nj + width):
            a, b, over = cell(i, j, ni, nj, wrap)
            want[i, j] = (values[a, b], -values[a, b] if over else values[a, b])
    assert got == want
    left = {(r.i, r.j) for r in inside(halo(cells, Globe(ni, nj, wrap), width), Globe(ni, nj, wrap)).collect()}
    assert left == {(i, j) for i in range(turn) for j in range(nj)}


def test_places_and_winds_beyond_a_pole(spark):
    cells = spark.createDataFrame([(1, i, j, float(i), float(j)) for i in range(8) for j in range(5)], "k long, i long, j long, u double, v double")
    points = spark.createDataFrame([(1, 1, 7.5, 2.0), (2, 1, -0.5, 2.0), (3, 1, 1.0, -0.5), (4, 1, 6.0, 4.25), (5, 1, None, 1.0), (6, 2, 1.0, 1.0), (7, 1, 15.0, 0.0)], "id long, k long, x double, y double")
    for turn, sign in ((False, 1), (True, -1)):
        got = {r.id: (r.u, r.v) for r in gather.wind(points, cells, ["k"], globe=Globe(8, 5, 1), turn=turn).collect()}
        assert got == {1: (3.5, 2.0), 2: (3.5, 2.0), 3: (5.0 * sign, 0.5 * sign), 4: (2.0 * sign, 3.75 * sign), 5: (None, None), 6: (None, None), 7: (7.0, 0.0)}
    assert gather.nearest(points, cells.withColumn("v", cells.u), ["k"], globe=Globe(8, 5, 1)).filter("id = 1").first().value == 0.0
