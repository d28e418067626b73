"""Grids that go round: places beyond an end are those at the other, and places beyond a pole lie on the opposite meridian.

A ``Globe`` states a grid's numbers of columns and rows and its wrap (gridref.wrap_kind): 0 for a grid with ends, 1 if the axis goes round, 2 if its last column repeats the first.
``Globe.place`` brings a place to the grid, ``halo`` gives a grid's cells again beyond its ends and poles, so that one square or stencil joins both ends;
both are expressions and one explode of the few columns and rows at the edges, without a join.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Globe(NamedTuple):
    """Columns, rows and wrap of a grid, as numbers or as names of columns of both points and cells."""

    ni: str | int
    nj: str | int
    wrap: str | int

    def columns(self) -> tuple[Column, Column, Column, Column]:
        """Rows, wrap, the number of columns that the axis takes to go round, and half the grid's columns."""
        ni, nj, wrap = (F.col(c) if isinstance(c, str) else F.lit(c) for c in self)
        return nj, wrap, ni - wrap + 1, F.floor(ni / 2)

    def over(self, y: Column) -> Column:
        """Whether a row of a grid that goes round lies beyond a pole."""
        nj, wrap, _, _ = self.columns()
        return (wrap > 0) & ((y < 0) | (y > nj - 1))

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The place on the grid of one up to a turn beyond its ends and up to half a turn beyond its poles; null stays null, and grids with ends are left as they are."""
        nj, wrap, turn, half = self.columns()
        top = (nj - 1).cast("double")
        row = F.when(y < 0, -y).when(y > top, 2 * top - y).otherwise(y)
        col = F.pmod(F.when(self.over(y), x + half).otherwise(x), turn.cast("double"))
        return F.when(wrap > 0, col).otherwise(x), F.when(wrap > 0, row).otherwise(y)


def halo(cells: DataFrame, globe: Globe, width: int = 1, turned: tuple[str, ...] = ()) -> DataFrame:
    """cells (i, j and others) and, of grids that go round, copies of those within width of an edge: beyond both ends of their row, and beyond the poles half a turn away, where the columns ``turned`` (a vector's components) change their sign.

    The column that repeats the first is left out before and made anew, so a grid's two kinds of axis give the same; a grid's poles are its first and last rows, which aren't copied themselves."""
    nj, wrap, turn, half = globe.columns()
    whole = cells.filter((wrap == 0) | (F.col("i") < turn))
    i, j = F.col("i"), F.col("j")
    rows = [(j, i, F.lit(False), F.lit(True)), (-j, F.pmod(i + half, turn), F.lit(True), (j > 0) & (j <= width)), (2 * (nj - 1) - j, F.pmod(i + half, turn), F.lit(True), (j < nj - 1) & (j >= nj - 1 - width))]
    near = []
    for row, col, over, there in rows:
        near.append(F.when(there & ((wrap > 0) | ~over), F.struct(col.cast("long").alias("i"), row.cast("long").alias("j"), over.alias("over"))))
        near.append(F.when(there & (wrap > 0) & (col < width), F.struct((col + turn).cast("long").alias("i"), row.cast("long").alias("j"), over.alias("over"))))
        near.append(F.when(there & (wrap > 0) & (col >= turn - width), F.struct((col - turn).cast("long").alias("i"), row.cast("long").alias("j"), over.alias("over"))))
    places = F.filter(F.array(*near), lambda p: p.isNotNull())
    out = whole.withColumn("_place", F.explode(places))
    out = out.withColumns({c: F.when(F.col("_place.over"), -F.col(c)).otherwise(F.col(c)) for c in turned})
    return out.withColumns({"i": F.col("_place.i"), "j": F.col("_place.j")}).drop("_place")


def inside(cells: DataFrame, globe: Globe) -> DataFrame:
    """Without the cells of a halo: what is left of a stencil's result over one."""
    nj, wrap, turn, _ = globe.columns()
    return cells.filter((wrap == 0) | ((F.col("i") >= 0) & (F.col("i") < turn) & (F.col("j") >= 0) & (F.col("j") < nj)))
