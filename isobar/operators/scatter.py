"""Scatter aggregation: source values onto destination cells, and vector fields and classes.

All modes are one hash aggregation on the cell with map-side partial sums, so a cell that gets a third of all rows costs one partial row a task.
Multi-pass work (``partial``/``merge``/``finish``) keeps the sums as a table, so that passes over later inputs only add to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = {
    "maximum": lambda v: F.max(v), "minimum": lambda v: F.min(v), "sum": lambda v: F.sum(v), "average": lambda v: F.avg(v), "count": lambda v: F.count(v), "square": lambda v: F.avg(v * v),
    "circular": lambda v: F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(v))), F.avg(F.cos(F.radians(v))))), F.lit(360.0)),
}


def scatter(df: DataFrame, cell: list[str], value: str, modes: list[str], digits: int | None = None) -> DataFrame:
    """One row a cell with a column for each mode; missing values (null) don't count."""
    out = [MODES[m](F.col(value)) for m in modes]
    return df.groupBy(*cell).agg(*[(F.round(c, digits) + 0.0 if digits is not None and m != "count" else c).alias(m) for m, c in zip(modes, out)])


def variance(df: DataFrame, means: DataFrame, cell: list[str], value: str, mean: str = "mean") -> DataFrame:
    """Mean squared distance of each cell's values from a supplied mean: their variance and the distance of their own mean from it, which don't cancel where values are large; only one row a cell meets its mean."""
    s = df.groupBy(*cell).agg(F.var_pop(value).alias("_v"), F.avg(value).alias("_m"))
    far = F.col("_m") - F.col(mean)
    return s.join(means.select(*cell, mean), cell).withColumn("variance", F.col("_v") + far * far).drop("_v", "_m")


def class_columns(klass: str, classes: list[str], normalise: bool | str = False) -> list[Column]:
    """Aggregates of the rows of each class; as shares of all rows (``all``), or of those in a class (``matched``)."""
    total = F.count(F.lit(1)) if normalise == "all" else F.count_if(F.col(klass).isin(classes))
    hit = [F.count_if(F.col(klass) == c) for c in classes]
    return [(h / F.nullif(total, F.lit(0)) if normalise else h).alias(f"class_{c}") for c, h in zip(classes, hit)]


def class_counts(df: DataFrame, cell: list[str], klass: str, classes: list[str], normalise: bool | str = False) -> DataFrame:
    """class_columns of each cell."""
    return df.groupBy(*cell).agg(*class_columns(klass, classes, normalise))


def lookup_counts(df: DataFrame, cell: list[str], value: str, lut: DataFrame) -> DataFrame:
    """Weighted counts a cell and class: lut has (code, class, weight). Rows are summed by code first, so the table meets one row a cell and code."""
    codes = df.groupBy(*cell, F.col(value).alias("code")).agg(F.count("*").alias("n"))
    return codes.join(lut, "code").groupBy(*cell, "class").agg(F.sum(F.col("n") * F.col("weight")).alias("weighted"), F.sum("n").alias("n"))


def partial(df: DataFrame, cell: list[str], value: str) -> DataFrame:
    """The sums of a pass."""
    v = F.col(value)
    return df.groupBy(*cell).agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def merge(*passes: DataFrame) -> DataFrame:
    """Passes added up."""
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    cell = [c for c in every.columns if c not in ("s", "q", "n", "lo", "hi")]
    return every.groupBy(*cell).agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def finish(sums: DataFrame) -> DataFrame:
    """Average, mean square, range and count from sums."""
    n = F.nullif(F.col("n"), F.lit(0))
    return sums.withColumns({"average": F.col("s") / n, "square": F.col("q") / n}).drop("s", "q")


def combine(previous: Column, new: Column, how: str, count: Column | None = None) -> Column:
    """A cell's new value: replace, min, max, sum or (with the values so far) average; a missing previous value doesn't count."""
    old = F.coalesce(previous, new)
    return {"replace": new, "min": F.least(old, new), "max": F.greatest(old, new), "sum": F.coalesce(previous, F.lit(0.0)) + new, "average": (F.coalesce(previous, F.lit(0.0)) * count + new) / (count + 1) if count is not None else new}[how]


def paste(base: DataFrame, patch: DataFrame, x0: int, y0: int, alpha: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """base cells (i, j, v) overlaid by patch cells of the same keys, shifted to (x0, y0); with an alpha column, blended."""
    keys = keys or []
    p = patch.select(*keys, (F.col("i") + x0).alias("i"), (F.col("j") + y0).alias("j"), F.col("v").alias("_v"), (F.col(alpha) if alpha else F.lit(1.0)).alias("_a"))
    j = base.join(p, [*keys, "i", "j"], "left")
    return j.withColumn("v", F.when(F.col("_v").isNull(), F.col("v")).otherwise(F.col("_v") * F.col("_a") + F.col("v") * (1 - F.col("_a")))).drop("_v", "_a")
