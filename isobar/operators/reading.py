"""Fields at any time in one plan: the records of the two times around it are found among headers, read, stitched from tiles, masked, multiplied and blended.

Headers come first (``bf`` with data false): of each request and each level of its variable the last record time at or before it and the first at or after it are one conditional aggregation of distinct times; then only the records of those times
are read (``bf.fetched``), tiles and masks of both times among them. The cells of all of them meet in one aggregation by request, level and cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.sources import bf

KEYS = ["nomvar", "etiket", "ip1"]


def bracketed(headers: DataFrame, requests: DataFrame, time: str = "dateo") -> DataFrame:
    """requests (id, nomvar, at) with etiket, ip1, t0, t1 and f, the share of the later record; a time between whose ends no records lie, or before the first or after the last, has none."""
    times = headers.filter("rtrim(typvar) <> '@@'").select(*KEYS, F.col(time).alias("t")).distinct()
    j = requests.join(times, "nomvar")
    b = j.groupBy("id", "at", *KEYS).agg(F.max(F.when(F.col("t") <= F.col("at"), F.col("t"))).alias("t0"), F.min(F.when(F.col("t") >= F.col("at"), F.col("t"))).alias("t1"))
    f = F.when(F.col("t1") > F.col("t0"), (F.col("at") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(F.lit(0.0))
    return b.filter("t0 IS NOT NULL AND t1 IS NOT NULL").withColumn("f", f)


def record_cells(records: DataFrame, keys: list[str], tile: tuple[int, int, int] | None = None) -> DataFrame:
    """keys, i, j, v of the cells of records with data. Of tiles (grtyp ``#``, whose origin from 1 is in ig3 and ig4), cut by tile (ni, nj, columns of the whole grid) and with halos, each cell comes from the tile that owns it, whose number from 1 is in ip3. Missing values (NaN) give no cell."""
    c = records.select(*keys, "ni", "nj", "grtyp", "ip3", "ig3", "ig4", F.posexplode("data").alias("_n", "v")).filter(F.col("_n") < F.col("ni") * F.col("nj"))
    part = F.col("grtyp") == "#"
    c = c.withColumns({"i": F.col("_n") % F.col("ni") + F.when(part, F.col("ig3") - 1).otherwise(0), "j": F.floor(F.col("_n") / F.col("ni")) + F.when(part, F.col("ig4") - 1).otherwise(0)})
    if tile:
        ni, nj, width = tile
        across = (width - 1) // ni + 1
        c = c.filter(~part | ((F.floor(F.col("i") / ni) == (F.col("ip3") - 1) % across) & (F.floor(F.col("j") / nj) == F.floor((F.col("ip3") - 1) / across))))
    return c.select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v").filter("v IS NOT NULL AND NOT isnan(v)")


def dense(cells: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """keys and data: for each of the keys the values v by place n, 0 to before size (of the keys' columns), NaN where there is no cell. Places are filled in by one aggregation, so work is linear in them."""
    every = cells.select(*keys).distinct().withColumn("n", F.explode(F.sequence(F.lit(0), size.cast("int") - 1))).withColumn("v", F.lit(None).cast("double"))
    filled = every.unionByName(cells.select(*keys, F.col("n").cast("int").alias("n"), F.col("v").cast("double").alias("v"))).groupBy(*keys, "n").agg(F.coalesce(F.max("v"), F.lit(float("nan"))).alias("v"))
    return filled.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "v"))), lambda x: x.v).alias("data"))


def fields_at(headers: DataFrame, requests: DataFrame, factor: float = 1.0, tile: tuple[int, int, int] | None = None, time: str = "dateo") -> DataFrame:
    """id, nomvar, etiket, ip1, i, j and value of each request's field: linear between the two times, times factor; null where either is missing or masked (0 in the ``@@`` record of the same variable, label, level and time)."""
    b = bracketed(headers, requests, time)
    ends = F.array_distinct(F.array(F.struct(F.col("t0").alias("t"), F.lit(0).alias("side")), F.struct(F.when(F.col("t1") > F.col("t0"), F.col("t1")).otherwise(F.col("t0")).alias("t"), F.when(F.col("t1") > F.col("t0"), 1).otherwise(0).alias("side"))))
    wanted = b.withColumn("e", F.explode(ends)).select("id", *KEYS, "f", F.col("e.t").alias("t"), F.col("e.side").alias("side"))
    own = headers.join(wanted.select(*KEYS, F.col("t").alias(time)).distinct(), [*KEYS, time], "left_semi")
    cells = record_cells(bf.fetched(own), [*KEYS, time, "typvar"], tile).withColumn("mask", F.rtrim("typvar") == "@@")
    cells = cells.groupBy(*KEYS, F.col(time).alias("t"), "i", "j").agg(F.max(F.when(~F.col("mask"), F.col("v"))).alias("v"), F.max(F.when(F.col("mask"), F.col("v"))).alias("m"))
    cells = cells.withColumn("v", F.when(F.col("m").isNull() | (F.col("m") != 0), F.col("v")))
    both = cells.join(wanted, [*KEYS, "t"]).groupBy("id", *KEYS, "i", "j", "f").agg(*[F.max(F.when(F.col("side") == s, F.col("v"))).alias(f"v{s}") for s in (0, 1)])
    value = F.when(F.col("f") == 0, F.col("v0")).otherwise(F.col("v0") * (1 - F.col("f")) + F.col("v1") * F.col("f"))
    return both.select("id", *KEYS, "i", "j", (value * factor).alias("value"))
