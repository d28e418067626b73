"""Batch jobs over files, for ``spark-submit`` or ``python -m isobar.jobs NAME ...``: tiles of fields, conservative regridding, text codes, and checks against a dictionary. Each is a function on a session and paths, too."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions import rings
from isobar.operators import catalog, dictionary, gridref, reading, regrid
from isobar.sources import bf

_OWN = ("file_idx", "rec_idx", "file", "offset", "nbytes")  # columns of reading, which writing doesn't take
_RECORD = [*bf.HEADER, "dtype", "data", "raw"]


def _headers(spark: SparkSession, path: str, variables: list[str] | None) -> DataFrame:
    """Headers of the named variables' fields, or of all that are no descriptors."""
    bf.register(spark)
    h = spark.read.format("bf").option("data", "false").load(path)
    return h.filter(F.rtrim("nomvar").isin(variables) if variables else ~catalog.is_descriptor())


def tiled(records: DataFrame, ni: int, nj: int, halo: int) -> DataFrame:
    """A record for each tile of ni x nj, with halo cells around, of records of one level: ip3 is its number from 1, ig3 and ig4 its origin from 1, grtyp ``#``. Rows of tiles are slices of the record's array."""
    width, height = F.col("ni"), F.col("nj")
    t = records.filter("nk = 1 AND data IS NOT NULL").withColumn("_across", F.ceil(width / ni)).withColumn("_t", F.explode(F.sequence(F.lit(0), (F.col("_across") * F.ceil(F.col("nj") / nj) - 1).cast("int"))))
    low = lambda n, side: F.greatest(F.lit(0), n * side - halo).cast("int")
    high = lambda n, side, whole: F.least(whole, (n + 1) * side + halo).cast("int")
    ti, tj = F.col("_t") % F.col("_across"), F.floor(F.col("_t") / F.col("_across"))
    t = t.withColumns({"_x0": low(ti, ni), "_x1": high(ti, ni, width), "_y0": low(tj, nj), "_y1": high(tj, nj, height)})
    row = lambda j: F.slice("data", j * width + F.col("_x0") + 1, F.col("_x1") - F.col("_x0"))
    t = t.withColumn("_data", F.flatten(F.transform(F.sequence(F.col("_y0"), F.col("_y1") - 1), row)))
    new = {"data": F.col("_data"), "ni": F.col("_x1") - F.col("_x0"), "nj": F.col("_y1") - F.col("_y0"), "ip3": (F.col("_t") + 1).cast("int"), "ig3": F.col("_x0") + 1, "ig4": F.col("_y0") + 1, "grtyp": F.lit("#")}
    return t.select(*[new[c].alias(c) if c in new else F.col(c) for c in records.columns])


def tile(spark: SparkSession, source: str, target: str, ni: int, nj: int, halo: int = 0, variables: list[str] | None = None) -> None:
    """The fields of record files in tiles, and their descriptors as they are."""
    fields = tiled(bf.fetched(_headers(spark, source, variables)), ni, nj, halo)
    heads = spark.read.format("bf").option("data", "false").load(source).filter(catalog.is_descriptor())
    fields.unionByName(bf.fetched(heads)).drop(*_OWN).write.format("bf").mode("append").save(target)


def _edges(axis: Column) -> Column:
    """The bounds of the cells of an axis: half way between its points, and as far beyond its ends."""
    n = F.size(axis)
    mid = F.transform(F.slice(axis, 1, n - 1), lambda a, k: (a + axis[k + 1]) / 2)
    return F.concat(F.array(axis[0] * 1.5 - axis[1] / 2), mid, F.array(F.element_at(axis, -1) * 1.5 - F.element_at(axis, -2) / 2))


def grid_cells(spark: SparkSession, path: str) -> DataFrame:
    """i, j and ring of the cells of the grid whose axes are the first ``>>`` and ``^^`` records of the files."""
    heads = spark.read.format("bf").option("data", "false").load(path)
    axis = lambda name: bf.fetched(heads.filter(F.rtrim("nomvar") == name).orderBy("file_idx", "rec_idx").limit(1)).select(_edges(F.col("data")).alias("e"))
    span = lambda df, k, a, b: df.select(F.posexplode(F.transform(F.slice("e", 1, F.size("e") - 1), lambda v, n: F.struct(v.alias("a"), F.col("e")[n + 1].alias("b")))).alias(k, "s")).select(k, F.col("s.a").alias(a), F.col("s.b").alias(b), F.lit(0).alias("one"))
    cells = span(axis(">>"), "i", "x0", "x1").join(span(axis("^^"), "j", "y0", "y1"), "one")
    return cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), rings.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))


def conserve(spark: SparkSession, source: str, target: str, grid: str, index: str, variables: list[str] | None = None, means: bool = False) -> bool:
    """Every record of the variables (all fields, if none are named) on another grid, by the parts of its cells' areas: as sums, or as means over what is covered. The weights are kept in the index folder under both paths, and taken from there if they are known; whether they were made."""
    bf.register(spark)
    known, cells = regrid.RegridIndex(spark, index), (grid_cells(spark, source), grid_cells(spark, grid))
    of = lambda c, a, b: c.select(F.col("i").alias(a), F.col("j").alias(b), "ring")
    made = known.fill(source, grid, lambda: regrid.conservative(of(cells[0], "si", "sj"), of(cells[1], "di", "dj")))
    records = bf.fetched(_headers(spark, source, variables)).filter("nk = 1 AND data IS NOT NULL")
    key = ["file_idx", "rec_idx"]
    field = records.select(*key, "ni", F.posexplode("data").alias("n", "v")).select(*key, (F.col("n") % F.col("ni")).cast("long").alias("i"), F.floor(F.col("n") / F.col("ni")).alias("j"), F.when(~F.isnan("v"), F.col("v")).alias("v"))
    out = known.apply(field, source, grid, key, "there" if means else "sum")
    ni, nj = cells[1].agg((F.max("i") + 1).cast("int"), (F.max("j") + 1).cast("int")).first()
    if ni is None:
        raise ValueError(f"{grid}: no axes (>> and ^^)")
    ni, nj = cells[1].agg((F.max("i") + 1).cast("int"), (F.max("j") + 1).cast("int")).first()
    if ni is None:
        raise ValueError(f"{grid}: no axes (>> and ^^)")
    held = out.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("di", "dj").alias("at"), "value"))).alias("_held"))
    held = reading.dense(out.select(*key, (F.col("dj") * ni + F.col("di")).alias("n"), F.col("value").alias("v")), key, F.lit(ni * nj))
    r = records.drop("data", "ni", "nj").join(held, key)
    heads = bf.fetched(spark.read.format("bf").option("data", "false").load(grid).filter(F.rtrim("nomvar").isin(">>", "^^")))
    r = r.withColumns({"ni": F.lit(ni), "nj": F.lit(nj), "dtype": F.lit("FLOAT64")}).select(*_RECORD)
    r.unionByName(heads.select(*_RECORD)).write.format("bf").mode("append").save(target)
    return made


def encode(spark: SparkSession, source: str, target: str) -> None:
    """Each line of text files that isn't empty as a record of its characters' codes. The order of lines is not kept."""
    bf.register(spark)
    lines = spark.read.text(source).filter("value <> ''")
    r = lines.select(gridref.encode_text(F.col("value")).cast("array<double>").alias("data"), F.length("value").alias("ni"), F.lit("INT32").alias("dtype"), F.lit("TEXT").alias("nomvar"))
    r.write.format("bf").mode("append").save(target)


def decode(spark: SparkSession, source: str, target: str) -> None:
    """The texts of such records, a line each."""
    records = bf.fetched(_headers(spark, source, ["TEXT"]))
    records.select(gridref.decode_text(F.col("data").cast("array<int>")).alias("value")).write.text(target)


def check_configurations(spark: SparkSession, folder: str, variables: DataFrame) -> DataFrame:
    """name, n, files, known: the variables that all configuration files under a folder name, in how many files, and whether the dictionary has them. Lists may go on over lines."""
    whole = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    inside = F.regexp_extract_all("value", F.lit(r"(?i)sortie\s*\([^\[\]]*\[([^\]]*)\]"), F.lit(1))
    names = whole.select("file", F.explode(F.flatten(F.transform(inside, lambda s: F.split(s, r"[,\s]+")))).alias("name")).select("file", F.upper(F.trim("name")).alias("name")).filter("name <> ''")
    files = names.groupBy("name").agg(F.countDistinct("file").alias("files"))
    return dictionary.known_and_unknown(names.select("name"), variables).join(files, "name").select("name", "n", "files", "known")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="isobar.jobs", description=__doc__)
    sub = p.add_subparsers(dest="job", required=True)
    names = lambda s: s.split(",")
    t = sub.add_parser("tile", help=tile.__doc__)
    t.add_argument("source"), t.add_argument("target"), t.add_argument("--ni", type=int, required=True), t.add_argument("--nj", type=int, required=True), t.add_argument("--halo", type=int, default=0), t.add_argument("--variables", type=names)
    t = sub.add_parser("conserve", help=conserve.__doc__)
    t.add_argument("source"), t.add_argument("target"), t.add_argument("--grid", required=True), t.add_argument("--index", required=True), t.add_argument("--variables", type=names), t.add_argument("--means", action="store_true")
    for name, job in (("encode", encode), ("decode", decode)):
        t = sub.add_parser(name, help=job.__doc__)
        t.add_argument("source"), t.add_argument("target")
    given = vars(p.parse_args(argv))
    jobs = {"tile": tile, "conserve": conserve, "encode": encode, "decode": decode}
    jobs[given.pop("job")](SparkSession.builder.getOrCreate(), **given)


if __name__ == "__main__":
    main()
