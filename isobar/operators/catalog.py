"""Record catalogue: searches over header tables, without touching data columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Names of descriptor records.
DESCRIPTORS = (">>", "^^", "^>", "!!", "##", "HY", "PROJ", "MTRX")


def criteria(**wanted) -> Column:
    """Conjunction of the given criteria; -1, blank and None match all."""
    c = F.lit(True)
    for name, v in wanted.items():
        if v is None or v == -1 or (isinstance(v, str) and not v.strip()):
            continue
        c = c & (F.rtrim(F.col(name)) == v.rstrip() if isinstance(v, str) else F.col(name) == v)
    return c


def find_all(headers: DataFrame, **wanted) -> DataFrame:
    return headers.filter(criteria(**wanted))


def find(headers: DataFrame, order: list[str], **wanted) -> DataFrame:
    """The first record that matches."""
    return find_all(headers, **wanted).orderBy(*order).limit(1)


def numbered(headers: DataFrame, group: list[str], order: list[str], ranges: bool = False, **wanted) -> DataFrame:
    """Matches with ``place`` from 1 within their group: the n-th next is a filter. With ranges, for groups that hold much of a table: rows are sorted in ranges, numbered within each, and the sizes of a group's ranges before are added."""
    found = find_all(headers, **wanted)
    if not ranges:
        return found.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    d = stored(found.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy(*group, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sizes = sizes.select(F.col("_part").alias("_p"), "_before", *[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)])
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    own = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    return d.withColumn("place", own).join(sizes, same).withColumn("place", (F.col("place") + F.col("_before")).cast("int")).drop("_part", "_p", "_before", *[f"_g{k}" for k in range(len(group))])


def values(headers: DataFrame, column: str, unique: bool = True) -> DataFrame:
    """Validity dates or IPs of a key set."""
    v = headers.select(column)
    return v.distinct() if unique else v


def is_descriptor(name: str = "nomvar") -> Column:
    return F.rtrim(F.col(name)).isin(*DESCRIPTORS)


def missing_descriptors(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Descriptors of source that target doesn't have."""
    return source.filter(is_descriptor()).join(target.select(*key).distinct(), key, "left_anti")


def first_readable(headers: DataFrame, order: list[str], **wanted) -> DataFrame:
    """The first match that is no descriptor and no mask."""
    return find(headers.filter(~is_descriptor() & (F.rtrim("typvar") != "@@")), order, **wanted)


def link(*files: DataFrame) -> DataFrame:
    """Several files as one searchable set, in order of ``file_idx``."""
    out = None
    for n, f in enumerate(files):
        f = f.withColumn("file_idx", F.lit(n))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def conformance(headers: DataFrame, known: DataFrame) -> DataFrame:
    """(check, subject, n): unknown variables, duplicates, and variables with several origin dates."""
    unknown = headers.join(known.select("nomvar"), "nomvar", "left_anti").groupBy("nomvar").agg(F.count("*").alias("n")).select(F.lit("unknown").alias("check"), F.col("nomvar").alias("subject"), "n")
    same = headers.groupBy("nomvar", "etiket", "ip1", "datev").agg(F.count("*").alias("c")).filter("c > 1").groupBy("nomvar").agg(F.sum("c").alias("n")).select(F.lit("duplicate").alias("check"), F.col("nomvar").alias("subject"), "n")
    mixed = headers.groupBy("nomvar").agg(F.countDistinct("dateo").alias("n")).filter("n > 1").select(F.lit("mixed_origin").alias("check"), F.col("nomvar").alias("subject"), "n")
    return unknown.unionByName(same).unionByName(mixed)
