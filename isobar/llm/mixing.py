"""Mixing sources to target weights.

Each row gets a hash-random key (MD5 of seed and doc_id). Within a source, the key's leading digits deal the
rows into key ranges; sizes are summed by range, a running sum over the ranges gives the words
before each, and only the range in which the source's budget ends goes on: by ``DIGITS`` it is cut in ranges
again, then by the keys themselves and, as rows of one doc_id share their key, the rows of the key in which the budget ends by ranges of their text's
hash; what is left is sorted text by text, equal rows as one. So no task ever sees a whole source, nor all rows of one id (null is one, too).

Targets: the sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share all words in
these proportions; a target stops at ``MAX_EPOCHS`` times its source's size, and the excess is shared
anew by weight until no target is above. In the order of size / weight, that is a running sum as well: the sources before the first whose
cap holds its share of what is left stop at their caps. Running sums over sources are one window up to ``FEW_SOURCES``; beyond, sources are sorted in ranges, summed within each, and
the sums of the ranges, of which there are as many as partitions, added. Both give the same.
A source whose target is e times its size and some more is taken e times whole, and the rest in key
order; the row in which the budget ends gives its first words only (or, where texts shall stay whole, all or nothing).

Defined results: null or empty texts have size 0 and take 0; a null source is a source of its own; rows
that are equal in doc_id share a key and are ordered by text hash, and equal rows at the cut share what is left evenly; a corpus without words has targets 0; an empty table gives no rows. Other columns are kept, but for
clashing names (size, source_size, target, taken), which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, stored

WORD = r"[^\x20\x09-\x0D]+"
WORD_AND_SPACE = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
DIGITS = ((1, 3), (4, 3))  # first digit and number of hexadecimal digits of the key, of each cut in ranges
TIE_BITS = (52, 40)  # bits of the text's hash that the ranges of one key's rows leave
FEW_SOURCES = 100_000


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column], few: bool) -> DataFrame:
    """df with ``place``, its row's number in the order, from 1, and for each named column the sum of it in the rows before."""
    def over(w, d):
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        return d.withColumns({"place": F.row_number().over(w).cast("bigint")} | {n: F.coalesce(F.sum(c).over(before), F.lit(0.0)) for n, c in sums.items()})

    if few:
        return over(Window.partitionBy(F.lit(0)).orderBy(*order), df)
    d = stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    parts = d.groupBy("part").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"of_{n}") for n, c in sums.items()])
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ["n", *[f"of_{n}" for n in sums]]])
    d = over(Window.partitionBy("part").orderBy(*order), d).join(F.broadcast(parts), "part")
    return d.withColumns({"place": F.col("place") + F.col("n_before")} | {n: F.col(n) + F.col(f"of_{n}_before") for n in sums}).drop("part", "n_before", *[f"of_{n}_before" for n in sums])


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size), one row per source: also weight and target. Null-safe; sources in code point order."""
    few = sizes.count() <= FEW_SOURCES
    by_name = F.col("source").asc_nulls_last()
    w = _running(sizes, [by_name], {}, few)
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))).drop("place")
    w = w.withColumn("cap", F.col("source_size").cast("double") * MAX_EPOCHS)
    w = stored(_running(w, [F.col("cap") / F.col("weight"), by_name], {"cap_before": F.col("cap"), "weight_before": F.col("weight")}, few), "targets")
    words, weights = w.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level = (F.lit(words or 0.0) - F.col("cap_before")) / (F.lit(weights or 0.0) - F.col("weight_before"))
    share = w.withColumn("level", level).filter(F.col("cap") >= F.col("level") * F.col("weight")).agg(F.min_by("level", "place")).first()[0]
    target = F.least("cap", F.lit(share) * F.col("weight")) if share is not None else F.col("cap")
    return w.select("source", "source_size", "weight", target.alias("target"))


def _n_words(text: str) -> Column:
    """Number of words: each becomes one character with the space about it. regexp_count would hold all words of a text at once."""
    return F.when(F.regexp_like(text, F.lit(WORD)), F.length(F.regexp_replace(text, F.lit(WORD_AND_SPACE), F.lit("x")))).otherwise(F.lit(0)).cast("bigint")


def _sized(docs: DataFrame, seed: int, name: dict[str, str]) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.drop("size", "source_size", "target", "taken").withColumns({"size": _n_words("text"), name["key"]: key, name["tie"]: F.xxhash64("text")})


def _source_table(rows: DataFrame) -> DataFrame:
    """Stored, one row per source of rows (doc_id, source, size, key, tie): target, whole epochs, and the row (key, doc_id, tie) in which its budget ends, with the words that it may give."""
    digits = {f"range{k}": F.conv(F.substring("key", at, n), 16, 10).cast("int") for k, (at, n) in enumerate(DIGITS)}
    digits |= {"key": F.col("key")} | {f"text{k}": F.shiftright("tie", at) for k, at in enumerate(TIE_BITS)}
    rows = rows.withColumns(digits)
    ranges = stored(rows.groupBy("source", "range0").agg(F.sum("size").alias("words")), "mix-ranges")
    t = source_targets(stored(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), "mix-sources"))
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
    t = stored(t.withColumn("rest", F.round(F.col("target") - (F.col("epochs") * F.col("source_size")).cast("double")).cast("bigint")), "mix-rests")
    cut = t.select(F.col("source").alias("s"), "rest", F.lit(0).cast("bigint").alias("before"))
    r = rows
    for k, name in enumerate(digits):  # the range in which the budget ends, then its own ranges
        words = ranges if k == 0 else r.groupBy("source", name).agg(F.sum("size").alias("words"))
        earlier = Window.partitionBy("source").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        c = words.withColumn("sum", F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(cut, F.col("source").eqNullSafe(F.col("s"))).withColumn("before", F.col("before") + F.col("sum"))
        c = c.filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words")))
        cut = stored(c.select("s", "rest", "before", F.col(name).alias("at")), "mix-cut")
        r = r.drop("s", "rest", "before", "at").join(_bounded(cut), F.col("source").eqNullSafe(F.col("s")) & (F.col(name) == F.col("at")))
        cut = cut.drop("at")
    r = r.groupBy("s", "rest", "before", "key", "doc_id", "tie", "size").agg(F.count("*").alias("equal"))
    order = Window.partitionBy("s").orderBy("key", "doc_id", "tie", "size")
    r = r.withColumn("so_far", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("equal")).over(order.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    at = r.filter(F.col("so_far") >= F.col("rest")).groupBy("s").agg(
        F.min(F.struct("so_far", "key", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "tie", "rest", "size")).alias("at"), F.min("so_far").alias("end")
    )
    same = r.join(at.select(F.col("s").alias("s2"), "end"), F.col("s").eqNullSafe(F.col("s2")) & (F.col("so_far") == F.col("end")) & (F.col("size") > 0)).groupBy("s2").agg(F.sum("equal").alias("equal"))
    at = at.join(same, F.col("s").eqNullSafe(F.col("s2")), "left")
    left = F.floor((F.col("at.rest") - F.col("at.so_far") + F.col("equal") * F.col("at.size")) / F.col("equal")).cast("bigint")
    at = at.select("s", F.struct(F.col("at.key").alias("k"), F.col("at.doc_id").alias("d"), F.col("at.tie").alias("t")).alias("cut"), left.alias("cut_words"))
    return stored(t.join(at, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "weight", "rest"), "mix-targets")


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast if there are few sources; else the planner joins as it sees fit, and splits hot sources."""
    return F.broadcast(df) if df.count() <= FEW_SOURCES else df


def _taken(sized: DataFrame, table: DataFrame, name: dict[str, str]) -> DataFrame:
    """sized with source_size, target and taken."""
    t = _bounded(table.select(F.col("source").alias(name["s"]), "source_size", "target", F.col("epochs").alias(name["epochs"]), F.col("cut").alias(name["cut"]), F.col("cut_words").alias(name["words"])))
    r = sized.join(t, sized["source"].eqNullSafe(t[name["s"]]))
    own, cut = F.struct(F.col(name["key"]).alias("k"), F.coalesce("doc_id", F.lit(-1)).alias("d"), F.col(name["tie"]).alias("t")), F.col(name["cut"])
    part = F.when(cut.isNull(), F.lit(0)).when(own < cut, F.col("size")).when(own == cut, F.least(name["words"], "size")).otherwise(F.lit(0))
    return r.withColumn("taken", (F.col(name["epochs"]) * F.col("size") + part).cast("bigint")).drop(*name.values())


_INNER = ("key", "tie", "s", "epochs", "cut", "words")


def mix_sizes(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row; texts are read once."""
    name = dict(zip(_INNER, _INNER))
    rows = stored(_sized(docs.select("doc_id", "text", "source"), seed, name).drop("text"), "mix")
    return _taken(rows, _source_table(rows), name)


def mix_plan(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs (doc_id, text, source and others) with size, source_size, target and taken."""
    name = free_names(docs, _INNER)
    sized = _sized(docs, seed, name)
    rows = stored(sized.select("doc_id", "source", "size", F.col(name["key"]).alias("key"), F.col(name["tie"]).alias("tie")), "mix")
    return _taken(sized, _source_table(rows), name)


def mix_documents(docs: DataFrame, seed: int = 7, whole: bool = False) -> DataFrame:
    """The mixed corpus, with docs' columns: a row for each time that a document is taken; of the row in which a budget ends, its first words (joined by one space). With whole, all of that row if half of it or more is taken, and
    else nothing: texts stay as they are, and a source's words are off its target by half a document at most (for equal rows at the cut, by half of each)."""
    new = free_names(docs, ("size", "source_size", "target", "taken", "copy"))
    copy, own = new.pop("copy"), {c: new[c.lower()] for c in docs.columns if c.lower() in new}  # docs' own columns of these names step aside
    r = mix_plan(docs.withColumnsRenamed(own), seed).filter("taken > 0")
    times = F.col("taken") / F.col("size")
    copies = (F.floor(times + 0.5) if whole else F.ceil(times)).cast("int")
    r = r.filter(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
    if not whole:
        left = F.col("taken") - (F.col(copy) - 1) * F.col("size")
        cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1), F.lit(1), left.cast("int")), " ")
        r = r.withColumn("text", F.when(left >= F.col("size"), F.col("text")).otherwise(cut))
    return r.drop("size", "source_size", "target", "taken", copy).withColumnsRenamed({n: c for c, n in own.items()}).select(docs.columns)


PLAN_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('7:' || CAST(doc_id AS VARCHAR)) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS cap FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level,
      row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
      FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, (SELECT level FROM l WHERE cap >= level * weight ORDER BY place LIMIT 1) AS share FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(share * weight, cap)) AS target FROM h),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT *, CAST(round(target - CAST(epochs * source_size AS DOUBLE)) AS BIGINT) AS rest FROM e),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT p.doc_id, p.size, r.source_size, round(r.target, 6) AS target, CAST(r.epochs * p.size + greatest(0, least(p.size, r.rest - p.before)) AS BIGINT) AS taken
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
"""
