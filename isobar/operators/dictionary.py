"""Metadata dictionary: variables and types as tables, searches, modifiers, reports and checks.

A dictionary is read with Spark's XML source under declared schemas, one row an element. Reports are expressions, and checks are semi and anti joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: State bits by usage, and nature bits by kind of measure.
STATES = {"incomplete": 1, "future": 2, "obsolete": 4, "deprecated": 8, "current": 16}
NATURES = {"integer": 0x100, "real": 0x200, "logical": 0x400, "code": 0x800}
#: Modifier codes and their texts (French, English).
MODIFIERS = {"MIN___": ("(minimum)", "(minimum)"), "MAX___": ("(maximum)", "(maximum)"), "SSTD__": ("(écart-type (population))", "(standard deviation (population))"), "PSTD__": ("(écart-type (échantillon))", "(standard deviation (sample))"), "MEAN__": ("(moyenne)", "(mean)"), "EFI___": ("(index de prévision extrème)", "(extreme forecast index)")}
OPERATORS = {"GT": ">", "LT": "<", "EQ": "=", "GE": ">=", "LE": "<="}
WORDS = {"centile": ("e centile", "th percentile"), "between": ("entre", "between"), "and": ("et", "and"), "D": ("le jour", "day"), "H": ("l'heure", "hour")}
LANGUAGES = ("fr", "en")

_TEXT = "array<struct<_VALUE: string, _lang: string>>"
_RANGE = "struct<units: string, magnitude: double, min: double, max: double, precision: double>"
_CODES = f"struct<value: array<int>, meaning: {_TEXT}>"
VAR_SCHEMA = f"_usage string, _origin string, _pack int, _date date, nomvar struct<_VALUE: string, _ip1: int, _ip2: int, _ip3: int, _etiket: string, _level: double, _kind: int>, description struct<short: {_TEXT}, long: {_TEXT}>, measure struct<integer: {_RANGE}, real: {_RANGE}, logical: {_CODES}, code: {_CODES}>"
TYPE_SCHEMA = f"_usage string, _origin string, _date date, nomtype string, description struct<short: {_TEXT}, long: {_TEXT}>"


def _language(texts: Column, lang: str) -> Column:
    """The text of a language, else the one without a language."""
    pick = lambda want: F.try_element_at(F.filter(texts, lambda t: t["_lang"] == want if want else t["_lang"].isNull()), F.lit(1))["_VALUE"]
    return F.coalesce(pick(lang), pick(None))


def _state(usage: Column) -> Column:
    out = F.lit(0)
    for name, bit in STATES.items():
        out = F.when(usage == name, bit).otherwise(out)
    return out


def read_variables(spark: SparkSession, path) -> DataFrame:
    """One row a ``metvar``, in any number of files."""
    x = spark.read.format("xml").option("rowTag", "metvar").schema(VAR_SCHEMA).load(path)
    m = F.col("measure")
    nature = sum((F.when(m[k].isNotNull(), v).otherwise(0) for k, v in NATURES.items()), F.lit(0)) + _state(F.col("_usage"))
    units = F.when(m.logical.isNotNull(), "bool").when(m.code.isNotNull(), "code").otherwise(F.coalesce(m.integer.units, m.real.units))
    own = lambda f: F.coalesce(m.integer[f], m.real[f])
    codes = F.coalesce(m.code, m.logical)
    return x.select(
        F.substring(F.trim("nomvar._VALUE"), 1, 4).alias("name"), F.col("_origin").alias("origin"), F.col("_pack").alias("pack"), F.col("_date").alias("date"), nature.alias("nature"),
        *[F.coalesce(F.col(f"nomvar._{c}"), F.lit(-1)).alias(c) for c in ("ip1", "ip2", "ip3", "kind")], F.col("nomvar._level").alias("level"), F.col("nomvar._etiket").alias("etiket"),
        *[_language(F.col("description")[s], lang).alias(f"{s}_{lang}") for s in ("short", "long") for lang in LANGUAGES], units.alias("units"), *[own(f).alias(f) for f in ("magnitude", "min", "max", "precision")],
        codes.value.alias("codes"), F.transform(codes.meaning, lambda t: t["_VALUE"]).alias("meanings"),
    )


def read_types(spark: SparkSession, path) -> DataFrame:
    """One row a ``typvar``."""
    x = spark.read.format("xml").option("rowTag", "typvar").schema(TYPE_SCHEMA).load(path)
    return x.select(F.substring(F.trim("nomtype"), 1, 2).alias("name"), F.col("_origin").alias("origin"), F.col("_date").alias("date"), _state(F.col("_usage")).alias("nature"), *[_language(F.col("description")[s], lang).alias(f"{s}_{lang}") for s in ("short", "long") for lang in LANGUAGES])


def search(name: str | None = None, glob: bool = False, state: int = 0, origin: str | None = None, etiket: str | None = None, ip1: int = -1, ip2: int = -1, ip3: int = -1, other_ip1: int = -1) -> Column:
    """Predicate on variables: letter case does not matter; state is a mask; glob takes a pattern, else the whole name is meant."""
    c = F.lit(True)
    if state:
        c &= F.col("nature").bitwiseAND(F.lit(state)) != 0
    for col, want in (("origin", origin), ("etiket", etiket)):
        if want:
            c &= F.lower(col) == want.lower()
    if ip1 > 0:
        c &= F.col("ip1").isin(ip1, other_ip1)
    for col, want in (("ip2", ip2), ("ip3", ip3)):
        if want > 0:
            c &= F.col(col) == want
    if glob:
        return c & (F.col("name").rlike(f"(?i){name}") if name else F.lit(True))
    return c & (F.lower("name") == name.lower() if name else F.lit(False))


def search_type(name: str) -> Column:
    """Predicate on types: the whole name, or it without its first character."""
    return (F.lower("name") == name.lower()) | (F.lower(F.substring("name", 2, 2)) == name.lower())


def ordered(variables: DataFrame) -> DataFrame:
    """By name, current entries first."""
    return variables.orderBy(F.lower("name"), F.col("nature").bitwiseAND(F.lit(255)).desc())


def first_of_each(variables: DataFrame) -> DataFrame:
    """The entry that a search by name finds first."""
    w = Window.partitionBy(F.lower("name")).orderBy(F.col("nature").bitwiseAND(F.lit(255)).desc(), "origin")
    return variables.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def modifier_text(modifier: Column, units: Column, lang: str) -> Column:
    """What a modifier adds to a short description; null if it isn't one. Its first two characters don't count; a time range starts at the ninth."""
    n = LANGUAGES.index(lang)
    body = F.substring(modifier, 3, 6)
    out = F.lit(None).cast("string")
    for op, sign in OPERATORS.items():
        out = F.when(F.startswith(body, F.lit(op)), F.concat(F.lit(f"{sign} "), F.regexp_extract(body, f"^{op}([^_]*)", 1), F.lit(" "), F.coalesce(units, F.lit("")))).otherwise(out)
    out = F.when(F.startswith(body, F.lit("C")), F.concat(F.lit("("), F.regexp_extract(body, "^C([^_]*)", 1), F.lit(WORDS["centile"][n]), F.lit(")"))).otherwise(out)
    for code, texts in MODIFIERS.items():
        out = F.when(body == code, texts[n]).otherwise(out)
    span = F.substring(modifier, 9, 4)
    kind = F.substring(span, 1, 1)
    until = F.regexp_replace(F.substring(span, 2, 3), "^0{1,2}", "")
    word = F.when(kind == "D", WORDS["D"][n]).when(kind == "H", WORDS["H"][n]).otherwise("")
    ranged = F.concat(F.lit(f" {WORDS['between'][n]} "), word, F.lit(f" 1 {WORDS['and'][n]} "), until)
    return F.concat(out, F.when((kind == "N") | (kind == ""), "").otherwise(ranged))


def modified(variables: DataFrame, modifier: Column) -> DataFrame:
    """variables with short texts, units and range as the modifier makes them."""
    compares = F.substring(modifier, 3, 2).isin(*OPERATORS)
    v = variables
    for lang in LANGUAGES:
        t = modifier_text(modifier, F.col("units"), lang)
        v = v.withColumn(f"_{lang}", F.when(t.isNotNull(), F.concat_ws(" ", f"short_{lang}", t)).otherwise(F.col(f"short_{lang}")))
    v = v.withColumns({f"short_{lang}": F.col(f"_{lang}") for lang in LANGUAGES} | {"min": F.when(compares, 0.0).otherwise(F.col("min")), "max": F.when(compares, 100.0).otherwise(F.col("max")), "units": F.when(compares, "%").otherwise(F.col("units"))})
    return v.drop("_fr", "_en")


def report(variables: DataFrame, lang: str = "en", style: str = "short") -> DataFrame:
    """One text a variable: short (a line), long, or XML."""
    s, lng = F.coalesce(F.col(f"short_{lang}"), F.lit("")), F.coalesce(F.col(f"long_{lang}"), F.lit(""))
    if style == "short":
        line = F.format_string("%-4s\t%-70s\t%s", "name", s, F.coalesce("units", F.lit("")))
    elif style == "long":
        line = F.concat_ws("\n", F.concat(F.lit("Name: "), "name"), F.concat(F.lit("Short description: "), s), F.concat(F.lit("Long description: "), lng), F.concat(F.lit("Units: "), F.coalesce("units", F.lit(""))))
    else:
        line = F.format_string('<metvar origin="%s"><nomvar>%s</nomvar><description><short lang="%s">%s</short></description></metvar>', F.coalesce("origin", F.lit("")), "name", F.lit(lang), s)
    return variables.select("name", line.alias("text"))


def type_report(types: DataFrame, lang: str = "en") -> DataFrame:
    return types.select("name", F.format_string("%-2s\t%s", "name", F.coalesce(F.col(f"short_{lang}"), F.lit(""))).alias("text"))


def configured(lines: DataFrame) -> DataFrame:
    """Names in ``sortie(...[A,B])`` lines of a configuration (one row a line, column ``value``); a list may go on over lines if they were joined."""
    inside = F.regexp_extract_all("value", F.lit(r"(?i)sortie\s*\([^\[\]]*\[([^\]]*)\]"), F.lit(1))
    return lines.select(F.explode(F.flatten(F.transform(inside, lambda s: F.split(s, r"\s*,\s*")))).alias("name")).select(F.trim(F.upper("name")).alias("name")).filter("name <> ''")


def known_and_unknown(names: DataFrame, variables: DataFrame) -> DataFrame:
    """(name, n, known): each name used, how often, and whether the dictionary has it."""
    used = names.groupBy("name").agg(F.count("*").alias("n"))
    return used.join(variables.select(F.upper("name").alias("name"), F.lit(True).alias("known")).distinct(), "name", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def defined_not_found(names: DataFrame, variables: DataFrame) -> DataFrame:
    return variables.select(F.upper("name").alias("name")).distinct().join(names.select("name").distinct(), "name", "left_anti")
