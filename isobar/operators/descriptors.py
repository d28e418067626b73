"""Vertical references from descriptor records: what kind of level a set of fields has, its parameters, and pressures through them.

Of each set (by key columns) the first ``!!`` record (a table of parameters and of each level's coefficients), the first ``HY`` record (top, reference and exponent in its header) and the first ``PT`` record (top pressure)
are found among headers, and only these are read (bf.fetched); they are brought together by one aggregation and joined to the sets, and the first kind that there is counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.functions import expr
from isobar.sources import bf

DEFAULT_TOP = 10.0
PARAMETERS = ["kind", "version", "ptop", "pref", "rcoef0", "rcoef1", "levels"]


def records(headers: DataFrame, keys: list[str]) -> DataFrame:
    """keys with toc, hy and pt: the first descriptor record of each kind, null if there is none."""
    name, x = F.rtrim("nomvar"), F.rtrim("typvar") == "X"
    d = bf.fetched(headers.filter((name.isin("!!", "HY") & x) | (name == "PT")))
    own = F.struct("file_idx", "rec_idx", "ip1", "ig1", "ig2", "ni", "nj", "data")
    return d.groupBy(*keys).agg(*[F.min(F.when(name == n, own)).alias(c) for n, c in (("!!", "toc"), ("HY", "hy"), ("PT", "pt"))])


def _table(toc: Column) -> Column:
    """ip, a and b of each level, in the rows after those that the table's first row says to skip."""
    rows = F.sequence(toc.data[2].cast("int"), toc.nj - 1)
    at = lambda j, c: F.element_at(toc.data, j * toc.ni + c + 1)
    return F.when(toc.data[2] < toc.nj, F.transform(rows, lambda j: F.struct(at(j, 0).cast("int").alias("ip"), at(j, 1).alias("a"), at(j, 2).alias("b"))))


def decoded(sets: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """sets (keys, kind: PRESSURE, UNDEFINED, SIGMA, ETA or HYBRID, as their fields say) with kind as the descriptors say, version, ptop and pref (hPa), rcoef0, rcoef1 and levels, the table of ip, a, b.

    Pressures and levels of undefined kind need no descriptor. Version is that of a ``!!`` record, else 0; parameters that a version doesn't state are those of its header (top) or 10, 0 and 0."""
    d = sets.join(records(headers, keys), keys, "left")
    toc, hy, pt, kind = F.col("toc"), F.col("hy"), F.col("pt"), F.col("kind")
    needs = ~kind.isin("PRESSURE", "UNDEFINED")
    v, cell = toc.ig1, lambda n: F.element_at(toc.data, toc.ni + n + 1) * F.lit(0.01)
    by_toc, by_hy = needs & toc.isNotNull(), needs & toc.isNull() & hy.isNotNull()
    plain = needs & toc.isNull() & hy.isNull()
    stated = lambda low, value, other: F.when((v >= low) & (v != 2001), value).otherwise(other)
    eta = plain & pt.isNotNull() & kind.isin("SIGMA", "ETA")
    out = {
        "version": F.when(by_toc, v).otherwise(F.lit(0)),
        "ptop": F.when(by_toc, stated(1002, cell(0), toc.ig2 / 10)).when(by_hy, hy.ip1.cast("double")).when(eta, pt.data[0]).when(plain & kind.isin("SIGMA", "ETA"), F.lit(DEFAULT_TOP)),
        "pref": F.when(by_toc, stated(1003, cell(1), F.lit(10.0))).when(by_hy, hy.ig1.cast("double")),
        "rcoef0": F.when(by_toc, stated(1003, cell(2) * 100, F.lit(0.0))).when(by_hy, hy.ig2 / 1000),
        "rcoef1": F.when(by_toc, stated(5002, F.element_at(toc.data, 2 * toc.ni + 1), F.lit(0.0))).when(by_hy, F.lit(0.0)),
        "levels": F.when(by_toc, _table(toc)),
        "kind": F.when(by_toc, F.coalesce(F.expr(expr.version_kind("toc.ig1")), kind)).when(by_hy & (kind == "SIGMA"), "ETA").when(eta, "ETA").otherwise(kind),
    }
    return d.select(*[c for c in sets.columns if c not in PARAMETERS], *[out[c].alias(c) for c in PARAMETERS])


def pressure(level: Column, ip1: Column, p0: Column) -> Column:
    """Pressure (hPa) of a level by the columns of ``decoded`` and the surface pressure: the level itself, a share of it, that between the top and it, the hybrid formula, or from a level's coefficients; null where a table lacks the level."""
    c = {n: F.col(n) for n in PARAMETERS}
    own = F.get(F.filter(c["levels"], lambda x: x.ip == ip1), F.lit(0))
    top = c["ptop"] / c["pref"]
    hybrid = c["pref"] * level + (p0 - c["pref"]) * F.pow(F.greatest(F.lit(0.0), (level - top) / (1 - top)), c["rcoef0"])
    by_table = F.when(c["version"] == 5001, own.a / 100 + own.b * p0).otherwise(F.exp(own.a + own.b * F.log(p0 / c["pref"])) / 100)
    kind = c["kind"]
    return F.when(kind == "PRESSURE", level).when(kind == "UNDEFINED", p0).when(kind == "SIGMA", p0 * level).when(kind == "ETA", c["ptop"] + (p0 - c["ptop"]) * level).when((kind == "HYBRID") & (c["version"] <= 0), hybrid).when(kind == "HYBRID", by_table)
