"""Batch jobs over files: tiles read back, totals conserved, texts round."""

import pytest
from pyspark.sql import functions as F

from isobar import jobs
from isobar.operators import reading
from isobar.sources import bf


def files(spark, path, name, lons, lats, fields):
    bf.register(spark)
    rows = [(">>", 0, len(lons), 1, "FLOAT64", [float(v) for v in lons]), ("^^", 0, 1, len(lats), "FLOAT64", [float(v) for v in lats])]
    rows += [(name, level, len(lons), len(lats), "FLOAT64", [float(v) for v in data]) for level, data in fields.items()]
    spark.createDataFrame(rows, "nomvar string, ip1 int, ni int, nj int, dtype string, data array<double>").withColumns({"nk": F.lit(1), "grtyp": F.lit("Z"), "typvar": F.lit("P")}).repartition(2).write.format("bf").mode("append").save(path)


def test_tiles_of_files(spark, tmp_path):
    lons, lats = list(range(0, 170, 10)), list(range(-50, 60, 10))
    fields = {k: [1000 * k + n for n in range(17 * 11)] for k in (1, 2)}
    files(spark, f"{tmp_path}/in", "TT", lons, lats, fields)
    jobs.main(["tile", f"{tmp_path}/in", f"{tmp_path}/out", "--ni", "5", "--nj", "4", "--halo", "1", "--variables", "TT"])
    out = spark.read.format("bf").load(f"{tmp_path}/out")
    tiles = out.filter("grtyp = '#'")
    assert tiles.count() == 2 * 4 * 3 and out.filter("nomvar IN ('>>', '^^')").count() == 2
    r = tiles.filter("ip1 = 1 AND ip3 = 6").first()
    assert (r.ig3, r.ig4, r.ni, r.nj) == (5, 4, 7, 6) and r.data[:7] == [1000 + 3 * 17 + 4 + n for n in range(7)]
    cells = reading.record_cells(tiles, ["ip1"], (5, 4, 17))
    got = {(c.ip1, c.i, c.j): c.v for c in cells.collect()}
    assert cells.count() == 2 * 17 * 11 and got == {(k, n % 17, n // 17): float(v) for k, data in fields.items() for n, v in enumerate(data)}


def test_regridding_of_files_conserves(spark, tmp_path):
    files(spark, f"{tmp_path}/in", "PR", [5, 15, 25, 35], [5, 15, 25], {k: [k * (n + 1) for n in range(12)] for k in (1, 2)})
    files(spark, f"{tmp_path}/grid", "XX", [2.5 + 5 * k for k in range(9)], [10, 30], {})
    path = [f"{tmp_path}/in", f"{tmp_path}/out", "--grid", f"{tmp_path}/grid", "--index", f"{tmp_path}/index", "--variables", "PR"]
    jobs.main(["conserve", *path])
    out = {r.ip1: r for r in spark.read.format("bf").load(f"{tmp_path}/out").filter("nomvar = 'PR'").collect()}
    for k in (1, 2):
        assert (out[k].ni, out[k].nj, len(out[k].data)) == (9, 2, 18)
        assert sum(v for v in out[k].data if v == v) == pytest.approx(k * sum(range(1, 13))) and out[k].data[0] == pytest.approx(k * (1 + 5) / 2) and out[k].data[9] == pytest.approx(k * 9 / 2)
        assert out[k].data[8] != out[k].data[8]
    assert not jobs.conserve(spark, f"{tmp_path}/in", f"{tmp_path}/means", f"{tmp_path}/grid", f"{tmp_path}/index", ["PR"], means=True)
    mean = spark.read.format("bf").load(f"{tmp_path}/means").filter("nomvar = 'PR' AND ip1 = 2").first()
    assert mean.data[0] == pytest.approx(6.0) and mean.data[9] == pytest.approx(18.0)


def test_texts_and_configurations(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_text("Hello\n\nWorld é\n")
    jobs.main(["encode", f"{tmp_path}/a", f"{tmp_path}/codes"])
    jobs.main(["decode", f"{tmp_path}/codes", f"{tmp_path}/texts"])
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/texts").collect()) == ["Hello", "World é"]
    (tmp_path / "cfg" / "deep").mkdir(parents=True)
    (tmp_path / "cfg" / "x.cfg").write_text("sortie(1,[TT,UU,\n  vv], 2)\nother([ZZ])\n")
    (tmp_path / "cfg" / "deep" / "y.cfg").write_text("Sortie (a, [tt , QQ])\n")
    known = spark.createDataFrame([("TT",), ("VV",)], "name string")
    got = {r.name: (r.n, r.files, r.known) for r in jobs.check_configurations(spark, f"{tmp_path}/cfg", known).collect()}
    assert got == {"TT": (2, 2, True), "UU": (1, 1, False), "VV": (1, 1, True), "QQ": (1, 1, False)}
