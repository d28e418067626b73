import struct

import numpy as np
import pytest

from isobar.sources import bf
from isobar.sources.codec import compress, inflate


@pytest.mark.parametrize("kind", ["f4", "f8"])
def test_codec_round_trip(kind):
    rng = np.random.default_rng(1)
    for a in (np.zeros(50), np.sin(np.arange(400) / 30), rng.normal(size=300), np.array([]), np.array([np.inf, -0.0, 1e-40, np.nan, 5.0]), np.repeat([1.5, 2.5], 60)):
        a = a.astype(kind)
        raw = compress(a)
        assert inflate(raw, len(a), kind).tobytes() == a.tobytes()
    assert len(compress(np.zeros(1000, dtype=kind))) < 1200


def test_reads_a_file_laid_out_by_hand(spark, tmp_path):
    bf.register(spark)
    block = struct.pack("<6f", 1, 2, 3, 4, 5, 6.5)
    head = struct.pack("<qq15i2s4s12scc", 32, 24, 1000, 60, 2, 32, 10, 12000, 0, 0, 3, 2, 1, 1, 2, 3, 4, b"P\0", b"TT\0\0", b"RUN1", b"L", b"\0")
    path = tmp_path / "a.bf"
    path.write_bytes(struct.pack("<qqiIII", 32 + 24, 32 + 24 + 4 + 96, 0x45454642, 2, 32, 96) + block + struct.pack("<i", 1) + head)
    r = spark.read.format("bf").load(str(path)).collect()
    assert len(r) == 1 and r[0].nomvar == "TT" and r[0].etiket == "RUN1" and r[0].data == [1, 2, 3, 4, 5, 6.5] and (r[0].ni, r[0].nj, r[0].nk) == (3, 2, 1)
    path.write_bytes(path.read_bytes()[:-1])
    with pytest.raises(ValueError):
        bf.index(str(path))


def test_write_and_read_again(spark, tmp_path):
    bf.register(spark)
    rows = [(n, "CFLOAT32" if n % 2 else "INT16", "UU" if n % 3 else "VV", n, 4, 2, [float(n + k // 3) for k in range(8)]) for n in range(30)]
    df = spark.createDataFrame(rows, "ip1 int, dtype string, nomvar string, dateo int, ni int, nj int, data array<double>").repartition(3)
    df.write.format("bf").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("bf").load(str(tmp_path / "out"))
    assert sorted((r.ip1, r.nomvar, r.data) for r in back.collect()) == sorted((r[0], r[2], r[6]) for r in rows)
    assert back.filter("nomvar = 'VV'").count() == 10
    assert spark.read.format("bf").option("data", "false").load(str(tmp_path / "out")).filter("data IS NULL").count() == 30


def attempt(writer, rows):
    return writer.write(iter(rows))


def test_attempts_that_do_not_count_leave_nothing(spark, tmp_path):
    """A task that ran twice, and a job that failed: only what was committed is there, and no temporary folder is left."""
    from pyspark.sql import Row
    from pyspark.sql.types import StructType

    bf.register(spark)
    schema = StructType.fromDDL("ip1 int, nomvar string, data array<double>")
    folder = str(tmp_path / "out")
    rows = [Row(ip1=k, nomvar="TT", data=[float(k)]) for k in range(5)]
    writer = bf._Writer({"path": folder}, schema, False)
    lost, kept = attempt(writer, rows), attempt(writer, rows)
    assert lost.path != kept.path and bf.listed(folder) == []
    writer.commit([kept])
    failed = bf._Writer({"path": folder}, schema, False)
    attempt(failed, rows)
    failed.abort([None])
    back = spark.read.format("bf").load(folder)
    assert sorted(r.ip1 for r in back.collect()) == [0, 1, 2, 3, 4]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [kept.path.split("/")[-1]]
    again = bf._Writer({"path": folder}, schema, True)
    again.commit([attempt(again, rows[:2])])
    assert spark.read.format("bf").load(folder).count() == 2


def test_paths_with_a_scheme_and_patterns(spark, tmp_path):
    bf.register(spark)
    df = spark.createDataFrame([(k, "TT", [float(k)]) for k in range(6)], "ip1 int, nomvar string, data array<double>").repartition(2)
    df.write.format("bf").mode("append").save(f"file://{tmp_path}/run1")
    df.write.format("bf").mode("append").save(f"{tmp_path}/run2")
    for path, n in ((f"file://{tmp_path}/run1", 6), (f"{tmp_path}/run*/*.bf", 12), (f"file://{tmp_path}/run2/part-*.bf", 6), (f"{tmp_path}/run1,file://{tmp_path}/run2", 12), (f"{tmp_path}/none", 0)):
        assert spark.read.format("bf").load(path).count() == n
    heads = spark.read.format("bf").option("data", "false").load(f"{tmp_path}/run1").filter("ip1 > 3").withColumn("extra", heads_extra())
    assert sorted((r.ip1, r.data, r.extra) for r in bf.fetched(heads).collect()) == [(4, [4.0], "x"), (5, [5.0], "x")]


def heads_extra():
    from pyspark.sql import functions as F

    return F.lit("x")
