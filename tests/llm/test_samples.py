"""Bounded samples for learning, and columns whose names clash with those of the stages."""

import random

from pyspark.sql import functions as F

from isobar.llm import common, jaccard, language, quality, toxicity


def test_scan_for_a_fit_runs_in_every_partition(spark, tmp_path):
    spark.createDataFrame([(k, f"word{k} text", "en") for k in range(400)], "doc_id long, text string, lang string").repartition(8).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(k, k % 2) for k in range(0, 400, 2)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/l")
    docs = spark.read.option("maxPartitionBytes", 1).parquet(f"{tmp_path}/d")
    sample = common.labelled_sample(docs, spark.read.parquet(f"{tmp_path}/l"), "toxic", F.lit(True), 50)
    sc = spark.sparkContext
    sc.setJobGroup("fit", "fit")
    common.fitted(sample, lambda texts, y, prior: str(len(texts)).encode())
    sc.setJobGroup("", "")
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("fit") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    assert max(stages) >= docs.rdd.getNumPartitions() > 1


def test_repeated_ids_keep_to_the_bound(spark):
    rows = [(1, f"text {k % 70} of one id", "en") for k in range(5000)] + [(k, f"text of {k}", "en") for k in range(2, 40)] + [(2, "autre texte", "fr"), (3, "sans langue", None), (None, "no id", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(k, 1) for k in range(1, 40)] + [(1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got = common.labelled_sample(docs, labels, "toxic", F.lit(True), 10).collect()
    assert len(got) == 10 and len({r.doc_id for r in got}) == 10 and {r.y for r in got} == {"1"}
    whole = common.labelled_sample(docs, labels, "toxic", F.lit(True), 1000).collect()
    assert len(whole) == 39 and len(whole) == len({r.doc_id for r in whole})
    seen = []
    known = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("lang").alias("y")).distinct()
    seen = common.sampled(docs.select("doc_id", "text", F.col("lang").alias("y")), known, ["doc_id", "y"], 1000).collect()
    assert "sans langue" not in {r.text for r in seen} and ("fr", "autre texte") in {(r.y, r.text) for r in seen}
    assert sum(r.doc_id == 1 for r in seen) == 1


def test_texts_of_a_sample_keep_to_a_bound_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(common, "SAMPLE_BYTES", 3000)
    docs = spark.createDataFrame([(k, "x" * 1000) for k in range(40)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    sizes = common.fitted(common.labelled_sample(docs, labels, "toxic", F.lit(True), 100), lambda texts, y, prior: f"{y.count('0')} {y.count('1')}".encode())
    assert sizes == b"2 2"
    assert common.fitted(common.labelled_sample(docs.limit(0), labels.limit(0), "toxic", F.lit(True), 100), lambda texts, y, prior: str(len(y)).encode()) == b"0"


def test_every_language_is_learned(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("bcdfgh") + rng.choice("aeiou") for _ in range(8)), f"l{k % 1100:04d}") for k in range(2200)]
    model = __import__("pickle").loads(language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)))
    assert len(model["langs"]) == 1100


def test_columns_of_stages_keep_their_values(spark):
    rows = [(k, ("good plain words of a text " if k % 2 else "snarl ### ### bad ") * 6 + f"number {k % 9}", 42.0, "d", "t", 7, "r", "s") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, _d string, _t string, _th int, _row string, _score string")
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    for out in (toxicity.reject_toxic(docs, labels), quality.reject_poor(docs, labels), jaccard.one_of_each(docs), jaccard.one_of_each(docs.union(docs))):
        assert out.columns == docs.columns
        got = out.collect()
        assert 0 < len(got) < 40 and all((r.score, r["_d"], r["_t"], r["_th"], r["_row"], r["_score"]) == (42.0, "d", "t", 7, "r", "s") for r in got)
