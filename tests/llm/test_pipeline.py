import base64
import pickle
import random
import re
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from isobar.llm import quality, toxicity
from isobar.llm.common import stored, utf8

from .test_jaccard import brute
from .test_mixing import targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(260):
        w = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        if k > 200:
            w = docs[k - 150][1].split(" ")
            w[3:3] = [rng.choice(words)] * rng.randint(0, 1)
        bad, poor = k % 5 == 1 and k <= 200, k % 5 == 2 and k <= 200
        if bad:
            w[5] = rng.choice(["grunt", "snarl"])
        text = " ".join(w) if not poor else " ".join(f"{x}###" for x in w)
        docs.append((k, text, "en", f"src{k % 3}", len(text)))
        labels.append((k, int(not poor), int(bad)))
    docs += [(900, None, "en", "src0", 0), (901, "", None, None, None)]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_every_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    step = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    def score(texts, scorer):
        data, off = utf8(pa.array(texts, pa.large_string()))
        return scorer(data, off)

    a = stored(step["toxicity"](spark, docs, sf_dir), "a")
    scorer = toxicity._Scorer(pickle.loads(toxicity.train(docs, labels, "toxic", F.lit(True))))
    want = {i for i, s in zip(rows, score([r.text for r in rows.values()], scorer)) if s < 0.5}
    assert {r.doc_id for r in a.collect()} == want and a.columns == docs.columns
    assert sum(i % 5 == 1 and i <= 200 for i in want) <= 3

    b = stored(step["quality"](spark, a, sf_dir), "b")
    kept = sorted(want)
    s = score([rows[i].text for i in kept], quality._scorer(quality.train(a, labels, "quality", F.lit(True))))
    want = {i for i, x in zip(kept, s) if x >= 0.3}
    assert {r.doc_id for r in b.collect()} == want

    c = stored(step["near_duplicates"](spark, b, sf_dir), "c")
    want = {i for i, (_, k) in brute({i: rows[i].text for i in want}, 5, 80, 100).items() if i == k}
    assert {r.doc_id for r in c.collect()} == want and len(want) < 200

    e = stored(step["mixing"](spark, c, sf_dir), "e")
    size, sizes = {i: len(WORD.findall(rows[i].text or "")) for i in want}, Counter()
    for i in want:
        sizes[rows[i].source] += size[i]
    words, seen = Counter(), Counter()
    for r in e.collect():
        assert r.text == rows[r.doc_id].text  # whole
        words[r.source] += len(WORD.findall(r.text))
        seen[r.doc_id] += len(WORD.findall(r.text))
    for source, t in targets(dict(sizes)).items():
        assert abs(words[source] - t) <= 1 + max(size[i] for i in want if rows[i].source == source) / 2
    assert all(n <= 3 * size[i] for i, n in seen.items())

    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    f = step["bpe"](spark, e, sf_dir).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in f) == Counter((r.doc_id, tuple(plain.encode_ordinary(r.text))) for r in e.collect())


def test_run_applies_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() > 50


def test_empty_documents(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "none")
        assert docs.count() == 0
