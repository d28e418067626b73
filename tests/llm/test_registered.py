"""The registered queries on small tables, against plain versions of them."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from isobar.llm import language, quality, queries, toxicity
from isobar.llm.common import crc_fold, utf8

from .test_jaccard import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, docs, labels = random.Random(4), [], []
    words = {"en": ["the", "water", "house", "green", "walks", "seven", "light"], "de": ["der", "wasser", "haus", "grün", "geht", "sieben", "licht"], "el": ["το", "νερό", "σπίτι", "πράσινο", "επτά", "φως"]}
    for k in range(180):
        lang = ["en", "de", "el"][k % 3]
        w = [rng.choice(words[lang]) + str(rng.randint(0, 3)) * (rng.random() < 0.3) for _ in range(rng.randint(4, 60))]
        bad, poor = k % 7 == 1, k % 5 == 2
        w[1:1] = ["snarl"] * bad
        text = " ".join(w if not poor else [f"{x}###" for x in w])
        docs.append((k, docs[k - 60][1] + (" end" if k % 2 else "") if k > 150 else text, lang, f"s{k % 4}", len(text)))
        labels.append((k, int(not poor), int(bad)))
    docs += [(900, None, "en", None, 0), (901, "", None, "s1", 0), (902, "x" * 700 + " " + "ab" * 300 + " 12345", "en", "s1", 0), (903, "123 456", None, "s2", 7)]
    d = tmp_path_factory.mktemp("registered")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    vectors = [(k, [rng.uniform(-1, 1) for _ in range(16)], k % 3) for k in range(260)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d), {x[0]: x for x in docs}


def rows(spark, tables, name):
    return queries.QUERIES[name](spark, tables[0]).collect()


def test_op1(spark, tables):
    docs = tables[1]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, tables, "op1_jaccard_join")}
    assert got == brute({k: x[1] for k, x in docs.items()}, 3, 90, 100)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables[0]}/documents.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(queries.SQL["op1_jaccard_join"]).fetchall()} == got


def test_op3(spark, tables):
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, tables, "op3_bpe")
    assert len(got) == len(tables[1])
    for r in got:
        ids = plain.encode_ordinary(tables[1][r.doc_id][1] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((tables[1][r.doc_id][1] or "").encode()).hexdigest()


@pytest.mark.parametrize("name, label, of, threshold", [("op4_toxicity", "toxic", toxicity, 0.5), ("op8_quality", "quality", quality, 0.3)])
def test_classifiers(spark, tables, name, label, of, threshold):
    """Scores are those of a model that has seen the learning fold only, computed text by text."""
    got, docs = rows(spark, tables, name), spark.read.parquet(f"{tables[0]}/documents.parquet")
    model = of.train(docs, spark.read.parquet(f"{tables[0]}/labels.parquet"), label, crc_fold("doc_id", 5) != 0)
    scorer = toxicity._Scorer(__import__("pickle").loads(model)) if of is toxicity else quality._scorer(model)
    for r in got:
        one = scorer(*utf8(pa.array([tables[1][r.doc_id][1]], pa.large_string())))[0]
        assert (r.held_out, r.score, r.predicted) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0, pytest.approx(one, abs=1e-9), int(r.score >= threshold))
    assert len(got) == len(tables[1])


def test_op5(spark, tables):
    got = {r.doc_id: r for r in rows(spark, tables, "op5_language")}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (900, 901, 903))
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    held = [r.lang_pred == tables[1][k][2] for k, r in got.items() if r.held_out and k < 900]
    assert sum(held) > 0.95 * len(held) and len(got) == len(tables[1])


def test_op6(spark, tables):
    got = rows(spark, tables, "op6_top_k")
    v = {r.vec_id: [int(np.floor(256 * float(x))) for x in r.embedding] for r in spark.read.parquet(f"{tables[0]}/embeddings.parquet").collect()}
    for q in range(0, 260, 50):
        want = sorted((-sum(a * b for a, b in zip(v[q], v[k])), k) for k in v if k != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_op10(spark, tables):
    by_text: dict = {}
    for r in rows(spark, tables, "op10_media"):
        raw = (tables[1][r.doc_id][1] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes > r.payload_bytes and by_text.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert len({x[0] for x in by_text.values()}) == len(by_text)


def test_plain_ftrl():
    """The model against FTRL-proximal with one coordinate at a time."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "snarl" if k % 3 == 0 else "ee"]) for _ in range(8)) for k in range(60)]
    y = [str(int("snarl" in t)) for t in texts]
    got = __import__("pickle").loads(toxicity.fit(pa.array(texts, pa.large_string()), y, [0.5] * 60))
    features = [sorted(set(toxicity.occurrences(*utf8(pa.array([t], pa.large_string())))[0].tolist())) for t in texts]
    share = sum(map(int, y)) / 60
    z, n, order = {}, {}, np.random.default_rng(5)
    weight = lambda k, l1=toxicity.L1, l2=toxicity.L2: 0.0 if abs(z.get(k, 0.0)) <= l1 else (np.sign(z[k]) * l1 - z[k]) / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA + l2)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(60):
            w = {f: weight(f) for f in features[k]} | {"bias": weight("bias", 0.0, 0.0)}
            g = (1 / (1 + np.exp(-sum(w.values()))) - int(y[k])) * (0.5 / share if y[k] == "1" else 0.5 / (1 - share))
            for f, x in w.items():
                before = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / toxicity.ALPHA * x
                n[f] = before + g * g
    want = {k: weight(k) for k in z if k != "bias" and abs(z[k]) > toxicity.L1}
    assert sorted(want) == got["at"].tolist() and np.allclose([want[k] for k in sorted(want)], got["w"], atol=1e-5)
    assert got["bias"] == pytest.approx(weight("bias", 0.0, 0.0))


def test_features_of_a_text():
    text = "Snarling dogs, snarling   cats - and Dogs"
    w = [x.lower() for x in re.findall(r"[0-9A-Za-z\x80-\xff]+", text)]
    want = [("w", x) for x in w] + [("s", n, x[:n]) for n in toxicity.STEMS for x in w if len(x) > n] + [("p", g, a, b) for g in (1, 2) for a, b in zip(w, w[g:])]
    got, row = toxicity.occurrences(*utf8(pa.array([text, "", text], pa.large_string())))
    once = got[row == 0].tolist()
    assert sorted(once) == sorted(got[row == 2].tolist()) and len(once) == len(want)
    assert len(set(once)) == len(set(want))


def test_plain_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 2] > 0.3) ^ (rng.random(300) < 0.05)).astype(float)
    m = quality.fit_trees(x, y)
    walk = []
    for v in x:
        total = m["base"]
        for f, cut, value in zip(m["feature"], m["cut"], m["value"]):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(v[f[node]] > cut[node])
            total += value[node - len(f)]
        walk.append(total)
    assert np.allclose(walk, quality.predict(m, x))
    p = y.mean()
    g, h, best = p - y, np.full(300, p * (1 - p)), (0.0, None, None)
    for f in range(4):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])):
            a = x[:, f] <= cut
            if min(a.sum(), (~a).sum()) >= quality.MIN_ROWS:
                part = lambda s: g[s].sum() ** 2 / (h[s].sum() + quality.L2)
                gain = part(a) + part(~a) - g.sum() ** 2 / (h.sum() + quality.L2)
                best = max(best, (gain, f, cut))
    assert (m["feature"][0][0], m["cut"][0][0]) == (best[1], pytest.approx(best[2]))


def test_statistics_of_a_text():
    text = "Two words.\nTwo words. ABC 12 {x} ### is it!\n\nlast"
    s = dict(zip(quality.NAMES, quality.statistics(*utf8(pa.array([text], pa.large_string())))[0]))
    w, lines = text.split(), [x for x in text.split("\n") if x]
    assert s["log_bytes"] == pytest.approx(np.log1p(len(text))) and s["log_words"] == pytest.approx(np.log1p(len(w))) and s["word_length"] == pytest.approx(np.mean([len(x) for x in w]))
    assert s["upper"] == pytest.approx(sum(c.isupper() for c in text) / len(text)) and s["digit"] == pytest.approx(2 / len(text)) and s["lines"] == len(lines)
    assert s["distinct_words"] == pytest.approx(len({x.lower() for x in w}) / len(w)) and s["distinct_lines"] == pytest.approx(len(set(lines)) / len(lines)) and s["longest_word"] == max(map(len, w))
    assert s["stop_end"] == pytest.approx(2 / len(w)) and s["bang"] == pytest.approx(1 / len(w)) and s["short_words"] == pytest.approx(sum(len(x) <= 3 for x in w) / len(w))
    pairs = list(zip([x.lower() for x in w], [x.lower() for x in w[1:]]))
    assert s["repeated_pairs"] == pytest.approx(1 - len(set(pairs)) / len(pairs)) and s["word_length_deviation"] == pytest.approx(np.std([len(x) for x in w]))


def test_plain_language_scores():
    """Words scored one at a time by their n-grams, held to the languages of their script, then the best path of all."""
    rng = random.Random(6)
    words = {"en": ["water", "house", "green"], "de": ["wasser", "haus", "grün"], "el": ["νερό", "σπίτι", "φως"]}
    texts = [" ".join(rng.choice(words[k]) for _ in range(12)) for k in words for _ in range(20)]
    model = __import__("pickle").loads(raw := language.fit(pa.array(texts, pa.large_string()), [k for k in words for _ in range(20)], [1 / 3] * 60))
    langs, of = model["langs"], language._Labeller(raw)
    script = {"en": "Latin", "de": "Latin", "el": "Greek"}
    assert {k: {n for n, a in zip(language._names, model["allowed"][:, i]) if a} for i, k in enumerate(langs)} == {k: {script[k]} for k in langs}
    for text in ("water haus grün νερό house", "Wasser νερό φως green", "日本 water", "φως"):
        score = []
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            c = [1, *map(ord, w), 1]
            total = np.zeros(len(langs))
            for k in range(1, language.ORDER + 1):
                for at in range(len(c) - k + 1):
                    if k == 1 and c[at] == 1:
                        continue
                    h = 0
                    for x in c[at : at + k]:
                        h = (h * 0x9E3779B97F4A7C15 + x + 1) % 2**64
                    g = int(language.mix(np.array([(h + k - 1) % 2**64], dtype=np.uint64))[0]) >> (64 - language.BITS)
                    entries = range(model["first"][g], model["first"][g + 1])
                    total += model["base"] * (len(entries) > 0)
                    for z in entries:
                        total[model["lang"][z]] += model["value"][z]
            kind = language._names[language._script[np.searchsorted(language._first, ord(w[0]), side="right") - 1]]
            ok = np.array([script[k] == kind for k in langs])
            score.append(np.maximum(np.where(ok, total - total[ok].max(initial=-np.inf), -np.inf), -language.CLIP) if ok.any() else np.zeros(len(langs)))
        best = {(): 0.0}
        for s in score:
            best = {p + (j,): v + s[j] - language.PENALTY * (p != () and p[-1] != j) for p, v in best.items() for j in range(len(langs))}
        got = of(*utf8(pa.array([text], pa.large_string())))[2][3].tolist()
        assert best[tuple(got)] == pytest.approx(max(best.values()), abs=1e-4)


def test_many_languages(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{rng.choice('aeiou')}{chr(97 + k % 26)}" for _ in range(30)), f"l{k % 300:03d}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.label_languages(df.drop("lang"), language.train(df, F.lit(True)), spans=False).collect()
    assert len(got) == 600 and sum(r.lang_pred == f"l{r.doc_id % 300:03d}" for r in got) > 300
