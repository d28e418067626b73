import base64
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from isobar.llm import bpe, language, media, quality, toxicity
from isobar.llm.common import crc_fold, utf8

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts() -> list[str]:
    rng = random.Random(4)
    out = ["", " ", "a" * 900, "  \n\n x  ", "\x1c a\x1d\x1fb", "don't we'll 'LL", " 　 x", "é" * 400, "1234 567½ ٣٤", "😀 👨‍👩‍👧", "<|endoftext|>", "a\xa0b\x85c", "word " * 4000, "x" * 30000]
    out += ["".join(rng.choice("aAé 's\n\t　1½😀.,lre\xa0") for _ in range(rng.randint(0, 50))) for _ in range(300)]
    return out + ["".join(rng.choice("abtheinon") for _ in range(rng.randint(200, 900))) for _ in range(6)]


def test_bpe_equals_tiktoken_and_round_trips(spark, reference):
    texts = odd_texts()
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate([*texts, None])], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in bpe.encoded(df, VOCABULARY, public_tokenizers.PATTERN).collect()}
    for k, t in enumerate([*texts, ""]):
        want = reference.encode_ordinary(t)
        r = got[k]
        assert (list(r.ids), r.n_tokens) == (want, len(want))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = bpe.decode(bpe.encode(df.select("doc_id", "text"), VOCABULARY, public_tokenizers.PATTERN), VOCABULARY, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert bpe.digests(df.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def labelled(n: int = 400):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        bad, poor = k % 3 == 0, k % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["grunt", "snarl", "hiss"])
        text = " ".join(f"{x}$$$" for x in w) if poor else " ".join(w) + "."
        rows.append((k, text, "en", "s"))
        labels.append((k, int(not poor), int(bad)))
    return rows + [(5000, None, None, None), (5001, "", "en", "s"), (5002, "z " * 20000, "en", "s"), (None, "w1 w2", "en", "s")], labels + [(None, 1, 1), (9999, None, None), (1, 0, 0)]


@pytest.mark.parametrize("module, label, threshold", [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_classifiers(spark, module, label, threshold):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = module.train(docs, lab, label, crc_fold("doc_id", 5) != 0)
    got = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    truth = {i: v for i, q, t in labels if i is not None and i < 5000 for v in [q if label == "quality" else t]}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= threshold) == truth[i] for i in held]) > 0.9
    assert module.score(docs.limit(0), model).count() == 0
    nothing = module.train(docs, lab.limit(0), label, F.lit(True))
    assert all(s < 0.01 for s in (r.score for r in module.score(docs, nothing).collect()))


def test_rejecting_keeps_columns(spark):
    rows, labels = labelled(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a, b = toxicity.reject_toxic(docs, lab), quality.reject_poor(docs, lab)
    assert a.columns == b.columns == docs.columns
    left = {r.doc_id for r in b.collect()}
    assert sum(k % 4 == 0 for k in left if k is not None and k < 5000) <= 3 and sum(k % 4 > 0 for k in left if k is not None and k < 5000) >= 85


def brute_viterbi(score, penalty):
    best, paths = list(score[0]), [[k] for k in range(len(score[0]))]
    for row in score[1:]:
        options = [max((best[p] - penalty * (p != k), -abs(p - k), p) for p in range(len(row))) for k in range(len(row))]
        paths = [[*paths[o[2]], k] for k, o in enumerate(options)]
        best = [o[0] + row[k] for k, o in enumerate(options)]
    return max(best)


def test_viterbi_is_optimal(monkeypatch):
    monkeypatch.setattr(language, "SEGMENT", 4)
    rng = np.random.default_rng(1)
    score, row = rng.normal(size=(150, 3)).astype(np.float32) * 3, np.sort(rng.integers(0, 10, 150))
    label = language.viterbi(score, row, 2.0)
    for r in np.unique(row):
        s, at = score[row == r], label[row == r]
        assert s[np.arange(len(s)), at].sum() - 2.0 * (at[1:] != at[:-1]).sum() == pytest.approx(brute_viterbi(s, 2.0), abs=1e-3)


def test_language_spans(spark):
    en, fr, ru = "the quick brown thing with that", "le petit chat dans une maison", "быстрая лиса прыгает через забор"
    rows = [(k, " ".join([t] * 5), l) for k in range(60) for t, l in [[(en, "en"), (fr, "fr"), (ru, "ru")][k % 3]]]
    rows += [(100, None, "en"), (101, "12 ..", "en"), (102, "", None), (103, f"{en} {en} {fr} {fr}", None), (None, en, "xx"), (104, "λόγος", None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    model = language.train(docs, crc_fold("doc_id", 4) != 2)
    got = {r.doc_id: r for r in language.label_languages(docs, model).collect()}
    assert all(got[k].lang_pred == ["en", "fr", "ru"][k % 3] and got[k].score == 1.0 for k in range(60))
    assert [got[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0.0
    assert [s.lang for s in got[103].spans] == ["en", "fr"] and got[103].spans[0].start == 0 and got[103].spans[1].stop == len(f"{en} {en} {fr} {fr}")
    assert got[104].lang_pred in ("en", "fr", "ru")
    assert language.label_languages(docs.limit(0), model).count() == 0
    nothing = language.train(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.label_languages(docs, nothing).collect()} == {"und"}


def test_media_round_trip(spark):
    texts = ["", None, "é" * 287, "x" * 576, "y" * 577, "z" * (576 * 130 + 3), "same", "same"]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, codec string")
    stored = media.store_texts(df)
    for r in media.media_columns(stored).collect():
        raw = (texts[r.doc_id] or "").encode()
        want = media.padded(raw)
        data = bytes(r.media)
        assert r.codec == "raw " and r.error is None and r.samples * 576 == len(want) and r.n_bytes == len(raw)
        assert r.duration == pytest.approx(r.samples / media.RATE) and len(r.keyframes) == -(-r.samples // media.KEY_EVERY)
        assert all(data[k.start : k.stop] == want[n * 16 * 576 : n * 16 * 576 + 576] for n, k in enumerate(r.keyframes))
    d = {r.doc_id: r for r in media.media_digests(stored).collect()}
    for k, t in enumerate(texts):
        want = media.padded((t or "").encode())
        assert (d[k].payload_bytes, d[k].payload_sha256, d[k].tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
    assert d[6][1:] == d[7][1:] and media.media_digests(media.store_texts(df.limit(0))).count() == 0


def test_broken_containers(spark):
    good = media.wrap(media.padded(b"abc"))
    rows = [(0, None), (1, b""), (2, b"abc"), (3, good[:-9]), (4, good[: len(good) - 40] + b"\xff" * 40), (5, bytes(40)), (6, good)]
    got = {r.id: r for r in media.media_columns(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert all(got[k].error and got[k].codec is None for k in (0, 1, 2, 3, 5)) and got[6].error is None


def test_hostile_containers(spark):
    """Deep nesting and tables that claim more than there is are errors of their own row."""
    deep = b""
    for _ in range(1500):
        deep = media._box(b"moov", deep)
    good = media.wrap(body := media.padded(b"abc" * 900))
    n = len(body) // media.SAMPLE
    huge = good.replace(b"stsz" + bytes(4) + (576).to_bytes(4, "big") + n.to_bytes(4, "big"), b"stsz" + bytes(4) + (576).to_bytes(4, "big") + b"\xff" * 4)
    keys = -(-n // media.KEY_EVERY)
    zero = good.replace(b"stss" + bytes(4) + keys.to_bytes(4, "big") + (1).to_bytes(4, "big"), b"stss" + bytes(4) + keys.to_bytes(4, "big") + bytes(4))
    runs = good.replace(b"stsc" + bytes(4) + (1).to_bytes(4, "big") + (1).to_bytes(4, "big"), b"stsc" + bytes(4) + (1).to_bytes(4, "big") + (2).to_bytes(4, "big"))
    assert len({deep, good, huge, zero, runs}) == 5
    got = {r.id: r for r in media.media_columns(spark.createDataFrame(list(enumerate([deep, huge, zero, runs, good])), "id int, media binary")).collect()}
    assert all(got[k].error and got[k].tracks is None for k in range(4)) and got[4].error is None


def test_every_track_and_fragments(spark):
    body = media.padded(b"ab" * 9000)
    one = media.wrap(body)
    at = one.index(b"moov") + 4
    head = at + int.from_bytes(one[at : at + 4], "big")
    mvhd, video = one[at:head], one[head:]
    sound = video.replace(b"raw ", b"sowt").replace(b"stss", b"free")
    both = one[: at - 8] + media._box(b"moov", mvhd, sound, video)
    split = one + media._box(b"moof", media._full(b"mfhd", bytes(4)))
    empty = media._box(b"moov", mvhd, media._box(b"mvex"), media._box(b"trak", media._box(b"mdia", media._full(b"mdhd", bytes(20)))))
    df = spark.createDataFrame([(0, one), (1, both), (2, split), (3, empty)], "id int, media binary")
    got = {r.id: r for r in media.media_columns(df).collect()}
    n = len(body) // media.SAMPLE
    assert [(t.codec, t.samples, len(t.keyframes)) for t in got[1].tracks] == [("sowt", n, n), ("raw ", n, -(-n // media.KEY_EVERY))]
    assert got[1].tracks[1] == got[0].tracks[0] and got[1].tracks[0].codec == got[1].codec and got[1].error is None
    assert all("fragments" in got[k].error and got[k].tracks is None and got[k].samples is None for k in (2, 3))
    d = {r.id: r for r in media.media_digests(df.filter("id < 2")).collect()}
    assert d[1].payload_bytes == 2 * d[0].payload_bytes and d[1].feature.endswith("|" + d[0].feature) and d[1].feature.startswith("codec=sowt;")


def test_statistics_of_no_rows():
    assert quality.statistics(np.zeros(0, np.uint8), np.zeros(1, np.int64)).shape == (0, len(quality.NAMES))
    f, r = toxicity.occurrences(np.zeros(0, np.uint8), np.zeros(3, np.int64))
    assert len(f) == len(r) == 0
    assert pa.array([""]).type == pa.string()


def test_languages_of_many_words_in_bounded_memory(monkeypatch):
    """A slice of 1 MB takes far less than 100 MB for its n-grams, and how many words are looked up at once changes nothing."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefghé", k=rng.randint(3, 12))) for _ in range(25_000)) for _ in range(4)]
    column = pa.array(texts, pa.large_string())
    data, off = utf8(column)
    language._chars()
    results = []
    for cells in (language.GRAM_CELLS, 1 << 30):
        monkeypatch.setattr(language, "GRAM_CELLS", cells)
        tracemalloc.start()
        model = language.fit(column, ["a", "b", "c", "d"], [0.25] * 4)
        learnt = tracemalloc.get_traced_memory()[1]
        labeller = language._Labeller(model)
        tracemalloc.reset_peak()
        langs, score, words = labeller(data, off)
        results.append((model, langs, score.tolist(), [w.tolist() for w in words], learnt, tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
    assert results[0][:4] == results[1][:4]
    assert max(results[0][4:]) < 100 << 20 < min(results[1][4:]), [x[4:] for x in results]
