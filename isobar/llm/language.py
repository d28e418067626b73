"""Language identification of mixed-language text.

A word is a run of letters. Its script (a range of code points, by its first letter) leaves as candidates the languages that
use the script; each candidate scores the word by the log-probabilities of its hashed character 1- to ``ORDER``-grams, with word bounds,
held within ``CLIP`` of the best. Viterbi then labels the words of a text with the languages whose scores sum to the most, less
``PENALTY`` for each change of language, so a span of another language is found if it is long enough, and single odd words are not. The
text's language is the one of most letters.

All texts of a slice go through Viterbi together: their words are cut in segments of ``SEGMENT``; for each segment and each language
before it, the best scores are found at once, one numpy step for each place in a segment, and joined in order; then back pointers are kept, a bit for each word and language.
N-grams are looked up for distinct words only, ``GRAM_CELLS`` of their letters at once, when learning too.

Learning reads a bounded sample, at most ``PER_LANGUAGE`` texts of each language (all, if fewer; ``MAX_SAMPLE`` texts in all, but at least one a language, and ``common.SAMPLE_BYTES``). The model is a sparse table of
2^BITS rows with a number for each language that has such an n-gram, whatever the number of languages, and is broadcast; the sample bounds it. Prediction is one pass over whole texts without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0; so are all texts if nothing could be learned; of
languages with equally many letters, the first by code point wins; words of a script that no language uses count for all languages alike.
Repeated rows get equal results. Other columns are kept; lang_pred, score and spans are replaced.
"""

from __future__ import annotations

import pickle
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, fitted, mix, sampled, slices, tidy, utf8, word_hashes

BITS, ORDER, CLIP, PENALTY, SEGMENT, PER_LANGUAGE, MAX_SAMPLE, SCRIPT_SHARE = 18, 4, 8.0, 12.0, 128, 1500, 60_000, 0.01
CELLS = 1 << 20  # numbers of the segments at once in Viterbi
GRAM_CELLS = 1 << 16  # letters, times languages where words are scored, of the words whose n-grams are looked up at once

#: First code points of ranges, and the script that starts there (after the Unicode blocks).
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Other"), (0x08A0, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x2E80, "Han"), (0x3040, "Kana"),
    (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF65, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x30000, "Other"),
]
_names = sorted({n for _, n in SCRIPTS})
_first = np.array([a for a, _ in SCRIPTS])
_script = np.array([_names.index(n) for _, n in SCRIPTS])
_tables: list = []


def _chars() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and its lower case where that is one code point."""
    if not _tables:
        letter, lower = np.zeros(0x110000, dtype=bool), np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                letter[c] = True
                low = chr(c).lower()
                if len(low) == 1:
                    lower[c] = ord(low)
        _tables.extend((letter, lower))
    return _tables[0], _tables[1]


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a run of rows, and the rows' offsets in them."""
    lead = (data & 0xC0) != 0x80
    before = np.append(0, np.cumsum(lead))
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32), before[off]


def _words(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, and start, length and row of each word."""
    letter, lower = _chars()
    inside = letter[cp]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    start[off[:-1][full]] = inside[off[:-1][full]]
    end[off[1:][full] - 1] = inside[off[1:][full] - 1]
    s = np.flatnonzero(start)
    return lower[cp], s, np.flatnonzero(end) + 1 - s, np.searchsorted(off, s, side="right") - 1


def _distinct(cp: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of an occurrence of each distinct word, and for each word its place among them."""
    h = word_hashes(np.ascontiguousarray(cp).view(np.uint8), 4 * s, 4 * (s + n), lower=False)
    _, first, place = np.unique(h, return_index=True, return_inverse=True)
    return first, place


def _runs(size: np.ndarray):
    """Ranges (a, b) of words that have about ``GRAM_CELLS`` of the given sizes together, or one word: n-grams take many times the memory of their words."""
    before, a = np.append(0, np.cumsum(size + 2)), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(before, before[a] + GRAM_CELLS, side="right")) - 1)
        yield a, b
        a = b


def _grams(cp: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the given words with a bound on either side, and the word of each."""
    size = n + 2
    begin = np.cumsum(size) - size
    word = np.repeat(np.arange(len(s)), size)
    at = np.arange(len(word)) - begin[word]
    bound = (at == 0) | (at == size[word] - 1)
    c = np.where(bound, 1, cp[np.minimum(np.where(bound, 0, s[word] + at - 1), len(cp) - 1)]).astype(np.uint64)
    out, of, h = [], [], np.zeros(len(c), dtype=np.uint64)
    for k in range(ORDER):
        h = h[: len(c) - k] * np.uint64(0x9E3779B97F4A7C15) + c[k:] + np.uint64(1)
        ok = word[: len(h)] == word[k:]
        if k == 0:
            ok &= ~bound
        out.append(mix(h[ok] + np.uint64(k)) >> np.uint64(64 - BITS))
        of.append(word[: len(h)][ok])
    return np.concatenate(out).astype(np.int64), np.concatenate(of)


def fit(texts: pa.Array, y: list[str], prior: list[float]) -> bytes:
    """The sparse table: bucket g has the entries first[g] .. first[g + 1] of lang and value, log-probabilities above base, that of an n-gram that a language lacks."""
    langs = sorted(set(y))
    scripts, keys, times = np.zeros((len(_names), len(langs))), np.zeros(0, dtype=np.int64), np.zeros(0)
    place = {v: k for k, v in enumerate(langs)}
    code = np.array([place[v] for v in y], dtype=np.int64)
    data, off = utf8(texts)
    for i, j in slices(off):
        cp, o = code_points(data[off[i] : off[j]], off[i : j + 1] - off[i])
        cp, s, n, row = _words(cp, o)
        if len(s):
            k = code[i:j][row]
            first, place = _distinct(cp, s, n)
            pair, often = np.unique(place * len(langs) + k, return_counts=True)  # each word of a language once
            first, of = first[pair // len(langs)], pair % len(langs)
            found = [(keys, times)]
            for a, b in _runs(n[first]):
                f, w = _grams(cp, s[first[a:b]], n[first[a:b]])
                at, back = np.unique(f * len(langs) + of[a:b][w], return_inverse=True)
                found.append((at, np.bincount(back, often[a:b][w])))
            keys, back = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            times = np.bincount(back, np.concatenate([x for _, x in found]))
            np.add.at(scripts, (_script[np.searchsorted(_first, cp[s], side="right") - 1], k), n)
    bucket, lang = keys // max(1, len(langs)), keys % max(1, len(langs))
    base = -np.log(2 * np.bincount(lang, times, len(langs)) + (1 << BITS))
    first = np.searchsorted(bucket, np.arange((1 << BITS) + 1))
    allowed = scripts > SCRIPT_SHARE * scripts.sum(axis=0, keepdims=True)
    return pickle.dumps({"langs": langs, "base": base, "first": first.astype(np.int32), "lang": lang.astype(np.int32), "value": np.log(2 * times + 1).astype(np.float32), "allowed": allowed})


def train(docs: DataFrame, fold: Column, per_language: int = PER_LANGUAGE) -> bytes:
    """Learns from the text and non-null lang of the documents of the fold; an id with several languages counts in each, with one text of each."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & fold).select("doc_id", F.col("lang").alias("y")).distinct()
    return fitted(sampled(docs.select("doc_id", "text", F.col("lang").alias("y")), known, ["doc_id", "y"], per_language, MAX_SAMPLE), fit)


def viterbi(score: np.ndarray, row: np.ndarray, penalty: float = PENALTY, place: np.ndarray | None = None) -> np.ndarray:
    """Best label of each word: score is words x labels (of each word's place, if given), row the text of each word, ascending."""
    n, k = len(row), score.shape[1]
    place = np.arange(n) if place is None else place
    first = np.ones(n, dtype=bool)
    first[1:] = row[1:] != row[:-1]
    text_at = np.flatnonzero(first)
    at = np.flatnonzero((np.arange(n) - np.repeat(text_at, np.diff(np.append(text_at, n)))) % SEGMENT == 0)
    size, text = np.diff(np.append(at, n)), np.cumsum(first)[at] - 1
    n_seg = np.bincount(text)
    seg_at = np.cumsum(n_seg) - n_seg
    # forward: what each segment adds from each label before it to each at its end, a bounded number of segments at once; then its text's best scores before it
    enter, total, some = np.zeros((len(at), k)), np.zeros((len(n_seg), k)), max(1, CELLS // (k * k))
    for low in range(0, len(at), some):
        segs = np.arange(low, min(low + some, len(at)))
        order = segs[np.argsort(-size[segs], kind="stable")]
        v = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(len(order), axis=0)
        for t in range(int(size[order[0]])):
            m = int(np.searchsorted(-size[order], -t, side="left"))
            v[:m] = np.maximum(v[:m], v[:m].max(axis=2, keepdims=True) - penalty) + score[place[at[order[:m]] + t]][:, None, :]
        back = np.empty(len(order), dtype=np.int64)
        back[order - low] = np.arange(len(order))
        turn = segs - np.maximum(seg_at[text[segs]], low)
        by_turn = np.argsort(turn, kind="stable")
        for live in np.split(segs[by_turn], np.flatnonzero(np.diff(turn[by_turn])) + 1):
            enter[live] = total[text[live]]
            total[text[live]] = (enter[live][:, :, None] + v[back[live - low]]).max(axis=1)
    # again from these scores, keeping for each word and label whether it stayed, and for each word the best label before it
    order = np.argsort(-size, kind="stable")
    start, length = at[order], -size[order]
    v, stay, best = enter[order], np.empty((n, k), dtype=bool), np.empty(n, dtype=np.int32)
    for t in range(-int(length[0])):
        m = int(np.searchsorted(length, -t, side="left"))
        w, b = start[:m] + t, v[:m].argmax(axis=1)
        top = np.take_along_axis(v[:m], b[:, None], axis=1) - penalty
        stay[w], best[w] = v[:m] >= top, b
        v[:m] = np.maximum(v[:m], top) + score[place[w]]
    # backward: the label before each segment for each at its end; then the labels at the ends, from the last segment of a text to its first; then all
    came = np.arange(k)[None].repeat(len(at), axis=0)
    for t in range(-int(length[0]) - 1, -1, -1):
        m = int(np.searchsorted(length, -t, side="left"))
        w = start[:m] + t
        came[:m] = np.where(np.take_along_axis(stay[w], came[:m], axis=1), came[:m], best[w][:, None])
    before = np.empty_like(came)
    before[order] = came
    end, now, by_size = np.empty(len(at), dtype=np.int64), total.argmax(axis=1), np.argsort(-n_seg, kind="stable")
    for t in range(int(n_seg.max()) - 1, -1, -1):
        live = by_size[: int(np.searchsorted(-n_seg[by_size], -t, side="left"))]
        g = seg_at[live] + t
        end[g] = now[live]
        now[live] = before[g, now[live]]
    out, now = np.empty(n, dtype=np.int64), end[order]
    for t in range(-int(length[0]) - 1, -1, -1):
        m = int(np.searchsorted(length, -t, side="left"))
        w = start[:m] + t
        out[w] = now[:m]
        now[:m] = np.where(stay[w, now[:m]], now[:m], best[w])
    return out


class _Labeller:
    def __init__(self, model: bytes):
        m = pickle.loads(model)
        self.langs, self.allowed, self.base, self.first, self.lang, self.value = (m[k] for k in ("langs", "allowed", "base", "first", "lang", "value"))
        self.limit = SLICE_BYTES * 16 // max(16, len(self.langs))

    def scores(self, f: np.ndarray, w: np.ndarray, n_words: int) -> np.ndarray:
        """Sums of the log-probabilities of the n-grams f of words w, for each language; n-grams that no language has count for all alike."""
        k = len(self.langs)
        size = self.first[f + 1] - self.first[f]
        seen = np.bincount(w, size > 0, n_words)
        at = np.repeat(self.first[f] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return seen[:, None] * self.base + np.bincount(np.repeat(w, size) * k + self.lang[at], self.value[at], n_words * k).reshape(n_words, k)

    def __call__(self, data: np.ndarray, off: np.ndarray):
        """For each row its language and score; and the words: start, length (code points), row, label."""
        k, rows = len(self.langs), len(off) - 1
        cp, o = code_points(data, off)
        none = np.zeros(0, dtype=np.int64)
        if not k or not len(cp):
            return ["und"] * rows, np.zeros(rows), (none, none, none, none)
        cp, s, n, row = _words(cp, o)
        if not len(s):
            return ["und"] * rows, np.zeros(rows), (none, none, none, none)
        first, place = _distinct(cp, s, n)
        score = np.empty((len(first), k))
        for a, b in _runs(n[first] * k):
            score[a:b] = self.scores(*_grams(cp, s[first[a:b]], n[first[a:b]]), b - a)
        script = _script[np.searchsorted(_first, cp[s[first]], side="right") - 1]
        allowed = self.allowed[script]
        score = np.where(allowed, score, -np.inf)
        score = np.maximum(score - score.max(axis=1, keepdims=True, initial=-1e30), -CLIP)
        score[~allowed.any(axis=1)] = 0
        label = viterbi(score, row, place=place)
        letters = np.bincount(row * k + label, weights=n, minlength=rows * k).reshape(rows, k)
        total = letters.sum(axis=1)
        best = letters.argmax(axis=1)
        share = np.round(letters[np.arange(rows), best] / np.maximum(total, 1), 9)
        return [self.langs[b] if t else "und" for b, t in zip(best, total)], np.where(total > 0, share, 0.0), (s - o[row], n, row, label)

    def spans(self, words, rows: int) -> list[list[dict]]:
        """Runs of words of one language: start and stop in code points of the text, and the language."""
        s, n, row, label = words
        out: list[list[dict]] = [[] for _ in range(rows)]
        if len(s):
            new = np.ones(len(s), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (label[1:] != label[:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(s)) - 1
            for r, a, b, x in zip(row[at].tolist(), s[at].tolist(), (s[last] + n[last]).tolist(), label[at].tolist()):
                out[r].append({"start": a, "stop": b, "lang": self.langs[x]})
        return out


def label_languages(df: DataFrame, model: bytes, text: str = "text", spans: bool = True) -> DataFrame:
    """df without its text, with lang_pred and score (the share of letters), and if asked for spans (start, stop, lang)."""
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("lang", T.StringType())])
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + [T.StructField("spans", T.ArrayType(span))] * spans
    kept = [f for f in df.schema.fields if f.name not in {text, "lang_pred", "score", "spans"}]
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        of = _Labeller(shared.value)
        for b in batches:
            data, off = utf8(b.column(text))
            for i, j in slices(off, of.limit):
                langs, score, found = of(data[off[i] : off[j]], off[i : j + 1] - off[i])
                part = b.slice(i, j - i)
                cols = [pa.array(langs, pa.string()), pa.array(score)] + ([pa.array(of.spans(found, j - i), kind)] if spans else [])
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *cols], names=[*(f.name for f in kept), *(f.name for f in new)])

    return df.mapInArrow(tidy(run), T.StructType([*kept, *new]))
