"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words (runs of letters and digits, A-Z lower-cased), their first 4 to 8 bytes (for inflected
forms), pairs of neighbours and pairs with one word between, each hashed to ``BITS`` bits and counted once a text. FTRL-proximal keeps for each coordinate a
sum of gradients z and of their squares n; the weight is 0 while |z| <= L1 and else -(z - sign(z) L1) / ((BETA + sqrt(n)) / ALPHA + L2),
so frequent features get small steps, and most weights stay 0. What is broadcast is the list of non-zero weights, at most 2^BITS.

Learning reads a bounded sample, at most ``PER_CLASS`` labelled texts of each class (all, if fewer; ``common.SAMPLE_BYTES`` in all), ``EPOCHS`` times in one task, with both
classes weighing half. Scoring is one pass over whole texts without a shuffle.

Defined results: null and empty texts get the intercept's score; without labels of both classes every score is the share of
label 1 (about 0 without labels); repeated rows get equal scores. Other columns are kept; score is replaced.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fitted, free_names, labelled_sample, mix, slices, tidy, utf8, word_hashes, words

BITS, ALPHA, BETA, L1, L2, EPOCHS, PER_CLASS = 20, 0.3, 1.0, 8.0, 1.0, 4, 3000
STEMS = (4, 5, 6, 7, 8)

_OTHER = np.ones(256, dtype=bool)
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def occurrences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature and row of every occurrence in a run of rows."""
    s, e, row = words(data, off, _OTHER)
    h = word_hashes(data, s, e)
    out, rows = [h], [row]
    for size in STEMS:
        long = e - s > size
        out.append(mix(word_hashes(data, s[long], s[long] + size) + np.uint64(size)))
        rows.append(row[long])
    for gap in (1, 2):
        if len(h) > gap:
            ok = row[:-gap] == row[gap:]
            out.append(mix(h[:-gap][ok] + h[gap:][ok] * np.uint64(0xA24BAED4963EE407 + 2 * gap)))
            rows.append(row[:-gap][ok])
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows)


def once(f: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once a row, by row."""
    key = np.unique((row << BITS) | f)
    return key & ((1 << BITS) - 1), key >> BITS


def fit(texts: pa.Array, y: list[str], prior: list[float]) -> bytes:
    target = np.array([float(v) > 0 for v in y], dtype=np.float64)
    share = {v: p for v, p in zip(y, prior)}
    positive = sum(p for v, p in share.items() if float(v) > 0)
    if not len(y) or target.min() == target.max():
        return pickle.dumps({"at": np.zeros(0, np.int64), "w": np.zeros(0, np.float32), "bias": float(np.log((positive + 1e-9) / (1 - positive + 1e-9)))})
    rows: list = []
    data, off = utf8(texts)
    for i, j in slices(off):
        f, r = once(*occurrences(data[off[i] : off[j]], off[i : j + 1] - off[i]))
        cut = np.searchsorted(r, np.arange(j - i + 1))
        rows += [f[a:b] for a, b in zip(cut[:-1], cut[1:])]
    sampled = target.mean()
    weight = np.where(target > 0, 0.5 / sampled, 0.5 / (1 - sampled))
    z, n, bias_z, bias_n, rng = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, np.random.default_rng(5)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            f = rows[k]
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) <= L1, 0.0, (np.sign(zf) * L1 - zf) / ((BETA + np.sqrt(nf)) / ALPHA + L2))
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - target[k]
            g *= weight[k]
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / ALPHA * w
            n[f] = nf + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    at = np.flatnonzero(np.abs(z) > L1)
    w = (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
    bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
    return pickle.dumps({"at": at, "w": w.astype(np.float32), "bias": float(bias)})


def train(docs: DataFrame, labels: DataFrame, label: str, fold: Column, per_class: int = PER_CLASS) -> bytes:
    return fitted(labelled_sample(docs, labels, label, fold, per_class), fit)


def score(df: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """df without its text, with ``score``, the probability of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return scored(df, text, lambda: _Scorer(pickle.loads(shared.value)))


def scored(df: DataFrame, text: str, scorer, keep_text: bool = False, name: str = "score") -> DataFrame:
    """df with the column ``name``, which replaces one of that name, from scorer()(bytes, offsets) over slices of rows."""
    kept = [f for f in df.schema.fields if f.name != name and (keep_text or f.name != text)]

    def run(batches):
        of = scorer()
        for b in batches:
            data, off = utf8(b.column(text))
            out = np.empty(b.num_rows)
            for i, j in slices(off):
                out[i:j] = of(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(out)], names=[*(f.name for f in kept), name])

    return df.mapInArrow(tidy(run), T.StructType([*kept, T.StructField(name, T.DoubleType())]))


class _Scorer:
    def __init__(self, m: dict):
        self.w, self.bias = np.zeros(1 << BITS, dtype=np.float32), m["bias"]
        self.w[m["at"]] = m["w"]

    def __call__(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        f, row = occurrences(data, off)
        live = self.w[f] != 0
        f, row = once(f[live], row[live])
        total = np.bincount(row, weights=self.w[f], minlength=len(off) - 1) if len(f) else np.zeros(len(off) - 1)
        return np.round(1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35))), 9)


def reject_toxic(docs: DataFrame, labels: DataFrame, fold: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """docs, with the same columns, without the documents whose score is threshold or more."""
    model = train(docs, labels, "toxic", F.lit(True) if fold is None else fold)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), free_names(docs, ["score"])["score"]
    return scored(docs, "text", lambda: _Scorer(pickle.loads(shared.value)), keep_text=True, name=name).filter(F.col(name) < threshold).drop(name)
