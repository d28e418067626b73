"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` computes ``NAMES`` for a run of rows at once from their bytes: sizes, shares of character kinds, word and line shapes,
and repetition. Each statistic is cut in up to ``BINS`` bins at quantiles of the sample; a tree grows level by level to ``DEPTH`` by the split
with the largest gain in each node, from histograms of gradients and Hessians; the trees are flattened in arrays of feature,
threshold and leaf value of complete trees, and all rows go down one level of a tree in one numpy step. The model has
a fixed size of TREES * 2^(DEPTH + 1) numbers, and is broadcast.

Learning reads a bounded sample, about ``PER_CLASS`` labelled texts of each class (all, if fewer), in one task; the intercept is shifted
to the classes' shares among all labels. Scoring is one pass over whole texts without a shuffle.

Defined results: null and empty texts have all statistics 0 and are scored as such; without labels of both classes every score is
the share of label 1 (0 without labels); repeated rows get equal scores. Other columns are kept; score is replaced.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, fitted, free_names, labelled_sample, slices, utf8, word_hashes, words
from .toxicity import scored

BINS, DEPTH, TREES, RATE, L2, MIN_ROWS, PER_CLASS = 64, 4, 60, 0.2, 1.0, 8, 3000
NAMES = (
    "log_bytes log_words word_length upper digit punctuation odd_symbol space beyond_ascii lines_per_word bars_per_word upper_words symbol_words "
    "distinct_words distinct_lines top_word short_words long_words longest_word bang stop_end brace hash_mark lines repeated_pairs word_length_deviation"
).split()

_kind = np.zeros((7, 256), dtype=bool)
_kind[0, 65:91] = True
_kind[1, 48:58] = True
_kind[2, [c for c in range(33, 127) if not chr(c).isalnum()]] = True
_kind[3, [ord(c) for c in "$%&*#@^~=_+<>\\|"]] = True
_kind[4] = _SPACE
_kind[5, 128:] = True
_kind[6, 10] = True


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x NAMES."""
    n = len(off) - 1
    size = np.diff(off)
    x = np.zeros((n, len(NAMES)))
    if not len(data):
        return x
    row_of = np.repeat(np.arange(n), size)
    counts = np.bincount(row_of * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    share = counts @ _kind.T / np.maximum(size, 1)[:, None]
    s, e, row = words(data, off)
    n_words = np.bincount(row, minlength=n)
    per = 1 / np.maximum(n_words, 1)
    length = (e - s).astype(np.float64)
    mean = np.bincount(row, length, n) * per
    first, last = data[s], data[np.maximum(e - 1, 0)]
    h = word_hashes(data, s, e)
    order = np.lexsort((h, row))
    hr, rr = h[order], row[order]
    new = np.ones(len(hr), dtype=bool)
    new[1:] = (hr[1:] != hr[:-1]) | (rr[1:] != rr[:-1])
    starts = np.flatnonzero(new)
    run = np.diff(np.append(starts, len(hr)))
    top = np.zeros(n)
    np.maximum.at(top, rr[starts], run)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    line_space = np.zeros(256, dtype=bool)
    line_space[[10, 13]] = True
    ls, le, lrow = words(data, off, line_space)
    lh = word_hashes(data, ls, le, lower=False)
    n_lines = np.bincount(lrow, minlength=n)
    lines = np.zeros(n)
    if len(lh):
        lo = np.lexsort((lh, lrow))
        ln = np.ones(len(lh), dtype=bool)
        ln[1:] = (lh[lo][1:] != lh[lo][:-1]) | (lrow[lo][1:] != lrow[lo][:-1])
        lines = np.bincount(lrow[lo][ln], minlength=n)
    pairs = np.zeros(n)
    if len(h) > 1:
        ok = row[1:] == row[:-1]
        p, pr = (h[:-1] * np.uint64(3) + h[1:])[ok], row[1:][ok]
        po = np.lexsort((p, pr))
        pn = np.ones(len(p), dtype=bool)
        pn[1:] = (p[po][1:] != p[po][:-1]) | (pr[po][1:] != pr[po][:-1])
        pairs = 1 - np.bincount(pr[po][pn], minlength=n) / np.maximum(np.bincount(pr, minlength=n), 1)
    bang, bar = last == 33, (length == 1) & (first == 124)
    columns = [
        np.log1p(size), np.log1p(n_words), mean, share[:, 0], share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5], counts[:, 10] * per, np.bincount(row, bar, n) * per,
        np.bincount(row, _kind[0][first] & ((length == 1) | _kind[0][data[np.minimum(s + 1, len(data) - 1)]]), n) * per, np.bincount(row, _kind[3][last], n) * per,
        np.bincount(rr[starts], minlength=n) * per, lines / np.maximum(n_lines, 1), top * per, np.bincount(row, length <= 3, n) * per, np.bincount(row, length >= 12, n) * per, longest,
        np.bincount(row, bang, n) * per, np.bincount(row, last == 46, n) * per, (counts[:, 123] + counts[:, 125]) / np.maximum(size, 1), counts[:, 35] / np.maximum(size, 1), n_lines, pairs,
        np.sqrt(np.maximum(np.bincount(row, length**2, n) * per - mean**2, 0)),
    ]
    for k, c in enumerate(columns):
        x[:, k] = c
    return x


def fit_trees(x: np.ndarray, y: np.ndarray) -> dict:
    """Flattened trees for logistic loss."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    base = np.log(y.mean() / (1 - y.mean()))
    score, inner, leaves = np.full(len(y), base), (1 << DEPTH) - 1, 1 << DEPTH
    out = {"feature": np.zeros((TREES, inner), dtype=np.int64), "cut": np.full((TREES, inner), np.inf), "value": np.zeros((TREES, leaves)), "base": base}
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for d in range(DEPTH):
            width = 1 << d
            best, feature, cut = np.full(width, 1e-6), np.zeros(width, dtype=np.int64), np.full(width, BINS)
            for f in range(x.shape[1]):
                key = node * BINS + binned[:, f]
                G, H, N = (np.bincount(key, w, width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (g, hess, np.ones(len(g))))
                gt, ht, nt = G[:, -1:], H[:, -1:], N[:, -1:]
                gain = G**2 / (H + L2) + (gt - G) ** 2 / (ht - H + L2) - gt**2 / (ht + L2)
                gain[(N < MIN_ROWS) | (nt - N < MIN_ROWS)] = 0
                at = gain.argmax(axis=1)
                better = gain[np.arange(width), at] > best
                best[better], feature[better], cut[better] = gain[np.arange(width), at][better], f, at[better]
            out["feature"][t, width - 1 : 2 * width - 1] = feature
            out["cut"][t, width - 1 : 2 * width - 1] = [cuts[f][c] if c < len(cuts[f]) else np.inf for f, c in zip(feature, cut)]
            node = node * 2 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        G, H = np.bincount(node, g, leaves), np.bincount(node, hess, leaves)
        out["value"][t] = -RATE * G / (H + L2)
        score = score + out["value"][t][node]
    return out


def predict(m: dict, x: np.ndarray) -> np.ndarray:
    """Log-odds of each row."""
    total, own = np.full(len(x), m["base"]), np.arange(len(x))
    inner = (1 << DEPTH) - 1
    for feature, cut, value in zip(m["feature"], m["cut"], m["value"]):
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[own, feature[node]] > cut[node])
        total += value[node - inner]
    return total


def fit(texts: pa.Array, y: list[str], prior: list[float]) -> bytes:
    target = np.array([float(v) > 0 for v in y], dtype=np.float64)
    positive = sum(p for v, p in dict(zip(y, prior)).items() if float(v) > 0)
    if not len(y) or target.min() == target.max():
        none = {"feature": np.zeros((0, 1), np.int64), "cut": np.zeros((0, 1)), "value": np.zeros((0, 1))}
        return pickle.dumps(none | {"base": float(np.log((positive + 1e-9) / (1 - positive + 1e-9)))})
    data, off = utf8(texts)
    x = np.concatenate([statistics(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off)])
    m = fit_trees(x, target)
    sampled = target.mean()
    return pickle.dumps(m | {"base": m["base"] + float(np.log(positive / (1 - positive)) - np.log(sampled / (1 - sampled)))})


def train(docs: DataFrame, labels: DataFrame, label: str, fold: Column, per_class: int = PER_CLASS) -> bytes:
    return fitted(labelled_sample(docs, labels, label, fold, per_class), fit)


def _scorer(model: bytes):
    m = pickle.loads(model)
    return lambda data, off: np.round(1 / (1 + np.exp(-np.clip(predict(m, statistics(data, off)), -35, 35))), 9)


def score(df: DataFrame, model: bytes, text: str = "text", keep_text: bool = False, name: str = "score") -> DataFrame:
    """df with ``name``, the probability of label 1; without its text unless that is kept."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return scored(df, text, lambda: _scorer(shared.value), keep_text, name)


def reject_poor(docs: DataFrame, labels: DataFrame, fold: Column | None = None, threshold: float = 0.3) -> DataFrame:
    """docs, with the same columns, without the documents whose score is below threshold."""
    model = train(docs, labels, "quality", F.lit(True) if fold is None else fold)
    name = free_names(docs, ["score"])["score"]
    return score(docs, model, keep_text=True, name=name).filter(F.col(name) >= threshold).drop(name)
