"""Whitening of embeddings by TSQR, without a covariance matrix.

The fit list holds each distinct integer vector x once (n of them, with exact sums S). Its rows are centred by S / n; each task takes
the R factor of its rows, batch by batch (QR of the factor so far on top of the next rows), the factors are merged ``FAN`` at a time, level by level, and the SVD of the
last R gives the right vectors, which are the covariance's eigenvectors, and its eigenvalues e = s^2 / n. A factor is d by d whatever the number of rows. What comes to the driver are sums
and the last factor of each length of vectors, and the model (the first ``components`` vectors of each) is broadcast.

Vectors of different lengths are fitted apart, each length for itself. ``identity_error`` is measured by another pass over the fit list: its whitened rows are centred by
construction, so their products summed over n are their covariance.

Defined results: rows whose vector is null, empty or holds a null or non-finite entry are dropped; rows of null id and repeated rows are kept, but a vector counts once in the fit; a vector of fewer entries than ``components`` has
fewer components. A component without variance (e is 0 or below rounding, as with one distinct vector) has whitened null and explained 0 and doesn't count in identity_error, which is 0 if none counts.
A deviation beyond 63 bits is null. Other columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, tidy
from .vectors import by_length, floors, sound

FAN, ROWS, SAFE = 64, 4096, 1 << 28


def fit_list(df: DataFrame, vector: str, factor: float) -> DataFrame:
    """The distinct vectors x, once each."""
    return df.filter(sound(vector) & (F.size(vector) > 0)).select(floors(vector, factor).alias("x")).distinct()


def sums(x: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Of each length: the number of vectors and their exact sums."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, v in by_length(b.column("x")):
                for half in (0, 32):  # in two halves, which don't overflow
                    part = v >> 32 if half else v & 0xFFFFFFFF
                    own = total.setdefault(d, np.zeros((2, d + 1), dtype=np.int64))
                    own[half // 32, 1:] += part.sum(axis=0)
                total[d][0, 0] += len(v)
        for d, own in total.items():
            yield pa.RecordBatch.from_pydict({"d": np.full(d + 1, d, np.int32), "i": np.arange(d + 1, dtype=np.int32), "low": own[0], "high": own[1]})

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out: dict[int, dict] = {}
    for r in x.mapInArrow(tidy(run), "d int, i int, low long, high long").groupBy("d", "i").agg(wide("low"), wide("high")).collect():
        out.setdefault(r["d"], {})[r["i"]] = int(r["low"]) + (int(r["high"]) << 32)
    return {d: (s[0], [s[i + 1] for i in range(d)]) for d, s in out.items()}


def centred(v: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """Rows x - S / n: the numerator n x - S is exact where it fits, and the whole part of S / n is taken off first where it doesn't."""
    top = int(np.abs(v).max(initial=0)) if v.size and v.min() > np.iinfo(np.int64).min else 1 << 63
    if n * top + max(map(abs, s), default=0) < 1 << 62:
        return (v * n - np.array(s, dtype=np.int64)) / n
    whole = [z // n for z in s]
    rest = np.array([float(Fraction(z, n) - w) for z, w in zip(s, whole)])
    return (v.astype(np.longdouble) - np.array(whole, dtype=np.longdouble) - rest).astype(np.float64)


def r_factor(blocks) -> np.ndarray | None:
    """R of blocks of rows, stacked one after the other."""
    r = None
    for b in blocks:
        r = np.linalg.qr(b if r is None else np.concatenate([r, b]), mode="r")
    return r


def factors(x: DataFrame, known: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """R of the centred rows of each length: one a task, then merged in a tree."""

    def first(batches):
        r: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, v in by_length(b.column("x")):
                for a in range(0, len(v), ROWS):
                    r[d] = r_factor([*([r[d]] if d in r else []), centred(v[a : a + ROWS], *known[d])])
        for d, own in r.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "r": pa.array([own.tobytes()], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        d = t.column("d")[0].as_py()
        r = r_factor(np.frombuffer(b.as_buffer(), np.float64).reshape(-1, d) for b in t.column("r"))
        return pa.table({"d": pa.array([d], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})

    level = stored(x.mapInArrow(tidy(first), "d int, r binary"), "r-factors")
    while (most := level.groupBy("d").count().agg(F.max("count")).first()[0] or 0) > 1:
        last, groups = level, -(-most // FAN)
        part = F.pmod(F.monotonically_increasing_id(), F.lit(groups)).alias("part") if groups > 1 else F.lit(0).alias("part")
        level = stored(level.select("d", "r", part).groupBy("d", "part").applyInArrow(merge, "d int, r binary"), "r-factors")
        discard(last)
    out = {r["d"]: np.frombuffer(bytes(r["r"]), np.float64).reshape(-1, r["d"]) for r in level.collect()}
    discard(level)
    return out


def _model(r: np.ndarray, n: int, components: int) -> dict:
    _, s, right = np.linalg.svd(r, full_matrices=True)
    s = np.pad(s, (0, r.shape[1] - len(s)))
    e, m = s * s / n, min(components, r.shape[1])
    live = s > s.max(initial=0) * max(n, len(s)) ** 0.5 * np.finfo(np.float64).eps * 4
    return {"v": right[:m], "e": e[:m], "live": live[:m], "explained": np.where(live[:m], e[:m] / (e.sum() or 1.0), 0.0)}


def _projected(v: np.ndarray, model: dict) -> np.ndarray:
    """Whitened rows; nan where a component has no variance."""
    return np.where(model["live"], centred(v, model["n"], model["s"]) @ model["v"].T / np.sqrt(np.where(model["live"], model["e"], 1.0)), np.nan)


def _identity_error(x: DataFrame, models: dict[int, dict]) -> dict[int, float]:
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, v in by_length(b.column("x")):
                for a in range(0, len(v), ROWS):
                    w = np.nan_to_num(_projected(v[a : a + ROWS], models[d]))
                    total[d] = total.get(d, 0.0) + w.T @ w
        for d, own in total.items():
            yield pa.RecordBatch.from_pydict({"d": np.full(own.size, d, np.int32), "i": np.arange(own.size, dtype=np.int32), "s": own.ravel()})

    worst = {d: 0.0 for d in models}
    for r in x.mapInArrow(tidy(run), "d int, i int, s double").groupBy("d", "i").agg(F.sum("s").alias("s")).collect():
        m = models[r["d"]]
        i, j = divmod(r["i"], len(m["e"]))
        if m["live"][i] and m["live"][j]:
            worst[r["d"]] = max(worst[r["d"]], abs(r["s"] / m["n"] - (i == j)))
    return worst


def deviation(v: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2, exactly."""
    top = int(np.abs(v).max(initial=0)) if v.size and v.min() > np.iinfo(np.int64).min else 1 << 63
    if (n * top + max(map(abs, s), default=0)) ** 2 * max(1, len(s)) < 1 << 63:
        return ((v * n - np.array(s, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    got = (sum((n * x - z) ** 2 for x, z in zip(row, s)) for row in v.tolist())
    return [g if g < 1 << 63 else None for g in got]


def whiten(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 4, factor: float = 256.0) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each row and component."""
    x = stored(fit_list(df, vector, factor), "fit-list")
    known = sums(x)
    models = {d: _model(r, known[d][0], components) | {"n": known[d][0], "s": known[d][1]} for d, r in factors(x, known).items()}
    for d, worst in _identity_error(x, models).items():
        models[d]["error"] = worst
    discard(x)
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(models))

    def run(batches):
        of = pickle.loads(shared.value)
        for b in batches:
            for d, rows, v in by_length(b.column("x")):
                m = of[d]
                k = len(m["e"])
                for a in range(0, len(v), ROWS):
                    part, own = v[a : a + ROWS], rows[a : a + ROWS]
                    w = _projected(part, m).ravel()
                    yield pa.RecordBatch.from_pydict({
                        "id": b.column("id").take(pa.array(np.repeat(own, k))), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(own)), "n": np.full(len(own) * k, m["n"], np.int64),
                        "deviation": pa.array(deviation(part, m["n"], m["s"]), pa.int64()).take(pa.array(np.repeat(np.arange(len(own)), k))), "whitened": pa.array(w, mask=np.isnan(w)),
                        "explained": np.tile(m["explained"], len(own)), "identity_error": np.full(len(own) * k, m["error"]),
                    })

    rows = df.filter(sound(vector) & (F.size(vector) > 0)).select(F.col(id_column).cast("bigint").alias("id"), floors(vector, factor).alias("x"))
    return rows.mapInArrow(tidy(run), "id long, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("id", id_column)
