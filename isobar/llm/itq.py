"""Near duplicates among embeddings: ITQ codes, multi-index Hamming tables, and exact cosines.

1. Rows of equal vectors (after scaling by the largest component) become one class, under a 64-bit hash of the vector (at 10^10 different vectors, about 3 chance meetings of hashes are expected).
2. Iterative quantisation learns, from a sample of about ``SAMPLE`` classes chosen by hash, a mean and a rotation of the principal axes that makes the signs balanced bits of little error: signs and
   rotation are fitted in turn, ``TURNS`` times (orthogonal Procrustes). The sample is turned by the threshold's angle in random directions, which gives ``flip``, the share of bits that change between vectors just similar enough.
   A length of vectors that the sample lacks has a random rotation and the flips of its angle.
3. Every class gets a code of up to 64 bits, and an entry in each of ``tables`` tables: a table's key are ``width`` bits of the code, which permutations of all bits are cut in. Width and number of tables follow from flip and the
   number of classes: of the widths, each with as many tables as leave at most ``MISS`` of pairs at the threshold without a common key, the one of least work; so recall is alike at every size and work grows little more than the number of classes.
4. Entries meet by key. A pair counts in the first table in which its keys agree, which the two codes tell, so no pair counts twice and none has to be written. Pairs whose codes differ in more than ``radius`` bits (4 deviations above the mean at the threshold) are not candidates;
   only entries of candidates go on, with their vectors. A key of more than ``BLOCK`` classes is cut in blocks, and pairs of blocks meet in tasks of their own, so no key is too large for a task.
5. Candidates are compared by cosine in double precision, key by key, with a matrix product where there are many. A task returns for each class how many rows it found linked and the smallest class of its tree; components of these are the result.

Within a group of M near copies M^2 cosines are computed, block by block over tasks, but nothing of that size is kept or sent.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with nothing; vectors of different lengths aren't compared; equal vectors link; every row counts, also those that repeat an id; rows of null id link too; a component's
id is its smallest id, nulls aside; such a row of its own keeps its id. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, stored, tidy
from .components import components
from .vectors import by_length, sound

SAMPLE, TURNS, BITS, MISS, BLOCK, ENTRIES_PER_TASK = 8192, 30, 64, 0.005, 2048, 1 << 19
ROWS_AT_ONCE, PAIRS_AT_ONCE = 256, 1 << 15
_ENTRY = "key long, a int, b int, other boolean, d int, cls long, code long"


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit_length(v: np.ndarray, angle: float, seed: int = 7) -> dict:
    """Mean, rotation (d x bits) and share of flipped bits for unit rows v of one length."""
    rng, d = np.random.default_rng(seed), v.shape[1]
    bits, mean = min(BITS, d), v.mean(axis=0)
    if len(v) <= d:
        turn, mean = np.linalg.qr(rng.standard_normal((d, d)))[0][:, :bits], np.zeros(d)
    else:
        _, _, axes = np.linalg.svd(v - mean, full_matrices=False)
        low = (v - mean) @ axes[:bits].T
        r = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
        for _ in range(TURNS):
            left, _, right = np.linalg.svd(np.where(low @ r >= 0, 1.0, -1.0).T @ low)
            r = (left @ right).T
        turn = axes[:bits].T @ r
    if len(v) and d > 1:
        way = rng.standard_normal(v.shape)
        way -= (way * v).sum(axis=1, keepdims=True) * v
        near = math.cos(angle) * v + math.sin(angle) * unit(way)
        flip = float((((v - mean) @ turn >= 0) != ((near - mean) @ turn >= 0)).mean())
    else:
        flip = angle / math.pi
    return {"mean": mean, "turn": turn, "flip": flip}


def plan(classes: int, flip: float, bits: int) -> tuple[list[int], int]:
    """The bits of each table, as masks, and the radius."""
    best = (math.inf, 1, 1)
    for width in range(1, bits + 1):
        hit = (1 - flip) ** width
        tables = 1 if hit >= 1 - MISS else math.ceil(math.log(MISS) / math.log1p(-hit)) if hit > 1e-12 else math.inf
        best = min(best, (tables * (40 + classes / 2**width), width, tables))
    _, width, tables = best
    rng, masks = np.random.default_rng(11), []
    while len(masks) < tables:
        order = np.arange(bits) if not masks else rng.permutation(bits)
        masks += [sum(1 << int(z) for z in order[a : a + width]) for a in range(0, bits - width + 1, width)]
    return masks[:tables], math.ceil(bits * flip + 4 * math.sqrt(bits * flip * (1 - flip)))


def codes(v: np.ndarray, model: dict) -> np.ndarray:
    """The codes of unit rows v."""
    on = np.packbits((v - model["mean"]) @ model["turn"] >= 0, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(on, ((0, 0), (0, 8 - on.shape[1])))).view(np.uint64).ravel()


def learnt(classes: DataFrame, total: int, least: float) -> dict:
    """Of each length: model, masks and radius, from a bounded sample of the classes."""
    angle, lengths = math.acos(least), [r["d"] for r in classes.select(F.size("v").alias("d")).distinct().collect()]

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for d, rows, v in by_length(b.column("v")):
                held.setdefault(d, []).append((b.column("cls").to_numpy()[rows], v))
        for d, parts in held.items():
            order = np.argsort(np.concatenate([c for c, _ in parts]))
            yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "model": pa.array([pickle.dumps(fit_length(unit(np.concatenate([v for _, v in parts])[order]), angle))], pa.binary())})

    share = int(min(1.0, SAMPLE / max(1, total)) * (1 << 30))
    sample = classes.filter(F.pmod(F.xxhash64("cls", F.lit(5)), F.lit(1 << 30)) < share)
    models = {r["d"]: pickle.loads(bytes(r["model"])) for r in sample.select("cls", "v").repartition(1).mapInArrow(tidy(run), "d int, model binary").collect()}
    out = {}
    for d in lengths:
        m = models.get(d) or fit_length(np.zeros((0, d)), angle)
        m["masks"], m["radius"] = plan(total, m["flip"], min(BITS, d))
        out[d] = m
    return out


def _entries(classes: DataFrame, models: dict) -> DataFrame:
    """A row (key, cls, code) of each class in each table."""
    shared = classes.sparkSession.sparkContext.broadcast(pickle.dumps(models))

    def run(batches):
        of = pickle.loads(shared.value)
        for b in batches:
            for d, rows, v in by_length(b.column("v")):
                code, cls = codes(unit(v), of[d]), b.column("cls").to_numpy()[rows]
                for t, mask in enumerate(of[d]["masks"]):
                    name = mix((code & np.uint64(mask)) + np.uint64(d * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                    key = (name >> np.uint64(16)) | np.uint64(t << 48)
                    yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "d": np.full(len(cls), d, np.int32), "cls": cls, "code": code.view(np.int64)})

    return classes.select("cls", "v").mapInArrow(tidy(run), "key long, d int, cls long, code long")


def _blocked(entries: DataFrame) -> DataFrame:
    """The entries of keys with at least two classes, dealt to pairs of blocks (a, b); other: of the second block."""
    held = entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("k"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    m = entries.join(held, F.col("key") == F.col("k")).withColumn("own", F.pmod(F.xxhash64("cls", F.lit(3)), "blocks").cast("int"))
    m = m.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return m.select("key", F.least("own", "x").alias("a"), F.greatest("own", "x").alias("b"), (F.col("own") > F.col("x")).alias("other"), "d", "cls", "code")


def _groups(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """t by key, block pair, side and class, and where each group of a key and block pair begins and ends."""
    key, a, b, other, cls = (t.column(c).to_numpy() for c in ("key", "a", "b", "other", "cls"))
    order = np.lexsort((cls, other, b, a, key))
    key, a, b = key[order], a[order], b[order]
    new = np.append(True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    return t.take(pa.array(order)), np.append(np.flatnonzero(new), len(key))


def _pairs(at: np.ndarray, other: np.ndarray, crossed: np.ndarray):
    """Places (x, y) of the pairs of the groups that begin and end at ``at``, a bounded number at once; of two blocks (crossed) only pairs between them."""
    size = np.diff(at)
    small = np.flatnonzero((size > 1) & (size <= 64) & ~crossed)
    for w in np.unique(size[small]).tolist():
        i, j = np.triu_indices(w, 1)
        first = at[small[size[small] == w]]
        step = max(1, PAIRS_AT_ONCE // len(i))
        for k in range(0, len(first), step):
            f = first[k : k + step, None]
            yield (f + i).ravel(), (f + j).ravel()
    for g in np.flatnonzero((size > 64) | crossed).tolist():
        low, high = int(at[g]), int(at[g + 1])
        mid = low + int(np.searchsorted(other[low:high], True)) if crossed[g] else high
        for k in range(low, mid, ROWS_AT_ONCE):
            yield slice(k, min(mid, k + ROWS_AT_ONCE)), slice(mid, high) if crossed[g] else slice(k, high)


def _candidates(rows: DataFrame, models: dict, tasks: int) -> DataFrame:
    """Of the blocked entries those with a candidate that meets them here first."""
    rules = {d: (np.array(m["masks"], dtype=np.uint64), m["radius"]) for d, m in models.items()}

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t, at = _groups(pa.Table.from_batches(got))
        code, table, d, other = t.column("code").to_numpy().view(np.uint64), t.column("key").to_numpy() >> 48, t.column("d").to_numpy(), t.column("other").to_numpy()
        crossed, live = (t.column("a").to_numpy() != t.column("b").to_numpy())[at[:-1]], np.zeros(t.num_rows, dtype=bool)
        for x, y in _pairs(at, other, crossed):
            first = x.start if isinstance(x, slice) else None
            if first is None:
                i, j = x, y
                reach = np.array([rules[z][1] for z in np.unique(d)])[np.searchsorted(np.unique(d), d[i])]
                ok = (np.bitwise_count(code[i] ^ code[j]) <= reach) & (d[i] == d[j])
                i, j = i[ok], j[ok]
            else:
                ok = np.bitwise_count(code[x, None] ^ code[None, y]) <= rules[int(d[first])][1]
                i, j = np.nonzero(ok)
                i, j = i + first, j + y.start
                ok = (i < j) & (d[i] == d[j])
                i, j = i[ok], j[ok]
            ok = first_here(code[i] ^ code[j], table[i], d[i], rules)
            live[i[ok]] = True
            live[j[ok]] = True
        yield from t.filter(pa.array(live)).to_batches()

    return rows.repartition(tasks, "key", "a", "b").mapInArrow(tidy(run), _ENTRY)


def first_here(differ: np.ndarray, table: np.ndarray, d: np.ndarray, rules: dict) -> np.ndarray:
    """Whether pairs whose codes differ in these bits agree in the given table's bits and in those of none before it."""
    out = np.zeros(len(differ), dtype=bool)
    for z in np.unique(d).tolist():
        masks, own = rules[z][0], np.flatnonzero(d == z)
        seen = np.zeros(len(own), dtype=bool)
        for t in range(int(table[own].max(initial=0)) + 1):
            meets = (differ[own] & masks[t]) == 0
            here = (table[own] == t) & meets & ~seen
            out[own[here]] = True
            seen |= meets
    return out


def _linked(rows: DataFrame, models: dict, least: float, tasks: int) -> DataFrame:
    """cls, n (rows that it links with, of pairs found by the task) and top, the smallest class of its tree in the task."""
    rules = {d: (np.array(m["masks"], dtype=np.uint64), m["radius"]) for d, m in models.items()}

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t, at = _groups(pa.Table.from_batches(got))
        code, table, d, other = t.column("code").to_numpy().view(np.uint64), t.column("key").to_numpy() >> 48, t.column("d").to_numpy(), t.column("other").to_numpy()
        names, of = np.unique(t.column("cls").to_numpy(), return_inverse=True)
        weight, where = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        weight[of] = t.column("w").to_numpy()
        vectors = {}
        _, one = np.unique(of, return_index=True)
        for z, r, v in by_length(t.column("v").take(pa.array(one))):
            where[r], vectors[z] = np.arange(len(r)), unit(v)
        crossed = (t.column("a").to_numpy() != t.column("b").to_numpy())[at[:-1]]
        n, top = np.zeros(len(names), dtype=np.int64), np.arange(len(names))
        for x, y in _pairs(at, other, crossed):
            if isinstance(x, slice):
                own = vectors[int(d[x.start])]
                alike = d[y] == d[x.start]
                if not (d[x] == d[x.start]).all() or not alike.all():  # two lengths under one hashed key
                    i, j = (z.ravel() for z in np.meshgrid(np.arange(x.start, x.stop), np.arange(y.start, y.stop), indexing="ij"))
                else:
                    i, j = np.nonzero(own[where[of[x]]] @ own[where[of[y]]].T >= least)
                    i, j = i + x.start, j + y.start
                i, j = i[i < j], j[i < j]
            else:
                i, j = x, y
            ok = d[i] == d[j]
            i, j = i[ok], j[ok]
            ok = first_here(code[i] ^ code[j], table[i], d[i], rules)
            i, j = i[ok], j[ok]
            cosine = np.empty(len(i))
            for z, own in vectors.items():
                for k in np.array_split(np.flatnonzero(d[i] == z), len(i) // PAIRS_AT_ONCE + 1):
                    cosine[k] = np.einsum("ij,ij->i", own[where[of[i[k]]]], own[where[of[j[k]]]])
            i, j = of[i[cosine >= least]], of[j[cosine >= least]]
            np.add.at(n, i, weight[j])
            np.add.at(n, j, weight[i])
            _join(top, i, j)
        out = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cls": names[out], "n": n[out], "top": names[_roots(top)[out]]})

    return rows.repartition(tasks, "key", "a", "b").mapInArrow(tidy(run), "cls long, n long, top long")


def _roots(top: np.ndarray) -> np.ndarray:
    while (up := top[top]).tobytes() != top.tobytes():
        top = up
    return top


def _join(top: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the trees (each node's way to a smaller one of its tree) of the pairs x, y, in place."""
    while len(x):
        top[:] = _roots(top)
        x, y = top[x], top[y]
        x, y = np.minimum(x, y), np.maximum(x, y)
        new = x < y
        x, y = x[new], y[new]
        np.minimum.at(top, y, x)


def near_duplicates(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    x = F.transform(F.col(vector), lambda c: c.cast("double") + F.lit(0.0))
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.when(sound(vector) & F.exists(F.col(vector), lambda c: c != 0), x).alias("v"))
    rows = rows.withColumn("v", F.transform("v", lambda c: c / F.aggregate("v", F.lit(0.0), lambda m, z: F.greatest(m, F.abs(z)))))
    rows = rows.withColumn("cls", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    classes = stored(rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.first("v").alias("v"), F.count("*").alias("w"), F.min("id").alias("least")), "vector-classes")
    total = classes.count()
    models = learnt(classes, total, least)
    tables = max((len(m["masks"]) for m in models.values()), default=1)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), total * tables // ENTRIES_PER_TASK)
    near = stored(_candidates(_blocked(_entries(classes, models)), models, tasks), "near-entries")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), near.count() // (ENTRIES_PER_TASK // 16))
    found = stored(_linked(near.join(classes.select("cls", "w", "v"), "cls").select("key", "a", "b", "other", "d", "cls", "code", "w", "v"), models, least, tasks), "vector-links")
    discard(near)
    trees = components(found.select(F.col("cls").alias("u"), F.col("top").alias("v"))).withColumnRenamed("node", "cls")
    links = found.groupBy("cls").agg(F.sum("n").alias("n"))
    own = classes.select("cls", "w", "least").join(links, "cls", "left").join(trees, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    ends = own.groupBy("component").agg(F.min("least").alias("component_id"))
    own = own.join(ends, "component").filter("n IS NOT NULL OR w > 1").select("cls", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "cls").join(own, "cls", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def links_sql(least: float = 0.95) -> str:
    """All links by comparing every pair, and what each vector reaches by them: what near_duplicates gives where its tables miss none."""
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
l AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.sound AND b.sound AND a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {least}),
w AS (SELECT a, b FROM l UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a),
c AS (SELECT w.a, min(v.vec_id) AS least FROM w JOIN v ON v.r = w.b GROUP BY w.a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, c.least) AS component_id, v.vec_id = least(v.vec_id, c.least) AS kept FROM v LEFT JOIN n ON n.a = v.r LEFT JOIN c ON c.a = v.r
"""
