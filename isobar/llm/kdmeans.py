"""Centroid clustering of integer vectors by kd-tree filtering.

Each task cuts its vectors in blocks of at most ``BLOCK`` rows and builds a kd-tree of each: a node holds its count, the integer sums of
its vectors and their box, and is halved at the median of its widest component until ``LEAF`` rows are left or all are equal. The blocks are
written once to the shared folder. A round walks the trees from their roots with the centroids as candidates: the candidate nearest to the box's middle is compared
with the others at the box's corner that favours those most, and a candidate that is farther there too can win nowhere in the box and is dropped. A node of one candidate is
assigned whole, by its count and sums; a leaf of several is resolved row by row, over its candidates only. All arithmetic is in integers, so the result doesn't
depend on how rows are dealt. A task returns a row a centroid; what comes to the driver are count and sums of ``k`` centroids.

Centroids start as the k vectors of smallest sha256 of ``<seed>:<id>``. After each round a centroid is the componentwise floor(sum / count) of its vectors; empty ones stay.

Defined results: vectors that are null, hold a null or non-finite component, or have another number of components than ``dims`` are left out; so are those with a component of 2^27 or more in size after scaling, as
their squared distances don't fit a long. Ties go to the smaller centroid. Rows of null id are assigned, but don't start a centroid; of rows that repeat an id, the smaller vector starts first. Repeated
rows get equal results. Fewer rows than k give fewer centroids; an empty table gives no rows. An inertia beyond 63 bits is null. Other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, tidy
from .vectors import by_length, floors, sound

BLOCK, LEAF, LIMIT = 8192, 64, 1 << 27
_BLOCKS = "ids array<long>, v binary, first binary, last binary, child binary, low binary, high binary, sums binary"


class Tree:
    """Nodes as arrays: rows first .. last of v, the first of two children (-1 for a leaf), the box's low and high corners, and sums."""

    def __init__(self, v, first, last, child, low, high, sums):
        self.v, self.first, self.last, self.child, self.low, self.high, self.sums = v, first, last, child, low, high, sums

    @classmethod
    def grow(cls, v: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree of v's rows, and their order in it."""
        order, nodes, child, todo = np.arange(len(v)), [(0, len(v))], [], 0
        boxes = []
        while todo < len(nodes):
            a, b = nodes[todo]
            own = v[order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            boxes.append((low, high, own.sum(axis=0, dtype=np.int64)))
            if b - a > leaf and (low < high).any():
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, int(np.argmax(high.astype(np.int64) - low))], mid)]
                child.append(len(nodes))
                nodes += [(a, a + mid), (a + mid, b)]
            else:
                child.append(-1)
            todo += 1
        ends = np.array(nodes, dtype=np.int64)
        low, high, sums = (np.array([x[k] for x in boxes]) for k in range(3))
        return cls(v[order], ends[:, 0], ends[:, 1], np.array(child, dtype=np.int64), low, high, sums), order

    def packed(self) -> dict:
        return {k: x.tobytes() for k, x in vars(self).items()}

    @classmethod
    def unpacked(cls, row: dict, dims: int) -> Tree:
        whole = lambda k, kind, *shape: np.frombuffer(row[k], kind).reshape(shape or -1)
        return cls(whole("v", np.int32, -1, dims), *(whole(k, np.int64) for k in ("first", "last", "child")), *(whole(k, np.int32, -1, dims) for k in ("low", "high")), whole("sums", np.int64, -1, dims))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, of integers, exactly: in doubles where every sum keeps under 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[-1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def filtered(tree: Tree, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Each row's centroid, each centroid's count and sums, and what was assigned: rows of whole nodes and candidates of rows in leaves."""
    k, square = len(c), (c * c).sum(axis=1)
    label, count, sums = np.empty(len(tree.v), dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros(c.shape, dtype=np.int64)
    node, live, leaves, lives, whole = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool), [], [], 0
    while len(node):
        low, high = tree.low[node].astype(np.int64), tree.high[node].astype(np.int64)
        near = np.where(live, 4 * (square - product(low + high, c)), np.iinfo(np.int64).max)
        best = near.argmin(axis=1)
        way = c[None, :, :] - c[best][:, None, :]
        corner = np.maximum(way * low[:, None, :], way * high[:, None, :]).sum(axis=2)
        ahead = square[None, :] - square[best][:, None] - 2 * corner  # how much farther than the best one, at least, anywhere in the box
        live = live & ((ahead < 0) | (ahead == 0) & (np.arange(k)[None, :] <= best[:, None]))
        one = live.sum(axis=1) == 1
        for n, z in zip(node[one].tolist(), best[one].tolist()):
            label[tree.first[n] : tree.last[n]] = z
            whole += int(tree.last[n] - tree.first[n])
        np.add.at(count, best[one], (tree.last - tree.first)[node[one]])
        np.add.at(sums, best[one], tree.sums[node[one]])
        end = ~one & (tree.child[node] < 0)
        leaves.append(node[end]), lives.append(live[end])
        inner = ~one & ~end
        node, live = np.repeat(tree.child[node[inner]], 2) + np.tile([0, 1], int(inner.sum())), np.repeat(live[inner], 2, axis=0)
    leaves, live = np.concatenate(leaves), np.concatenate(lives)
    size = tree.last[leaves] - tree.first[leaves]
    rows = np.repeat(tree.first[leaves] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    if len(rows):
        own, live = tree.v[rows], np.repeat(live, size, axis=0)
        label[rows] = np.where(live, square - 2 * product(own, c), np.iinfo(np.int64).max).argmin(axis=1)
        for z in range(k):
            mine = label[rows] == z
            count[z] += mine.sum()
            sums[z] += own[mine].sum(axis=0, dtype=np.int64)
    return label, count, sums, {"whole": whole, "candidates": int(live.sum()) if len(rows) else 0, "rows": len(rows)}


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (id, v) as trees of at most BLOCK rows."""

    def tree(ids: list, parts: list):
        got, order = Tree.grow(np.concatenate(parts).astype(np.int32))
        return pa.RecordBatch.from_pydict({"ids": pa.array([pa.concat_arrays(ids).take(pa.array(order))], pa.list_(pa.int64()))} | {k: pa.array([x], pa.binary()) for k, x in got.packed().items()})

    def run(batches):
        ids, parts, held = [], [], 0
        for b in batches:
            for _, _, v in by_length(b.column("v")):
                for a in range(0, len(v), BLOCK):
                    part = v[a : a + BLOCK]
                    if held + len(part) > BLOCK:
                        yield tree(ids, parts)
                        ids, parts, held = [], [], 0
                    ids.append(b.column("id").slice(a, len(part))), parts.append(part)
                    held += len(part)
        if held:
            yield tree(ids, parts)

    return rows.mapInArrow(tidy(run), _BLOCKS)


def _trees(batches, dims: int):
    for b in batches:
        for i in range(b.num_rows):
            row = {k: b.column(k)[i].as_buffer() for k in b.schema.names if k != "ids"}
            yield b.column("ids")[i].values, Tree.unpacked(row, dims)


def _round(blocks: DataFrame, c: np.ndarray, dims: int) -> np.ndarray:
    """The centroids after a round."""

    def run(batches):
        total = np.zeros((len(c), dims + 1), dtype=np.int64)
        for _, tree in _trees(batches, dims):
            _, count, sums, _ = filtered(tree, c)
            total[:, 0] += count
            total[:, 1:] += sums
        z, i = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"z": z.astype(np.int32), "i": i.astype(np.int32), "s": total[z, i]})

    got = blocks.mapInArrow(tidy(run), "z int, i int, s long").groupBy("z", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = {(r["z"], r["i"]): int(r["s"]) for r in got}
    return np.array([[sums.get((z, i + 1), 0) // sums[z, 0] if (z, 0) in sums else int(c[z, i]) for i in range(dims)] for z in range(len(c))], dtype=np.int64).reshape(c.shape)


def cluster(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3, factor: float = 64.0, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """id, cluster, distance (squared) of every vector that is kept, in a stored table, and the centroids."""
    kept = df.filter(sound(vector) & (F.size(vector) == dims)).select(F.col(id_column).cast("bigint").alias("id"), floors(vector, factor).alias("v"))
    kept = kept.filter(F.forall("v", lambda x: (x > F.lit(-LIMIT)) & (x < F.lit(LIMIT))))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = kept.filter("id IS NOT NULL").orderBy(hashed, "v").limit(k).collect()
    c = np.array([r["v"] for r in starts], dtype=np.int64).reshape(len(starts), dims)
    if not len(c):
        kept = kept.limit(0)
    blocks = stored(_blocks(kept), "kd-blocks")
    for _ in range(rounds if len(c) else 0):
        c = _round(blocks, c, dims)

    def run(batches):
        for ids, tree in _trees(batches, dims):
            label = filtered(tree, c)[0]
            yield pa.RecordBatch.from_pydict({"id": ids, "cluster": label.astype(np.int32), "distance": ((tree.v - c[label]) ** 2).sum(axis=1)})

    out = stored(blocks.mapInArrow(tidy(run), "id long, cluster int, distance long"), "clusters")
    discard(blocks)
    return out, c


def clusters(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", **settings) -> DataFrame:
    """vec_id, cluster, distance, and of its cluster and of all: cluster_inertia, inertia, centroid_sha256."""
    rows, c = cluster(df, id_column, vector, **settings)
    own = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    held = lambda s: F.lit(s if s < 1 << 63 else None).cast("bigint")
    of = lambda x: F.element_at(F.array(*x), F.col("cluster") + 1)
    sha = [F.lit(hashlib.sha256(",".join(map(str, z)).encode()).hexdigest()) for z in c.tolist()] or [F.lit("")]
    inertia = [held(own.get(z, 0)) for z in range(len(sha))]
    return rows.select(F.col("id").alias(id_column), "cluster", "distance", of(inertia).alias("cluster_inertia"), held(sum(own.values())).alias("inertia"), of(sha).alias("centroid_sha256"))


def clusters_sql(dims: int = 64, k: int = 16, rounds: int = 3, factor: int = 64, seed: int = 1) -> str:
    """The same by comparing every vector with every centroid."""
    out = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k}),"""
    for n in range(rounds + 1):
        out += f"""
a{n} AS (SELECT r, min({{'d': d, 'c': c}}) AS m FROM (SELECT v.r, c.c, CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{n} c) GROUP BY r),"""
        if n < rounds:
            out += f"""
s{n} AS (SELECT a.m.c AS c, i, CAST(sum(v.v[i]) AS BIGINT) AS s, count(*) AS n FROM a{n} a JOIN v ON a.r = v.r, range(1, {dims + 1}) AS t(i) GROUP BY a.m.c, i),
g{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{n} GROUP BY c),
c{n + 1} AS (SELECT c.c, coalesce(g.v, c.v) AS v FROM c{n} c LEFT JOIN g{n} g ON c.c = g.c),"""
    return out + f"""
h AS (SELECT c, sha256(array_to_string(v, ',')) AS h FROM c{rounds})
SELECT v.vec_id, CAST(a.m.c AS INT) AS cluster, a.m.d AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM a{rounds} a JOIN v ON a.r = v.r JOIN h ON h.c = a.m.c
"""
