"""Near duplicates, clustering and whitening of vectors against brute force."""

import hashlib
import os

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from isobar.llm import itq, kdmeans, queries, whitening

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAN, INF = float("nan"), float("inf")
ODD = "vec_id long, embedding array<double>, v string, cls string, id string, x string, w int, cluster string"


def given():
    t = pq.read_table(f"{SF}/embeddings.parquet")
    return t.column("vec_id").to_numpy(), np.array(t.column("embedding").to_pylist(), dtype=np.float64)


def table(spark, ids, v, schema="vec_id long, embedding array<double>"):
    return spark.createDataFrame([(None if i is None else int(i), None if x is None else [None if z is None else float(z) for z in x]) for i, x in zip(ids, v)], schema).repartition(5)


def linked(ids, v, least):
    """Direct links and smallest reachable id of each row, by comparing all."""
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = n @ n.T >= least
    near |= (v[:, None, :] == v[None, :, :]).all(axis=2) if len(v) < 500 else False
    np.fill_diagonal(near, False)
    top = np.array(ids)
    while True:
        new = np.array([min([top[i], *top[np.flatnonzero(near[i])]]) for i in range(len(v))])
        if (new == top).all():
            return near.sum(axis=1), top
        top = new


def test_dedup_finds_planted_copies(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    way = rng.standard_normal((1000, 64))
    way -= (way * base[:1000]).sum(axis=1, keepdims=True) * base[:1000]
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    angle = np.arccos(rng.uniform(0.945, 0.97, 1000))[:, None]
    crowd = base[0] + 0.018 * rng.standard_normal((400, 64))
    v = np.concatenate([base, np.cos(angle) * base[:1000] + np.sin(angle) * way, crowd, base[5:8], base[5:6] * 2])
    ids = rng.permutation(len(v))
    want, _ = linked(ids, v, 0.95)
    got = itq.near_duplicates(table(spark, ids, v)).toPandas().set_index("vec_id").loc[ids]
    assert (got.n_links.to_numpy() <= want).all()
    pairs = want[1500:2500].sum()
    assert got.n_links.to_numpy()[1500:2500].sum() >= 0.97 * pairs
    assert got.n_links.sum() >= 0.98 * want.sum()
    assert (got.kept.to_numpy() == (got.component_id.to_numpy() == ids)).all()
    assert len(set(got.component_id.to_numpy()[2500:2900])) == 1


def test_dedup_of_hot_keys_meets_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 40)
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.standard_normal((1, 16)) + 0.02 * rng.standard_normal((300, 16)), rng.standard_normal((60, 16))])
    want, top = linked(np.arange(360), v, 0.95)
    got = itq.near_duplicates(table(spark, range(360), v)).toPandas().set_index("vec_id").sort_index()
    assert (got.n_links.to_numpy() == want).all()
    assert (got.component_id.to_numpy() == top).all()


def test_dedup_odd_rows(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.0001]
    rows = [(7, a), (3, a), (3, a), (None, b), (9, [2.0, 4.0, 6.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (8, [NAN, 1.0, 1.0]), (10, [INF, 1.0, 1.0]), (11, [None, 1.0, 1.0]), (12, [1.0, 2.0]), (13, [-1.0, -2.0, -3.0]), (14, [1e308, 2e308 / 2, 3e307]), (15, [1e-320, 0.0, 0.0]), (None, None), (16, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "v", "c", "i", "x", 1, "k") for r in rows], ODD)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in itq.near_duplicates(df).collect()), key=str)
    group = [(i, 4, 3, i == 3) for i in (7, 3, 3, None, 9)]
    alone = [(i, 0, i, True) for i in (4, 5, 6, 8, 10, 11, 12, 13, 14, None)]
    assert got == sorted([*group, *alone, (15, 1, 15, True), (16, 1, 15, False)], key=str)
    assert itq.near_duplicates(df.limit(0)).collect() == []


def test_pairs_count_in_their_first_table():
    rules = {8: (np.array([0b0011, 0b1100, 0b0110], dtype=np.uint64), 3)}
    differ = np.array([0b0000, 0b0001, 0b1001, 0b0100, 0b0101], dtype=np.uint64)
    for t, want in enumerate([[1, 0, 0, 1, 0], [0, 1, 0, 0, 0], [0, 0, 1, 0, 0]]):
        assert itq.first_here(differ, np.full(5, t), np.full(5, 8), rules).tolist() == [bool(x) for x in want]


def test_plan_keeps_recall_at_every_size():
    for n in (10, 10**5, 10**9):
        masks, _ = itq.plan(n, 0.1, 64)
        width = masks[0].bit_count()
        assert all(m.bit_count() == width for m in masks) and (1 - 0.9**width) ** len(masks) <= itq.MISS
    assert itq.plan(10**9, 0.1, 64)[0][0].bit_count() > itq.plan(10**5, 0.1, 64)[0][0].bit_count()


def test_rotation_is_orthogonal_and_bits_are_balanced():
    _, v = given()
    m = itq.fit_length(itq.unit(v), 0.3)
    assert np.allclose(m["turn"].T @ m["turn"], np.eye(64))
    on = (itq.unit(v) - m["mean"]) @ m["turn"] >= 0
    assert abs(on.mean(axis=0) - 0.5).max() < 0.15
    plain = itq.unit(v) - m["mean"]
    error = lambda z: ((np.sign(z) * np.abs(z).mean() - z) ** 2).sum()
    assert error(plain @ m["turn"]) < error(plain @ np.linalg.svd(plain, full_matrices=False)[2].T)


def means(ids, x, k=16, rounds=3):
    start = sorted(range(len(ids)), key=lambda r: (hashlib.sha256(f"1:{ids[r]}".encode()).hexdigest(), x[r].tolist()))[:k]
    c = [x[r].tolist() for r in start]
    for n in range(rounds + 1):
        d = [[sum((p - q) ** 2 for p, q in zip(v, z)) for z in c] for v in x.tolist()]
        label = [min(range(len(c)), key=lambda z, row=row: (row[z], z)) for row in d]
        if n < rounds:
            for z in range(len(c)):
                own = [v for v, w in zip(x.tolist(), label) if w == z]
                c[z] = [sum(col) // len(own) for col in zip(*own)] if own else c[z]
    return label, [row[w] for row, w in zip(d, label)], c


def test_clusters_match_plain_rounds(spark):
    ids, v = given()
    label, distance, c = means(ids, np.floor(64 * v).astype(np.int64))
    got = queries.op12_clustering(spark, SF).toPandas().set_index("vec_id").loc[ids]
    assert got.cluster.tolist() == label and got.distance.tolist() == distance
    assert got.centroid_sha256.tolist() == [hashlib.sha256(",".join(map(str, c[z])).encode()).hexdigest() for z in label]
    assert set(got.inertia) == {sum(distance)}
    assert got.cluster_inertia.tolist() == [sum(d for d, w in zip(distance, label) if w == z) for z in label]


def test_clusters_match_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = duck.execute(queries.SQL["op12_clustering"]).df().sort_values("vec_id").reset_index(drop=True)
    got = queries.op12_clustering(spark, SF).toPandas().sort_values("vec_id").reset_index(drop=True)
    assert (got[list(want.columns)] == want).all().all()


@pytest.mark.parametrize("dims,leaf", [(2, 8), (3, 4)])
def test_filtering_prunes_and_stays_exact(dims, leaf):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.integers(-50, 50, (2000, dims)), np.zeros((300, dims), int), rng.integers(-2, 3, (300, dims))]).astype(np.int32)
    c = np.concatenate([rng.integers(-50, 50, (8, dims)), np.zeros((2, dims), int), [[1] * dims]]).astype(np.int64)
    tree, order = kdmeans.Tree.grow(v, leaf)
    assert (tree.v == v[order]).all() and (tree.sums[0] == v.sum(axis=0)).all()
    label, count, sums, work = kdmeans.filtered(tree, c)
    d = ((tree.v[:, None, :].astype(np.int64) - c[None]) ** 2).sum(axis=2)
    assert (label == d.argmin(axis=1)).all()
    assert (count == np.bincount(label, minlength=len(c))).all()
    assert all((sums[z] == tree.v[label == z].sum(axis=0)).all() for z in range(len(c)))
    assert work["whole"] > 500 and work["candidates"] < len(v) * len(c) / 2


def test_cluster_odd_rows(spark):
    good = [(i, [float(i % 3)] * 64) for i in range(12)]
    odd = [(None, [5.0] * 64), (20, None), (21, [1.0] * 63), (22, []), (23, [NAN] + [0.0] * 63), (24, [None] + [0.0] * 63), (25, [1e300] + [0.0] * 63), (3, [9.0] * 64)]
    df = spark.createDataFrame([(*r, "v", "c", "i", "x", 1, "k") for r in good + odd], ODD)
    got = kdmeans.clusters(df).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted([*(str(i) for i in range(12)), "None", "3"])
    assert len({r.cluster for r in got if r.vec_id in (0, 6, 9) and r.distance == 0}) == 1
    kept = [r for r in good + odd[:1] + odd[-1:]]
    label, distance, _ = means([r[0] for r in kept if r[0] is not None], np.array([[int(64 * z) for z in r[1]] for r in kept if r[0] is not None]), rounds=0)
    assert len(set(label)) == 4 and set(distance) == {0}
    assert kdmeans.clusters(df.limit(0)).collect() == []
    assert kdmeans.clusters(df.filter("vec_id = 20")).collect() == []


def plain_whitening(x, all_x):
    s, n = x.sum(axis=0), len(x)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    e, u = e[::-1], u[:, ::-1]
    return (all_x - s / n) @ u[:, :4] / np.sqrt(e[:4]), ((n * all_x - s) ** 2).sum(axis=1), e[:4] / e.sum()


def test_whitening_matches_eigenvectors(spark):
    ids, v = given()
    x = np.floor(256 * v).astype(np.int64)
    w, deviation, explained = plain_whitening(np.unique(x, axis=0), x)
    got = queries.op13_whitening(spark, SF).toPandas()
    assert len(got) == 4 * len(ids) and set(got.n) == {len(np.unique(x, axis=0))}
    wide = got.set_index(["vec_id", "component"]).whitened.unstack().loc[ids].to_numpy()
    signs = np.sign((wide * w).sum(axis=0))
    assert np.abs(wide - w * signs).max() < 1e-9
    one = got[got.component == 1].set_index("vec_id").loc[ids]
    assert one.deviation.tolist() == deviation.tolist()
    assert np.abs(got.groupby("component").explained.first().to_numpy() - explained).max() < 1e-12
    assert got.identity_error.nunique() == 1 and 0 < got.identity_error.iloc[0] < 1e-9


def test_whitening_counts_copies_once_and_merges_factors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(4)
    v = rng.standard_normal((90, 6)) * [9, 7, 5, 3, 2, 1] + 100
    v = np.concatenate([v, np.repeat(v[:1], 400, axis=0)])
    x = np.floor(256 * v).astype(np.int64)
    w, deviation, _ = plain_whitening(np.unique(x, axis=0), x)
    got = whitening.whiten(table(spark, range(len(v)), v).repartition(9)).toPandas()
    wide = got.set_index(["vec_id", "component"]).whitened.unstack().sort_index().to_numpy()
    assert np.abs(wide - w * np.sign((wide * w).sum(axis=0))).max() < 1e-9
    assert got[got.component == 1].set_index("vec_id").deviation.sort_index().tolist() == deviation.tolist()


def test_whitening_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (2, [0.5, 0.25]), (3, [1.0, 2.0, 3.0]), (4, None), (5, []), (6, [NAN, 1.0]), (7, [None, 1.0]), (8, [INF, 1.0]), (9, [4.0])]
    df = spark.createDataFrame([(*r, "v", "c", "i", "x", 1, "k") for r in rows], ODD)
    got = whitening.whiten(df).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in got) == sorted([("1", 1, 3), ("1", 2, 3)] * 2 + [(s, k, 3) for s in ("None", "2") for k in (1, 2)] + [("3", k, 1) for k in (1, 2, 3)] + [("9", 1, 1)])
    assert all(r.whitened is None and r.explained == 0 and r.identity_error == 0 and r.deviation == 0 for r in got if r.vec_id in (3, 9))
    assert all(r.whitened is not None for r in got if r.vec_id in (1, 2, None))
    assert whitening.whiten(df.limit(0)).collect() == []
    big = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 5.0])], "vec_id long, embedding array<double>")).collect()
    assert len(big) == 6 and all(r.deviation is None for r in big if r.vec_id == 1)


def test_dedup_matches_sql(spark, tmp_path):
    """On the given table, and on one of groups of near copies well above the threshold, which no table misses."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 32))
    v = np.concatenate([base, base[:20] + 0.1 * rng.standard_normal((20, 32)), base[:3], base[7:8] + 0.05 * rng.standard_normal((30, 32))])
    table(spark, range(len(v)), v).write.parquet(f"{tmp_path}/embeddings.parquet")
    for d, path in ((SF, f"{SF}/embeddings.parquet"), (str(tmp_path), f"{tmp_path}/embeddings.parquet/*.parquet")):
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
        want = duck.execute(queries.SQL["op11_embedding_dedup"]).df().sort_values("vec_id").reset_index(drop=True)
        got = queries.op11_embedding_dedup(spark, d).toPandas().sort_values("vec_id").reset_index(drop=True)
        assert (got[list(want.columns)] == want).all().all() and list(got.dtypes[want.columns]) == list(want.dtypes)
    assert got.n_links.sum() > 100
