import random
import re

import numpy as np
import pytest

from isobar.llm import components as cc
from isobar.llm import jaccard as j

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_sets(texts: dict, n: int) -> dict:
    """doc_id -> set of shingles."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return sets


def brute(texts: dict, n: int, num: int, den: int) -> dict:
    """doc_id -> (set size, component), by comparing all pairs."""
    sets = plain_sets(texts, n)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed: int) -> dict:
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 12, 40, 120]))] for _ in range(12)]
    out = {}
    for k in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
        out[k] = rng.choice([" ", "\n", "\t "]).join(w if rng.random() < 0.8 else [x.upper() for x in w])
    return out | {900: None, 901: "", 902: " \n", 903: "É é", 904: "é É", 905: "x " * 5000}


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80)])
def test_matches_brute_force(spark, n, num):
    texts = corpus(n)
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in texts.items()], "doc_id long, text string, component_id string, cls int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.jaccard_components(df, n, num, 100).collect()}
    want = brute(texts, n, num, 100)
    assert got == want
    kept = sorted(r.doc_id for r in j.one_of_each(df, n, num, 100).collect())
    assert kept == sorted(i for i, (_, c) in want.items() if c == i)


def test_signature_guarantee():
    rng = np.random.default_rng(7)
    for num in (90, 80):
        for _ in range(600):
            a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300))).astype(np.uint64))
            gone = int(rng.integers(0, len(a) * (100 - num) // 100 + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, int(rng.integers(0, len(a) * (100 - num) // 100 + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= num * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert len(np.intersect1d(j.signatures(a, num, 100), j.signatures(b, num, 100)))


def test_large_bucket_goes_as_blocks(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    texts = {}
    for k in range(60):
        w = list(base)
        w[rng.randrange(60)] = f"x{k}"
        texts[k] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.jaccard_components(df, 3, 90, 100).collect()}
    assert got == brute(texts, 3, 90, 100)


def test_many_members_by_matrix_or_by_pair():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = {k: np.unique(np.concatenate([rng.permutation(base)[int(rng.integers(0, 30)) :], rng.integers(0, 2**63, int(rng.integers(0, 10))).astype(np.uint64)])) for k in range(40)}
    roots = []
    for members in ([*sets], None):
        f = j._Forest()
        for part in [members] if members else [[a, b] for a in sets for b in sets if a < b]:
            j.links_of(part, sets, 90, 100, f, set())
        roots.append([f.root(k) for k in sets])
    assert roots[0] == roots[1]


def test_rows_that_repeat_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "g h i j k"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = j.jaccard_components(df).collect()
    assert len(got) == 5 and {r.component_id for r in got if r.n_shingles == 2} == {1}
    kept = [r.doc_id for r in j.one_of_each(df).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 2] and kept.count(None) == 1  # the row without text
    none = spark.createDataFrame([], "doc_id long, text string")
    assert j.jaccard_components(none).count() == 0 and j.one_of_each(none).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(40)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_rows_of_null_id_link(spark):
    w = [f"w{k}" for k in range(60)]
    ends = [" ".join(w), " ".join([*w, "v1", "v2", "v3", "v4", "v5", "v6"]), " ".join([*w, *(f"v{k}" for k in range(1, 13))])]
    lone = [f"u{k}" for k in range(40)]
    rows = [(7, ends[0]), (None, ends[1]), (3, ends[2]), (None, " ".join(lone)), (None, " ".join([*lone, "t1"])), (9, "x y z q")]
    sets = brute(dict(enumerate(t for _, t in rows)), 3, 90, 100)
    assert len({sets[k][1] for k in range(3)}) == 1 and sets[3][1] == sets[4][1]
    got = j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert sorted((r.n_shingles, r.component_id or 0) for r in got) == sorted((sets[k][0], c) for k, c in enumerate([3, 3, 3, 0, 0, 9]))


def test_one_row_of_each_group(spark):
    w = [f"w{k}" for k in range(60)]
    near = " ".join([*w, "v"])
    rows = [(1, " ".join(w), "b"), (1, "quite other words than those above here", "x"), (1, " ".join(w), "a"), (None, near, "c"), (None, "p q r s t u", "n"), (None, "p q r s t u", "m"), (4, "", "e"), (4, None, "e")]
    got = j.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, th string")).collect()
    assert sorted((r.doc_id or 0, r.text or "-", r.th) for r in got) == sorted([(1, rows[1][1], "x"), (1, rows[0][1], "a"), (0, "p q r s t u", "m"), (4, "-", "e"), (4, "-", "e")])


def test_words_of_one_structure_are_not_alike(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = {k: w for k, w in enumerate([word, word.translate(str.maketrans("ab", "ba")), word + "x", "12345678", "12345678a", "12345678b", "A2345678b"])}
    got = j.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k for k in texts}


def test_bitmaps_never_part_linked_sets():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**63, int(n)).astype(np.uint64)) for n in (3, 40, 130, 260, 700)]
    sets = []
    for _ in range(120):
        b = base[int(rng.integers(0, 5))]
        sets.append(np.unique(np.concatenate([rng.permutation(b)[int(rng.integers(0, len(b) // 4 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, len(b) // 5 + 1))).astype(np.uint64)])))
    known = np.arange(len(sets))
    key = np.repeat([1, 2, 3], [120, 60, 2])
    cls = np.concatenate([known, known[::2], known[:2]])
    size = np.array([len(s) for s in sets])
    groups = j.near_groups(key, cls, known, size, [j.bitmap(s) for s in sets], 80, 100)
    together = {(x, y) for g in groups for x in g.tolist() for y in g.tolist() if x < y}
    links = {(x, y) for x in known.tolist() for y in range(x + 1, 120) if 100 * (b := len(np.intersect1d(sets[x], sets[y]))) >= 80 * (len(sets[x]) + len(sets[y]) - b)}
    assert links and links <= together and len(together) < 120 * 119 / 2
    maps = j._Bitmaps([j.bitmap(s) for s in sets])
    x, y = np.triu_indices(120, 1)
    apart = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(x, y)])
    assert (maps.distance(x, y) <= apart).all()


def test_pairs_of_representatives(spark):
    texts = corpus(4) | {500 + k: " ".join([f"g{k}" if i == k else f"w{i}" for i in range(200)]) for k in range(30)}
    sets = plain_sets(texts, 3)
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    reps = sorted(i for s, i in least.items() if s)
    want = {(a, b) for a in reps for b in reps if a < b and 100 * (n := len(sets[a] & sets[b])) >= 90 * (len(sets[a]) + len(sets[b]) - n)}
    pairs, members = j.jaccard_pairs(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 90, 100)
    got = [(r.left, r.right) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    assert {r.doc_id: r.representative for r in members.collect()} == {i: least[s] for i, s in sets.items() if s}


def test_a_large_group_hangs_on_pivots(spark, monkeypatch):
    """A chain of near copies round a core, with outliers that link to single members only, over many small blocks."""
    monkeypatch.setattr(j, "BLOCK", 12)
    monkeypatch.setattr(j, "FEW", 4)
    monkeypatch.setattr(j, "PIVOTS", 3)
    rng = random.Random(8)
    texts = corpus(6)
    for k in range(150):
        w = [f"w{i}" for i in range(120)]
        for at in rng.sample(range(120), k % 4):
            w[at] = f"x{k}_{at}"
        texts[1000 + k] = " ".join(w)
    for k in range(12):
        texts[2000 + k] = texts[1000 + 9 * k] + " " + " ".join(f"y{k}_{i}" for i in range(9))
    want = brute(texts, 3, 90, 100)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    seen, compared = [], j._pivot_links
    monkeypatch.setattr(j, "_pivot_links", lambda *a: seen.append(compared(*a)) or seen[-1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.jaccard_components(df, 3, 90, 100).collect()}
    assert got == want and seen[0] is not None


def test_a_bucket_of_one_tree_is_done(spark):
    rows = [(1, c, 6, 1, 8) for c in range(6)] + [(2, c, 5, 1, 8) for c in range(2, 7)] + [(3, c, 3, 7, 8) for c in (7, 8, 9)]
    members = spark.createDataFrame(rows, "bucket long, cls long, size long, least long, bytes long")
    trees = spark.createDataFrame([(c, 0) for c in range(6)] + [(7, 7), (8, 7)], "node long, component long")
    few, j.FEW = j.FEW, 1
    try:
        got = j._in_trees(members, trees).collect()
    finally:
        j.FEW = few
    assert {(r.bucket, r.cls, r.tree) for r in got} == {(2, c, c < 6) for c in range(2, 7)} | {(3, c, c < 9) for c in (7, 8, 9)}
