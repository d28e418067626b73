import datetime
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.llm import sharding, topk, urlfilter


def plain_fill(names, slots):
    """The table by its definition: whole preference lists, and turns."""
    prefer = []
    for name in names:
        d = hashlib.md5(name.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1
        prefer.append([(offset + j * skip) % slots for j in range(slots)])
    table, at = {}, [0] * len(names)
    while len(table) < slots:
        for i in range(len(names)):
            if len(table) == slots:
                break
            while prefer[i][at[i]] in table:
                at[i] += 1
            table[prefer[i][at[i]]] = i
    return [table[s] for s in range(slots)]


def test_fill_and_placement(spark):
    names = [f"n{k}" for k in range(7)]
    assert sharding.fill(names, 211) == plain_fill(names, 211)
    share = np.bincount(sharding.fill(names, 211))
    assert share.max() - share.min() <= 1
    moved = sum(a != b for a, b in zip(sharding.fill(names, 211), sharding.fill(names[:-1], 211)))
    assert moved < 211 / 2
    for bad in (([], 7), (names, 210), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)
    rows = [(k, "x") for k in range(300)] + [(None, "x"), (5, "x")]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, slot string"), "doc_id", names, 211).collect()
    table = sharding.fill(names, 211)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) % 211
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert len(got) == 302 and sharding.assign_shards(spark.createDataFrame([], "doc_id long"), "doc_id", names, 211).count() == 0


def test_url_filter(spark):
    day = datetime.date
    entries = [("bad.org", day(2024, 1, 10), "block"), ("bad.org", day(2024, 2, 1), "allow"), ("sub.bad.org", day(2024, 1, 20), "block"), ("ok.net/x/", day(2024, 1, 1), "block"), ("tie.com", day(2024, 1, 5), "allow"), ("tie.com", day(2024, 1, 5), "block"), (None, day(2024, 1, 1), "block"), ("never.com", None, "block")]
    cap = [
        ("http://bad.org/", day(2024, 1, 9), None), ("http://bad.org/", day(2024, 1, 10), "bad.org"), ("https://WWW.Bad.org:80/a?b#c", day(2024, 1, 31), "bad.org"), ("http://bad.org/", day(2024, 2, 1), None), ("http://u@a.sub.bad.org/", day(2024, 1, 25), "sub.bad.org"), ("http://a.sub.bad.org/", day(2024, 1, 15), "bad.org"),
        ("http://sub.bad.org", day(2024, 3, 1), "sub.bad.org"), ("http://notbad.org/", day(2024, 1, 15), None), ("http://ok.net/x/y", day(2024, 5, 1), "ok.net/x/"), ("http://ok.net/x", day(2024, 5, 1), None), ("http://ok.net/xx/", day(2024, 5, 1), None), ("http://tie.com/", day(2024, 6, 1), "tie.com"), ("http://never.com", day(2024, 6, 1), None),
        (None, day(2024, 1, 15), None), ("not a url", day(2024, 1, 15), None), ("http://bad.org/", None, None), ("http://bad.org/", day(2024, 1, 10), "bad.org"),
    ]
    e = spark.createDataFrame(entries, "pattern string, listed_at date, action string")
    c = spark.createDataFrame([(k, *x) for k, x in enumerate(cap)], "id int, url string, fetched_at date, want string").withColumn("host", F.lit("clash"))
    got = urlfilter.url_filter(c, e).collect()
    assert len(got) == len(cap)
    for r in got:
        assert (r.pattern, r.blocked) == (r.want, r.want is not None), r
    assert urlfilter.url_filter(c.limit(0), e).count() == 0
    assert urlfilter.url_filter(c, e.limit(0)).filter("blocked").count() == 0


def test_url_filter_paths_and_www(spark):
    day = datetime.date(2024, 1, 1)
    listed = ["a.org/x/y/", "b.org/EN/", "www.C.org", "WWW.d.org/P/q/", "e.org/", "www.com", "f.org/x", "g.org/a/b/c/d/"]
    cap = [
        ("http://a.org/x/y/z", "a.org/x/y/"), ("http://s.a.org/x/y/z/w?q=/", "a.org/x/y/"), ("http://a.org/x/y", None), ("http://a.org/x/z/y/", None), ("http://b.org/EN/p", "b.org/EN/"), ("http://B.org/en/p", None), ("http://c.org/", "c.org"), ("http://www.c.org", "c.org"), ("http://m.c.org/x", "c.org"),
        ("http://d.org/P/q/1", "d.org/P/q/"), ("http://d.org/p/q/1", None), ("http://e.org", "e.org/"), ("http://e.org?x", "e.org/"), ("http://www.com/a", "www.com"), ("http://z.com/a", None), ("http://f.org/x", None), ("http://g.org/a/b/c/d/e", "g.org/a/b/c/d/"), ("http://g.org/a/b/c/d", None), ("http://g.org//a/b/c/d/", None),
    ]
    e = spark.createDataFrame([(p, day, "block") for p in listed], "pattern string, listed_at date, action string")
    c = spark.createDataFrame([(u, day, w) for u, w in cap], "url string, fetched_at date, want string")
    got = urlfilter.url_filter(c, e).collect()
    assert len(got) == len(cap) and [(r.url, r.pattern) for r in got if r.pattern != r.want] == []
    hosts = urlfilter.url_filter(c, e.filter("pattern IN ('www.C.org', 'www.com')")).collect()
    assert [r.url for r in hosts if r.pattern != (r.want if r.want in ("c.org", "www.com") else None)] == []


def test_url_filter_addresses_dots_and_names(spark):
    day = datetime.date(2024, 1, 1)
    cap = [("http://1.2.3.4/", "1.2.3.4"), ("http://9.1.2.3.4/", None), ("http://5.3.4/", None), ("http://c.org./x", "c.org"), ("http://A.c.org.:80/x", "c.org"), ("http://d.org/", "d.org")]
    e = spark.createDataFrame([(p, day, "block") for p in ("1.2.3.4", "3.4", "c.org", "D.org.")], "pattern string, listed_at date, action string")
    c = spark.createDataFrame([(u, day, w, k, k, k) for k, (u, w) in enumerate(cap)], "url string, fetched_at date, want string, _hit int, _spans int, _host int")
    got = urlfilter.url_filter(c, e).collect()
    assert [(r.url, r.pattern) for r in got if r.pattern != r.want] == [] and sorted((r._hit, r._spans, r._host) for r in got) == [(k, k, k) for k in range(len(cap))]


def test_block_top_against_brute_force():
    rng = np.random.default_rng(0)
    for d, n, high in [(0, 5, 3), (1, 60, 3), (3, 400, 100), (64, 700, 100), (8, 400, 1 << 30), (2, 300, 1 << 40)]:
        c, ids = rng.integers(-high, high, (n, d)), rng.permutation(n) * 5
        c[: n // 3] = c[0] if n else c[:0]
        row, col, score = topk.block_top(ids[:20], c[:20], ids, c, 5)
        exact = c[:20].astype(object) @ c.astype(object).T if d else np.zeros((min(20, n), n), dtype=object)
        for i in range(min(20, n)):
            want = sorted((-max(min(exact[i, k], 2**63 - 1), 1 - 2**63), ids[k]) for k in range(n) if ids[k] != ids[i])[:5]
            assert [(-int(s), int(ids[k])) for s, k in zip(score[row == i], col[row == i])] == want


def test_statistics_drop_pairs():
    """Vectors with smooth components are told apart by coarse segments, and floors from another block drop more."""
    rng = np.random.default_rng(4)
    smooth = lambda n: (np.repeat(rng.normal(size=(n, 8)), 8, axis=1) * 200 + rng.normal(size=(n, 64)) * 20).astype(np.int64)
    q, c = smooth(30), smooth(3000)
    floor = np.full(30, topk.LOW)
    live, share = topk.survivors(np.arange(30), q, 100 + np.arange(3000), c, 5, floor)
    assert share[1] < 0.1 and share == sorted(share, reverse=True)
    exact = q @ c.T
    assert (np.sort(exact, axis=1)[:, -5] >= floor).all() and live[np.arange(30)[:, None], np.argsort(-exact, axis=1, kind="stable")[:, :5]].all()
    better = np.sort(exact, axis=1)[:, -5].copy()
    _, less = topk.survivors(np.arange(30), q, 100 + np.arange(3000), c, 5, better)
    assert less[-1] <= share[-1]


def test_top_k_odd_rows(spark):
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(6)], "x") for k in range(120)]
    rows += [(150, None, "x"), (151, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (152, [float("nan")] * 6, "x"), (153, [float("inf")] * 6, "x"), (None, [0.5] * 6, "x"), (200, [0.1, 0.2], "x"), (50, rows[50][1], "x"), (250, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect()
    good = {k: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] for k, v, _ in rows[:120]}
    for q in (0, 50, 100):
        other = [(-(sum(a * b for a, b in zip(good[q], v))), k) for k, v in good.items() if k != q] + ([(-(sum(a * b for a, b in zip(good[q], good[50]))), 50)] if q != 50 else [])
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == sorted(other)[:5]
    assert {r.query_id for r in got} == {0, 50, 100}
    assert topk.top_k(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 50 == 0).count() == 0


def test_cells_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "BLOCKS_PER_CELL", 4)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((700, 8))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect()
    x = np.floor(256 * v).astype(np.int64)
    for q in range(0, 700, 50):
        score = x @ x[q]
        want = sorted((-int(score[k]), k) for k in range(700) if k != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_long_histories(spark):
    """A pattern listed and taken off hundreds of times, over another that is listed for good: each capture against every entry."""
    import datetime

    day = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(days=k)
    entries = [("a.org", day(3 * k), "block" if k % 2 else "allow") for k in range(301)] + [("a.org/x/", day(100), "block"), ("org", day(400), "block"), ("org", day(500), "allow")]
    captures = [(k, f"http://www.a.org/{'x/' if k % 3 else 'y/'}p", day(k)) for k in range(0, 1000, 7)] + [(-1, "http://a.org/", None), (-2, "http://b.org/x/", day(450)), (-3, "http://b.org/x/", day(500))]
    df = spark.createDataFrame(captures, "id int, url string, fetched_at date")
    got = {r.id: (r.blocked, r.pattern, r.since) for r in urlfilter.url_filter(df, spark.createDataFrame(entries, "pattern string, listed_at date, action string")).collect()}

    def plain(url, at):
        for pattern in ("a.org/x/", "a.org", "org"):
            host, _, path = pattern.partition("/")
            seen = [(d, a) for p, d, a in entries if p == pattern and at is not None and d <= at]
            own = url.split("/")[2].removeprefix("www.")
            if seen and (own == host or own.endswith("." + host)) and (not path or url.split(own + "/")[1].startswith(path)) and max(seen)[1] == "block":
                return True, pattern, max(seen)[0]
        return False, None, None

    assert got == {k: plain(u, at) for k, u, at in captures}
