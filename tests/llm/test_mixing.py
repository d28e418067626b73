import random
import re
from collections import Counter, defaultdict

import pytest

from isobar.llm import mixing
from isobar.llm.mixing import mix_documents, mix_plan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size string"


def targets(sizes: dict) -> dict:
    """The stated rule, step by step."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return capped | share
        for s in above:
            capped[s] = 3.0 * sizes[s]
            left -= capped[s]


def rows_of(sizes):
    out, k = [], 0
    for s, counts in sizes.items():
        for c in counts:
            out.append((k, " ".join(f"w{k}_{i}" for i in range(c)), s, "clash"))
            k += 1
    return out


@pytest.mark.parametrize("sizes", [
    {"a": [5, 7, 9], "b": [100] * 12, "c": [3], "d": [40, 2, 0], None: [10, 11]},
    {"only": [4, 4, 4]},
    {"tiny": [1], "hot": [50] * 200, "z": [2, 2]},
])
def test_targets_and_budgets(spark, sizes):
    rows = rows_of(sizes)
    got = mix_plan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = targets({s: sum(c) for s, c in sizes.items()})
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
        assert r.source_size == sum(sizes[r.source])
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    docs = mix_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    words = Counter()
    for r in docs:
        words[r.source] += len(WORD.findall(r.text))
    assert dict(words) == {s: n for s, n in taken.items() if n}
    again = mix_plan(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_odd_rows(spark):
    rows = [(1, "a b", "s", ""), (1, "a b", "s", ""), (None, None, None, ""), (2, "", "s", ""), (3, "\t x \n", "t", "")]
    got = mix_plan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and all(r.taken == 0 for r in got if r.size == 0)
    assert mix_plan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mix_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_sources_in_ranges(spark, monkeypatch):
    """Beyond FEW_SOURCES, sums over sources go by ranges; the targets are the same."""
    rng = random.Random(7)
    sizes = {f"s{k:03d}": [rng.randint(0, 9) for _ in range(rng.randint(1, 3))] for k in range(200)} | {None: [5], "hot": [40] * 60}
    df = spark.createDataFrame(rows_of(sizes), SCHEMA)
    want = targets({s: sum(c) for s, c in sizes.items()})
    plain = {(r.doc_id, r.target, r.taken) for r in mix_plan(df).collect()}
    monkeypatch.setattr(mixing, "FEW_SOURCES", 10)
    got = mix_plan(df).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(d, n) for d, _, n in plain}
    assert all(r.target == pytest.approx(want[r.source], abs=1e-6) for r in got) and len(got) == len(rows_of(sizes))


def test_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(k, "a b c d", f"s{k % 2}", k, k, k, k) for k in range(6)], "doc_id long, text string, source string, _key long, _cut long, Taken long, copy long")
    plan, docs = mix_plan(df), mix_documents(df)
    assert set(plan.columns) == {"doc_id", "text", "source", "_key", "_cut", "copy", "size", "source_size", "target", "taken"}
    assert docs.columns == df.columns and all(r._key == r._cut == r.Taken == r.copy == r.doc_id for r in docs.collect())
    assert [(r.size, r._key) for r in plan.orderBy("doc_id").collect()] == [(4, k) for k in range(6)]


@pytest.mark.parametrize("one", [5, None])
def test_one_id_on_many_rows(spark, one):
    """Rows of one id are cut by their texts; only equal rows share what is left."""
    rows = [(one, f"t{k} " * (k % 5 + 1), "hot", "") for k in range(900)] + [(one, "same text", "hot", "")] * 40 + [(k, "a b c", "cold", "") for k in range(10, 400)]
    got = mix_plan(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    want = targets({"hot": sum(len(r[1].split()) for r in rows if r[2] == "hot"), "cold": 3 * 390})
    for s in want:
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= 40
    part = {r.taken % r.size for r in got if r.source == "hot" and r.taken % r.size}
    assert len(part) <= 1
    again = mix_plan(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    key = lambda r: (r.text, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_words_are_counted_without_holding_them(spark):
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", " a", "a ", "a\x1cb \x85  c", "\u2003\u3000 x", "\U0001F600 \U0001F600", "  \x00 z", "$1 \\ x", " " * 100000, "w " * 50000, " " * 1000 + "a" * 50000 + " " * 1000]
    plan = mix_plan(spark.createDataFrame([(k, t, "s", "") for k, t in enumerate(texts)], SCHEMA))
    assert {r.doc_id: r.size for r in plan.collect()} == {k: len(WORD.findall(t or "")) for k, t in enumerate(texts)}
    shown = plan._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_replace" in shown and "regexp_extract_all" not in shown
