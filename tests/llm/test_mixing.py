"""Targets and budgets against plain versions."""

import itertools
import math

import numpy as np
import pytest

from pagemill.llm import mixing


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, limit = sum(sizes.values()), {s: 3 * n for s, n in sizes.items()}
    stopped = set()
    while True:
        free = [s for s in sizes if s not in stopped]
        rest = total - sum(limit[s] for s in stopped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > limit[s]}
        if not above:
            return {s: float(limit[s]) if s in stopped else share[s] for s in sizes}
        stopped |= above


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 10, None: 5}, {"z": 7}, {"a": 0, "b": 50, "é": 1, "ﬀ": 2, "𝔸": 3},
    {f"s{i}": (i * 37) % 91 for i in range(30)}, {"a": 0, "b": 0},
])
def test_targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, total long")).collect()
    want = plain_targets(sizes)
    assert {r.source: pytest.approx(r.target, abs=1e-6) for r in rows} == want


def test_knapsack_is_best():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = np.sort(rng.choice(np.arange(1, 40), int(rng.integers(1, 5)), replace=False))
        counts = rng.integers(0, 4, len(lengths))
        budget = int(rng.integers(0, 80))
        got = mixing._knapsack(lengths, counts, budget)
        sums = {int(np.dot(lengths, c)) for c in itertools.product(*[range(n + 1) for n in counts])}
        assert (got <= counts).all() and (got >= 0).all()
        assert int(np.dot(lengths, got)) == max(s for s in sums if s <= budget)


def test_budget_is_met():
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(1, 3000, 400))
    counts = rng.integers(1, 50, len(lengths))
    total = int(np.dot(lengths, counts))
    for budget in (0, 1, 17, total // 3, total - 1, total, total + 5):
        took = mixing.fitted(lengths, counts, budget)
        assert (took <= counts).all() and (took >= 0).all()
        least = total - int(lengths[0]) if budget == total - 1 else min(budget, total)  # all but the shortest document
        assert int(np.dot(lengths, took)) == least if budget != 1 else not took.any()


def rows_of(n=400):
    out = [(i, None if i % 50 == 0 else "w " * (i * i % 97), ["b", "a", None, "hot"][min(3, i % 7)]) for i in range(n)]
    return out + [(9000 + i, "same text here", "hot") for i in range(200)]


def test_mix(spark):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    size = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes = {}
    for i in size:
        sizes[source[i]] = sizes.get(source[i], 0) + size[i]
    want = plain_targets(sizes)
    for r in got:
        assert (r["size"], r.source_size, r.source) == (size[r.doc_id], sizes[r.source], source[r.doc_id])
        assert math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= 3
    again = mixing.mixed(docs.repartition(7)).collect()
    assert {r.doc_id: r.copies for r in again} == {r.doc_id: r.copies for r in got}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in got if r.copies}


def test_edges(spark):
    schema = "doc_id long, text string, source string, size string, take int"
    assert mixing.mixed(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(None, None, None, "x", 1), (None, None, None, "x", 1)], schema)
    assert [(r["size"], r.taken) for r in mixing.mixed(one).collect()] == [(0, 0)] * 2
    assert mixing.mixed_documents(one).columns == one.columns


def test_names_ties_and_very_long_texts(spark):
    """Columns with dots, sources that differ in case only, equal rows, and a text of a million words."""
    schema = "doc_id long, text string, source string, `a.b` int, _row int, _copies int"
    rows = [(i, "a b c", "S" if i % 2 else "s", i, 1, 2) for i in range(30)] + [(99, "w " * 1_000_000, "s", 0, 1, 2)] + [(7, "a b c", "S", 7, 1, 2)] * 3
    docs = spark.createDataFrame(rows, schema)
    got = mixing.mixed(docs).collect()
    sizes = {"S": 3 * 18, "s": 3 * 15 + 1_000_000}
    assert {r.source: (r.source_size, round(r.target, 6)) for r in got} == {s: (sizes[s], round(t, 6)) for s, t in plain_targets(sizes).items()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
