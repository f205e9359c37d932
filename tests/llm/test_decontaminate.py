"""Containment search against counting all shingles."""

import re

import numpy as np
import pytest

from pagemill.llm import decontaminate


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(docs, items, at_least=0.8):
    out = set()
    for item_id, text in items:
        w = words(text)
        if not w:
            continue
        k = min(5, len(w))
        mine = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for doc_id, body in docs:
            d = words(body)
            own = {tuple(d[i : i + k]) for i in range(len(d) - k + 1)}
            n = len(mine & own)
            if n and n * 1000 >= round(at_least * 1000) * len(mine):
                out.add((doc_id, item_id, len(mine), n))
    return out


@pytest.mark.parametrize("rows", [200_000, 0])
def test_against_plain(spark, monkeypatch, rows):
    """With sides broadcast and with sides shuffled."""
    monkeypatch.setattr("pagemill.storage.BROADCAST_ROWS", rows)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary, int(n)))) for i, n in enumerate([1, 3, 5, 6, 20, 33, 57, 200, 9, 14])]
    items += [(50, None), (51, ""), (52, "... !!"), (53, items[4][1])]
    docs = [(100, None), (101, ""), (102, "w1")]
    for j in range(60):
        body = list(rng.choice(vocabulary, int(rng.integers(0, 400))))
        item = words(items[j % 10][1])
        for _ in range(j % 4):
            item[int(rng.integers(len(item)))] = "changed"
        at = int(rng.integers(len(body) + 1))
        body[at:at] = [x.upper() + "," for x in item]
        docs.append((j, "\n".join(body)))
    d = spark.createDataFrame(docs + docs[:3], "doc_id long, text string").withColumnRenamed("text", "text")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.item_shingles, r.matched_shingles) for r in decontaminate.contaminated(d, b).collect()}
    want = plain(docs, items)
    assert got == want and len(want) > 20
    kept = {r.doc_id for r in decontaminate.decontaminated(d, b).collect()}
    assert kept == {i for i, _ in docs} - {x[0] for x in want}


def test_empty_and_extra_columns(spark):
    d = spark.createDataFrame([(None, "a b c d e f", 1, "x")], "doc_id long, text string, h int, item_id string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(d, none).count() == 0
    assert decontaminate.contaminated(d.limit(0), none).count() == 0
    one = spark.createDataFrame([(7, "A b, c d e f!")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, one).collect()] == [(None, 7)]
    assert decontaminate.decontaminated(d, one).count() == 0
    assert decontaminate.decontaminated(d, none).columns == d.columns


def test_very_long_ties_and_names(spark):
    """An item at the end of a megabyte, repeated items and documents, and columns with dots."""
    item = "one two three four five six seven"
    docs = [(1, "word " * 200_000 + item, 1), (2, "x" * 1_000_000, 2), (3, item, 3), (3, item, 4), (4, "one two three four five six", 5)]
    d = spark.createDataFrame(docs, "doc_id long, text string, `a.b` int")
    b = spark.createDataFrame([(7, item), (7, item), (8, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.item_shingles, r.matched_shingles) for r in decontaminate.contaminated(d, b).collect())
    assert got == [(i, j, 3, 3) for i in (1, 3) for j in (7, 8)]
    kept = decontaminate.decontaminated(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4]
