"""SimHash groups against a plain version."""

import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from pagemill.llm import simhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def plain_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=4):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= distance:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in prints}


def texts(seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, n)) for n in (3, 8, 40, 300, 2000)]
    out = [None, "", " \n\t", "One", "one", "a b c d", "A  B\nC D", "é É"]
    for words in base:
        for _ in range(12):
            copy = list(words)
            copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("size", [1, 4, 5])
def test_fingerprint(size):
    for text in texts():
        assert simhash.fingerprint(text, size) == plain_fingerprint(text, size)


def test_components(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows + rows[:5], SCHEMA)
    got = simhash.components_by_distance(docs).collect()
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_components(prints)
    assert len(got) == len(rows) + 5
    for r in got:
        assert r.fp % 2**64 == prints[r.doc_id]
        assert r.component_id == want[r.doc_id]


def test_hot_key(spark, monkeypatch):
    """Keys over the cell size are dealt to cells, with the same result."""
    rows = list(enumerate(texts(3)))
    want = {r.doc_id: r.component_id for r in simhash.components_by_distance(spark.createDataFrame(rows, SCHEMA)).collect()}
    monkeypatch.setattr(simhash, "CELL", 2)
    got = {r.doc_id: r.component_id for r in simhash.components_by_distance(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_empty_and_clashing_columns(spark):
    assert simhash.components_by_distance(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a b", 1, 2, "x"), (None, "a b", 3, 4, "y")], "doc_id long, text string, fp int, t int, component_id string")
    assert {(r.doc_id, r.component_id) for r in simhash.components_by_distance(docs).collect()} == {(1, 1), (None, 1)}


def test_blocks_meet():
    """Any two fingerprints within the distance share a key."""
    rng = np.random.default_rng(0)
    masks = [m % 2**64 for m in simhash.block_masks(7, 3)]
    for _ in range(300):
        flipped = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flipped & m == 0 for m in masks)


def test_sign_bit(spark):
    """Pairs that differ in the highest bit are told apart like any other."""
    rng = np.random.default_rng(9)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    prints = base + [b ^ (1 << 63) ^ (1 << int(rng.integers(63))) for b in base] + [b ^ (1 << 63) ^ 0x1F for b in base]
    rows = [(0, 1, 0, p - (1 << 64) if p >> 63 else p) for p in prints]
    df = spark.createDataFrame(rows, "t int, k long, cell int, fp long")
    linked = simhash.links(df, ["t", "k", "cell"], "fp", {"s": ["fp"]}, {"s": 4}).collect()
    want = plain_components(dict(enumerate(prints)))
    root = {p: p for p in prints}
    for _ in prints:
        for r in linked:
            a, b = r.a % 2**64, r.b % 2**64
            root[a] = root[b] = min(root[a], root[b])
    same = lambda label, of: {frozenset(of(i) for i in label if label[i] == c) for c in label.values()}
    assert same(root, lambda p: p) == same(want, lambda i: prints[i])


def test_very_long_texts(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 50_000, 300_000)]
    near = list(words)
    near[150_000] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, "x" * 2_000_000), (4, "word " * 500_000)]
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.components_by_distance(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: fp for i, (fp, _) in got.items()} == {i: plain_fingerprint(t) for i, t in rows[2:]} | {i: got[i][0] for i in (1, 2)}
    assert [got[i][1] for i in (1, 2, 3, 4)] == [1, 1, 3, 4]


def test_long_runs_grow_like_short_ones(monkeypatch):
    """Chains, hot sets and single rows: both ways of linking a run give the same labels."""
    rng = np.random.default_rng(5)
    places = np.concatenate([np.arange(0, 300, 2), rng.integers(400, 420, 200), 1000 + 50 * np.arange(60)])
    starts = np.array([0, 130, 150, len(places)])
    close = lambda i, j: np.abs(places[i] - places[j]) <= 3
    want = simhash._links(starts, close)
    monkeypatch.setattr(simhash, "SHORT_RUN", 10**6)
    assert simhash._links(starts, close).tolist() == want.tolist()
    whole = simhash._grown(np.arange(150, len(places)), close, room=64)
    assert whole.tolist() == want[150:].tolist()
