"""The corpus pipeline: each stage on its own input, planted cases, and the whole against a plain version of its decisions."""

import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from pagemill.llm import mixing, simhash

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_against_all_pairs(spark):
    """Planted copies at a similarity of 0.85 or more are grouped; unlike texts are not."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows, groups = [], {}
    for g in range(40):
        n = int(rng.integers(30, 900))
        base = list(rng.choice(vocabulary, n))
        for k in range(6):
            copy = list(base)
            for _ in range(int(n * (0, 0, 0.004, 0.008, 0.01, 0.012)[k])):
                copy[int(rng.integers(n))] = str(rng.choice(vocabulary))
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    sets = [shingles(t) for _, t in rows]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = 0
    for i in range(len(rows)):
        for j in range(i):
            if groups[i] == groups[j] and jaccard(sets[i], sets[j]) >= 0.85:
                missed += got[i] != got[j]
            if groups[i] != groups[j]:
                assert got[i] != got[j]
    assert missed == 0


def test_deduplicated_edges(spark):
    schema = "doc_id long, text string, node int, t string"
    rows = [(3, "a b c d e f", 1, "x"), (1, "A B C D E F", 2, "y"), (9, None, 3, "z"), (8, "", 4, "w"), (None, "q r s t u v", 5, "n")]
    out = simhash.deduplicated(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "node", "t"]
    assert sorted((r.doc_id is not None, r.doc_id) for r in out.collect()) == [(False, None), (True, 1), (True, 8)]
    assert simhash.deduplicated(spark.createDataFrame([], schema)).count() == 0


def plain_clean(text):
    """The quality stage on one text: what stays of it, or None."""
    from pagemill.llm import quality

    space, word = "\x20\x09-\x0D", r"[^\x20\x09-\x0D]+"
    text = text or ""
    words = re.findall(word, text)
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    letters = lambda x: sum(unicodedata.category(c)[0] in "LM" for c in x)
    black = lambda x: len(re.sub(f"[{space}]+", "", x))
    kept, gone = [], 0
    for line in text.split("\n"):
        bad = bool(re.search(word, line)) and (
            any(re.search(p, line) for p in (quality.NAVIGATION, quality.PUNCTUATION, quality.BOILERPLATE))
            or (not re.search(quality.ENDED, line) and len(re.findall(word, line)) <= 4)
            or 3 * letters(line) < black(line)
            or bool(re.search(quality.LINK, line) and 2 * black(re.sub(quality.LINK, "", line)) < black(line))
        )
        gone += black(line) if bad else 0
        kept += [] if bad else [line]
    if len(words) < 10 or 100 * len(covered) > 20 * len(words) or gone > 0.3 * sum(map(len, words)):
        return None
    return "\n".join(kept)


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality rules", "near-dedup", "decontamination", "mixing", "token files"]
    seen, raw = [], {r.doc_id: r.text for r in docs.collect()}
    for _, stage in C.STAGES[:-1]:
        docs = C.stored(stage(spark, docs, DATA), "stage")
        assert docs.columns == COLUMNS
        seen.append({r.doc_id: (r.text, r.source) for r in docs.collect()})
    clean, unique, safe, mixed = seen
    assert set(mixed) <= set(safe) <= set(unique) <= set(clean)
    # quality rules: as judged one by one
    assert {i: t for i, (t, _) in clean.items()} == {i: x for i, t in raw.items() if (x := plain_clean(t)) is not None}
    # near-dedup: the least doc_id of each group of all pairs at 0.8 or more
    ids = sorted(clean)
    groups = linked([shingles(clean[i][0]) for i in ids])
    assert set(unique) == {ids[min(g)] for g in groups}
    # mixing: copies as the operator's own figures say, which test_mixing holds against targets
    copies = {r.doc_id: r.copies for r in mixing.mixed(spark.createDataFrame([(i, *x) for i, x in safe.items()], "doc_id long, text string, source string")).collect()}
    assert {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
    # decontamination: what went holds a benchmark item, what stayed none
    items = []
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = re.findall(r"[^\W_]+", r.text.lower())
        items.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    for i, (text, _) in unique.items():
        w = re.findall(r"[^\W_]+", text.lower())
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        holds = any(q and len(q & own) * 10 >= 8 * len(q) for q in items)
        assert holds == (i not in safe)
    # mixing and token files: every copy is a document of its own, in order, and reruns agree
    from tokenizers import Tokenizer

    from pagemill.llm.queries import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted((r.doc_id, r.n_tokens, r.ids_crc32, r.start) for r in C.run(spark, DATA).collect())
    want = [(i, np.array([*t.encode(x, add_special_tokens=False).ids, 1], dtype="<u4")) for i, x in rows]
    assert [g[:3] for g in got] == sorted((i, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    assert sorted(g[3] for g in got) == np.cumsum([0, *[len(x) for _, x in want]])[:-1].tolist()


@pytest.mark.parametrize("stage", range(4))
def test_stage_keeps_empty_tables(spark, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(F.lit(False))
    out = C.STAGES[stage][1](spark, docs, DATA)
    assert out.columns == COLUMNS and out.count() == 0


def copies_by(edit, target, rng, n=300):
    """A text and a copy with words appended, cut or replaced until the similarity is just at target or above."""
    base = [f"w{i}" for i in rng.integers(0, 10**6, n)]
    if edit == "appended":
        copy = base + [f"w{i}" for i in rng.integers(0, 10**6, int((n - 4) * (1 / target - 1)))]
    elif edit == "cut":
        copy = base[: n - int((n - 4) * (1 - target))]
    else:
        copy, k = list(base), int((n - 4) * (1 - target) / (1 + target) / 5)
        for at in range(k):
            copy[5 + at * (n // k)] = f"x{at}"
    return " ".join(base), " ".join(copy)


@pytest.mark.parametrize("target", [0.8, 0.85, 0.9])
@pytest.mark.parametrize("edit", ["appended", "cut", "replaced"])
def test_search_finds_all_kinds_of_edits(edit, target):
    """Pairs at the similarity share a search key, however the copy was made."""
    rng = np.random.default_rng(4)
    n = len(simhash.SEARCH)
    for _ in range(100):
        a, b = copies_by(edit, target, rng)
        assert target <= jaccard(shingles(a), shingles(b)) < target + 0.03
        a, b = (simhash.sketch(t.encode())[:n] for t in (a, b))
        assert any(x == y for x, y in zip(a, b, strict=True))


def linked(sets, at_least=0.8):
    """Groups of all pairs at the similarity, by comparing all."""
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            alike = min(len(sets[i]), len(sets[j])) >= at_least * max(len(sets[i]), len(sets[j]))  # no pair of less even sizes is
            if alike and root[i] != root[j] and jaccard(sets[i], sets[j]) >= at_least:
                root = [root[j] if r == root[i] else r for r in root]
    return {frozenset(i for i in range(len(sets)) if root[i] == r) for r in root}


@pytest.mark.parametrize("together", [512, 5])
def test_near_copies_are_exact(spark, monkeypatch, together):
    """Groups are those of all pairs at an exact similarity of 0.8 or more; pairs just below stay apart."""
    monkeypatch.setattr(simhash, "TOGETHER", together)
    rng = np.random.default_rng(12)
    texts = ["", "one", "one two three four five six", "one two three four five six seven"]
    for edit in ("appended", "cut", "replaced"):
        for target in (0.6, 0.7, 0.74, 0.78, 0.79, 0.8, 0.82, 0.9):
            for n in (40, 300):
                texts.extend(copies_by(edit, target, rng, n))
    sets = [shingles(t) for t in texts]
    got = {}
    for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.component_id, set()).add(r.doc_id)
    assert {frozenset(x) for x in got.values()} == linked(sets)


def test_large_parts(spark, monkeypatch):
    """Parts of the search that don't fit a chunk: chains through many chunks, a large group, and groups that meet in one pair of texts only."""
    monkeypatch.setattr(simhash, "TOGETHER", 6)
    monkeypatch.setattr(simhash, "MOST_SEARCH", 252)
    words = [f"w{i}" for i in range(4000)]
    rng = np.random.default_rng(2)
    chain = [" ".join(words[12 * i : 12 * i + 300]) for i in range(40)]  # each like the next few only
    hot = []
    for _ in range(60):
        copy = words[2000:2300]
        for at in rng.integers(0, 300, 3):
            copy[at] = f"x{rng.integers(10**6)}"
        hot.append(" ".join(copy))
    other = [" ".join(words[2000 + 18 * i : 2300 + 18 * i]) for i in (5, 6, 7, 8)]  # like each other; too far from the hot text
    bridge = [" ".join(words[2000 + 18 * i : 2300 + 18 * i]) for i in (2,)]
    texts = chain + hot + other + bridge
    sets = [shingles(t) for t in texts]
    got = {}
    for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect():
        got.setdefault(r.component_id, set()).add(r.doc_id)
    want = linked(sets)
    assert {frozenset(x) for x in got.values()} == want and max(map(len, want)) >= 40


def test_fingerprints_find_copies_alone(spark, monkeypatch):
    """Near copies are linked by SimHash fingerprints at most 4 bits apart even if no band finds them; unlike texts with near fingerprints stay apart."""
    monkeypatch.setattr(simhash, "_by_minima", lambda classes: classes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false"))
    rng = np.random.default_rng(9)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t + " end") for i, t in enumerate(base)]
    line = "one line that comes again and again in both of these texts "
    rows += [(30, line * 60 + "first"), (31, line * 60 + " ".join(f"x{i}" for i in range(20)))]
    prints = {i: simhash.fingerprint(t, 5) for i, t in rows}
    near = {i for i in range(6) if (prints[i] ^ prints[10 + i]).bit_count() <= 4}
    assert len(near) >= 4 and (prints[30] ^ prints[31]).bit_count() <= 4 and jaccard(shingles(rows[-2][1]), shingles(rows[-1][1])) < 0.8
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 10 if i - 10 in near else i for i, _ in rows}


def test_alike_links_through_others():
    """A chain of sets, each like the next only, is one group, and what is like none is its own."""
    whole = np.arange(1000, dtype=np.uint64)
    sets = [whole[a : a + 400] for a in (0, 40, 80, 120, 500)]
    assert simhash.alike(sets).tolist() == [0, 0, 0, 0, 4]
    assert simhash.alike([sets[0]]).tolist() == [0]
    assert simhash.alike(sets, np.array([7, 8, 9, 10, 8])).tolist() == [0, 0, 0, 0, 0]
    apart = [whole[a : a + 100] for a in (0, 200, 400, 600)]
    assert simhash.alike(apart, np.array([3, 4, 3, 5])).tolist() == [0, 1, 0, 3]


def test_deduplicated_rows(spark):
    """One row of each group stays: repeated rows, equal and null ids, and one id with two texts."""
    a, b, c = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = [(5, a), (7, a), (5, b), (3, b), (None, c), (None, c), (None, c), (9, "x y z"), (9, "x y z"), (None, a)]
    out = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.text, r.doc_id) for r in out.collect()) == [(a, 5), (b, 3), (c, None), ("x y z", 9)]
