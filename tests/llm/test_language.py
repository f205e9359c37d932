"""Language identification: held-out accuracy, and folded logits against averages made one by one."""

import zlib

import numpy as np

from pagemill.llm import language

ENDS = {"aa": ["tion", "ing", "the", "er"], "bb": ["ción", "mente", "ado", "que"], "cc": ["ung", "keit", "sch", "lich"]}


def made(n=900, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = list(ENDS)[i % 3]
        words = ["".join(rng.choice(ENDS[lang], int(rng.integers(1, 4)))) for _ in range(int(rng.integers(1, 60)))]
        out.append((i, " ".join(words).capitalize() + ".", lang))
    return out


def test_held_out(spark):
    rows = [*made(), (5000, None, "aa"), (5001, "12 -- 34", None), (5002, "", "bb"), (None, "tioning", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.held_out_predictions(docs).collect()}
    assert len(got) == len(rows)
    for i in (5000, 5001, 5002):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    want = {i: x for i, _, x in rows[:900]}
    held = [r for i, r in got.items() if i in want and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    taken = [r for r in held if r.accepted]
    assert len(taken) > 0.8 * len(held) and np.mean([r.lang_pred == want[r.doc_id] for r in taken]) > 0.98


def test_slices_do_not_change_averages(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [t for _, t, _ in made(40)] + ["", "a", "b" * 3000, "x y z"]
    model = language.Model(["p", "q"], rng.normal(size=(1 << language.BITS, 2)).astype(np.float32), np.zeros(2))
    want = []
    for text in texts:
        at, n = language.subwords(text)
        want.append((n[:, None] * model.logits[at]).sum(axis=0) / max(1, n.sum()))
    plain = [language.letters(t) for t in texts]
    for size in (1 << 19, 64, 7):
        monkeypatch.setattr(language, "SLICE", size)
        assert np.allclose(model.averages(plain), np.array(want), atol=1e-4), size


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.held_out_predictions(docs).collect()] == ["und"]
    assert language.held_out_predictions(docs.limit(0)).count() == 0


def test_no_language_is_lost(spark):
    """An id that repeats in most rows of a language takes one place of the bound; languages with one id are learned too."""
    docs = spark.range(20_000).selectExpr("cast(7 as long) as doc_id", "'das ist der eine text' as text", "'de' as lang")
    more = spark.range(1000, 1900).selectExpr("id as doc_id", "concat('the text number ', id) as text", "'en' as lang")
    model = language.fit(docs.unionByName(more), 10)
    assert model.languages == ["de", "en"]


def test_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda rows, labels: seen.append(labels))
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id % 3 = 0, 'a', if(id % 600 = 1, 'b', 'c')) as lang")
    language.fit(docs.unionByName(docs), 50)
    assert {x: seen[0].count(x) for x in set(seen[0])} == {"a": 50, "b": 10, "c": 50}


def test_training_against_plain():
    """One pass of gradient descent, subword by subword, with the same draws."""
    texts, labels = [t for _, t, _ in made(12)], [x for _, _, x in made(12)]
    rows = [language.subwords(t) for t in texts]
    model = language.train(rows, labels, dims=4, epochs=1, rate=0.3, seed=5)
    names = sorted(set(labels))
    rng = np.random.default_rng(5)
    embed = rng.uniform(-1 / 4, 1 / 4, (1 << language.BITS, 4)).astype(np.float32).astype(np.float64)
    soft = np.zeros((4, len(names)))
    for i in rng.permutation(np.array([i for i in range(12) if i % 5 != 4])):
        grams = [int(b) for b, n in zip(*rows[i], strict=True) for _ in range(n)]
        mean = sum(embed[g] for g in grams) / len(grams)
        e = np.exp(mean @ soft - (mean @ soft).max())
        error = e / e.sum() - np.array([n == labels[i] for n in names])
        back, old = soft @ error, soft.copy()
        soft = old - 0.3 * np.outer(mean, error)
        for g in grams:
            embed[g] -= 0.3 * 50 / len(grams) * back
    assert np.allclose(model.logits, embed @ soft, atol=1e-4)


def test_repeats_ties_long_and_clashing_columns(spark):
    rows = made(300)
    schema = "doc_id long, text string, lang string, turn int, score double, `a.b` int"
    more = [(7000, "tioning", None), (7000, "tioning", None), (7001, "tion " * 200_000, None), (7002, "é", None)]
    docs = spark.createDataFrame([(*r, 1, 2.0, 3) for r in rows + more], schema)
    got = language.held_out_predictions(docs).collect()
    assert len(got) == len(rows) + len(more)
    twice = [r for r in got if r.doc_id == 7000]
    assert twice[0] == twice[1] and twice[0].lang_pred == "aa"
    assert {r.doc_id: r.lang_pred for r in got}[7001] == "aa"
    flat = language.Model(["p", "q"], np.zeros((1 << language.BITS, 2), dtype=np.float32), np.zeros(2))
    assert flat.predict(["abc", None])[0] == ["p", "und"]
