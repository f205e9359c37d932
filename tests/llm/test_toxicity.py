"""Positive-unlabelled learning: held-out accuracy on made texts, the risk's gradient and scores against plain versions."""

import zlib

import numpy as np
import pytest

from pagemill.llm import toxicity

INSULTS = ["idiot", "moron", "scum", "loser"]
ENDINGS = ["a", "ent", "isko", "ur"]


def made(n=3000, seed=4):
    rng = np.random.default_rng(seed)
    vocabulary = [f"word{i}" for i in range(3000)]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocabulary, int(rng.integers(5, 120))))
        toxic = i % 9 == 0
        for _ in range(3 if toxic else 0):
            bad = str(rng.choice(INSULTS)).title() + "!" if i % 2 else "grobian" + str(rng.choice(ENDINGS))
            words[int(rng.integers(len(words)))] = bad
        docs.append((i, " ".join(words)))
        if rng.random() < 0.4:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out(spark):
    docs, labels = made()
    more = [(9001, None), (9002, ""), (9003, "idiot " * 200_000), (9004, "clean " * 200_000), (None, "x"), (9005, "moron"), (9005, "moron")]
    d = spark.createDataFrame([*docs, *more], "doc_id long, text string")
    got = toxicity.held_out_scores(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs) + len(more)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    toxic = [r.predicted for r in held if r.doc_id % 9 == 0]
    clean = [r.predicted for r in held if r.doc_id % 9]
    assert np.mean(toxic) >= 0.95 and np.mean(clean) <= 0.01
    score = {r.doc_id: r.score for r in got}
    assert score[9001] == score[9002] and score[9003] > 0.5 > score[9004] > 0
    assert [r.predicted for r in got if r.doc_id == 9005] == [1, 1]


def test_held_out_on_the_tables(spark):
    """Recall and precision on labelled rows that training didn't see."""
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{path}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = {r.doc_id: r.predicted for r in toxicity.held_out_scores(docs, labels).where("held_out").collect()}
    pairs = [(r.toxic, got[r.doc_id]) for r in labels.collect() if r.doc_id in got]
    hits = sum(t == 1 and p == 1 for t, p in pairs)
    assert hits >= 0.9 * sum(t == 1 for t, _ in pairs)
    assert hits >= 0.95 * sum(p == 1 for _, p in pairs)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = made(600)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    a = toxicity.held_out_scores(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    b = toxicity.held_out_scores(d, spark.createDataFrame(turned, "doc_id long, toxic int")).collect()
    assert {r.doc_id: r.score for r in a} == {r.doc_id: r.score for r in b}


def test_nothing_to_learn_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", 5, 0.1, 7)], "doc_id long, text string, turn int, score double, `_n` int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.doc_id, r.predicted) for r in toxicity.held_out_scores(d, none).collect()] == [(1, 0)]
    assert toxicity.held_out_scores(d.limit(0), none).count() == 0
    nulls = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert toxicity.held_out_scores(d, nulls).count() == 1


def test_sample_counts_ids(spark, monkeypatch):
    """One id in most rows takes one place of the bound, and what the driver gets is as long as the bound."""
    docs = spark.range(20_000).selectExpr("cast(7 as long) as doc_id", "'same text' as text", "1 as toxic")
    docs = docs.unionByName(spark.range(100, 500).selectExpr("id as doc_id", "concat('text ', id) as text", "1 as toxic"))
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda p, u, prior: seen.append((len(p), len(u), prior)))
    toxicity.fit(docs, docs, 10, 30)
    assert seen == [(10, 30, 1.0)]
    toxicity.fit(docs, docs, 1000, 1000)
    assert seen[-1] == (401, 401, 1.0)


def test_scores_against_plain():
    rng = np.random.default_rng(3)
    texts = [None, "", "...", "Idiot idiotic IDIOT word", "ß é 1x", *[t for _, t in made(50)[0]]]
    weights = {int(b): float(rng.normal()) for t in texts for w in toxicity.words_of(t) for b in toxicity.buckets(w)}
    model = toxicity.Model(weights, -0.7)
    got = model.scores(texts)
    for text, score in zip(texts, got, strict=True):
        words, total = toxicity.words_of(text), -0.7
        for w in words:
            for b in {zlib.crc32(x.encode()) & (toxicity.BUCKETS - 1) for x in [w, *["^" + w[:k] for k in (4, 5, 6) if len(w) >= k]]}:
                total += 50 * weights[b] / len(words)
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
        at, rate = toxicity.features(text)
        assert score == pytest.approx(1 / (1 + np.exp(0.7 - 50 * sum(weights[int(b)] * r for b, r in zip(at, rate, strict=True)))))


def test_risk_gradient_against_differences():
    rng = np.random.default_rng(6)
    sigmoid_loss = lambda z: np.logaddexp(0, -z)
    for prior, bias in ((0.1, -1.0), (0.6, -6.0)):  # in the second the corrected part is below 0
        a, b = rng.random((20, 5)), rng.random((70, 5)) * 0.3
        w = np.append(rng.normal(size=5), bias)

        def corrected(w):
            return sigmoid_loss(-(b @ w[:-1] + w[-1])).mean() - prior * sigmoid_loss(-(a @ w[:-1] + w[-1])).mean()

        def risk(w):
            return prior * sigmoid_loss(a @ w[:-1] + w[-1]).mean() + corrected(w) if corrected(w) >= 0 else -corrected(w)

        steps = np.eye(6) * 1e-6
        plain = [(risk(w + s) - risk(w - s)) / 2e-6 for s in steps]
        assert np.allclose(toxicity.risk_gradient(w, a, b, prior), plain, atol=1e-6)


def test_correction_is_non_negative():
    """All unlabelled texts are toxic, far more than the prior says: training stays finite."""
    p = [(np.array([1, 2, 3]), np.ones(3) / 3)] * 20
    model = toxicity.train(p, p * 3 + [(np.array([9]), np.ones(1))] * 60, prior=0.05)
    assert all(np.isfinite(list(model.weights.values()))) and np.isfinite(model.bias)
    assert toxicity.train(p, p, 0.5).weights == {}
