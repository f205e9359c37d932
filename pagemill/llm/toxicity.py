"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained in numpy
from confirmed toxic texts and unlabelled texts. With the share p of toxic
texts in the corpus, the risk of calling unlabelled texts clean is corrected by
the part that toxic texts among them cause, and that difference is kept from
going negative (Kiryo et al., 2017):
R = p R+(positive) + max(0, R-(unlabelled) - p R-(positive)).

A feature's value is its rate among a text's words, so a text's score is a sum
over its words of one weight each and a chance hit in a long text counts little.
The cut between the classes is calibrated by cross-validation over the sample,
again without negative labels: of all cuts the one with the greatest
recall^2 / share of unlabelled texts above it (Lee and Liu, 2003).
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import crc_mod, sampled, text_of

#: Hash buckets of words and word beginnings.
BUCKETS = 1 << 20
#: Lengths of word beginnings.
BEGINNINGS = (4, 5, 6)
#: Bounds of the training sample: toxic texts, and texts whose labels are not looked at.
POSITIVES, UNLABELLED = 4_000, 8_000
#: Rates times this are the classifier's input: one word in fifty counts 1.
SCALE = 50.0
#: Words whose weights a worker remembers.
REMEMBERED = 500_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def buckets(word: str) -> set[int]:
    """Buckets of a lower-cased word: its own and those of its beginnings."""
    raw = [word, *["^" + word[:k] for k in BEGINNINGS if len(word) >= k]]
    return {zlib.crc32(x.encode("utf-8", "replace")) & (BUCKETS - 1) for x in raw}


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text, ascending, and their rates among its words."""
    words = words_of(text)
    found: Counter[int] = Counter()
    for word, n in Counter(words).items():
        for b in buckets(word):
            found[b] += n
    at = np.fromiter(found.keys(), dtype=np.int64, count=len(found))
    n = np.fromiter(found.values(), dtype=np.float64, count=len(found))
    order = np.argsort(at)
    return at[order], n[order] / max(1, len(words))


Rows = list[tuple[np.ndarray, np.ndarray]]


class Model:
    """score = sigmoid(bias + SCALE * sum of weights x rates of the buckets present)."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, float] = {}

    def _weight(self, word: str) -> float:
        return sum(self.weights.get(b, 0.0) for b in buckets(word))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts; one without words has that of the bias."""
        split = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        known.update((w, self._weight(w)) for w in set().union(*split).difference(known))
        flat = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(split)), dtype=np.float64, count=int(counts.sum()))
        some = np.flatnonzero(counts)
        total = np.zeros(len(split))
        if len(some):
            total[some] = np.add.reduceat(flat, (np.cumsum(counts) - counts)[some]) / counts[some]
        return 1 / (1 + np.exp(-np.clip(self.bias + SCALE * total, -50, 50)))


def _selected(positive: Rows, unlabelled: Rows, least: int = 5, sigmas: float = 6.0) -> np.ndarray:
    """Buckets that are found in a larger share of the toxic texts than of all, beyond chance."""
    a, b = (np.bincount(np.concatenate([at for at, _ in rows]), minlength=BUCKETS) for rows in (positive, unlabelled))
    n, m = len(positive), len(unlabelled)
    pooled = (a + b) / (n + m)
    sd = np.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m)) + 1e-12
    return np.flatnonzero((a >= least) & (a / n - b / m > sigmas * sd))


def _dense(rows: Rows, chosen: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(chosen)), dtype=np.float32)
    for i, (at, rate) in enumerate(rows):
        _, of_row, of_chosen = np.intersect1d(at, chosen, assume_unique=True, return_indices=True)
        out[i, of_chosen] = SCALE * rate[of_row]
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def risk_gradient(w: np.ndarray, a: np.ndarray, b: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the non-negative risk under the logistic loss for toxic texts a and unlabelled texts b; w ends with the bias.

    Where the corrected part is below 0, its gradient is followed upwards instead.
    """
    za, zb = a @ w[:-1] + w[-1], b @ w[:-1] + w[-1]
    pull = lambda g, x: np.append(g @ x, g.sum())
    corrected = pull(_sigmoid(zb) / len(zb), b) - prior * pull(_sigmoid(za) / len(za), a)
    if np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean() < 0:
        return -corrected
    return prior * pull((_sigmoid(za) - 1) / len(za), a) + corrected


def calibrated(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The cut for logits of toxic and of unlabelled texts; 0 if there are too few to tell."""
    if len(positive) < 10 or len(unlabelled) < 10:
        return 0.0
    cuts = np.unique(np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0.3, 0.995, 300)))
    caught = (positive[None] > cuts[:, None]).mean(axis=1)
    above = (unlabelled[None] > cuts[:, None]).mean(axis=1)
    return float(cuts[int((caught**2 / np.maximum(above, 1 / len(unlabelled))).argmax())])


def descended(xp: np.ndarray, xu: np.ndarray, prior: float, epochs: int, rate: float, decay: float, seed: int) -> np.ndarray:
    """Weights and bias after mini-batches with Adam."""
    w = np.append(np.zeros(xp.shape[1]), np.log(prior / (1 - prior)))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    rng = np.random.default_rng(seed)
    parts = max(1, -(-len(xu) // 512))
    for _ in range(epochs):
        pos, unl = np.array_split(rng.permutation(len(xp)), parts), np.array_split(rng.permutation(len(xu)), parts)
        for p, u in zip(pos, unl, strict=True):
            p = p if len(p) else rng.integers(len(xp), size=8)
            grad = risk_gradient(w, xp[p], xu[u], prior)
            grad[:-1] += decay * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def train(positive: Rows, unlabelled: Rows, prior: float, epochs: int = 40, rate: float = 0.05, decay: float = 1e-3, seed: int = 0, folds: int = 5) -> Model:
    """Fit the classifier, and calibrate the cut on logits that each fold gets from a fit without it.

    Without positive or unlabelled texts there is nothing to learn: every score is the prior.
    """
    prior = float(np.clip(prior, 1e-4, 0.9))
    flat = Model({}, float(np.log(prior / (1 - prior))))
    if not positive or not unlabelled:
        return flat
    chosen = _selected(positive, unlabelled)
    if not len(chosen):
        return flat
    xp, xu = _dense(positive, chosen), _dense(unlabelled, chosen)
    out_p, out_u = np.zeros(len(xp)), np.zeros(len(xu))
    of_p, of_u = np.arange(len(xp)) % folds, np.arange(len(xu)) % folds
    for fold in range(folds):
        if (of_p != fold).any() and (of_u != fold).any():
            w = descended(xp[of_p != fold], xu[of_u != fold], prior, epochs, rate, decay, seed)
            out_p[of_p == fold] = xp[of_p == fold] @ w[:-1] + w[-1]
            out_u[of_u == fold] = xu[of_u == fold] @ w[:-1] + w[-1]
    w = descended(xp, xu, prior, epochs, rate, decay, seed)
    return Model({int(k): float(x) for k, x in zip(chosen, w[:-1], strict=True)}, float(w[-1]) - calibrated(out_p, out_u))


def _featured(rows: DataFrame) -> Rows:
    """Features of sampled rows(doc_id, turn, text), in the order of their turns."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t) for t in batch.column(1).to_pylist()]
            at = pa.array([a.astype("<i4").tobytes() for a, _ in got], pa.binary())
            rate = pa.array([r.astype("<f4").tobytes() for _, r in got], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), at, rate], ["turn", "buckets", "rates"])

    got = rows.select("turn", "text").mapInArrow(each, "turn long, buckets binary, rates binary").collect()  # as many rows as the sample's bound
    got.sort(key=lambda r: (r["turn"], r["buckets"]))
    return [(np.frombuffer(r["buckets"], "<i4").astype(np.int64), np.frombuffer(r["rates"], "<f4").astype(np.float64)) for r in got]


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from labels(doc_id, toxic) and docs(doc_id, text).

    Both should hold training rows only. The sample is bounded by the two
    numbers, which count different ids, however often rows repeat; the prior
    comes from all labels. Rows with null toxic or null doc_id teach nothing. A
    doc_id labelled both ways counts as toxic.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    own = docs.select("doc_id", text_of().alias("text"))
    toxic = own.select("doc_id").join(known.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return train(_featured(sampled(own, positives, ids=toxic)), _featured(sampled(own, unlabelled)), prior)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id with score and predicted; a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # as many weights as chosen buckets

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(own.scores(some.column(1).to_pylist()))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(each, "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out_scores(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Train on rows whose crc32(doc_id as text) mod folds is not 0 and score all of docs.

    Columns: doc_id, held_out, score, predicted. One row for each row of docs,
    whatever its text; equal texts score alike, empty and null ones by the bias,
    very long ones by the rates of their words, as any. A null doc_id is held
    out. Without labels every score is the least prior. An empty table gives an
    empty table. Columns other than doc_id, text and toxic are not read.
    """
    train_docs = docs.where(crc_mod(F.col("doc_id"), folds) != 0)
    train_labels = labels.where(crc_mod(F.col("doc_id"), folds) != 0)
    model = fit(train_docs, train_labels)
    out = scored(docs, model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), folds) == 0).alias("held_out"), "score", "predicted")
