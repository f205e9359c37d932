"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the byte n-grams of its lower-cased words, word borders
included. Each falls into a hash bucket with an embedding; the average of all
embeddings goes through a linear softmax. Both are trained by stochastic
gradient descent in numpy (the scheme of Joulin et al., 2016). For prediction
the softmax layer is folded into the embeddings, which leaves one row of logits
for each bucket to look up and average.

Confidence is calibrated on texts set aside: a temperature for the softmax and
the least confidence at which nearly all accepted predictions are right.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import crc_mod, sampled

BITS = 15
SIZES = (2, 3, 4)
#: Bound of the training sample: texts of each language.
EACH = 400
UNKNOWN = "und"
#: Bytes that are worked on at a time.
SLICE = 1 << 19
_OTHER = re.compile(r"[\W\d_]+")
_SPACE = np.uint8(32)


def letters(text: str | None) -> bytes:
    """The lower-cased words of a text, letters only, each with a space on both sides; empty without letters."""
    plain = _OTHER.sub(" ", (text or "").lower()).strip()
    return b" " + plain.encode("utf-8", "replace") + b" " if plain else b""


def _hashed(octets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n-gram size: (size, bucket of the n-gram at each place, is it one). A space may only begin or end an n-gram."""
    wide, space = octets.astype(np.uint32), octets == _SPACE
    rolled = wide
    for size in range(2, max(SIZES) + 1):
        n = len(octets) - size + 1
        if n <= 0:
            return
        rolled = rolled[:n] * np.uint32(0x01000193) + wide[size - 1 :]
        if size in SIZES:
            fine = ~(space[:n] & space[size - 1 :])
            for inner in range(1, size - 1):
                fine &= ~space[inner : inner + n]
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1)
            yield size, (mixed >> np.uint32(32 - BITS)).astype(np.int32), fine


def subwords(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text's subwords and how often each occurs."""
    octets = np.frombuffer(letters(text), dtype=np.uint8)
    counts = np.zeros(1 << BITS, dtype=np.int64)
    for _, bucket, fine in _hashed(octets):
        counts += np.bincount(bucket[fine], minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    """Languages, folded logits by bucket, bias, temperature and the least confidence that is accepted."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def averages(self, texts: list[bytes]) -> np.ndarray:
        """The averaged logits of each text given by letters(), in slices of bounded size."""
        out = np.zeros((len(texts), len(self.languages)))
        seen = np.zeros(len(texts))
        held: list[tuple[int, bytes]] = []
        room = SLICE

        def work() -> None:
            if not held:
                return
            octets = np.frombuffer(b"".join(part for _, part in held), dtype=np.uint8)
            owner = np.array([i for i, _ in held])
            starts = np.cumsum([0] + [len(part) for _, part in held[:-1]])
            for _, bucket, fine in _hashed(octets):
                rows = self.logits[bucket]
                rows[~fine] = 0
                # texts end with a space, so n-grams across two texts aren't ones; those cut off by a slice's end come with the next
                live = starts[starts < len(bucket)]
                sums = np.add.reduceat(rows, live, axis=0)
                np.add.at(out, owner[: len(live)], sums)
                np.add.at(seen, owner[: len(live)], np.add.reduceat(fine.astype(np.int64), live))

        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = min(len(text), at + room)
                if end < len(text):  # a slice ends at a space, which the next one begins with
                    cut = text.rfind(b" ", at + 1, end)
                    end = cut + 1 if cut > at else (text.find(b" ", end) + 1 or len(text))
                held.append((i, text[at:end]))
                room -= end - at
                at = end - 1 if end < len(text) else end
                if room <= 0:
                    work()
                    held, room = [], SLICE
        work()
        return out / np.maximum(seen, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability and acceptance of each text."""
        plain = [letters(t) for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        p = _softmax(self.averages(plain) / self.temperature)
        best, there = p.argmax(axis=1), np.array([bool(x) for x in plain], dtype=bool)
        score = np.where(there, p[np.arange(len(p)), best], 0.0) if len(p) else np.zeros(0)
        return [self.languages[b] if t else UNKNOWN for b, t in zip(best, there, strict=True)], score, there & (score >= self.least)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True)) if z.size else z
    return e / e.sum(axis=1, keepdims=True) if z.size else z


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], dims: int = 16, epochs: int = 12, rate: float = 0.5, seed: int = 0) -> Model:
    """Fit embeddings and softmax to (buckets, counts) rows; every fifth row is set aside to calibrate."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), dtype=np.float32), np.zeros(0))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / dims, 1 / dims, (1 << BITS, dims)).astype(np.float32)
    soft = np.zeros((dims, len(languages)), dtype=np.float32)
    aside = np.arange(len(rows)) % 5 == 4
    use, test = np.flatnonzero(~aside), np.flatnonzero(aside)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(use):
            at, n = rows[i]
            if not len(at):
                continue
            share = (n / n.sum()).astype(np.float32)
            mean = share @ embed[at]
            p = _softmax((mean @ soft)[None])[0]
            p[y[i]] -= 1
            back = soft @ p
            soft -= step * np.outer(mean, p)
            # a text's share of a bucket is small; embeddings move by it times a constant so that they learn as fast as the softmax
            embed[at] -= step * 50 * share[:, None] * back
    logits = embed @ soft
    model = Model(languages, logits.astype(np.float32), np.zeros(len(languages)))
    test = np.array([i for i in test if len(rows[i][0])], dtype=np.int64)
    if len(test):
        z = np.array([(rows[i][1] / rows[i][1].sum()) @ logits[rows[i][0]] for i in test])
        heats = np.geomspace(0.02, 20, 61)
        loss = [-np.log(_softmax(z / t)[np.arange(len(z)), y[test]] + 1e-12).mean() for t in heats]
        model.temperature = float(heats[int(np.argmin(loss))])
        model.least = _least_confidence(_softmax(z / model.temperature), y[test])
    return model


def _least_confidence(p: np.ndarray, y: np.ndarray, precision: float = 0.99) -> float:
    """The least confidence from which on predictions reach the precision; 1 if there is none."""
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= precision)
    return float(score[order][good[-1]]) if len(good) else 1.0


def fit(docs: DataFrame, each_language: int = EACH) -> Model:
    """Learn from docs' text and lang; rows with a null in either, or in doc_id, teach nothing.

    The sample holds each_language different ids of every language at most, all
    of them if it has no more, however often rows repeat. An id with several
    texts of one language counts by one of them.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [subwords(t) for t in batch.column(2).to_pylist()]
            at = pa.array([a.astype("<i4").tobytes() for a, _ in got], pa.binary())
            n = pa.array([b.astype("<i4").tobytes() for _, b in got], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), at, n], ["turn", "lang", "buckets", "counts"])

    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    rows = sampled(known, each_language, "lang").select("turn", "lang", "text")
    got = rows.mapInArrow(each, "turn long, lang string, buckets binary, counts binary").collect()  # each_language rows for each language
    got.sort(key=lambda r: (r["turn"], r["lang"], r["buckets"], r["counts"]))
    unpacked = [(np.frombuffer(r["buckets"], "<i4").astype(np.int64), np.frombuffer(r["counts"], "<i4").astype(np.int64)) for r in got]
    return train(unpacked, [r["lang"] for r in got])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id with lang_pred, score and accepted, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS rows of one number for each language

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                names, score, fine = shared.value.predict(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(fine)], ["doc_id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(each, "doc_id long, lang_pred string, score double, accepted boolean")


def held_out_predictions(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """Train on rows whose crc32(doc_id as text) mod folds is not fold, and predict all.

    Columns: doc_id, held_out, lang_pred, score, accepted. Texts that are null
    or have no letter are `und` with score 0 and are never accepted; without
    rows to learn from all are. accepted is the calibrated rejection and does
    not change lang_pred; of languages as likely the first by name is taken. One
    row for each row of docs; repeated rows get equal results. Texts of any
    length are averaged in slices. An empty table gives an empty table. Columns
    other than doc_id, text and lang are not read.
    """
    place = crc_mod(F.col("doc_id"), folds)
    model = fit(docs.where(place != fold))
    out = predicted(docs, model)
    return out.select("doc_id", (place == fold).alias("held_out"), "lang_pred", "score", "accepted")
