"""Token files: the coding, and a round trip against the tokenizer itself."""

import zlib

import numpy as np
import pytest

from pagemill.llm import token_files
from pagemill.llm.common import new_path, stored

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_coding():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        raw = token_files.coded(ranks)
        assert (token_files.decoded(raw, n) == ranks).all()
    edges = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], dtype=np.uint32)
    assert (token_files.decoded(token_files.coded(edges), 8) == edges).all()
    assert len(token_files.coded(edges)) == 2 + 2 * (1 + 2 + 3 + 4)


def test_blocks_and_damage():
    raw = token_files.block([3, None], [2, 0], np.array([7, 300], dtype=np.uint32)) + b"\n"
    raw += token_files.block([5], [1], np.array([10], dtype=np.uint32)) + b"\n"
    got = [(ids, counts.tolist(), ranks.tolist()) for ids, counts, ranks in token_files.blocks(raw)]
    assert got == [([3, None], [2, 0], [7, 300]), ([5], [1], [10])]
    broken = bytearray(raw)
    broken[40] ^= 1
    with pytest.raises(ValueError):
        list(token_files.blocks(bytes(broken)))


TEXTS = [
    None, "", "  ", "Hello, hello world! it's 2 of 3...", "A<|endoftext|>b <|endoftext|>, c", "É é é ﬁ Straße ΣΑΣ x\x1cy z\x85w",
    "don't we'll THEY'RE x's. y't, (a) [b], c:d; e--f! ??", "\n".join(["word*** thing%%%", "10.5 a1b2 naïve."]), "漢字かな交じり文、です。 " * 20, "x" * 5000, "\x0b\x0ca\r\nb",
]


def test_encoder_equals_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    encode = token_files.Encoder(PATH, 1)
    for text in TEXTS:
        want = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(encode([(text or "").encode()])[0], encode.width).tolist() == want, text
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    for text in TEXTS + TEXTS:
        want = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(encode([(text or "").encode()])[0], encode.width).tolist() == want, text
    assert token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 1).by_words is False


@pytest.mark.parametrize("small", [False, True])
def test_round_trip(spark, monkeypatch, small):
    from tokenizers import Tokenizer

    if small:
        monkeypatch.setattr(token_files, "BLOCK_DOCS", 2)
        monkeypatch.setattr(token_files, "FILE_BLOCKS", 1)
    t = Tokenizer.from_file(PATH)
    rows = [(i * 37 % 101, TEXTS[i % len(TEXTS)], "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(5)
    got = {r.doc_id: r for r in token_files.encoded_and_read(docs, PATH, 1).collect()}
    start = 0
    for doc_id, text, _ in sorted(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        r = got.pop(doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_edges(spark):
    schema = "doc_id long, text string"
    assert token_files.encoded_and_read(spark.createDataFrame([], schema), PATH).count() == 0
    got = token_files.encoded_and_read(spark.createDataFrame([(4, "a"), (4, "a b"), (None, None)], schema), PATH).collect()
    assert sorted((r.doc_id is not None, r.start, r.n_tokens) for r in got) == [(False, 0, 1), (True, 1, 2), (True, 3, 3)]


def test_ranks_by_frequency(spark):
    docs = spark.createDataFrame([(1, "the the the cat")], "doc_id long, text string")
    path = new_path(spark, "ranks")
    token_files.write(stored(token_files.tokenized(docs, PATH, 1), "tokens"), path)
    rows = {r["rank"]: r["id"] for r in spark.read.parquet(f"{path}/ranks").collect()}
    from tokenizers import Tokenizer

    assert rows[0] == Tokenizer.from_file(PATH).encode("the").ids[0] and rows[1] == 1


def test_very_long_texts_and_clashing_columns(spark):
    """Megabytes of words, of one word and of marks: ids of the whole text, as the library gives them."""
    from tokenizers import Tokenizer

    from pagemill.llm.queries import tokenizer_path

    own = Tokenizer.from_file(tokenizer_path())
    texts = ["The end of a line, and more. " * 40_000, "x" * 200_000, "!?" * 100_000, "é " * 300_000, "long\n" * 3]
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in enumerate(texts)], "doc_id long, text string, ids int, `n.x` string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.encoded_and_read(docs, tokenizer_path(), 1).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_marks_behind_words_cost_one_look(monkeypatch):
    """Words with any marks behind, new to a worker, don't go through the whole tokenizer one by one; parts are looked up apart."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    encode = token_files.Encoder(PATH, 1)
    asked: list[str] = []
    whole = encode._whole
    monkeypatch.setattr(encode, "_whole", lambda texts: asked.extend(texts) or whole(texts))
    words = [f"{a}{b}é{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    texts = [" ".join(w + m for w in words) for m in ("***", ")", "###", ".", "'", "|>", "")] + ["", "\x85", "*** )"]
    got = encode([x.encode() for x in texts])
    assert sorted(asked) == sorted(["***", ")", "###", ".", "'", "|>", "\x85"])
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, encode.width).tolist() == [*t.encode(text, add_special_tokens=False).ids, 1], text
    assert encode(pa.array([b"left out", *(x.encode() for x in texts)]).slice(1)) == got and len(asked) == 7


@pytest.mark.parametrize("text", ["\x85", " ", "***", "×", "É", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "é ≠ X́!"])
def test_a_batch_of_one_kind(text):
    from tokenizers import Tokenizer

    encode = token_files.Encoder(PATH, 1)
    want = [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 1]
    for n in (1, 3):
        assert [np.frombuffer(x, encode.width).tolist() for x in encode([text.encode()] * n)] == [want] * n
    assert encode([]) == []


def test_batches_bounded_in_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "BATCH_BYTES", 10)
    texts = [b"", b"abc", b"d" * 25, b"", b"efg", b"hi", b"j" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    parts = list(token_files._bounded(batch))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts and len(parts) > 2
    assert all(sum(map(len, p.column(1).to_pylist()[1:])) <= 10 for p in parts)
    assert sum(p.num_rows for p in token_files._bounded(batch.slice(0, 0))) == 0
