"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank by frequency over the corpus. A rank takes 1 to
4 bytes, little-endian, as many as it needs; the lengths, less 1, stand apart
as two bits each, four to a control byte, lowest bits first. A reader finds the
lengths of a control byte's four ids in a table, adds them up to the places of
the data bytes and gathers those, all in numpy.

A file is a sequence of blocks, each of these parts (integers little-endian):

    magic "PMT1", u32 bytes of the rest up to the newline, u32 documents, u64 ids, u32 crc32 of all that follows
    i64 doc_id, u8 null flag and u64 ids of each document (three arrays)
    control bytes, data bytes, and one newline byte

Files are written by Spark's text writer, one block a row, so tasks commit as
Spark's own do on any file system; a file holds a bounded number of blocks, a
block a bounded number of documents and ids (one document may go beyond it).
Beside the files lies the table of ranks, which is as long as the vocabulary.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import dropped, given_back, new_path, stored, text_of

MAGIC = b"PMT1"
HEAD = struct.Struct("<4sIIQI")
#: A block ends with the document that brings it to so many ids or documents.
BLOCK_IDS, BLOCK_DOCS = 1 << 19, 1 << 14
#: Blocks in one file.
FILE_BLOCKS = 16
#: Bytes of text that are encoded together.
BATCH_BYTES = 6 << 20
#: Parts of pieces in a generation of those that a worker remembers; it keeps two.
REMEMBERED = 260_000
_LENGTHS = (1 + ((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3)).astype(np.uint8)  # of the four ids of each control byte
_PLACES = np.arange(4, dtype=np.uint8)


def coded(ranks: np.ndarray) -> bytes:
    """Control bytes and data bytes of ranks."""
    ranks = ranks.astype("<u4", copy=False)
    more = (ranks > 0xFF).view(np.uint8) + (ranks > 0xFFFF).view(np.uint8) + (ranks > 0xFFFFFF).view(np.uint8)
    two = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    two[: len(ranks)] = more
    two = two.reshape(-1, 4)
    control = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    octets = ranks.view(np.uint8).reshape(-1, 4)
    width = int(more.max(initial=0)) + 1  # bytes beyond the longest are all left out
    return control.tobytes() + octets[:, :width][_PLACES[:width] <= more[:, None]].tobytes()


def decoded(raw: bytes | memoryview, n: int) -> np.ndarray:
    """The n ranks of control and data bytes."""
    octets = np.frombuffer(raw, dtype=np.uint8)
    control, data = octets[: -(-n // 4)], octets[-(-n // 4) :]
    sizes = _LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(sizes, dtype=np.int64)
    if n and ends[-1] != len(data):
        raise ValueError("data bytes don't match the control bytes")
    starts = ends - sizes
    ranks = data[starts].astype(np.uint32)
    for more in range(1, int(sizes.max(initial=1))):
        at = np.flatnonzero(sizes > more)
        ranks[at] |= data[starts[at] + more].astype(np.uint32) << np.uint32(8 * more)
    return ranks


def block(doc_ids: list[int | None], counts: list[int], ranks: np.ndarray) -> bytes:
    """One block, without its newline."""
    ids = np.array([i or 0 for i in doc_ids], dtype="<i8")
    nulls = np.array([i is None for i in doc_ids], dtype=np.uint8)
    body = ids.tobytes() + nulls.tobytes() + np.array(counts, dtype="<u8").tobytes() + coded(ranks)
    return HEAD.pack(MAGIC, len(body), len(doc_ids), len(ranks), zlib.crc32(body)) + body


def blocks(raw: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, counts, ranks) of a file's blocks; raises on damage."""
    view, at = memoryview(raw), 0
    while at < len(view):
        magic, size, docs, n, crc = HEAD.unpack_from(view, at)
        body = view[at + HEAD.size : at + HEAD.size + size]
        if magic != MAGIC or len(body) != size or zlib.crc32(body) != crc:
            raise ValueError(f"damaged block at byte {at}")
        ids = np.frombuffer(body[: 8 * docs], dtype="<i8").tolist()
        nulls = np.frombuffer(body[8 * docs : 9 * docs], dtype=np.uint8)
        counts = np.frombuffer(body[9 * docs : 17 * docs], dtype="<u8").astype(np.int64)
        yield [None if null else i for i, null in zip(ids, nulls, strict=True)], counts, decoded(body[17 * docs :], n)
        at += HEAD.size + size + 1


class Encoder:
    """A tokenizer's ids of whole texts.

    With a vocabulary whose pre-tokenizer drops white space, never joins across
    it and sets letters apart from marks, a text's ids are those of its
    space-separated pieces, in order. Texts are split, pieces are told apart and
    their ids put together in Arrow, so that each different piece of a batch is
    looked at once. A piece of plain letters, with or without marks behind, is
    cut into these two parts; any other is one part. A worker remembers the ids
    of parts it met lately. New words go through the tokenizer's own byte-pair
    model many at a time: they are lower-cased as its normalizer would, and ids
    that end a word tell where the next begins. All other new parts go through
    the whole tokenizer. A tokenizer of any other kind encodes whole texts.
    """

    def __init__(self, path: str, end: int | None):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {b"": b""}
        self.before: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_words = bool(suffix) and spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _PRE_TOKENIZER
        # control strings begin with "<|", so a word and the marks behind it hold none between them
        self.by_words = self.by_words and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        if self.by_words:
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
            self.bare = Tokenizer(models.BPE(vocab=spec["model"]["vocab"], merges=merges, end_of_word_suffix=suffix, cache_capacity=0))
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 and (end or 0) < 1 << 16 else "<u4"
        self.end = b"" if end is None else np.array([end], dtype=self.width).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.width).tobytes() for e in found]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of plain letters, many in one go."""
        joined = [b" ".join(some).decode().lower() for some in itertools.batched(words, _JOINED)]
        joined = [j if j.isascii() else j.encode().decode("latin-1").translate(_BYTE_LETTERS) for j in joined]
        found = self.bare.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in found), dtype=self.width)
        ends = ids.itemsize * (np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(words):
            raise ValueError("word ends don't match the words")
        raw, cuts = ids.tobytes(), [0, *ends.tolist()]
        return [raw[a:b] for a, b in itertools.pairwise(cuts)]

    def _of_parts(self, parts: list[bytes], plain: np.ndarray) -> list[bytes]:
        """Ids of different parts; plain tells which are words."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {b"": b""}
        known, before = self.known, self.before
        ids = list(map(known.get, parts))
        gaps = [i for i, x in enumerate(ids) if x is None]
        if before:
            for i in gaps:
                if (x := before.get(parts[i])) is not None:
                    ids[i] = known[parts[i]] = x
            gaps = [i for i in gaps if ids[i] is None]
        words, others = [i for i in gaps if plain[i]], [i for i in gaps if not plain[i]]
        new = self._words([parts[i] for i in words]) + self._whole([parts[i].decode() for i in others])
        for i, x in zip(words + others, new, strict=True):
            ids[i] = known[parts[i]] = x
        return ids

    def _of_pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of different pieces without white space, as binary values."""
        n, (_, ends, data) = len(pieces), pieces.buffers()
        if not data:  # no piece but the empty one
            return pa.array([b""] * n, pa.large_binary())
        at = np.frombuffer(ends, dtype=np.int32)[: n + 1]
        octets = np.frombuffer(data, dtype=np.uint8)[: at[-1]]
        letters = pc.binary_length(pc.ascii_rtrim(pieces, _MARKS)).to_numpy()
        odd = _ODD[octets]
        odd[1:] &= ~((octets[:-1] == 0xC3) & _BEHIND_C3[octets[1:]])
        odds = np.append(0, np.cumsum(odd, dtype=np.int32))
        letters = np.where(odds[at[:-1] + letters] == odds[at[:-1]], letters, 0)
        cuts = np.empty(2 * n + 1, dtype=np.int32)
        cuts[::2], cuts[1::2] = at, at[:-1] + letters
        # words and what is behind them, in turn, in the bytes of the pieces
        parts = pa.Array.from_buffers(pa.binary(), 2 * n, [None, pa.py_buffer(cuts), data]).dictionary_encode()
        plain = np.zeros(len(parts.dictionary), dtype=bool)
        plain[parts.indices.to_numpy()[::2]] = True
        ids = self._of_parts(parts.dictionary.to_numpy(zero_copy_only=False).tolist(), plain)
        found = pa.array(ids, pa.large_binary()).take(parts.indices)
        ends = np.frombuffer(found.buffers()[1], dtype=np.int64)[: 2 * n + 1 : 2].copy()
        return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), found.buffers()[2]])

    def __call__(self, texts: list[bytes] | pa.Array) -> list[bytes]:
        """Each UTF-8 text's ids and the end id, as little-endian unsigned integers of self.width."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary())
        if not self.by_words:
            return [ids + self.end for ids in self._whole([t.decode() for t in texts.to_pylist()])]
        texts = texts.view(pa.string())
        small = pc.ascii_lower(texts)
        control = pc.match_substring(texts, "<|")  # there may be a control string, whose case counts
        split = pc.ascii_split_whitespace(pc.if_else(control, texts, small) if pc.any(control).as_py() else small)
        pieces = split.flatten().dictionary_encode()  # the tokenizer sees any other white space
        ids = self._of_pieces(pieces.dictionary).take(pieces.indices)
        if not len(ids):
            return [self.end] * len(texts)
        after = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))
        cuts = np.frombuffer(ids.buffers()[1], dtype=np.int64)[after].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [b"".join((raw[a:b], self.end)) for a, b in itertools.pairwise(cuts)]


#: The normalizer and pre-tokenizer, as in a vocabulary file, for which pieces stand for the text. Fixed values.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The marks that may stand behind a word: the pre-tokenizer sets any run of them apart at the end of a piece.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words are of letters that composition leaves alone and that have one lower-case letter each: A-Z, a-z and À to ÿ, which
#: are C3 and one more byte, but for × and ÷. Bytes that are odd wherever they stand in a word, and those that follow C3.
_ODD = ~np.isin(np.arange(256), [*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0xC3])
_BEHIND_C3 = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])
#: New words that are given to the model as one text.
_JOINED = 200
#: Byte-level models write the bytes 161 to 172 and 174 to 255 as the characters of that number, those from 127 to 160 and 173 as 289 on.
_BYTE_LETTERS = {b: 289 + i for i, b in enumerate([*range(127, 161), 173])}


@cache
def encoder(path: str, end: int | None) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory
    return Encoder(path, end)


def _forgotten() -> None:
    """Drop what a worker remembers; writing and reading files need the room."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        given_back()


_SQUEEZE, _EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(ids: bytes, width: str) -> bytes:
    """Ids as they travel between stages: compressed, with their width."""
    return width[-1:].encode() + _SQUEEZE.compress(ids)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(_EXPAND.decompress(memoryview(raw)[1:]), dtype="<u" + chr(raw[0]))


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about BATCH_BYTES of text; one text may go beyond it."""
    turn = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64) // BATCH_BYTES
    for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def tokenized(docs: DataFrame, tokenizer: str, end: int | None = 1) -> DataFrame:
    """doc_id, ids (packed) and n of every whole text; null is an empty text.

    Each task adds one row with n = -1, how often it met each id (packed in
    eight bytes each), so that frequencies need no pass over the ids.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end)
        seen = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for some in _bounded(batch):
                ids = encode(some.column(1))
                got = np.bincount(np.frombuffer(b"".join(ids), dtype=encode.width))
                seen = np.append(seen, np.zeros(max(0, len(got) - len(seen)), dtype=np.int64))
                seen[: len(got)] += got
                packed = pa.array([_packed(x, encode.width) for x in ids], pa.binary())
                n = pa.array([len(x) // int(encode.width[-1]) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), packed, n], ["doc_id", "ids", "n"])
        given_back()
        if len(seen):
            row = [pa.array([None], pa.int64()), pa.array([_packed(seen.astype("<u8").tobytes(), "<u8")]), pa.array([-1])]
            yield pa.RecordBatch.from_arrays(row, ["doc_id", "ids", "n"])

    return docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text")).mapInArrow(each, "doc_id long, ids binary, n long")


def frequency_ranks(tokens: DataFrame) -> DataFrame:
    """(id, rank) of all ids found, the most frequent first, then by id. No longer than the vocabulary."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                seen = _unpacked(raw.as_py()).astype(np.int64)
                at = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["id", "n"])

    counts = tokens.where("n = -1").select("ids").mapInArrow(each, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1
    return counts.select("id", rank.cast("long").alias("rank"))


def write(tokens: DataFrame, path: str) -> None:
    """Write tokens(doc_id, ids, n) to files under path, in ascending doc_id order, nulls first, with their table of ranks."""
    spark = tokens.sparkSession
    frequency_ranks(tokens).coalesce(1).write.parquet(f"{path}/ranks")
    pairs = spark.read.parquet(f"{path}/ranks").toPandas()
    table = np.zeros(int(pairs["id"].max()) + 1 if len(pairs) else 0, dtype=np.uint32)
    table[pairs["id"].to_numpy()] = pairs["rank"].to_numpy()
    shared = spark.sparkContext.broadcast(table)  # 4 bytes for each id of the vocabulary

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forgotten()
        ids: list[int | None] = []
        counts: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def full() -> pa.RecordBatch:
            nonlocal held
            raw = block(ids, counts, shared.value[np.concatenate(parts)])
            for x in (ids, counts, parts):
                x.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["raw"])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = _unpacked(raw.as_py())
                ids.append(doc_id)
                counts.append(len(values))
                parts.append(values)
                held += len(values)
                if held >= BLOCK_IDS or len(ids) >= BLOCK_DOCS:
                    yield full()
        if ids:
            yield full()

    ordered = tokens.where("n >= 0").repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "n", "ids")
    raw = ordered.select("doc_id", "ids").mapInArrow(each, "raw binary").select(F.col("raw").cast("string").alias("value"))
    raw.write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/files")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone.

    start counts the ids of all documents before it, in the order of the files.
    """
    pairs = spark.read.parquet(f"{path}/ranks").toPandas()
    back = np.zeros(len(pairs), dtype="<u4")
    back[pairs["rank"].to_numpy()] = pairs["id"].to_numpy()
    shared = spark.sparkContext.broadcast(back)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forgotten()
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at = 0
                for doc_ids, counts, ranks in blocks(raw.as_py()):
                    ids = shared.value[ranks]
                    ends = np.cumsum(counts)
                    starts = ends - counts
                    crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    columns = [pa.array([name] * len(doc_ids)), pa.array(doc_ids, pa.int64()), pa.array(at + starts), pa.array(counts), pa.array(crcs, pa.int64())]
                    at += int(counts.sum())
                    yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "start", "n_tokens", "ids_crc32"])

    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/files").select(name.alias("file"), "content")
    rows = stored(files.mapInArrow(each, "file string, doc_id long, start long, n_tokens long, ids_crc32 long"), "token-rows")
    ids_in = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # one row for each file; a file's name has the number of its part, then its own number within the part
    number = lambda mark: F.regexp_extract("file", mark, 1).cast("long")
    order = Window.orderBy(number(r"^part-(\d+)"), number(r"-c(\d+)\.")).rowsBetween(Window.unboundedPreceding, -1)
    base = ids_in.select(F.col("file").alias("_f"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    joined = rows.join(base, F.col("file") == F.col("_f"))
    return joined.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def encoded_and_read(docs: DataFrame, tokenizer: str, end: int | None = 1) -> DataFrame:
    """Write all documents' ids to new files in the shared folder and read them back.

    Null texts have only the end id. Documents with a null doc_id come first.
    Repeated doc_ids are documents of their own, ordered by their ids. A text of
    any length is one document of one block. An empty table gives an empty table.
    Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    found = tokenized(docs, tokenizer, end)
    found.write.option("compression", "uncompressed").parquet(f"{path}/tokens")  # the ids are compressed already
    tokens = spark.read.schema(found.schema).parquet(f"{path}/tokens")
    write(tokens, path)
    dropped(tokens)
    return read(spark, path)
