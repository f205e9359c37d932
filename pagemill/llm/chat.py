r"""Chat formatting with shared turns packed once.

A conversation is rendered turn by turn as

    <|im_start|>ROLE newline TEXT<|im_end|> newline

with control strings inside texts made harmless, reversibly: a backslash is
doubled and one is put inside each `<|`. Conversations with the same initial
turns share them: all conversations are sorted by their turns' hashes, which is
the depth-first order of their prefix tree, and a walk along that order emits
only the turns that the one before didn't have. The walk needs one path at a
time, so a first turn that a third of all conversations have fits any number of
tasks.

A packed sequence holds each node of the tree once, in characters; tokenized()
gives the same in the ids of a tokenizer:

- text;
- nodes: start, end, position (the position id of the first character; it
  counts up from there) and sees, the intervals of text that its characters
  attend to besides their own node up to themselves; neighbours are joined;
- loss: intervals under the loss mask, the assistants' texts;
- members: conv_id and the node of its last turn.

A new sequence emits the path of its first conversation anew. What bounds a
sequence are the characters beyond that path, so a first turn of any length is
still shared by as many conversations as a short one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>\n"
#: A sequence is closed after so many characters beyond its first conversation, or conversations.
SEQUENCE_CHARS, SEQUENCE_MEMBERS = 1 << 16, 1 << 14
LOSS_ROLE = "assistant"
PACKED = (
    "text string, nodes array<struct<start:long,end:long,position:long,sees:array<struct<a:long,b:long>>>>, "
    "loss array<struct<a:long,b:long>>, members array<struct<conv_id:long,leaf:int>>"
)
_SPAN = pa.struct([("a", pa.int64()), ("b", pa.int64())])
_NODE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("sees", pa.list_(_SPAN))])
_MEMBER = pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())])
_ARROW = pa.schema([("text", pa.string()), ("nodes", pa.list_(_NODE)), ("loss", pa.list_(_SPAN)), ("members", pa.list_(_MEMBER))])
Turn = tuple[str, str]


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn's characters, and where its text begins and ends in them."""
    head = START + escaped(role).replace("\n", "\\n") + "\n"
    body = escaped(text)
    return head + body + END, len(head), len(head) + len(body)


def parsed(formatted: str) -> list[Turn]:
    """The turns of a formatted conversation; raises on anything else."""
    out, at = [], 0
    while at < len(formatted):
        line, end = formatted.find("\n", at), formatted.find(END, at)
        if not formatted.startswith(START, at) or line < 0 or end < line:
            raise ValueError(f"no turn at character {at}")
        out.append((unescaped(formatted[at + len(START) : line]), unescaped(formatted[line + 1 : end])))
        at = end + len(END)
    return out


class Packer:
    """One packed sequence in the making."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size, self.first = 0, 0
        self.nodes: list[dict] = []
        self.loss: list[dict] = []
        self.members: list[dict] = []
        self.path: list[tuple[Turn, int]] = []

    def add(self, conv_id: int | None, turns: list[Turn]) -> None:
        same = 0
        while same < min(len(turns), len(self.path)) and self.path[same][0] == turns[same]:
            same += 1
        del self.path[same:]
        for turn in turns[same:]:
            chars, a, b = rendered(*turn)
            start, sees, position = self.size, [], 0
            if self.path:
                above = self.nodes[self.path[-1][1]]
                sees = [dict(x) for x in above["sees"]]
                if sees and sees[-1]["b"] == above["start"]:
                    sees[-1]["b"] = above["end"]
                else:
                    sees.append({"a": above["start"], "b": above["end"]})
                position = above["position"] + above["end"] - above["start"]
            self.nodes.append({"start": start, "end": start + len(chars), "position": position, "sees": sees})
            if turn[0] == LOSS_ROLE and b > a:
                self.loss.append({"a": start + a, "b": start + b})
            self.parts.append(chars)
            self.size += len(chars)
            self.path.append((turn, len(self.nodes) - 1))
        self.first = self.first if self.members else self.size
        self.members.append({"conv_id": conv_id, "leaf": self.path[-1][1] if self.path else -1})

    def full(self) -> bool:
        return self.size - self.first >= SEQUENCE_CHARS or len(self.members) >= SEQUENCE_MEMBERS

    def row(self) -> dict:
        return {"text": "".join(self.parts), "nodes": self.nodes, "loss": self.loss, "members": self.members}


def position_ids(row) -> np.ndarray:
    """Each character's position id."""
    return np.concatenate([np.zeros(0, dtype=np.int64), *[n["position"] + np.arange(n["end"] - n["start"]) for n in row["nodes"]]])


def visible(node) -> list[tuple[int, int]]:
    """The intervals that a node's last character attends to: its ancestors' and its own."""
    return [(x["a"], x["b"]) for x in node["sees"]] + [(node["start"], node["end"])]


def conversations(turns: DataFrame) -> DataFrame:
    """One row for each conv_id: its turns in order, as turns, and path, their hashes in one binary.

    A conversation is read as one sequence and so is one row.
    """
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select(F.col("conv_id").cast("long"), said.alias("_said")).groupBy("conv_id").agg(F.sort_array(F.collect_list("_said")).alias("turns"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for said in batch.column(1):
                keys = [xxhash.xxh64_digest(f"{len(t['role'])} {t['role']}{t['text']}".encode("utf-8", "surrogatepass")) for t in said.as_py()]
                paths.append(b"".join(keys))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.binary())], ["conv_id", "turns", "path"])

    kind = rows.schema["turns"].dataType.simpleString()
    return rows.mapInArrow(each, f"conv_id long, turns {kind}, path binary")


def packed(turns: DataFrame) -> DataFrame:
    """Packed sequences of all conversations of turns(conv_id, turn, role, text).

    Rows of one conv_id are put in order of turn, then role, then text, nulls
    first; a null role or text is an empty one. Rows with a null conv_id are one
    conversation. Repeated rows are turns of their own. Equal conversations share
    all their nodes. Texts of any length are whole; a conversation is one row's
    work. An empty table gives no sequences. Other columns are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Packer()
        for batch in batches:
            for conv_id, said in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now.add(conv_id, [(t["role"], t["text"]) for t in said.as_py()])
                if now.full():
                    yield pa.RecordBatch.from_pylist([now.row()], schema=_ARROW)
                    now = Packer()
        if now.members:
            yield pa.RecordBatch.from_pylist([now.row()], schema=_ARROW)

    rows = stored(conversations(turns), "conversations")
    ordered = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.select("conv_id", "turns").mapInArrow(each, PACKED)


TOKENS = PACKED.replace("text string", "ids array<int>")
_TOKEN_ARROW = pa.schema([("ids", pa.list_(pa.int32())), *[f for f in _ARROW if f.name != "text"]])


def in_tokens(row, encode) -> dict:
    """A packed sequence in token ids: ids, nodes with start, end, position and sees, loss intervals, members.

    encode gives the ids of each text of a list. A turn's head, text and end are
    encoded one by one, so the loss mask falls on borders of tokens and a node's
    ids don't depend on its neighbours.
    """
    parts = []
    for node in row["nodes"]:
        chars = row["text"][node["start"] : node["end"]]
        head = chars.index("\n") + 1
        parts += [chars[:head], chars[head : -len(END)], END]
    found = encode(parts)
    sizes = np.array([len(x) for x in found], dtype=np.int64).reshape(-1, 3)
    ends = sizes.sum(axis=1).cumsum()
    starts = ends - sizes.sum(axis=1)
    begin = {n["start"]: i for i, n in enumerate(row["nodes"])}
    finish = {n["end"]: i for i, n in enumerate(row["nodes"])}
    nodes = []
    for i, node in enumerate(row["nodes"]):
        sees = [{"a": int(starts[begin[x["a"]]]), "b": int(ends[finish[x["b"]]])} for x in node["sees"]]
        nodes.append({"start": int(starts[i]), "end": int(ends[i]), "position": sum(x["b"] - x["a"] for x in sees), "sees": sees})
    of = {n["start"]: i for i, n in enumerate(row["nodes"])}
    places = sorted(of)
    loss = []
    for x in row["loss"]:
        i = of[places[bisect_left(places, x["a"] + 1) - 1]]
        if sizes[i, 1]:
            loss.append({"a": int(starts[i] + sizes[i, 0]), "b": int(starts[i] + sizes[i, 0] + sizes[i, 1])})
    return {"ids": [t for x in found for t in x], "nodes": nodes, "loss": loss, "members": row["members"]}


def tokenized(sequences: DataFrame, tokenizer: str) -> DataFrame:
    """Packed sequences in the ids of a tokenizer's vocabulary file: shared turns' ids once, with position ids, attention and loss intervals."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer)
        encode = lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                yield pa.RecordBatch.from_pylist([in_tokens(row, encode)], schema=_TOKEN_ARROW)

    return sequences.mapInArrow(each, TOKENS)


def written(turns: DataFrame) -> DataFrame:
    """The packed sequences, written to the shared folder and read back."""
    return stored(packed(turns), "packed")


def formatted(row, member) -> tuple[str, str]:
    """A member's formatted conversation, and its text under the loss mask, unescaped, from a sequence alone."""
    spans = visible(row["nodes"][member["leaf"]]) if member["leaf"] >= 0 else []
    starts = [x["a"] for x in row["loss"]]
    loss = []
    for a, b in spans:
        for x in row["loss"][bisect_left(starts, a) : bisect_left(starts, b)]:
            loss.append(unescaped(row["text"][x["a"] : x["b"]]))
    return "".join(row["text"][a:b] for a, b in spans), "".join(loss)


def digests(sequences: DataFrame) -> DataFrame:
    """Of each conversation in packed sequences: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                out, known = [], {}
                for member in row["members"]:
                    if member["leaf"] not in known:
                        chars, loss = formatted(row, member)
                        turns = parsed(chars)
                        all_turns = "".join(f"{role}\n{text}\n" for role, text in turns)
                        known[member["leaf"]] = (len(turns), sha(all_turns), len(loss), sha(loss), len(chars))
                    out.append((member["conv_id"], *known[member["leaf"]]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return sequences.mapInArrow(each, schema)
