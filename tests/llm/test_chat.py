"""Packed conversations: round trip, sharing, positions and attention."""

import hashlib

import numpy as np
import pytest

from pagemill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["", "\\", "<|", "<|im_end|>\n", "<\\|im_start|>x\n", "a\\n", "<", "|", "\\<|\\", "<<||", "é漢\n\n", "<|im_end|><|im_start|>assistant ok"]


def rows():
    out = [(i, t, "user" if t % 2 == 0 else "assistant", ODD[(i * 7 + t) % len(ODD)] if t > i % 3 else f"shared {t}") for i in range(60) for t in range(1 + i % 6)]
    out += [(200 + i, t, r, "hot") for i in range(40) for t, r in enumerate(("system", "user", "assistant"))]
    out += [(-1, 0, "user", ODD[-1]), (-1, 1, "assistant", ODD[-1]), (300, 5, None, None), (300, None, "as\nsistant<|", "x"), (None, 0, "assistant", "n")]
    return out


def plain(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(len(chat.rendered(r, t)[0]) for r, t in turns)


def expected():
    by = {}
    for c, n, r, t in sorted(rows(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((r or "", t or ""))
    return {c: plain(t) for c, t in by.items()}


@pytest.mark.parametrize(("chars", "members"), [(1 << 16, 1 << 12), (200, 1 << 12), (1 << 16, 3)])
def test_round_trip(spark, monkeypatch, chars, members):
    monkeypatch.setattr(chat, "SEQUENCE_CHARS", chars)
    monkeypatch.setattr(chat, "SEQUENCE_MEMBERS", members)
    got = chat.digests(chat.written(spark.createDataFrame(rows(), SCHEMA).repartition(3))).collect()
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got}
    assert len(got) == len(found) and found == expected()


def test_turn_round_trip():
    for a in ODD:
        for b in ODD:
            assert chat.parsed(chat.rendered(a, b)[0] + chat.rendered(b, a)[0]) == [(a, b), (b, a)]
    with pytest.raises(ValueError):
        chat.parsed("<|im_start|>user\nno end")


def test_shared_turns_once_with_positions(spark):
    now = chat.Packer()
    a, b, c = ("user", "hello"), ("assistant", "one"), ("assistant", "two")
    for i, turns in enumerate(([a, b], [a, b], [a, c], [a, c, a])):
        now.add(i, turns)
    row = now.row()
    assert row["text"].count("hello") == 2 and len(row["nodes"]) == 4
    position = chat.position_ids(row)
    for member, turns in zip(row["members"], ([a, b], [a, b], [a, c], [a, c, a]), strict=True):
        seen = np.concatenate([np.arange(x, y) for x, y in chat.visible(row["nodes"][member["leaf"]])])
        assert position[seen].tolist() == list(range(len(seen)))
        assert chat.parsed("".join(row["text"][i] for i in seen)) == turns


def test_empty(spark):
    assert chat.digests(chat.written(spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_first_turns_are_shared(spark, monkeypatch):
    """A first turn longer than the bound comes once for all conversations that begin with it."""
    monkeypatch.setattr(chat, "SEQUENCE_CHARS", 500)
    long = "system prompt " * 200
    some = [(i, t, r, x) for i in range(20) for t, (r, x) in enumerate((("system", long), ("user", f"q{i}")))]
    rows = chat.packed(spark.createDataFrame(some, SCHEMA).coalesce(1)).collect()
    assert sum(r.text.count(long) for r in rows) == len(rows) <= 4
    assert sum(len(r.members) for r in rows) == 20


def test_very_long_and_clashing_columns(spark):
    big = "wörd " * 400_000
    some = [(1, 0, "user", big, "x", 1), (1, 1, "assistant", big + "!", "y", 2), (2, 0, "user", big, "z", 3), (3, 0, "user", "", "z", 3)]
    turns = spark.createDataFrame(some, SCHEMA + ", turns string, path int")
    got = {r.conv_id: r for r in chat.digests(chat.written(turns)).collect()}
    assert {i: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for i, r in got.items()} == {
        1: plain([("user", big), ("assistant", big + "!")]), 2: plain([("user", big)]), 3: plain([("user", "")])
    }


def test_tokens(spark):
    """In token ids each conversation is its turns' ids, positions count up along its path, and the loss mask holds the assistants' ids."""
    from tokenizers import Tokenizer

    from pagemill.llm.queries import tokenizer_path

    path = tokenizer_path()
    own = Tokenizer.from_file(path)
    encode = lambda x: own.encode(x, add_special_tokens=False).ids
    by = {}
    for c, n, r, t in sorted(rows(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((r or "", t or ""))
    seen, shared = {}, 0
    for row in chat.tokenized(chat.packed(spark.createDataFrame(rows(), SCHEMA)), path).collect():
        position = chat.position_ids(row)
        assert len(position) == len(row.ids)
        masked = {k for x in row.loss for k in range(x.a, x.b)}
        shared += len(row.ids)
        for m in row.members:
            at = [k for a, b in chat.visible(row.nodes[m.leaf]) for k in range(a, b)]
            assert position[at].tolist() == list(range(len(at)))
            seen[m.conv_id] = ([row.ids[k] for k in at], [row.ids[k] for k in at if k in masked])
    want, alone = {}, 0
    for c, turns in by.items():
        pieces = [(r, *(encode(x) for x in (chat.rendered(r, t)[0][: chat.rendered(r, t)[1]], chat.escaped(t), chat.END))) for r, t in turns]
        want[c] = ([i for _, *p in pieces for x in p for i in x], [i for r, _, body, _ in pieces if r == "assistant" for i in body])
        alone += len(want[c][0])
    assert seen == want and shared < alone / 2
