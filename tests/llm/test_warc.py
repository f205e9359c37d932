"""WARC archives: round trip, revisits, the loser tree and the order of the index."""

import base64
import glob
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import warc

SCHEMA = "page_id long, url string, html string"


def test_digest(spark):
    values = ["", "a", "é" * 999]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(warc.base32_sha1(F.col("v").cast("binary")))
    assert [r[0] for r in df.collect()] == [base64.b32encode(hashlib.sha1(v.encode()).digest()).decode() for v in values]


@pytest.mark.parametrize("k", range(0, 10))
def test_loser_tree(k):
    rng = np.random.default_rng(k)
    runs = [sorted(rng.integers(0, 30, int(rng.integers(0, 20))).tolist()) for _ in range(k)]
    got = list(warc.LoserTree([iter([(x, i) for x in r]) for i, r in enumerate(runs)], lambda p: p[0]))
    assert got == sorted([(x, i) for i, r in enumerate(runs) for x in r])


@pytest.mark.parametrize(("url", "key"), [
    ("HTTP://www.Example.com:80/A%20b?q=1#f", "com,example)/a b?q=1"), ("https://example.com", "com,example)/"), (None, ")/"),
    ("https://u@a.b.example.org/x", "org,example,b,a)/x"), ("https://example.com?x=1", "com,example)/?x=1"),
])
def test_url_key(url, key):
    assert warc.url_key(url) == key


def pages():
    rows = [(1, "http://b.com/1", "same"), (2, "http://a.com/2", "same"), (9, "http://a.com/9", "same"), (3, "http://a.com/3", None), (4, None, "")]
    rows += [(5, "http://a.com/5\r\nX: y", "one\r\n\r\nWARC/1.1\r\n\r\ntwo\r\n\r\n"), (6, "http://a.com/3", "é\n\x00\r\n"), (None, "http://c.com", "same")]
    return rows + [(100 + i, f"http://h{i % 5}.com/{i}", "hot" if i % 3 == 0 else f"page {i}") for i in range(90)]


@pytest.mark.parametrize(("least", "rows_for_broadcast"), [(0, 200_000), (4, 200_000), (0, 0)])
def test_round_trip(spark, monkeypatch, least, rows_for_broadcast):
    monkeypatch.setattr("pagemill.storage.BROADCAST_ROWS", rows_for_broadcast)
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 700)
    monkeypatch.setattr(warc, "ARCHIVE_SEGMENTS", 2)
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 10)
    rows = pages()
    got = warc.written_and_indexed(spark.createDataFrame(rows, SCHEMA), least)
    out = got.collect()
    assert len(out) == len(rows)
    order = [(r.url_key, r.timestamp, r.page_id is not None, r.page_id or 0) for r in out]
    assert order == sorted(order)
    last, found = {}, {r.page_id: r for r in out}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    for i, _, html in rows:
        raw, r = (html or "").encode(), found[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        again = len(raw) >= least and last[html or ""] != i
        assert (r.record_type, r.refers_to) == (("revisit", last[html or ""]) if again else ("response", None))
        assert r.digest_ok
    assert warc.histories(got).agg(F.sum("captures")).first()[0] == len(rows)


def made(page_id, payload, refers_to=None):
    return warc.record(page_id, "http://a", "2024-01-01T00:00:00Z", payload, len(payload), "X", refers_to)


def test_members_seek_and_damage(monkeypatch):
    """Archives are plain gzip, each offset is where a reader can begin, a long record is several members, and damage is found."""
    monkeypatch.setattr(warc, "MEMBER_BYTES", 4096)
    rng = np.random.default_rng(0)
    raw = [made(1, b"abc"), made(2, rng.bytes(300_000)), made(3, b"", 1), made(4, b"x" * 50_000)]
    packed = [warc.member(r) for r in raw]
    assert all(m[-1] == 0 for m in packed)
    whole = b"".join(packed)
    assert gzip.decompress(whole) == b"".join(raw)
    found = list(warc.records(whole))
    assert [h["warc-type"] for _, h, _ in found] == ["response", "response", "revisit", "response"]
    assert [at for at, _, _ in found] == np.cumsum([0, *map(len, packed)])[:-1].tolist()
    for i, (at, head, body) in enumerate(found):
        assert next(warc.records(whole, at)) == (at, head, body)
        assert body == raw[i].partition(b"\r\n\r\n")[2][:-4]
    for bad in (whole[:-3], whole[:-1], whole[: len(packed[0]) + 5000], whole[:40] + b"?" + whole[41:], whole[5:], warc.member(raw[0][:-3])):
        with pytest.raises(ValueError):
            list(warc.records(bad))


def test_archives_are_bounded_in_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 20_000)
    monkeypatch.setattr(warc, "ARCHIVE_SEGMENTS", 2)
    rng = np.random.default_rng(1)
    rows = [(i, f"http://a/{i}", rng.bytes(3000).hex()) for i in range(200)] + [(999, "http://a/long", rng.bytes(400_000).hex())]
    path = str(tmp_path / "archives")
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    sizes = sorted(len(open(f, "rb").read()) for f in glob.glob(f"{path}/part-*"))
    assert len(sizes) > 10 and sizes[-2] < 2 * 23_500 and sizes[-1] > 400_000
    assert sum(len(list(warc.records(open(f, "rb").read()))) for f in glob.glob(f"{path}/part-*")) == len(rows)


def test_captures_of_one_url_in_order_of_time(spark, monkeypatch):
    """Timestamps order the captures of a URL, whatever the page_ids and archives; a null time is the default date."""
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 500)
    monkeypatch.setattr(warc, "ARCHIVE_SEGMENTS", 1)
    times = ["2024-03-01 00:00:00", "2023-05-06 07:08:09", None, "2025-01-01 00:00:00"]
    rows = [(i, f"http://h.com/{i % 3}", f"v{i}", times[i % 4]) for i in range(40)]
    got = warc.written_and_indexed(spark.createDataFrame(rows, SCHEMA + ", at string").repartition(4), captured="at").collect()
    stamp = {i: (t or "2024-01-01 00:00:00").translate(str.maketrans("", "", "- :")) for i, _, _, t in rows}
    assert {r.page_id: r.timestamp for r in got} == stamp
    want = sorted((f"com,h)/{i % 3}", stamp[i], i) for i in stamp)
    assert [(r.url_key, r.timestamp, r.page_id) for r in got] == want


def test_ascending():
    assert warc.ascending(iter([])) == []
    assert warc.ascending(iter([1, 2, 2, 1, 5, 0])) == [[1, 2, 2], [1, 5], [0]]


def test_very_long_payload(spark):
    html = "é<p>" * 4_000_000  # 20 MB: several members
    r = warc.written_and_indexed(spark.createDataFrame([(1, "http://a", html), (2, "http://b", "x")], SCHEMA)).where("page_id = 1").first()
    raw = html.encode()
    assert (r.payload_bytes, r.payload_digest, r.digest_ok) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), True)


def test_empty_and_repeated(spark):
    assert warc.written_and_indexed(spark.createDataFrame([], SCHEMA)).count() == 0
    two = spark.createDataFrame([(1, "http://a", "x", 0), (1, "http://a", "x", 1)], SCHEMA + ", payload int")
    assert [(r.record_type, r.refers_to) for r in warc.written_and_indexed(two).collect()] == [("response", None)] * 2
