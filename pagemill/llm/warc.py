"""WARC archives and their capture index.

Pages become WARC 1.1 records: a response for one page of each payload, and
revisit records, which carry no payload, for its other copies. Each record is a
gzip member of its own, so the offset in the index is where a reader can seek
to and begin. Records go to archives where their rows are, without a shuffle;
archives end at a bounded number of bytes. Spark's text writer writes them, so
tasks commit as Spark's own do on any file system: a row holds many members less
the last byte, which is 0 (the highest byte of the member's size), and the line
separator is that byte.

Reading an archive gives a capture run, sorted by URL key, timestamp and page_id.
The index is an external merge of these runs: each range of keys gets the parts
of all runs that fall into it, in the order they have there, and a loser tree
merges them.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import new_path, small, stored, text_of

#: A row for the writer ends with the record that brings it to so many compressed bytes; an archive holds so many rows.
SEGMENT_BYTES, ARCHIVE_SEGMENTS = 8 << 20, 8
#: A gzip member holds so many bytes of a record at most; a longer record is several members in a row.
MEMBER_BYTES = 8 << 20
#: Captures in one range of the merge, about.
RANGE_CAPTURES = 250_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of captures that have none.
_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five bytes make eight digits, as number bases 16 and 32 allow."""
    hexed = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels from the top down, then path and query; scheme, www, port 80/443 and fragment don't count."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", (url or "").strip()).split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host, mark, query = host.partition("?")
    host = re.sub(r":(80|443)$", "", host.rsplit("@", 1)[-1].lower())
    host = re.sub(r"^www\d*\.", "", host)
    path = unquote(slash + path if slash else "/" + mark + query).lower()
    return ",".join(reversed(host.split("."))) + ")" + path


def decided(pages: DataFrame, least_bytes: int = 0, captured: str | None = None) -> DataFrame:
    """page_id, url, date, payload, payload_bytes, payload_digest and refers_to (null for responses).

    Of equal payloads with at least least_bytes bytes the row with the largest
    page_id is the response, by which the rest is revisited; smaller payloads
    are responses all. Rows with a null page_id never have one refer to them
    unless all copies have none. The payload of a revisit is null: what repeats
    doesn't travel further than to where it is found out.
    """
    payload = text_of("html").cast("binary")
    date = F.lit(_DATE) if captured is None else F.coalesce(F.date_format(F.col(captured).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(_DATE))
    rows = pages.select("page_id", "url", date.alias("date"), payload.alias("payload"), base32_sha1(payload).alias("payload_digest"))
    narrow = rows.select("page_id", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    # counted before the join: only payloads with copies come into it, and the side that repeats a digest can be split
    last = narrow.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
    last = last.where((F.col("_n") > 1) & (F.col("payload_bytes") >= least_bytes)).select("payload_digest", "_last")
    rows = rows.join(small(stored(last, "copies")), "payload_digest", "left")
    refers = F.when(F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col("page_id")), F.col("_last"))
    return rows.select(
        "page_id", "url", "date", F.when(refers.isNull(), F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload_digest", refers.alias("refers_to"),
    )


def record(page_id: int | None, url: str | None, date: str, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, with the two line ends behind it. size is the payload's, which a revisit doesn't carry."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http + (payload or b"") if refers_to is None else http
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {clean}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[3:3] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A record as a gzip member, or several if it is long; the last byte is 0."""
    parts = []
    for at in range(0, len(raw), MEMBER_BYTES):
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        parts.append(squeeze.compress(raw[at : at + MEMBER_BYTES]) + squeeze.flush())
    return b"".join(parts)


def members(raw: bytes | memoryview, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of a gzip file's members from an offset on; raises on damage."""
    view = memoryview(raw)
    while at < len(view):
        expand, start, parts = zlib.decompressobj(31), at, []
        while not expand.eof:
            if at >= len(view):
                raise ValueError(f"cut off member at byte {start}")
            some = view[at : at + (1 << 14)]
            try:
                parts.append(expand.decompress(some))
            except zlib.error as e:
                raise ValueError(f"damaged member at byte {start}") from e
            at += len(some) - len(expand.unused_data)
        yield start, b"".join(parts)


def records(raw: bytes | memoryview, at: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, body) of a gzipped archive's records from an offset on; raises on damage."""
    found = members(raw, at)
    for offset, data in found:
        end = data.find(b"\r\n\r\n")
        lines = data[:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at byte {offset}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = end + 4 + int(head["content-length"]) + 4
        more = [data]
        held = len(data)
        while held < size:
            more.append(next(found, (0, b""))[1])
            if not more[-1]:
                raise ValueError(f"cut off record at byte {offset}")
            held += len(more[-1])
        data = b"".join(more)
        if len(data) != size or data[-4:] != b"\r\n\r\n":
            raise ValueError(f"damaged record at byte {offset}")
        yield offset, head, data[end + 4 : -4]


def write(pages: DataFrame, path: str, least_bytes: int = 0, captured: str | None = None) -> None:
    """Write archives of all pages under path; captured names the column with the time of capture."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def row() -> pa.RecordBatch:
            raw = b"".join(held)[:-1]  # the writer ends each row with its last byte, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["raw"])

        size = 0
        for batch in batches:
            for values in zip(*batch.columns, strict=True):
                held.append(member(record(*[v.as_py() for v in values])))
                size += len(held[-1])
                if size >= SEGMENT_BYTES:
                    yield row()
                    size = 0
        if held:
            yield row()

    rows = decided(pages, least_bytes, captured).select("page_id", "url", "date", "payload", "payload_bytes", "payload_digest", "refers_to")
    raw = rows.mapInArrow(each, "raw binary").select(F.col("raw").cast("string").alias("value"))
    raw.write.option("lineSep", "\x00").option("maxRecordsPerFile", ARCHIVE_SEGMENTS).text(path)


def _page(text: str) -> int | None:
    number = text.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


_CAPTURE = "archive string, url_key string, timestamp string, page_id long, url string, offset long, payload_bytes long, payload_digest string, digest_ok boolean, record_type string, refers_to long"


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Each archive's captures, read from its records and sorted: the runs to merge."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _CAPTURE.split(", ")]
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = []
                for at, head, body in records(raw.as_buffer()):
                    http, _, payload = body.partition(b"\r\n\r\n")
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    plain = head["warc-type"] == "response"
                    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                    ok = not plain or base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
                    stamp = re.sub(r"\D", "", head["warc-date"])
                    refers = None if plain else _page(head["warc-refers-to"])
                    url = head["warc-target-uri"]
                    out.append((name, url_key(url), stamp, _page(head["warc-record-id"]), url, at, size, digest, ok, head["warc-type"], refers))
                out.sort(key=_order)
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=_ARROW)

    file = F.regexp_extract("path", r"([^/]+)$", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(file.alias("file"), "content")
    return files.mapInArrow(each, _CAPTURE)


_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in _CAPTURE.split(", "))])


def _order(capture: tuple) -> tuple:
    """By URL key, timestamp, page_id (none first), then archive and offset; strings by code point."""
    return capture[1], capture[2], capture[3] is not None, capture[3] or 0, capture[0], capture[5]


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a new head plays one match a level."""

    def __init__(self, sources: list[Iterator[Any]], key=lambda x: x):
        self.sources, self.key, self.k = sources, key, max(1, len(sources))
        self.heads: list[tuple[Any, Any] | None] = [self._next(i) for i in range(len(sources))] or [None]
        self.losers = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.losers[0] = winners[1] if self.k > 1 else 0

    def _next(self, i: int) -> tuple[Any, Any] | None:
        try:
            value = next(self.sources[i])
        except StopIteration:
            return None
        return self.key(value), value

    def _before(self, a: int, b: int) -> bool:
        """Does source a's head come first? Ended sources come last; of equal heads the earlier source's."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def __iter__(self) -> Iterator[Any]:
        while (head := self.heads[self.losers[0]]) is not None:
            yield head[1]
            winner = self.losers[0]
            self.heads[winner] = self._next(winner)
            node = (winner + self.k) // 2
            while node:
                if self._before(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.losers[0] = winner


def ascending(rows: Iterator[tuple], key=lambda x: x) -> list[list[tuple]]:
    """rows cut into runs where one comes before the row ahead of it."""
    out: list[list[tuple]] = []
    last = None
    for row in rows:
        own = key(row)
        if last is None or own < last:
            out.append([])
        out[-1].append(row)
        last = own
    return out


def merged(captures: DataFrame) -> DataFrame:
    """The captures in global order: a range of URL keys in each partition, merged from the runs by a loser tree.

    A range gets each run's captures in the run's order, run by run: what the
    shuffle brings is cut where the order breaks, and those ascending parts are
    merged without sorting. Captures of one URL key may fill several ranges, as
    timestamps and page_ids divide them too; no key has to fit one task. There
    are so many ranges that each holds about RANGE_CAPTURES captures, which is
    what a task keeps in memory.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _CAPTURE.split(", ")]
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        tree = iter(LoserTree([iter(run) for run in ascending(rows, _order)], _order))
        while out := list(itertools.islice(tree, 4096)):
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=_ARROW)

    ranges = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // RANGE_CAPTURES))
    ranged = captures.repartitionByRange(ranges, "url_key", "timestamp", "page_id", "archive", "offset")
    return ranged.mapInArrow(each, _CAPTURE)


def written_and_indexed(pages: DataFrame, least_bytes: int = 0, captured: str | None = None) -> DataFrame:
    """Write pages to new archives in the shared folder, read them back and merge the captures.

    One row for each row of pages, in the order of URL key, timestamp and
    page_id. payload_bytes and payload_digest are the full payload's, also for
    revisits; a null html is an empty payload, a null url an empty one, a null
    time of capture the date of pages without. Rows equal in page_id and payload
    are responses both. A page of any length is one record, and a task holds one
    archive's bytes. Columns other than page_id, url, html and captured are not
    read. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, least_bytes, captured)
    return merged(stored(runs(spark, path), "captures"))


def histories(index: DataFrame) -> DataFrame:
    """Captures of each URL key: how many, first and last timestamp, and how many different payloads."""
    return index.groupBy("url_key").agg(
        F.count("*").alias("captures"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.count_distinct("payload_digest").alias("payloads"),
    )


def union(indexes: list[DataFrame]) -> DataFrame:
    """Several indexes as the runs of one larger merge."""
    return merged(reduce(DataFrame.unionByName, indexes))
