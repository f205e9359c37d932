"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many virtual nodes on a ring of 64-bit positions; a row
belongs to the first node clockwise of its id's position. A shard takes rows
only up to its capacity, in ring order; rows beyond it continue clockwise to
the next node of a shard with room. Capacities add up to exactly the number of
rows, so counts differ by one at most, and as many nodes make owners' shares
nearly even, few rows move on.

The rows of an arc (the positions that belong to one node) are numbered within
the arc. What the driver holds is one count for each arc, a number set by the
parameters; it walks the ring and gives each arc's numbers out as intervals,
at most one more for each shard. Rows find their shard by a join on the arc.
Only DataFrame functions run on the executors.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.llm.common import free_name, stored, text_of

_MASK = (1 << 64) - 1


def _mixed(x: int) -> int:
    """A 64-bit mix (the finaliser of SplitMix64), for node positions."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise; positions are signed longs. Nodes of a shard don't depend on the number of shards."""
    points = {}
    for shard in range(shards):
        for node in range(nodes):
            points.setdefault(_mixed(shard << 32 | node) - (1 << 63), shard)
    return sorted(points.items())


def capacities(total: int, shards: int) -> list[int]:
    """What each shard may hold: equal but for one, total together."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def dealt(loads: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, first slot) that give out loads[arc] rows of each arc, clockwise, within each shard's room.

    from and to count the arc's rows from 0. At most len(nodes) + len(room) intervals.
    """
    left, slots, out = list(room), [0] * len(room), []
    for arc in range(len(nodes)):
        at, todo, step = 0, loads.get(arc, 0), 0
        while todo:
            shard = nodes[(arc + step) % len(nodes)][1]
            step += 1
            if n := min(todo, left[shard]):
                out.append((arc, at, at + n, shard, slots[shard]))
                at, todo = at + n, todo - n
                left[shard] -= n
                slots[shard] += n
    return out


def _arc_of(position, nodes: list[tuple[int, int]]):
    """The arc of a position: a search by nested comparisons over 256 slices of the ring, then a count within the slice."""
    points = [p for p, _ in nodes]
    first = [bisect_left(points, (i << 56) - (1 << 63)) for i in range(257)]
    slices = F.array(*[F.array(*map(F.lit, points[a:b])).cast("array<bigint>") for a, b in zip(first, first[1:], strict=False)])
    base = F.array(*map(F.lit, first[:-1]))
    i = F.shiftright(position, 56).cast("int") + 128
    within = F.size(F.filter(slices[i], lambda p: p < position))
    return (base[i] + within) % len(points)


def assigned(docs: DataFrame, shards: int = 8, nodes: int = 128, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of all rows of docs.

    The law is rows: counts of shards differ by one at most. slot counts from 0
    without gaps in each shard. size is the text's UTF-8 bytes (none for null)
    plus 1; a null text has the crc32 of no bytes. Rows with a null doc_id find
    their place by their text. Rows equal in id and text are interchangeable;
    each gets a slot of its own. With fewer rows than shards some stay empty.
    Other columns of docs are not read. Reruns agree.
    """
    if shards < 1 or nodes < 1:
        raise ValueError("shards and nodes must be positive")
    spark: SparkSession = docs.sparkSession
    points = ring(shards, nodes)
    raw = text_of(text)
    rows = docs.select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32")
    )
    rows = rows.withColumn("_at", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), "text_crc32"))))
    rows = rows.withColumn("_arc", _arc_of(F.col("_at"), points))
    order = Window.partitionBy("_arc").orderBy("_at", "doc_id", "text_crc32", "size")
    rows = stored(rows.withColumn("_n", F.row_number().over(order).cast("long") - 1), "ring")
    loads = {r["_arc"]: r["count"] for r in rows.groupBy("_arc").count().collect()}  # at most shards * nodes rows
    parts = dealt(loads, points, capacities(sum(loads.values()), shards))
    schema = "_arc int, _from long, _to long, shard int, _slot long"
    given = F.broadcast(spark.createDataFrame(parts, schema))  # at most shards * (nodes + 1) rows
    inside = (rows["_arc"] == given["_arc"]) & (rows["_n"] >= given["_from"]) & (rows["_n"] < given["_to"])
    joined = rows.join(given, inside)
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_n") - F.col("_from")).alias("slot"))


def keyed(docs: DataFrame, shards: int = 8, nodes: int = 128) -> DataFrame:
    """docs with the shard of the unbounded ring: doc_id and the number of shards decide, and a shard more takes rows only into itself."""
    points = ring(shards, nodes)
    position = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    owners = F.array(*[F.lit(s) for _, s in points])
    return docs.withColumn(free_name(docs, "shard"), owners[_arc_of(position, points)])


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("text_crc32", T.LongType()),
        T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()),
    ]
)
