"""SimHash near-duplicate groups.

Fingerprints are cut into blocks. Two fingerprints with at most d differing
bits agree on at least m - d of m blocks, so they share at least one of the
C(m, d) keys that a choice of m - d blocks makes (pigeonhole). Rows are joined
on those keys and each pair under a key is verified by its Hamming distance.
Equal fingerprints are one class from the start; a key's pairs become links to
the least class of each linked set within the key, never a list of all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import dropped, free_name, given_back, small, stored, text_of
from pagemill.operators.components import components

#: A key with more classes than this is split into cells of about this size.
CELL = 2048
#: Runs of up to so many rows under one key are compared place by place.
SHORT_RUN = 48
_LANES = np.uint64(0x0101010101010101)
_SEED = 42


def _majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes. Eight bits are counted at a time in the bytes of one word."""
    counts = np.zeros(64, dtype=np.int64)
    rows = np.zeros(-(-len(hashes) // 255) * 255, dtype=np.uint64)  # a byte counts to 255
    rows[: len(hashes)] = hashes
    rows = rows.reshape(-1, 255)
    for bit in range(8):
        lanes = ((rows >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts[bit::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of size words, repeats included; of the whole sequence if it is shorter."""
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, _SEED)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], _SEED) for a, b in spans], dtype=np.uint64)


def fingerprint(text: str | bytes | None, size: int = 4) -> int:
    """SimHash of a text's lower-cased (A-Z) word shingles, as an unsigned number; 0 without words."""
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()
    return _majority(_shingle_hashes(words, size)) if words else 0


def fingerprints(docs: DataFrame, size: int = 4, text: str = "text") -> DataFrame:
    """docs' doc_id with the fingerprint of the whole text as a signed long, fp."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select("doc_id", text_of(text).cast("binary").alias("text"))
    return narrow.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(blocks: int, shared: int, bits: int = 64) -> list[int]:
    """Masks, as signed longs, of every choice of shared blocks out of blocks nearly equal ones."""
    cuts = [round(bits * i / blocks) for i in range(blocks + 1)]
    ones = [((1 << b) - (1 << a)) for a, b in itertools.pairwise(cuts)]
    masks = [sum(chosen) for chosen in itertools.combinations(ones, shared)]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in masks]


def keyed(classes: DataFrame, search: list[str], blocks: int, shared: int) -> DataFrame:
    """One row for each class, search fingerprint and choice of blocks: (t, k) with all columns of classes and the fingerprint s."""
    masks = block_masks(blocks, shared)
    cols = classes.columns
    rows = classes.select("*", F.posexplode(F.array(*search)).alias("_n", "s"))
    rows = rows.select(*cols, "s", "_n", F.posexplode(F.array(*map(F.lit, masks))).alias("_t", "_m"))
    return rows.select((F.col("_n") * len(masks) + F.col("_t")).alias("t"), F.col("s").bitwiseAND(F.col("_m")).alias("k"), "s", *cols)


def _cells(rows: DataFrame, salt: Column) -> DataFrame:
    """Add a cell number, which is 0 for all rows of a key unless the key is hot.

    A hot key's rows are dealt to n salts, and each row goes to the cells of its
    salt with every other: any two rows meet in at least one cell, a cell has
    about 2 * CELL rows, and the cells of one key spread over many tasks.
    """
    hot = rows.groupBy("t", "k").count().where(F.col("count") > CELL)
    hot = stored(hot.select("t", "k", F.ceil(F.col("count") / CELL).cast("int").alias("_n")), "hot")
    if hot.isEmpty():
        return rows.withColumn("cell", F.lit(0))
    own = F.pmod(salt, F.col("_n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1))
    rows = rows.join(hot, ["t", "k"], "left").select("*", other.alias("_o"))
    cell = F.least(own, "_o") * F.col("_n") + F.greatest(own, "_o")
    return rows.withColumn("cell", F.coalesce(cell, F.lit(0))).drop("_n", "_o")


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where a new key begins, with the length at the end."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _least_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index that each of n rows is linked to, by links a to b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _links(starts: np.ndarray, close) -> np.ndarray:
    """The least row linked to each row; rows i < j of one run are linked if close(i, j).

    Short runs are compared place by place, all at once. In a long run each set
    found grows by comparing its new rows with those still unlinked, so a run of
    rows that are all alike takes one pass.
    """
    sizes = np.diff(starts)
    left = np.repeat(np.where(sizes <= SHORT_RUN, starts[1:], starts[:-1]), sizes) - np.arange(starts[-1])  # rows of a short run from this one on
    a, b, d, rows = [], [], 1, np.flatnonzero(left > 1)
    while len(rows):
        yes = rows[close(rows, rows + d)]
        a.append(yes)
        b.append(yes + d)
        d += 1
        rows = rows[left[rows] > d]
    for run in np.flatnonzero(sizes > SHORT_RUN):
        label = _grown(np.arange(starts[run], starts[run + 1]), close)
        a.append(np.arange(starts[run], starts[run + 1]))
        b.append(label)
    none = [np.zeros(0, dtype=np.int64)]
    return _least_linked(np.concatenate(a or none), np.concatenate(b or none), int(starts[-1]))


def _grown(rows: np.ndarray, close, room: int = 1 << 20) -> np.ndarray:
    """The least row linked to each of rows, directly or through others."""
    label, left = rows.copy(), rows
    while len(left):
        first, left = left[0], left[1:]
        front = np.array([first])
        while len(front) and len(left):
            hit = np.zeros(len(left), dtype=bool)
            step = max(1, room // len(left))
            for at in range(0, len(front), step):
                some, rest = front[at : at + step], np.flatnonzero(~hit)
                near = close(np.repeat(some, len(rest)), np.tile(left[rest], len(some)))
                hit[rest[near.reshape(len(some), len(rest)).any(axis=0)]] = True
            front, left = left[hit], left[~hit]
            label[front - rows[0]] = first
    return label


def links(rows: DataFrame, key: list[str], node: str, words: dict[str, list[str]], limits: dict[str, int]) -> DataFrame:
    """Links (a, b) between the nodes of rows that share the key and are close.

    words names groups of long columns that each hold a fingerprint, limits the
    greatest Hamming distance for each group; a pair must meet all.
    """
    used = sorted({c for group in words.values() for c in group})
    columns = [*key, node, *used]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(part: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
            of = dict(zip(columns, part, strict=True))

            def close(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                fine = np.ones(len(i), dtype=bool)
                for group, names in words.items():
                    at = np.flatnonzero(fine)
                    # unsigned: of a signed number, bitwise_count takes the absolute value
                    far = sum(np.bitwise_count((of[c][i[at]] ^ of[c][j[at]]).view(np.uint64)).astype(np.int64) for c in names)
                    fine[at] = far <= limits[group]
                return fine

            least = _links(starts, close)
            moved = np.flatnonzero(least != np.arange(len(least)))
            return pa.RecordBatch.from_arrays([pa.array(of[node][moved]), pa.array(of[node][least[moved]])], ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))]
            part = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            if not len(part[0]):
                continue
            starts = _runs(part[: len(key)])
            last = int(starts[-2])
            held = [c[last:] for c in part]
            if last:
                yield linked([c[:last] for c in part], starts[:-1])
        if held is not None and len(held[0]):
            yield linked(held, np.array([0, len(held[0])]))
            held = None
            given_back()

    dealt = rows.select(*columns).repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(each, "a long, b long").distinct()


def linked_fingerprints(classes: DataFrame, distance: int = 4, shared: int = 3) -> DataFrame:
    """Links (a, b) between classes(fp) of different fingerprints; components of them are those of all pairs with at most distance bits apart."""
    rows = keyed(classes.select("fp"), ["fp"], distance + shared, shared)
    rows = _cells(rows, F.xxhash64("fp"))
    return links(rows, ["t", "k", "cell"], "fp", {"s": ["fp"]}, {"s": distance})


def components_by_distance(docs: DataFrame, size: int = 4, distance: int = 4, shared: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints link, directly or through others.

    Two fingerprints link if at most distance bits differ. component_id is the
    least doc_id reachable. Null or empty texts have fingerprint 0 and link like
    any other; documents with a null doc_id are labelled too, but never name a
    component unless it has no other. Repeated rows come out repeated. Other
    columns of docs are not read. An empty table gives an empty table.
    """
    prints = stored(fingerprints(docs, size), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = components(linked_fingerprints(classes, distance, shared))
    joined = classes.join(parts, classes.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    joined = stored(joined, "classes")
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = joined.join(roots, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


#: What the dedup stage searches beyond fingerprints: keys of BANDS bands of WIDTH minima of the shingle set, and BITS bits of each minimum in MARKS.
BANDS, WIDTH, BITS = 21, 3, 4
SEARCH = [f"k{i}" for i in range(BANDS)]
MARKS = [f"s{i}" for i in range(BITS)]
#: Pairs under a key are looked at further if so many bits of MARKS differ at most. Shingle sets with a Jaccard similarity j
#: differ in 126 * (1 - j) of 252 bits on average: 25 at 0.8, with a deviation of 7.3, so 62 is five deviations off; at 0.3 it is 88.
MOST_SEARCH = 62
#: Near copies have this Jaccard similarity of shingle sets or more, as a fraction.
LEAST_ALIKE = (4, 5)
#: Texts that are verified together in one task's memory.
TOGETHER = 512


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Other hashes of the same things: the SplitMix64 finaliser of each plus a multiple of its step."""
    x = hashes + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers, one for each hash function of the minima.
_TURNS = _mixed(np.arange(BANDS * WIDTH, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95), 0) | np.uint64(1)


def _minima(shingles: np.ndarray) -> np.ndarray:
    """The least hash of the shingles under each of BANDS * WIDTH hash functions; two sets agree in one with a chance of their Jaccard similarity."""
    least = np.full(len(_TURNS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[at : at + 4096] * _TURNS[:, None]).min(axis=1), out=least)
    return least


def searched(shingles: np.ndarray) -> list[int]:
    """A key for each band of WIDTH minima, then MARKS, each with one bit of every minimum."""
    least = _minima(shingles)
    bands = least.reshape(BANDS, WIDTH)
    key = np.zeros(BANDS, dtype=np.uint64)
    for i in range(WIDTH):
        key = _mixed(key ^ bands[:, i], i)
    bits = np.zeros((BITS, 64), dtype=np.uint8)
    bits[:, : len(least)] = (_mixed(least, WIDTH) >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1)
    return [*key.tolist(), *np.packbits(bits, axis=1).view(np.uint64)[:, 0].tolist()]


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Hashes of a text's distinct word shingles, in order; empty without words."""
    words = (text or b"").lower().split()
    return np.unique(_shingle_hashes(words, size)) if words else np.zeros(0, dtype=np.uint64)


def sketch(text: bytes | None, size: int = 5) -> list[int]:
    """Search keys, marks, the digest of the shingle set, which tells different sets apart, and the fingerprint; all 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return [0] * (len(SEARCH) + len(MARKS) + 2)
    hashes = _shingle_hashes(words, size)
    shingles = np.unique(hashes)
    return [*searched(shingles), xxhash.xxh64_intdigest(shingles.tobytes(), _SEED), _majority(hashes)]


def sketches(rows: DataFrame, size: int = 5) -> DataFrame:
    """rows(row, doc_id, text) with sketches in place of texts."""
    names = [*SEARCH, *MARKS, "node", "fp"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t, size) for t in batch.column(2).to_pylist()]
            words = np.array(found, dtype=np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(words[:, i].copy()) for i in range(len(names))]], ["row", "doc_id", *names])
        given_back()

    narrow = rows.select("row", "doc_id", text_of().cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(each, f"row long, doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def alike(sets: list[np.ndarray], known: np.ndarray | None = None) -> np.ndarray:
    """The least index each set is linked to, directly or through others; sets link if their Jaccard similarity is LEAST_ALIKE or more.

    Sets with one number in known are linked from the start. Each set found is
    compared with all that are still unlinked, so copies of one text end after
    one pass.
    """
    part, whole = LEAST_ALIKE
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ids = np.split(ids, np.cumsum(sizes)[:-1])
    mask = np.zeros(max((int(x.max()) for x in ids if len(x)), default=0) + 1, dtype=bool)
    known = np.arange(len(sets)) if known is None else known
    label = np.arange(len(sets))
    left = np.arange(len(sets))
    while len(left):
        first = left[0]
        front, left = left[known[left] == known[first]].tolist(), left[known[left] != known[first]]
        label[front] = first
        flat = None
        while front and len(left):
            at = front.pop()
            if flat is None:
                flat, starts = np.concatenate([ids[x] for x in left]), np.cumsum(sizes[left]) - sizes[left]
            mask[ids[at]] = True
            both = np.add.reduceat(mask[flat], starts, dtype=np.int64)
            mask[ids[at]] = False
            near = whole * both >= part * (sizes[at] + sizes[left] - both)
            if near.any():
                near = np.isin(known[left], known[left[near]])
                label[left[near]] = first
                front.extend(left[near].tolist())
                left, flat = left[~near], None
    return label


def verified(texts: DataFrame, size: int = 5) -> DataFrame:
    """(part, node, root) of texts(part, cell, node, known, text): root is the least node of a cell that is linked by exact
    similarity or, from the start, by an equal known. A cell is one task's memory."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(part: int, nodes: list[int], known: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            at = np.array(nodes, dtype=np.int64)
            root = at[alike(sets, np.array(known, dtype=np.int64))]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part)), pa.array(at), pa.array(root)], ["part", "node", "root"])

        held, nodes, known, sets = None, [], [], []
        for batch in batches:
            for part, cell, node, group, text in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if (part, cell) != held and nodes:
                    yield linked(held[0], nodes, known, sets)
                    nodes, known, sets = [], [], []
                held = (part, cell)
                nodes.append(node)
                known.append(group)
                sets.append(shingle_set(text, size))
        if nodes:
            yield linked(held[0], nodes, known, sets)
            sets = []
            given_back()

    dealt = texts.select("part", "cell", "node", "known", "text").repartition("part", "cell").sortWithinPartitions("part", "cell", "node")
    return dealt.mapInArrow(each, "part long, node long, root long")


def _chunked(rows: DataFrame, together: int, turn: int) -> DataFrame:
    """rows(part, node, ...) with cell: a chunk of about so many nodes of the part, by a hash that the turn changes."""
    n = rows.groupBy("part").agg(F.ceil(F.count("*") / F.lit(together)).alias("_chunks"))
    cell = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("_chunks"))
    return rows.join(small(stored(n, "chunks")), "part").withColumn("cell", cell).drop("_chunks")


def _roots(texts: DataFrame, size: int, together: int) -> DataFrame:
    """(node, root) of texts(part, node, text), linked by exact similarity within parts; no task holds more than a few times `together` texts.

    Parts that fit are verified at once. Of larger ones, chunks are verified, and
    the least text of each group found stands for it in the next round, until
    the part's groups fit one chunk or hardly merge any more: copies of one text
    end in one group, with work in proportion to their number. If groups are
    left apart, their members may still be alike: chunks of different groups
    are compared with each other, those within a group are not.
    """
    n = texts.groupBy("part").agg(F.count("*").alias("n"))
    large = stored(n.where(F.col("n") > together), "large-parts")
    if large.isEmpty():
        one = texts.withColumn("cell", F.lit(0).cast("long")).withColumn("known", F.col("node"))
        return verified(one, size).select("node", "root")
    large = small(large.select("part"))
    fit = texts.join(large, "part", "left_anti").withColumn("cell", F.lit(0).cast("long")).withColumn("known", F.col("node"))
    done = stored(verified(fit, size).select("node", "root"), "small-roots")
    rest = stored(texts.join(large, "part", "left_semi"), "large-texts")

    kin = None
    now, count, turn = rest, rest.count(), 0
    while True:  # each turn ends with fewer texts, or is the last
        found = stored(verified(_chunked(now, together, turn).withColumn("known", F.col("node")), size), "chunk-roots")
        edges = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        kin = edges if kin is None else kin.unionAll(edges)
        firsts = found.where("node = root").select("node")
        now, turn = now.join(small(stored(firsts, "firsts")), "node", "left_semi"), turn + 1
        before, count = count, firsts.count()
        if count > 0.7 * before or now.groupBy("part").count().where(F.col("count") > 1).isEmpty():
            break

    groups = components(kin).withColumnRenamed("component", "root")
    named = rest.select("part", "node").join(groups, "node", "left").select("part", "node", F.coalesce("root", "node").alias("known"))
    named = stored(named, "groups")
    apart = named.groupBy("part").agg(F.min("known").alias("_a"), F.max("known").alias("_b")).where("_a <> _b").select("part")
    apart = small(stored(apart, "apart"))
    split = named.join(apart, "part", "left_semi")
    sizes = split.groupBy("part", "known").agg(F.count("*").alias("_n"))
    sizes = stored(sizes.withColumn("_own", F.when(F.col("_n") >= together, F.col("known"))), "group-sizes")  # a large group has chunks of its own, small ones share some
    chunks = sizes.groupBy(F.col("part").alias("_part"), F.col("_own").alias("_of")).agg(F.ceil(F.sum("_n") / F.lit(together)).alias("_chunks"))
    sizes = sizes.join(chunks, (F.col("part") == F.col("_part")) & F.col("_own").eqNullSafe(F.col("_of"))).select("part", "known", "_own", "_chunks")
    key = F.when(F.col("_own").isNull(), F.xxhash64("known")).otherwise(F.xxhash64("node"))  # a small group stays whole
    place = F.struct("_own", F.pmod(key, F.col("_chunks")).alias("at")).alias("place")
    placed = stored(split.join(sizes, ["part", "known"]).select("part", "node", "known", place), "placed")
    places = placed.select("part", "place").distinct()
    a, b = places.withColumnRenamed("place", "pa"), places.withColumnRenamed("place", "pb")
    # one row for each two chunks of a part that hold different groups; chunks, not texts, are paired
    pairs = a.join(b, "part").where("pa <= pb and (pa._own is null or not pa._own <=> pb._own)")
    pairs = pairs.withColumn("cell", F.xxhash64("part", "pa", "pb"))
    cells = pairs.select("part", F.col("pa").alias("place"), "cell").unionAll(pairs.where("pa <> pb").select("part", F.col("pb").alias("place"), "cell"))
    across = placed.join(cells, ["part", "place"]).select("part", "cell", "node", "known")
    across = across.join(rest.select("node", "text"), "node")
    more = stored(verified(across, size).where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "across")
    own = named.where("node <> known").select(F.col("node").alias("a"), F.col("known").alias("b"))
    return done.unionAll(components(own.unionAll(more)).select("node", F.col("component").alias("root")))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a number for each row, and that column's name."""
    row = free_name(docs, "_row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _by_fingerprint(prints: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of sketches whose fingerprints link as in components_by_distance."""
    nodes = stored(prints.select("node", "fp").distinct(), "fingerprint-nodes")
    classes = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprint-classes")
    firsts = [classes.select(F.col("fp").alias(f"_{s}"), F.col("first").alias(s)) for s in "ab"]
    found = linked_fingerprints(classes).select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    across = found.join(firsts[0], "_a").join(firsts[1], "_b").select("a", "b")
    own = nodes.join(classes, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return across.unionAll(own).where("a <> b")


def _by_minima(classes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that share a search key and are not far apart by MARKS."""
    rows = classes.select("node", *MARKS, F.posexplode(F.array(*SEARCH)).alias("t", "k"))
    return links(_cells(rows, F.col("node")), ["t", "k", "cell"], "node", {"s": MARKS}, {"s": MOST_SEARCH})


def _labelled(held: DataFrame, row: str, size: int) -> DataFrame:
    """(row, doc_id, node, root) of all rows of held, written; near copies share a root."""
    held = held.select(F.col(row).alias("row"), "doc_id", "text")
    prints = stored(sketches(held, size), "sketches")
    classes = stored(prints.groupBy("node", *MARKS, *SEARCH).agg(F.min("row").alias("row")), "sketch-classes")
    found = _by_fingerprint(prints).unionAll(_by_minima(classes))
    parts = components(found).withColumnRenamed("component", "part")
    parts = small(stored(classes.select("node", "row").join(parts, "node").select("row", "node", "part"), "search-parts"))
    dropped(classes)
    texts = held.select("row", text_of().cast("binary").alias("text")).join(parts, "row").select("part", "node", "text")
    roots = small(stored(_roots(texts, size, TOGETHER), "near-copy-roots"))
    out = prints.select("row", "doc_id", "node").join(roots, "node", "left").select("row", "doc_id", "node", F.coalesce("root", "node").alias("root"))
    out = stored(out, "near-copy-labels")
    dropped(prints)
    return out


def near_copies(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, component_id) of all documents; near copies share a component.

    Near copies have a Jaccard similarity of their sets of five-word shingles of
    0.8 or more, directly or through others. Pairs are those whose SimHash
    fingerprints, of the same shingles with repeats, differ in at most 4 bits; at
    0.8 about 9 of 64 bits differ, so further pairs come from MinHash bands: 21
    keys of 3 minima of the shingle set. What an edit is does not matter there,
    only the similarity j: a pair shares no key with a chance of
    (1 - j ** 3) ** 21, which is 3e-7 at 0.8 and 1e-12 at 0.9. Of the pairs under
    a key a loose limit takes the unlike ones. What is linked by either is
    verified by its shingles, in parts of bounded size.
    """
    held, row = _numbered(docs.select("doc_id", "text"))
    labelled = _labelled(held, row, size)
    roots = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(roots, "root").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, size: int = 5) -> DataFrame:
    """One row of each group of near copies; all columns kept.

    The row with the least doc_id stays, nulls last; of several with that
    doc_id, one with the least digest of its shingles, and of equal ones any.
    Rows count one by one, whether or not they share a doc_id or have none.
    Texts without words are copies of each other. An empty table stays empty.
    """
    held, row = _numbered(docs)
    labelled = _labelled(held, row, size)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "row")
    kept = labelled.groupBy("root").agg(F.min(order).alias("least")).select(F.col("least.row").alias("row"))
    gone = labelled.select("row").join(kept, "row", "left_anti")
    gone = small(stored(gone.withColumnRenamed("row", row), "near-copies"))
    return held.join(gone, row, "left_anti").drop(row)
