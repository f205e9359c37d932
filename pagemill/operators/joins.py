"""Joins on sizes, intervals, boxes and neighbours, each led by an equality so that it can be hashed and sorted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import geometry as G
from pagemill.storage import small, stored


def named(df: DataFrame, suffix: str, *keep: str) -> DataFrame:
    """All columns but those to keep with a suffix."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(c + suffix) for c in df.columns])


#: Cells of a band join across its radius.
CELLS = 2
#: Rows of a cell that a block of a band join has at most, and blocks that a task keeps of one side and takes of the other, on average.
#: A task keeps some 61,440 rows at most, fewer than 65,536: files of results then number them in two whole bytes, so that lists of b that repeat are packed as such.
BAND_BLOCK, BAND_KEPT, BAND_TAKEN = 64, 960, 512


def band_join(a: DataFrame, b: DataFrame, at_least: float = 0.8, by: list[str] | None = None, width: str = "w", height: str = "h", order: str | None = None) -> DataFrame:
    """Pairs of rows whose log-size similarity is at_least or more, with that similarity.

    exp(-d) >= s means d <= r = -ln s, so sizes are dealt to cells of r / CELLS
    in the logarithms, and a cell's rows are put into blocks, each written once.
    Partitions of blocks meet where they are read, or blocks of equal by where
    that is given, and blocks of cells within reach become pairs of rows in the
    task: disk grows with the rows, not with their cells or pairs. Logarithms are
    taken once a row; only pairs within a hair of r are measured again by their
    ratios, whose equal sizes give 0 exactly. Columns of a and b come with _a and
    _b. Sizes of 0 or less and nulls have no logarithm and match nothing. Blocks
    list rows of one size in the given order, so that pairs of a range of it follow
    one another; results are the same without.
    """
    radius, by = -math.log(at_least), by or []
    step = radius * (1 + 1e-9) / CELLS
    cell = lambda c: F.floor(F.col(c) / step)

    def packed(df: DataFrame) -> DataFrame:
        rows = df.where((F.col(width) > 0) & (F.col(height) > 0)).withColumns({"_lw": F.log(F.col(width).cast("double")), "_lh": F.log(F.col(height).cast("double"))})
        keys = [*by, "_cw", "_ch"]
        rows = rows.withColumns({"_cw": cell("_lw"), "_ch": cell("_lh")})
        listed = Window.partitionBy(*keys).orderBy("_lw", "_lh", *([order] if order else []))
        rows = rows.withColumn("_n", F.floor((F.row_number().over(listed) - 1) / BAND_BLOCK))
        row = F.struct("_lw", "_lh", *[c for c in df.columns if c not in by])
        return stored(rows.groupBy(*keys, "_n").agg(F.collect_list(row).alias("_rows")).drop("_n"), "band-blocks")

    left = packed(a)
    right = left if a is b else packed(b)
    n, m, cores = left.count(), right.count(), a.sparkSession.sparkContext.defaultParallelism
    left, right = named(left, "_a", *by), named(right, "_b", *by)
    apart = [F.greatest(F.abs(F.col(c + "_a") - F.col(c + "_b")) - 1, F.lit(0)) for c in ("_cw", "_ch")]
    near = apart[0] * apart[0] + apart[1] * apart[1] < CELLS * CELLS
    if by:
        pairs = left.join(right, by).where(near)
    else:  # a block's work is that of its rows with all in reach, which its few bytes don't show: tasks are numbered
        taken = max(1, min(n, 4 * cores), -(-n // BAND_TAKEN))
        pairs = left.repartition(taken).hint("shuffle_replicate_nl").join(right.repartition(max(1, -(-m // BAND_KEPT))), near)
    pairs = pairs.select(*by, F.explode("_rows_a").alias("_a"), "_rows_b").select(*by, "_a", F.explode("_rows_b").alias("_b"))
    own = {s: [c for c in df.columns if c not in by] for s, df in (("_a", a), ("_b", b))}
    pairs = pairs.select(*by, *[F.col(f"{s}.{c}").alias(c + s) for s in own for c in ("_lw", "_lh", *own[s])])
    dw, dh = F.col("_lw_a") - F.col("_lw_b"), F.col("_lh_a") - F.col("_lh_b")
    far = dw * dw + dh * dh
    size = [F.col(c + s).cast("double") for c in (width, height) for s in ("_a", "_b")]
    distance = G.log_ratio_distance(*size)
    fine = F.when(far <= radius * radius * (1 - 1e-9), True).when(far > radius * radius * (1 + 1e-9), False).otherwise(distance <= radius)
    return pairs.where(fine).withColumn("similarity", F.exp(-distance)).drop("_lw_a", "_lh_a", "_lw_b", "_lh_b")


def triangular_band_join(df: DataFrame, key: str, at_least: float = 0.85, by: list[str] | None = None, width: str = "w", height: str = "h") -> DataFrame:
    """band_join of a table with itself, each pair once, the smaller key as a."""
    return band_join(df, df, at_least, by, width, height, key).where(F.col(key + "_a") < F.col(key + "_b"))


#: Pages are dealt to so many parts a side where each is paired with each.
PARTS = 16


def page_pairs(pages: DataFrame, page: str = "page", how: str = "all") -> DataFrame:
    """Pairs (page_a, page_b, kind) of distinct pages in order: all within and cross pairs, cross only, or each page with the next.

    Names are dealt to a grid of parts, so pairs meet by an equality of cells and no side is held whole.
    """
    names = pages.select(F.col(page).alias("page_a")).distinct()
    if how == "next":
        after = F.lead("page_a").over(Window.orderBy("page_a"))  # one row for each page
        return names.withColumn("page_b", after).where("page_b is not null").withColumn("kind", F.lit("cross"))
    own, every = F.pmod(F.xxhash64("page_a"), F.lit(PARTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    left = names.select("page_a", own.alias("_i"), every.alias("_j"))
    right = names.select(F.col("page_a").alias("page_b"), own.alias("_j"), every.alias("_i"))
    pairs = left.join(right, ["_i", "_j"]).where("page_a < page_b").select("page_a", "page_b", F.lit("cross").alias("kind"))
    if how == "cross":
        return pairs
    return pairs.unionByName(names.select("page_a", F.col("page_a").alias("page_b"), F.lit("within").alias("kind")))


def _sliced(df: DataFrame, lo: str, hi: str, size: float, out: str) -> DataFrame:
    """A row for each slice of the given size that the interval reaches into."""
    return df.withColumn(out, F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))))


def meeting(a: DataFrame, b: DataFrame, by: list[str], spans: list[tuple[str, str, str, str]], size: float) -> DataFrame:
    """Pairs of rows of a group whose intervals share a slice, each pair once; spans names (lo, hi) of a and (lo, hi) of b for each dimension.

    Intervals are dealt to slices of a fixed size (boxes to cells), so rows meet
    their neighbours only. A pair meets in several slices and is kept in the
    first that both have. Empty intervals meet nothing.
    """
    keys = []
    for n, (a0, a1, b0, b1) in enumerate(spans):
        keys.append(f"_cell{n}")
        a = _sliced(a.where(F.col(a0) < F.col(a1)), a0, a1, size, keys[n])
        b = _sliced(b.where(F.col(b0) < F.col(b1)), b0, b1, size, keys[n])
    pairs = a.join(b, [*by, *keys])
    for key, (a0, _, b0, _) in zip(keys, spans, strict=True):
        pairs = pairs.where(F.col(key) == F.floor(F.greatest(F.col(a0), F.col(b0)) / size))
    return pairs.drop(*keys)


def meeting_boxes(a: DataFrame, b: DataFrame, by: list[str], prefix: str, size: float) -> DataFrame:
    """Pairs of boxes of a group that share a cell of a grid; b's corners have a prefix."""
    return meeting(a, b, by, [("x0", "x1", prefix + "x0", prefix + "x1"), ("y0", "y1", prefix + "y0", prefix + "y1")], size)


def spatial_links(words: DataFrame, boxes: DataFrame, by: list[str], least: float = 0.5, order: str = "ord", cell: float = 64) -> DataFrame:
    """Each word with the boxes of its page that hold at least a share (above 0) of its area; unmatched words stay.

    boxes has symbol, relation, line and the order column besides its corners;
    all hits of a word are put together with "; " in that order.
    """
    rows = words.withColumn("_word", F.monotonically_increasing_id()) if "word_id" not in words.columns else words.withColumn("_word", F.col("word_id"))
    b = boxes.where(F.col("relation").isin("member", "borderline", "note"))
    b = b.select(*by, *[F.col(c).alias("b_" + c) for c in ("x0", "y0", "x1", "y1", "symbol", "relation", "line", order)])
    share = G.overlap_share(G.box(), G.box("b_"))
    hits = meeting_boxes(rows.select("_word", *by, "x0", "y0", "x1", "y1"), b, by, "b_", cell).where(share >= least)
    text = lambda c: F.array_join(F.transform(F.col("_hits"), lambda h: h[c].cast("string")), "; ").alias(f"symbol_{c}" if c != "symbol" else c)
    hit = F.struct(F.col("b_" + order).alias("o"), *[F.coalesce(F.col("b_" + c).cast("string"), F.lit("")).alias(c) for c in ("symbol", "relation", "line")])
    joined = hits.groupBy("_word").agg(F.array_sort(F.collect_list(hit)).alias("_hits"))
    joined = joined.select("_word", text("symbol"), text("relation"), text("line"))
    return rows.join(joined, "_word", "left").drop("_word")


def span_overlaps(spans: DataFrame, by: list[str], key: str, least: float = 0.5, size: float = 32) -> DataFrame:
    """Pairs (key_a < key_b) of spans of one token whose x-intervals overlap by IoU of a share above 0."""
    a = spans.select(*by, F.col(key).alias(key + "_a"), F.col("x0").alias("_p"), F.col("x1").alias("_q"))
    b = spans.select(*by, F.col(key).alias(key + "_b"), F.col("x0").alias("_r"), F.col("x1").alias("_s"))
    share = G.x_iou(F.col("_p"), F.col("_q"), F.col("_r"), F.col("_s"))
    pairs = meeting(a, b, by, [("_p", "_q", "_r", "_s")], size).where((F.col(key + "_a") < F.col(key + "_b")) & (share >= least))
    return pairs.select(*by, key + "_a", key + "_b", share.alias("iou"))


def carried_over(old: DataFrame, new: DataFrame, least_iou: float = 0.5, least_share: float = 0.5, cell: float = 64) -> DataFrame:
    """For each new cluster, the old one that covers the largest share of its boxes, if that is at least least_share.

    Both have cluster, page and corners. A box counts once for each old cluster
    with any box of its page at IoU >= least_iou. The lower old cluster wins ties.
    """
    n = new.withColumn("_item", F.monotonically_increasing_id()) if "item" not in new.columns else new.withColumn("_item", F.col("item"))
    sizes = new.groupBy(F.col("cluster").alias("new_cluster")).agg(F.count("*").alias("size"))
    o = old.select("page", F.col("cluster").alias("old_cluster"), *[F.col(c).alias("o_" + c) for c in ("x0", "y0", "x1", "y1")])
    hits = meeting_boxes(n.select("_item", "page", F.col("cluster").alias("new_cluster"), "x0", "y0", "x1", "y1"), o, ["page"], "o_", cell)
    hits = hits.where(G.iou(G.box(), G.box("o_")) >= least_iou).select("_item", "new_cluster", "old_cluster").distinct()
    counts = hits.groupBy("new_cluster", "old_cluster").agg(F.count("*").alias("n")).join(sizes, "new_cluster")
    counts = counts.withColumn("share", F.col("n") / F.col("size")).where(F.col("share") >= least_share)
    best = F.max_by(F.struct("old_cluster", "share"), F.struct("share", -F.col("old_cluster")))
    return counts.groupBy("new_cluster").agg(best.alias("_b")).select("new_cluster", "_b.old_cluster", "_b.share")


def best_overlap(words: DataFrame, refs: DataFrame, by: list[str], word: str, ref: str, least: float = 0.4, cell: float = 64) -> DataFrame:
    """Each word with the ref of its page that it overlaps most, by the smaller area, or null below the limit."""
    r = refs.select(*by, F.col(ref).alias("_ref"), *[F.col(c).alias("r_" + c) for c in ("x0", "y0", "x1", "y1")])
    share = G.least_overlap(G.box(), G.box("r_"))
    hits = meeting_boxes(words.select(word, *by, "x0", "y0", "x1", "y1"), r, by, "r_", cell).withColumn("_share", share).where(F.col("_share") >= least)
    best = hits.groupBy(word).agg(F.max_by(F.struct(F.col("_ref").alias(ref), F.col("_share").alias("share")), F.struct("_share", -F.col("_ref"))).alias("_b"))
    return words.join(best, word, "left").select(*words.columns, f"_b.{ref}", "_b.share")


def nearest(points: DataFrame, refs: DataFrame, by: list[str], key: str, at: str, ref_at: str, within: float | None = None) -> DataFrame:
    """Each point with the nearest ref of its group, the lower one of two as near; null if the group has none within reach.

    Both neighbours of a point come from one pass over points and refs sorted
    together, so no pair is ever formed.
    """
    a = points.select(*by, F.col(at).alias("_x"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"))
    b = refs.select(*by, F.col(ref_at).alias("_x"), F.lit(0).alias("_kind"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    both = a.unionByName(b).where("_x is not null")
    ref = F.when(F.col("_kind") == 0, F.col("_x"))
    order = Window.partitionBy(*by).orderBy("_x", "_kind")
    low = F.last(ref, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first(ref, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumn("_low", low).withColumn("_high", high).where("_kind = 1")
    near = F.when(F.col("_low").isNull() | (F.col("_high") - F.col("_x") < F.col("_x") - F.col("_low")), F.col("_high")).otherwise(F.col("_low"))
    out = rows.select("_row.*", near.alias("nearest"), F.abs(near - F.col("_x")).alias("distance"))
    if within is None:
        return out
    fine = F.col("distance") <= within
    return out.withColumns({"nearest": F.when(fine, F.col("nearest")), "distance": F.when(fine, F.col("distance"))})


def containing_or_nearest(points: DataFrame, spans: DataFrame, by: list[str], key: str, at: str, size: float = 64) -> DataFrame:
    """Each point with the span (lo, hi, name) of its group that contains it, else the one whose edge is nearest; of equals the first by lo, then name.

    Points at one place of a group fare alike, so places are answered, once each,
    and points look theirs up. Containing spans meet places in slices; the nearest
    edges on either side of the other places come from passes over sorted places,
    ends and starts, one from below and one from above: a frame that runs on to
    the end of its group would be read again for each row.
    """
    places = stored(points.select(*by, at).distinct(), "places")
    here = places.where(F.col(at).isNotNull()).select(*by, at, F.floor(F.col(at) / size).alias("_slice"))
    inside = here.join(_sliced(spans.select(*by, "lo", "hi", "name"), "lo", "hi", size, "_slice"), [*by, "_slice"])
    inside = inside.where(F.col(at).between(F.col("lo"), F.col("hi")))
    inside = inside.groupBy(*by, at).agg(F.min_by(F.struct("name", F.lit(0).alias("gap")), F.struct("lo", "name")).alias("_in"))
    none = F.lit(None)
    kinds = {c: spans.schema[c].dataType for c in ("lo", "hi", "name")}
    p = places.select(*by, F.col(at).alias("_x"), F.lit(1).alias("_kind"), *[none.cast(k).alias(c) for c, k in kinds.items()])
    edge = lambda x, kind: spans.select(*by, F.col(x).alias("_x"), F.lit(kind).alias("_kind"), "lo", "hi", "name")
    both = p.unionByName(edge("hi", 0)).unionByName(edge("lo", 2))
    span = lambda kind: F.when(F.col("_kind") == kind, F.struct("lo", "hi", "name"))
    before = Window.partitionBy(*by).orderBy("_x", "_kind", F.desc("lo"), F.desc("name")).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*by).orderBy(F.desc("_x"), F.desc("_kind"), F.desc("lo"), F.desc("name")).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_low", F.last(span(0), ignorenulls=True).over(before)).withColumn("_high", F.last(span(2), ignorenulls=True).over(behind)).where("_kind = 1")
    low, high = F.col("_x") - F.col("_low.hi"), F.col("_high.lo") - F.col("_x")
    first = F.col("_high").isNull() | (low < high) | ((low == high) & (F.struct("_low.lo", "_low.name") < F.struct("_high.lo", "_high.name")))
    near = F.when(F.col("_low").isNotNull() & first, F.struct("_low.name", low.alias("gap"))).when(F.col("_high").isNotNull(), F.struct("_high.name", high.alias("gap")))
    keys = [F.col(c).alias("_" + c) for c in by]
    here = rows.select(*by, F.col("_x").alias(at), near.alias("_near")).join(inside, [*by, at], "left")
    name, gap = (F.when(F.col("_in").isNotNull(), F.col(f"_in.{c}")).otherwise(F.col(f"_near.{c}")).alias("_" + c + "_") for c in ("name", "gap"))
    here = small(stored(here.select(*keys, F.col(at).alias("_at"), name, gap), "places-answered"))
    same = F.col(at).eqNullSafe(F.col("_at"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col("_" + c))
    return points.join(here, same, "left").select(*points.columns, F.col("_name_").alias("name"), F.col("_gap_").alias("gap"))


def contained(items: DataFrame, spans: DataFrame, by: list[str], member: float = 0.8, borderline: float = 0.25, size: float = 1000) -> DataFrame:
    """Items with the spans that cover a share of them: relation member or borderline, and the coverage. items(lo, hi), spans(s_lo, s_hi)."""
    share = G.coverage(F.col("lo"), F.col("hi"), F.col("s_lo"), F.col("s_hi"))
    pairs = meeting(items, spans, by, [("lo", "hi", "s_lo", "s_hi")], size).withColumn("coverage", share)
    relation = F.when(F.col("coverage") >= member, "member").when(F.col("coverage") >= borderline, "borderline")
    return pairs.withColumn("relation", relation).where("relation is not null")


def reading_neighbours(tokens: DataFrame, reach: int, by: list[str], key: str, order: list[str]) -> DataFrame:
    """(by, key, side, step, neighbour) of each token: the tokens up to reach before (side -1) and behind (1) it in the same group."""
    w = Window.partitionBy(*by).orderBy(*order)
    steps = [F.struct(F.lit(s).alias("side"), F.lit(d).alias("step"), (F.lag if s < 0 else F.lead)(key, d).over(w).alias("neighbour")) for d in range(1, reach + 1) for s in (-1, 1)]
    rows = tokens.select(*by, key, F.array(*steps).alias("_n")).select(*by, key, F.explode("_n").alias("_n"))
    return rows.select(*by, key, "_n.side", "_n.step", "_n.neighbour").where("neighbour is not null")


def shifted_neighbours(scores: DataFrame, a: DataFrame, b: DataFrame, by: list[str], value: str, key_a: str = "tok_a", key_b: str = "tok_b") -> DataFrame:
    """For each pair of tokens, the greatest value of pairs next to it on the same side, as support.

    a and b are reading_neighbours of either side: (by, tok, side, neighbour).
    Each score is sent to the pairs that it is a neighbour of, so the scores
    themselves are never looked up: two joins on the neighbours and one maximum.
    """
    ra = a.select(*by, F.col("neighbour").alias(key_a), F.col("side"), F.col("tok").alias("_ta"))
    rb = b.select(*by, F.col("neighbour").alias(key_b), F.col("side"), F.col("tok").alias("_tb"))
    sent = scores.select(*by, key_a, key_b, value).join(ra, [*by, key_a]).join(rb, [*by, key_b, "side"])
    return sent.groupBy(*by, F.col("_ta").alias(key_a), F.col("_tb").alias(key_b)).agg(F.max(value).alias("support"))


def touching(matches: DataFrame, groups: DataFrame, left: list[str], right: list[str], on: list[str]) -> DataFrame:
    """Rows of matches of which either end is in groups. `A or B` in one semi-join could not be hashed; two are."""
    g = groups.select(*on).distinct()
    side = lambda cols, mark: matches.join(g.select(*[F.col(o).alias(c) for o, c in zip(on, cols, strict=True)]), cols, "left_semi")
    first = side(left, 0)
    return first.unionByName(side(right, 1).join(g.select(*[F.col(o).alias(c) for o, c in zip(on, left, strict=True)]), left, "left_anti"))


def symmetric(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges in both directions."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.unionByName(edges.select(F.col(b).alias(a), F.col(a).alias(b), *rest))


def without(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df not in done, nulls compared as values."""
    d = done.select(*[F.col(c).alias("_d" + c) for c in on]).distinct()
    same: Column = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col("_d" + c))
    return df.join(d, same, "left_anti")


def orphans(rows: DataFrame, parents: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a parent, rows without one)."""
    p = parents.select(*on).distinct()
    return rows.join(p, on, "left_semi"), rows.join(p, on, "left_anti")


def replaced(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return without(old, new, on).unionByName(new)
