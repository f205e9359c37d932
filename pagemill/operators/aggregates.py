"""Grouped operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.functions import geometry as G
from pagemill.functions import vectors as V
from pagemill.operators.components import components
from pagemill.operators.windows import placed
from pagemill.storage import stored


def token_max(pairs: DataFrame, by: list[str], score: str = "score", allowed: str = "allowed") -> DataFrame:
    """For each pair of tokens: u, the best score; t, the best of allowed candidate pairs; and the (i, j) that reach t, the first in row order."""
    gated = F.when(F.col(allowed), F.struct(F.col(score).alias("s"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j")))
    best = pairs.groupBy(*by, "tok_a", "tok_b").agg(F.max(score).alias("u"), F.max(gated).alias("_t"))
    return best.select(*by, "tok_a", "tok_b", "u", F.col("_t.s").alias("t"), (-F.col("_t.i")).alias("i"), (-F.col("_t.j")).alias("j"))


def background_z(df: DataFrame, by: list[str], value: Column, background: str, out: str, a: str = "tok_a", b: str = "tok_b") -> DataFrame:
    """The lower of value's standard scores against its row's and its column's background."""
    stats = lambda key, s: df.groupBy(*by, key).agg(F.avg(background).alias("_m" + s), F.stddev_pop(background).alias("_s" + s))
    rows = df.join(stats(a, "a"), [*by, a]).join(stats(b, "b"), [*by, b])
    score = lambda s: (value - F.col("_m" + s)) / (F.col("_s" + s) + 1e-8)
    return rows.withColumn(out, F.least(score("a"), score("b"))).drop("_ma", "_sa", "_mb", "_sb")


def median_pitch(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.median(value).alias("pitch"))


def line_pitch(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """Median distance of consecutive lines."""
    step = F.col(at) - F.lag(at).over(Window.partitionBy(*by).orderBy(at))
    return df.withColumn("_step", step).groupBy(*by).agg(F.median("_step").alias("pitch"))


def percentiles(df: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """Interpolated percentiles, one column each."""
    names = [F.percentile(value, p).alias(f"p{round(100 * p):02d}") for p in at]
    return df.groupBy(*by).agg(*names)


def ordered_distinct(df: DataFrame, by: list[str], value: str, order: str, out: str, mark: str = "; ") -> DataFrame:
    """Distinct values in the order of their first sight, put together. Repeats are dropped before they are collected."""
    first = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(order).alias("_o"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("_o"), F.col(value))))
    return first.groupBy(*by).agg(F.array_join(F.transform(rows, lambda x: x[value].cast("string")), mark).alias(out))


def majority(df: DataFrame, by: list[str], value: str, order: str, rank: Column | None = None) -> DataFrame:
    """The most frequent value of each group, the first seen of equals: value, n, total, distinct values, and votes as n/total.

    auto_name is the value if it is the only one or has two votes or more. rank,
    of n and first (the first sight of a value), decides in place of that order,
    among the values where it isn't null; of equal ranks the first seen wins.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first")) if rank is None else F.when(rank.isNotNull(), F.struct(rank, -F.col("first"))))
    out = counts.groupBy(*by).agg(best.alias("_b"), F.sum("n").alias("total"), F.count("*").alias("readings"))
    out = out.select(*by, f"_b.{value}", "_b.n", "total", "readings")
    votes = F.concat_ws("/", F.col("n").cast("string"), F.col("total").cast("string"))
    return out.withColumn("votes", votes).withColumn("auto_name", F.when((F.col("readings") == 1) | (F.col("n") >= 2), F.col(value)))


def status_counts(df: DataFrame, by: list[str], status: str, values: list[str]) -> DataFrame:
    """How many rows have each status, 0 where none has."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values])


def cluster_summary(members: DataFrame, edges: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Clusters of matched candidates, numbered by size and best z.

    members(node, page, token, x0, x1, ...) are candidates, edges(a, b, z) accepted
    matches between them. Spans of one token that overlap are one occurrence:
    they are linked too, and each (page, token) is listed once, by its widest
    candidate, the first of equals. Clusters of one occurrence are dropped.
    Columns: cluster, size, n_pages, best_z and those of members.
    """
    met = edges.select(F.col("a").alias("node"), "z").unionByName(edges.select(F.col("b").alias("node"), "z"))
    met = met.groupBy("node").agg(F.max("z").alias("_z"))
    nodes = stored(members.join(met, "node"), "matched")
    spans = nodes.select("page", "token", "node", "x0", "x1")
    a, b = spans.alias("a"), spans.alias("b")
    share = G.x_iou(F.col("a.x0"), F.col("a.x1"), F.col("b.x0"), F.col("b.x1"))
    same = (F.col("a.page") == F.col("b.page")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & (share >= overlap)
    more = a.join(b, same).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    parts = components(edges.select("a", "b").unionByName(more))
    rows = nodes.join(parts, "node")
    best_z = rows.groupBy("component").agg(F.max("_z").alias("best_z"))
    widest = F.max_by(F.struct(*members.columns), F.struct(F.col("x1") - F.col("x0"), -F.col("node")))
    kept = rows.groupBy("component", "page", "token").agg(widest.alias("_m"))
    sizes = kept.groupBy("component").agg(F.count("*").alias("size"), F.count_distinct("page").alias("n_pages")).where("size > 1").join(best_z, "component")
    sizes = placed(sizes, [-F.col("size"), -F.col("best_z"), F.col("component")], "cluster").withColumn("cluster", F.col("cluster").cast("int"))
    return kept.join(sizes, "component").select("cluster", "size", "n_pages", "best_z", "_m.*")


def retrieval(scores: DataFrame, gold: DataFrame, by: list[str], a: str, b: str, score: str) -> DataFrame:
    """Ranks of gold(by, a, b) partners from both ends (1 + how many score higher): rank_a among a row's, rank_b among a column's.

    scores may leave out pairs that score lower than all gold ones of their row
    and column: they change no rank. Each end takes one sort, whatever the number
    of gold pairs in a row.
    """
    g = gold.select(*by, a, b).distinct()
    at = lambda key: F.rank().over(Window.partitionBy(*by, key).orderBy(F.desc(score)))
    ranked = scores.select(*by, a, b, score).withColumn("rank_a", at(a)).withColumn("rank_b", at(b))
    return ranked.join(g, [*by, a, b], "left_semi").select(*by, a, b, *[F.col(c).cast("long").alias(c) for c in ("rank_a", "rank_b")])


def retrieval_metrics(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Mean reciprocal rank, hit@1, hit@3 and median rank over both directions."""
    rows = ranks.select(*by, F.explode(F.array("rank_a", "rank_b")).alias("rank"))
    return rows.groupBy(*by).agg(
        F.avg(1 / F.col("rank")).alias("mrr"), F.avg((F.col("rank") <= 1).cast("double")).alias("hit1"),
        F.avg((F.col("rank") <= 3).cast("double")).alias("hit3"), F.median("rank").alias("median_rank"),
    )


def rank_metrics(ranks: DataFrame, by: list[str]) -> DataFrame:
    """retrieval_metrics of ranks(by, rank, n) that occur n times each."""
    total, of = F.sum("n"), lambda v: F.sum(v * F.col("n"))
    return ranks.groupBy(*by).agg(
        (of(1 / F.col("rank")) / total).alias("mrr"), (of((F.col("rank") <= 1).cast("double")) / total).alias("hit1"),
        (of((F.col("rank") <= 3).cast("double")) / total).alias("hit3"), F.percentile("rank", 0.5, F.col("n")).alias("median_rank"),
    )


def judged(accepted: DataFrame, gold: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    """How many accepted pairs, named by the columns in on, are gold (correct), judged but not gold (wrong), or never judged."""
    g = gold.select(*on).distinct().withColumn("_g", F.lit(True))
    s = seen.select(*on).distinct().withColumn("_s", F.lit(True))
    rows = accepted.select(*on).join(g, on, "left").join(s, on, "left")
    right, known = F.col("_g").isNotNull(), F.col("_s").isNotNull()
    return rows.agg(F.count_if(right).alias("correct"), F.count_if(~right & known).alias("wrong"), F.count_if(~right & ~known).alias("unjudged"))


def profiles(df: DataFrame, by: list[str], vector: str, width: str, dims: int) -> DataFrame:
    """Of each cluster: the sum of its unit vectors, its size and its median width."""
    rows = df.withColumn("_u", V.scaled(F.col(vector)))
    out = rows.groupBy(*by).agg(*V.sums(F.col("_u"), dims), F.count("*").alias("size"), F.median(width).alias("median_width"))
    return out.select(*by, F.array(*[f"s{i}" for i in range(dims)]).alias("profile"), "size", "median_width")


#: Profiles that a member is compared with at a time.
PROFILE_BLOCK = 1024


def fit(members: DataFrame, profile: DataFrame, vector: str, own: str = "cluster") -> DataFrame:
    """Mean cosine of each member with each cluster; with its own cluster, itself left out: (dot - 1) / (n - 1). Null for a cluster of one.

    Members are compared with blocks of profiles as matrices; blocks of either
    side meet in the cells of a grid, so neither is held whole. The cells have
    one type on both sides: numbers of other types are dealt to other tasks.
    """
    p = profile.select(F.col(own).alias("target"), "profile", "size")
    blocks = F.lit(max(1, -(-p.count() // PROFILE_BLOCK)))  # one row for each cluster
    parts = F.lit(max(1, -(-members.count() // (8 * PROFILE_BLOCK))))
    rest = [c for c in members.columns if c != vector]
    left = members.withColumn("_u", V.scaled(F.col(vector))).withColumn("_i", F.pmod(F.xxhash64(*rest), parts).cast("long")).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))))
    right = p.withColumn("_j", F.pmod(F.xxhash64("target"), blocks).cast("long")).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))))
    kind = T.StructType([*members.drop(vector).schema.fields, *p.select("target", "size").schema.fields, T.StructField("mean_cosine", T.DoubleType())])

    def each(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=kind.names)
        u, q = np.array(a["_u"].tolist(), dtype=np.float64), np.array(b["profile"].tolist(), dtype=np.float64)
        dot, size = u @ q.T, b["size"].to_numpy(dtype=np.float64)[None]
        mine = a[own].to_numpy()[:, None] == b["target"].to_numpy()[None]
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(mine, np.where(size > 1, (dot - 1) / (size - 1), np.nan), dot / size)
        x, y = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
        out = a[rest].iloc[x].reset_index(drop=True)
        out["target"], out["size"], out["mean_cosine"] = b["target"].to_numpy()[y], b["size"].to_numpy()[y], mean.ravel()
        return out

    out = left.where("_u is not null").groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInPandas(each, kind)
    return out.withColumn("mean_cosine", F.nanvl("mean_cosine", F.lit(None).cast("double")))


def verdicts(fits: DataFrame, key: str, mean: float, deviation: float, margin: float = 0.5, least: float = 1.5, own: str = "cluster") -> DataFrame:
    """Whether each member should stay: keep, move (to the best other cluster), remove or single.

    Means become standard scores against a background. A member moves if another
    cluster fits better by the margin and well enough, goes if neither fits.
    """
    z = (F.col("mean_cosine") - mean) / (deviation + 1e-8)
    rows = fits.withColumn("_z", z).withColumn("_mine", F.col(own) == F.col("target"))
    best = F.max_by(F.struct(F.col("target"), F.col("_z")), F.when(~F.col("_mine"), F.struct(F.col("_z"), -F.col("target"))))
    out = rows.groupBy(key, own).agg(F.max(F.when(F.col("_mine"), F.col("_z"))).alias("own_z"), best.alias("_b"))
    out = out.select(key, own, "own_z", F.col("_b.target").alias("best_target"), F.col("_b._z").alias("best_z"))
    alone = F.col("own_z").isNull()
    move = (F.col("best_z") >= least) & (alone | (F.col("best_z") > F.col("own_z") + margin))
    verdict = F.when(move, "move").when(alone, "single").when(F.col("own_z") < least, "remove").otherwise("keep")
    return out.withColumn("verdict", verdict)


def overruled(checks: DataFrame, edges: DataFrame, members: DataFrame, key: str, least: float = 1.5, own: str = "cluster") -> DataFrame:
    """Verdicts of checks(key, own, own_z, best_target, verdict) after what accepted matches say.

    edges(a, b, z) are matches between members(key, own). A member doesn't move
    while its strongest match in its own cluster is as strong as that in the
    target, and isn't removed while it has any in its own.
    """
    both = edges.select(F.col("a").alias(key), F.col("b").alias("_other"), "z").unionByName(edges.select(F.col("b").alias(key), F.col("a").alias("_other"), "z"))
    best = both.join(members.select(F.col(key).alias("_other"), F.col(own).alias("_of")), "_other").groupBy(key, "_of").agg(F.max("z").alias("_z"))
    mine = best.select(key, F.col("_of").alias(own), F.col("_z").alias("_own_match"))
    other = best.select(key, F.col("_of").alias("best_target"), F.col("_z").alias("_target_match"))
    rows = checks.join(mine, [key, own], "left").join(other, [key, "best_target"], "left")
    held = F.col("_own_match").isNotNull() & (F.col("_target_match").isNull() | (F.col("_own_match") >= F.col("_target_match")))
    stays = F.when((F.col("own_z") < least) & F.col("_own_match").isNull(), "remove").otherwise("keep")
    verdict = F.when((F.col("verdict") == "move") & held, stays).when((F.col("verdict") == "remove") & F.col("_own_match").isNotNull(), "keep").otherwise(F.col("verdict"))
    return rows.withColumn("verdict", verdict).select(*checks.columns)


def background(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """Mean and deviation of the cosine over all pairs of different rows, exactly and without forming a pair.

    With unit vectors u, the cosines of all ordered pairs sum to |sum u|^2 and
    their squares to the squared entries of the sum of u u^T; each row's cosine
    of 1 with itself is taken off. The outer products are summed as they stream.
    """
    unit = df.select(V.scaled(F.col(vector)).alias("u")).where(F.col("u").isNotNull())
    linear = unit.agg(F.count("*").alias("n"), *V.sums(F.col("u"), dims))
    index = F.explode(F.sequence(F.lit(0), F.lit(dims - 1)))
    cells = unit.select("u", index.alias("i")).select("i", F.posexplode(F.transform("u", lambda x: x * F.get("u", F.col("i")))).alias("j", "v"))
    square = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("q"))
    total = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(1, dims)), F.col("s0") * F.col("s0"))
    pairs = F.col("n") * (F.col("n") - 1)
    both = linear.select("n", total.alias("l")).crossJoin(square)  # two single rows
    mean = F.try_divide(F.col("l") - F.col("n"), pairs)
    variance = F.try_divide(F.col("q") - F.col("n"), pairs) - mean * mean
    return both.select(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), variance)).alias("deviation"), "n")


def durations(df: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """Average, least and greatest duration; text that is no number doesn't count."""
    s = F.col(seconds).cast("string").try_cast("double")
    return df.groupBy(*by).agg(F.avg(s).alias("average"), F.min(s).alias("fastest"), F.max(s).alias("slowest"), F.count(s).alias("timed"))


def envelope(df: DataFrame, by: list[str]) -> DataFrame:
    """The union of boxes."""
    return df.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
