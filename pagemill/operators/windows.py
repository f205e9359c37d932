"""Window operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from pagemill.storage import stored


def _over(by: list[str], *order: Column | str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def reciprocal_top_k(df: DataFrame, by: list[str], a: str, b: str, score: str, k: int | Column, margin: float | None = None) -> DataFrame:
    """Pairs that are among the k best of both their row and their column, ties by the other key, and, with a margin,
    no further below the best of either. Rank and best of a row come from one sort."""
    wa, wb = _over([*by, a], F.desc(score), b), _over([*by, b], F.desc(score), a)
    rows = df.withColumns({"rank_a": F.row_number().over(wa), "best_a": F.first(score).over(wa)})
    rows = rows.withColumns({"rank_b": F.row_number().over(wb), "best_b": F.first(score).over(wb)})
    fine = (F.col("rank_a") <= k) & (F.col("rank_b") <= k)
    if margin is not None:
        fine = fine & (F.col(score) >= F.col("best_a") - margin) & (F.col(score) >= F.col("best_b") - margin)
    return rows.where(fine)


def numbered(df: DataFrame, by: list[str], order: list[Column | str], out: str = "number") -> DataFrame:
    """Rows numbered from 1 within groups."""
    return df.withColumn(out, F.row_number().over(_over(by, *order)))


def placed(df: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """Rows numbered from 1 over the whole table, without one task for all: rows are sorted by ranges, ranges are counted, and
    each row's number is that within its range plus the rows of those before. Rows equal in the order are numbered in any."""
    keys = [f"_k{i}" for i in range(len(order))]
    ranged = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)]).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stored(ranged.withColumn("_id", F.monotonically_increasing_id()), "placed")  # partition number above, place within below
    part = F.shiftright("_id", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + own + 1).drop(*keys, "_id", "_part", "_start")


def true_runs(df: DataFrame, by: list[str], at: str, flag: str) -> DataFrame:
    """Runs (start, end exclusive) of places where the flag is true; a missing place ends a run."""
    rows = df.where(F.col(flag))
    island = F.col(at) - F.row_number().over(_over(by, at))
    runs = rows.withColumn("_island", island).groupBy(*by, "_island").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end"))
    return runs.drop("_island")


def merged_runs(runs: DataFrame, by: list[str], gap: int | float | str) -> DataFrame:
    """Runs merged where the gap before one is less than a number or column."""
    limit = F.col(gap) if isinstance(gap, str) else F.lit(gap)
    reach = F.max("end").over(_over(by, "start").rowsBetween(Window.unboundedPreceding, -1))
    rows = runs.withColumn("_new", (F.col("start") - reach >= limit).cast("int"))
    rows = rows.withColumn("_part", F.sum(F.coalesce("_new", F.lit(0))).over(_over(by, "start")))
    return rows.groupBy(*by, "_part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_part")


def gap_limits(runs: DataFrame, by: list[str], width: str, factor: float = 1.8, share: float = 0.006, fixed: float | None = None) -> DataFrame:
    """The gap at which runs are set apart: fixed, or the larger of factor x median gap and share x width; infinite for one run."""
    rows = runs.withColumn("_gap", F.col("start") - F.lag("end").over(_over(by, "start")))
    median = F.median("_gap")
    limit = F.when(median.isNull(), F.lit(float("inf"))).otherwise(F.greatest(factor * median, share * F.max(width)))
    return rows.groupBy(*by).agg((F.lit(float(fixed)) if fixed is not None else limit).alias("limit"))


def tokens_of_runs(runs: DataFrame, by: list[str], width: str, least: float = 0.006) -> DataFrame:
    """Runs merged by their group's gap limit; those narrower than least x width are dropped."""
    limits = gap_limits(runs, by, width)
    rows = merged_runs(runs.join(limits, by), by, "limit")
    widths = runs.groupBy(*by).agg(F.max(width).alias("_w"))
    return rows.join(widths, by).where(F.col("end") - F.col("start") >= least * F.col("_w")).drop("_w")


def moving(df: DataFrame, by: list[str], at: str, value: str, reach: int, how: str = "avg") -> DataFrame:
    """Average, minimum, maximum or median over reach places to either side, cut off at the ends."""
    w = _over(by, at).rowsBetween(-reach, reach)
    f = {"avg": F.avg, "min": F.min, "max": F.max, "median": F.median}[how]
    if how == "median":
        return df.withColumn("moving", _median_of(F.collect_list(value).over(w)))
    return df.withColumn("moving", f(value).over(w))


def _median_of(values: Column) -> Column:
    s, n = F.sort_array(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def peaks(df: DataFrame, by: list[str], at: str, value: str, least: float = 0.0) -> DataFrame:
    """Places higher than the place before and at least as high as that behind. Distance and prominence rules are in kernels.signal."""
    w = _over(by, at)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    rows = df.withColumn("_b", before).withColumn("_a", after)
    return rows.where((F.col(value) > F.col("_b")) & (F.col(value) >= F.col("_a")) & (F.col(value) >= least)).drop("_a", "_b")


def valley(df: DataFrame, by: list[str], at: str, value: str, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """The place with the least value, the first of equals, optionally within a range of places."""
    rows = df if low is None else df.where((F.col(at) >= low) & (F.col(at) < high))
    return rows.groupBy(*by).agg(F.min_by(at, F.struct(value, at)).alias(at), F.min(value).alias(value))


def next_pending(clusters: DataFrame, run: str, after: int | None = None) -> DataFrame:
    """The first pending cluster number of a run behind a number; one row, null if there is none."""
    rows = clusters.where((F.col("run_id") == run) & (F.col("status") == "pending"))
    rows = rows if after is None else rows.where(F.col("number") > after)
    return rows.agg(F.min("number").alias("number"))
