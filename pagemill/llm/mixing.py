"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is met by whole passes over the source and a remainder.
Documents are counted by exact length; of each length the same share is taken
at first, and what is left of the budget is fitted by a bounded-knapsack
dynamic program over the documents that remain. The result is a count for each
length; which documents of a length are taken follows a seeded hash.

Only counts by (source, length) meet in one task, and only those of one
source, so a task's rows are bounded by the number of distinct lengths.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import named, stored, text_of, word_count

#: No document is taken more often than this.
PASSES = 3
#: A length's documents are ranked in so many slices of the hash, so that a length with very many documents is no single task.
SLICES = 64
_PLACE = ["_name", "_none", "_size", "_slice"]


def fitted(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length (positive, ascending, distinct) to take so that their sum is nearest below or at the budget.

    The same share of each length comes first, then lengths from the longest
    down while they fit, until no more than the reach of the program is left;
    the program then finds the best sum that the remaining documents can add,
    of up to twice the longest length, with one of the longest taken back so
    that there is room to choose.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    taken = np.array([int(c) * budget // total for c in counts.tolist()], dtype=np.int64)
    left = budget - int((lengths * taken).sum())
    reach = 2 * int(lengths[-1])
    for i in range(len(lengths) - 1, -1, -1):
        if left <= reach:
            break
        n = min(int(counts[i] - taken[i]), (left - reach) // int(lengths[i]) + 1, left // int(lengths[i]))
        taken[i] += n
        left -= n * int(lengths[i])
    for i in range(len(lengths)):  # room to choose: give documents back while the program still reaches
        if left + int(lengths[i]) > reach or left >= int(lengths[-1]):
            break
        n = min(int(taken[i]), (reach - left) // int(lengths[i]), 4)
        taken[i] -= n
        left += n * int(lengths[i])
    return taken + _knapsack(lengths, counts - taken, left)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The bounded knapsack: numbers of each length, up to counts, whose sum is the greatest that is at most budget.

    Sums reached are the bits of one integer. counts are split into powers of
    two; the piece that first reached a sum is kept, so walking back from the
    best sum meets each piece once at most.
    """
    full = (1 << (budget + 1)) - 1
    sums, pieces = 1, []
    first = np.full(budget + 1, -1, dtype=np.int64)
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        many, room = 1, min(count, budget // length)
        while room > 0:
            n = min(many, room)
            new = (sums << (n * length)) & full & ~sums
            if new:
                bits = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), dtype=np.uint8)
                first[np.flatnonzero(np.unpackbits(bits, bitorder="little")[: budget + 1])] = len(pieces)
                sums |= new
            pieces.append((i, n))
            room -= n
            many *= 2
        if sums == full:
            break
    out, at = np.zeros_like(counts), sums.bit_length() - 1
    while at:
        i, n = pieces[first[at]]
        out[i] += n
        at -= n * int(lengths[i])
    return out


def targets(sizes: DataFrame, passes: int = PASSES) -> DataFrame:
    """sizes(source, total) with weight and target.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and
    share the sum of all totals by weight. A target stops at passes times its
    source's total and the excess goes to the others by weight until none is
    above. That ends where every free source has one common rate of words for a
    unit of weight: sources are put in order of the rate at which they would
    stop, and the first that need not stop gives the rate. One row for each
    source; rows of documents don't come here.
    """
    code_points = F.hex(F.col("source").cast("binary"))
    order = Window.orderBy(F.col("source").isNull(), code_points)
    rows = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    rows = rows.withColumn("limit", F.col("total") * passes).withColumn("stops", F.col("limit") / F.col("weight"))
    by_rate = Window.orderBy("stops", F.col("source").isNull(), code_points)
    before = by_rate.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_rate.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    spent = F.coalesce(F.sum("limit").over(before), F.lit(0))
    rows = rows.withColumn("rate", (F.sum("total").over(whole) - spent) / F.sum("weight").over(onward))
    free = F.max(F.when(F.col("stops") >= F.col("rate"), F.col("rate"))).over(whole)  # later ones have lower rates
    rows = rows.withColumn("rate", free)
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("rate") * F.col("weight"), F.col("limit").cast("double")))
    return rows.select("source", "total", "weight", target.alias("target"))


def _plan(counts: pd.DataFrame) -> pd.DataFrame:
    """Of one source's counts by length: the count to take, beyond the whole passes."""
    counts = counts.sort_values("size")
    row = counts.iloc[0]
    budget = int(np.floor(row["target"] + 0.5)) - int(row["whole"]) * int(row["total"])
    some = counts[counts["size"] > 0]
    take = np.zeros(len(counts), dtype=np.int64)
    if len(some):
        take[(counts["size"] > 0).to_numpy()] = fitted(some["size"].to_numpy(), some["n"].to_numpy(), budget)
    return counts.assign(take=take)[["source", "size", "whole", "total", "target", "take"]]


def _turned(docs: DataFrame, seed: int, size: Column | None, *keep: Column | str) -> DataFrame:
    """docs' columns to keep, with _source, _size, _turn (a seeded hash) and _slice (the hash's leading bits)."""
    text = text_of()
    size = word_count(text) if size is None else size
    turn = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.crc32(text.cast("binary")))
    named = F.coalesce("source", F.lit("")).alias("_name"), F.col("source").isNull().alias("_none")  # keys without nulls
    rows = docs.select(*keep, F.col("source").alias("_source"), *named, size.cast("long").alias("_size"), turn.alias("_turn"))
    return rows.withColumn("_slice", F.shiftright("_turn", 58).cast("int") + SLICES // 2)


def _planned(rows: DataFrame, passes: int) -> DataFrame:
    """For each (_source, _size, _slice) of rows: the number of whole passes, how many more to take of the length, and how many come in earlier slices."""
    slices = stored(rows.groupBy("_source", *_PLACE).agg(F.count("*").alias("n")), "lengths")
    counts = slices.groupBy("_source", "_size").agg(F.sum("n").alias("n"))
    sums = counts.groupBy("_source").agg(F.sum(F.col("n") * F.col("_size")).alias("total"))
    total = targets(sums.withColumnRenamed("_source", "source"), passes)
    whole = F.when(F.col("total") > 0, F.floor(F.floor(F.col("target") + 0.5) / F.col("total"))).otherwise(0).cast("long")
    total = total.withColumn("whole", whole)
    counts = counts.join(total, F.col("source").eqNullSafe(F.col("_source"))).select("source", F.col("_size").alias("size"), "n", "whole", "total", "target")
    plan = counts.groupBy("source").applyInPandas(_plan, "source string, size long, whole long, total long, target double, take long")
    own = Window.partitionBy("_source", "_size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("start", F.coalesce(F.sum("n").over(own), F.lit(0))).drop("n")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    joined = starts.join(plan, same).select(*_PLACE, *[F.col(c).alias("_p" + c) for c in ("start", "whole", "take", "total", "target")])
    return stored(joined, "plan")


def _counted(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with _copies and the plan's columns."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*_PLACE).orderBy("_turn")))
    both = ranked.join(plan, _PLACE)  # by the window's keys: rows, with their texts, are dealt out once for both
    return both.withColumn("_copies", F.col("_pwhole") + (F.col("_rank") + F.col("_pstart") <= F.col("_ptake")).cast("long"))


def mixed(docs: DataFrame, seed: int = 17, passes: int = PASSES, size: Column | None = None) -> DataFrame:
    """docs' doc_id and source with size, source_size, target, copies and taken.

    size is the number of words (null text: none) unless a column is given.
    copies says how often the mix takes the document, passes at most; taken is
    copies times size. Documents without words add nothing; they come in the
    whole passes only. Which documents fill the remainder depends on the seed,
    doc_id and the text's crc32 alone; rows equal in these are ranked in any
    order, with the same counts. A null source is a source of its own. An empty
    table gives an empty table.
    """
    rows = stored(_turned(docs, seed, size, "doc_id"), "sizes")
    out = _counted(rows, _planned(rows, passes))
    return out.select(
        "doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_ptotal").alias("source_size"),
        F.col("_ptarget").alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: int = 17, passes: int = PASSES, size: Column | None = None) -> DataFrame:
    """The mix itself: docs' rows, each as often as mixed() takes it, with the columns of docs.

    Lengths are counted in one pass; texts are dealt out in a second one, in
    which each goes through one exchange. Null and empty texts come in whole
    passes only; a null source is a source; rows equal in doc_id and text are
    interchangeable; very long texts count by their words like any. Columns of
    any name come out as they went in. An empty table stays empty.
    """
    plan = _planned(_turned(docs, seed, size), passes)
    row = F.struct(*named(docs)).alias("_row")
    out = _counted(_turned(docs, seed, size, row), plan)
    out = out.where(F.col("_copies") > 0).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select("_row.*")
