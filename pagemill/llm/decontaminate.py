"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is found in a document if the document holds at least a share t
of the item's distinct word shingles. Items are partitioned by size, in powers
of two. An item's sketch holds its smallest shingle hashes (a bottom-k MinHash
sketch); k is set by the partition's largest item so that an item with
containment t or more must have a sketch hash in the document: at most q - ceil(tq)
of its q shingles can be missing, and k is one more than that. So, unlike with
banded signatures, whose chance to meet falls with a document's length, no
find depends on luck, and a document of any length needs no signature.
Candidates are then verified by counting the item's shingles themselves.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import small, stored, text_of


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), "")


def _grams(rows: DataFrame, keep: list[str], words: str, sizes: list[int], texts: bool = False) -> DataFrame:
    """One row for each run of so many words, for each of the sizes: k, its hash h and, if asked for, the words themselves as gram.

    All sizes come from one pass: each place gives its next words, as many as
    the largest size has, and one hash for each size that fits there.
    """
    most = max(sizes)
    n = F.size(words)
    parts = [F.slice(words, F.least(n, F.lit(i)) + 1, n).alias(f"g{i}") for i in range(most)]
    places = rows.where(n > 0).select(*keep, F.inline(F.arrays_zip(*parts)))  # words beyond the end are null
    names = [f"g{i}" for i in range(most)]

    def run(k: int) -> Column:
        own = F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), *names[:k]).alias("h"), *([F.array(*names[:k]).alias("gram")] if texts else []))
        return F.when(F.col(names[k - 1]).isNotNull(), own)

    fields = ["k", "h", *(["gram"] if texts else [])]
    if len(sizes) == 1:
        gram = [F.array(*names).alias("gram")] if texts else []
        return places.where(F.col(names[-1]).isNotNull()).select(*keep, F.lit(most).alias("k"), F.xxhash64(F.lit(most), *names).alias("h"), *gram)
    every = places.select(*keep, F.explode(F.array(*map(run, sizes))).alias("_r")).where("_r is not null")
    return every.select(*keep, *[F.col(f"_r.{c}").alias(c) for c in fields])


def _items(benchmark: DataFrame, size: int, at_least: float) -> tuple[DataFrame, list[int]]:
    """All distinct shingles of the items, with q (how many), need (how many must be found) and sketch (is it in the sketch)."""
    items = benchmark.select("item_id", normal_words(text_of()).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("k", F.least(F.size("w"), F.lit(size)))
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most `size` rows
    if not sizes:
        return benchmark.sparkSession.createDataFrame([], "item_id long, k int, gram array<string>, h long, q long, need long, sketch boolean"), []
    # an item's own size is the least of its length and `size`; its runs of other sizes are no shingles
    grams = _grams(items.withColumnRenamed("k", "_size"), ["item_id", "_size"], "w", sizes, texts=True).where("k = _size")
    table = grams.select("item_id", "k", "gram", "h").distinct()
    own = Window.partitionBy("item_id")
    table = table.withColumn("q", F.count("*").over(own))
    table = table.withColumn("need", F.ceil(F.col("q") * F.lit(at_least).cast("decimal(9,6)")).cast("long"))
    largest = F.pow(F.lit(2), F.floor(F.log2(F.col("q").cast("double"))) + 1).cast("long") - 1  # of the size partition
    depth = largest - F.ceil(largest * F.lit(at_least).cast("decimal(9,6)")).cast("long") + 1
    rank = F.row_number().over(own.orderBy("h", "gram"))
    return table.withColumn("sketch", rank <= depth), sizes


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, at_least: float = 0.8) -> DataFrame:
    """Pairs (doc_id, item_id) where the document holds at_least of the item's shingles, with the counts.

    Words are lower-cased runs of letters and digits, so case, punctuation and
    line breaks don't hide a passage. An item of fewer than size words is one
    shingle, its whole sequence; an item without words is never found. Rows of
    docs with one doc_id, null included, count as one document; null and empty
    texts hold nothing; texts of any length are searched whole, in one pass. Each
    item_id that repeats is one item with all its shingles; items with equal
    texts are found alike. An empty table on either side gives an empty table.
    Extra columns are not read. Columns: doc_id, item_id, item_shingles,
    matched_shingles, containment.
    """
    found, sizes = _items(benchmark, size, at_least)
    items = stored(found, "items")
    docs = docs.select("doc_id", text_of().alias("text"))
    empty = docs.sparkSession.createDataFrame([], docs.select("doc_id").schema).crossJoin(items.select("item_id").limit(0)) if not sizes else None
    if empty is not None:
        return empty.select("doc_id", "item_id", *[F.lit(0).cast(t).alias(n) for n, t in (("item_shingles", "long"), ("matched_shingles", "long"), ("containment", "double"))])
    split = docs.select("doc_id", normal_words(F.col("text")).alias("w"))
    sketch = small(items.where("sketch").select("item_id", "k", "h"))
    met = _grams(split, ["doc_id"], "w", sizes).join(sketch, ["k", "h"]).select("doc_id", "item_id")
    candidates = stored(met.distinct(), "candidates")

    ids = small(stored(candidates.select("doc_id").distinct(), "candidate-docs"))
    kept = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    kept = kept.select("doc_id", normal_words(F.col("text")).alias("w"))
    wanted = small(items.select("item_id", "k", "gram", "h", "q", "need"))
    own = _grams(kept, ["doc_id"], "w", sizes, texts=True).withColumnRenamed("gram", "own")
    every = own.join(wanted, ["k", "h"]).where("own = gram").select("doc_id", "item_id", "q", "need", "h", "gram")
    counted = every.distinct().groupBy("doc_id", "item_id", "q", "need").agg(F.count("*").alias("n")).where("n >= need")
    c = candidates.alias("c")
    sure = counted.alias("m").join(c, F.expr("m.doc_id <=> c.doc_id and m.item_id <=> c.item_id"), "left_semi")
    return sure.select(
        "doc_id", "item_id", F.col("q").alias("item_shingles"), F.col("n").alias("matched_shingles"),
        F.round(F.col("n") / F.col("q"), 6).alias("containment"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, at_least: float = 0.8) -> DataFrame:
    """The rows of docs in which no item is found, all columns kept, whatever their names.

    Rows that share a doc_id, null included, go or stay together; rows with null
    or empty texts hold nothing and stay unless such a namesake goes. An empty
    benchmark takes nothing away; an empty table stays empty.
    """
    ids = small(stored(contaminated(docs, benchmark, size, at_least).select("doc_id").distinct(), "contaminated"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_anti")
