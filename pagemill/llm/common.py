"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.storage import BROADCAST_ROWS, new_path, shared_dir, small, stored

__all__ = [
    "BROADCAST_ROWS", "SPACE", "WORD", "crc_mod", "dropped", "free_name", "given_back", "named", "new_path", "sampled", "shared_dir", "small", "stored", "table", "text_of",
    "word_count", "words_of",
]

#: ASCII white space, as a character class.
SPACE = r"[\x20\x09-\x0D]"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, with null read as no text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty if it has none."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def word_count(text: Column) -> Column:
    """Number of words, without building an array: each word and the space behind it become one letter."""
    led = F.regexp_replace(text, f"^{SPACE}+", "")
    return F.char_length(F.regexp_replace(led, f"{WORD}{SPACE}*", "x")).cast("long")


def crc_mod(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo divisor; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor).cast("int")


def dropped(df: DataFrame) -> None:
    """Delete the files behind a stored() table that is no longer read."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def named(df: DataFrame) -> list[Column]:
    """df's columns, quoted, so that dots and spaces in names don't matter."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sampled(rows: DataFrame, most: int, by: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Of rows(doc_id, text, by): one row for each of at most so many different ids of each group, with turn, a hash of the id, that decides which.

    Ids are counted, not rows, so an id that repeats takes one place only, with
    the text of the least hash. A first filter by the hash keeps, of a group with
    n ids (an estimate, by HyperLogLog), about 4 * most + 200; it can't leave fewer
    than most but by a chance below 1e-100. So a group with a third of all rows is
    no more work for a task than a small one. Null ids are not in the sample. ids
    (doc_id, by), if given, are the ones to choose from; texts are read when the
    choice is made.
    """
    keys = [by] if by else []
    turn = F.xxhash64(F.lit("sample"), "doc_id")
    known = (rows if ids is None else ids).select("doc_id", *keys).where("doc_id is not null").withColumn("turn", turn)
    n = known.groupBy(*keys).agg(F.approx_count_distinct("doc_id", 0.03).alias("_n"))
    even = (F.col("turn") / F.lit(2.0**63) + 1) / 2
    share = F.lit(4.0 * most + 200) / F.greatest(F.col("_n"), F.lit(1))
    few = known.select("doc_id", "turn", *keys)
    few = few.join(small(stored(n, "sample-sizes")), by) if by else few.crossJoin(F.broadcast(n))  # one row
    few = few.where(even <= share).select("doc_id", "turn", *keys).distinct()
    if by:
        rank = F.row_number().over(Window.partitionBy(by).orderBy("turn", "doc_id"))
        few = few.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
    else:
        few = few.orderBy("turn", "doc_id").limit(most)
    few = small(stored(few, "sample-ids"))
    text = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("_t")
    return rows.join(few, ["doc_id", *keys]).groupBy("doc_id", "turn", *keys).agg(text).select("doc_id", "turn", *keys, "_t.text")


def given_back() -> None:
    """In a worker: hand freed memory back to the system, where the C library can. Workers live on for other tasks."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
