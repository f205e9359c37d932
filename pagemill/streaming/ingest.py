"""File-source streams.

Pages that arrive in a folder are worked on once and their rows replace those
of the same page; a stopped run goes on where it was, as the stream's checkpoint
and Spark's commits say. Windows, sessions and late data on event streams go
beyond what batch queries here do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.joins import replaced
from pagemill.storage import new_path

IMAGE_FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, glob: str = "*", per_batch: int = 100) -> DataFrame:
    """Files of a folder as a stream of (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").schema(IMAGE_FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(folder)


def arriving_rows(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", per_batch: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).parquet(folder)


def work_pages(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, page: str = "page") -> None:
    """Apply work to each batch and replace the pages it has in a table partitioned by page; returns when all that has arrived is done.

    Overwriting a page's partition twice gives the same table, so a batch that is run again does no harm.
    """

    def batch(df: DataFrame, _: int) -> None:
        work(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(page).parquet(out)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert(table: DataFrame, batch: DataFrame, on: list[str]) -> DataFrame:
    """A table with a batch's rows in place of those with the same keys."""
    return replaced(table, batch, on)


def append_log(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append a stream's rows to a table."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def windowed(stream: DataFrame, time: str, by: list[str], value: str, size: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Counts and sums over tumbling or sliding windows, for rows up to `late` behind the latest."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    rows = stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions: rows of a key with less than a gap between them."""
    rows = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def first_of(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Rows whose keys were not seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that has arrived and read what it appended; complete for windows that the watermark has passed or that the end flushes."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    append_log(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
