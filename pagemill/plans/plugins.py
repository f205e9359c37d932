"""Plug-ins: a spotter or a word reader given by module name."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from types import ModuleType

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a spotter module must offer.
SPOTTER = ("Params", "matches", "clusters")


def spotter(name: str = "pagemill.plans.spotting", required: tuple[str, ...] = SPOTTER) -> ModuleType:
    """A module by name, or an error that says what it lacks."""
    try:
        module = importlib.import_module(name)
    except ImportError as e:
        raise ValueError(f"no spotter module {name}: {e}") from e
    if missing := [r for r in required if not hasattr(module, r)]:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return module


def readings(words: DataFrame, read: Callable[[list[bytes]], list[str]], image: str = "crop", key: str = "occ_id") -> DataFrame:
    """(key, reading) of word crops by a reader function, a batch at a time; a batch that fails gives nulls. Votes come from aggregates.majority."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            try:
                found = read(part[image].tolist())
            except Exception:  # noqa: BLE001
                found = [None] * len(part)
            yield pd.DataFrame({key: part[key], "reading": found})

    return words.select(key, image).mapInPandas(each, f"{key} {words.schema[key].dataType.simpleString()}, reading string")


def read_all(words: DataFrame, read: Callable[[list[bytes]], list[str]], path: str, progress: Callable[[int, int], None] | None = None, image: str = "crop", key: str = "occ_id", parts: int = 8) -> DataFrame:
    """All readings, written to path in so many parts by a hash of the key; progress(done, parts) is called after each.

    A part that is there already is not read again, so a run that was cut off
    goes on where it ended.
    """
    spark = words.sparkSession
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for part in range(parts):
        own = f"{path}/part={part}"
        done = files(f"{own}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            rows = words.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
            readings(rows, read, image, key).write.mode("overwrite").parquet(own)
        if progress is not None:
            progress(part + 1, parts)
    return spark.read.parquet(path).drop("part")
