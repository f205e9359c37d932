"""Session settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "pagemill", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session as the engine expects it: UTC, adaptive plans, Arrow transfer, ANSI arithmetic.

    Settings that depend on the cluster (memory, shuffle partitions) are left
    to spark-submit; local runs get few shuffle partitions.
    """
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
        builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
