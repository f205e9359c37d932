"""The test tables as the engine's entities: candidates, tokens, words, boxes, edges and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import vectors as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str, scaled: bool = True) -> DataFrame:
    """Embeddings as candidates: a page for each label, two to a token, sizes and places made from the number. Vectors are scaled to length 1 or as they are."""
    e = table(spark, sf_dir, "embeddings")
    n = F.col("vec_id")
    x0 = ((n * 13) % 40).cast("int")
    w = (20 + (n * 7) % 50).cast("int")
    h = (10 + (n * 3) % 11).cast("int")
    return e.select(
        F.concat(F.lit("p"), F.col("label").cast("string")).alias("page"), F.floor(n / 2).cast("long").alias("tok"), n.alias("cand"),
        w.cast("double").alias("w"), h.cast("double").alias("h"), F.lit(20.0).alias("unit"), (V.scaled(F.col("embedding")) if scaled else F.col("embedding").cast("array<double>")).alias("feat"),
        F.lit(None).cast("array<double>").alias("seq"), x0.alias("x0"), F.lit(0).alias("y0"), (x0 + w).alias("x1"), h.alias("y1"),
    )


def tokens(cands: DataFrame) -> DataFrame:
    """Their tokens in reading order: one column, eight to a line."""
    rows = cands.select("page", "tok").distinct()
    return rows.withColumn("col", F.lit(0)).withColumn("line", F.floor(F.col("tok") / 8).cast("int")).withColumn("pos", (F.col("tok") % 8).cast("int"))


#: The same as SQL.
CANDIDATES = """
  SELECT 'p' || label AS page, vec_id // 2 AS tok, vec_id AS cand, 20 + (vec_id * 7) % 50 AS w, 10 + (vec_id * 3) % 11 AS h,
         CAST(embedding AS DOUBLE[]) AS f, (vec_id * 13) % 40 AS x0 FROM embeddings
"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents with their place: line, number in the line, first and last character."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return d.select("doc_id", "line", F.posexplode(F.split("t", " ")).alias("pos", "word")).where("word <> ''")


WORDS = """
  SELECT doc_id, line, p - 1 AS pos, word FROM (
    SELECT doc_id, line, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM (
      SELECT doc_id, i - 1 AS line, string_split(t, ' ') AS ws FROM (
        SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))))
  WHERE word <> ''
"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes on the page of their supplier."""
    li = table(spark, sf_dir, "lineitem")
    x0, y0 = (F.col("l_partkey") % 1000).cast("int"), (F.col("l_orderkey") % 700).cast("int")
    return li.select(
        F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box_id"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 5 + F.col("l_quantity").cast("int")).alias("x1"), (y0 + 10 + F.col("l_linenumber")).alias("y1"), "l_linenumber", "l_returnflag", "l_linestatus",
    )


BOXES = """
  SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS box_id, l_partkey % 1000 AS x0, l_orderkey % 700 AS y0,
         l_partkey % 1000 + 5 + CAST(l_quantity AS INT) AS x1, l_orderkey % 700 + 10 + l_linenumber AS y1, l_linenumber, l_returnflag, l_linestatus FROM lineitem
"""
