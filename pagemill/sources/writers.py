"""Writers: CSV with fixed decimals, nested JSON, JSON-LD, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.joins import replaced, without


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A CSV folder with a header; one_file for small reports. Spark's commit protocol leaves no half-written file."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def decimals(c: Column, n: int) -> Column:
    """A number with fixed decimals; empty for null."""
    return F.when(c.isNull(), "").otherwise(F.format_string(f"%.{n}f", c))


def match_rows(found: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Matches as text columns; for one pair of pages the first two are named after them."""
    rows = found.orderBy(F.desc("z")) if a is not None else found
    first, second = (f"{a}_candidate", f"{b}_candidate") if a is not None else ("a_candidate", "b_candidate")
    return rows.select(
        F.col("cand_a").alias(first), F.col("cand_b").alias(second), decimals(F.col("z"), 2).alias("z_context"), decimals(F.col("z_base"), 2).alias("z_score"),
        decimals(F.col("support"), 2).alias("neighbour_support"), decimals(F.col("score"), 3).alias("combined_score"),
        decimals(F.col("cos"), 3).alias("hog_cosine"), decimals(F.col("dtw"), 3).alias("dtw_distance"),
    )


def nested_segmentation(tokens: DataFrame) -> DataFrame:
    """tokens(page, column, line, token, box...) as one nested document for each page: columns, lines, tokens."""
    box = F.struct(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height", "group")])
    hull = lambda s: F.struct(F.array_min(F.transform(s, lambda b: b["x0"])).alias("x0"), F.array_min(F.transform(s, lambda b: b["y0"])).alias("y0"), F.array_max(F.transform(s, lambda b: b["x1"])).alias("x1"), F.array_max(F.transform(s, lambda b: b["y1"])).alias("y1"))
    lines = tokens.groupBy("page", "column", "line").agg(F.sort_array(F.collect_list(F.struct("token", box.alias("b")))).alias("_t"))
    lines = lines.select("page", "column", "line", F.transform("_t", lambda t: t["b"]).alias("tokens"))
    lines = lines.select("page", "column", F.struct("line", hull(F.col("tokens")).alias("box"), "tokens").alias("l"))
    cols = lines.groupBy("page", "column").agg(F.sort_array(F.collect_list("l")).alias("lines"))
    cols = cols.select("page", F.struct("column", hull(F.transform("lines", lambda x: x["box"])).alias("box"), "lines").alias("c"))
    return cols.groupBy("page").agg(F.to_json(F.sort_array(F.collect_list("c"))).alias("document"))


def append_rows(df: DataFrame, path: str) -> None:
    """Rows added to a table; what is there stays readable throughout."""
    df.write.mode("append").parquet(path)


def replace_pages(new: DataFrame, path: str, page: str = "page") -> None:
    """Rewrite only the pages that new has: dynamic overwrite of a table partitioned by page."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(page).parquet(path)


def drop_pages(table: DataFrame, pages: DataFrame, page: str = "page") -> DataFrame:
    return without(table, pages, [page])


def merged_in_order(tables: DataFrame, order: DataFrame, page: str = "page", keys: tuple[str, ...] = ("symbol", "line")) -> DataFrame:
    """Rows of many pages in the order of a list of pages(page, ord)."""
    return tables.join(order, page).orderBy("ord", *keys).drop("ord")


def rewritten(df: DataFrame, path: str) -> None:
    """Replace a table that df itself may be read from.

    The new table is written beside the old one; then names are exchanged, which
    a file system does at once, so a crash leaves the old or the new table, and
    between the two names the old one as path.old, which the next reading by
    recovered() puts back.
    """
    spark = df.sparkSession
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    df.write.parquet(new)
    files, at = _files(spark, path)
    recovered(spark, path)
    old = at(f"{path.rstrip('/')}.old")
    if files.exists(at(path)) and not files.rename(at(path), old):
        raise OSError(f"can't set {path} aside")
    if not files.rename(at(new), at(path)):
        files.rename(old, at(path))
        raise OSError(f"can't put the new table at {path}")
    files.delete(old, True)


def recovered(spark: SparkSession, path: str) -> str:
    """path, after a rewrite that was cut off has been undone or finished."""
    files, at = _files(spark, path)
    old = at(f"{path.rstrip('/')}.old")
    if files.exists(old):
        if files.exists(at(path)):
            files.delete(old, True)
        else:
            files.rename(old, at(path))
    return path


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes its paths."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def decided(clusters: DataFrame, occurrences: DataFrame, run: str, include_removed: bool = False) -> DataFrame:
    """Kept words of labelled clusters of a run, in the export's columns."""
    status = ["labelled", "removed"] if include_removed else ["labelled"]
    c = clusters.where((F.col("run_id") == run) & F.col("status").isin(status))
    o = occurrences.where(F.coalesce("removed", F.lit(0)) == 0)
    names = ["run_id", "number", "status", "kind", "concept", "name", "name_source", "auto_name", "page", "token", "candidate", "x0", "y0", "x1", "y1", "annotator", "updated_at", "note"]
    return c.join(o, "cluster_id").select(*[F.col(n).alias({"run_id": "run", "number": "cluster"}.get(n, n)) for n in names])


def web_annotations(rows: DataFrame, base: str = "") -> DataFrame:
    """Decided words as W3C Web Annotations: one JSON text each. A body only where there is a name or a concept."""
    tag = F.struct(F.lit("TextualBody").alias("type"), F.lit("tagging").alias("purpose"), F.col("name").alias("value"), F.lit(None).cast("string").alias("source"))
    link = F.struct(F.lit("SpecificResource").alias("type"), F.lit("linking").alias("purpose"), F.lit(None).cast("string").alias("value"), F.col("concept").alias("source"))
    body = F.filter(F.array(F.when(F.col("name").isNotNull(), tag), F.when(F.col("concept").isNotNull(), link)), lambda x: x.isNotNull())
    where = F.format_string("xywh=pixel:%d,%d,%d,%d", F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    selector = F.struct(F.lit("FragmentSelector").alias("type"), F.lit("http://www.w3.org/TR/media-frags/").alias("conformsTo"), where.alias("value"))
    target = F.struct(F.concat(F.lit(base), "page").alias("source"), selector.alias("selector"))
    ident = F.concat(F.lit(base + "#"), F.concat_ws("-", "run", F.col("cluster").cast("string"), "page", "token"))
    item = F.struct(
        ident.alias("id"), F.lit("Annotation").alias("type"), F.lit("tagging").alias("motivation"), F.col("annotator").alias("creator"),
        F.col("updated_at").alias("modified"), body.alias("body"), target.alias("target"),
    )
    return rows.select("run", "cluster", "page", "token", F.to_json(item).alias("annotation"))


def collection(items: DataFrame, label: str) -> DataFrame:
    """Annotations as one collection document. For exports of one run; for more, write the items as lines."""
    doc = F.concat(
        F.lit('{"@context":"http://www.w3.org/ns/anno.jsonld","type":"AnnotationCollection","label":' + json.dumps(label)),
        F.lit(',"total":'), F.count("*").cast("string"), F.lit(',"items":['), F.array_join(F.sort_array(F.collect_list("annotation")), ","), F.lit("]}"),
    )
    return items.agg(doc.alias("document"))


def timing_lines(rows: DataFrame) -> DataFrame:
    """Average, fastest and slowest second of images done, and how many failed."""
    ok = F.when(F.col("status") == "ok", F.col("seconds"))
    return rows.agg(
        F.count("*").alias("images"), F.count_if(F.col("status") != "ok").alias("failed"), F.round(F.avg(ok), 2).alias("average"),
        F.round(F.min(ok), 2).alias("fastest"), F.round(F.max(ok), 2).alias("slowest"),
    )


def retried(old: DataFrame, new: DataFrame) -> DataFrame:
    """Timing rows with those of images run again replaced."""
    return replaced(old, new, ["image"])


def region_document(lines: DataFrame) -> DataFrame:
    """lines(page, id, polygon, baseline) as JSON for each page."""
    row = F.struct("id", "polygon", "baseline")
    return lines.groupBy("page").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("document"))


def write_page_xml(lines: DataFrame, path: str) -> None:
    """Lines as TextLine elements."""
    text = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(",", F.round(p["x"]).cast("int").cast("string"), F.round(p["y"]).cast("int").cast("string"))), " ")
    rows = lines.select(F.col("id").alias("_id"), F.struct(text("polygon").alias("_points")).alias("Coords"), F.struct(text("baseline").alias("_points")).alias("Baseline"))
    rows.write.mode("overwrite").format("xml").option("rowTag", "TextLine").option("rootTag", "Page").save(path)
