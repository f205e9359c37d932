"""Readers of images, CSV, JSON and XML inputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill import schema
from pagemill.functions.text import folded
from pagemill.kernels import sheets as SH
from pagemill.operators.windows import placed
from pagemill.storage import stored

#: Suffixes of page images.
IMAGES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp")


class InputError(ValueError):
    """Input that can't be used."""


def stem(path: Column) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\?#]*)$", 1))


def images(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """Image files of a folder, not of those below it: path, page (the stem), length, content. A listing without content reads no bytes."""
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in IMAGES) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(folder)
    files = files.withColumn("page", stem(F.col("path")))
    return files if content else files.drop("content")


def repeated_stems(files: DataFrame, path: str = "path") -> DataFrame:
    """Stems that more than one distinct path has, with their number."""
    rows = files.select(F.col(path).alias("path")).distinct().withColumn("stem", stem(F.col("path")))
    return rows.groupBy("stem").agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1")


def checked_images(files: DataFrame) -> DataFrame:
    """The files, or an error if there is none or two share a stem."""
    if files.isEmpty():
        raise InputError("no images found")
    twice = repeated_stems(files).orderBy("stem").limit(5).collect()
    if twice:
        raise InputError("images share a name: " + ", ".join(r["stem"] for r in twice))
    return files


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of a folder's images by Spark's image source: page, height, width, channels, data (rows of BGR bytes).

    Photographs are turned the way their EXIF orientation says. A file that is no
    image keeps its row, with a height of -1, so that it can be reported.
    """
    df = spark.read.format("image").option("dropInvalid", "false").load(folder)
    df = df.select(stem(F.col("image.origin")).alias("page"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    files = images(spark, folder).select(F.col("page").alias("_page"), "content")

    def tags(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"_page": part["_page"], "_turn": [SH.orientation(bytes(c[: 1 << 18])) for c in part["content"]]})

    def turned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                pixels = SH.upright(np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, -1), int(r.turn))
                out.append((r.page, *pixels.shape, np.ascontiguousarray(pixels).tobytes()))
            yield pd.DataFrame(out, columns=["page", "height", "width", "channels", "data"])

    kind = "page string, height int, width int, channels int, data binary"
    rows = df.join(files.mapInPandas(tags, "_page string, _turn int").where("_turn > 1"), F.col("page") == F.col("_page"), "left").drop("_page")
    fine = rows.where("_turn is null or height < 0").drop("_turn")
    return fine.unionByName(rows.where("_turn is not null and height >= 0").withColumnRenamed("_turn", "turn").mapInPandas(turned, kind))


def sniffed(header: str) -> str:
    """The delimiter of a header line: the most frequent of four."""
    return max([",", ";", "\t", "|"], key=lambda d: header.count(d))


def tolerant_csv(spark: SparkSession, path: str, required: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """A CSV of strings with any usual delimiter, a byte-order mark or none, and headers in any case with spaces around.

    Only the header line comes to the driver.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise InputError(f"{path} is empty")
    header = first[0][0].lstrip("﻿")
    mark = sniffed(header)
    df = spark.read.csv(path, sep=mark, header=True, inferSchema=False, quote='"', escape='"', multiLine=True)
    df = df.toDF(*[c.lstrip("﻿").strip().lower() for c in df.columns])
    if missing := [c for c in required if c not in df.columns]:
        raise InputError(f"{path} lacks {', '.join(missing)}")
    return df


def typed_csv(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    """A CSV with declared types; empty cells are null, a missing file is an empty table."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(conf).exists(where):
        return spark.createDataFrame([], kind)
    names = spark.read.csv(path, header=True).columns
    raw = spark.read.csv(path, header=True, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]), quote='"', escape='"', multiLine=True)
    cell = lambda f: F.nullif(F.col(f"`{f.name}`"), F.lit("")).try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)
    return raw.select(*[cell(f).alias(f.name) for f in kind])


def exact_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose cells stay as they are: all strings, nothing read as missing."""
    df = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def detected(columns: list[str]) -> str:
    """The declared schema that shares most names with a header."""
    return max(schema.DECLARED, key=lambda name: len(set(schema.DECLARED[name]) & set(columns)))


def projected(df: DataFrame, name: str | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """df with the columns of a declared schema, in its order; also the columns dropped and those missing."""
    wanted = schema.DECLARED[name or detected(df.columns)]
    kept = [c for c in wanted if c in df.columns]
    return df.select(*kept), [c for c in df.columns if c not in wanted], [c for c in wanted if c not in df.columns]


def page_column(columns: list[str]) -> str | None:
    """The column that names the page, under any of its names."""
    return next((c for c in schema.PAGE_NAMES if c in columns), None)


def imported_clusters(rows: DataFrame, run_id: str, have: DataFrame | None = None, first_cluster: int = 1, first_occurrence: int = 1) -> tuple[DataFrame, DataFrame]:
    """clusters.csv rows as (clusters, occurrences) with ids in the order of first sight; an imported run is refused.

    rows has an order column `ord`. Both are numbered by ranges, so neither has
    to be sorted in one place.
    """
    if have is not None and not have.where(F.col("run_id") == run_id).isEmpty():
        raise InputError(f"run {run_id} is imported already")
    seen = rows.groupBy("cluster").agg(F.min("ord").alias("first"), F.max("best_z").alias("best_z"))
    ids = placed(seen, [F.col("first")], "cluster_id").withColumn("cluster_id", F.col("cluster_id") + first_cluster - 1)
    ids = stored(ids, "cluster-ids")
    out = ids.select("cluster_id", F.lit(run_id).alias("run_id"), F.col("cluster").alias("number"), "best_z", F.lit("pending").alias("status"))
    occ = placed(rows.drop("best_z").join(ids.select("cluster", "cluster_id"), "cluster"), [F.col("cluster_id"), F.col("ord")], "_place")
    return out, occ.select(
        (F.col("_place") + first_occurrence - 1).alias("occ_id"), "cluster_id", F.col("cluster_id").alias("origin_cluster"),
        "page", "token", "candidate", "x0", "y0", "x1", "y1", F.lit(0).alias("removed"),
    )


def concept_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Concepts of a .txt (one a line, # comments) or .csv (column concept, else the first; optional note), each spelling once."""
    if path.lower().endswith(".csv"):
        df = tolerant_csv(spark, path)
        name = "concept" if "concept" in df.columns else df.columns[0]
        rows = df.select(F.trim(name).alias("name"), (F.col("note") if "note" in df.columns else F.lit(None).cast("string")).alias("note"))
    else:
        line = F.trim(F.regexp_replace("value", "^﻿", ""))
        rows = spark.read.text(path).select(line.alias("name"), F.lit(None).cast("string").alias("note")).where(~F.col("name").startswith("#"))
    return rows.where("name is not null and name <> ''")


def new_concepts(rows: DataFrame, have: DataFrame) -> DataFrame:
    """Concepts whose folded name is not among those there are; of several spellings the least."""
    fresh = rows.withColumn("_k", folded(F.col("name"))).groupBy("_k").agg(F.min(F.struct("name", "note")).alias("_r"))
    known = have.select(folded(F.col("name")).alias("_k")).distinct()
    return fresh.join(known, "_k", "left_anti").select("_r.name", "_r.note")


def symbol_rows(spark: SparkSession, path: str) -> DataFrame:
    """result.json files as symbol rows: one for each mark, brace and line related to a brace."""
    box = "array<int>"
    kind = (
        f"source_file string, image_size {box}, sheet_offset {box}, columns array<array<int>>, line_spacing_px double, stroke_width_px double, run_date string, "
        f"settings string, marks array<struct<kind:string,bbox:{box},attributes:string>>, "
        f"braces array<struct<bbox:{box},column:int,attributes:string,lines:array<struct<relation:string,line:int,bbox:{box},coverage:double>>>>"
    )
    pages = spark.read.schema(kind).json(path, multiLine=True).withColumn("page", stem(F.col("source_file")))
    return flattened_symbols(pages)


def flattened_symbols(pages: DataFrame) -> DataFrame:
    """Nested page results as the 27 symbol columns. Boxes come as x, y, width, height of the sheet; ox0.. are those of the original image, empty if the offset is unknown."""
    none = lambda t: F.lit(None).cast(t)
    mark = F.transform("marks", lambda m, i: F.struct(
        F.concat(m["kind"], (i + 1).cast("string")).alias("symbol"), m["kind"].alias("kind"), F.lit("symbol").alias("relation"), none("int").alias("line"),
        m["bbox"].alias("b"), none("int").alias("column"), none("double").alias("coverage"), m["attributes"].alias("attributes")))
    name = lambda i: F.concat(F.lit("brace"), (i + 1).cast("string"))
    brace = F.transform("braces", lambda m, i: F.struct(
        name(i).alias("symbol"), F.lit("brace").alias("kind"), F.lit("symbol").alias("relation"), none("int").alias("line"),
        m["bbox"].alias("b"), m["column"].alias("column"), none("double").alias("coverage"), m["attributes"].alias("attributes")))
    lines = F.flatten(F.transform("braces", lambda m, i: F.transform(m["lines"], lambda x: F.struct(
        name(i).alias("symbol"), F.lit("brace").alias("kind"), x["relation"].alias("relation"), x["line"].alias("line"),
        x["bbox"].alias("b"), m["column"].alias("column"), x["coverage"].alias("coverage"), none("string").alias("attributes")))))
    empty = F.array().cast("array<struct<symbol:string,kind:string,relation:string,line:int,b:array<int>,column:int,coverage:double,attributes:string>>")
    rows = pages.withColumn("_s", F.explode(F.concat(F.coalesce(mark, empty), F.coalesce(brace, empty), F.coalesce(lines, empty))))
    b, off = F.col("_s.b"), F.col("sheet_offset")
    corners = [b[0], b[1], b[0] + b[2], b[1] + b[3]]
    span = F.get("columns", F.col("_s.column"))
    values = {
        "image_width": F.get("image_size", F.lit(0)), "image_height": F.get("image_size", F.lit(1)), "symbol": F.col("_s.symbol"), "kind": F.col("_s.kind"),
        "relation": F.col("_s.relation"), "line": F.col("_s.line"), "column": F.col("_s.column"), "coverage": F.col("_s.coverage"), "attributes": F.col("_s.attributes"),
        "sheet_x": F.get(off, F.lit(0)), "sheet_y": F.get(off, F.lit(1)), "column_x0": F.get(span, F.lit(0)), "column_x1": F.get(span, F.lit(1)),
        **dict(zip(("x0", "y0", "x1", "y1"), corners, strict=True)),
        **{"o" + n: c + F.get(off, F.lit(i % 2)) for i, (n, c) in enumerate(zip(("x0", "y0", "x1", "y1"), corners, strict=True))},
    }
    return rows.select(*[values.get(f.name, F.col(f.name) if f.name in pages.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.SYMBOLS])


def page_xml(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of PAGE-XML: id, polygon and baseline as arrays of points; lines that lack either are left out, those without an id are numbered."""
    kind = "_id string, Coords struct<_points:string>, Baseline struct<_points:string>"
    rows = spark.read.format("xml").option("rowTag", "TextLine").schema(kind).load(path)
    return lines_of(rows.select(F.col("_id").alias("id"), F.col("Coords._points").alias("coords"), F.col("Baseline._points").alias("base"), F.input_file_name().alias("file")))


def points(text: Column) -> Column:
    """`x,y x,y ...` as an array of points."""
    pair = lambda p, i: F.element_at(F.split(p, ","), i).cast("double")
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != ""), lambda p: F.struct(pair(p, 1).alias("x"), pair(p, 2).alias("y")))


def lines_of(rows: DataFrame) -> DataFrame:
    rows = rows.where("coords is not null and base is not null").withColumn("_at", F.monotonically_increasing_id())
    number = F.row_number().over(Window.partitionBy("file").orderBy("_at"))
    default = F.concat(F.lit("l"), F.lpad(number.cast("string"), 3, "0"))
    return rows.select("file", F.coalesce(F.nullif("id", F.lit("")), default).alias("id"), points(F.col("coords")).alias("polygon"), points(F.col("base")).alias("baseline"))


def chosen_candidates(rows: DataFrame, by: list[str], chosen: str = "chosen", full: str = "full", width: str = "width") -> DataFrame:
    """One candidate for each token: a chosen one before a full one before the widest."""
    order = F.struct(F.col(chosen).cast("int"), F.col(full).cast("int"), F.col(width), -F.col("cand"))
    return rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in by]), order).alias("_r")).select(*by, "_r.*")


def edge_document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of "a|b": z as edges (a, b, z), in both directions, the greatest z of each pair."""
    text = spark.read.text(path, wholetext=True)
    return edges_of(text.select(F.from_json("value", "map<string,double>").alias("m")))


def edges_of(maps: DataFrame) -> DataFrame:
    rows = maps.select(F.explode("m").alias("k", "z")).select(F.split_part("k", F.lit("|"), F.lit(1)).alias("a"), F.split_part("k", F.lit("|"), F.lit(2)).alias("b"), "z")
    both = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "z"))
    return both.groupBy("a", "b").agg(F.max("z").alias("z"))


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """pages.csv with its matrix column parsed into nine numbers."""
    df = typed_csv(spark, path, schema.PAGE_INDEX)
    return df.withColumn("matrix", F.flatten(F.from_json("to_original", "array<array<double>>")))
