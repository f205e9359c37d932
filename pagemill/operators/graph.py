"""Entities, regions and images as a graph, and the trace from one to another.

The graph is kept as tables: entity(entity, type, name), region(region, page,
box), image(page, path) and occurrence(entity, region). The encoding as sets,
in which every fact is a set node with its members as literals, is an export.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import capitalised


def built(annotations: DataFrame, symbols: DataFrame, images: DataFrame) -> dict[str, DataFrame]:
    """Tables of the graph from annotations(concept, name, page, box), symbols(page, kind, box, symbol, relation) and images(page, path, ord).

    Names and kinds are capitalised. Each distinct (type, name) is one entity. A
    page's path is that of its last row. Rows that relate to a symbol whose own
    row is missing are left out and returned as orphans.
    """
    image = images.groupBy("page").agg(F.max_by("path", "ord").alias("path"))
    own = symbols.where("relation = 'symbol'").select("page", "symbol").distinct()
    fine, lost = symbols.join(own, ["page", "symbol"], "left_semi"), symbols.join(own, ["page", "symbol"], "left_anti")
    box = ["page", "x0", "y0", "x1", "y1"]
    rows = annotations.select(F.lit("Annotation").alias("type"), capitalised(F.col("name")).alias("name"), F.col("concept"), F.lit(None).cast("string").alias("relation"), *box)
    rows = rows.unionByName(fine.select(F.lit("Symbol").alias("type"), capitalised(F.col("kind")).alias("name"), F.lit(None).cast("string").alias("concept"), "relation", *box))
    rows = rows.withColumn("entity", F.sha1(F.concat_ws("\x1f", "type", "name"))).withColumn("region", F.sha1(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in box])))
    return {
        "entity": rows.groupBy("entity").agg(F.first("type").alias("type"), F.first("name").alias("name"), F.min("concept").alias("concept")),
        "region": rows.select("region", *box).distinct(), "image": image,
        "occurrence": rows.select("entity", "region", "relation").distinct(), "orphans": lost,
    }


def entities(graph: dict[str, DataFrame]) -> DataFrame:
    """All entities with how many regions and pages they have."""
    rows = graph["occurrence"].join(graph["region"], "region")
    counts = rows.groupBy("entity").agg(F.count_distinct("region").alias("regions"), F.count_distinct("page").alias("pages"))
    return graph["entity"].join(counts, "entity")


def found(graph: dict[str, DataFrame], name: str, kind: str | None = None) -> DataFrame:
    """Entities by name, in any case, and type."""
    rows = graph["entity"].where(F.lower("name") == name.lower())
    return rows if kind is None else rows.where(F.col("type") == kind)


def trace(graph: dict[str, DataFrame], which: DataFrame) -> DataFrame:
    """The image regions of entities: type, name, page, path, box, relation."""
    rows = which.join(graph["occurrence"], "entity").join(graph["region"], "region").join(graph["image"], "page", "left")
    return rows.select("type", "name", "page", "path", "x0", "y0", "x1", "y1", "relation")


def on_image(graph: dict[str, DataFrame], page: str) -> DataFrame:
    """What is on a page: its regions with their entities. The page filter reaches the regions before any join."""
    rows = graph["region"].where(F.col("page") == page).join(graph["occurrence"], "region").join(graph["entity"], "entity")
    return rows.select("type", "name", "x0", "y0", "x1", "y1", "relation")


def as_sets(graph: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the set encoding: a set node for each fact, an edge from each member to it; literals are `$` and their text.

    An attribute is the set {entity, key, value}. A value equal to its key is one
    member with it and so can't be read back, as with sets it must be.
    """
    facts = graph["entity"].select("entity", F.explode(F.create_map(F.lit("type"), F.col("type"), F.lit("name"), F.col("name"))).alias("key", "value"))
    facts = facts.select(F.array("entity", F.concat(F.lit("$"), "key"), F.concat(F.lit("$"), "value")).alias("m"))
    facts = facts.unionByName(graph["occurrence"].select(F.array("entity", "region").alias("m")))
    facts = facts.unionByName(graph["region"].select(F.array("region", F.concat(F.lit("$"), "page")).alias("m")))
    sets = facts.withColumn("set", F.concat(F.lit("_set"), F.sha1(F.array_join("m", "\x1f"))))
    edges = sets.select(F.explode(F.array_distinct("m")).alias("src"), F.col("set").alias("dst")).distinct()
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), edges


def attribute(edges: DataFrame, key: str) -> DataFrame:
    """(entity, value) read back from the sets that hold a key: sets with exactly one member besides the two."""
    sets = edges.where(F.col("src") == "$" + key).select("dst")
    rows = edges.join(sets, "dst").where(F.col("src") != "$" + key)
    pairs = rows.groupBy("dst").agg(F.count("*").alias("n"), F.max(F.when(~F.col("src").startswith("$"), F.col("src"))).alias("entity"), F.max(F.when(F.col("src").startswith("$"), F.col("src"))).alias("value"))
    return pairs.where("n = 2 and entity is not null and value is not null").select("entity", F.expr("substr(value, 2)").alias("value"))
