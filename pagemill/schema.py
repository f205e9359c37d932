"""Schemas of the engine's tables. Column names and order are fixed values of the data formats."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {
    "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(),
    "ARRAY<FLOAT>": T.ArrayType(T.FloatType()),
}


def _schema(ddl: str) -> T.StructType:
    """A schema from `name TYPE, ...`; needs no session, unlike StructType.fromDDL."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (part.split() for part in ddl.split(","))])


BOX = _schema("x0 INT, y0 INT, x1 INT, y1 INT, width INT, height INT, group INT")
TOKENS = _schema("column INT, line INT, token INT, x0 INT, y0 INT, x1 INT, y1 INT, width INT, height INT, group INT")
CANDIDATES = _schema(
    """page STRING, cand BIGINT, tid STRING, parent STRING, x0 INT, y0 INT, x1 INT, y1 INT, is_full BOOLEAN,
    feat ARRAY<FLOAT>, seq ARRAY<FLOAT>"""
)
CLUSTERS_CSV = _schema(
    "cluster INT, size INT, n_pages INT, best_z DOUBLE, page STRING, token STRING, candidate STRING, x0 INT, y0 INT, x1 INT, y1 INT"
)
SYMBOLS = _schema(
    """source_file STRING, page STRING, image_width INT, image_height INT, symbol STRING, kind STRING, relation STRING, line INT,
    ox0 INT, oy0 INT, ox1 INT, oy1 INT, x0 INT, y0 INT, x1 INT, y1 INT, sheet_x INT, sheet_y INT, column INT, column_x0 INT,
    column_x1 INT, coverage DOUBLE, attributes STRING, line_spacing_px DOUBLE, stroke_width_px DOUBLE, run_date STRING, settings STRING"""
)
RUNS = _schema("run_id STRING, folder STRING, image_dir STRING, imported_at STRING")
PAGES = _schema("run_id STRING, page STRING, path STRING")
CLUSTER_LABELS = _schema(
    """cluster_id BIGINT, run_id STRING, number INT, best_z DOUBLE, status STRING, kind STRING, concept STRING, name STRING,
    name_source STRING, auto_name STRING, auto_source STRING, annotator STRING, updated_at STRING, note STRING, merged_into BIGINT"""
)
CONCEPTS = _schema("name STRING, source STRING, note STRING, n_clusters INT, signifiers STRING, created_by STRING, created_at STRING")
OCCURRENCES = _schema(
    """occ_id BIGINT, cluster_id BIGINT, origin_cluster BIGINT, page STRING, token STRING, candidate STRING,
    x0 INT, y0 INT, x1 INT, y1 INT, removed INT"""
)
HISTORY = _schema("event_id BIGINT, ts STRING, annotator STRING, action STRING, cluster_id BIGINT, payload STRING")
PAGE_INDEX = _schema(
    """page STRING, source_file STRING, source_width INT, source_height INT, side STRING, page_width INT, page_height INT,
    fold_found INT, to_original STRING"""
)
TIMINGS = _schema(
    """image STRING, status STRING, seconds DOUBLE, marks_seconds DOUBLE, words_seconds DOUBLE, braces INT, member_lines INT,
    notes INT, rule INT, slash INT, dash INT, circle INT, filler INT, word_matches INT, word_clusters INT, word_occurrences INT,
    word_symbol_links INT, error STRING"""
)
ANNOTATIONS = _schema("concept STRING, name STRING, page STRING, x0 STRING, y0 STRING, x1 STRING, y1 STRING")

#: Declared schemas by name, for detection from a header.
DECLARED = {
    "annotations": ANNOTATIONS.names, "symbols": SYMBOLS.names, "clusters": CLUSTERS_CSV.names, "tokens": TOKENS.names,
    "occurrences": OCCURRENCES.names, "timings": TIMINGS.names,
}
#: Names that a page column may have.
PAGE_NAMES = ("page", "document", "image")
