"""Registered queries: one or more for each relational operator, over stand-ins from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import stats as ST
from pagemill.functions import text as TX
from pagemill.functions import vectors as V
from pagemill.operators import aggregates as A
from pagemill.operators import joins as J
from pagemill.operators import rules as R
from pagemill.operators import windows as W
from pagemill.operators.components import components
from pagemill.plans import spotting as S
from pagemill.plans.standins import BOXES, CANDIDATES, WORDS, boxes, candidates, table, words
from pagemill.sources import readers as RD
from pagemill.sources import writers as WR
from pagemill.storage import stored

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- sources and sinks ------------------------------------------------------------------------------------------------------


@query("""
SELECT page_id, regexp_replace(regexp_extract(url, '([^/]+)$', 1), '\\.[^.]*$', '') AS stem, lower(regexp_extract(url, '\\.([^./?#]*)$', 1)) AS suffix FROM pages
""")
def scan_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", RD.stem(F.col("url")).alias("stem"), RD.suffix(F.col("url")).alias("suffix"))


@query("""
SELECT stem, count(*) AS n, min(path) AS first FROM (
  SELECT DISTINCT url AS path, regexp_replace(regexp_extract(url, '([^/]+)$', 1), '\\.[^.]*$', '') AS stem FROM pages) GROUP BY stem HAVING count(*) > 1
""")
def scan_repeated_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RD.repeated_stems(table(spark, sf_dir, "pages"), "url")


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k, count(*) AS n FROM events GROUP BY event_type")
def scan_json_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count("*").alias("n"))


@query("""
WITH c AS (SELECT user_id AS cluster, min(event_id) AS first, round(max(value), 6) AS best_z FROM events GROUP BY user_id)
SELECT row_number() OVER (ORDER BY first) AS cluster_id, 'r' AS run_id, cluster AS number, best_z, 'pending' AS status FROM c
""")
def scan_import_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, _ = RD.imported_clusters(_cluster_rows(spark, sf_dir), "r")
    return clusters.withColumn("best_z", F.round("best_z", 6))


def _cluster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("cluster"), F.col("value").alias("best_z"), F.col("event_id").alias("ord"), F.col("event_type").alias("page"), F.col("event_id").cast("string").alias("token"), F.col("event_id").cast("string").alias("candidate"), *[F.lit(i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@query("""
WITH c AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id)
SELECT row_number() OVER (ORDER BY first, event_id) AS occ_id, dense_rank() OVER (ORDER BY first) AS cluster_id, event_type AS page, event_id::VARCHAR AS token FROM events JOIN c USING (user_id)
""")
def scan_import_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, occ = RD.imported_clusters(_cluster_rows(spark, sf_dir), "r")
    return occ.select("occ_id", "cluster_id", "page", "token")


_SPELLED = "CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand || ' ' || p_size) ELSE ' ' || lower(p_brand || ' ' || p_size) END"


@query(f"""
WITH r AS (SELECT *, {_SPELLED} AS name FROM part), f AS (SELECT *, min(name) OVER (PARTITION BY lower(trim(name))) AS least FROM r)
SELECT least AS name, min(p_type) FILTER (name = least) AS note FROM f WHERE lower(trim(name)) NOT IN (SELECT lower(p_brand || ' ' || p_size) FROM part WHERE p_retailprice > 1200) GROUP BY least
""")
def scan_new_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands with sizes, spelled in two ways, as concepts; those of dear parts are known."""
    p = table(spark, sf_dir, "part")
    plain = F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper(plain)).otherwise(F.concat(F.lit(" "), F.lower(plain)))
    return RD.new_concepts(p.select(name.alias("name"), F.col("p_type").alias("note")), p.where("p_retailprice > 1200").select(plain.alias("name")))


@query("""
SELECT o_orderkey::VARCHAR AS page, 'brace1' AS symbol, relation, line, x0, y0, x0 + 7 AS ox0, y0 + 3 AS oy0 FROM (
  SELECT o_orderkey, 'symbol' AS relation, NULL::INT AS line, (o_custkey % 100)::INT AS x0, (o_orderkey % 50)::INT AS y0 FROM orders
  UNION ALL SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'member' ELSE 'note' END, l_linenumber, (l_partkey % 90)::INT, (l_suppkey % 80)::INT FROM lineitem)
""")
def scan_flatten_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    box = lambda x, y: F.array(x.cast("int"), y.cast("int"), F.lit(5), F.lit(6))
    line = F.struct(F.when(F.col("l_linenumber") % 2 == 0, "member").otherwise("note").alias("relation"), F.col("l_linenumber").alias("line"), box(F.col("l_partkey") % 90, F.col("l_suppkey") % 80).alias("bbox"), F.lit(0.5).alias("coverage"))
    lines = li.groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    brace = F.struct(box(F.col("o_custkey") % 100, F.col("o_orderkey") % 50).alias("bbox"), F.lit(0).alias("column"), F.lit(None).cast("string").alias("attributes"), F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)).alias("lines"))
    pages = o.select(
        F.col("o_orderkey").cast("string").alias("page"), F.lit("f").alias("source_file"), F.array(F.lit(640), F.lit(480)).alias("image_size"), F.array(F.lit(7), F.lit(3)).alias("sheet_offset"),
        F.array(F.array(F.lit(0), F.lit(99))).alias("columns"), F.lit(40.0).alias("line_spacing_px"), F.lit(3.0).alias("stroke_width_px"), F.lit("d").alias("run_date"), F.lit("{}").alias("settings"),
        F.array().cast("array<struct<kind:string,bbox:array<int>,attributes:string>>").alias("marks"), F.array(brace).alias("braces"),
    )
    return RD.flattened_symbols(pages).select("page", "symbol", "relation", "line", "x0", "y0", "ox0", "oy0")


@query("""
SELECT l_orderkey::VARCHAR AS file, coalesce(CASE WHEN l_linenumber % 2 = 1 THEN 'x' || l_linenumber END, 'l' || lpad(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::VARCHAR, 3, '0')) AS id,
       3 AS points, (l_partkey % 100 + l_suppkey % 100 + 7)::DOUBLE AS sum_x FROM lineitem WHERE l_returnflag <> 'R'
""")
def scan_line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").repartition("l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    coords = F.concat_ws(" ", F.concat_ws(",", (F.col("l_partkey") % 100).cast("string"), F.lit("1")), F.concat_ws(",", (F.col("l_suppkey") % 100).cast("string"), F.lit("2")), F.lit("7,3"))
    rows = li.where("l_returnflag <> 'R'").select(F.col("l_orderkey").cast("string").alias("file"), F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("x"), F.col("l_linenumber").cast("string"))).alias("id"), coords.alias("coords"), F.lit("0,0").alias("base"))
    return RD.lines_of(rows).select("file", "id", F.size("polygon").alias("points"), F.aggregate("polygon", F.lit(0.0), lambda s, p: s + p["x"]).alias("sum_x"))


@query("SELECT label AS page, tok, arg_max(vec_id, (vec_id % 3 = 0)::INT * 1000000000 + (vec_id % 2)::INT * 100000000 + ((vec_id * 7) % 50) * 100000 - vec_id) AS cand FROM (SELECT *, vec_id // 2 AS tok FROM embeddings) GROUP BY ALL")
def scan_chosen_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("label").alias("page"), F.floor(F.col("vec_id") / 2).alias("tok"), F.col("vec_id").alias("cand"), (F.col("vec_id") % 3 == 0).alias("chosen"), (F.col("vec_id") % 2 == 1).alias("full"), ((F.col("vec_id") * 7) % 50).alias("width"))
    return RD.chosen_candidates(rows, ["page", "tok"]).select("page", "tok", "cand")


@query("""
WITH e AS (SELECT l_partkey::VARCHAR AS a, l_suppkey::VARCHAR AS b, l_quantity AS z FROM lineitem)
SELECT a, b, max(z) AS z FROM (SELECT * FROM e UNION ALL SELECT b, a, z FROM e) GROUP BY a, b
""")
def join_symmetric_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.create_map(F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")), F.col("l_quantity").cast("double")).alias("m"))
    return RD.edges_of(rows)


@query("SELECT count(*) AS images, count(*) FILTER (event_type = 'error') AS failed, round(avg(value) FILTER (event_type <> 'error'), 2) AS average, round(min(value) FILTER (event_type <> 'error'), 2) AS fastest, round(max(value) FILTER (event_type <> 'error'), 2) AS slowest FROM events")
def sink_timing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return WR.timing_lines(e.select(F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("value").alias("seconds")))


@query("""
SELECT page, count(*) AS columns, sum(lines) AS lines FROM (SELECT l_suppkey AS page, l_linenumber AS c, count(DISTINCT l_orderkey) AS lines FROM lineitem GROUP BY ALL) GROUP BY page
""")
def sink_nested_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    box = {c: F.lit(i) for i, c in enumerate(("x0", "y0", "x1", "y1", "width", "height", "group"))}
    rows = li.select(F.col("l_suppkey").alias("page"), F.col("l_linenumber").alias("column"), F.col("l_orderkey").alias("line"), F.col("l_partkey").alias("token"), *[v.alias(k) for k, v in box.items()])
    doc = F.from_json("document", "array<struct<column:int,lines:array<struct<line:int>>>>")
    return WR.nested_segmentation(rows).withColumn("d", doc).select("page", F.size("d").cast("long").alias("columns"), F.aggregate("d", F.lit(0), lambda a, c: a + F.size(c["lines"])).cast("long").alias("lines"))


@query("SELECT event_id, event_type, value FROM events WHERE value < 20 OR event_type <> 'error' UNION ALL SELECT event_id, 'ok', 1.0 FROM events WHERE value >= 20 AND event_type = 'error'")
def sink_retried_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    again = e.where("value >= 20 and event_type = 'error'").select("event_id", F.lit("ok").alias("event_type"), F.lit(1.0).alias("value"))
    return J.replaced(e, again, ["event_id"])


# --- projections, filters ---------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey * 10 + l_linenumber AS occ_id, l_suppkey AS cluster_id, l_partkey AS x0, l_partkey + 9 AS x1, 'occurrences' AS detected, 'note' AS dropped, 7 AS missing FROM lineitem")
def proj_schema_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items under a header in another order: the schema it belongs to, its columns in that schema's order, what is left over and what is missing."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.lit("-").alias("note"), (F.col("l_partkey") + 9).alias("x1"), F.col("l_partkey").alias("x0"), F.col("l_suppkey").alias("cluster_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("occ_id"))
    out, dropped, missing = RD.projected(rows)
    return out.withColumns({"detected": F.lit(RD.detected(rows.columns)), "dropped": F.lit("; ".join(dropped)), "missing": F.lit(len(missing))})


@query("SELECT p_partkey, round(ln(p_size / 20.0), 6) AS log_w, round(ln(p_retailprice / 1000.0), 6) AS log_h FROM part")
def proj_log_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.log(F.col("p_size") / 20.0), 6).alias("log_w"), F.round(F.log(F.col("p_retailprice") / 1000.0), 6).alias("log_h"))


_MAPPED = ["(1.1 * {x} + 0.05 * {y} + 3) / (0.0001 * {x} + 1)", "(-0.02 * {x} + 0.9 * {y} + 7) / (0.0001 * {x} + 1)"]
_CORNERS = [[m.format(x=x, y=y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))] for m in _MAPPED]


@query(f"""
WITH b AS ({BOXES}) SELECT box_id, floor(round(least({", ".join(_CORNERS[0])}), 6))::INT AS x0, floor(round(least({", ".join(_CORNERS[1])}), 6))::INT AS y0,
  ceil(round(greatest({", ".join(_CORNERS[0])}), 6))::INT AS x1, ceil(round(greatest({", ".join(_CORNERS[1])}), 6))::INT AS y1 FROM b
""")
def proj_map_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = [F.lit(x) for x in (1.1, 0.05, 3.0, -0.02, 0.9, 7.0, 0.0001, 0.0, 1.0)]
    b = boxes(spark, sf_dir)
    return b.select("box_id", *[c.alias(n) for c, n in zip(G.mapped_box(m, G.box()), ("x0", "y0", "x1", "y1"), strict=True)])


@query("SELECT p_partkey, round(least(least(p_size, 20) / greatest(p_size, 20)::DOUBLE, 1), 6) AS ratio, round(greatest(0, 1 - abs(p_size - 20) / greatest(sqrt(p_size * p_size + 100), sqrt(500.0))), 6) AS euclidean, round(exp(-abs(ln(p_size / 20.0))), 6) AS log FROM part")
def proj_size_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size"), F.lit(10)
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(f(w, h, F.lit(20), h), 6).alias(n) for n, f in G.METRICS.items()])


@query(f"SELECT page, cand FROM ({CANDIDATES}) WHERE w / 20.0 BETWEEN 1.2 AND 2.5")
def filter_width_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.in_width(candidates(spark, sf_dir), S.Params(min_width=1.2, max_width=2.5)).select("page", "cand")


_F = "SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d, l_tax AS t, l_linenumber AS n FROM lineitem"


@query(f"""
SELECT l_orderkey, l_linenumber FROM ({_F}) WHERE abs(d * 5) <= 0.45 AND t * 10 >= 0.35 AND q / 50 >= 0.4
AND CASE WHEN n >= 2 THEN q / 10 >= 1.1 AND t * 12 >= 0.75 AND d * 12 >= 0.75 ELSE q / 10 >= 1.6 AND t * 12 >= 0.5 AND d * 12 >= 0.6 END
""")
def filter_brace_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rule = R.brace(F.col("l_discount") * 5, F.col("l_tax") * 10, F.col("l_quantity") / 50, F.col("l_linenumber"), F.col("l_quantity") / 10, F.col("l_tax") * 12, F.col("l_discount") * 12)
    return li.where(rule).select("l_orderkey", "l_linenumber")


@query(f"""
SELECT l_orderkey, l_linenumber FROM ({_F}) WHERE q / 20 BETWEEN 0.22 AND 2.2 AND d * 2 <= 0.3 AND q / 20 >= 1.7 * d * 2 AND t * 3 <= 0.35 AND d * 4 <= 0.5 AND n * 0.5 <= 2.2 AND t * 2 <= 0.2 AND q / 60 >= 0.6
""")
def filter_dash_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rule = R.dash(F.col("l_quantity") / 20, F.col("l_discount") * 2, F.col("l_tax") * 3, F.col("l_discount") * 4, F.col("l_linenumber") * 0.5, F.col("l_tax") * 2, F.lit(True), F.col("l_quantity") / 60)
    return li.where(rule).select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND user_id % 2 = 0 AND value > 10")
def filter_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click") & (F.col("user_id") % 2 == 0) & (F.col("value") > 10)).select("event_id")


_PARTS = "x0, y0, x1, y1, x1 - x0 AS w, y1 - y0 AS h, (x1 - x0) * (y1 - y0) * (box_id % 10) / 10.0 AS area"


@query(f"""
WITH b AS ({BOXES}), c AS (SELECT box_id, {_PARTS} FROM b)
SELECT box_id, area < greatest(10, 0.05 * 144) OR x0 <= 3 OR y0 <= 3 OR x1 >= 1047 OR y1 >= 713 OR (w > 120 AND h < 14.4) OR h > 358 OR w > 630 AS junk,
       x0 < 100 + 12 AND h > 9 AND h > 2.5 * w AS edge_stroke, (x0 < 2 OR y0 < 2 OR x1 > 1048 OR y1 > 714) AND area * 0.7 * (box_id % 2) >= 0.5 * area AS shadow, area >= 3 * 64 AS solid
FROM c
""")
def filter_component_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as components of a page of 1050 x 716 pixels: what page cleaning would drop or keep, by each rule."""
    b = boxes(spark, sf_dir)
    c = b.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * (F.col("box_id") % 10) / 10.0)
    x0, y0, x1, y1, area = (F.col(n) for n in ("x0", "y0", "x1", "y1", "area"))
    size = F.lit(1050), F.lit(716)
    return c.select(
        "box_id", R.junk(x0, y0, x1, y1, area, F.lit(12), *size).alias("junk"), R.edge_stroke(x0, x1 - x0, y1 - y0, F.lit(100), F.lit(3)).alias("edge_stroke"),
        R.border_shadow(x0, y0, x1, y1, area, area * 0.7 * (F.col("box_id") % 2), *size).alias("shadow"), R.solid(area, F.lit(8)).alias("solid"),
    )


# --- joins ------------------------------------------------------------------------------------------------------------------

_PART = "SELECT p_partkey, p_size::DOUBLE AS w, p_retailprice AS h FROM part"
_ALIKE = "sqrt(pow(ln(a.w / b.w), 2) + pow(ln(a.h / b.h), 2)) <= -ln({s})"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"), F.col("p_retailprice").alias("h"))


@query(f"SELECT a.p_partkey AS p_partkey_a, b.p_partkey AS p_partkey_b FROM ({_PART}) a, (SELECT p_partkey, p_size + 1.0 AS w, p_retailprice * 1.1 AS h FROM part) b WHERE " + _ALIKE.format(s=0.8))
def join_band_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _parts(spark, sf_dir)
    return J.band_join(a, a.withColumns({"w": F.col("w") + 1.0, "h": F.col("h") * 1.1}), 0.8).select("p_partkey_a", "p_partkey_b")


@query(f"SELECT a.p_partkey AS p_partkey_a, b.p_partkey AS p_partkey_b, round(exp(-sqrt(pow(ln(a.w / b.w), 2) + pow(ln(a.h / b.h), 2))), 6) AS similarity FROM ({_PART}) a, ({_PART}) b WHERE a.p_partkey < b.p_partkey AND " + _ALIKE.format(s=0.85))
def join_triangular_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.triangular_band_join(_parts(spark, sf_dir), "p_partkey", 0.85)
    return out.select("p_partkey_a", "p_partkey_b", ST.rounded(F.col("similarity"), 6).alias("similarity"))


@query("WITH p AS (SELECT DISTINCT 'p' || label AS page FROM embeddings) SELECT a.page AS page_a, b.page AS page_b, CASE WHEN a.page = b.page THEN 'within' ELSE 'cross' END AS kind FROM p a, p b WHERE a.page <= b.page")
def join_page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.page_pairs(candidates(spark, sf_dir))


@query("WITH p AS (SELECT DISTINCT 'p' || label AS page FROM embeddings) SELECT page AS page_a, lead(page) OVER (ORDER BY page) AS page_b, 'cross' AS kind FROM p QUALIFY page_b IS NOT NULL")
def join_next_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.page_pairs(candidates(spark, sf_dir), how="next")


#: Words are the first lines of orders, symbols all others.
_SIDES = f"WITH b AS ({BOXES}), w AS (SELECT * FROM b WHERE l_linenumber = 1), s AS (SELECT * FROM b WHERE l_linenumber <> 1)"


@query(_SIDES + """
, hit AS (SELECT w.box_id, s.box_id AS o, 's' || s.box_id AS symbol, s.l_returnflag AS line FROM w JOIN s ON w.page = s.page
  WHERE greatest(0, least(w.x1, s.x1) - greatest(w.x0, s.x0)) * greatest(0, least(w.y1, s.y1) - greatest(w.y0, s.y0)) >= 0.5 * (w.x1 - w.x0) * (w.y1 - w.y0))
SELECT w.box_id, (SELECT string_agg(symbol, '; ' ORDER BY o) FROM hit WHERE hit.box_id = w.box_id) AS symbol, (SELECT string_agg('member', '; ' ORDER BY o) FROM hit WHERE hit.box_id = w.box_id) AS symbol_relation FROM w
""")
def join_spatial_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    s = b.where("l_linenumber <> 1").select("page", "x0", "y0", "x1", "y1", F.concat(F.lit("s"), F.col("box_id").cast("string")).alias("symbol"), F.lit("member").alias("relation"), F.col("l_returnflag").alias("line"), F.col("box_id").alias("ord"))
    w = b.where("l_linenumber = 1").withColumn("word_id", F.col("box_id"))
    return J.spatial_links(w, s, ["page"]).select("box_id", "symbol", "symbol_relation")


@query(f"""
WITH b AS ({BOXES}) SELECT a.page, a.box_id AS box_id_a, c.box_id AS box_id_b FROM b a JOIN b c ON a.page = c.page AND a.l_linenumber = c.l_linenumber AND a.box_id < c.box_id
WHERE greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) >= 0.8 * (greatest(a.x1, c.x1) - least(a.x0, c.x0))
""")
def join_iou_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.span_overlaps(boxes(spark, sf_dir), ["page", "l_linenumber"], "box_id", 0.8).select("page", "box_id_a", "box_id_b")


@query(f"""
WITH b AS ({BOXES}), n AS (SELECT *, box_id % 400 AS cluster FROM b WHERE l_linenumber = 1), o AS (SELECT *, box_id % 50 AS cluster FROM b WHERE l_linenumber <> 1),
hit AS (
  SELECT DISTINCT n.box_id, n.cluster AS new_cluster, o.cluster AS old_cluster FROM n JOIN o ON n.page = o.page,
  LATERAL (SELECT greatest(0, least(n.x1, o.x1) - greatest(n.x0, o.x0)) * greatest(0, least(n.y1, o.y1) - greatest(n.y0, o.y0)) AS i) t
  WHERE i >= 0.1 * ((n.x1 - n.x0) * (n.y1 - n.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - i)
), sh AS (SELECT new_cluster, old_cluster, count(*) / any_value(size)::DOUBLE AS share FROM hit JOIN (SELECT cluster AS new_cluster, count(*) AS size FROM n GROUP BY ALL) USING (new_cluster) GROUP BY new_cluster, old_cluster)
SELECT new_cluster, old_cluster, round(share, 6) AS share FROM sh WHERE share >= 0.02 QUALIFY row_number() OVER (PARTITION BY new_cluster ORDER BY share DESC, old_cluster) = 1
""")
def join_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    new = b.where("l_linenumber = 1").withColumn("cluster", F.col("box_id") % 400).withColumn("item", F.col("box_id"))
    old = b.where("l_linenumber <> 1").withColumn("cluster", F.col("box_id") % 50)
    return J.carried_over(old, new, 0.1, 0.02).withColumn("share", F.round("share", 6))


@query(_SIDES + """
, hit AS (SELECT w.box_id, s.box_id AS ref, greatest(0, least(w.x1, s.x1) - greatest(w.x0, s.x0)) * greatest(0, least(w.y1, s.y1) - greatest(w.y0, s.y0)) / least((w.x1 - w.x0) * (w.y1 - w.y0), (s.x1 - s.x0) * (s.y1 - s.y0))::DOUBLE AS share FROM w JOIN s ON w.page = s.page),
best AS (SELECT * FROM hit WHERE share >= 0.4 QUALIFY row_number() OVER (PARTITION BY box_id ORDER BY share DESC, ref) = 1)
SELECT w.box_id, ref, round(share, 6) AS share FROM w LEFT JOIN best USING (box_id)
""")
def join_best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    refs = b.where("l_linenumber <> 1").withColumnRenamed("box_id", "ref")
    return J.best_overlap(b.where("l_linenumber = 1"), refs, ["page"], "box_id", "ref").select("box_id", "ref", F.round("share", 6).alias("share"))


@query("""
WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS s, l_partkey % 5000 AS x FROM lineitem WHERE l_linenumber = 1),
r AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 5000 AS y FROM lineitem WHERE l_linenumber <> 1)
SELECT DISTINCT id, nearest, abs(nearest - x) AS distance FROM (
  SELECT id, x, arg_min(y, abs(y - x) * 1000000 + y) AS nearest FROM p LEFT JOIN r USING (s) GROUP BY id, x, s)
""")
def join_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    x = (F.col("l_partkey") % 5000).alias("x")
    points = li.where("l_linenumber = 1").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("s"), x)
    refs = li.where("l_linenumber <> 1").select(F.col("l_suppkey").alias("s"), x.alias("y"))
    return J.nearest(points, refs, ["s"], "id", "x", "y").select("id", "nearest", "distance").distinct()


@query("""
WITH s AS (SELECT n_nationkey AS name, n_regionkey AS r, n_nationkey * 40 AS lo, n_nationkey * 40 + 25 AS hi FROM nation),
p AS (SELECT c_custkey, n_regionkey AS r, c_custkey % 1100 AS x FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, name, gap FROM (SELECT c_custkey, s.name, greatest(0, lo - x, x - hi) AS gap, row_number() OVER (PARTITION BY c_custkey ORDER BY greatest(0, lo - x, x - hi), lo, name) AS n FROM p JOIN s USING (r)) WHERE n = 1
""")
def join_containing_or_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    spans = n.select(F.col("n_nationkey").alias("name"), F.col("n_regionkey").alias("r"), (F.col("n_nationkey") * 40).alias("lo"), (F.col("n_nationkey") * 40 + 25).alias("hi"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    points = c.select("c_custkey", F.col("n_regionkey").alias("r"), (F.col("c_custkey") % 1100).alias("x"))
    return J.containing_or_nearest(points, spans, ["r"], "c_custkey", "x").select("c_custkey", "name", "gap")


@query("""
WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS s, (l_partkey * 7) % 9000 AS lo, (l_partkey * 7) % 9000 + 20 + l_linenumber AS hi FROM lineitem WHERE l_linenumber <= 4),
b AS (SELECT DISTINCT l_suppkey AS s, (l_partkey * 11) % 9000 AS s_lo, (l_partkey * 11) % 9000 + 300 AS s_hi FROM lineitem WHERE l_linenumber > 4)
SELECT id, s_lo, CASE WHEN c >= 0.8 THEN 'member' ELSE 'borderline' END AS relation, round(c, 6) AS coverage FROM (
  SELECT id, s_lo, greatest(0, least(hi, s_hi) - greatest(lo, s_lo)) / (hi - lo)::DOUBLE AS c FROM i JOIN b USING (s)) WHERE c >= 0.25
""")
def join_interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    lo = (F.col("l_partkey") * 7) % 9000
    items = li.where("l_linenumber <= 4").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("s"), lo.alias("lo"), (lo + 20 + F.col("l_linenumber")).alias("hi"))
    s = (F.col("l_partkey") * 11) % 9000
    spans = li.where("l_linenumber > 4").select(F.col("l_suppkey").alias("s"), s.alias("s_lo"), (s + 300).alias("s_hi")).distinct()
    return J.contained(items, spans, ["s"], size=500).select("id", "s_lo", "relation", F.round("coverage", 6).alias("coverage"))


@query("""
SELECT conv_id, turn, s AS side, d AS step, other AS neighbour FROM (
  SELECT conv_id, turn, s, d, CASE WHEN s < 0 THEN CASE d WHEN 1 THEN lag(turn, 1) OVER w ELSE lag(turn, 2) OVER w END ELSE CASE d WHEN 1 THEN lead(turn, 1) OVER w ELSE lead(turn, 2) OVER w END END AS other
  FROM (SELECT conv_id, turn FROM conversations), (VALUES (-1), (1)) a(s), (VALUES (1), (2)) b(d) WINDOW w AS (PARTITION BY conv_id, s, d ORDER BY turn)) WHERE other IS NOT NULL
""")
def win_reading_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return J.reading_neighbours(c, 2, ["conv_id"], "turn", ["turn"])


@query("""
WITH s AS (SELECT l_suppkey % 3 AS g, l_partkey % 40 AS tok_a, l_orderkey % 40 AS tok_b, max(l_quantity) AS v FROM lineitem GROUP BY ALL),
n AS (SELECT a.t, b.t AS o, sign(b.t - a.t) AS side FROM range(40) a(t), range(40) b(t) WHERE abs(a.t - b.t) BETWEEN 1 AND 2)
SELECT g, x.t AS tok_a, y.t AS tok_b, max(v) AS support FROM s JOIN n x ON x.o = tok_a JOIN n y ON y.o = tok_b AND x.side = y.side GROUP BY ALL
""")
def join_shifted_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    s = li.groupBy((F.col("l_suppkey") % 3).alias("g"), (F.col("l_partkey") % 40).alias("tok_a"), (F.col("l_orderkey") % 40).alias("tok_b")).agg(F.max("l_quantity").alias("v"))
    toks = spark.range(40).select(F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("g"), F.col("id").alias("tok"))
    n = J.reading_neighbours(toks, 2, ["g"], "tok", ["tok"]).select("g", "tok", "side", "neighbour")
    return J.shifted_neighbours(s, n, n, ["g"], "v")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) OR l_suppkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def join_semi_either_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    groups = table(spark, sf_dir, "part").where("p_size = 7").select("p_partkey")
    return J.touching(li, groups, ["l_partkey"], ["l_suppkey"], ["p_partkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def join_anti_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.without(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


# --- aggregates -------------------------------------------------------------------------------------------------------------

_PAIRS = f"""
WITH c AS ({CANDIDATES}), p AS (
  SELECT a.page AS page_a, b.page AS page_b, a.tok AS tok_a, b.tok AS tok_b, a.cand AS i, b.cand AS j, list_cosine_similarity(a.f, b.f) AS score, a.w >= 30 AND b.w >= 30 AS allowed
  FROM c a JOIN c b ON a.page < b.page)
"""
_BOTH = ["page_a", "page_b"]


def _pairs(spark: SparkSession, sf_dir: str) -> S.Cells:
    """All candidates of every two pages."""
    return S.block_pairs(stored(S.flat(S.blocks(candidates(spark, sf_dir))), "blocks"), within=False)


@query(_PAIRS + """
SELECT page_a, page_b, tok_a, tok_b, round(max(score), 6) AS u, round(max(score) FILTER (allowed), 6) AS t, max(i) FILTER (allowed AND n = 1) AS i, max(j) FILTER (allowed AND n = 1) AS j
FROM (SELECT *, row_number() OVER (PARTITION BY page_a, page_b, tok_a, tok_b, allowed ORDER BY score DESC, i, j) AS n FROM p) GROUP BY ALL
""")
def agg_token_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.token_best(_pairs(spark, sf_dir), 1.5 - 1e-9)
    return out.select(*_BOTH, "tok_a", "tok_b", F.round("u", 6).alias("u"), F.round("t", 6).alias("t"), "i", "j")


@query(_PAIRS + "SELECT page_a, page_b, i, j, round((score - avg(score) OVER g) / (stddev_pop(score) OVER g + 1e-8), 6) AS z FROM p WINDOW g AS (PARTITION BY page_a, page_b)")
def agg_global_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.standard_scores(_pairs(spark, sf_dir)).select(*_BOTH, "i", "j", F.round("z", 6).alias("z"))


@query(_PAIRS + ", t AS (SELECT page_a, page_b, tok_a, tok_b, max(score) AS u FROM p GROUP BY ALL) SELECT page_a, page_b, tok_a, tok_b, round(least((u - avg(u) OVER a) / (stddev_pop(u) OVER a + 1e-8), (u - avg(u) OVER b) / (stddev_pop(u) OVER b + 1e-8)), 6) AS z FROM t WINDOW a AS (PARTITION BY page_a, page_b, tok_a), b AS (PARTITION BY page_a, page_b, tok_b)")
def agg_background_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stored(S.flat(S.blocks(candidates(spark, sf_dir))), "blocks")
    return S.background_scores(b, within=False).select(*_BOTH, "tok_a", "tok_b", F.round("z", 6).alias("z"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity * 0.5 - l_tax * 0.25) / 0.75, 6) AS mix FROM lineitem")
def agg_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = ST.weighted([(F.col("l_quantity"), 0.5), (-F.col("l_tax"), 0.25), (F.col("l_discount"), 0.0)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(mix, 6).alias("mix"))


@query(f"SELECT doc_id, median(length(word))::DOUBLE AS pitch FROM ({WORDS}) GROUP BY doc_id")
def agg_median_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.median_pitch(words(spark, sf_dir).withColumn("n", F.char_length("word")), ["doc_id"], "n")


@query("SELECT l_suppkey, median(step)::DOUBLE AS pitch FROM (SELECT l_suppkey, x - lag(x) OVER (PARTITION BY l_suppkey ORDER BY x) AS step FROM (SELECT l_suppkey, l_orderkey AS x FROM lineitem)) GROUP BY l_suppkey")
def agg_line_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.line_pitch(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey")


@query("SELECT c_nationkey, round(quantile_cont(c_acctbal, 0.05), 6) AS p05, round(quantile_cont(c_acctbal, 0.1), 6) AS p10, round(quantile_cont(c_acctbal, 0.7), 6) AS p70, round(quantile_cont(c_acctbal, 0.99), 6) AS p99 FROM customer GROUP BY c_nationkey")
def agg_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.percentiles(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", [0.05, 0.1, 0.7, 0.99])
    return out.select("c_nationkey", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


_EDGES = """
WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
"""


@query(_EDGES + "SELECT a AS node, min(b) AS component FROM r GROUP BY a")
def agg_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(S.similar(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.4))


@query()
def agg_leader_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("page"), F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("w"), F.col("p_retailprice").alias("h"))
    return R.leader_groups(p, "page", "item", 0.95)


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'xx') AS xx FROM documents GROUP BY source")
def agg_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.status_counts(table(spark, sf_dir, "documents"), ["source"], "lang", ["en", "fr", "xx"])


@query("SELECT l_suppkey, string_agg(f, '; ' ORDER BY o, f) AS flags FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS f, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def agg_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("f"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return A.ordered_distinct(li, ["l_suppkey"], "f", "o", "flags")


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS o FROM events GROUP BY ALL),
t AS (SELECT user_id, sum(n) AS total, count(*) AS readings FROM c GROUP BY user_id)
SELECT user_id, event_type, n, total, readings, n || '/' || total AS votes, CASE WHEN readings = 1 OR n >= 2 THEN event_type END AS auto_name
FROM c JOIN t USING (user_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, o) = 1
""")
def agg_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.majority(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


_UNIT = "WITH u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"


@query(_UNIT + """
, p AS (SELECT label, i, sum(u[i]) AS s FROM u, range(1, 65) r(i) GROUP BY label, i), pr AS (SELECT label AS target, list(s ORDER BY i) AS profile FROM p GROUP BY label), n AS (SELECT label AS target, count(*) AS n FROM u GROUP BY label)
SELECT vec_id, label, target, round(CASE WHEN label = target THEN (list_dot_product(u, profile) - 1) / (n - 1) ELSE list_dot_product(u, profile) / n END, 6) AS mean_cosine FROM u, pr JOIN n USING (target)
""")
def agg_profile_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("w", F.lit(1.0))
    fits = A.fit(e, A.profiles(e, ["label"], "embedding", "w", 64), "embedding", "label")
    return fits.select("vec_id", "label", "target", F.round("mean_cosine", 6).alias("mean_cosine"))


@query(_UNIT + """
, p AS (SELECT label, i, sum(u[i]) AS s FROM u, range(1, 65) r(i) GROUP BY label, i), pr AS (SELECT label AS target, list(s ORDER BY i) AS profile FROM p GROUP BY label), n AS (SELECT label AS target, count(*) AS n FROM u GROUP BY label),
f AS (SELECT vec_id, label, target, (CASE WHEN label = target THEN (list_dot_product(u, profile) - 1) / (n - 1) ELSE list_dot_product(u, profile) / n END) / 0.02 AS z FROM u, pr JOIN n USING (target)),
b AS (SELECT vec_id, label, max(z) FILTER (label = target) AS own, max(z) FILTER (label <> target) AS other FROM f GROUP BY ALL)
SELECT vec_id, CASE WHEN other >= 1.5 AND other > own + 0.5 THEN 'move' WHEN own < 1.5 THEN 'remove' ELSE 'keep' END AS verdict FROM b
""")
def agg_fit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("w", F.lit(1.0))
    fits = A.fit(e, A.profiles(e, ["label"], "embedding", "w", 64), "embedding", "label")
    return A.verdicts(fits, "vec_id", 0.0, 0.02, own="label").select("vec_id", "verdict")


@query(_UNIT + "SELECT round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS deviation FROM (SELECT list_dot_product(a.u, b.u) AS d FROM u a JOIN u b ON a.vec_id <> b.vec_id)")
def agg_background_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.background(table(spark, sf_dir, "embeddings"), "embedding", 64)
    return out.select(F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("SELECT event_type, round(avg(value), 6) AS average, min(value) AS fastest, max(value) AS slowest, count(value) AS timed FROM events GROUP BY event_type")
def agg_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("string"))
    return A.durations(e, ["event_type"], "value").withColumn("average", F.round("average", 6))


@query("""
WITH v AS (SELECT l_suppkey % 10 AS g, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY ALL),
w AS (SELECT g, v, lead(v) OVER o AS nx, sum(n) OVER o AS n0, sum(n) OVER p AS n1, sum(ln(v) * n) OVER o AS l0, sum(ln(v) * n) OVER p AS l1, sum(v * n) OVER o AS v0, sum(v * n) OVER p AS v1
  FROM v WINDOW o AS (PARTITION BY g ORDER BY v), p AS (PARTITION BY g)),
b AS (SELECT *, n0::DOUBLE * (n1 - n0) * pow(l0 / n0 - (l1 - l0) / (n1 - n0), 2) AS between FROM w WHERE nx IS NOT NULL)
SELECT g, round(CASE WHEN (v1 - v0) / (n1 - n0) >= 1.8 * v0 / n0 AND n1 >= 15 THEN exp((ln(v) + ln(nx)) / 2) END, 6) AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(between, 9) DESC, v) = 1
""")
def agg_two_class_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("g"), F.col("l_quantity").alias("v"))
    return ST.two_class_split(li, "v", ["g"]).withColumn("threshold", F.round("threshold", 6))


@query(f"WITH b AS ({BOXES}) SELECT page, l_returnflag, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY ALL")
def agg_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.envelope(boxes(spark, sf_dir), ["page", "l_returnflag"])


@query("""
WITH m AS (SELECT c_nationkey, median(c_acctbal) AS mid FROM customer GROUP BY ALL), d AS (SELECT c_nationkey, median(abs(c_acctbal - mid)) AS mad FROM customer JOIN m USING (c_nationkey) GROUP BY ALL)
SELECT c_custkey, round((c_acctbal - mid) / (1.4826 * mad + 1e-8), 6) AS z FROM customer JOIN m USING (c_nationkey) JOIN d USING (c_nationkey)
""")
def agg_robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ST.robust_z(table(spark, sf_dir, "customer"), "c_acctbal", "z", ["c_nationkey"])
    return out.select("c_custkey", F.round("z", 6).alias("z"))


@query("""
WITH p AS (SELECT c_nationkey, quantile_cont(c_acctbal, 0.05) AS a, quantile_cont(c_acctbal, 0.95) AS b FROM customer GROUP BY ALL)
SELECT c_custkey, round(least(1, greatest(0, (c_acctbal - a) / (b - a))), 6) AS v FROM customer JOIN p USING (c_nationkey)
""")
def agg_stretched(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ST.stretched(table(spark, sf_dir, "customer"), "c_acctbal", "v", ["c_nationkey"])
    return out.select("c_custkey", F.round("v", 6).alias("v"))


# --- windows ----------------------------------------------------------------------------------------------------------------

_SCORES = "WITH s AS (SELECT l_suppkey % 5 AS g, l_partkey % 60 AS a, l_orderkey % 60 AS b, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 5).alias("g"), (F.col("l_partkey") % 60).alias("a"), (F.col("l_orderkey") % 60).alias("b")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))


@query(_SCORES.replace("sum(l_extendedprice)", "round(sum(l_extendedprice), 2)") + "SELECT g, a, b, ra AS rank_a, rb AS rank_b FROM (SELECT *, row_number() OVER (PARTITION BY g, a ORDER BY v DESC, b) AS ra, row_number() OVER (PARTITION BY g, b ORDER BY v DESC, a) AS rb FROM s) WHERE ra <= 3 AND rb <= 3")
def win_reciprocal_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.reciprocal_top_k(_scores(spark, sf_dir), ["g"], "a", "b", "v", 3).select("g", "a", "b", "rank_a", "rank_b")


@query(_SCORES.replace("sum(l_extendedprice)", "round(sum(l_extendedprice), 2)") + "SELECT g, a, b FROM (SELECT *, row_number() OVER (PARTITION BY g, a ORDER BY v DESC, b) AS ra, row_number() OVER (PARTITION BY g, b ORDER BY v DESC, a) AS rb, max(v) OVER (PARTITION BY g, a) AS ma, max(v) OVER (PARTITION BY g, b) AS mb FROM s) WHERE ra <= 9 AND rb <= 9 AND v >= ma - 20000 AND v >= mb - 20000")
def win_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.reciprocal_top_k(_scores(spark, sf_dir), ["g"], "a", "b", "v", 9, 20000.0).select("g", "a", "b")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) AS number FROM lineitem")
def win_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    return W.numbered(li, ["l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "number")


_RUNS = """
WITH f AS (SELECT DISTINCT l_suppkey AS g, l_partkey % 3000 AS x FROM lineitem), i AS (SELECT g, x, x - row_number() OVER (PARTITION BY g ORDER BY x) AS k FROM f),
r AS (SELECT g, min(x) AS start, max(x) + 1 AS "end" FROM i GROUP BY g, k)
"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_partkey") % 3000).alias("x")).distinct()
    return W.true_runs(li.withColumn("ink", F.lit(True)), ["g"], "x", "ink")


@query(_RUNS + 'SELECT g, start, "end" FROM r')
def win_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


_MERGED = """
, lim AS (SELECT g, greatest(1.8 * median(gap), 0.006 * 3000) AS lim FROM (SELECT g, start - lag("end") OVER (PARTITION BY g ORDER BY start) AS gap FROM r) GROUP BY g),
p AS (SELECT r.*, sum(CASE WHEN gap >= lim THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY start) AS part FROM (SELECT *, start - lag("end") OVER (PARTITION BY g ORDER BY start) AS gap FROM r) r JOIN lim USING (g))
"""


@query(_RUNS + _MERGED + 'SELECT g, min(start) AS start, max("end") AS "end" FROM p GROUP BY g, part HAVING max("end") - min(start) >= 0.006 * 3000')
def win_token_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.tokens_of_runs(_runs(spark, sf_dir).withColumn("w", F.lit(3000.0)), ["g"], "w")


_DAILY = "WITH d AS (SELECT event_type AS k, CAST(epoch(date_trunc('hour', ts)) / 3600 AS BIGINT) AS x, sum(value) AS v FROM events GROUP BY ALL)"


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hour = F.expr("cast(floor(unix_micros(cast(date_trunc('HOUR', ts) as timestamp)) / 3600000000) as bigint)")
    return e.groupBy(F.col("event_type").alias("k"), hour.alias("x")).agg(F.sum("value").alias("v"))


@query(_DAILY + "SELECT k, x, round(avg(v) OVER (PARTITION BY k ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS moving FROM d")
def win_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.moving(_hourly(spark, sf_dir), ["k"], "x", "v", 3).select("k", "x", F.round("moving", 6).alias("moving"))


@query(_DAILY + "SELECT k, x, round(max(v) OVER (PARTITION BY k ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS moving FROM d")
def win_moving_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.moving(_hourly(spark, sf_dir), ["k"], "x", "v", 2, "max").select("k", "x", F.round("moving", 6).alias("moving"))


@query(_DAILY + "SELECT k, x, round(median(v) OVER (PARTITION BY k ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS moving FROM d")
def win_moving_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.moving(_hourly(spark, sf_dir), ["k"], "x", "v", 2, "median").select("k", "x", F.round("moving", 6).alias("moving"))


@query(_DAILY + "SELECT k, x FROM d QUALIFY v > lag(v) OVER (PARTITION BY k ORDER BY x) AND v >= lead(v) OVER (PARTITION BY k ORDER BY x) AND v >= 50")
def win_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.peaks(_hourly(spark, sf_dir), ["k"], "x", "v", 50.0).select("k", "x")


@query(_DAILY + "SELECT k, x FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY v, x) = 1")
def win_valley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.valley(_hourly(spark, sf_dir), ["k"], "x", "v").select("k", "x")


# --- sets, sorts, scalars ---------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT page FROM (SELECT 'p' || label AS page FROM embeddings UNION SELECT 'p' || (doc_id % 13) FROM documents)")
def set_page_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda c: F.concat(F.lit("p"), c.cast("string")).alias("page")
    return table(spark, sf_dir, "embeddings").select(p(F.col("label"))).union(table(spark, sf_dir, "documents").select(p(F.col("doc_id") % 13))).distinct()


@query("SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.05")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_quantity > 40").select("l_partkey", "l_suppkey").subtract(li.where("l_discount > 0.05").select("l_partkey", "l_suppkey"))


@query("SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_suppkey")
    return a.intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey"))


@query(_PAIRS + "SELECT page_a, page_b, i, j, round(score, 6) AS score FROM p ORDER BY p.score DESC, i, j LIMIT 15")
def sort_top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stored(S.blocks(candidates(spark, sf_dir, scaled=False)), "blocks")
    return S.top_pairs(S.block_pairs(b, within=False), 15).select(*_BOTH, "i", "j", F.round("score", 6).alias("score"))


@query(f"WITH c AS ({CANDIDATES}), q AS (SELECT * FROM c WHERE cand = 17) SELECT c.cand, round(list_cosine_similarity(c.f, q.f), 6) AS score FROM c, q WHERE c.cand <> 17 AND sqrt(pow(ln(c.w / q.w), 2) + pow(ln(c.h / q.h), 2)) <= -ln(0.85) ORDER BY list_cosine_similarity(c.f, q.f) DESC, c.cand LIMIT 5")
def sort_query_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    q = F.broadcast(c.where("cand = 17").select(F.col("w").alias("qw"), F.col("h").alias("qh"), F.col("feat").alias("qf")))  # one row
    near = G.log_size_similarity(F.col("w"), F.col("h"), F.col("qw"), F.col("qh")) >= 0.85
    rows = c.where("cand <> 17").join(q, how="cross").where(near).withColumn("score", V.dot(F.col("feat"), F.col("qf")))
    return rows.orderBy(F.desc("score"), "cand").limit(5).select("cand", F.round("score", 6).alias("score"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey % 1000, p_partkey) AS place FROM part")
def sort_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Symbol "), (F.col("p_partkey") % 1000).cast("string")).alias("label"))
    return W.placed(p, [TX.natural_key(F.col("label")), F.col("p_partkey")]).select("p_partkey", "place")


@query("SELECT l_orderkey, l_linenumber, (l_suppkey % 4 + 1)::INT AS col, l_linenumber AS line, (l_partkey % 30)::INT AS token FROM lineitem")
def str_token_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    tid = F.concat(TX.token_id(F.col("l_suppkey") % 4 + 1, F.col("l_linenumber"), F.col("l_partkey") % 30), F.lit("[0:30]"))
    return li.select("l_orderkey", "l_linenumber", *[c.alias(n) for c, n in zip(TX.token_numbers(tid), ("col", "line", "token"), strict=True)])


@query("SELECT p_partkey, upper(p_name[1:1]) || lower(p_name[2:]) AS name FROM part")
def str_capitalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", TX.capitalised(F.col("p_name")).alias("name"))


@query("""
WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list('page' || l_suppkey))) AS stems FROM lineitem GROUP BY l_orderkey), j AS (SELECT *, array_to_string(stems, '+') AS joined FROM s)
SELECT l_orderkey, CASE WHEN len(stems) = 1 OR length(joined) <= 60 THEN joined ELSE stems[1] || '+' || (len(stems) - 1) || 'more_' || substr(md5(joined), 1, 6) END AS name FROM j
""")
def str_page_set_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("page"), F.col("l_suppkey").cast("string"))).alias("stems"))
    return rows.select("l_orderkey", TX.page_set_name(F.col("stems")).alias("name"))


@query("SELECT p_partkey, p_brand AS reply FROM part")
def str_cleaned_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("```text\nWord: \""), F.col("p_brand"), F.lit('".\nsecond line```'))
    return table(spark, sf_dir, "part").select("p_partkey", TX.cleaned_reply(raw).alias("reply"))


@query()
def str_near_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.operators.annotations import near_spellings

    names = table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct()
    first = names.orderBy("name").first()["name"]
    return near_spellings(names, first[:-1], 5)


@query("""
SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[32]::DOUBLE * 0.5 + embedding[33]::DOUBLE * 0.5, 6) AS mid, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings
""")
def arr_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.resampled(F.col("embedding"), 3).alias("r"))
    return e.select("vec_id", F.round(F.col("r")[0].cast("double"), 6).alias("first"), F.round(F.col("r")[1], 6).alias("mid"), F.round(F.col("r")[2].cast("double"), 6).alias("last"))
