"""Readers, writers, the graph and streams on small files."""

import pytest
from pyspark.sql import functions as F

from pagemill import schema
from pagemill.functions import geometry as G
from pagemill.functions import text as TX
from pagemill.operators import graph as GR
from pagemill.sources import readers as RD
from pagemill.sources import writers as WR
from pagemill.streaming import ingest as IN


def test_tolerant_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿ Concept ;NAME;x0\nHorse;equus;1\n", encoding="utf-8")
    df = RD.tolerant_csv(spark, str(p), ["concept", "name"])
    assert df.columns == ["concept", "name", "x0"] and df.first()["concept"] == "Horse"
    with pytest.raises(RD.InputError, match="page"):
        RD.tolerant_csv(spark, str(p), ["page"])


def test_typed_and_exact_csv(spark, tmp_path):
    p = tmp_path / "o.csv"
    p.write_text("occ_id,page,x0,removed\n1,NA,,0\n")
    r = RD.typed_csv(spark, str(p), schema.OCCURRENCES).first()
    assert (r["occ_id"], r["page"], r["x0"], r["removed"], r["token"]) == (1, "NA", None, 0, None)
    assert RD.typed_csv(spark, str(tmp_path / "none.csv"), schema.OCCURRENCES).count() == 0
    assert RD.exact_csv(spark, str(p)).first()["x0"] == ""
    df, dropped, missing = RD.projected(spark.createDataFrame([(1, 2, 3)], "removed int, occ_id int, other int"), "occurrences")
    assert df.columns == ["occ_id", "removed"] and dropped == ["other"] and "page" in missing
    assert RD.page_column(["x", "document"]) == "document" and RD.page_column(["x"]) is None


def test_images(spark, tmp_path):
    for name in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.png").write_bytes(b"x")
    files = RD.images(spark, str(tmp_path), content=False)
    assert sorted(r["page"] for r in RD.checked_images(files).collect()) == ["a", "b"]
    (tmp_path / "a.tif").write_bytes(b"x")
    with pytest.raises(RD.InputError, match="share"):
        RD.checked_images(RD.images(spark, str(tmp_path)))
    with pytest.raises(RD.InputError, match="no images"):
        RD.checked_images(files.limit(0))


def test_concepts(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# list\nHorse\n\n sheep \n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("id,concept,note\n1,Cow,big\n2,HORSE,\n", encoding="utf-8")
    a, b = RD.concept_dictionary(spark, str(tmp_path / "c.txt")), RD.concept_dictionary(spark, str(tmp_path / "c.csv"))
    assert sorted(r["name"] for r in a.collect()) == ["Horse", "sheep"]
    assert [r["name"] for r in RD.new_concepts(b, a).collect()] == ["Cow"]


def test_page_xml_round_trip(spark, tmp_path):
    xml = '<PcGts><Page><TextLine id="x"><Coords points="0,0 5,0 5,5"/><Baseline points="0,4 5,4"/></TextLine><TextLine><Coords points="1,1"/><Baseline points="2,2"/></TextLine><TextLine id="z"><Coords points="1,1"/></TextLine></Page></PcGts>'
    (tmp_path / "p.xml").write_text(xml)
    rows = RD.page_xml(spark, str(tmp_path / "p.xml"))
    assert sorted(r["id"] for r in rows.collect()) == ["l002", "x"]
    WR.write_page_xml(rows.coalesce(1), str(tmp_path / "out"))
    again = RD.page_xml(spark, str(tmp_path / "out"))
    assert sorted((r["id"], len(r["polygon"])) for r in again.collect()) == [("l002", 1), ("x", 3)]
    assert WR.region_document(rows.withColumn("page", F.lit("p"))).count() == 1


def test_edge_document_and_index(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"a|b": 2.5, "b|a": 3.0}')
    assert sorted(tuple(r) for r in RD.edge_document(spark, str(tmp_path / "e.json")).collect()) == [("a", "b", 3.0), ("b", "a", 3.0)]
    (tmp_path / "pages.csv").write_text('page,source_file,side,to_original\np,f.jpg,L,"[[1,0,5],[0,1,6],[0,0,1]]"\n')
    df = RD.page_index(spark, str(tmp_path / "pages.csv")).withColumns({c: F.lit(i) for i, c in enumerate(("x0", "y0", "x1", "y1"))})
    mapped = G.mapped_box([F.col("matrix")[i] for i in range(9)], G.box())
    assert tuple(df.select(*mapped).first()) == (5, 7, 7, 9)


def test_symbols(spark, tmp_path):
    doc = '{"source_file":"p1.jpg","image_size":[9,8],"sheet_offset":[10,20],"columns":[[0,50]],"line_spacing_px":40.0,"stroke_width_px":3.0,"run_date":"d","settings":"{}","marks":[{"kind":"dash","bbox":[1,2,3,4],"attributes":"{}"}],"braces":[{"bbox":[5,5,2,9],"column":0,"lines":[{"relation":"member","line":1,"bbox":[0,5,4,4],"coverage":0.9}]}]}'
    (tmp_path / "result.json").write_text(doc)
    rows = RD.symbol_rows(spark, str(tmp_path / "result.json"))
    assert rows.columns == schema.SYMBOLS.names
    got = {(r["symbol"], r["relation"]): r for r in rows.collect()}
    assert got["dash1", "symbol"]["ox0"] == 11 and got["brace1", "member"]["column_x1"] == 50 and got["brace1", "symbol"]["y1"] == 14


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "page string, v int")
    rows.write.partitionBy("page").parquet(path)
    WR.replace_pages(spark.createDataFrame([("a", 9)], "page string, v int"), path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [3, 9]
    assert [r["v"] for r in WR.drop_pages(rows, rows.where("v = 3").select("page")).collect()] == [1, 2]
    order = spark.createDataFrame([("b", 0), ("a", 1)], "page string, ord int")
    assert [r["v"] for r in WR.merged_in_order(rows.withColumnsRenamed({}), order, keys=("v",)).collect()] == [3, 1, 2]
    WR.write_csv(rows, str(tmp_path / "c"), one_file=True)
    assert RD.exact_csv(spark, str(tmp_path / "c")).count() == 3
    WR.rewritten(spark.read.parquet(path).where("v = 9"), path)
    assert spark.read.parquet(path).count() == 1


def test_rewrite_cut_off(spark, tmp_path):
    """A crash between the two exchanges of names leaves the old table aside; it is put back."""
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert spark.read.parquet(WR.recovered(spark, path)).count() == 3
    spark.range(9).write.parquet(path + ".old")  # the new table is there, the old one not yet deleted
    WR.rewritten(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_decoded_images(spark, tmp_path):
    """Photographs come out as their orientation says, other images as they are, and what is no image keeps its row."""
    import numpy as np

    from pagemill.kernels import image as I

    im = np.full((20, 40), 255.0)
    im[:5, :5] = 0
    (tmp_path / "plain.png").write_bytes(I.png(im))
    (tmp_path / "bad.png").write_bytes(b"no image")
    jvm = spark.sparkContext._jvm
    raw = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(tmp_path / "plain.png"))), "jpg", raw)
    jpeg = bytes(raw.toByteArray())
    tiff = b"II" + (42).to_bytes(2, "little") + (8).to_bytes(4, "little") + (1).to_bytes(2, "little") + bytes([0x12, 1, 3, 0, 1, 0, 0, 0, 6, 0, 0, 0])
    body = b"Exif\0\0" + tiff
    (tmp_path / "turned.jpg").write_bytes(jpeg[:2] + b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + jpeg[2:])
    got = {r.page: r for r in RD.decoded(spark, str(tmp_path)).collect()}
    assert {p: (r.height, r.width) for p, r in got.items()} == {"plain": (20, 40), "turned": (40, 20), "bad": (-1, -1)}
    seen = np.frombuffer(got["turned"].data, dtype=np.uint8).reshape(40, 20, -1)
    assert seen[1, 18, 0] < 60 and seen[1, 1, 0] > 200  # the dark corner is on the upper right now


def test_graph(spark):
    notes = spark.createDataFrame([("c", "eQuus", "p1", 0, 0, 1, 1), ("c", "EQUUS", "p2", 0, 0, 1, 1), ("c", "Name", "p1", 5, 5, 6, 6)], "concept string, name string, page string, x0 int, y0 int, x1 int, y1 int")
    symbols = spark.createDataFrame([("p1", "s1", "brace", "symbol", 0, 0, 2, 2), ("p1", "s1", "brace", "member", 3, 3, 4, 4), ("p1", "s9", "brace", "note", 3, 3, 4, 4)], "page string, symbol string, kind string, relation string, x0 int, y0 int, x1 int, y1 int")
    images = spark.createDataFrame([("p1", "old", 1), ("p1", "new", 2), ("p2", "two", 3)], "page string, path string, ord int")
    g = GR.built(notes, symbols, images)
    assert g["orphans"].count() == 1
    assert sorted((r["page"], r["path"]) for r in GR.trace(g, GR.found(g, "equus")).collect()) == [("p1", "new"), ("p2", "two")]
    assert {(r["name"], r["relation"]) for r in GR.on_image(g, "p1").collect()} == {("Equus", None), ("Name", None), ("Brace", "symbol"), ("Brace", "member")}
    nodes, edges = GR.as_sets(g)
    assert nodes.count() > 0
    assert sorted(r["value"] for r in GR.attribute(edges, "name").collect()) == ["Brace", "Equus", "Name"]


def test_text(spark):
    df = spark.createDataFrame([("c1_l02_t3[0:5]", "eLEPHANT", "Item 9", "Item 10")], "t string, n string, a string, b string")
    r = df.select(*TX.token_numbers(F.col("t")), TX.parent(F.col("t")), TX.capitalised(F.col("n")), TX.natural_key(F.col("a")) < TX.natural_key(F.col("b"))).first()
    assert tuple(r) == (1, 2, 3, "c1_l02_t3", "Elephant", True)


def test_geometry(spark):
    df = spark.createDataFrame([(0, 0, 10, 10, 5, 0, 15, 10)], "ax0 int, ay0 int, ax1 int, ay1 int, bx0 int, by0 int, bx1 int, by1 int")
    r = df.select(G.iou(G.box("a"), G.box("b")), G.overlap_share(G.box("a"), G.box("b")), G.log_size_similarity(F.lit(100), F.lit(20), F.lit(95), F.lit(20)), G.coverage(F.lit(0), F.lit(0), F.lit(0), F.lit(5))).first()
    assert tuple(round(x, 9) for x in r) == (round(1 / 3, 9), 0.5, 0.95, 0.0)


def test_streams(spark, tmp_path):
    src, out, mark = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "mark")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "page string, v int")
    rows.coalesce(1).write.parquet(src)
    work = lambda df: df.groupBy("page").agg(F.sum("v").alias("v"))
    IN.work_pages(IN.arriving_rows(spark, src, rows.schema), work, out, mark)
    spark.createDataFrame([("a", 7)], rows.schema).coalesce(1).write.mode("append").parquet(src)
    IN.work_pages(IN.arriving_rows(spark, src, rows.schema), work, out, mark)
    assert sorted((r["page"], r["v"]) for r in spark.read.parquet(out).collect()) == [("a", 7), ("b", 2)]
    assert IN.upsert(rows, rows.where("v = 2").withColumn("v", F.lit(5)), ["page"]).agg(F.sum("v")).first()[0] == 6
