"""Marks and polygons on drawn shapes, and the decision rules at their limits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.kernels import marks as M
from pagemill.kernels import polygons as L
from pagemill.operators import rules as R
from pagemill.plans import pages as P
from pagemill.plans import plugins


def test_rules_at_limits(spark):
    df = spark.createDataFrame([(0.45, 0.35, 0.4, 2, 1.1, 0.75, 0.75), (0.46, 0.35, 0.4, 2, 1.1, 0.75, 0.75), (0.0, 0.5, 0.5, 1, 1.59, 0.9, 0.9), (0.0, 0.5, 0.5, 1, 1.6, 0.5, 0.6)], "a double, b double, c double, d int, e double, f double, g double")
    assert [r[0] for r in df.select(R.brace(*[F.col(x) for x in "abcdefg"])).collect()] == [True, False, False, True]
    one = spark.range(1)
    lit = lambda *v: [F.lit(x) for x in v]
    got = one.select(
        R.dash(*lit(1.0, 0.3, 0.0, 0.1, 2.0, 0.0, True, 0.9)), R.circle(*lit(0.5, 1.0, 0.0, 0.9, 0.1, 0.9, 0.0, 0.6)), R.filler(*lit(0.4, 1.0, 10.0, True, 0.1, True)),
        R.slash(*lit(45.0, 0.3, 1.0, 0.7, 0.7, 0.5)), R.slash_sign(*lit(1.0, 40.0, 60.0)), R.slash_role(*lit(True, 1.0, True, False)), R.rule_line(*lit(5.0, 5.5, 3.0)),
        R.specks(*lit(19, 100)), R.pencil(*lit(10.0, 50.0, 20.0)),
    ).first()
    assert tuple(got) == (True, True, True, True, True, "closing", True, True, True)


def test_brace_lines(spark):
    lines = spark.createDataFrame([("p", 1, 0, 10, 50, 20), ("p", 2, 0, 95, 50, 115), ("p", 3, 300, 20, 350, 30), ("p", 4, 130, 48, 200, 58)], "page string, line int, x0 int, y0 int, x1 int, y1 int")
    braces = spark.createDataFrame([("p", 5, 100, 100, 40.0)], "page string, b_y0 int, b_y1 int, b_x0 int, spacing double")
    assert sorted((r.line, r.relation) for r in R.brace_lines(lines, braces, ["page"]).collect()) == [(1, "member"), (2, "borderline")]
    cusps = spark.createDataFrame([("p", 52, 110, 40.0, "b1")], "page string, c_y int, c_x int, spacing double, brace string")
    assert [r.line for r in R.note_lines(lines, cusps, ["page"]).orderBy("line").collect()] == [3, 4]


def page():
    im = np.full((600, 600), 235.0)
    for y in range(60, 560, 50):
        for x in range(40, 300, 9):
            im[y : y + 16, x : x + 3] = 20
    im[300:304, 360:400] = 20
    return im


def test_measures():
    ink = page() < 100
    parts = {(c["x0"], c["y0"]): c for c in M.measured(page(), ink, 50.0, 3.0)}
    dash = parts[360, 300]
    assert dash["width"] == pytest.approx(0.8) and abs(dash["slope"]) < 1e-9 and dash["clear"] and dash["last"] and dash["dark"] > 0.9
    ring = np.zeros((40, 40), dtype=bool)
    y, x = np.mgrid[:40, :40]
    ring[(np.hypot(x - 20, y - 20) > 9) & (np.hypot(x - 20, y - 20) < 12)] = True
    c = M.measured(np.where(ring, 20.0, 235.0), ring, 40.0, 3.0)[0]
    assert c["axes"] > 0.95 and c["covered"] == 1 and c["centre"] == 0 and M.loops(ring) and not M.loops(ring[:, :15])


def test_strokes():
    im = np.zeros((120, 120), dtype=bool)
    for i in range(60):
        im[90 - i, 20 + i : 23 + i] = True
    s = M.strokes(im, 40.0, 3.0)[0]
    assert 40 < s["angle"] < 50 and s["rms"] < 0.65 and s["length"] > 1.6 and s["iso_left"] == 1


def test_page_marks(spark):
    images = spark.createDataFrame([("p", 600, 600, 1, bytearray(page().astype(np.uint8).tobytes()))], "page string, height int, width int, channels int, data binary")
    rows = P.marks(images).collect()
    assert ("dash", 360) in {(r.kind, r.x0) for r in rows} and all(r.error is None for r in rows)
    assert P.polygons(images).where("error is null").count() >= 9


def test_polygons():
    line = np.array([(0, 0), (5, 0.5), (10, 0), (20, 9)])
    assert L.simplified(line, 1.0).tolist() == [[0, 0], [10, 0], [20, 9]]
    square = np.array([(0, 0), (10, 0), (10, 10), (0, 10)])
    assert L.inside(square, np.array([5, 15]), np.array([5, 5])).tolist() == [True, False]
    assert L.nearest_polygon([square, square + 30], 12, 5) == 0 and L.nearest_polygon([square], 30, 30) is None
    ink = page() < 100
    found = L.line_polygons(ink, [(50, 90), (100, 140)])
    assert [f["id"] for f in found] == ["l001", "l002"]
    assert found[0]["baseline"][0][1] == pytest.approx(75, abs=1.5)
    assert L.bracket_members([(10, 0, 10), (90, 0, 10)], {"x0": 100, "y0": 0, "y1": 50}, 0) == [0]


def test_words_of_a_line():
    ink = np.zeros((30, 700), dtype=bool)
    x = 5
    for word in range(8):
        for _ in range(4):
            ink[5:25, x : x + 8] = True
            x += 10
        x += 18
    spans = L.line_words(ink, np.array([(0, 0), (699, 0), (699, 29), (0, 29)]), 20.0)
    assert len(spans) == 8


def test_plugins(spark):
    assert plugins.spotter().Params
    with pytest.raises(ValueError, match="no spotter"):
        plugins.spotter("nothing.there")
    with pytest.raises(ValueError, match="lacks"):
        plugins.spotter("json")
    words = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"b"))], "occ_id int, crop binary")
    assert sorted(r.reading for r in plugins.readings(words, lambda crops: [bytes(c).decode().upper() for c in crops]).collect()) == ["A", "B"]


def test_traced_braces():
    """A long bent stroke that touches a word is traced through the word's ink; letters are too short."""
    ink = np.zeros((400, 300), dtype=bool)
    for y in range(60, 340, 40):
        for x in range(20, 140, 9):
            ink[y : y + 14, x : x + 3] = True
    for i in range(140):
        x = 160 + round(9 * np.sin(np.pi * i / 140))
        ink[100 + i, x : x + 3] = True
    ink[220:224, 128:172] = True  # a word's last stroke runs into it
    found = [b for b in M.braces(ink, 40.0, 3.0) if b["traced"]]
    assert len(found) == 1
    b = found[0]
    assert abs(b["y0"] - 100) <= 2 and abs(b["y1"] - 240) <= 2 and b["arms"] == 1 and b["height"] > 3 and b["left_text"] > 0.3
    assert b["resid"] > 0.35 and b["iso_right"] > 0.9


def test_exif_and_turns():
    from pagemill.kernels import sheets as SH

    im = np.arange(6).reshape(2, 3)
    # what a viewer does for each orientation, by where the first row and column go
    want = {1: im, 2: im[:, ::-1], 3: im[::-1, ::-1], 4: im[::-1], 5: im.T, 6: im.T[:, ::-1], 7: im.T[::-1, ::-1], 8: im.T[::-1]}
    for turn, seen in want.items():
        assert (SH.upright(im, turn) == seen).all(), turn
    for mark, order in ((b"II", "little"), (b"MM", "big")):
        n = lambda v, size: v.to_bytes(size, order)  # noqa: B023, E731
        tiff = mark + n(42, 2) + n(8, 4) + n(2, 2) + n(0x0100, 2) + n(3, 2) + n(1, 4) + n(9, 2) + n(0, 2) + n(0x0112, 2) + n(3, 2) + n(1, 4) + n(6, 2) + n(0, 2)
        body = b"Exif\0\0" + tiff
        jpeg = b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xda"
        assert SH.orientation(jpeg) == 6
        assert SH.orientation(jpeg[:30]) == 1
    assert SH.orientation(b"") == SH.orientation(b"\x89PNG") == 1


def test_sheet_straight_and_evenly_lit():
    from pagemill.kernels import image as I
    from pagemill.kernels import sheets as SH

    quad = np.array([(60, 40), (340, 60), (330, 280), (50, 260)], dtype=float)
    y, x = np.mgrid[:320, :400]
    inside = L.inside(quad, x, y)
    photo = np.where(inside, 150 + 0.2 * x, 20.0)
    found = SH.corners(I.sheet_mask(photo))
    assert np.abs(found - quad).max() <= 3
    sheet, matrix = SH.straightened(photo, found)
    assert abs(sheet.shape[1] - 281) <= 4 and abs(sheet.shape[0] - 220) <= 4 and (sheet > 100).mean() > 0.995
    u = matrix @ [0, 0, 1]
    assert np.abs(u[:2] / u[2] - quad[0]).max() < 5
    sheet[100:104, 50:200] *= 0.3
    even = SH.evened(sheet)
    assert np.median(even) == 255 and (even[101, 60:190] < 60).all() and (even[20:80, 20:260] > 235).all()
    assert SH.corners(np.zeros((4, 6), dtype=bool)).tolist() == [[0, 0], [5, 0], [5, 3], [0, 3]]


def test_colours_overlays_and_readings(spark, tmp_path):
    """Circles in pencil and ink are told apart by saturation; boxes are drawn; readings go on where they ended."""
    import zlib

    im = np.full((300, 300, 3), 230, dtype=np.uint8)
    y, x = np.mgrid[:300, :300]
    for y0 in range(20, 280, 40):
        for x0 in range(20, 120, 8):
            im[y0 : y0 + 12, x0 : x0 + 3] = (120, 30, 20)  # blue ink
    for cx, cy, c in ((200, 110, (120, 30, 20)), (240, 190, (90, 90, 90))):
        ring = np.hypot(x - cx, y - cy)
        im[(ring > 6) & (ring < 9)] = c
    images = spark.createDataFrame([("p", 300, 300, 3, im.tobytes()), ("bad", 10, 10, 3, b"x")], "page string, height int, width int, channels int, data binary")
    rows = P.marks(images).collect()
    assert [r.page for r in rows if r.error] == ["bad"]
    assert {(r.x0 < 220): r.medium for r in rows if r.kind == "circle"} == {True: "ink", False: "pencil"}
    fine = images.where("page = 'p'")
    boxes = spark.createDataFrame([("p", 1, 10, 10, 40, 30)], "page string, id int, x0 int, y0 int, x1 int, y1 int")
    png = bytes(P.overlays(fine, boxes).first().png)
    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    raw = np.frombuffer(zlib.decompress(png[41 : 41 + int.from_bytes(png[33:37], "big")]), dtype=np.uint8).reshape(300, 301)[:, 1:]
    assert (raw[10:12, 10:40] == 0).all() and (raw[13:27, 13:37] > 0).all()
    assert P.crops(fine, boxes, "id").first().id == "1"
    assert P.straightened(images).where("error is null").first().channels == 1
    words = spark.createDataFrame([(i, bytes([i])) for i in range(20)], "occ_id long, crop binary")
    seen = []
    out = plugins.read_all(words, lambda crops: [str(c[0]) for c in crops], str(tmp_path / "r"), lambda a, b: seen.append((a, b)), parts=3)
    assert seen == [(1, 3), (2, 3), (3, 3)] and {r.occ_id: r.reading for r in out.collect()} == {i: str(i) for i in range(20)}
    again = plugins.read_all(words, lambda crops: 1 / 0, str(tmp_path / "r"), parts=3)
    assert again.where("reading is null").count() == 0
