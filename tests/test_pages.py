"""Pages read by a scanner."""

import random

from lectern.operators import pages
from lectern.operators.pages import Box


def box(text, x0, y0, x1, y1, confidence=1.0, index=0):
    return Box(index, text, confidence, x0, y0, x1, y1)


def test_lines_and_paragraphs():
    own = [box("Title", 10, 10, 90, 34), box("first", 10, 50, 60, 60), box("line", 70, 51, 110, 61), box("second line", 10, 64, 110, 74), box("far away", 10, 140, 110, 150)]
    random.Random(1).shuffle(own)
    found = pages.elements_of(own)
    assert [(e.kind, e.text, e.level) for e in found] == [("heading", "Title", 1), ("paragraph", "first line\nsecond line", None), ("paragraph", "far away", None)]


def test_tables():
    rows = [[box(t, 10 + 100 * c, 10 + 20 * r, 40 + 100 * c, 20 + 20 * r) for c, t in enumerate(row)] for r, row in enumerate((("A1", "12", "x"), ("B2", "7", "y"), ("C3", "9", "z")))]
    found = pages.elements_of([b for r in rows for b in r])
    assert [(e.kind, e.table, e.row, e.cell) for e in found] == [("table_cell", 0, r, c) for r in range(3) for c in range(3)]
    listed = [[box("•", 10, 10 + 20 * r, 14, 20 + 20 * r), box("an entry of a list", 60, 10 + 20 * r, 200, 20 + 20 * r)] for r in range(3)]
    assert {e.kind for e in pages.elements_of([b for r in listed for b in r])} == {"paragraph"}
    prose = [[box("left words", 10, 10 + 20 * r, 80, 20 + 20 * r), box("right words go", 150, 10 + 20 * r, 280, 20 + 20 * r)] for r in range(3)]
    assert {e.kind for e in pages.elements_of([b for r in prose for b in r])} == {"paragraph"}


def test_repeated_boxes():
    own = [box("a", 0, 0, 100, 10, 0.5), box("b", 0.5, 0, 100.5, 10, 0.9), box("c", 0, 20, 100, 30, 0.9), box("d", 0, 0, 50, 10, 0.9)]
    assert [b.text for b in pages.one_of_each(own)] == ["d", "b", "c"]
    assert not pages.elements_of([])


def test_tables_of_boxes(spark):
    rows = [(1, 1, "far", 0.005, 1.0, 1.0, 9.0, 9.0), (1, 1, "b", 0.9, 20.0, 40.0, 60.0, 60.0), (1, 1, "a", 0.9, 20.0, 20.0, 60.0, 40.0), (1, 1, "out", 0.9, 20.0, 20.0, 600.0, 40.0), (1, 1, None, None, None, None, None, None)]
    own = spark.createDataFrame(rows, "doc_id bigint, page int, text string, confidence double, x0 double, y0 double, x1 double, y1 double").selectExpr("*", "200.0 raster_width", "400.0 raster_height", "100.0 page_width", "200.0 page_height")
    placed = pages.on_page(own)
    assert [(r.box_index, r.text, r.x0, r.y1) for r in placed.orderBy("box_index").collect()] == [(0, "a", 10.0, 20.0), (1, "b", 10.0, 30.0)]
    native = spark.createDataFrame([(1, 1, 0, "Ａ", 10.0, 10.0, 31.0, 20.0), (1, 1, 1, "b", 90.0, 90.0, 95.0, 95.0)], "doc_id bigint, page int, box_index int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in pages.not_native(placed, native).collect()] == ["b"]
    assert [r.kind for r in pages.elements(placed.withColumn("clash", placed.text)).collect()] == ["paragraph"]
    assert pages.elements(placed.where("false")).count() == 0
    glyphs = native.withColumnRenamed("box_index", "glyph_index").drop("text")
    assert [(r.glyph_index, r.cell_index) for r in pages.owners(glyphs, placed.withColumnRenamed("box_index", "cell_index").drop("text", "confidence")).collect()] == [(0, 0)]
    line = spark.createDataFrame([(1, 1, 0, "a", 0.0, 0.0, 9.0, 10.0), (1, 1, 0, "b", 10.0, 0.0, 19.0, 10.0), (1, 1, 0, "c", 29.0, 0.0, 35.0, 10.0)], "doc_id bigint, page int, line_index int, text string, x0 double, y0 double, x1 double, y1 double")
    assert pages.spaced(line).first().text == "ab c"
