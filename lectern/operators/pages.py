"""Pages read by a scanner: boxes brought to the page, boxes that repeat, lines, tables, headings and paragraphs, and what lies in which cell."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship

#: Least confidence of a box; share by which two boxes are one; shares of a repeated text; size of a grid's cell.
LEAST_CONFIDENCE, SAME_BOX, SAME_TEXT, COVERED, CELL = 0.01, 0.95, 0.5, 0.9, 64.0
#: Overlap and distance of baselines within a line, in heights.
LINE_OVERLAP, LINE_BASELINE = 0.45, 0.45
#: Height of a heading over the body's, its longest text, heights of one cluster and of one paragraph.
HEADING, HEADING_SIGNS, CLUSTER, PARAGRAPH = 1.35, 160, 1.15, 1.25
#: Gap between the cells of a row, and between two rows, in heights.
CELL_GAP, ROW_GAP = 1.5, 4.0
_SIDES = ("x0", "y0", "x1", "y1")


# ------------------------------------------------------------------------------------------------------------------- boxes
def on_page(boxes: DataFrame) -> DataFrame:
    """doc_id, page, box_index, text, confidence, x0..y1: boxes of a raster in the measure of their page, from the top to the bottom, numbered.

    boxes: doc_id, page, text, confidence, x0..y1 in the raster, raster_width, raster_height, page_width, page_height. Boxes with hardly any
    confidence are dropped, as are those outside the raster, without a size, or with a null. Equal rows are boxes of their own.
    """
    inside = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") <= F.col("raster_width")) & (F.col("y1") <= F.col("raster_height")) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    kept = boxes.where(inside & (F.col("confidence") >= LEAST_CONFIDENCE))
    scaled = [(F.col(c) / F.col(f"raster_{side}") * F.col(f"page_{side}")).alias(c) for c, side in zip(_SIDES, ("width", "height") * 2)]
    order = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "text", F.desc("confidence"), "x1", "y1")
    return kept.select("doc_id", "page", "text", "confidence", *scaled).withColumn("box_index", F.row_number().over(order) - 1)


def _area(p: str):
    return (F.col(p + "x1") - F.col(p + "x0")) * (F.col(p + "y1") - F.col(p + "y0"))


def _shared():
    side = lambda low, high: F.greatest(F.lit(0.0), F.least("a_" + high, "b_" + high) - F.greatest("a_" + low, "b_" + low))
    return side("x0", "x1") * side("y0", "y1")


def _gridded(boxes: DataFrame, p: str, *keys: str) -> DataFrame:
    span = lambda a, b: F.sequence(F.floor(F.col(a) / CELL), F.floor(F.col(b) / CELL))
    rows = boxes.select(*keys, *[F.col(c).alias(p + c) for c in boxes.columns if c not in keys], F.explode(span("x0", "x1")).alias("cx"), span("y0", "y1").alias("ys"))
    return rows.withColumn("cy", F.explode("ys")).drop("ys")


def not_native(scanned: DataFrame, native: DataFrame) -> DataFrame:
    """The scanned boxes whose text the page does not hold already at their place.

    scanned and native: doc_id, page, box_index, text, x0..y1. A native box repeats one of the same text, whatever its case, width and blanks, where they
    have half of their union, or nine tenths of the smaller, in common. Boxes meet in the cells of a grid, by an equi-join on page, cell and text.
    """
    keys = ("doc_id", "page", "norm")
    norm = F.regexp_replace(F.lower(F.translate("text", "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))))), r"\s+", "")
    own = scanned.withColumn("norm", norm)
    met = _gridded(own.select(*keys, "box_index", *_SIDES), "a_", *keys).join(_gridded(native.withColumn("norm", norm).select(*keys, *_SIDES), "b_", *keys), [*keys, "cx", "cy"])
    shared = _shared()
    same = (shared / (_area("a_") + _area("b_") - shared) >= SAME_TEXT) | (shared / F.least(_area("a_"), _area("b_")) >= COVERED)
    repeats = met.where((F.col("norm") != "") & same).select("doc_id", "page", F.col("a_box_index").alias("box_index")).distinct()
    return scanned.join(repeats, ["doc_id", "page", "box_index"], "left_anti")


def owners(glyphs: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, page, glyph_index, cell_index: the cell that holds most of each glyph, of equal ones the first; glyphs outside all cells are left out.

    glyphs: doc_id, page, glyph_index, x0..y1; cells: doc_id, page, cell_index, x0..y1; they meet in the cells of a grid.
    """
    keys = ("doc_id", "page")
    met = _gridded(glyphs, "a_", *keys).join(_gridded(cells, "b_", *keys), [*keys, "cx", "cy"]).withColumn("shared", _shared()).where("shared > 0")
    best = Window.partitionBy(*keys, "a_glyph_index").orderBy(F.desc("shared"), "b_cell_index")
    return met.withColumn("nth", F.row_number().over(best)).where("nth = 1").select(*keys, F.col("a_glyph_index").alias("glyph_index"), F.col("b_cell_index").alias("cell_index"))


def spaced(glyphs: DataFrame, gap: float = 0.3) -> DataFrame:
    """doc_id, page, line_index, text: the glyphs of each line with a blank where the gap before one is more than `gap` of its height.

    glyphs: doc_id, page, line_index, text, x0..y1. Of a gap beside a blank nothing comes.
    """
    order = Window.partitionBy("doc_id", "page", "line_index").orderBy("x0", "x1", "text")
    before, last = F.lag("x1").over(order), F.lag("text").over(order)
    wide = (F.col("x0") - before > gap * (F.col("y1") - F.col("y0"))) & ~F.coalesce(last.rlike(r"\s$"), F.lit(True)) & ~F.col("text").rlike(r"^\s")
    parts = glyphs.withColumn("part", F.concat(F.when(wide, " ").otherwise(""), F.col("text"))).withColumn("nth", F.row_number().over(order))
    return parts.groupBy("doc_id", "page", "line_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "part"))), lambda x: x["part"]), "").alias("text"))


# ------------------------------------------------------------------------------------------------------------------- pages
@dataclass
class Box:
    index: int
    text: str
    confidence: float
    x0: float
    y0: float
    x1: float
    y1: float

    @property
    def height(self) -> float:
        return self.y1 - self.y0

    @property
    def middle(self) -> float:
        return (self.x0 + self.x1) / 2


def one_of_each(boxes: list[Box]) -> list[Box]:
    """The surest of boxes that are nearly one, whatever their text: a box goes where a surer one that stays has nearly all in common with it."""
    kept: list[Box] = []
    cells: dict[tuple[int, int], list[Box]] = {}
    for b in sorted(boxes, key=lambda b: (-b.confidence, unicodedata.normalize("NFKC", b.text).casefold(), b.text, b.x0, b.y0, b.x1, b.y1)):
        size = max(1.0, min(b.x1 - b.x0, b.height))
        at = lambda v: int(v // CELL)
        around = [(i, j) for i in range(at(b.middle) - 1, at(b.middle) + 2) for j in range(at((b.y0 + b.y1) / 2) - 1, at((b.y0 + b.y1) / 2) + 2)]

        def same(o: Box, b: Box = b) -> bool:
            shared = max(0.0, min(b.x1, o.x1) - max(b.x0, o.x0)) * max(0.0, min(b.y1, o.y1) - max(b.y0, o.y0))
            return shared >= SAME_BOX * ((b.x1 - b.x0) * b.height + (o.x1 - o.x0) * o.height - shared)

        if size and not any(same(o) for cell in around for o in cells.get(cell, ())):
            kept.append(b)
            cells.setdefault((at(b.middle), at((b.y0 + b.y1) / 2)), []).append(b)
    return sorted(kept, key=lambda b: (b.y0, b.x0, b.text))


@dataclass
class Line:
    boxes: list[Box] = field(default_factory=list)

    x0 = property(lambda self: min(b.x0 for b in self.boxes))
    y0 = property(lambda self: min(b.y0 for b in self.boxes))
    x1 = property(lambda self: max(b.x1 for b in self.boxes))
    y1 = property(lambda self: max(b.y1 for b in self.boxes))
    height = property(lambda self: self.y1 - self.y0)

    def fits(self, b: Box) -> tuple[float, float, float] | None:
        """How well a box goes on with the line (the less the better), or None."""
        overlap = max(0.0, min(self.y1, b.y1) - max(self.y0, b.y0)) / max(1e-9, min(self.height, b.height))
        apart = abs(sum(x.y1 for x in self.boxes) / len(self.boxes) - b.y1)
        return (-overlap, apart, self.x0) if overlap >= LINE_OVERLAP or apart <= max(self.height, b.height) * LINE_BASELINE else None

    def text(self, blank: str) -> str:
        return blank.join(b.text for b in self.boxes)


def lines_of(boxes: list[Box]) -> list[Line]:
    """Lines of boxes, from the top; a box joins the line it fits best among those that reach down to it."""
    done: list[Line] = []
    open_: list[Line] = []
    for b in sorted(boxes, key=lambda b: (b.y0, b.x0, b.y1, b.index)):
        open_ = [x for x in open_ if x.y1 + max(x.height, b.height) * LINE_BASELINE >= b.y0]
        fitting = [(f, k) for k, x in enumerate(open_) if (f := x.fits(b)) is not None]
        if fitting:
            open_[min(fitting)[1]].boxes.append(b)
        else:
            open_.append(Line([b]))
            done.append(open_[-1])
    for x in done:
        x.boxes.sort(key=lambda b: (b.x0, b.index))
    return sorted(done, key=lambda x: (x.y0, x.x0))


_MARKER = re.compile(r"[•●▪◦‣⁃∙·○◆◇■□▲△※\-–—]|[（(]?(?:\d{1,3}|[一二三四五六七八九十]{1,3}|[A-Za-z])[)）.、]")
_CODE = re.compile(r"(?=\w*\d)\w{1,11}\.?|[A-Z]\.")


def _even(values: list[float], allowed: float) -> bool:
    return max(values) - min(values) <= allowed


def _is_row(line: Line) -> bool:
    gaps = [b.x0 - a.x1 for a, b in zip(line.boxes, line.boxes[1:])]
    tall = median(b.height for b in line.boxes)
    return bool(gaps) and min(gaps) >= max(4.0, CELL_GAP * tall) and _even(gaps, max(2 * tall, 0.5 * median(gaps))) and _even([b.y1 for b in line.boxes], max(2.0, 0.35 * tall))


def _is_table(rows: list[Line]) -> bool:
    tall = median(b.height for r in rows for b in r.boxes)
    columns = list(zip(*(r.boxes for r in rows)))
    if not all(_even([b.x0 for b in c], max(4.0, 0.75 * tall)) or _even([b.middle for b in c], max(4.0, 0.75 * tall)) for c in columns):
        return False
    first, second = ([b.text.strip() for b in c] for c in columns[:2])
    if all(_MARKER.fullmatch(t) for t in first) and max(b.x1 - b.x0 for b in columns[0]) <= 0.35 * median(b.x1 - b.x0 for b in columns[1]):
        return False  # a list with its marks apart
    plain = lambda t: t.replace(" ", "").isalpha()
    if not all(_CODE.fullmatch(t) for t in first) and all(plain(t) and len(t.replace(" ", "")) > 1 for t in first) and all(" " in t or plain(t) or len(t) >= 12 for t in second):
        return False  # prose in columns
    short = lambda t: bool(_CODE.fullmatch(t)) or (1 <= len(t) <= 3 and " " not in t and not _MARKER.fullmatch(t))
    return len(rows) > 2 or (_even([r.height for r in rows], max(2.0, 0.25 * tall)) and all(map(short, first)))


def tables_of(lines: list[Line]) -> list[list[int]]:
    """Runs of two rows and more whose cells stand under each other, by the lines' numbers."""
    out: list[list[int]] = []
    run: list[int] = []
    rows = [k for k, x in enumerate(lines) if _is_row(x)]
    for k in [*rows, None]:
        if k is not None and run:
            a, b = lines[run[-1]], lines[k]
            tall = median(x.height for x in (*a.boxes, *b.boxes))
            under = len(a.boxes) == len(b.boxes) and 0 <= b.y0 - a.y1 <= ROW_GAP * tall and all(min(abs(p.x0 - q.x0), abs(p.middle - q.middle)) <= max(4.0, 0.75 * tall) for p, q in zip(a.boxes, b.boxes))
        else:
            under = False
        if not under:
            if len(run) >= 2 and _is_table([lines[j] for j in run]):
                out.append(run)
            run = []
        if k is not None:
            run.append(k)
    return out


def body_height(lines: list[Line]) -> float:
    """Height of the most lines that are nearly as high as each other; of as many, the lower if all stand alone, else the higher, but for two kinds of
    which the higher stands above the other, well apart."""
    clusters: list[list[Line]] = []
    for x in sorted(lines, key=lambda x: x.height):
        usual = median(y.height for y in clusters[-1]) if clusters else 0.0
        if clusters and not (x.height > usual * CLUSTER and x.height > usual + 2.0):
            clusters[-1].append(x)
        else:
            clusters.append([x])
    most = max(map(len, clusters))
    best = [c for c in clusters if len(c) == most]
    low, high = best[0], best[-1]
    tall = lambda c: median(x.height for x in c)
    if most == 1:
        return tall(low)
    gap = min(x.y0 for x in low) - max(x.y1 for x in high)
    return tall(low) if len(best) == 2 and 0 < gap <= max(tall(low), tall(high)) else tall(high)


@dataclass
class Element:
    kind: str
    text: str
    lines: list[Line]
    level: int | None = None
    table: int = -1
    row: int = -1
    cell: int = -1


def elements_of(boxes: list[Box], blank: str = " ") -> list[Element]:
    """Cells of tables, headings and paragraphs of a page, from the top to the bottom."""
    lines = lines_of(one_of_each(boxes))
    tables = tables_of(lines)
    out = [Element("table_cell", b.text, [Line([b])], None, t, r, c) for t, rows in enumerate(tables) for r, k in enumerate(rows) for c, b in enumerate(lines[k].boxes)]
    taken = {k for rows in tables for k in rows}
    rest = [x for k, x in enumerate(lines) if k not in taken]
    body = body_height(rest) if rest else 0.0
    paragraph: list[Line] = []

    def close() -> None:
        if paragraph:
            out.append(Element("paragraph", "\n".join(x.text(blank) for x in paragraph), list(paragraph)))
            paragraph.clear()

    for x in rest:
        if x.height >= max(body * HEADING, body + 2.0) and len(x.text(blank)) <= HEADING_SIGNS:
            close()
            level = next((n for n, least in ((1, 2.0), (2, 1.75), (3, 1.5)) if x.height >= least * body), 4)
            out.append(Element("heading", x.text(blank), [x], level))
            continue
        if paragraph:
            last = paragraph[-1]
            goes_on = 0 <= x.y0 - last.y1 <= max(4.0, 1.5 * body) and abs(x.x0 - last.x0) <= max(10.0, 1.5 * body) and max(x.height, last.height) <= PARAGRAPH * min(x.height, last.height)
            if not goes_on:
                close()
        paragraph.append(x)
    close()
    rank = {"heading": 0, "paragraph": 1, "table_cell": 2}
    return sorted(out, key=lambda e: (min(x.y0 for x in e.lines), min(x.x0 for x in e.lines), rank[e.kind], e.table, e.row, e.cell))


_ELEMENTS = "doc_id bigint, page int, element_index int, kind string, text string, level int, table_index int, row_index int, cell_index int, x0 double, y0 double, x1 double, y1 double, confidence double"


def elements(boxes: DataFrame, blank: str = " ") -> DataFrame:
    """The elements of each page with their place in its order. boxes: doc_id, page, box_index, text, confidence, x0..y1.

    A page's boxes are brought together; there are as many as fit on a page. Boxes with a null or without a size are left out.
    """
    ship(boxes.sparkSession)
    own = boxes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page").cast("int").alias("page"), F.col("box_index").cast("int").alias("box_index"), "text", F.col("confidence").cast("double").alias("confidence"), *[F.col(c).cast("double").alias(c) for c in _SIDES]).na.drop().where("x1 > x0 and y1 > y0")

    def page_of(frame: pd.DataFrame) -> pd.DataFrame:
        found = elements_of([Box(*r) for r in frame[["box_index", "text", "confidence", *_SIDES]].itertuples(index=False, name=None)], blank)
        rows = []
        for k, e in enumerate(found):
            inside = [b for x in e.lines for b in x.boxes]
            rows.append((int(frame.doc_id.iloc[0]), int(frame.page.iloc[0]), k, e.kind, e.text, e.level, e.table, e.row, e.cell, min(b.x0 for b in inside), min(b.y0 for b in inside), max(b.x1 for b in inside), max(b.y1 for b in inside), sum(b.confidence for b in inside) / len(inside)))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _ELEMENTS.split(", ")]).astype({"level": "Int32"})

    return own.groupBy("doc_id", "page").applyInPandas(page_of, _ELEMENTS)


def boxes_of(blocks: DataFrame) -> DataFrame:
    """The boxes that blocks with a place on a page have, each with full confidence; repeated rows count once."""
    sides = [F.element_at("bbox", k + 1).alias(c) for k, c in enumerate(_SIDES)]
    return blocks.where("bbox is not null and size(bbox) = 4 and page is not null").select("doc_id", "page", F.col("block_index").alias("box_index"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1.0).alias("confidence"), *sides).distinct()


def grid_cells(boxes: DataFrame, rulings: DataFrame) -> DataFrame:
    """doc_id, page, box_index, row_index, cell_index: the cell of a ruled table that holds the middle of each box; boxes outside it are left out.

    rulings: doc_id, page, xs, ys: sorted places of the lines. The lines of a page's table are few, so a box carries them.
    """
    at = lambda places, v: F.size(F.filter(places, lambda p: p <= v)) - 1
    met = boxes.join(rulings, ["doc_id", "page"]).withColumn("cell_index", at("xs", (F.col("x0") + F.col("x1")) / 2)).withColumn("row_index", at("ys", (F.col("y0") + F.col("y1")) / 2))
    inside = (F.col("cell_index") >= 0) & (F.col("cell_index") < F.size("xs") - 1) & (F.col("row_index") >= 0) & (F.col("row_index") < F.size("ys") - 1)
    return met.where(inside).select("doc_id", "page", "box_index", "row_index", "cell_index")
