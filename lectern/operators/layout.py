"""Pages and boxes: kinds of pages, areas, offsets and boxes that repeat others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Share of a page that pictures cover where it is a mixed one, and signs of text that make it readable.
COVERED, READABLE = 0.5, 1


def page_kinds(texts: DataFrame, images: DataFrame, page_area: float) -> DataFrame:
    """doc_id, page, chars, cover, page_kind: scanned where pictures stand and no text, mixed where they cover half of the page and there is text, else text.

    texts and images are blocks; pictures that overlap cover what they cover together. Pages of either are told.
    """
    signs = texts.where("page is not null").select("doc_id", "block_index", "page", F.length("text").alias("signs")).distinct().groupBy("doc_id", "page").agg(F.coalesce(F.sum("signs"), F.lit(0)).alias("chars"))
    met = signs.join(union_area(images), ["doc_id", "page"], "full").select("doc_id", "page", F.coalesce("chars", F.lit(0)).alias("chars"), F.round(F.least(F.lit(1.0), F.coalesce("area", F.lit(0.0)) / page_area), 6).alias("cover"))
    kind = F.when((F.col("chars") < READABLE) & (F.col("cover") > 0), "scanned").when((F.col("cover") >= COVERED) & (F.col("chars") >= READABLE), "mixed").otherwise("text")
    return met.withColumn("page_kind", kind)


def joined_offsets(blocks: DataFrame) -> DataFrame:
    """doc_id, block_index, joined_start, joined_end: the blocks with a text one after another, a line break between."""
    own = blocks.select("doc_id", "block_index", F.length("text").alias("n")).where("n > 0").distinct()
    upto = F.sum(F.col("n") + 1).over(Window.partitionBy("doc_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return own.select("doc_id", "block_index", (upto - F.col("n") - 1).cast("bigint").alias("joined_start"), (upto - 1).cast("bigint").alias("joined_end"))


def _boxes(blocks: DataFrame) -> DataFrame:
    sides = [F.element_at("bbox", k + 1).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]
    return blocks.where("bbox is not null and size(bbox) = 4 and page is not null").select("doc_id", "page", "block_index", "text", *sides).distinct().where("x1 > x0 and y1 > y0")


def union_area(blocks: DataFrame) -> DataFrame:
    """doc_id, page, area: of the union of a page's boxes, by a sweep over bands between its horizontal edges.

    Within a band, intervals merge by a running maximum of their right ends. A page's boxes are bounded by what fits on a page.
    """
    boxes = _boxes(blocks)
    edges = boxes.select("doc_id", "page", F.explode(F.array("y0", "y1")).alias("y")).distinct()
    bands = edges.withColumn("upto", F.lead("y").over(Window.partitionBy("doc_id", "page").orderBy("y"))).where("upto is not null")
    within = bands.join(boxes, ["doc_id", "page"]).where("y0 <= y and upto <= y1")
    order = Window.partitionBy("doc_id", "page", "y").orderBy("x0", "x1")
    reach = F.coalesce(F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("x0"))
    new = F.greatest(F.lit(0.0), F.col("x1") - F.greatest("x0", "reach"))
    return within.withColumn("reach", reach).groupBy("doc_id", "page").agg(F.round(F.sum(new * (F.col("upto") - F.col("y"))), 4).alias("area"))


def _overlap(a: str, b: str) -> Column:
    side = lambda p, q: F.greatest(F.lit(0.0), F.least(f"{a}{q}", f"{b}{q}") - F.greatest(f"{a}{p}", f"{b}{p}"))
    return side("x0", "x1") * side("y0", "y1")


def overlapping_boxes(blocks: DataFrame, least: float = 0.5, cell: float = 64.0) -> DataFrame:
    """doc_id, page, block_index, repeats: blocks whose box has at least this intersection over union with an earlier one of equal text.

    Boxes meet in the cells of a grid that both touch, by an equi-join on page, cell and text.
    """
    boxes = _boxes(blocks)
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    gridded = boxes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    keys = ["doc_id", "page", "cx", "cy", "text"]
    side = lambda p: gridded.select(*keys, *[F.col(c).alias(p + c) for c in ("block_index", "x0", "y0", "x1", "y1")])
    met = side("a_").join(side("b_"), keys).where("a_block_index < b_block_index")
    area = lambda p: (F.col(p + "x1") - F.col(p + "x0")) * (F.col(p + "y1") - F.col(p + "y0"))
    shared = _overlap("a_", "b_")
    return met.where(shared / (area("a_") + area("b_") - shared) >= least).groupBy("doc_id", "page", F.col("b_block_index").alias("block_index")).agg(F.min("a_block_index").alias("repeats"))
