"""Counts of a text as an editor shows them."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import texts_of
from ..session import map_arrow, ship, spread

_WORDS, _NUMBERS = re.compile(r"[A-Za-z]+(?:['’-][A-Za-z]+)*"), re.compile(r"\d+(?:[.,]\d+)*")
#: White space that counts.
BLANKS = r"[\s\x1c-\x1f\u0085   -     　]"


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, char_count, char_count_no_space, line_count, paragraph_count, by native expressions.

    An empty text has one line and no paragraph; a null text has nulls.
    """
    lines = F.split("text", "\n", -1)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").alias("char_count"), F.length(F.regexp_replace("text", BLANKS, "")).alias("char_count_no_space"),
        F.when(F.col("text").isNotNull(), F.size(lines)).alias("line_count"),
        F.when(F.col("text").isNotNull(), F.size(F.filter(lines, lambda x: F.length(F.regexp_replace(x, BLANKS, "")) > 0))).alias("paragraph_count"),
    )


def wide(text: str) -> int:
    """East Asian wide signs, and ambiguous marks, which editors count as words."""
    return sum((w := unicodedata.east_asian_width(c)) in "WF" or (w == "A" and unicodedata.category(c)[0] == "P") for c in text)


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, language (zh where wide signs are at least as many as English words, else en), primary_count, primary_label."""
    ship(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(w := wide(t), len(_WORDS.findall(t)), len(_NUMBERS.findall(t))) for t in texts_of(batch.column(1))]
        language = ["zh" if w >= e else "en" for w, e, _ in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(language), pa.array([sum(x) for x in rows], pa.int32()), pa.array(["总字数" if x == "zh" else "总单词数" for x in language])], names=["doc_id", "language", "primary_count", "primary_label"])

    return map_arrow(spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")), lambda: work, "doc_id bigint, language string, primary_count int, primary_label string")
