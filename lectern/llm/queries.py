"""The subpackage's queries over a data folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import chunking, languages, leakage, overlap, packing, personal, quality, scanned, sentences


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded chunks that break a rule of the windows."""
    return chunking.wrong_chunks(table(spark, sf, "documents"), table(spark, sf, "chunks"))


def p1_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of every document of more than 800 characters."""
    return chunking.chunks(table(spark, sf, "documents"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a missing or wrong label or several languages, a row for each language."""
    return languages.mislabelled(table(spark, sf, "documents"), table(spark, sf, "text_statistics"), table(spark, sf, "common_words"))


def p2_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Language and confidence of every document and of its segments."""
    return languages.segments(table(spark, sf, "documents"), table(spark, sf, "common_words"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in the documents and in the contexts of issues."""
    return personal.found_everywhere(table(spark, sf, "documents"), table(spark, sf, "verification_issues"))


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """The documents and the contexts of issues with typed placeholders for personal data."""
    return personal.redacted_everywhere(table(spark, sf, "documents"), table(spark, sf, "verification_issues"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Noise of scanned documents by line."""
    return scanned.noisy_lines(table(spark, sf, "documents"))


def p4_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, scanned ones as continuous paragraphs."""
    return scanned.repaired(table(spark, sf, "documents"))


def p4_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks of scanned documents, repaired."""
    return scanned.repaired_blocks(table(spark, sf, "documents"), table(spark, sf, "document_blocks"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of cases in train and outside it with the same or nearly the same text."""
    return overlap.overlaps(table(spark, sf, "detection_cases"))


def p5_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of p5_found without any that its lists and marks may leave out, with the work of all pairs."""
    return overlap.overlaps(table(spark, sf, "detection_cases"), exact=True)


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping cases per split and source."""
    return overlap.overlap_report(table(spark, sf, "detection_cases"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence units of the documents that have a task."""
    return sentences.asked_sentences(table(spark, sf, "documents"), table(spark, sf, "sentence_tasks"))


def p6_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence units of every document."""
    return sentences.sentences(table(spark, sf, "documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the packing has to cut."""
    return packing.cut_documents(table(spark, sf, "documents"), table(spark, sf, "packing_specs"))


def p7_packing(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every document or piece."""
    return packing.pack(table(spark, sf, "documents"), table(spark, sf, "packing_specs"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of each scenario are."""
    return packing.fill_report(p7_packing(spark, sf))


def p7_account(spark: SparkSession, sf: str) -> DataFrame:
    """What the containers of each scenario hold."""
    return packing.account(p7_packing(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the test items they leak."""
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select("doc_id", "item_id")


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The longest leaked stretch of each document and item."""
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def p8_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """All documents without the passages of test items."""
    return leakage.cleaned(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are no natural prose, with their kind."""
    return quality.assessed(table(spark, sf, "documents"), table(spark, sf, "common_words")).where("text_kind <> 'prose'").select("doc_id", "text_kind")


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Quality statistics, outlier score and kind of every document."""
    return quality.assessed(table(spark, sf, "documents"), table(spark, sf, "common_words"))


QUERIES = {name: f for name, f in sorted(globals().items()) if name[:1] == "p" and name[1:2].isdigit()}

SQL = {
    "p7_found": """
        SELECT d.doc_id FROM documents d LEFT JOIN packing_specs s ON s.scenario = coalesce(d.scenario, 'general')
        WHERE octet_length(encode(d.text)) + 1 > coalesce(s.capacity, (SELECT max(capacity) FROM packing_specs WHERE scenario = 'general'))""",
    "p7_account": """
        SELECT CASE WHEN s.scenario IS NULL THEN 'general' ELSE s.scenario END AS scenario, count(*) AS documents, CAST(sum(length(d.text)) AS BIGINT) AS characters, CAST(0 AS BIGINT) AS overfull
        FROM documents d LEFT JOIN packing_specs s ON s.scenario = coalesce(d.scenario, 'general') WHERE d.text IS NOT NULL GROUP BY 1""",
}
