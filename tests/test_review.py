"""Review, reports, terminology and the table function."""

import pytest

from lectern.functions.udtf import register
from lectern.operators import dictionary, review


def test_sample(spark):
    rows = [(1, k, "a") for k in range(9)] + [(1, 9, "b"), (2, 0, "a"), (2, 1, "a"), (2, 2, "a")]
    own = spark.createDataFrame(rows, "doc_id bigint, issue_index int, type string")
    assert sorted(tuple(r) for r in review.sample(own, 4).collect()) == [(1, 0, "a"), (1, 4, "a"), (1, 8, "a"), (1, 9, "b"), (2, 0, "a"), (2, 1, "a"), (2, 2, "a")]
    assert sorted(r.issue_index for r in review.sample(own.where("doc_id = 2"), 1).collect()) == [1]


def test_judged(spark):
    issues = spark.createDataFrame([(1, 0, "warning", 0.8), (1, 1, "warning", 0.8), (1, 2, "warning", 0.8)], "doc_id bigint, issue_index int, severity string, confidence double")
    verdicts = spark.createDataFrame([(1, 0, "false_positive"), (1, 1, "uncertain")], "doc_id bigint, issue_index int, verdict string")
    assert sorted(tuple(r) for r in review.judged(issues, verdicts).collect()) == [(1, 1, "info", 0.55), (1, 2, "warning", 0.8)]


def test_report(spark):
    issues = spark.createDataFrame([(1, 1, "r", "info", "<b>", None), (1, 0, "q", "info", "a&b", "c")], "doc_id bigint, issue_index int, rule_id string, severity string, original string, suggestion string")
    (row,) = review.report(issues).collect()
    assert row.html == "<table><tr><td>0</td><td>q</td><td>info</td><td>a&amp;b</td><td>c</td></tr><tr><td>1</td><td>r</td><td>info</td><td>&lt;b&gt;</td><td></td></tr></table>"


def test_terminology():
    assert review.terminology('# note\nAI,人工智能\nAI,x\n"a,b"\tc\nsame,same\nword => term\n') == [("AI", "人工智能"), ("a,b", "c"), ("word", "term")]
    with pytest.raises(ValueError):
        review.terminology("\n".join(f"a{k},b" for k in range(501)))


def test_overlapping_blocks(spark):
    blocks = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 9, 12), (1, 2, 12, 13), (1, 2, 12, 13)], "doc_id bigint, block_index int, global_start int, global_end int")
    assert [r.block_index for r in review.block_overlaps(blocks).collect()] == [1]


def test_table_function(spark):
    register(spark)
    spark.createDataFrame([(1, "帐号"), (2, None)], "doc_id bigint, text string").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT doc_id, i.rule_id FROM texts, LATERAL issues_in(text, 'general') i").collect()
    assert {tuple(r) for r in rows} == {(1, "cn_typo"), (1, "variant_word")}


def test_dictionary(spark):
    docs = spark.createDataFrame([(1, "house " * 12 + "mouse " * 5 + "hause hous Xhouse h'ouse rouse"), (2, None), (3, "")], "doc_id bigint, text string")
    rows = {(r.word, r.place): (r.candidate, r.confident) for r in dictionary.suggestions(docs).collect()}
    assert rows == {("hause", 1): ("house", True), ("hous", 1): ("house", True), ("rouse", 1): ("house", False), ("rouse", 2): ("mouse", False)}
