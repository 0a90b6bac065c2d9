"""Post-processing of issues and the relational operators, on small tables."""

from pyspark.sql import functions as F

from lectern.functions import identity, statistics
from lectern.operators import edits, issues, jobs, layout
from lectern.operators.rules import Options

DOCS = [(1, "帐号,请用`recieve`。"), (2, None), (3, ""), (4, "好的. 好的"), (4, "好的. 好的")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("type", F.lit("x"))


def test_pipeline(spark):
    found = issues.issues_of(docs(spark)).collect()
    own = {(r.doc_id, r.rule_id) for r in found}
    assert (1, "cn_typo") in own and (1, "variant_word") not in own  # one family, same change
    assert (1, "en_spelling") not in own  # inline code is protected
    assert next(r for r in found if r.rule_id == "cn_typo").also == ["variant_word"]
    mixed = [r for r in found if r.doc_id == 1 and r.original == ","]
    assert [(r.rule_id, r.also) for r in mixed] == [("mixed_punct", ["half_in_cn_context"])]
    assert sorted(r.issue_index for r in found if r.doc_id == 1) == list(range(len([r for r in found if r.doc_id == 1])))
    assert not [r for r in found if r.doc_id in (2, 3)]


def test_shield(spark):
    options = Options(glossary=(("用户名", "帐号"),))
    assert not issues.issues_of(docs(spark, [(1, "帐号")]), options).where("rule_id = 'cn_typo'").count()


def test_empty_table(spark):
    empty = docs(spark, [])
    assert issues.issues_of(empty).count() == 0
    assert [(r.dimension, r.n) for r in issues.summary(issues.issues_of(empty)).collect()] in ([], [("total", 0)])


def test_summary(spark):
    rows = issues.summary(issues.issues_of(docs(spark))).collect()
    total = next(r.n for r in rows if r.dimension == "total")
    for d in ("type", "severity", "rule_id", "layer"):
        assert sum(r.n for r in rows if r.dimension == d) == total


def test_located(spark):
    found = spark.createDataFrame([(1, 5000, 5002), (1, 90, 110), (2, 0, 1)], "doc_id bigint, start int, end int")
    blocks = spark.createDataFrame([(1, 0, "a", 0, 100), (1, 1, "b", 101, 6000), (1, 1, "b", 101, 6000)], "doc_id bigint, block_index int, block_id string, global_start int, global_end int")
    assert {(r.doc_id, r.start): r.block_index for r in issues.located(found, blocks).collect()} == {(1, 5000): 1, (1, 90): None, (2, 0): None}


def test_edits(spark):
    texts = docs(spark, [(1, "😀abcdef"), (2, "abc"), (3, None)])
    own = spark.createDataFrame([(1, 1, 1, 2, "a", "X"), (1, 2, 3, 5, "cd", None), (2, 3, 0, 2, "ab", "Y"), (2, 4, 1, 3, "bc", "Z")], "doc_id bigint, edit_id int, start int, end int, original string, replacement string")
    assert {r.edit_id: r.conflict for r in edits.conflicts(own).collect()} == {1: False, 2: False, 3: True, 4: True}
    assert {r.doc_id: r.text for r in edits.apply_edits(texts, own).collect()} == {1: "😀Xbef", 2: "abc", 3: None}
    assert {r.doc_id: r.text for r in edits.apply_edits(texts, own, tracked=True).collect()}[1] == "😀【删除:a→修改为:X】b【删除:cd】ef"
    assert edits.valid(own.withColumn("original", F.lit("a")), texts).count() == 1


def test_difference():
    for a, b in (("abc", "axc"), ("", "x"), ("same", "same"), ("hello world", "hello there world")):
        new = a
        for s, e, r in reversed(edits.difference(a, b)):
            new = new[:s] + r + new[e:]
        assert new == b
    assert edits.difference("a" * 2000, "b" * 2000) is None
    assert edits.difference("a" * 10, "b" * 10, max_work=120) == [(0, 10, "b" * 10)]


def test_search(spark):
    texts = docs(spark, [(1, "aaa Ａbc"), (2, None)])
    assert [(r.start, r.end) for r in edits.search(texts, "aa").collect()] == [(0, 2)]
    assert [(r.start, r.end) for r in edits.search(texts, "ABC", fold=True).collect()] == [(4, 7)]


def test_counts(spark):
    texts = docs(spark, [(1, "中文 test"), (2, "hello world\nnext"), (3, ""), (4, None)])
    own = {r.doc_id: tuple(r)[1:] for r in statistics.counts(texts).collect()}
    assert own == {1: (7, 6, 1, 1), 2: (16, 14, 2, 2), 3: (0, 0, 1, 0), 4: (None, None, None, None)}
    words = {r.doc_id: (r.language, r.primary_count) for r in statistics.word_counts(texts).collect()}
    assert words == {1: ("zh", 3), 2: ("en", 3), 3: ("zh", 0), 4: ("zh", 0)}


def test_uuid5(spark):
    import uuid

    names = ["a", "中文😀", "document:txt:x:sha256:1"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", identity.uuid5(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) for r in rows)


def test_jobs(spark):
    log = spark.createDataFrame(
        [("a", 0, "queued", 0), ("a", 0, "queued", 0), ("a", 2, "parsing", 40), ("a", 3, "queued", 30), ("b", 0, "completed", 100), ("b", 1, "parsing", 100)],
        "job_id string, sequence int, status string, progress int",
    ).withColumn("message", F.lit(None).cast("string")).withColumn("created_at", F.current_timestamp()).withColumn("received_at", F.col("created_at"))
    assert {(r.job_id, r.sequence, r.problem) for r in jobs.violations(log).collect()} == {("a", 2, "missing_event"), ("a", 3, "step_back"), ("a", 3, "progress_falls"), ("b", 1, "after_final"), ("b", 1, "step_back")}
    assert {r.job_id: r.sequence for r in jobs.latest(log).collect()} == {"a": 3, "b": 1}
    assert {r.stage for r in jobs.stage(log).where("job_id = 'a'").collect()} == {"queued", "ocr"}


def test_evaluate(spark):
    key = "case_id int, start int, end int, type string"
    found = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 1, "a"), (2, 0, 1, "a")], key)
    expected = spark.createDataFrame([(1, 0, 1, "a"), (2, 5, 6, "a")], key)
    groups = spark.createDataFrame([(1, "x"), (2, "y")], "case_id int, case_group string")
    rows = {r.case_group: (r.tp, r.fp, r.fn) for r in jobs.evaluate(found, expected, groups).collect()}
    assert rows == {None: (1, 2, 1), "x": (1, 1, 0), "y": (0, 1, 1)}


def test_layout(spark):
    blocks = spark.createDataFrame([(1, 0, "paragraph", "t", 1, [0.0, 0.0, 10.0, 10.0]), (1, 1, "paragraph", "t", 1, [1.0, 0.0, 10.0, 10.0]), (1, 2, "paragraph", "u", 1, [5.0, 5.0, 20.0, 10.0]), (1, 3, "paragraph", "v", 1, None)], "doc_id bigint, block_index int, kind string, text string, page int, bbox array<double>")
    assert [r.area for r in layout.union_area(blocks).collect()] == [150.0]
    assert [(r.block_index, r.repeats) for r in layout.overlapping_boxes(blocks).collect()] == [(1, 0)]
    area = layout.union_area(blocks).first().area
    kinds = lambda texts, images, size: [(r.page, r.page_kind) for r in layout.page_kinds(texts, images, size).collect()]
    page = blocks.first().page
    assert kinds(blocks, blocks, 2 * area) == [(page, "mixed")] and kinds(blocks, blocks, 2 * area + 1) == [(page, "text")]
    assert kinds(blocks.where("false"), blocks, 2 * area) == [(page, "scanned")] and kinds(blocks, blocks.where("false"), 1.0) == [(page, "text")]


def test_budget_of_documents(spark):
    docs = spark.createDataFrame([(1, "帐号"), (2, "帐号，，帐号"), (3, None)], "doc_id bigint, text string")
    kept, many = issues.within_budget(docs, limit=2)
    assert [r.doc_id for r in kept.collect()] == [1] and [tuple(r) for r in many.collect()] == [(2, 5)]
    own = spark.createDataFrame([(1, 0, 2, "帐号"), (1, 0, 9, "帐号"), (1, 0, 2, "帐"), (1, 0, 2, "账号"), (9, 0, 1, "x")], "doc_id bigint, start int, end int, original string")
    assert sorted(str(r.fault) for r in issues.faults(own, docs).collect()) == ["None", "length", "original", "span"]
