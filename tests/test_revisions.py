"""Edits, revisions, reviews, leases, uploads and the registry."""

import io
import itertools
import random
import re
import zipfile

import pytest

from lectern.operators import edits, issues, jobs, review
from lectern.plans.registry import Registry
from lectern.sources import documents, files
from lectern.sources.docx import Package, edited_docx
from lectern.streaming import jobs as streams


def test_spliced():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))
        own = sorted({(a, rng.randint(a, len(text)), None, rng.choice(("", "x", "yy"))) for a in (rng.randint(0, len(text)) for _ in range(rng.randint(0, 3)))})
        own = [(a, b, text[a:b], new) for a, b, _, new in own]
        clash = any(max(p[0], q[0]) < min(p[1], q[1]) or p[:2] == q[:2] or (p[0] < q[0] < p[1]) for p, q in itertools.combinations(own, 2))
        want = text
        for a, b, _, new in reversed(own):
            want = want[:a] + new + want[b:]
        assert edits.spliced(text, own) == ((text, 0) if clash else (want, len(own)))
    assert edits.spliced("abc", [(0, 1, "z", "x"), (1, 9, "bc", "x")]) == ("abc", 0)
    assert edits.spliced("abc", [(0, 1, "a", "x"), (2, 3, "c", "")], True) == ("【删除:a→修改为:x】b【删除:c】", 2)


def test_derivable_against_all_subsets():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 7)))
        changes = [(a, rng.randint(a + 1, len(text)), rng.choice(("", "a", "b", "ab"))) for a in (rng.randrange(len(text)) for _ in range(3))]
        reach = set()
        for n in range(4):
            for own in itertools.combinations(sorted(set(changes)), n):
                if all(p[1] <= q[0] for p, q in zip(own, own[1:])):
                    out = text
                    for a, b, new in reversed(own):
                        out = out[:a] + new + out[b:]
                    reach.add(out)
        for target in {*reach, text + "a", text[::-1]}:
            assert edits.derivable(text, target, changes) == (target in reach)
    assert edits.derivable("a" * 40, "b", [(k, k + 1, "") for k in range(40)]) is False


def test_edit_tables(spark):
    docs = spark.createDataFrame([(1, "abc the the"), (2, None), (3, "")], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in edits.replaced_at(docs, "the", "x", 1).collect()} == {1: "abc the x", 2: None, 3: ""}
    assert edits.replaced(docs, [("a", "b"), ("b", "c"), ("", "z")]).orderBy("doc_id").first().text == "ccc the the"
    own = spark.createDataFrame([(1, 7, 0, 1, "a", "x"), (1, 8, 0, 2, "ab", "y"), (3, 9, 0, 0, "", "new")], "doc_id bigint, edit_id bigint, start int, end int, original string, replacement string")
    assert {r.doc_id: (r.text, r.edits) for r in edits.apply_edits(docs, own).collect()} == {1: ("abc the the", 0), 2: (None, 0), 3: ("new", 1)}
    assert {r.doc_id: (r.conflicting, r.status) for r in edits.plan(own).collect()} == {1: ([7, 8], "conflict"), 3: ([], "ready")}
    chain = spark.createDataFrame([("d", 1, "r1", None), ("d", 1, "r1", None), ("d", 2, "r2", "r1"), ("d", 3, "r3", "r1"), ("e", 2, "s2", None)], "doc_id string, number int, revision_id string, parent_id string")
    assert {tuple(r) for r in edits.chain_faults(chain).collect()} == {("d", 3, "parent"), ("e", 2, "number")}
    assert edits.rechecked(docs, own.where("doc_id = 3").selectExpr("doc_id", "edit_id", "start", "end", "original", "'帐号' replacement")).where("doc_id = 3").count() == 1


def test_reviews(spark):
    assert review.read_answer('[{"id":0,"verdict":"real","reason":7}]', 1) == "no verdict" and review.read_answer('{"verdicts":[{"id":0,"verdict":"real"}]}', 1) == [(0, "real", "")]
    text = "see `code` and https://a.test/x plus a_b fooBar\nimport os\nplain"
    hidden = review.masked(text)
    assert len(hidden) == len(text) and "code" not in hidden and "https" not in hidden and "a_b" not in hidden and "import" not in hidden and hidden.endswith("\nplain")
    found = spark.createDataFrame([(1, k, "warning", 0.7) for k in range(3)] + [(2, 0, "error", 0.9), (3, 0, "info", 0.5)], "doc_id bigint, issue_index int, severity string, confidence double")
    told = spark.createDataFrame([(1, '[{"id":0,"verdict":"false_positive"},{"id":1,"verdict":"uncertain"},{"id":2,"verdict":"real"}]', 3), (2, "no", 1)], "doc_id bigint, answer string, expected int")
    assert {tuple(r) for r in review.reviewed(found, told).collect()} == {(1, 1, "info", 0.55, False), (1, 2, "warning", 0.7, False), (2, 0, "error", 0.9, True), (3, 0, "info", 0.5, False)}
    docs = spark.createDataFrame([(1, "one two two")], "doc_id bigint, text string")
    rows = [(1, None, 0, 11, "one", [" 1 "], "typo", 0.99), (1, None, 0, 11, "two", ["2"], "typo", 0.9), (1, 4, 0, 11, "two", ["2"], "typo", 0.9), (1, 4, 5, 11, "two", ["3"], "typo", 0.9), (1, 4, 0, 11, "two", ["2", "2"], "typo", 0.9), (1, 4, 0, 11, "two", ["4"], "x", 0.9), (1, 4, 0, 11, "two", ["4"], "typo", 0.1)]
    proposed = spark.createDataFrame(rows, "doc_id bigint, start int, chunk_start int, chunk_end int, original string, suggestions array<string>, type string, confidence double")
    known = spark.createDataFrame([(1, 4, 7, "2")], "doc_id bigint, start int, end int, suggestion string")
    assert [(r.start, r.suggestions, r.confidence) for r in review.proposed(proposed, docs, known, ("typo",)).collect()] == [(0, ["1"], 0.9)]
    assert review.proposed(proposed, docs, known.where("false"), ("typo",)).count() == 2
    with pytest.raises(ValueError):
        review.terminology("a,b\n" * 40_000)


def test_sources(spark, tmp_path):
    text = "a{b}\\ 中😀\nc\td"
    assert files.from_rtf(documents.as_rtf(text)) == text
    docs = spark.createDataFrame([(1, "x", "RTF", "帐号"), (2, "y", "pdf", "帐号"), (3, "z", "txt", None), (4, "w", "txt", "q")], "doc_id bigint, source_name string, file_type string, text string")
    own = spark.createDataFrame([(1, 0, 0, 2, "帐号", "账号")], "doc_id bigint, edit_id bigint, start int, end int, original string, replacement string")
    told = {r.source_name: (r.status, r.content and bytes(r.content)) for r in documents.exported(docs, own).collect()}
    assert files.from_rtf(told["x"][1]) == "账号" and told["y"][0] == "needs_adapter" and told["z"][0] == "failed: no text" and told["w"] == ("ok", b"q")
    assert documents.load_dictionary('{"a": "b", "c": null}'.encode(), "d")[0] == {"a": "b", "c": None}
    for wrong in (b"[]", b'{"a": 1}', b"7"):
        with pytest.raises(ValueError):
            documents.load_dictionary(wrong, "d")
    with pytest.raises(ValueError):
        documents.parser("txt")(files.parsed)
    path = str(tmp_path / "saved")
    results = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, value string")
    assert documents.save_once(results, path, ["doc_id"]) == 2 and documents.save_once(results, path, ["doc_id"]) == 0 and spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        documents.save_once(spark.createDataFrame([(2, "c")], "doc_id bigint, value string"), path, ["doc_id"])
    read = documents.dispatched(spark.createDataFrame([("a.txt", bytearray(b"hi")), ("b.xyz", bytearray(b"x")), (None, None)], "source_name string, content binary")).collect()
    assert {(r.source_name, r.text, r.parse_status) for r in read} == {("a.txt", "hi", "ok"), ("b.xyz", None, "missing_parser"), ("", None, "missing_parser")}
    docs_, blocks = documents.direct(docs)
    assert docs_.count() == 3 and blocks.count() == 3 and re.fullmatch(r"[0-9a-f-]{36}", docs_.first().document_id)


def test_edited_rtf():
    source = ("{~rtf1~ansi~ansicpg936{~fonttbl{~f0 Arial;}}{~b A}~u20013?b~par C~'d6~'d0 d~{e~}~u-10179?~u-8704?.}").replace("~", chr(92)).encode()
    text = files.from_rtf(source)
    assert text == "A中b\nC中 d{e}😀."
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            assert files.from_rtf(files.edited_rtf(source, [(a, b, "审{x")])) == text[:a] + "审{x" + text[b:]
    both = files.edited_rtf(source, [(0, 1, "Z"), (9, 10, "!")])
    assert files.from_rtf(both) == "Z中b\nC中 d{!}😀." and b"fonttbl" in both and b"{\\b " in both
    assert files.from_rtf(files.edited_rtf(source, [(0, 1, "Z")], tracked=True)) == "AZ" + text[1:]
    with pytest.raises(ValueError):
        files.edited_rtf(source, [(0, 99, "")])


def docx(body, header=""):
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="urn:x" mc:Ignorable="w14"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {space}>{header}</w:hdr>")
        z.writestr("word/media/x.bin", b"kept")
    return out.getvalue()


def test_edited_docx():
    source = docx("<w:p><w:r><w:rPr><w:b/></w:rPr><w:t> 帐</w:t></w:r><w:r><w:t>号 and</w:t><w:tab/><w:t>more </w:t></w:r></w:p><w:p/><w:p><w:r><w:t>last</w:t></w:r></w:p>", "<w:p><w:r><w:t>head</w:t></w:r></w:p>")
    text = files.from_docx(source)
    assert text == "帐号 and\tmore\nlast\nhead" and Package(source).text == text
    for a in range(len(text)):
        for b in range(a, len(text) + 1):
            if "\n" in text[a:b] or (a == b and text[a : a + 1] == "\n"):
                continue
            assert files.from_docx(edited_docx(source, [(a, b, "新x")])) == text[:a] + "新x" + text[b:], (a, b)
    done = edited_docx(source, [(0, 2, "账号"), (13, 14, "")], tracked=True)
    parts = zipfile.ZipFile(io.BytesIO(done))
    xml = parts.read("word/document.xml").decode()
    assert "<w:b" in xml and xml.count("<w:del ") == 3 and xml.count("<w:ins ") == 1 and "w14" in xml and parts.read("word/media/x.bin") == b"kept"
    with pytest.raises(ValueError):
        edited_docx(source, [(0, len(text), "")])


def test_edited_files(spark):
    source = docx("<w:p><w:r><w:t>帐号</w:t></w:r></w:p>")
    own = spark.createDataFrame([("a.docx", bytearray(source)), ("b.rtf", bytearray(documents.as_rtf("帐号"))), ("c.txt", bytearray("帐号".encode())), ("d.pdf", bytearray(b"%PDF")), ("e.txt", bytearray(b"x")), ("f.txt", bytearray(b"abc")), (None, None)], "source_name string, content binary")
    rows = [(n, 0, 2, "账号") for n in ("a.docx", "b.rtf", "c.txt", "d.pdf")] + [("f.txt", 0, 2, "x"), ("f.txt", 1, 3, "y")]
    told = {r.source_name: (r.status, r.content and bytes(r.content)) for r in documents.edited_files(own, spark.createDataFrame(rows, "source_name string, start int, end int, replacement string")).collect()}
    assert files.from_docx(told["a.docx"][1]) == files.from_rtf(told["b.rtf"][1]) == told["c.txt"][1].decode() == "账号"
    assert told["d.pdf"] == ("needs_adapter", None) and told["e.txt"] == ("ok", b"x") and told["f.txt"] == ("conflict", None) and told[None] == ("ok", None)


def test_registry(spark):
    docs = spark.createDataFrame([(1, "帐号，，重复重复")], "doc_id bigint, text string")
    own = Registry()
    with pytest.raises(LookupError):
        own.run(docs)
    one = lambda d: issues.issues_of(d).withColumn("nth", issues.F.col("issue_index"))
    own.register("a", one)
    own.register("b", one)
    with pytest.raises(ValueError):
        own.register("a", one)
    assert [(r.rule_id, r.checker) for r in own.run(docs).orderBy("place").collect()] == [(r, c) for r in ("cn_typo", "repeat_punct", "repeat_word_cn") for c in "ab"]


def test_late_events(spark, tmp_path):
    log = spark.createDataFrame([("a", 2, "parsing", 40), ("a", 3, "completed", 100)], "job_id string, sequence int, status string, progress int").selectExpr("*", "cast(null as string) message", "timestamp'2031-01-01' created_at", "timestamp'2031-01-01' received_at")
    late = spark.createDataFrame([("a", 1, "queued", 0)], "job_id string, sequence int, status string, progress int").selectExpr("*", "cast(null as string) message", "timestamp'2031-01-01' created_at", "timestamp'2031-01-02' received_at")
    for frame in (log, late):
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        query = streams.states(streams.event_stream(spark, str(tmp_path / "events"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert {(r.sequence, r.accepted) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(2, True), (3, True), (1, False)}


def test_latest(spark):
    rows = [("a", 1, "parsing", 5, "2031-01-01", "2031-01-03"), ("a", 1, "parsing", 4, "2031-01-01", "2031-01-02"), ("a", 0, "queued", 0, "2031-01-01", "2031-01-09"), ("b", 0, None, None, None, None)]
    log = spark.createDataFrame(rows, "job_id string, sequence int, status string, progress int, c string, r string").selectExpr("job_id", "sequence", "status", "progress", "null message", "cast(c as timestamp) created_at", "cast(r as timestamp) received_at")
    assert {tuple(r) for r in jobs.latest(log).collect()} == {("a", 1, "parsing", 4), ("b", 0, None, None)}
    assert {(r.job_id, r.sequence, r.progress) for r in jobs.events(log).collect()} == {("a", 1, 4), ("a", 0, 0), ("b", 0, None)}
