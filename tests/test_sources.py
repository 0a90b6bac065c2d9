"""Files and streams."""

import io
import subprocess
import sys
import zipfile
from pathlib import Path

from lectern.operators.issues import issues_of
from lectern.sources import files
from lectern.streaming import jobs


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_entry_needs_no_session():
    """The catalogue of queries is there before any session is, and each SQL belongs to a query."""
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(s) > 100"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_decoding():
    assert files.decoded("中文".encode("gbk")) == "中文" and files.decoded("中文".encode()) == "中文"
    assert files.without_markup("<p a=\"b\">x &amp; y</p>") == "x & y" and files.without_markup("a < b") == "a < b"
    rtf = ("{~rtf1~ansi{~fonttbl{~f0 Arial;}}A~u20013?~par B~'e9}").replace("~", chr(92)).encode()
    assert files.from_rtf(rtf) == "A中" + chr(10) + "Bé"
    assert files.from_docx(docx("one", " ", "two")) == "one\ntwo"
    assert files.safe_archive(b"x") == "no archive" and files.parsed("a.docx", b"x") == (None, "failed: no archive") and files.parsed("a.pdf", b"")[1] == "needs_adapter"


def test_every_format_gives_the_same_issue(spark, tmp_path):
    text = "Contact test@example.com for review."
    for name, data in (("a.txt", text.encode()), ("b.md", text.encode()), ("c.csv", text.encode("utf-16")), ("d.rtf", b"{\\rtf1 " + text.encode() + b"}"), ("e.docx", docx(text))):
        (tmp_path / name).write_bytes(data)
    docs = files.read_documents(spark, str(tmp_path)).selectExpr("crc32(source_name) doc_id", "text")
    assert issues_of(docs).where("rule_id = 'pii_email'").count() == 5


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([("a", 0, "queued", 0), ("a", 1, "parsing", 40), ("a", 2, "queued", 50), ("b", 0, "queued", 0), ("b", 0, "queued", 0)], "job_id string, sequence int, status string, progress int").selectExpr("*", "cast(null as string) message", "timestamp'2031-01-01' created_at", "timestamp'2031-01-01' received_at")
    log.write.parquet(str(tmp_path / "events"))
    query = jobs.states(jobs.event_stream(spark, str(tmp_path / "events"))).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.job_id, r.sequence): r.accepted for r in spark.table("states").collect()} == {("a", 0): True, ("a", 1): True, ("a", 2): False, ("b", 0): True}
    docs = spark.createDataFrame([(1, "帐号"), (2, "a@b.com")], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    stream = jobs.issue_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), str(tmp_path / "out"), str(tmp_path / "c2"))
    stream.awaitTermination(120)
    columns = ["doc_id", "rule_id", "start", "end"]
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(columns).collect()} == {tuple(r) for r in issues_of(docs).select(columns).collect()}
