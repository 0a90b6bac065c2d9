"""Documents and their blocks from texts and page maps, checks of uploads, dictionaries, and results that are saved once."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identity
from ..operators.edits import apply_edits, spliced
from ..session import map_arrow, ship
from .docx import edited_docx
from .files import ENCODINGS, MAX_ENTRY, decoded, edited_rtf, parsed, rtf_escaped, safe_archive

# What may be uploaded: extension, MIME type, bytes it begins with, whether the text is read here.
FORMATS = (
    ("txt", "text/plain", "", True), ("md", "text/markdown", "", True), ("csv", "text/csv", "", True), ("rtf", "application/rtf", "7B5C727466", True),
    ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "504B0304", True), ("doc", "application/msword", "D0CF11E0A1B11AE1", False),
    ("pdf", "application/pdf", "255044462D", False), ("png", "image/png", "89504E470D0A1A0A", False), ("jpg", "image/jpeg", "FFD8FF", False),
)
#: Fixed value: share of printable signs from which bytes are a text.
PRINTABLE = 0.85


def formats(spark: SparkSession) -> DataFrame:
    """extension, mime, parsed_here: the catalogue of formats."""
    return spark.createDataFrame([(e, m, here) for e, m, _, here in FORMATS], "extension string, mime string, parsed_here boolean")


def looks_like_text(data: bytes) -> bool:
    """Whether bytes are a text in one of the encodings: no NUL, and hardly anything that can't be printed."""
    for name in ENCODINGS:
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        if not text or ("\x00" not in text and sum(c.isprintable() or c in "\r\n\t" for c in text) >= PRINTABLE * len(text)):
            return True
    return False


def upload_problem(name: str, mime: str | None, data: bytes | None) -> str | None:
    """What is wrong with an upload, or None: its extension, its MIME type, its size, what it begins with, or what is in it."""
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    kind = {"jpeg": "jpg", "markdown": "md"}.get(kind, kind)
    known = {e: (m, magic) for e, m, magic, _ in FORMATS}
    if kind not in known:
        return "unknown format"
    expected, magic = known[kind]
    if mime and mime.split(";")[0].strip().lower() not in (expected, "application/octet-stream") and not (kind in ("md", "csv") and mime.startswith("text/")):
        return "MIME type of another format"
    if not data:
        return "empty"
    if len(data) > MAX_ENTRY:
        return "too large"
    if magic:
        if not (data[:16].lstrip() if kind == "rtf" else data).startswith(bytes.fromhex(magic)):
            return "content of another format"
        return safe_archive(data, ("[Content_Types].xml", "word/document.xml")) if kind == "docx" else None
    return None if looks_like_text(data) else "no text"


def checked_uploads(uploads: DataFrame) -> DataFrame:
    """source_name, problem (null where there is none) of uploads: source_name, mime, content."""
    ship(uploads.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = [upload_problem(n or "", m, d) for n, m, d in zip(*(batch.column(k).to_pylist() for k in range(3)))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string())], names=["source_name", "problem"])

    return map_arrow(uploads.select("source_name", "mime", "content"), lambda: work, "source_name string, problem string")


#: Readers by file type; each gives (text, status) of a name and bytes.
PARSERS: dict = {}


def parser(*kinds: str):
    """Registers a reader for file types, none of which may have one."""

    def keep(read):
        for kind in kinds:
            if kind in PARSERS:
                raise ValueError(f"{kind} has a reader already")
            PARSERS[kind] = read
        return read

    return keep


parser("txt", "md", "csv", "rtf", "docx", "doc", "pdf", "png", "jpg")(parsed)


def dispatched(files: DataFrame) -> DataFrame:
    """source_name, file_type, text, parse_status of files (source_name, content), each read by the reader of its type; a type without one is missing_parser."""
    ship(files.sparkSession)
    readers = dict(PARSERS)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = [n or "" for n in batch.column(0).to_pylist()]
        kinds = [n.rsplit(".", 1)[-1].lower() for n in names]
        done = [readers[k](n, d or b"") if k in readers else (None, "missing_parser") for n, k, d in zip(names, kinds, batch.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(kinds), pa.array([t for t, _ in done], pa.string()), pa.array([s for _, s in done])], names=["source_name", "file_type", "text", "parse_status"])

    return map_arrow(files.select("source_name", "content"), lambda: work, "source_name string, file_type string, text string, parse_status string")


def direct(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, document_id, source_version, file_type, source_name, text; blocks: doc_id, block_id, kind, text, global_start, global_end): a text
    as a document with one block. texts: doc_id, source_name, text. Null texts have no document; an empty one has no block."""
    docs = texts.where("text is not null").select("doc_id", F.lit("txt").alias("file_type"), F.coalesce("source_name", F.lit("")).alias("source_name"), "text").withColumn("source_version", identity.source_version(F.col("text")))
    docs = docs.withColumn("document_id", identity.document_identity(F.col("file_type"), F.col("source_name"), F.col("source_version")))
    blocks = docs.where("text <> ''").select("doc_id", F.lit("p-0").alias("block_id"), F.lit("paragraph").alias("kind"), "text", F.lit(0).alias("global_start"), F.length("text").alias("global_end"))
    return docs, blocks


def mapped_blocks(docs: DataFrame, page_map: DataFrame) -> DataFrame:
    """doc_id, block_id, block_index, locator_kind, page, paragraph_index, global_start, global_end: blocks of the stretches that a reader's map gives.

    page_map: doc_id, nth, start, end, label. Labels 第N段 and 第N页 name a paragraph and a page, others nothing. Empty stretches give no block; a document without any has
    one for the whole file. Only lengths are taken from the texts.
    """
    sizes = docs.where("text is not null").select("doc_id", F.length("text").alias("size"))
    number = lambda sign: F.regexp_extract("label", rf"^第\s*(\d+)\s*{sign}", 1)
    rows = page_map.join(sizes, "doc_id").where((F.least("end", "size") > F.col("start")) & (F.col("start") >= 0))
    paragraph, page = (F.try_to_number(F.nullif(number(s), F.lit("")), F.lit("999999999")).cast("int") for s in "段页")
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("nth", "start", "end")) - 1
    own = rows.withColumn("paragraph", paragraph).withColumn("page", F.when(F.col("paragraph").isNull(), page)).withColumn("ordinal", ordinal)
    name = F.when(F.col("paragraph").isNotNull(), F.concat(F.lit("paragraph-"), (F.col("paragraph") - 1).cast("string"))).when(F.col("page").isNotNull(), F.concat(F.lit("page-"), F.col("page").cast("string"))).otherwise(F.concat(F.lit("block-"), F.col("nth").cast("string")))
    kind = F.when(F.col("paragraph").isNotNull(), "paragraph").when(F.col("page").isNotNull(), "page").otherwise("unknown")
    mapped = own.select("doc_id", name.alias("block_id"), F.col("ordinal").alias("block_index"), kind.alias("locator_kind"), "page", (F.col("paragraph") - 1).alias("paragraph_index"), F.col("start").alias("global_start"), F.least("end", "size").alias("global_end"))
    whole = sizes.join(mapped.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("file-0").alias("block_id"), F.lit(0).alias("block_index"), F.lit("file").alias("locator_kind"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("paragraph_index"), F.lit(0).alias("global_start"), F.col("size").alias("global_end"))
    return mapped.unionByName(whole)


def edited_files(files: DataFrame, edits: DataFrame, tracked: bool = False) -> DataFrame:
    """source_name, content, status: RTF and DOCX files, and files of text, with the edits of their texts put in where these stand.

    files: source_name, content; edits: source_name, start, end, replacement, by places in the text that the file is read as. A file whose edits overlap, or
    don't fit, comes back with a null content and says why; one without edits as it is; types without a writer are needs_adapter.
    """
    ship(files.sparkSession)
    lists = edits.groupBy("source_name").agg(F.sort_array(F.collect_set(F.struct("start", "end", F.coalesce("replacement", F.lit("")).alias("replacement")))).alias("own"))

    def one(name: str, data: bytes, own: list[tuple[int, int, str]]) -> tuple[bytes | None, str]:
        kind = name.rsplit(".", 1)[-1].lower()
        if any(b > c or (a, b) == (c, d) for (a, b, _), (c, d, _) in zip(own, own[1:])):
            return None, "conflict"
        try:
            if kind == "rtf":
                return edited_rtf(data, own, tracked), "ok"
            if kind == "docx":
                return edited_docx(data, own, tracked), "ok"
            if kind in ("txt", "md", "csv"):
                text = decoded(data)
                done, n = spliced(text, [(a, b, text[a:b], new) for a, b, new in own], tracked)
                return (done.encode("utf-8", "surrogatepass"), "ok") if n == len(own) else (None, "failed: an edit lies outside the text")
        except (ValueError, KeyError) as error:
            return None, f"failed: {error}"
        return None, "needs_adapter"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = [(d, "ok") if not own or d is None else one(n or "", d, [tuple(e.values()) for e in own]) for n, d, own in zip(*(batch.column(k).to_pylist() for k in range(3)))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in told], pa.binary()), pa.array([s for _, s in told])], names=["source_name", "content", "status"])

    return map_arrow(files.select("source_name", "content").join(lists, "source_name", "left").select("source_name", "content", "own"), lambda: work, "source_name string, content binary, status string")


def load_dictionary(content: bytes, name: str) -> tuple[dict, str]:
    """(entries, version) of a dictionary in JSON: an object of non-empty words with a word or null each, or a list of words. The version is the hash of its bytes."""
    import hashlib

    told = json.loads(content.decode("utf-8"))
    entries = dict.fromkeys(told) if isinstance(told, list) else told
    if not isinstance(entries, dict) or not entries or not all(isinstance(k, str) and k.strip() and (v is None or isinstance(v, str)) for k, v in entries.items()):
        raise ValueError(f"{name} is no dictionary")
    return entries, hashlib.sha256(content).hexdigest()


def save_once(results: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the results whose keys the table at a path does not have, and says how many. Saved again, an equal result changes nothing; another one is an error.

    Results are compared by a hash of their other columns, so nothing but keys and hashes is joined.
    """
    spark = results.sparkSession
    rest = [c for c in results.columns if c not in keys]
    mark = lambda df: df.select(*keys, F.xxhash64(*[F.col(c) for c in rest]).alias("mark"))
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        saved = spark.read.schema(results.schema).parquet(path)
        other = mark(results).join(mark(saved).withColumnRenamed("mark", "saved"), keys).where("mark <> saved")
        if other.limit(1).count():
            raise ValueError("another result was saved for the same key")
        results = results.join(saved.select(*keys), keys, "left_anti").select(*results.columns)
    new = results.dropDuplicates(keys)
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def exported(docs: DataFrame, edits: DataFrame, tracked: bool = False) -> DataFrame:
    """source_name, file_type, content, status: the documents as files of their own type with their edits. Types that only an adapter can write say so.

    RTF comes back as RTF: signs outside ASCII as unicode escapes, control signs escaped, lines as paragraphs.
    """
    done = apply_edits(docs, edits, tracked).join(docs.select("doc_id", "source_name", F.lower("file_type").alias("file_type")), "doc_id")
    ship(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, kind in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
            if t is None or kind not in ("txt", "md", "markdown", "csv", "rtf"):
                out.append((None, "failed: no text" if t is None else "needs_adapter"))
            else:
                out.append((as_rtf(t) if kind == "rtf" else t.encode("utf-8", "surrogatepass"), "ok"))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for c, _ in out], pa.binary()), pa.array([s for _, s in out])], names=["source_name", "file_type", "content", "status"])

    return map_arrow(done.select("source_name", "file_type", "text"), lambda: work, "source_name string, file_type string, content binary, status string")


def as_rtf(text: str) -> bytes:
    """A text as an RTF file that reads back as it is, but for white space around it."""
    return ("{\\rtf1\\ansi\\uc1 " + rtf_escaped(text) + "}").encode("ascii")
