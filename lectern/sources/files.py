"""Documents from files: plain text in several encodings, markup, RTF and DOCX, read as bytes and decoded in Arrow batches."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_arrow, ship

# Encodings in the order in which they are tried, and bounds of zip archives.
ENCODINGS = ("utf-8", "gbk", "gb2312", "big5", "utf-16", "latin-1")
MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL = 10_000, 100_000_000, 200_000_000
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Destinations of RTF groups that hold no text.
_SILENT = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr headerf footerl footerr footerf footnote generator themedata colorschememapping datastore latentstyles listtable listoverridetable rsidtbl xmlnstbl".split())
_BREAKS = {"par": "\n", "line": "\n", "tab": "\t", "cell": "\t", "row": "\n", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def decoded(data: bytes) -> str:
    """Text in the first encoding that fits."""
    for name in ENCODINGS:
        try:
            return data.decode(name).lstrip("\ufeff")
        except UnicodeDecodeError:
            continue
    return ""


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def without_markup(text: str) -> str:
    """The character data of a text that holds both angle brackets, without what is left of attributes; any other text as it is."""
    if "<" not in text or ">" not in text:
        return text
    parser = _Text()
    parser.feed(text)
    parser.close()
    return re.sub(r"[<>]", "", re.sub(r"\b[\w-]+=\"[^\"]*\"", "", "".join(parser.parts)))


class _Rtf:
    """The signs of an RTF file with the stretch of its bytes that each comes from: groups on a stack, unicode signs with their fallbacks, bytes of the
    code page, silent destinations."""

    def __init__(self, data: bytes):
        self.source = data.decode("latin-1")
        self.signs: list[tuple[str, int, int]] = []
        self._decoder = codecs.getincrementaldecoder("cp1252")("replace")
        self._since: int | None = None
        self._read()
        self._join_halves()
        while self.signs and self.signs[-1][0].isspace():
            self.signs.pop()
        blank = next((k for k, (c, *_) in enumerate(self.signs) if not c.isspace()), 0)
        del self.signs[:blank]

    def _byte(self, value: int, start: int, end: int) -> None:
        self._since = start if self._since is None else self._since
        for c in self._decoder.decode(bytes([value])):
            self.signs.append((c, self._since, end))
            self._since = None

    def _read(self) -> None:
        skip, silent, drop = 1, False, 0
        stack: list[tuple[int, bool]] = []
        for m in re.finditer(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+", self.source):
            word, number, byte, sign, brace, plain = m.groups()
            if brace == "{":
                stack.append((skip, silent))
            elif brace == "}":
                if stack:
                    skip, silent = stack.pop()
            elif word:
                if word == "ansicpg" and number:
                    self._decoder = codecs.getincrementaldecoder(f"cp{number}")("replace")
                elif word == "uc" and number:
                    skip = int(number)
                elif word in _SILENT:
                    silent = True
                elif word == "u" and number and not silent:
                    self.signs.append((chr(int(number) % 0x10000), *m.span()))
                    drop = skip
                elif word in _BREAKS and not silent:
                    self.signs.append((_BREAKS[word], *m.span()))
            elif sign == "*":
                silent = True
            elif silent:
                continue
            elif byte:
                if drop:
                    drop -= 1
                    self._widen(m.end())
                else:
                    self._byte(int(byte, 16), *m.span())
            elif sign:
                shown = {"~": " ", "_": "‑", "-": ""}.get(sign, sign if sign in "\\{}" else "")
                if shown:
                    self.signs.append((shown, *m.span()))
            elif plain:
                fallback = min(drop, len(plain))
                if fallback:
                    self._widen(m.start() + fallback)
                    drop -= fallback
                for k in range(fallback, len(plain)):
                    at = m.start() + k
                    self._byte(ord(plain[k]), at, at + 1) if plain[k] > "\x7f" else self.signs.append((plain[k], at, at + 1))

    def _widen(self, end: int) -> None:
        """The last sign's stretch takes in what stands for it where unicode signs are not read."""
        c, a, _ = self.signs[-1]
        self.signs[-1] = (c, a, end)

    def _join_halves(self) -> None:
        out: list[tuple[str, int, int]] = []
        for c, a, b in self.signs:
            if out and "\ud800" <= out[-1][0] <= "\udbff" and "\udc00" <= c <= "\udfff":
                out[-1] = ((out[-1][0] + c).encode("utf-16", "surrogatepass").decode("utf-16"), out[-1][1], b)
            else:
                out.append((c, a, b))
        self.signs = [("\ufffd" if "\ud800" <= c <= "\udfff" else c, a, b) for c, a, b in out]


def from_rtf(data: bytes) -> str:
    """The text of an RTF file, without white space around it."""
    return "".join(c for c, *_ in _Rtf(data).signs)


def rtf_escaped(text: str) -> str:
    """A text as it stands in an RTF file: signs outside ASCII as unicode escapes, control signs escaped, lines as paragraphs."""
    out = []
    for c in text:
        if c in "\\{}":
            out.append("\\" + c)
        elif c == "\n":
            out.append("\\par\n")
        elif c == "\t":
            out.append("\\tab ")
        elif c.isascii():
            out.append(c)
        else:
            units = c.encode("utf-16-le", "surrogatepass")
            out += [f"\\u{int.from_bytes(units[k : k + 2], 'little', signed=True)}?" for k in range(0, len(units), 2)]
    return "".join(out)


def edited_rtf(data: bytes, edits: list[tuple[int, int, str]], tracked: bool = False) -> bytes:
    """An RTF file with edits (start, end, replacement) of its text put in where the signs stand; all else of it stays as it is.

    Tracked, what was is struck through and what is, underlined. Edits must not overlap and must lie in the text.
    """
    rtf = _Rtf(data)
    cuts: list[tuple[int, int, str]] = []
    for a, b, new in edits:
        if not 0 <= a <= b <= len(rtf.signs):
            raise ValueError("an edit lies outside the text")
        at = rtf.signs[a][1] if a < len(rtf.signs) else rtf.signs[-1][2] if rtf.signs else rtf.source.rfind("}")
        put = rtf_escaped(new)
        if tracked:
            old = "".join(c for c, *_ in rtf.signs[a:b])
            put = ("{\\strike " + rtf_escaped(old) + "}" if old else "") + ("{\\ul " + put + "}" if put else "")
        cuts.append((at, at, put))
        cuts += [(x, y, "") for _, x, y in rtf.signs[a:b]]
    source = rtf.source
    for x, y, put in sorted(cuts, key=lambda c: (c[0], c[1]), reverse=True):
        source = source[:x] + put + source[y:]
    return source.encode("latin-1")


def safe_archive(data: bytes, required: tuple[str, ...] = ()) -> str | None:
    """What is wrong with a zip archive, or None."""
    try:
        entries = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except zipfile.BadZipFile:
        return "no archive"
    if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_TOTAL or any(e.file_size > MAX_ENTRY for e in entries):
        return "too large"
    if any(e.flag_bits & 1 for e in entries):
        return "encrypted"
    if any(e.filename.startswith(("/", "\\")) or ".." in e.filename.replace("\\", "/").split("/") for e in entries):
        return "unsafe path"
    return None if set(required) <= {e.filename for e in entries} else "incomplete"


def from_docx(data: bytes) -> str:
    """Paragraphs of a DOCX file in the order of its body, tables included, then of its headers and footers; blank ones left out."""
    if problem := safe_archive(data, ("word/document.xml",)):
        raise ValueError(problem)
    archive = zipfile.ZipFile(io.BytesIO(data))
    parts = ["word/document.xml", *sorted(n for n in archive.namelist() if re.fullmatch(r"word/(?:header|footer)\d*\.xml", n))]
    lines: list[str] = []
    seen: set[str] = set()  # headers and footers repeat from section to section
    for part in parts:
        for p in ElementTree.fromstring(archive.read(part)).iter(f"{_WORD}p"):
            text = "".join((n.text or "") if n.tag == f"{_WORD}t" else "\t" if n.tag == f"{_WORD}tab" else "\n" if n.tag == f"{_WORD}br" else "" for n in p.iter()).strip()
            if text and (part == parts[0] or text not in seen):
                lines.append(text)
                seen.add(text)
    return "\n".join(lines)


def parsed(name: str, data: bytes) -> tuple[str | None, str]:
    """(text, status) of a file by its extension; unknown ones are tried as text. Status is ok or what went wrong."""
    kind = name.rsplit(".", 1)[-1].lower()
    try:
        if kind == "rtf":
            return from_rtf(data), "ok"
        if kind == "docx":
            return from_docx(data), "ok"
        if kind in ("pdf", "png", "jpg", "jpeg", "doc"):
            return None, "needs_adapter"
        return without_markup(decoded(data)), "ok"
    except (ValueError, ElementTree.ParseError, KeyError, LookupError) as error:
        return None, f"failed: {error}"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """source_name, file_type, text, parse_status of the files below a path. A file that can't be read has a null text and says why."""
    ship(spark)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.column(0).to_pylist()
        done = [parsed(n, d) for n, d in zip(names, batch.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array([n.rsplit("/", 1)[-1] for n in names]), pa.array([n.rsplit(".", 1)[-1].lower() for n in names]), pa.array([t for t, _ in done], pa.string()), pa.array([s for _, s in done])], names=["source_name", "file_type", "text", "parse_status"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return map_arrow(files.select("path", "content"), lambda: work, "source_name string, file_type string, text string, parse_status string")


def stripped(docs: DataFrame) -> DataFrame:
    """doc_id, text of documents without markup."""
    ship(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else without_markup(t) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), lambda: work, "doc_id bigint, text string")
