"""Sentence units in many scripts: boundary rules compiled into a finite transducer, run over text in blocks by a parallel prefix scan."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import code_points, texts_of
from ..session import cut, map_arrow, ship, spread

# Symbols of the input alphabet
OTHER, UPPER, LOWER, DIGIT, SPACE, LINE, DOT, GLUED, MARK, FULL, OPEN, CLOSE, KEEP, STRAY, THAI, PUNCT, LETTER = range(17)
SYMBOLS = 17

# Written abbreviations of the languages handled.
#: Never the end of a sentence: titles and words that announce what follows.
LEADING = "Dr Mr Mrs Ms Prof Hon Rev St Sr Sra Srta Dña M MM Mme Mlle Hr Fr Hrn Dipl Ing г гр см См ср Ср т е д п ул пр пер кв стр рис табл гл им обл vs cf Cf approx ca ca bzw vgl Vgl siehe z B b h u d i e g viz incl inkl zzgl"
#: Not the end where a number or a code follows.
NUMBERED = "no No nos Nos nr Nr n fig Fig figs Figs Abb abb Tab tab sec Sec sect Sect p pp P S pág págs Pág art Art vol Vol Vols ch Ch chap Chap cap Cap Kap ed tel Tel Tél tél ext Apt apt Bd núm Núm Eq eq Nr"
#: End a sentence where a capital follows.
TRAILING = "a.m p.m A.M P.M Ltd Inc Co Corp etc usw Jr excl exkl"

_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
_LEADING, _NUMBERED = frozenset(LEADING.split()), frozenset(NUMBERED.split())
#: A short word or number with a full stop that white space follows.
_SHORT = re.compile(r"\b([^\W\d_]{1,6}|\d{1,3})\.(?=[^\S\n])")
_NUMBER_NEXT = re.compile(r"\s*\(?\+?(?:\d|[A-Z]{1,3}-?\d|[ivxlIVXL]+\b)")
_NAME_NEXT = re.compile(r"\s?[A-ZÀ-ÖØ-ÞА-ЯЁ](?:[^\W\d_]|\.)")
_MONTH_NEXT = re.compile(rf"\s(?:{_MONTHS})\b")
_MARKER = re.compile(r"(?m:^)[ \t　]*\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,5})\.(?=\s)")
#: A full stop without white space before a capital.
_CAPITAL_NEXT = re.compile(r"\.(?=[“\"«(]?[A-ZÀ-ÖØ-ÞА-ЯЁ](?:[^\W\d_]|[ ’']))")
_MAIL_TAIL, _MAIL_HEAD = re.compile(r"[@＠]\s?\S*$"), re.compile(r"\.[\w.+-]*[@＠]")


def _inner(text: str, m: re.Match) -> bool:
    """Whether the full stop of a short word or number belongs to it."""
    word, at = m.group(1), m.end()
    if word in _LEADING:
        return True
    if word in _NUMBERED:
        return bool(_NUMBER_NEXT.match(text, at))
    if word.isdecimal():
        return bool(_MONTH_NEXT.match(text, at))
    return len(word) == 1 and word.isupper() and bool(_NAME_NEXT.match(text, at))


_PAIRS = [re.compile(p) for p in (r"“[^“”\n]*”", r"„[^„“”\n]*[“”]", r"«[^«»\n]*»", r"「[^「」\n]*」", r"『[^『』\n]*』", r'"[^"\n]*"', r"‹[^‹›\n]*›")]
_BRACKETS = [re.compile(p) for p in (r"\([^()\n]*\)", r"（[^（）\n]*）", r"\[[^\[\]\n]*\]", r"【[^【】\n]*】")]
#: What goes on with the sentence right after a closed quotation.
_GOES_ON = re.compile(r"[^\S\n]*(?:と|って|とは|라고|이라고|라며|하고|고 |는 |[,，、;；:：]|[—–-][ ]|[a-zß-öø-ÿа-яё])")
#: A named speaker after a quotation that opens its sentence. Verbs of saying.
_SPEAKER = re.compile(r"[^。！？!?\n“”「」：:，]{1,24}?(?:问道|说道|答道|回答|喊道|写道|问|说|道)[。！？!?，.]")
_CJK = r"぀-ヿ㐀-䶿一-鿿豈-﫿"
_CJK_MARK = re.compile(rf"(?<=[{_CJK}）」』”])(?:\.(?![.\w@]|[A-Za-z0-9])|(?<!\.)\.(?=[{_CJK}“（「])|[!?])")
@cache
def _table() -> np.ndarray:
    """Symbol of every code point on its own."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x30000):
        if 0xD800 <= cp < 0xE000:
            continue
        c, kind = chr(cp), unicodedata.category(chr(cp))
        if c.isspace():
            out[cp] = SPACE
        elif 0xE01 <= cp <= 0xE3A or 0xE40 <= cp <= 0xE4E:
            out[cp] = THAI
        elif kind == "Nd":
            out[cp] = DIGIT
        elif kind in ("Lu", "Lt"):
            out[cp] = UPPER
        elif kind == "Ll":
            out[cp] = LOWER
        elif kind in ("Lo", "Lm"):
            out[cp] = LETTER
        elif kind[0] == "P" or c in "=+<>|~":
            out[cp] = PUNCT
    for chars, symbol in (("\n\r\v\f\x1c\x1d\x1e\x85  ", LINE), (".", DOT), ("!?", MARK), ("。！？｡", FULL), ("”’»›」』)]）】", STRAY), ("¿¡“„«‹「『\"(（[【《#@", UPPER), ("　", SPACE)):
        out[[ord(c) for c in chars]] = symbol
    return out


def symbols(text: str, base: np.ndarray) -> np.ndarray:
    """The text as transducer input: the code points' own symbols, changed where tokens, quotations and brackets say so."""
    if "." in text:
        for m in _CAPITAL_NEXT.finditer(text):
            k = m.start()
            before = text[k - 1 : k]
            if (before.islower() or before in ")]\"”»" or (before.isupper() and text[k + 2 : k + 3].isupper())) and not _MAIL_TAIL.search(text, max(0, k - 40), k) and not _MAIL_HEAD.match(text, k):
                base[k] = GLUED
        for m in _SHORT.finditer(text):
            if _inner(text, m):
                base[m.end() - 1] = OTHER
        for m in _MARKER.finditer(text):
            base[m.end() - 1] = OTHER
    if any(c in text for c in ".!?"):
        for m in _CJK_MARK.finditer(text):
            if base[m.start()] != OTHER:
                base[m.start()] = FULL
    for pattern in _PAIRS:
        if pattern.pattern[0] in text:
            for m in pattern.finditer(text):
                a, b = m.start(), m.end()
                base[a] = OPEN
                k = a - 1
                while k >= 0 and base[k] == SPACE:
                    k -= 1
                opens = k < 0 or base[k] in (LINE, FULL, DOT, MARK, CLOSE, STRAY, GLUED)
                goes_on = _GOES_ON.match(text, b) or (opens and _SPEAKER.match(text, b))
                base[b - 1] = KEEP if goes_on else CLOSE
    for pattern in _BRACKETS:
        if pattern.pattern[1 if pattern.pattern[0] == "\\" else 0] in text:
            for m in pattern.finditer(text):
                base[m.start()], base[m.end() - 1] = OPEN, CLOSE
    return base


def _step(state: tuple[int, str], c: int) -> tuple[tuple[int, str], bool]:
    """One move of the transducer: (depth of quotation, what is pending) and a symbol to the next state and whether a unit begins here.

    Pending: '' nothing, '.' '!' '。' after a mark, '. ' '! ' also after white space, 'x' after a full stop that a capital follows
    directly, 'n' at a line's start, 't' after a Thai letter, 't ' after white space behind one.
    """
    depth, pending = state
    if c == LINE:
        return (0, "n"), False
    if depth:
        if c in (CLOSE, KEEP):
            return (depth - 1, pending if depth == 1 and c == CLOSE and pending in (".", "!", "。") else ""), False
        if c == OPEN:
            return (min(2, depth + 1), ""), False
        if c in (DOT, MARK, FULL):
            return (depth, {DOT: ".", MARK: "!", FULL: "。"}[c]), False
        return (depth, pending if c in (SPACE, STRAY) else ""), False
    begins = False
    if c == SPACE:
        return (0, {".": ". ", "!": "! ", "t": "t ", "": ""}.get(pending, pending)), False
    if pending == "n":
        begins = True
    elif pending == "x":
        begins = c not in (STRAY, CLOSE, KEEP)
    elif pending == "。":
        begins = c not in (STRAY, CLOSE, KEEP, PUNCT, DOT, MARK, FULL, GLUED)
    elif pending in (". ", "! "):
        begins = c in (UPPER, DIGIT, OPEN, THAI, LETTER, OTHER)
    elif pending == "!":
        begins = c in (UPPER, LETTER, OPEN, THAI)
    elif pending == "t ":
        begins = c == THAI
    if c == OPEN:
        return (1, ""), begins
    if c in (DOT, MARK, FULL, GLUED):
        strongest = "。" if pending == "。" and not begins else {DOT: ".", MARK: "!", FULL: "。", GLUED: "x"}[c]
        return (0, "!" if pending in ("!", "! ") and c == DOT else strongest), begins
    if c in (STRAY, CLOSE) and pending in (".", "!", "。", "x"):
        return (0, pending), False
    return (0, "t" if c == THAI else ""), begins


@cache
def compiled() -> tuple[np.ndarray, np.ndarray, int]:
    """(next state, unit begins, start) of the transducer as tables indexed by symbol * states + state."""
    first = (0, "n")
    states, todo = {first: 0}, [first]
    moves = {}
    while todo:
        s = todo.pop()
        for c in range(SYMBOLS):
            to, begins = _step(s, c)
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            moves[s, c] = (to, begins)
    n = len(states)
    nexts, begin = np.zeros(SYMBOLS * n, np.intp), np.zeros(SYMBOLS * n, bool)
    for (s, c), (to, begins) in moves.items():
        nexts[c * n + states[s]], begin[c * n + states[s]] = states[to], begins
    return nexts, begin, 0


def run(symbols_: np.ndarray, block: int = 256, first: int | None = None) -> np.ndarray:
    """Places where units begin, from a first state on. The input is cut into blocks; each block becomes a function from state to state, the functions
    are composed by a prefix scan of doubling steps, and each block is then run from its own first state."""
    nexts, begin, start = compiled()
    first = start if first is None else first
    n = len(nexts) // SYMBOLS
    size = len(symbols_)
    if not size:
        return np.zeros(0, np.int64)
    rows = -(-size // block)
    grid = np.full(rows * block, SPACE, np.intp)
    grid[:size] = symbols_
    grid = np.ascontiguousarray(grid.reshape(rows, block).T) * n
    states = np.full(rows, first)
    if rows > 1:
        functions = np.tile(np.arange(n), (rows, 1))
        for column in grid:
            functions = nexts[functions + column[:, None]]
        step = 1
        while step < rows:  # after it, function k leads from the start of the text to the end of block k
            functions[step:] = np.take_along_axis(functions[step:], functions[:-step], axis=1)
            step *= 2
        states[1:] = functions[:-1, first]
    out = np.zeros((block, rows), bool)
    for k, column in enumerate(grid):
        at = states + column
        out[k] = begin[at]
        states = nexts[at]
    return np.flatnonzero(out.T.reshape(-1)[:size])


def function_of(symbols_: np.ndarray, block: int = 256) -> np.ndarray:
    """The state that a stretch of input leads to from each state, composed of those of its blocks by halves."""
    nexts, _, _ = compiled()
    n = len(nexts) // SYMBOLS
    full, rest = len(symbols_) // block, len(symbols_) % block
    out = np.arange(n)
    if full:
        grid = np.ascontiguousarray(symbols_[: full * block].astype(np.intp).reshape(full, block).T) * n
        functions = np.tile(np.arange(n), (full, 1))
        for column in grid:
            functions = nexts[functions + column[:, None]]
        while len(functions) > 1:
            half = len(functions) // 2
            joined = np.take_along_axis(functions[1 : 2 * half : 2], functions[0 : 2 * half : 2], axis=1)
            functions = np.concatenate([joined, functions[2 * half :]])
        out = functions[0]
    for c in symbols_[len(symbols_) - rest :]:
        out = nexts[out + int(c) * n]
    return out


def units_of(texts: list[str]) -> list[list[tuple[int, int]]]:
    """(start, end) of the sentence units of each text, trimmed of white space."""
    points, bounds = code_points([t + "\n" for t in texts])
    base = _table()[points]
    for t, a in zip(texts, bounds):
        symbols(t, base[a : a + len(t)])
    begins = run(base)
    cut = np.searchsorted(begins, bounds)
    out = []
    for k, t in enumerate(texts):
        starts = (begins[cut[k] : cut[k + 1]] - bounds[k]).tolist()
        own = []
        for a, b in zip(starts, [*starts[1:], len(t)]):
            piece = t[a:b]
            end = a + len(piece.rstrip())
            a += len(piece) - len(piece.lstrip())
            if end > a:
                own.append((a, end))
        out.append(own)
    return out


def sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sent_no, sent_start, sent_end of every sentence unit, white space trimmed at both ends.

    A line break always ends a unit, and a line without marks is one. Null, empty and blank texts have no units; repeated rows repeat
    theirs. One narrow pass; of the input only the positions leave it. Texts of more than LONG signs are dealt to many tasks in chunks.
    """
    source = spread(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    return _units(source.where(F.length("text") <= LONG)).unionByName(long_units(source.where(F.length("text") > LONG)))


#: Signs of a text from which it is read in chunks by many tasks, of a chunk, and of the text on either side of a chunk by which its edges are read.
LONG, CHUNK, EDGE = 2_000_000, 200_000, 1_000


def chunked(text: str, chunk: int = CHUNK) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text: each ends behind its last line break, or where it has none, after `chunk` signs."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + chunk)
        if end < len(text):
            at = text.rfind("\n", start, end)
            end = at + 1 if at >= 0 else end
        out.append((start, end))
        start = end
    return out


def _chunk_symbols(piece: str, low: int, high: int) -> np.ndarray:
    """The input of a chunk [low, high) of a piece of text, read with what stands around it."""
    return symbols(piece, _table()[code_points([piece])[0]])[low:high]


def long_units(source: DataFrame, chunk: int = CHUNK, edge: int = EDGE) -> DataFrame:
    """The units of texts in chunks that many tasks read.

    Each chunk becomes the function from state to state that the transducer is on it; the functions of a text, some forty numbers each, are composed in the order of the
    chunks, which gives each its first state; from there the chunk is read again for its units. A unit that goes on over an edge is put together
    from what the chunks say of their ends. A text twice in the table has its units twice.
    """
    ship(source.sparkSession)
    numbered = source.withColumn("copy", F.monotonically_increasing_id())

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for d, t, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for n, (a, b) in enumerate(chunked(t, chunk)):
                low, high = max(0, a - edge), min(len(t), b + edge)
                rows.append((d, c, n, a, a - low, b - low, t[low:high]))
        columns = list(zip(*rows)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["doc_id", "copy", "chunk", "at", "low", "high", "piece"])

    pieces = cut(map_arrow(numbered.select("doc_id", "text", "copy"), lambda: deal, "doc_id bigint, copy bigint, chunk int, at bigint, low int, high int, piece string").repartition("copy", "chunk"))

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = [function_of(_chunk_symbols(p, a, b)).tolist() for p, a, b in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.list_(pa.int32()))], names=["copy", "chunk", "f"])

    functions = map_arrow(pieces.select("copy", "chunk", "piece", "low", "high"), lambda: function, "copy bigint, chunk int, f array<int>")
    ordered = functions.groupBy("copy").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "f"))), lambda x: x["f"]).alias("fs"))
    states = F.aggregate("fs", F.array(F.lit(compiled()[2])), lambda acc, f: F.concat(acc, F.array(F.get(f, F.element_at(acc, -1)))))
    first = ordered.select("copy", F.posexplode(states).alias("chunk", "state"))

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for d, c, n, at, low, high, piece, state in zip(*(batch.column(k).to_pylist() for k in range(8))):
            begins = run(_chunk_symbols(piece, low, high), first=state).tolist()
            body = piece[low:high]
            stop = lambda a, b, body=body: a + len(body[a:b].rstrip())
            lead = stop(0, begins[0] if begins else len(body))
            own = [(at + a + len(body[a:b]) - len(body[a:b].lstrip()), at + stop(a, b)) for a, b in zip(begins, begins[1:])]
            last = begins[-1] if begins else None
            begin = None if last is None else at + last + len(body[last:]) - len(body[last:].lstrip())
            rows.append((d, c, n, [{"start": a, "end": b} for a, b in own if b > a], at + lead if lead else None, begin, None if last is None else at + stop(last, len(body))))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int32(), span, pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*rows)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "copy", "chunk", "own", "lead", "begin", "open"])

    told = cut(map_arrow(pieces.join(first, ["copy", "chunk"]).select("doc_id", "copy", "chunk", "at", "low", "high", "piece", "state"), lambda: read, "doc_id bigint, copy bigint, chunk int, own array<struct<start:bigint,end:bigint>>, lead bigint, begin bigint, open bigint"))
    # a unit open at a chunk's end goes on through the leads of the chunks after it, up to and with the next in which one begins
    order = Window.partitionBy("copy").orderBy("chunk")
    run_no = F.sum(F.col("begin").isNotNull().cast("int")).over(order)
    marked = told.select("doc_id", "copy", "chunk", "lead", "begin", "open", run_no.alias("run"), (run_no - F.col("begin").isNotNull().cast("int")).alias("before"))
    opened = marked.where("begin is not null").select("doc_id", "copy", "run", "begin", "open")
    leads = marked.where("lead is not null").groupBy("copy", F.col("before").alias("run")).agg(F.max("lead").alias("lead"))
    across = opened.join(leads, ["copy", "run"], "left").select("doc_id", "copy", F.col("begin").alias("start"), F.greatest("open", F.coalesce("lead", F.col("open"))).alias("end")).where("end > start")
    within = told.select("doc_id", "copy", F.explode("own").alias("u")).select("doc_id", "copy", "u.start", "u.end")
    number = F.row_number().over(Window.partitionBy("copy").orderBy("start")) - 1
    return within.unionByName(across).select("doc_id", number.cast("int").alias("sent_no"), F.col("start").cast("int").alias("sent_start"), F.col("end").cast("int").alias("sent_end"))


def _units(source: DataFrame) -> DataFrame:
    ship(source.sparkSession)
    schema = "doc_id bigint, sent_no int, sent_start int, sent_end int"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
        columns: list[list[int]] = [[], [], [], []]
        k = 0
        while k < len(texts):
            to, room = k, 400_000
            while to < len(texts) and (to == k or room > len(texts[to])):
                room -= len(texts[to])
                to += 1
            for d, own in zip(ids[k:to], units_of(texts[k:to])):
                columns[0] += [d] * len(own)
                columns[1] += range(len(own))
                columns[2] += [a for a, _ in own]
                columns[3] += [b for _, b in own]
            k = to
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "sent_no", "sent_start", "sent_end"])

    return map_arrow(source, lambda: work, schema)


#: Ids of asked documents that are broadcast at most (8 bytes each); more are joined by a shuffle.
MOST_ASKED = 4_000_000


def asked_sentences(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """doc_id, sent_start, sent_end of the documents that have a task. Repeated tasks count once; tasks of unknown documents yield nothing.

    The ids are counted first: up to MOST_ASKED of them go to the texts; with more, texts and ids meet by a shuffle.
    """
    asked = cut(tasks.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct())
    source = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    own = source.join(F.broadcast(asked) if asked.count() <= MOST_ASKED else asked, "doc_id", "left_semi")
    return _units(own.where(F.length("text") <= LONG)).unionByName(long_units(own.where(F.length("text") > LONG))).select("doc_id", "sent_start", "sent_end")
