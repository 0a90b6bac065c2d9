"""Consistency rules of scenarios: what a text says in one place held against what it says in another.

Rules about amounts, parties to contracts and duties are business rules and are left out.
"""

from __future__ import annotations

import datetime
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masks import Page, Stretches
from ..functions.text import texts_of
from ..session import map_arrow, ship, spread

Span = tuple[int, int]

# Patterns of the structures that the rules read.
_REFERENCES = re.compile(r"^[ \t]*(?:#{1,6}[ \t]+)?(?:参考文献|References)[:：]?[ \t\r]*$", re.I | re.M)
_ENTRY = re.compile(r"[ \t]*\[([1-9][0-9]{0,3})\][ \t]+\S[^\n]*")
_CITATION = re.compile(r"(?<![\[\]])\[([1-9][0-9]{0,3})\](?![\[\]])(?![ \t]*[\[(\]:=])")
_CUE = re.compile(r"(?:文献|参见|\bsee|\breferences?)[ \t]*\Z", re.I)
_NARRATIVE = re.compile(r"(?<![一-鿿])[一-鿿]{4,120}[ \t]*\Z")
_SUBJECT, _STATEMENT, _NO_CITATION = re.compile("研究|结果|实验|分析|证据|调查"), re.compile("表明|显示|证明|证实|发现|指出|提出|支持|验证"), re.compile("数组|矩阵|向量|索引|下标|元素|列表|编号|示例|假设|假定|占位")
_CAPTION = re.compile(r"^[ \t]*(图|表|Figure|Table)[ \t]*([1-9][0-9]{0,3})(?:([ \t]*[:：][ \t]*|[.][ \t]+|[ \t]+)\S[^\n]*)?", re.I | re.M)
_LOCAL = re.compile(r"本文(图|表)[ \t]*([1-9][0-9]{0,3})(?![0-9A-Za-z.(（\-])|(?<=\bsee )(Figure|Table)[ \t]+([1-9][0-9]{0,3})(?=[ \t]+in this (?:paper|document|report)\b)", re.I)
_MEANING = re.compile(r"[ \t]*(?:缩写|Abbreviation)[ \t]+([A-Z]{2,10})[ \t]*[:：][ \t]*([A-Za-z一-鿿][A-Za-z一-鿿 \t\-]{1,119}?)[ \t\r]*")
_PROJECT, _OWNER = re.compile(r"[ \t]*(?:项目|Project)[ \t]*[:：][ \t]*\S.*", re.I), re.compile(r"[ \t]*(?:负责人|Owner)[ \t]*[:：][ \t]*[^:：;；\r\n]{1,80}[ \t\r]*", re.I)
_DATED = re.compile(r"[ \t]*(开始日期|结束日期|Start date|End date)[ \t]*[:：][ \t]*([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日)[ \t\r]*", re.I)
_CLAUSE, _CLAUSE_NAMED = re.compile(r"^[ \t]*第([0-9]{1,3}|[零一二三四五六七八九十百]{1,6})条", re.M), re.compile(r"本合同第([0-9]{1,3}|[零一二三四五六七八九十百]{1,6})条")
_HEADLINE, _LEAD = re.compile(r"^[ \t]*标题[：:]([^\r\n]+)", re.M), re.compile(r"^[ \t]*导语[：:]([^\r\n]+)", re.M)
_COUNTED = re.compile(r"[ \t]*([^。！？，；：、（）()\n\d]{1,80}(?:造成|导致|共有|共|新增|新建))([0-9]{1,9})(人(?:受伤|死亡|失踪)|家企业|所学校|家医院|座桥梁)[。！]?\s*")
_UNSURE = re.compile("预计|预期|预测|估计|估算|计划|规划|拟|可能|或|将|有望|力争|争取|约|近|至少|至多|最多|不少于|不超过|超过|不足|未|不|没有|[零〇一二三四五六七八九十百千万亿两]+(?:年|月|日|家|所|座|人|个|次|项|台|辆)")
_DAY = r"([0-9]{4})(?:年|-)([0-9]{1,2})(?:月|-)([0-9]{1,2})日?"
_PUBLISHED, _RELATIVE = re.compile(r"^[ \t]*发布日期[：:][ \t]*" + _DAY + r"[ \t]*\r?$", re.M), re.compile(r"(今日|昨日|明日)[（(]" + _DAY + r"[）)]")
_TIME_BASIS = re.compile(r"(?:以|按)[^。！？\r\n]{1,60}(?:为|作为)(?:(?:叙述|叙事|时间|日期|报道)?基准|准)|(?:叙述|叙事|时间|日期)(?:基准|参照)[：:]")
_VAGUE = re.compile("据统计(?!局)|有数据显示")
_SOURCE = re.compile(r"(?:数据|统计|信息|消息|资料)(?:来自|来源于|来源[：:])[ \t]*[^\s，,。！？；;（）()：:]+|(?:^|[（(，,；;])[ \t]*来源[：:][ \t]*[^\s，,。！？；;（）()：:]+|(?:根据|据)[ \t]*[^，,。！？；;（）()\r\n]{1,60}(?:发布|公布|报告|调查|统计|数据)|(?:来自|出自)[^，,。！？；;（）()\r\n]{1,60}的(?:数据|统计|报告|调查)")
_RELEASE = r"([0-9]{1,6}(?:\.[0-9]{1,6}){0,2})"
_VERSIONS = re.compile(r"^[ \t]*支持版本[：:][ \t]*" + _RELEASE + r"[ \t]+-[ \t]+" + _RELEASE + r"[ \t]*\r?\n\s*?[ \t]*当前版本[：:][ \t]*" + _RELEASE + r"[ \t]*\r?$", re.M)
_STEPS, _STEP, _STEP_NAMED = re.compile(r"^[ \t]*操作步骤[：:][ \t]*\r?$", re.M), re.compile(r"^[ \t]*步骤([1-9][0-9]{0,3})[：:]", re.M), re.compile(r"(?:返回|转到|跳转到|参见)(步骤([1-9][0-9]{0,3}))")
_PARAMETERS, _EXAMPLE = re.compile(r"^[ \t]*参数定义[：:][ \t]*\r?$", re.M), re.compile(r"^[ \t]*示例[：:][ \t]*\r?$", re.M)
_PARAMETER = re.compile(r"[ \t]*`?([A-Za-z][A-Za-z0-9_]*)`?[：:][^\n]+")
_FENCED = re.compile(r"\s*```json[ \t]*\r?\n(?P<body>[^`]+)\r?\n```[ \t]*(?:\r?\n|$)")
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_KINDS = {"图": "figure", "figure": "figure", "表": "table", "table": "table"}


class Prose(Page):
    """A text that knows what is quoted, its lines, and the standard forms of the glossary."""

    def __init__(self, text: str, terms: frozenset[str] = frozenset()):
        super().__init__(text)
        self.terms = terms

    @cached_property
    def quoted(self) -> Stretches:
        spans = [m.span() for m in re.finditer(r'"[^"]*"|“[^“”]*”|‘[^‘’]*’|「[^「」]*」|(?m:^ {0,3}>)(?:[^\n]*\S[^\n]*(?:\n|\Z))+', self.text)]
        return Stretches(spans)

    def plain(self, start: int, end: int) -> bool:
        return not self.technical.touches(start, end) and not self.quoted.touches(start, end)

    def hits(self, pattern: re.Pattern) -> list[re.Match]:
        return [m for m in pattern.finditer(self.text) if self.plain(*m.span())]

    def blocks(self) -> Iterator[list[tuple[int, str]]]:
        """Runs of lines that follow each other without a blank one."""
        for block in re.finditer(r"(?:[^\n]*[^\s][^\n]*(?:\n|\Z))+", self.text):
            yield [(block.start() + m.start(), m[0]) for m in re.finditer(r"[^\n]+", block[0])]


def citations(page: Prose) -> Iterator[Span]:
    """Cited numbers that the only list of references, numbered throughout, lacks."""
    heads = page.hits(_REFERENCES)
    if len(heads) != 1:
        return
    entries = [_ENTRY.fullmatch(x) for x in page.text[heads[0].end() :].splitlines() if x.strip()]
    numbers = [m[1] for m in entries if m]
    if not entries or len(numbers) < len(entries) or len(set(numbers)) < len(numbers):
        return
    for m in _CITATION.finditer(page.text, 0, heads[0].start()):
        before = page.text[max(page.text.rfind("\n", 0, m.start()) + 1, m.start() - 160) : m.start()]
        told = _NARRATIVE.search(before)
        cited = _CUE.search(before) or (told and re.match(r"[ \t]*[。！？.!?]", page.text[m.end() :]) and _SUBJECT.search(told[0]) and _STATEMENT.search(told[0]) and not _NO_CITATION.search(told[0]))
        if cited and m[1] not in numbers and page.plain(*m.span()):
            yield m.span()


def captions(page: Prose) -> Iterator[Span]:
    """Figures and tables of this text that have no caption, where captions of their kind are clear."""
    seen: dict[str, Counter] = {"figure": Counter(), "table": Counter()}
    unclear = set()
    for m in page.hits(_CAPTION):
        kind = _KINDS[m[1].lower()]
        seen[kind][m[2]] += 1
        if m[3] is None or seen[kind][m[2]] > 1:
            unclear.add(kind)
    for m in page.hits(_LOCAL):
        kind, number = _KINDS[(m[1] or m[3]).lower()], m[2] or m[4]
        if kind not in unclear and seen[kind] and number not in seen[kind]:
            yield m.span()


def abbreviations(page: Prose) -> Iterator[Span]:
    """Meanings that differ from the one before for the same abbreviation and language, in lines that follow each other."""
    for block in page.blocks():
        known: dict[tuple[str, bool], str] = {}
        for at, line in block:
            m = _MEANING.fullmatch(line)
            if not m or not page.plain(at, at + len(line)) or re.search(r"或|又称|亦称|\b(?:or|aka|also)\b", m[2], re.I):
                known = {}
                continue
            meaning = " ".join(m[2].casefold().split())
            if page.terms & {m[1].casefold(), meaning}:
                known = {}
                continue
            latin, han = bool(re.search("[a-z]", meaning)), bool(re.search("[一-鿿]", meaning))
            if latin != han:
                if known.get((m[1], han), meaning) != meaning:
                    yield at + m.start(2), at + m.end(2)
                known[m[1], han] = meaning


def _day(*parts: str) -> datetime.date | None:
    try:
        return datetime.date(*map(int, parts))
    except ValueError:
        return None


def date_order(page: Prose) -> Iterator[Span]:
    """End dates before the start date of their project's block."""
    for block in page.blocks():
        starts = [k for k, (at, x) in enumerate(block) if _PROJECT.fullmatch(x) and page.plain(at, at + len(x))]
        for a, b in zip(starts, [*starts[1:], len(block)]):
            found: dict[str, tuple[datetime.date, int, int]] = {}
            for at, line in block[a + 1 : b]:
                m = _DATED.fullmatch(line)
                if not m and _OWNER.fullmatch(line):
                    continue
                day = _day(*re.findall(r"\d+", m[2])) if m else None
                side = "start" if m and m[1].lower() in ("开始日期", "start date") else "end"
                if day is None or side in found or not page.plain(at, at + len(line)):
                    found = {}
                    break
                found[side] = (day, at + m.start(2), at + m.end(2))
            if len(found) == 2 and found["start"][0] > found["end"][0]:
                yield found["end"][1:]


def numeral(s: str) -> int | None:
    """A number below 1000 in digits, or in Chinese signs written in the usual way; else None."""
    if s.isascii():
        return int(s) if s.isdigit() and s[0] != "0" else None
    m = re.fullmatch("(?:([一二三四五六七八九])百(?:零(?=[一二三四五六七八九]$))?)?(?:([一二三四五六七八九])?(十))?([一二三四五六七八九])?", s)
    if not m or (m[1] and not m[3] and m[4] and "零" not in s) or (m[1] and m[3] and not m[2]):
        return None
    digit = lambda c: "零一二三四五六七八九".index(c) if c else 0
    return digit(m[1]) * 100 + (digit(m[2]) or 1) * bool(m[3]) * 10 + digit(m[4]) or None


def clauses(page: Prose) -> Iterator[Span]:
    """Clauses of this contract that are named but have no heading, where all headings can be read and differ."""
    heads = [numeral(m[1]) for m in page.hits(_CLAUSE)]
    if not heads or None in heads or len(set(heads)) < len(heads) or re.search("摘录|节选|示例|模板", page.text):
        return
    for sentence in re.finditer(r"[^。！？\r\n]+", page.text):
        if not re.search("《|》|协议|附件|其他|另", sentence[0]):
            for m in _CLAUSE_NAMED.finditer(sentence[0]):
                a, b = sentence.start() + m.start(), sentence.start() + m.end()
                if (n := numeral(m[1])) is not None and n not in heads and page.plain(a, b):
                    yield a, b


def headline(page: Prose) -> Iterator[Span]:
    """The count of a lead that says otherwise than the headline about the same event."""
    heads, leads = page.hits(_HEADLINE), page.hits(_LEAD)
    if len(heads) == len(leads) == 1:
        a, b = _COUNTED.fullmatch(heads[0][1]), _COUNTED.fullmatch(leads[0][1])
        if a and b and a[1].strip() == b[1].strip() and a[3] == b[3] and int(a[2]) != int(b[2]) and not _UNSURE.search(a[1]):
            yield leads[0].start(1) + b.start(2), leads[0].start(1) + b.end(2)


def relative_dates(page: Prose) -> Iterator[Span]:
    """Days named relative to the only date of publication whose date is another."""
    anchors = page.hits(_PUBLISHED)
    day = _day(*anchors[0].groups()) if len(anchors) == 1 and not page.hits(_TIME_BASIS) else None
    if day:
        for m in page.hits(_RELATIVE):
            told = _day(*m.groups()[1:])
            if told and told != day + datetime.timedelta({"今日": 0, "昨日": -1, "明日": 1}[m[1]]):
                yield m.span()


def vague_sources(page: Prose) -> Iterator[Span]:
    """Figures quoted without a source in their sentence."""
    for s in re.finditer(r"[^。！？\r\n]+", page.text):
        if _VAGUE.search(s[0]) and page.plain(*s.span()) and not _SOURCE.search(_VAGUE.sub("", s[0])):
            yield from ((s.start() + m.start(), s.start() + m.end()) for m in _VAGUE.finditer(s[0]))


def versions(page: Prose) -> Iterator[Span]:
    """A current version outside the supported range on the line above."""
    if page.text.count("支持版本") == page.text.count("当前版本") == 1:
        for m in page.hits(_VERSIONS):
            low, high, now = ([*map(int, v.split(".")), 0, 0][:3] for v in m.groups())
            if low <= high and not low <= now <= high:
                yield m.span(3)


def steps(page: Prose) -> Iterator[Span]:
    """Named steps beyond the last of the only sequence of steps, numbered from one throughout; a step before the heading ends the rule."""
    heads = page.hits(_STEPS)
    if len(heads) != 1 or re.search("摘录|节选|示例流程", page.text):
        return
    begin = heads[0].end()
    if not all(_STEP.match(x) for x in page.text[begin:].splitlines() if x.strip()):
        return
    found = page.hits(_STEP)
    if len(found) < 2 or found[0].start() < begin or [int(m[1]) for m in found] != [*range(1, len(found) + 1)]:
        return
    for m in page.hits(_STEP_NAMED):
        if m.start() > begin and int(m[2]) > len(found):
            yield m.span(1)


def _alike(name: str) -> str:
    return name.lower().replace("_", "")


def parameters(page: Prose) -> Iterator[Span]:
    """Keys of the only example, a flat object, that differ from a defined parameter in case or underscores only. The example is technical text."""
    defined, shown = page.hits(_PARAMETERS), page.hits(_EXAMPLE)
    if len(defined) != 1 or len(shown) != 1 or defined[0].end() >= shown[0].start():
        return
    lines = [_PARAMETER.fullmatch(x) for x in page.text[defined[0].end() : shown[0].start()].strip().splitlines()]
    block = _FENCED.match(page.text, shown[0].end())
    if not lines or not all(lines) or not block:
        return
    names = {_alike(m[1]): m[1] for m in lines}
    body, at = block["body"], block.start("body")
    outside = _STRING.sub("", body).strip()
    if len(names) < len(lines) or outside[:1] != "{" or outside[-1:] != "}" or re.search(r"[\"{}\[\]]", outside[1:-1]):
        return
    try:
        keys = [k for k, _ in json.loads(body, object_pairs_hook=list)]
    except ValueError:
        return
    if len(keys) > len(set(keys)):
        return
    for m in _STRING.finditer(body):
        key = m[0][1:-1]
        if re.fullmatch("[A-Za-z][A-Za-z0-9_]*", key) and re.match(r"\s*:", body[m.end() :]) and names.get(_alike(key), key) != key:
            yield at + m.start() + 1, at + m.end() - 1


#: scenario -> (rule, whether it needs the whole structure of a plain text, severity, confidence, function)
RULES: dict[str, tuple[tuple[str, bool, str, float, Callable[[Prose], Iterator[Span]]], ...]] = {
    "academic": (("citation_reference", True, "warning", 0.85, citations), ("caption_reference", True, "warning", 0.85, captions), ("abbreviation_definition", False, "warning", 0.85, abbreviations)),
    "business": (("date_order", False, "warning", 0.85, date_order),),
    "legal": (("missing_clause", True, "warning", 0.85, clauses),),
    "news": (("headline_count", False, "warning", 0.85, headline), ("relative_date", False, "warning", 0.85, relative_dates), ("vague_source", False, "info", 0.7, vague_sources)),
    "technical": (("parameter_spelling", False, "warning", 0.85, parameters), ("version_range", False, "warning", 0.85, versions), ("missing_step", True, "warning", 0.85, steps)),
}
COMPLETE_TYPES = ("txt", "md", "markdown")


def scenario_findings(text: str, scenario: str, complete: bool, terms: frozenset[str] = frozenset()) -> list[tuple[int, int, str, str, float]]:
    """(start, end, rule_id, severity, confidence) in order, each once."""
    own = RULES.get(scenario, ())
    if not own or not text.strip():
        return []
    page = Prose(text, terms)
    return sorted({(a, b, f"scenario.{scenario}.{name}", severity, sure) for name, whole, severity, sure, f in own if complete or not whole for a, b in f(page)})


def scenario_issues(docs: DataFrame, terms: tuple[str, ...] = (), doc_id: str = "doc_id") -> DataFrame:
    """doc_id, rule_id, severity, confidence, start, end, original, context of the scenario rules of each document; columns text, scenario, file_type.

    terms are standard forms of a glossary. Null and unknown scenarios have no rules; null and blank texts no issues.
    """
    ship(docs.sparkSession)
    standard = frozenset(t.strip().casefold() for t in terms if t.strip())

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts, scenarios, types = batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        rows = [(d, r, v, c, a, b, t[a:b], t[max(0, a - 40) : b + 40]) for d, t, s, k in zip(ids, texts, scenarios, types) for a, b, r, v, c in scenario_findings(t, s or "", (k or "").lower() in COMPLETE_TYPES, standard)]
        columns = list(zip(*rows)) if rows else [[]] * 8
        kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "rule_id", "severity", "confidence", "start", "end", "original", "context"])

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), "text", "scenario", "file_type").where(F.col("scenario").isin(*RULES))
    return map_arrow(spread(source), lambda: work, "doc_id bigint, rule_id string, severity string, confidence double, start int, end int, original string, context string")


def skipped_rules(docs: DataFrame) -> DataFrame:
    """doc_id, rule_id: rules of a document's scenario that need a structure its file type doesn't keep; a broadcast of the rule table."""
    rules = [(s, f"scenario.{s}.{name}") for s, own in RULES.items() for name, whole, *_ in own if whole]
    table = docs.sparkSession.createDataFrame(rules, "scenario string, rule_id string")
    return docs.where(~F.coalesce(F.lower("file_type").isin(*COMPLETE_TYPES), F.lit(False))).select("doc_id", "scenario").join(F.broadcast(table), "scenario").select("doc_id", "rule_id")
