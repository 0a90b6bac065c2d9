"""Personal data in free text: a semi-Markov conditional random field over bounded segments; dynamic programming chooses boundaries and types jointly."""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from functools import cache
from math import exp, inf, log, sqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import texts_of
from ..session import map_arrow, ship, spread

TYPES = ("email", "phone", "id_number", "address", "name")
#: Longest span of any type, in characters: the bound of the segments.
LONGEST = 120

# ---------------------------------------------------------------------------------------------------------------- candidates
_D, _H = "[0-9０-９]", "[一-鿿]"
_N = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:[-’'][A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+)*"
_EDGE, _NO_DIGIT = r"(?<![0-9A-Za-z０-９+.\-/_@])", r"(?![0-9０-９]|[\-./]\d|[A-Za-z_])"
_S = r"[  .\-－]?"


def _numbers(name: str, body: str) -> tuple[str, re.Pattern]:
    return name, re.compile(_EDGE + body + _NO_DIGIT)


#: Shapes of numbers that may be personal.
_SHAPES = [
    _numbers("mobile_cn", rf"(?:[(（]?[+＋][8８][6６][)）]?{_S})?[1１][3-9３-９]{_D}{_S}{_D}{{4}}{_S}{_D}{{4}}"),
    _numbers("nanp", r"(?:\+?1[ .\-])?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}"),
    _numbers("trunk", r"(?:\+44 ?(?:\(0\) ?)?|0)\d{2,4} \d{3,4} \d{4}"),
    _numbers("slash", r"(?:\+49 ?(?:\(0\) ?)?|0)\d{2,4}[ /]\d{3,6}(?:[ \-]\d{1,4})?"),
    _numbers("pairs", r"(?<![0-9A-Fa-f]{2} )(?:\+33 ?(?:\(0\) ?)?|0)[1-9](?:[ .]\d{2}){4}(?! [0-9A-Fa-f]{2}\b)"),
    _numbers("plus", r"\+\d{1,3}(?:[ .\-]\(?\d{1,5}\)?){2,5}"),
    _numbers("resident", r"\d{6}[ \-]?(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ \-]?\d{3}[\dXx]"),
    _numbers("social", r"\d{3}[ \-]\d{2}[ \-]\d{4}"),
    _numbers("letters", r"[A-Z]{2}\d{6,8}[A-Z]?"),
]
_MAIL_MARK = re.compile(r"[@＠]|[  ]?[(\[{](?:at|AT)[)\]}][  ]?")
_LOCAL, _HOST = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*\Z"), re.compile(r"[A-Za-z0-9\-]+(?:(?:\.|[ ]?[(\[](?:dot|DOT)[)\]][ ]?)[A-Za-z0-9\-]*[A-Za-z0-9])+")
#: Titles before a name, and words that name a street.
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Hr|Fr|M|Mme|Mlle|Monsieur|Madame|Sr|Sra|Srta|Don|Doña|Señor|Señora"
_EN_STREETS = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Row|Court|Ct|Drive|Dr|Close|Way|Place|Pl|Square|Terrace|Boulevard|Blvd|Crescent|Gardens|Mews|Walk"
_TITLED = re.compile(rf"(?<!\w)(?:{_TITLES})\b\.?[  ]+((?:(?:[A-Z]\.[  ]?){{1,3}})?{_N}(?:(?:,? | ){_N})?)")
_RUN = re.compile(rf"{_N}(?:(?:,? | ){_N})+")
_PART = re.compile(_N)
_INITIALS = re.compile(rf"[A-Z]\.\s?(?:[A-Z]\.\s?){{0,2}}{_N}(?![\w@])")
_GROUP = re.compile(r"[0-9０-９]+")
#: Digits of a number that may be personal, at least and at most.
LEAST_DIGITS, MOST_DIGITS = 7, 18
_DIGITS = re.compile(r"[0-9０-９][0-9０-９ ().（）/\-－xX]{6,}")
#: Cheap signs that a slower pattern can match at all.
_TITLE_SIGNS = tuple(f"{t}{e}" for t in _TITLES.split("|") for e in (".", " ", "\u00a0"))
_EN_SIGNS, _DE_SIGNS = tuple(f" {w}" for w in _EN_STREETS.split("|")), ("gasse ", "bogen ", "straße ", "strasse ", "str. ", "weg ", "platz ", "allee ", "ufer ", "ring ", "damm ", "steig ", "hof ", "graben ", "markt ", "zeile ")
_ROMANCE_SIGNS = ("allée ", "allee ", "rue ", "avenue ", "boulevard ", "place ", "chemin ", "impasse ", "quai ", "alle ", "venida ", "laza ", "aseo ", "camino ")
_EN_ADDRESS = re.compile(rf"(?<![\w.,\-])(?:(?:Flat|Apt|Unit|Suite|Apartment) \w+, )?\d{{1,4}}[A-Za-z]? (?:[A-Z][\w’'\-]+ ){{1,3}}(?:{_EN_STREETS})\b\.?(?:, (?:Apt|Flat|Suite|Unit|Apartment|Room|Floor)\.? ?\w+)?(?:, [A-Z][\w’'\-]+(?: [A-Z][\w’'\-]+)*(?: \d{{5}})?)?")
_DE_ADDRESS = re.compile(r"(?<!\w)[A-ZÄÖÜ][\wäöüß\-]*(?:gasse|bogen|stra(?:ß|ss)e|str\.|weg|platz|allee|ufer|ring|damm|steig|hof|graben|markt|zeile) \d{1,4}[a-z]?\b(?:, (?:D-)?\d{5} [A-ZÄÖÜ][\wäöüß\-]+(?: [A-ZÄÖÜ][\wäöüß\-]+)?)?")
_ROMANCE_ADDRESS = re.compile(r"(?<![\w.,\-])\d{1,4}(?: bis| ter)?,? (?:all[ée]e|rue|avenue|boulevard|place|chemin|impasse|quai|calle|avenida|plaza|paseo|camino)(?: (?:des|de|du|del|la|las|los|les|le))*(?: d[’']| l[’']| )[A-ZÀ-Þ][\w’'\-]*(?: [A-ZÀ-Þ][\w’'\-]*)*(?:, \d{5} [A-ZÀ-Þ][\w’'\-]*(?:-[\w’']+)*)?")
_ES_ADDRESS = re.compile(r"(?<!\w)(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo)(?: (?:de|del|la|las|los))* [A-ZÀ-Þ][\w’'\-]*(?: [A-ZÀ-Þ][\w’'\-]*)*,? (?:n\.?º ?)?\d{1,4}\b(?:, \d{5} [A-ZÀ-Þ][\w’'\-]*)?")
_ZH_STREET = re.compile(rf"(?:街|路|大道|巷|道|弄|胡同|里)[0-9０-９一二三四五六七八九十百]{{1,5}}号(?:(?:院内)?\d{{1,3}}(?:栋|幢|号楼|单元|座))?(?:\d{{1,2}}单元)?(?:\d{{1,2}}[层楼])?(?:\d{{2,4}}[室房])?")
_ZH_BEFORE = re.compile(rf"(?:{_H}{{2,3}}(?:省|自治区))?(?:{_H}{{2,3}}市)?(?:{_H}{{2,3}}[区县镇])?{_H}{{1,4}}\Z")
_ZH_LEFT = re.compile(rf"(?:联系人|经办人|收件人|负责人|姓名|签收人|申请人|当事人|联络人)(?:(?:为|是)?[:：][ 　]?|(?<!负责人))(?={_H}{{2}})")
_ZH_RIGHT = re.compile(r"(?:先生|女士|小姐|教授|博士|老师|同志|的身份证|的证件|的手机|的电话|的邮箱)")
_HAN_RUN = re.compile(rf"{_H}{{2,4}}")
_CELL = re.compile(rf"(?m)^[ \t]*((?:{_H}{{2,4}})|(?:{_N} {_N}))(?=[ \t]*[|;；,，\t]| {{2,}})")
_JA = re.compile(r"(?:担当は|担当者は|連絡先は|担当[:：]|氏名[:：])([^\s、。]{1,6}?(?:[ 　][^\s、。]{1,6}?)?)(?=さん|様|氏|です|、)")
_JA_RIGHT = re.compile(r"(?<=[、。\n「])([一-鿿]{1,4}[ 　]?[一-鿿ぁ-ん]{1,4})(?=さん|様|氏)")

#: Chinese family names that are rare or have two characters, and the most frequent ones.
_TWO = set("颛孙 澹台 钟离 百里 南荣 羊舌 闻人 欧阳 司马 上官 诸葛 东方 皇甫 尉迟 公孙 慕容 令狐 长孙 宇文 司徒 轩辕 端木 南宫 夏侯 东郭 西门 呼延 拓跋 赫连 独孤 申屠 太史 仲孙 公冶 宗政 濮阳 淳于 单于 公羊 第五".split())
_ONE = set("郄亓仉逄郗王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文庞樊兰殷施陶洪翟安颜倪严牛温芦季俞章鲁葛伍韦申尤毕聂丛焦向柳邢路岳齐沿梅莫庄辛管祝左涂谷祁时舒耿牟卜路詹关苗凌费纪靳盛童欧甄项曲成游阳裴席卫查屈鲍位覃霍翁隋植甘景薄单包司柏宁柯阮桂闵解强柴华车冉房边辜吉饶刁瞿戚丘古米池滕晋苑邬臧畅宫来嵺苟全褚廉简娄盖符奚木穆党燕郎邸冀谈姬屠连郜晏栾郁商蒙计喻揭窦迟宇敖糜鄢冷卓花仇艾蓝都巩稽井练仲乐虞卞封竺冼原官衣楚佟栗匡宗应台巫鞠僧桑荆谌银扬明沙薄伏岑习胥保和蔺".strip())
#: Words that begin sentences and thus are capitalised without being names.
_STARTERS = set("the a an in on at if it is are was were there this that these those because although despite while when with without before after during until our each one please contact according copies call see well nobody who did does how what why which under alongside order part invoice no not to by from for of and or but as of open scope notes summary against beneath shortly nobody der die das den dem des ein eine im in am es ist und oder nach vor mit ohne auf während trotz wegen bitte siehe zum zur laut frau herr le la les un une des du de en on dans après avant avec sans pendant malgré selon mme el los las una por para con sin antes después todavía según aunque sra sr name phone email item section summary".split())


class Candidate(NamedTuple):
    start: int
    end: int
    type: str
    kind: str


def candidates(text: str) -> list[Candidate]:
    """Spans that may be personal data, several of which may overlap or compete."""
    out: set[Candidate] = set()
    add = lambda a, b, t, k: out.add(Candidate(a, b, t, k)) if 0 < b - a <= LONGEST else None
    if "@" in text or "＠" in text or "(a" in text or "[a" in text or "(A" in text or "[A" in text or "{a" in text:
        for m in _MAIL_MARK.finditer(text):
            local, host = _LOCAL.search(text, max(0, m.start() - 64), m.start()), _HOST.match(text, m.end())
            if local and host:
                add(local.start(), host.end(), "email", "plain" if len(m[0]) == 1 else "masked")
    for run in _DIGITS.finditer(text):
        a, b = max(0, run.start() - 6), min(len(text), run.end() + 4)
        if sum(x.isdigit() for x in run[0]) < 6:
            continue
        for name, pattern in _SHAPES:
            for m in pattern.finditer(text, a, b):
                add(m.start(), m.end(), "id_number" if name in ("resident", "social", "letters") else "phone", name)
        # numbers of no known shape: all segments of whole groups of digits
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, run.start(), run.end())]
        for i, (start, _) in enumerate(groups):
            if start and (text[start - 1].isalnum() or text[start - 1] in "_@#."):
                continue
            digits = 0
            for x, y in groups[i:]:
                digits += y - x
                if digits > MOST_DIGITS or y - start > LONGEST:
                    break
                if digits >= LEAST_DIGITS and not (text[y : y + 1].isalnum() or text[y : y + 1] in ("_", "@")):
                    at = start - (text[start - 1 : start] in ("+", "＋", "("))
                    for kind in ("phone", "id_number"):
                        add(at, y, kind, "digits")
    if "号" in text:
        for m in _ZH_STREET.finditer(text):
            for a in range(max(0, m.start() - 22), m.start()):
                if _ZH_BEFORE.fullmatch(text, a, m.start()):
                    add(a, m.end(), "address", "zh")
    for kind, pattern, signs in (("en", _EN_ADDRESS, _EN_SIGNS), ("de", _DE_ADDRESS, _DE_SIGNS), ("romance", _ROMANCE_ADDRESS, _ROMANCE_SIGNS), ("es", _ES_ADDRESS, _ROMANCE_SIGNS)):
        if any(x in text for x in signs):
            for m in pattern.finditer(text):
                add(m.start(), m.end() - (text[m.end() - 1] == "."), "address", kind)
    if any(x in text for x in _TITLE_SIGNS):
        for m in _TITLED.finditer(text):
            add(m.start(1), m.end(1), "name", "titled")
    for run in _RUN.finditer(text):
        if run.start() and (text[run.start() - 1] in ".@’'-" or text[run.start() - 1].isalnum()) and not (text[run.start() - 1] == "." and run.start() > 1 and text[run.start() - 2].islower()):
            continue
        parts = [(m.start(), m.end()) for m in _PART.finditer(text, run.start(), run.end())]
        for (a, b), (x, y) in zip(parts, parts[1:]):
            if text[a:b].lower() not in _STARTERS and text[x:y].lower() not in _STARTERS and text[y : y + 1] not in ("@", "_"):
                add(a, y, "name", "comma" if "," in text[b:x] else "pair")
    for m in _INITIALS.finditer(text):
        if not m.start() or not (text[m.start() - 1].isalnum() or text[m.start() - 1] == "." and text[m.start() - 2 : m.start() - 1].isupper()):
            add(m.start(), m.end(), "name", "initials")
    edge = _HAN_RUN.match(text)
    if edge:
        for n in range(2, len(edge[0]) + 1):
            if (text[:2] in _TWO or text[0] in _ONE) and text[n : n + 1] in ("（", "。", "，", "的", "先", "女", "|", " "):
                add(0, n, "name", "edge")
    for n in (2, 3, 4):
        if len(text) > n and _HAN_RUN.fullmatch(text, len(text) - n) and (text[-n:][:2] in _TWO and n > 2) and not "一" <= text[-n - 1] <= "鿿":
            add(len(text) - n, len(text), "name", "edge")
    if "人" in text or "姓名" in text or "先生" in text or "女士" in text or "的" in text or "小姐" in text:
        for m in _ZH_LEFT.finditer(text):
            run = _HAN_RUN.match(text, m.end())
            for n in range(2, len(run[0]) + 1):
                add(m.end(), m.end() + n, "name", "zh_left")
        for m in _ZH_RIGHT.finditer(text):
            for n in (2, 3, 4):
                if m.start() >= n and _HAN_RUN.fullmatch(text, m.start() - n, m.start()):
                    add(m.start() - n, m.start(), "name", "zh_right")
    if "担当" in text or "さん" in text or "様" in text or "氏" in text:
        for pattern in (_JA, _JA_RIGHT):
            for m in pattern.finditer(text):
                add(m.start(1), m.end(1), "name", "ja")
    if "|" in text or "\t" in text or ";" in text or "   " in text:
        for m in _CELL.finditer(text):
            add(m.start(1), m.end(1), "name", "cell")
    return sorted(out)


# ------------------------------------------------------------------------------------------------------------------ the model
_WORD_LEFT, _WORD_RIGHT = re.compile(r"([^\W\d_]+)[\s.:：(（\"“]*\Z"), re.compile(r"[\s,.:;)）]*([^\W\d_]{1,12})")


@cache
def _is_cjk(c: str) -> bool:
    return "぀" <= c <= "鿿"


def features(text: str, c: Candidate) -> list[str]:
    """Features of a span as a whole: its shape and what stands beside it."""
    span, before = text[c.start : c.end], text[max(0, c.start - 24) : c.start]
    left = _WORD_LEFT.search(before)
    word = left[1][-8:].lower() if left else ""
    if word and _is_cjk(word[-1]):
        word = word[-2:]
    right = _WORD_RIGHT.match(text, c.end, c.end + 16)
    after = text[c.end : c.end + 2]
    next_word = right[1].lower() if right else ""
    if next_word and _is_cjk(next_word[0]):
        next_word = next_word[:2]
    line_start = text.rfind("\n", 0, c.start) + 1
    line_end = text.find("\n", c.end)
    line = text[line_start : line_end if line_end >= 0 else len(text)]
    key = f"{c.type}|{c.kind}"
    out = [key, f"{key}|L={word}", f"{key}|R={next_word}", f"{key}|l={before[-1:] or '^'}", f"{key}|r={after[:1] or '$'}", f"{c.type}|L={word}", f"{c.type}|R={next_word}"]
    if c.type == "name":
        if _is_cjk(span[0]) and c.kind != "ja":
            two, one = span[:2] in _TWO, span[0] in _ONE
            given = len(span) - (2 if two else 1)
            out += [f"name|family={'two' if two else 'one' if one else 'none'}|given={given}"]
        else:
            words = re.findall(r"[^\W\d_]+", span)
            known = sum(w.lower() in _STARTERS for w in words)
            again = sum(w.lower() in text for w in words if len(w) > 2)  # also stands in lower case
            out += [f"name|starters={known > 0}", f"name|lower={min(again, 2)}", f"name|words={len(words)}"]
        start = c.start == line_start or not text[line_start : c.start].strip()
        out.append(f"name|{c.kind}|starts={start}|contact={bool(start and re.search(r'[@＠]|\bat\b|[0-9０-９]{3,4}[ .\-]?[0-9０-９]{4}', line))}")
        if re.match(r"[  ]*(?:&|und|and|et|y)[  ]+[A-Z][a-z]+ (?:Ltd|Inc|Co|Corp|LLC|GmbH|AG|SA|Bros)|,? (?:Ltd|Inc|Corp|LLC|GmbH|Co\b|AG\b|SA\b|S\.A)", text[c.end : c.end + 30]) or before.rstrip().endswith("&"):
            out.append("name|company")
    elif c.type in ("phone", "id_number"):
        shape = re.sub(r"[0-9０-９]", "9", span)
        out += [f"{c.type}|shape={shape}", f"{c.type}|digits={shape.count('9')}", f"{c.type}|{c.kind}|digits={shape.count('9')}|l={before[-1:] or '^'}"]
    elif c.type == "address":
        out.append(f"address|town={bool(re.search(r'[市]|, (?:[A-ZÀ-Þ]|\d{5})', span))}")
        if c.kind == "zh":
            out.append(f"address|zh|city={'市' in span[1:6] or '省' in span[1:6]}|cue={before[-1:] in '到为至在往址：:于' if before else False}")
    return out


#: Entities with at most so many characters between them, on one line, bear on each other.
NEAR = 10


def _sum(values: list[float]) -> float:
    """Logarithm of a sum of exponentials."""
    top = max(values)
    return top + log(sum(exp(v - top) for v in values)) if top > -inf else -inf


class Lattice:
    """The candidate segments of a text by their ends, and which of them may come before which.

    Of each segment, `upto` counts those that end at or before its start, and those from `near` on do so within NEAR characters of it.
    """

    def __init__(self, text: str, found: list[Candidate]):
        self.order = sorted(found, key=lambda c: (c.end, c.start))
        ends = [c.end for c in self.order]
        self.upto = [bisect_right(ends, c.start) for c in self.order]
        self.near = [bisect_left(ends, c.start - NEAR, 0, n) for c, n in zip(self.order, self.upto)]
        self.sides = [[self.side(text, self.order[j], c) for j in range(m, n)] for c, m, n in zip(self.order, self.near, self.upto)]

    @staticmethod
    def side(text: str, a: Candidate, b: Candidate) -> str | None:
        """The feature of two entities side by side."""
        return f"next|{a.type}|{b.type}" if "\n" not in text[a.end : b.start] else None

    def best(self, own: list[float], weights: dict[str, float]) -> list[int]:
        """The best segments that don't overlap: dynamic programming over segment ends; what no segment covers scores nothing."""
        best, back = [0.0] * len(own), [-1] * len(own)
        top, top_at = [0.0] * (len(own) + 1), [-1] * (len(own) + 1)  # best of the first k segments
        for k, (m, n) in enumerate(zip(self.near, self.upto)):
            best[k], back[k] = top[m], top_at[m]
            for j, f in zip(range(m, n), self.sides[k]):
                score = best[j] + (weights.get(f, 0.0) if f else 0.0)
                if score > best[k]:
                    best[k], back[k] = score, j
            best[k] += own[k]
            top[k + 1], top_at[k + 1] = (best[k], k) if best[k] > top[k] else (top[k], top_at[k])
        out, k = [], top_at[len(own)]
        while k >= 0:
            out.append(k)
            k = back[k]
        return out[::-1]

    def marginals(self, own: list[float], weights: dict[str, float]) -> tuple[list[float], dict[str, float], float]:
        """(probability of each segment, expected number of each side feature, log of the sum over all segmentations), forward and backward."""
        n = len(own)
        side = lambda f: weights.get(f, 0.0) if f else 0.0
        alpha, top = [0.0] * n, [0.0] * (n + 1)
        for k in range(n):
            m, upto = self.near[k], self.upto[k]
            alpha[k] = own[k] + _sum([top[m], *(alpha[j] + side(f) for j, f in zip(range(m, upto), self.sides[k]))])
            top[k + 1] = _sum([top[k], alpha[k]])
        # beta[k]: all that may follow segment k; a far segment l follows any k < near[l], a near one its own sides
        total, follow = top[n], [[0.0] for _ in range(n)]
        pairs: list[tuple[int, int, str | None]] = [(j, k, f) for k in range(n) for j, f in zip(range(self.near[k], self.upto[k]), self.sides[k])]
        after = {k: [] for k in range(n)}
        for j, k, f in pairs:
            after[j].append((k, f))
        beta = [0.0] * n
        for k in range(n - 1, -1, -1):
            values = follow[k]
            values += [own[x] + beta[x] for x in range(k + 1, n) if k < self.near[x]]
            values += [own[x] + beta[x] + side(f) for x, f in after[k]]
            beta[k] = _sum(values)
        own_p = [exp(min(0.0, a + b - total)) for a, b in zip(alpha, beta)]
        expected: dict[str, float] = defaultdict(float)
        for j, k, f in pairs:
            if f:
                expected[f] += exp(min(0.0, alpha[j] + side(f) + own[k] + beta[k] - total))
        return own_p, expected, total


class Model:
    """Weights of the features of segments as wholes, and of two segments side by side: a semi-Markov conditional random field."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = defaultdict(float)

    def score(self, text: str, c: Candidate) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in features(text, c))

    def best(self, text: str, found: list[Candidate]) -> list[Candidate]:
        """The most probable segmentation's entities."""
        if len(found) == 1:
            return found if self.score(text, found[0]) > 0 else []
        lattice = Lattice(text, found)
        return [lattice.order[k] for k in lattice.best([self.score(text, c) for c in lattice.order], self.weights)]


# -------------------------------------------------------------------------------------------------------------------- training
#: Sentences to learn from. {n} a name, {f} a family name, {p} a phone number, {e} a mail address, {i} an identity number, {a} an
#: address; (x) what looks alike and is none: (c) a company, (s) a street, (d) digits, (r) a serial number, (w) two capitalised words.
_TEMPLATES = """
Contact {n} on {p} about the manual.|Contact {n} on {p} or write to {e}.|Call {p} or write to {e} before Friday.|According to {n}, the index is final.|According to {n}, it rained.
{n} gave the number {i} on the form.|Copies went to {n} ({e}) and to {n}, tel. {p}.|The form lists social security no. {i} for the tenant at {a}.|Please send the index to {a}.|Please send it to {a} by noon.
Mr. {f} said so.|Dr. {f} numbered the outline at 9.30 a.m. today.|Ms. {n} revised the note with care.|{I} questioned the bundle, approx. 3 MB in size.|{I} returned it.|Mrs. {n} lives at {a}.|The list was mailed to {e} on Monday.
{n}, the index is final.|{n} (après la réunion) répond au {p}.|{n} vive en {a}.|{n} on {p} about the manual.|{n} ; {p} ; {e} ; note|{n} | {p} | {e} | note|{n}\t{p}\t{e}\tnote|{n}   {p}   {e}   note|{n} | {p} |  | note|{n}; ; {e}; note|{n}\t\t{e}\tnote|- missing list {e}|3. old note {e}
Frau {n}, Tel. {p}, prüfte die Liste.|Herr {n}, Tel. {p}, las sie.|Dr. {f} archivierte die Liste vor der Sitzung.|Bitte senden Sie die Liste an {e}.|Die Listen gehen an {a}.|Frau {f} war da.
Mme {n} (après la réunion) répond au {p}.|M. {f} a corrigé les notices.|Envoyez les notices à {e}.|Les notices sont attendues au {a}.|La Sra. {n} vive en {a}.|El Sr. {f} revisó las guías.|Envíe las guías a {e} hoy.
联系人：{z}，电话{p}。|经办人{z}（手机{p}）核对了清单。|请把清单寄到{A}，收件人{z}。|{z}的身份证号为{R}，请核对。|证件号码{R}与清单不符。|如有疑问请致电 {p} 或写信到 {e} 。|会议之前，{z}先生更正了清单。|虽然已过，{z}女士提交了清单。|送货地址改为{A}，财务室已知悉。|可发邮件至{e}索取清单。|{z} | {p} | {e} | 清单|{z}; {p}; ; 清单|{z}\t{p}\t{e}\t清单|{z}   {p}   {e}   清单|{z} |  | {e} | 清单
{z}（手机{p}）核对了清单。|{z}。证件号码{R}与清单不符。|按照来函，{z}|{z}，电话{p}。|担当は{j}さんで、電話は{p}です。|清単は{e}までお送りください。|목록을 {e} 주소로 보내 주십시오.|Отправьте сноски на адрес {e} до пятницы.|กรุณาส่งไปที่ {e} โรงพิมพ์
Invoice (D) covers the manual.|Part no. (P) is listed in the index.|Order no. 74 vs. order no. 471 was collected.|ISBN 978-0-3395-7708-7 appears here.|The build ran at 10.89.2.43 on the test bench.|The tag @style_owner marks the plan.|(s) was closed before noon.|The (s) was closed.|(c) questioned the plan.|The team works for (c) with care.|Device serial (D) was noted.|It runs version 87.14.0 of the parser.|Serial number (D) is printed there.
订单编号(O)已由采购办登记。|设备序列号为(D)，见清单。|时间戳208809183911写入清单。|新闻中心公布的热词是@qa-bot，与邮箱无关。|书号978-7-3395-7708-7见清单。|项目经理先生们到了。|收件人已经更正。|经办人把清单交给财务室。|联系人根据来函修订了清单。|申请人按照新的体例归档了它。|当事人也整理了问卷。|经办人员已经更正。|负责人员提交了清单。|档案员先生批准了它。
(w) is open.|In Section 5, (w) was read.|Die (w) wurde gelesen.|最终清单 | 1,204 | 33% | 2031|最新摘要; 17; n/a; 4|Final Index | 12 | 4 | n/a|Part no. (T) is listed.|Invoice (M) covers it.|单号(M)已登记。|设备序列号为(M)，见清单。
"""


#: What made-up names, towns and hosts consist of.
_SYLLABLES = "ba dor ven mil ska tor ra lin mo fel gar hu sen wy ox per ali qua zin bre tha ol und ark isk eth".split()
_GIVEN = "予岚墨汀砚秋云舟听澜书棠北辰晚笙若漪景珩知渺亦峦安宁子轩雨桐明远文静思齐海洋志强"


def _sentence(template: str, rng: random.Random, syllables: list[str] = _SYLLABLES, han: str = _GIVEN) -> tuple[str, list[tuple[int, int, str]]]:
    """A template filled in, and its entities."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice((2, 2, 3)))).capitalize()

    def mobile() -> str:
        a, b, c = "1" + rng.choice("3456789") + d(1), d(4), d(4)
        s = rng.choice((a + b + c, f"{a}-{b}-{c}", f"{a} {b} {c}", f"+86 {a} {b} {c}", "+86" + a + b + c))
        return s.translate({**{ord(x): ord(x) + 0xFEE0 for x in "0123456789+"}}) if rng.random() < 0.1 else s

    def phone() -> str:
        return rng.choice((f"({d(3)}) 555-{d(4)}", f"{d(3)}-555-{d(4)}", f"{d(3)}.555.{d(4)}", f"+1 {d(3)} 555 {d(4)}", f"020 7946 {d(4)}", f"030 23125 {d(3)}", f"+49 (0)30/23125-{d(3)}", f"01 99 00 {d(2)} {d(2)}", f"+33 1.99.00.{d(2)}.{d(2)}", f"+44 20 7946 {d(4)}"))

    def mail() -> str:
        a, b = word().lower(), word().lower()
        host, tld = word().lower(), rng.choice(("test", "example", "invalid", "org"))
        local = rng.choice((f"{a}.{b}", f"{a}_{b}+x1", f"{a[0]}{b}{d(2)}", f"{b}-{a}"))
        return rng.choice((f"{local}@{host}.{tld}", f"{local}@{host}.{tld}".upper(), f"{local}＠{host}.{tld}", f"{local} [at] {host}.{tld}", f"{local} (at) {host} (dot) {tld}"))

    def address(style: str) -> str:
        w, town, n = word(), word(), str(rng.randint(1, 240))
        if style == "zh":
            pick = lambda k: "".join(rng.choice("明岭云湖青石听松望潮半塘石桥东篱竹影枫白鹭旧渡") for _ in range(k))
            return rng.choice(("", pick(2) + "省")) + pick(2) + "市" + pick(2) + rng.choice("区县") + pick(2) + rng.choice(("街", "路", "大道", "巷")) + n + "号" + rng.choice(("", "22栋2201室", "院内16单元"))
        if style == "de":
            return f"{w}{rng.choice(('gasse', 'bogen', 'straße', 'weg'))} {n}, {d(5)} {town}"
        if style == "romance":
            return f"{n}, {rng.choice(('rue des', 'allée du', 'calle del', 'avenue de la'))} {w}, {d(5)} {town}"
        return f"{n} {w} {rng.choice(('Street', 'Lane', 'Row', 'Court', 'Road'))}{rng.choice(('', f', Apt {d(1)}', f', Suite {d(2)}'))}, {town}{rng.choice(('', ' ' + d(5)))}"

    chinese = any("一" <= x <= "鿿" for x in template)
    style = "de" if "gehen" in template else "romance" if re.search("attendues|vive", template) else "en"
    make = {
        "{n}": lambda: ("name", rng.choice((f"{word()} {word()}", f"{word()} {word()}", f"{word()}, {word()}"))), "{f}": lambda: ("name", word()), "{I}": lambda: ("name", rng.choice(("", f"{rng.choice('ABDEGHJKLRT')}. ")) + f"{rng.choice('ABDEGHJKLRT')}. {word()}"),
        "{p}": lambda: ("phone", mobile() if chinese or "担当" in template else phone()), "{e}": lambda: ("email", mail()), "{i}": lambda: ("id_number", rng.choice((f"000-{d(2)}-{d(4)}", f"000 {d(2)} {d(4)}", f"ZZ{d(7)}", f"{d(3)}-{d(2)}-{d(4)}"))),
        "{R}": lambda: ("id_number", (lambda a, b, c: rng.choice((a + b + c, f"{a} {b} {c}")))(d(6), f"{rng.randint(1950, 2005)}{rng.randint(1, 12):02}{rng.randint(1, 28):02}", d(3) + rng.choice("0123456789X"))),
        "{a}": lambda: ("address", address(style)), "{A}": lambda: ("address", address("zh")), "{z}": lambda: ("name", rng.choice([*sorted(_TWO), *"郄亓仉逄郗王李张刘陈杨赵"]) + "".join(rng.choice(han) for _ in range(rng.choice((1, 2, 2))))),
        "{j}": lambda: ("name", rng.choice(("霧峰", "葦沢", "雫石原", "朝鳴", "柚森", "鈴淵", "佐藤")) + rng.choice(("", " ", "　")) + rng.choice(("律彦", "千歌", "かなた", "みちる", "透子"))),
        "(c)": lambda: (None, f"{word()} & {word()} Ltd."), "(s)": lambda: (None, f"{word()} Street"), "(D)": lambda: (None, rng.choice("23456789") + d(10)), "(P)": lambda: (None, f"{d(3)}-{d(2)}-{d(5)}"), "(T)": lambda: (None, f"{d(3)}-{d(3)}-{d(4)}"),
        "(M)": lambda: (None, "1" + rng.choice("3456789") + d(9)), "(O)": lambda: (None, d(6) + f"{rng.choice((rng.randint(1950, 2029), int(d(4))))}{rng.randint(1, 12):02}{rng.randint(1, 28):02}" + d(4)), "(w)": lambda: (None, f"{rng.choice(('Final', 'Open', 'Annual'))} {rng.choice(('Index', 'Report', 'Notice'))}"),
    }
    text, gold = "", []
    for part in re.split(r"(\{\w\}|\(\w\))", template):
        if part in make:
            kind, value = make[part]()
            if kind:
                gold.append((len(text), len(text) + len(value), kind))
            text += value
        else:
            text += part.replace("\\t", "\t")
    return text, gold


def sentences_of(templates: list[str], count: int, seed: int, **names) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts made of templates, with their entities; some begin or end in the middle, as contexts do, but in no entity."""
    rng = random.Random(seed)
    filler = ["The survey office published it. ", "审校人员表示，清单已经更正。", "Es ist nicht klar. ", "On ne sait pas encore. ", "", "", "", "\n"]
    data = []
    for _ in range(count):
        template = rng.choice(templates)
        before = "" if template[:3] in ("{n}", "{z}") and template[3:4] in ",（。，" else rng.choice(filler)
        text, gold = _sentence(template, rng, **names)
        table = "|" in text or ";" in text or "\t" in text or "   " in text
        before = "\n" if table else before
        text, gold = before + text + ("" if template.endswith("，{z}") else rng.choice(("", "\n", "\nThe end.") if table else ("", " ", "\n"))), [(a + len(before), b + len(before), t) for a, b, t in gold]
        edges = [k for k in range(len(text) + 1) if not any(a < k < b for a, b, _ in gold)]
        low = rng.choice([a for a, *_ in gold] or edges) if rng.random() < 0.12 else rng.choice(edges) if rng.random() < 0.1 else 0
        high = rng.choice([b for _, b, _ in gold] or edges) if rng.random() < 0.12 else rng.choice(edges) if rng.random() < 0.1 else len(text)
        if low < high:
            text, gold = text[low:high], [(a - low, b - low, t) for a, b, t in gold if low <= a and b <= high]
        data.append((text, gold))
    return data


def templates() -> list[str]:
    return [t for line in _TEMPLATES.strip().splitlines() for t in re.split(r"(?<! )\|(?! )", line)]


def fit(data: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 4, rate: float = 0.3, ridge: float = 1e-4, seed: int = 5) -> Model:
    """The weights of the highest conditional likelihood of the entities given the texts, by stochastic gradients with adapted rates.

    The gradient of a text is what is expected of each feature given its entities less what is expected without knowing them, both by the
    forward and backward sums over all segmentations. Several candidates of one span may stand for an entity; given the entities, these are the
    segmentations with each of them.
    """
    rng = random.Random(seed)
    texts = []
    for text, gold in data:
        lattice = Lattice(text, candidates(text))
        if lattice.order:
            texts.append((lattice, [features(text, c) for c in lattice.order], [(c.start, c.end, c.type) in set(gold) for c in lattice.order]))
    model = Model()
    w, seen = model.weights, defaultdict(float)
    for _ in range(epochs):
        rng.shuffle(texts)
        for lattice, own, right in texts:
            scores = [sum(w.get(f, 0.0) for f in fs) for fs in own]
            p, sides, _ = lattice.marginals(scores, w)
            given = [x + 60.0 if r else -inf for x, r in zip(scores, right)]  # with each entity, and with no other segment
            q, right_sides, _ = lattice.marginals(given, w) if any(right) else ([0.0] * len(p), {}, 0.0)
            gradient: dict[str, float] = defaultdict(float)
            for fs, a, b in zip(own, q, p):
                if abs(a - b) > 1e-4:
                    for f in fs:
                        gradient[f] += a - b
            for f in {*sides, *right_sides}:
                gradient[f] += right_sides.get(f, 0.0) - sides.get(f, 0.0)
            for f, g in gradient.items():
                g -= ridge * w.get(f, 0.0)
                seen[f] += g * g
                w[f] += rate * g / (sqrt(seen[f]) + 1e-6)
    out = Model()
    out.weights.update({f: round(x, 4) for f, x in w.items() if abs(x) >= 5e-5})
    return out


@cache
def trained(count: int = 6000, seed: int = 5) -> Model:
    """The model fitted on generated texts."""
    return fit(sentences_of(templates(), count, seed))


def find(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, type) of the personal data in a text."""
    found = candidates(text)
    if not found:
        return []
    out: list[tuple[int, int, str]] = []
    group: list[Candidate] = []
    end = 0
    for c in found:  # segments that are not near any before them don't bear on these
        if group and c.start - end > NEAR:
            out += [(g.start, g.end, g.type) for g in model.best(text, group)]
            group = []
        group.append(c)
        end = max(end, c.end)
    out += [(g.start, g.end, g.type) for g in model.best(text, group)]
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a placeholder of its type for each span."""
    out, at = [], 0
    for a, b, t in sorted(spans):
        out += [text[at:a], f"[{t.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def personal_spans(texts: DataFrame, record_table: str, record_id: str, column: str) -> DataFrame:
    """record_table, record_id, pii_start, pii_end, pii_type of the personal data in a column. Null and empty texts have none.

    One narrow pass; repeated rows count once only after the caller's distinct().
    """
    ship(texts.sparkSession)
    weights = dict(trained().weights)

    def make():
        model = Model()
        model.weights = weights

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(i, a, b, t) for i, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))) for a, b, t in find(text, model)]
            columns = list(zip(*rows)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array([record_table] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string())))], names=["record_table", "record_id", "pii_start", "pii_end", "pii_type"])

        return work

    return map_arrow(spread(texts.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(column).alias("text"))), make, "record_table string, record_id bigint, pii_start int, pii_end int, pii_type string")


def found_everywhere(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """The spans in documents.text and in verification_issues.context; repeated rows of the latter count once."""
    own = personal_spans(docs, "documents", "doc_id", "text")
    context = personal_spans(issues.select("issue_row_id", "context").distinct(), "verification_issues", "issue_row_id", "context")
    return own.unionByName(context)


def redacted(texts: DataFrame, record_id: str, column: str) -> DataFrame:
    """record_id, text, spans: each text with typed placeholders, and how many there are. A null text stays null."""
    ship(texts.sparkSession)
    weights = dict(trained().weights)

    def make():
        model = Model()
        model.weights = weights

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [(None, 0) if t is None else (lambda s, t=t: (redact(t, s), len(s)))(find(t, model)) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int32())], names=["record_id", "text", "spans"])

        return work

    return map_arrow(spread(texts.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(column).alias("text"))), make, "record_id bigint, text string, spans int")


def redacted_everywhere(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """record_table, record_id, text, spans of documents.text and verification_issues.context; repeated rows of the latter count once."""
    own = redacted(docs, "doc_id", "text").withColumn("record_table", F.lit("documents"))
    context = redacted(issues.select("issue_row_id", "context").distinct(), "issue_row_id", "context").withColumn("record_table", F.lit("verification_issues"))
    return own.unionByName(context).select("record_table", "record_id", "text", "spans")
