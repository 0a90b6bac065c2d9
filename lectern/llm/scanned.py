"""Repair of text from scanned pages: page furniture and line joins by line-pair classifiers, misread words by q-gram candidates and boosted ranking."""

from __future__ import annotations

import math
import random
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import texts_of
from ..session import cut, map_arrow, ship, spread

#: File types that pages are scanned into, and the parser that reads boxes of pages.
SCANNED_TYPES, SCANNED_PARSER = ("pdf", "png", "jpg"), "ocr_layout"
#: Share of lines that fill the column without a final mark, from which a text is broken by its lines.
BROKEN = 0.4
#: A word or window is known where it makes up this share of all in born-digital texts, and a correction where it makes up twice as much, but
#: once is an accident at any size: so often at least. A misprint's share doesn't grow with the texts, so it does not become known.
SHARE, KNOWN, CORRECTION = 2e-7, 2, 3
#: From this share of unknown words on, a text is not in a language whose words are known, and none of them is taken for misread.
STRANGE = 0.5
#: Letters by which a misread word differs from the right one: two where a sign was taken for two, and in long words a quarter of them, at most.
MOST_EDITS = 2
#: Most frequent known words that the ranking is fitted on at most.
FIT_WORDS = 2000
#: What scanners take for what.
CONFUSED = [("m", "rn"), ("l", "1"), ("i", "!"), ("i", "1"), ("l", "!"), ("e", "c"), ("o", "0"), ("h", "b"), ("u", "ii"), ("d", "cl"), ("w", "vv"), ("s", "5"), ("g", "9"), ("a", "o"), ("t", "f"), ("i", "l"), ("n", "m"), ("u", "n"), ("z", "2"), ("b", "6"), ("ri", "n"), ("q", "g"), ("v", "y"), ("k", "lc"), ("li", "h"), ("nn", "m"), ("in", "m"), ("f", "t"), ("y", "v"), ("é", "e"), ("ü", "u"), ("ö", "o"), ("ä", "a")]

_END = re.compile(r"[.!?。！？…:：;；][\"'”’»」』）)\]]*\s*\Z")
_HYPHEN = re.compile(r"([^\W\d_][\w'’\-]*?)([-¬­‐])\s*\Z")
_DIGIT = r"[\dlIO|]"
_PAGE = rf"(?:[\[(—–\-]*\s*{_DIGIT}{{1,4}}(?:\s*/\s*{_DIGIT}{{1,4}})?\s*[\])—–\-]*|[^\W\d_]{{1,6}}\.?\s{_DIGIT}{{1,4}}(?:\s[^\W\d_]{{2,3}}\s{_DIGIT}{{1,4}})?|第\s?{_DIGIT}{{1,4}}\s?[页頁](?:\s?共\s?{_DIGIT}{{1,4}}\s?[页頁])?)"
_PAGE_LINE = re.compile(rf"\s*{_PAGE}\s*\Z")
_PAGE_HEAD, _HEAD_PAGE = re.compile(rf"\s*({_PAGE})\s{{2,}}(\S.*)\Z"), re.compile(rf"(\S.*?)\s{{2,}}({_PAGE})\s*\Z")
_TOKEN = re.compile(r"\S+")
#: Signs that stand for several letters; scanned texts hold them where letters were taken together.
_LIGATURES = re.compile("[ﬀﬁﬂﬃﬄﬅﬆ]")
_STRIP = "\"'“”„«»‹›()[]{}（）「」『』,;:。，、；：？！…–—*•·.!?"
_HAN = re.compile(r"[぀-ヿ㐀-鿿]")
#: Stands for the two signs before the first and after the last of a text, of which there are no windows.
_EDGE = "\x02"
#: The signs of _signs where they stand in a line.
_SIGN = re.compile(r"\d(?:\s*\d)*|([A-Za-zÀ-ÿ])(?:\s*[A-Za-zÀ-ÿ])*|\S")


_SENTENCE = re.compile(r"[。！？]|[^\W\d_][.!?](?=\s|\Z)")
_COLUMNS = re.compile(r"\t|\|.*\||\S {2,}\S+.*\S {2,}\S|,.*,.*,.*,")
_HEADING = re.compile(r"\s*(?:\d{1,3} \S|[一二三四五六七八九十]+、|\W*\d{1,3}[.)] |[•*\-–] )|[^A-Z]*[.,;:，。；] \S|\s*[a-zß-öø-ÿ]")


def is_broken(text: str) -> bool:
    """Whether the lines of a text are those of a printed column of prose, so that some of them may belong to the page."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) < 2 or sum(bool(_COLUMNS.search(x)) for x in lines) > 0.3 * len(lines):
        return False
    if 120 * len(_SENTENCE.findall(text)) < 0.4 * len(text):
        return False
    usual = sorted(map(len, lines))[-max(1, len(lines) // 10) - 1]
    return sum(0.75 * usual <= len(x) <= 1.12 * usual and not _END.search(x) for x in lines) >= BROKEN * len(lines)


# --------------------------------------------------------------------------------------------------------- line-pair classifiers
def _grams(line: str) -> Counter:
    t = re.sub(r"[\W\d_]+", "", line.casefold())
    return Counter(t[k : k + 2] for k in range(len(t) - 1)) or Counter([t])


#: Share of pairs of letters that two lines have in common to be held against each other.
ALIKE = 0.6


def _alike_matrix(grams: list[Counter]) -> np.ndarray:
    """What _alike gives of each two of a few lines."""
    names = {x: k for k, x in enumerate({x for g in grams for x in g})}
    counts = np.zeros((len(grams), len(names)), np.int32)
    for k, g in enumerate(grams):
        counts[k, [names[x] for x in g]] = list(g.values())
    shared = np.minimum(counts[:, None, :], counts[None, :, :]).sum(2)
    sizes = counts.sum(1)
    return 2 * shared / np.maximum(1, sizes[:, None] + sizes[None, :])


def _alike(a: Counter, b: Counter) -> float:
    n = sum((a & b).values())
    return 2 * n / max(1, sum(a.values()) + sum(b.values()))


_LIKE_DIGITS = str.maketrans("lIO|", "1101")
_MARKED = re.compile(r"\s*([\[(—–\-])?.*?([\])—–\-])?\s*\Z", re.S)


def _numbers(part: str) -> tuple[str, list[int]]:
    """(shape, numbers) of what may be a page number; signs that scanners read for digits count as such beside digits or alone."""
    read = re.sub(r"(?<![^\W\d_])[\dlIO|]+(?![^\W\d_])", lambda m: m[0].translate(_LIKE_DIGITS), part.strip())
    return re.sub(r"\d+", "9", read), [int(n) for n in re.findall(r"\d+", read)[:4] if len(n) < 6]


def page_features(part: str, lines: list[str], k: int, others: dict[str, list[tuple[int, list[int]]]], usual: int) -> np.ndarray:
    """What a line has that may be a page's number, and what it has in common with the nearest lines of the same shape before and after it."""
    shape, own = _numbers(part)
    letters = sum(c.isalpha() for c in shape)
    marks = _MARKED.match(part)
    alike = others.get(shape, ())
    at = bisect_left(alike, (k,))
    before = alike[at - 1][1] if at else None
    after = next((n for j, n in alike[at : at + 2] if j > k), None)
    step = max([float(a[:1] == [b[0] + 1]) for a, b in ((own, before), (after, own)) if a and b], default=0.0)
    falls = max([float(a[0] <= b[0]) for a, b in ((own, before), (after, own)) if a and b], default=0.0)
    above = next((lines[j] for j in range(k - 1, -1, -1) if lines[j].strip()), "")
    return np.array([1.0, float(bool(_PAGE_LINE.match(part))), float(bool(_END.search(part))), min(letters, 12) / 6, float(bool(marks[1] and marks[2])), min(len(own), 4) / 2, step, falls, float(bool(before or after)), float(bool(above) and not _END.search(above)), len(part.strip()) / usual, float(not own), float(shape == "9")])


def _pages_of(parts: dict[int, str]) -> dict[str, list[tuple[int, list[int]]]]:
    out: dict[str, list[tuple[int, list[int]]]] = {}
    for k, part in sorted(parts.items()):
        shape, own = _numbers(part)
        out.setdefault(shape, []).append((k, own))
    return out


@cache
def page_classifier(seed: int = 4) -> np.ndarray:
    """Logistic weights of page_features, fitted on generated pages whose numbers have many forms, among short lines with numbers of other kinds."""
    rng = random.Random(seed)
    word = lambda a=3, b=8: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(a, b)))
    forms = ("- {0} -", "[{0}]", "{0}", "— {0} —", "({0})", "{1} {0}", "{1}. {0}", "{0} / {2}", "{0}/{2}", "{1} {0} {3} {2}", "第{0}页", "第 {0} 页", "第{0}页 共{2}页", "-{0}-")
    strange = ("{0}. {4}", "{0} {4}", "{4} {0}.", "{0}%", "2031-0{5}-1{5}", "{0}.{5}0 {4}", "{4} {0} {4}", "{0}份。", "{4}, {0}", "({0}) {4}", "{0}, {2}, {6}", "{4} no. {0}.", "{0} {2} {6} {5}", "§ {0} {4}")
    rows, truth = [], []
    for _ in range(500):
        form, title, count = rng.choice(forms), rng.choice((word(1, 4), word(4, 6).capitalize(), "p", "Page", "S")), rng.randint(1, 6)
        first, total, other = rng.randint(1, 300), rng.randint(300, 400), word(2, 3)
        lines, kinds = [], []
        for page in range(count):
            for _ in range(rng.randint(3, 9)):
                if rng.random() < 0.15:
                    lines.append(rng.choice(strange).format(rng.randint(1, 99), title, rng.randint(1, 99), other, word() if rng.random() < 0.5 else f"{word()} {word()}", rng.randint(1, 9), rng.randint(1, 99)))
                else:
                    lines.append((" ".join(word() for _ in range(8)))[:48] + rng.choice(("", "", ".")))
                kinds.append(0.0)
            number = str(first + page)
            if rng.random() < 0.15:
                number = number.replace("1", rng.choice("lI|")).replace("0", "O")
            lines.append(form.format(number, title, total, other))
            kinds.append(1.0)
        parts = {k: x for k, x in enumerate(lines) if _may_number(x, 46)}
        others = _pages_of(parts)
        for k, part in parts.items():
            rows.append(page_features(part, lines, k, others, 46))
            truth.append(kinds[k])
    return _logistic(np.array(rows), np.array(truth))


def _may_number(line: str, usual: int) -> bool:
    """Whether a line is short and has a digit, or consists of what is read for digits."""
    t = line.strip()
    return 0 < len(t) <= max(12, 0.6 * usual) and (any(c.isdigit() for c in t) or bool(_PAGE_LINE.match(t)) and any(c in "lIO|" for c in t) and (not t.isalpha() or bool(re.fullmatch(r"[lIO]{1,3}", t))))


def pair_features(lines: list[str], pages: set[int], usual: int, i: int, j: int, alike: float) -> np.ndarray:
    """What two lines have that may be one heading on two pages."""
    near = [k == 0 or k - 1 in pages or k + 1 in pages or k == len(lines) - 1 for k in (i, j)]
    breaks = [k > 0 and bool(lines[k - 1].strip()) and not _END.search(lines[k - 1]) and (k - 1) not in pages for k in (i, j)]
    return np.array([1.0, alike, float(alike > 0.95), sum(near) / 2, sum(breaks) / 2, float(any(_END.search(lines[k]) for k in (i, j))), max(len(lines[i]), len(lines[j])) / usual, float(bool(re.search(r"[/·（]", lines[i])))])


@cache
def head_classifier(seed: int = 3) -> np.ndarray:
    """Logistic weights of pair_features, fitted on generated pages with headings of pages and of sections."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 8)))
    rows, truth = [], []
    for _ in range(400):
        head = " ".join(word() for _ in range(rng.randint(2, 4)))
        head = rng.choice((head, head.upper(), head.replace(" ", " / ", 1)))
        section = rng.choice(("open points", "summary of the " + word()))
        lines, kind = [], []
        numbered, headed = rng.random() < 0.7, rng.random() < 0.6
        for page in range(rng.randint(2, 5)):
            if headed:
                damaged = list(head)
                if rng.random() < 0.4:
                    damaged[rng.randrange(len(damaged))] = rng.choice((" ", "", ".", "i"))
                lines.append("".join(damaged))
                kind.append(1)
            for _ in range(rng.randint(4, 9)):
                if rng.random() < 0.1 and lines:
                    lines.append(section)
                    lines[-2] = lines[-2].rstrip(".") + "." if kind[-1] == 0 else lines[-2]
                    kind.append(2)
                else:
                    lines.append(" ".join(word() for _ in range(8))[:48] + rng.choice(("", "", "", ".")))
                    kind.append(0)
            if numbered:
                lines.append(f"[{page + 3}]")
                kind.append(3)
        pages = {k for k, x in enumerate(kind) if x == 3}
        share = _alike_matrix([_grams(x) for x in lines])
        for i, j in zip(*np.nonzero(np.triu(share >= ALIKE, 1))):
            if not {int(i), int(j)} & pages:
                rows.append(pair_features(lines, pages, 46, int(i), int(j), float(share[i, j])))
                truth.append(float(kind[i] == kind[j] == 1))
    return _logistic(np.array(rows), np.array(truth))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def _alike_lines(asked: list[int], grams: dict[int, Counter]) -> Iterator[tuple[int, int, float]]:
    """(asked line, other line, share in common) of all pairs of lines that are ALIKE, one for each different other line.

    Lines of equal letters are one; lists of pairs of letters hold the others. Two lines that are alike share one of the rarest of either, since
    the rest of the pairs of letters are too few.
    """
    same: dict[frozenset, list[int]] = {}
    for k, g in grams.items():
        same.setdefault(frozenset(g.items()), []).append(k)
    kinds = list(same)
    seen = Counter(x for kind in kinds for x, _ in kind)
    sizes = [sum(n for _, n in kind) for kind in kinds]
    lists: dict[str, list[int]] = {}
    heads: list[list[str]] = []
    for i, kind in enumerate(kinds):
        left, own = ALIKE / (2 - ALIKE) * sizes[i], []  # so much of a line's pairs of letters must be shared
        for x, n in sorted(kind, key=lambda e: (seen[e[0]], e[0]), reverse=True):
            left -= n
            if left <= 1e-9:
                own.append(x)
        heads.append(own)
        for x in own:
            lists.setdefault(x, []).append(i)
    wanted = set(asked)
    for i, kind in enumerate(kinds):
        mine = [k for k in same[kind] if k in wanted]
        if not mine:
            continue
        for k in mine:
            other = next((j for j in same[kind] if j != k), None)
            if other is not None:
                yield k, other, 1.0
        a = Counter(dict(kind))
        for j in {j for x in heads[i] for j in lists[x]} - {i}:
            if (share := _alike(a, Counter(dict(kinds[j])))) >= ALIKE:
                for k in mine:
                    yield from ((k, x, share) for x in same[kinds[j]])


def furniture(lines: list[str]) -> dict[int, set[str]]:
    """line -> kinds (running_head, page_no) of the lines that belong to the page, not to the text, by the line-pair classifiers."""
    out: dict[int, set[str]] = {}
    heads: dict[int, str] = {}
    filled = sorted(len(x) for x in lines if x.strip())
    usual = max(10, filled[-max(1, len(filled) // 10) - 1]) if len(filled) > 1 else 40
    parts: dict[int, str] = {}
    beside: dict[int, str] = {}
    for k, x in enumerate(lines):
        if not x.strip() or len(x) > 1.2 * usual + 20:
            continue
        if m := _PAGE_HEAD.match(x):
            if not _END.search(m[2]) and any(c.isdigit() or c in "lIO" for c in m[1]):
                parts[k], beside[k] = m[1], m[2]
                continue
        elif m := _HEAD_PAGE.match(x):
            if not _END.search(m[1]) and any(c.isdigit() or c in "lIO" for c in m[2]):
                parts[k], beside[k] = m[2], m[1]
                continue
        if _may_number(x, usual):
            parts[k] = x
    others = _pages_of(parts)
    weights = page_classifier()
    for k, part in parts.items():
        if page_features(part, lines, k, others, usual) @ weights > 0:
            out[k] = {"page_no"}
            if k in beside:
                out[k].add("running_head")
                heads[k] = beside[k]
    pages = set(out)
    short = [k for k, x in enumerate(lines) if k not in out and 2 <= len(x.strip()) <= 0.95 * usual and not _END.search(x) and not _HEADING.match(x) and x.rstrip()[-1] not in ",-，、¬­‐"]
    grams = {k: _grams(lines[k]) for k in short} | {k: _grams(h) for k, h in heads.items()}
    weights = head_classifier()
    for k, j, alike in _alike_lines(short, grams):
        if k not in out and (j in heads or pair_features(lines, pages, usual, min(k, j), max(k, j), alike) @ weights > 0):
            out[k] = {"running_head"}
    return out


# line joins
def join_features(above: str, below: str, usual: int) -> np.ndarray:
    """What two body lines have that may be one line of a paragraph broken in two."""
    start = below.lstrip()[:1]
    return np.array([1.0, float(bool(_END.search(above))), min(len(above.rstrip()) / max(1, usual), 1.3), float(start.islower()), float(start.isalpha() and start.lower() == start.upper()), float(bool(re.match(r"\s*(?:[•*\-–]|\d{1,3}[.)]) ", below))), float(bool(_END.search(above))) * min(len(above.rstrip()) / max(1, usual), 1.3)])


@cache
def join_classifier(seed: int = 6) -> np.ndarray:
    """Logistic weights of join_features, fitted on generated paragraphs broken at a column's width."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    rows, truth = [], []
    for _ in range(600):
        wide = rng.random() < 0.35  # a script without blanks and case
        width = rng.randint(18, 40) if wide else rng.randint(30, 70)
        glyph = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))
        lines, ends = [], []
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.3:
                lines.append(glyph(rng.randint(3, 8)) if wide else " ".join(word() for _ in range(3)).capitalize())
                ends.append(True)
                continue
            if wide:
                text = "".join(glyph(rng.randint(8, 30)) + "。" for _ in range(rng.randint(1, 5)))
            else:
                text = " ".join((" ".join(word() for _ in range(rng.randint(4, 14)))).capitalize() + "." for _ in range(rng.randint(1, 5)))
            while text:
                piece = text if len(text) <= width else text[:width] if wide else text[: text.rfind(" ", 0, width + 1)] or text[:width]
                text = text[len(piece) :].lstrip()
                lines.append(piece)
                ends.append(not text)
        for a, b, end in zip(lines, lines[1:], ends):
            rows.append(join_features(a, b, width))
            truth.append(float(not end))
    return _logistic(np.array(rows), np.array(truth))


# ------------------------------------------------------------------------------------------------------------- boosted ranking
def confusion(word: str, candidate: str) -> tuple[float, int, int]:
    """(1 if one known confusion turns the candidate into the word, edit distance of at most 4, place of the first difference)."""
    a = 0
    while a < min(len(word), len(candidate)) and word[a] == candidate[a]:
        a += 1
    b = 0
    while b < min(len(word), len(candidate)) - a and word[-1 - b] == candidate[-1 - b]:
        b += 1
    x, y = candidate[a : len(candidate) - b], word[a : len(word) - b]
    known = 0.0
    for right, wrong in CONFUSED:
        for p, q in ((right, wrong), (wrong, right)):
            if (x, y) == (p, q) or (len(x) < 3 and len(y) < 3 and any(word == candidate[:k] + q + candidate[k + len(p) :] for k in range(max(0, a - 1), a + 1) if candidate.startswith(p, k))):
                known = 1.0
    distance = max(len(x), len(y))
    if len(x) > 1 and len(y) > 1 and distance <= 8:
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        distance = row[-1]
    return known, min(distance, 4), a


def rank_features(word: str, candidate: str, count: int) -> list[float]:
    known, distance, at = confusion(word, candidate)
    ga, gb = _bigrams(word), _bigrams(candidate)
    return [known, float(distance), len(set(ga) & set(gb)) / max(1, len(set(ga) | set(gb))), float(np.log1p(count)), float(len(candidate)), float(len(word) - len(candidate)), float(at == 0), float(any(not c.isalpha() for c in word)), distance / max(1, len(candidate))]


def _bigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[k : k + 2] for k in range(len(w) - 1)]


class Boosted:
    """Gradient-boosted trees of depth two for the logistic loss."""

    def __init__(self, trees: int = 40, rate: float = 0.3):
        self.trees, self.rate, self.base = trees, rate, 0.0
        self.nodes: list[tuple] = []

    def _split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        best = (0.0, 0, -np.inf)
        for f in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 13))):
                left = x[:, f] <= cut
                gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
                gain = gl * gl / (hl + 1) + gr * gr / (hr + 1)
                if gain > best[0] + 1e-12:
                    best = (gain, f, float(cut))
        return best[1], best[2]

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            f, cut = self._split(x, g, h)
            tree = [f, cut]
            for side in (x[:, f] <= cut, x[:, f] > cut):
                f2, cut2 = self._split(x[side], g[side], h[side]) if side.sum() > 20 else (0, -np.inf)
                values = []
                for leaf in (side & (x[:, f2] <= cut2), side & (x[:, f2] > cut2)):
                    value = self.rate * float(g[leaf].sum() / (h[leaf].sum() + 1))
                    score[leaf] += value
                    values.append(value)
                tree += [f2, cut2, *values]
            self.nodes.append(tuple(tree))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, cut, f1, c1, a, b, f2, c2, c, d in self.nodes:
            left = x[:, f] <= cut
            out += np.where(left, np.where(x[:, f1] <= c1, a, b), np.where(x[:, f2] <= c2, c, d))
        return out


def fitted_ranking(words: list[tuple[str, int]], seed: int = 9) -> Boosted:
    """Boosted trees that tell the word a misread one stands for, fitted on known words with single confusions put into them."""
    rng = random.Random(seed)
    rows, truth = [], []
    by: dict[str, set[int]] = {}
    for k, (w, _) in enumerate(words):
        for g in set(_bigrams(w)):
            by.setdefault(g, set()).add(k)
    known = {w for w, _ in words}
    for w, _ in words:
        if len(w) < 3:
            continue
        right, wrong = rng.choice([p for p in CONFUSED if p[0] in w] or [(w[0], rng.choice("aeinrst"))])
        at = rng.choice([k for k in range(len(w)) if w.startswith(right, k)])
        bad = w[:at] + wrong + w[at + len(right) :]
        strange = rng.random() < 0.4  # a word that is none of the known ones
        if strange:
            bad = "".join(rng.choice("abcdefghiklmnoprstuvwz") for _ in range(len(w)))
        if bad in known:
            continue
        shared = Counter(k for g in set(_bigrams(bad)) for k in by.get(g, ()))
        for k, _n in shared.most_common(6):
            c, n = words[k]
            rows.append(rank_features(bad, c, n))
            truth.append(float(c == w and not strange))
    if not rows or not 0 < sum(truth) < len(truth):
        return Boosted(trees=0)
    return Boosted().fit(np.array(rows), np.array(truth))


# -------------------------------------------------------------------------------------------------------------------- operators
#: Signs inside addresses, paths and names of files and fields: what of them is misread can't be told by words.
_NO_WORD = re.compile(r"[@/\\_.]")


def _clean(token: str) -> str:
    """A token without the marks around it, in lower case; '' where it holds no letter or too many digits, or is an address or a name of a file."""
    t = token.strip(_STRIP).casefold()
    letters = sum(c.isalpha() for c in t)
    if letters < 2 or _NO_WORD.search(t) or _HAN.search(t) or letters < 0.5 * len(t):
        return ""
    return t


def _body(lines: list[str], broken: bool) -> tuple[dict[int, set[str]], list[int]]:
    apart = furniture(lines) if broken else {}
    return apart, [k for k, x in enumerate(lines) if k not in apart and x.strip()]


def _signs(text: str) -> str:
    """Han text as its windows see it: digits and Latin letters one sign each, blanks left out."""
    return re.sub(r"[A-Za-zÀ-ÿ]+", "a", re.sub(r"\d+", "0", re.sub(r"\s+", "", text)))


def _placed_signs(line: str) -> list[tuple[str, int]]:
    """The signs of _signs(line), each with its place in the line."""
    return [("a" if m[1] else "0" if m[0][0].isdecimal() else m[0], m.start()) for m in _SIGN.finditer(line)]


class _Reading:
    """What the scanned texts of a batch hold: few rows of furniture and broken words, and the places of each different word and Han window.

    Places are kept as runs: of a text's line, how many there are, and then each one's unit, place and size.
    """

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.units: dict[tuple[str, str], int] = {}
        self.owner: list[int] = []
        self.places: list[int] = []
        self.sizes: list[int] = []
        self.runs: list[tuple[int, int, int]] = []
        self._tokens: dict[str, tuple[int, int, int]] = {}
        self._windows: dict[str, int] = {}

    def _unit(self, role: str, unit: str) -> int:
        return self.units.setdefault((role, unit), len(self.units))

    def _token(self, raw: str) -> tuple[int, int, int]:
        """(its unit, or -1; where that begins in it; its length)."""
        if _LIGATURES.search(raw):
            known = (self._unit("joined", raw), 0, len(raw))
        else:
            word = _clean(raw)
            known = (self._unit("word", word) if word else -1, len(raw) - len(raw.lstrip(_STRIP)), len(raw.strip(_STRIP)))
        self._tokens[raw] = known
        return known

    def read(self, doc_id: int, text: str) -> None:
        lines = text.split("\n")
        apart, body = _body(lines, is_broken(text))
        rows = self.rows
        rows += [(doc_id, k, "furniture", kind, None, 0) for k, kinds in apart.items() for kind in kinds]
        skip: set[tuple[int, int]] = set()
        for n, k in enumerate(body):
            m = _HYPHEN.search(lines[k]) if lines[k].rstrip()[-1:] in "-¬\xad‐" else None
            if m and n + 1 < len(body):
                j = body[n + 1]
                following = _TOKEN.search(lines[j])
                if following and any(c.isalpha() for c in following[0]) and following[0][0] not in _STRIP:
                    head, tail = _clean(m[1]) or m[1].casefold(), following[0].strip(_STRIP).casefold()
                    rows.append((doc_id, k, "broken", head + tail, f"{head}-{tail}", len(head) if m[2] == "-" else -len(head)))
                    rows.append((doc_id, j, "tail", head + tail, None, len(head)))
                    skip |= {(k, lines[k].rfind(" ", 0, m.start(1) + 1) + 1), (j, following.start())}
        owner, places, sizes, tokens = self.owner, self.places, self.sizes, self._tokens
        first = len(owner)
        for k in body:
            before_line = len(owner)
            for m in _TOKEN.finditer(lines[k]):
                raw = m[0]
                unit, before, size = tokens.get(raw) or self._token(raw)
                if unit >= 0:
                    at = m.start()
                    if not skip or (k, at) not in skip:
                        owner.append(unit)
                        places.append(at + before)
                        sizes.append(size)
            self.runs.append((doc_id, k, len(owner) - before_line))
        if len(owner) > first:
            rows.append((doc_id, None, "words", None, None, len(owner) - first))
        if _HAN.search(text):
            placed = [_placed_signs(lines[k]) for k in body]
            joined = _EDGE * 2 + "".join(c for line in placed for c, _ in line) + _EDGE * 2
            windows, i = self._windows, 0
            for k, line in zip(body, placed):
                before_line = len(owner)
                for c, at in line:
                    if "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff":
                        window = joined[i : i + 5]
                        unit = windows.get(window)
                        if unit is None:
                            unit = windows[window] = self._unit("han", window)
                        owner.append(unit)
                        places.append(at)
                    i += 1
                n = len(owner) - before_line
                sizes += [1] * n
                self.runs.append((doc_id, k, n))

    def batch(self) -> pa.RecordBatch:
        owner = np.array(self.owner, np.int64)
        order = np.argsort(owner, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(self.units)))])
        docs, lines, counts = (np.array(x, np.int64) for x in zip(*self.runs)) if self.runs else (np.zeros(0, np.int64),) * 3
        columns = (np.repeat(docs, counts), np.repeat(lines, counts).astype(np.int32), np.array(self.places, np.int32), np.array(self.sizes, np.int32))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(x[order]) for x in columns], ["doc_id", "line_no", "place", "size"]))
        n, m = len(self.rows), len(self.units)
        few = list(zip(*self.rows)) if n else [()] * 6
        more = ([None] * m, [None] * m, [r for r, _ in self.units], [u for _, u in self.units], [unicodedata.normalize("NFKC", u) if r == "joined" else None for r, u in self.units], [None] * m)
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32())
        arrays = [pa.array([*c, *x], t) for c, x, t in zip(few, more, kinds)]
        return pa.RecordBatch.from_arrays([*arrays, pa.concat_arrays([pa.nulls(n, lists.type), lists])], names=["doc_id", "line_no", "role", "unit", "second", "at", "places"])


def is_scan(docs: DataFrame):
    """Condition of documents that may be scanned, by their file type or parser."""
    return F.coalesce(F.lower("file_type").isin(*SCANNED_TYPES), F.lit(False)) | F.coalesce(F.col("parser_name") == SCANNED_PARSER, F.lit(False))


def _strings(values) -> pa.Array:
    return pa.array(values, pa.string())


def occurrences(docs: DataFrame) -> DataFrame:
    """The words, broken words and Han windows of all scanned texts, and the furniture of those that are columns of prose.

    role is furniture (unit its kind), broken (unit the joined word, second the word with its hyphen, at the length of its first part, below zero where
    the hyphen is no plain one), tail (the line in which it ends), words (at their number in a text), or, with all their places in a batch of texts in
    one row: word, joined (letters taken together, second with them apart) and han (a window of five signs). A place tells where in its line the word, or the sign in the
    middle of a window, stands. Texts that share words share rows, so what is joined later are different words, not all words.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        reading = _Reading()
        for d, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            reading.read(d, t)
        return reading.batch()

    source = docs.where(is_scan(docs)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_arrow(spread(source), lambda: work, "doc_id bigint, line_no int, role string, unit string, second string, at int, places array<struct<doc_id:bigint,line_no:int,place:int,size:int>>")


def vocabulary(docs: DataFrame) -> DataFrame:
    """unit, n: words and Han windows of three signs of all born-digital texts with their counts; counted in batches, then together."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, signs = Counter(), []
        for t in texts_of(batch.column(0)):
            if not _HAN.search(t):
                raw.update(t.split())
            else:
                signs += map(_signs, t.split("\n"))
                raw.update(x for x in re.findall(r"[A-Za-zÀ-ÿ][\w'\-]+", t))
        words: Counter = Counter()
        for x, n in raw.items():
            if c := _clean(x):
                words[c] += n
        windows: Counter = Counter()
        for s in signs:
            windows.update(map("".join, zip(s, s[1:], s[2:])))
        units = [*words, *(w for w in windows if _HAN.search(w))]
        return pa.RecordBatch.from_arrays([_strings(units), pa.array([words[w] if w in words else windows[w] for w in units], pa.int64())], names=["unit", "n"])

    source = docs.where(~is_scan(docs)).select("text")
    return map_arrow(spread(source), lambda: work, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))


def _candidates(unknown: DataFrame, vocab: DataFrame, often: int) -> DataFrame:
    """unit, candidate, n: known words that share enough groups of two letters with an unknown word, by a join of inverted lists.

    A candidate shares all but four groups of the unknown word, at least two: so it is in the list of one of the word's rarest groups, whatever
    these are. Only their lists are read, not those of frequent groups; lists are kept apart by the words' lengths. The shared groups are then counted exactly.
    """
    padded = lambda c: F.concat(F.lit("^"), F.col(c), F.lit("$"))
    groups = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda k: F.substring(padded(c), k, 2)))
    right = vocab.where((F.col("n") >= often) & (F.length("unit") >= 3)).select(F.col("unit").alias("candidate"), "n", F.length("unit").alias("length"), groups("unit").alias("c_groups"))
    counts = right.select(F.explode("c_groups").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("words"))  # pairs of letters
    left = unknown.select("unit", F.length("unit").alias("size"), groups("unit").alias("u_groups")).withColumn("need", F.greatest(F.lit(2), F.col("size") - 4))
    ranked = left.select("*", F.explode("u_groups").alias("gram")).join(counts, "gram", "left").groupBy("unit", "size", "need").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("words", F.lit(0)).alias("words"), "gram"))).alias("order"))
    asked = ranked.select("unit", "size", "need", F.explode(F.slice("order", 1, F.greatest(F.lit(1), F.size("order") - F.col("need") + 1))).alias("g")).select("unit", "size", "need", "g.gram", F.explode(F.sequence(F.col("size") - 2, F.col("size") + 2)).alias("length"))
    met = asked.join(right.select("candidate", "n", "length", F.explode("c_groups").alias("gram")), ["gram", "length"]).select("unit", "need", "candidate", "n").where(F.levenshtein("unit", "candidate") <= F.greatest(F.lit(MOST_EDITS), F.floor(F.length("unit") / 4))).distinct()
    return met.where(F.size(F.array_intersect(groups("unit"), groups("candidate"))) >= F.col("need")).select("unit", "candidate", "n")


def word_corrections(unknown: DataFrame, vocab: DataFrame, often: int = CORRECTION) -> DataFrame:
    """unit, correction, score, place: for unknown words, the best candidate where the boosted ranking takes it for the word meant."""
    spark = vocab.sparkSession
    frequent = vocab.where((F.length("unit") >= 3) & (F.col("n") >= often) & F.col("unit").rlike(r"^[\p{L}]+$") & ~F.col("unit").rlike(r"\p{IsHan}"))
    sample = [(r.unit, int(r.n)) for r in frequent.orderBy(F.desc("n"), "unit").limit(FIT_WORDS).collect()]
    trees = spark.sparkContext.broadcast(fitted_ranking(sample).__dict__)

    def make():
        ranking = Boosted.__new__(Boosted)
        ranking.__dict__.update(trees.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            scores = ranking.score(np.array([rank_features(*x) for x in rows]))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([confusion(u, c)[2] for u, c, _ in rows], pa.int32())], names=["unit", "correction", "score", "place"])

        return work

    ranked = map_arrow(_candidates(unknown, vocab, often), make, "unit string, correction string, score double, place int")
    best = Window.partitionBy("unit").orderBy(F.desc("score"), "correction")
    return ranked.where("score > 0").withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def _edge_corrections(windows: DataFrame, tri: DataFrame, often: int) -> DataFrame:
    """unit, correction of windows at the edges of a text, from those of their three windows that hold no edge: one or two."""
    part = lambda at: F.substring("unit", at, 3)
    others = lambda c, gap: F.concat(*[F.substring(c, k, 1) for k in (1, 2, 3) if k != gap])
    whole = lambda at: ~F.contains(part(at), F.lit(_EDGE))
    main = F.when(whole(2), part(2)).when(whole(1), part(1)).otherwise(part(3))
    odd = windows.withColumn("main", main).join(tri.select(F.col("unit").alias("main")), "main", "left_anti").select("unit")
    asked = F.explode(F.filter(F.array(*[F.when(whole(at), F.struct(F.lit(4 - at).alias("gap"), others(part(at), 4 - at).alias("others"))) for at in (1, 2, 3)]), lambda x: x.isNotNull()))
    asked = odd.select("unit", asked.alias("x")).select("unit", "x.gap", "x.others").withColumn("asked", F.count(F.lit(1)).over(Window.partitionBy("unit")))
    lists = tri.where(F.col("n") >= often).select("n", F.explode(F.array(*[F.struct(F.lit(gap).alias("gap"), others("unit", gap).alias("others"), F.substring("unit", gap, 1).alias("correction")) for gap in (1, 2, 3)])).alias("y")).select("n", "y.*")
    met = asked.join(lists, ["gap", "others"]).where(F.col("correction") != F.substring("unit", 3, 1))
    return met.groupBy("unit", "correction", "asked").agg(F.count(F.lit(1)).alias("met"), F.min("n").alias("n")).where("met = asked").select("unit", "correction", "n")


def han_corrections(windows: DataFrame, vocab: DataFrame, often: int = CORRECTION) -> DataFrame:
    """unit, correction: windows of five signs whose middle is unknown between its neighbours, and the sign that makes all three windows known.

    At the edges of a text, one or two of the windows do not exist; the others decide.
    """
    tri = vocab.where(F.length("unit") == 3)
    edge = F.contains(F.col("unit"), F.lit(_EDGE))
    edges = _edge_corrections(windows.where(edge), tri, often)
    odd = windows.where(~edge).join(tri.select(F.col("unit").alias("mid")), F.substring("unit", 2, 3) == F.col("mid"), "left_anti")
    lists = tri.where(F.col("n") >= often).select(F.concat(F.substring("unit", 1, 1), F.substring("unit", 3, 1)).alias("sides"), F.substring("unit", 2, 1).alias("correction"), F.col("n").alias("n2"))
    met = odd.withColumn("sides", F.concat(F.substring("unit", 2, 1), F.substring("unit", 4, 1))).join(lists, "sides").where(F.col("correction") != F.substring("unit", 3, 1))
    counts = lambda name: tri.where(F.col("n") >= often).select(F.col("unit").alias("tri"), F.col("n").alias(name))
    met = met.withColumn("tri", F.concat(F.substring("unit", 1, 2), "correction")).join(counts("n1"), "tri").drop("tri")
    met = met.withColumn("tri", F.concat("correction", F.substring("unit", 4, 2))).join(counts("n3"), "tri").drop("tri")
    met = met.select("unit", "correction", F.least("n1", "n2", "n3").alias("n")).unionByName(edges)
    best = Window.partitionBy("unit").orderBy(F.desc("n"), "correction")
    return met.where(F.col("correction").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")).withColumn("nth", F.row_number().over(best)).where("nth = 1").select("unit", "correction")


def hyphen_weights(vocab: DataFrame, compounds: DataFrame) -> list[float]:
    """Weights of the classifier of two lines of which the first ends with a hyphen, fitted on known words broken at random and on known words with a
    hyphen of their own; on at most FIT_WORDS of either."""
    rows = vocab.where((F.length("unit") >= 5) & ~F.contains("unit", F.lit("-"))).orderBy(F.desc("n"), "unit").limit(FIT_WORDS).collect()
    own = compounds.orderBy(F.desc("n"), "unit").limit(FIT_WORDS).collect()
    counts = {r.unit: int(r.n) for r in [*rows, *own]}
    rng = random.Random(17)
    x, y = [], []
    for r in rows:
        at = rng.randint(2, len(r.unit) - 2)
        x.append(hyphen_features(False, counts.get(r.unit, 0) * (rng.random() < 0.8), counts.get(f"{r.unit[:at]}-{r.unit[at:]}", 0), len(r.unit)))
        y.append(1.0)
    made = [(f"{rng.choice(rows).unit}-{rng.choice(rows).unit}", rng.randint(2, 40)) for _ in range(200)] if rows else []
    for unit, n in [*((r.unit, int(r.n)) for r in own), *made]:
        x.append(hyphen_features(False, counts.get(unit.replace("-", ""), 0), n, len(unit)))
        y.append(0.0)
    x += [hyphen_features(True, 0, 0, 8)] * 20
    y += [1.0] * 20
    return _logistic(np.array(x), np.array(y)).tolist() if x else [1.0, 0.0, 0.0, 0.0, 0.0]


def hyphen_features(soft: bool, joined: int, hyphened: int, size: int) -> list[float]:
    """Whether the hyphen is one that only breaks words, how often the joined word and the one with a hyphen are known, which is more, and the size."""
    return [1.0, float(soft), math.log1p(joined), -math.log1p(hyphened), float(joined >= hyphened)]


def noise(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, noise_kind, unit, correction, place, size: the noise of all scanned texts, line by line.

    running_head and page_no come from the line-pair classifiers, of texts that are columns of prose; hyphen where the classifier of two lines joins
    the word; misread where a word or Han sign has a correction, unless most words of its text are unknown. Texts that are not scanned have none; null
    texts neither. place and size tell what of the line the correction replaces; they are null where it is a line, or a word broken over two.
    """
    spark = docs.sparkSession
    ship(spark)
    nowhere = (F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("size"))
    found = cut(occurrences(docs))
    vocab = cut(vocabulary(docs))
    every = vocab.agg(F.sum(F.when(F.col("unit").rlike(_HAN.pattern), 0).otherwise(F.col("n"))).alias("words"), F.sum(F.when(F.col("unit").rlike(_HAN.pattern), F.col("n")).otherwise(0)).alias("windows")).first()
    words_known, words_often = (max(least, math.ceil(k * SHARE * (every.words or 0))) for k, least in ((1, KNOWN), (2, CORRECTION)))
    windows_often = max(CORRECTION, math.ceil(2 * SHARE * (every.windows or 0)))
    known = vocab.where(F.col("n") >= words_known).select(F.col("unit").alias("known_unit"))
    # words with a hyphen of their own may stand in scanned texts only
    own = found.where("role = 'word' and instr(unit, '-') > 0").groupBy("unit").agg(F.sum(F.size("places")).alias("n"))
    seen = cut(vocab.where(~F.col("unit").rlike(_HAN.pattern)).select("unit", "n").unionByName(own).groupBy("unit").agg(F.sum("n").alias("n")))
    spoken = found.where("role in ('word', 'broken')").select("unit").distinct()
    # written, these tables have a known size: small ones are broadcast, and the places of all words stay where they are
    unknown = cut(spoken.where(F.length("unit") >= 3).join(known, F.col("unit") == F.col("known_unit"), "left_anti"))
    places = lambda frame, *columns: frame.select(*columns, F.explode("places").alias("p")).select(*columns, "p.*")
    odd = cut(places(found.where("role = 'word'").select("unit", "places").join(unknown, "unit", "left_semi"), "unit"))
    strange = odd.groupBy("doc_id").agg(F.count(F.lit(1)).alias("odd")).join(found.where("role = 'words'").select("doc_id", "at"), "doc_id").where(F.col("odd") >= STRANGE * F.col("at")).select("doc_id").distinct()
    broken_units = found.where("role = 'broken'").select("doc_id", "unit").join(unknown, "unit", "left_semi")
    asked = odd.select("doc_id", "unit").unionByName(broken_units).join(strange, "doc_id", "left_anti").select("unit").distinct()
    fixes = cut(word_corrections(asked, vocab, words_often))
    furniture_rows = found.where("role = 'furniture'").select("doc_id", "line_no", F.col("unit").alias("noise_kind"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("correction"), *nowhere)
    shape = ["doc_id", "line_no", F.lit("misread").alias("noise_kind"), "unit", "correction", "place", "size"]
    taken = places(found.where("role = 'joined'").select("unit", F.col("second").alias("correction"), "places"), "unit", "correction").select(*shape)
    misread = odd.join(fixes.select("unit", "correction"), "unit").select(*shape)
    broken = found.where("role = 'broken'").drop("places").join(seen.select("unit", F.col("n").alias("joined_n")), "unit", "left").join(seen.select(F.col("unit").alias("second"), F.col("n").alias("hyphen_n")), "second", "left").join(fixes.select("unit", "correction"), "unit", "left")
    joined_n, hyphen_n = F.coalesce("joined_n", F.lit(0)), F.coalesce("hyphen_n", F.lit(0))
    w = hyphen_weights(vocab.where(~F.col("unit").rlike(_HAN.pattern) & (F.col("n") >= words_known)), seen.where(F.contains("unit", F.lit("-")) & (F.col("n") >= words_known)))
    really = F.lit(w[0]) + w[1] * (F.col("at") < 0).cast("int") + w[2] * F.log1p(joined_n) - w[3] * F.log1p(hyphen_n) + w[4] * (joined_n >= hyphen_n).cast("int") > 0
    hyphens = broken.where(really).select("doc_id", "line_no", F.lit("hyphen").alias("noise_kind"), "unit", F.coalesce("correction", "unit").alias("correction"), *nowhere)
    # a misread sign in a broken word stands in the line that holds it
    parts = found.where("role in ('broken', 'tail')").drop("places").join(fixes, "unit").where(F.when(F.col("role") == "broken", F.col("place") < F.abs("at")).otherwise(F.col("place") >= F.abs("at")))
    misparts = parts.select("doc_id", "line_no", F.lit("misread").alias("noise_kind"), "unit", "correction", *nowhere)
    han = found.where("role = 'han'").select("unit", "places")
    han_fixes = cut(han_corrections(han.select("unit").distinct(), vocab, windows_often))
    signs = places(han.join(han_fixes, "unit"), "unit", "correction").select(*shape)
    told = misread.unionByName(misparts).unionByName(signs).join(strange, "doc_id", "left_anti")
    return furniture_rows.unionByName(told).unionByName(taken).unionByName(hyphens)


def noisy_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, noise_kind, one row each."""
    return noise(docs).select("doc_id", "line_no", "noise_kind").distinct()


def _cased(correction: str, raw: str) -> str:
    """A correction in the case of what it replaces; letters that were only taken together keep theirs."""
    if unicodedata.normalize("NFKC", raw) == correction:
        return correction
    return correction.upper() if len(raw) > 1 and raw.isupper() else correction.capitalize() if raw[:1].isupper() else correction


Found = list[tuple[int, str, str | None, str | None, int | None, int | None]]


def _repaired_lines(lines: list[str], found: Found) -> dict[int, tuple[str, bool]]:
    """line -> (its repaired text, whether a word goes on in the next body line) of the lines that are not furniture nor blank.

    A broken word is restored in the line where it begins; misread words and signs are replaced where they stand.
    """
    apart = {k for k, kind, *_ in found if kind in ("running_head", "page_no")}
    joins = {k: (unit, correction) for k, kind, unit, correction, *_ in found if kind == "hyphen"}
    fixes: dict[int, list[tuple[int, int, str]]] = {}
    for k, kind, _, correction, place, size in found:
        if kind == "misread" and correction and place is not None:
            fixes.setdefault(k, []).append((place, size, correction))
    body = [k for k, x in enumerate(lines) if k not in apart and x.strip()]
    out: dict[int, tuple[str, bool]] = {}
    rest = False
    for n, k in enumerate(body):
        line = lines[k]
        for place, size, correction in sorted(fixes.get(k, ()), reverse=True):
            line = line[:place] + _cased(correction, line[place : place + size]) + line[place + size :]
        if rest:  # its first word, or the end of one, stands in the line before
            following = _TOKEN.search(line)
            line = line[following.start() + len(following[0].strip(_STRIP)) :] if following else line
        m = _HYPHEN.search(line) if k in joins and n + 1 < len(body) else None
        rest = bool(m)
        if m:
            unit, correction = joins[k]
            tail = _TOKEN.search(lines[body[n + 1]])
            whole = _cased(correction, m[1]) if unit != correction else m[1] + (tail[0].strip(_STRIP) if tail else "")
            line = line[: m.start(1)] + whole
        out[k] = (line.rstrip() if not m else line, rest)
    return out


def _repair(text: str, found: Found) -> str:
    """A scanned text as paragraphs: furniture gone, broken words joined, misread ones replaced, and lines that go on joined by the line-pair classifier."""
    lines = text.split("\n")
    repaired_ = _repaired_lines(lines, found)
    filled = sorted(len(x) for x in lines if x.strip())
    usual = filled[-max(1, len(filled) // 10) - 1] if len(filled) > 1 else 0
    body = list(repaired_)
    out: list[str] = []
    for n, k in enumerate(body):
        line, goes_on = repaired_[k]
        out.append(line)
        if n + 1 == len(body):
            break
        j = body[n + 1]
        apart = any(not lines[x].strip() for x in range(k + 1, j)) and not any(lines[x].strip() for x in range(k + 1, j))
        if goes_on:  # what is left of the next line begins with the signs behind the word
            continue
        if apart:
            out.append("\n\n")
        elif join_features(lines[k], lines[j], usual) @ join_classifier() > 0:
            out.append("" if _HAN.search(line[-1:]) or line[-1:] in "，。、；：" else " ")
        else:
            out.append("\n")
    return "".join(out)


def _listed(found) -> Found:
    return sorted(((x["line_no"], x["noise_kind"], x["unit"], x["correction"], x["place"], x["size"]) for x in found or ()), key=str)


def _noise_of(docs: DataFrame) -> DataFrame:
    return noise(docs).groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "noise_kind", "unit", "correction", "place", "size")).alias("found"))


def repaired(docs: DataFrame) -> DataFrame:
    """doc_id, text, noisy_lines of every document: scanned ones with noise as continuous paragraphs without furniture, all others as they are.

    A null text stays null.
    """
    joined = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(_noise_of(docs), "doc_id", "left")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, n = [], []
        for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            marks = _listed(found)
            out.append(_repair(t, marks) if t and marks else t)
            n.append(len({k for k, *_ in marks}))
        return pa.RecordBatch.from_arrays([batch.column(0), _strings(out), pa.array(n, pa.int32())], names=["doc_id", "text", "noisy_lines"])

    return map_arrow(joined, lambda: work, "doc_id bigint, text string, noisy_lines int")


def repaired_blocks(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """block_row_id, doc_id, block_index, text of the blocks of documents with noise: the lines that a block holds as a whole, repaired.

    Lines of furniture go, so a block of nothing else is empty; a broken word stands in the block where it begins. What a block holds of a line only in
    part stays as it is. Repeated rows count once; blocks of other documents, and those without a place in the text, are left out.
    """
    ship(docs.sparkSession)
    places = blocks.select("doc_id", "block_row_id", "block_index", "global_start", "global_end").where("global_start is not null and global_end is not null")
    lists = places.groupBy("doc_id").agg(F.collect_set(F.struct("block_row_id", "block_index", "global_start", "global_end")).alias("blocks"))
    joined = _noise_of(docs).join(lists, "doc_id").join(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null"), "doc_id")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for d, t, found, own in zip(*(batch.column(k).to_pylist() for k in range(4))):
            lines = t.split("\n")
            fixed = _repaired_lines(lines, _listed(found))
            apart = {x["line_no"] for x in found if x["noise_kind"] in ("running_head", "page_no")}
            starts = list(accumulate((len(x) + 1 for x in lines), initial=0))
            for b in own:
                out, at = [], b["global_start"]
                k = bisect_left(starts, at)
                if k == len(starts) or starts[k] != at:  # the rest of a line
                    end = min(b["global_end"], starts[k] - 1 if k < len(starts) else len(t))
                    out.append(t[at:end])
                while k < len(lines) and starts[k] + len(lines[k]) <= b["global_end"]:
                    if k not in apart:
                        out.append(fixed[k][0] if k in fixed else lines[k])
                    k += 1
                if k < len(lines) and starts[k] < b["global_end"]:
                    out.append(t[starts[k] : b["global_end"]])
                rows.append((b["block_row_id"], d, b["block_index"], "\n".join(out)))
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["block_row_id", "doc_id", "block_index", "text"])

    return map_arrow(joined.select("doc_id", "text", "found", "blocks"), lambda: work, "block_row_id bigint, doc_id bigint, block_index int, text string")
