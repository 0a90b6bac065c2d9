"""Language of documents and of their segments: the family first, then one-versus-one linear support vector machines inside it."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import code_points, texts_of
from ..session import map_arrow, ship, small_rows, spread

#: Families and their languages; those of a family are told apart by one-versus-one machines.
FAMILIES = {"han_kana": ("zh", "ja"), "hangul": ("ko",), "cyrillic": ("ru",), "thai": ("th",), "germanic": ("de", "en"), "romance": ("es", "fr"), "none": ("und",)}
LATIN = ("germanic", "romance", "none")
LANGUAGES = tuple(x for own in FAMILIES.values() for x in own if x != "und")
#: Documents of each language label that the machines are fitted on at most, and characters of each that are used at most.
SAMPLE_DOCS, SAMPLE_CHARS = 250, 1500
#: Confidence from which a sentence is of another language than its document.
SURE = 0.9
#: Buckets for hashed character n-grams.
BUCKETS = 1 << 16
#: How much the share of Kana, the constant and the share of known letter groups count beside an n-gram vector of length one.
KANA_WEIGHT, BIAS, USUAL_WEIGHT = 100.0, 10.0, 10.0
#: Other spellings of the labels.
SPELLED = {"zho": "zh", "chi": "zh", "cmn": "zh", "eng": "en", "jpn": "ja", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru", "kor": "ko", "tha": "th", "chinese": "zh", "english": "en", "japanese": "ja", "german": "de", "french": "fr", "spanish": "es", "russian": "ru", "korean": "ko", "thai": "th", "jp": "ja", "kr": "ko", "cn": "zh"}


def normal_label(column):
    """The two-letter code, or `und`, that a label means in whatever spelling; null for none, blank and placeholders."""
    head = F.split(F.lower(F.trim(F.regexp_replace(column, r"[\s ]+", " "))), "[-_. ]")[0]
    known = F.create_map(*[F.lit(x) for pair in SPELLED.items() for x in pair])
    code = F.coalesce(F.element_at(known, head), head)
    return F.when(code.isin(*LANGUAGES, "und"), code)


#: Scripts by first and last code point; letters outside them and all signs have the last number.
SCRIPTS = ((0x61, 0x7A, 0), (0xDF, 0x24F, 1), (0x400, 0x52F, 2), (0xE01, 0xE7F, 3), (0x3041, 0x30FF, 4), (0xFF66, 0xFF9D, 4), (0x3400, 0x9FFF, 5), (0xF900, 0xFAFF, 5), (0xAC00, 0xD7A3, 6), (0x1100, 0x11FF, 6))
ACCENTED, KANA, HAN, DIGITS, BLANKS, SIGNS = 1, 4, 5, 7, 8, 9


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: what the n-grams see (case folded; digits, blanks and signs each one), and its script."""
    seen, script = np.full(0x110000, 3, np.uint32), np.full(0x110000, SIGNS, np.uint8)
    for cp in range(0x30000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        low = ord(c.lower()[0])
        if c.isspace():
            seen[cp], script[cp] = 1, BLANKS
        elif c.isdigit():
            seen[cp], script[cp] = 2, DIGITS
        elif c.isalpha() or 0xE01 <= cp <= 0xE4E:
            seen[cp] = low
            script[cp] = next((k for a, b, k in SCRIPTS if a <= low <= b), SIGNS)
    return seen, script


def _slots(points: np.ndarray) -> np.ndarray:
    """Hash buckets of the n-grams of 2 to 4 characters that end at each character: 3 rows. Those that don't end with a letter, or with
    one and a blank, have bucket 0, which weighs nothing."""
    seen = _tables()[0][points]
    p = seen.astype(np.uint64)
    letter = seen > 3
    keep = (seen == 1) | letter
    keep[1:] &= letter[:-1] | (letter[1:] & (seen[:-1] == 1))
    keep[:1] = False
    m = np.uint64(0x9E3779B97F4A7C15)
    h, out = p * m, []
    for _ in range(3):
        h = np.concatenate([h[:1], h[:-1] * np.uint64(31) + p[1:] * m])
        out.append(np.where(keep, (h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - 16), np.uint64(0)).astype(np.int32))
    return np.stack(out)


def _sums(weights: np.ndarray, texts: list[str]) -> np.ndarray:
    """N-gram weight per column of each text, scaled as that of a vector of length one."""
    out = np.zeros((len(texts), weights.shape[1]), np.float32)
    points, bounds = code_points(texts)
    if not len(points):
        return out
    slots = _slots(points)
    some = np.flatnonzero(np.diff(bounds))
    for k in range(weights.shape[1]):
        column = weights[:, k]
        per = column[slots[0]]
        per += column[slots[1]]
        per += column[slots[2]]
        out[some, k] = np.add.reduceat(per, bounds[some])
    valid = np.zeros(len(texts))
    valid[some] = np.add.reduceat(slots[0] > 0, bounds[some])
    return out / np.sqrt(np.maximum(3 * valid, 1))[:, None]


def _usual(table: np.ndarray, texts: list[str]) -> np.ndarray:
    """Share of the groups of three letters of each text that a table knows; 0 for a text without one."""
    points, bounds = code_points(texts)
    if not len(points):
        return np.zeros(len(texts))
    letter = _tables()[0][points] > 3
    letter[2:] &= letter[1:-1] & letter[:-2]
    letter[:2] = False
    known = np.concatenate([[0], np.cumsum(letter & (table[_slots(points)[1]] > 0))])
    every = np.concatenate([[0], np.cumsum(letter)])
    part = lambda x: x[bounds[1:]] - x[bounds[:-1]]
    return np.where(part(every) > 0, part(known) / np.maximum(part(every), 1), 0.0)


def _shares(texts: list[str]) -> np.ndarray:
    """Of each text, the share of each script among its signs that are not blank, a Han or Hangul sign counting three; then a constant."""
    points, bounds = code_points(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    counts = np.bincount(owner * 10 + _tables()[1][points], minlength=10 * len(texts)).reshape(-1, 10).astype(np.float64)
    counts[:, [HAN, 6]] *= 3
    counts[:, KANA] *= 3
    counts[:, BLANKS] = 0
    counts[:, DIGITS] *= 0.2
    return np.hstack([counts / np.maximum(counts.sum(1), 1)[:, None], np.ones((len(texts), 1))])


def _features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse unit vectors of n-gram counts, as (buckets, values)."""
    out = []
    for t in texts:
        points, _ = code_points([t])
        slots, counts = np.unique(_slots(points), return_counts=True)
        slots, counts = slots[slots > 0], counts[slots > 0]
        values = counts.astype(np.float64)
        out.append((slots, values / max(1e-9, float(np.sqrt((values * values).sum())))))
    return out


def _machine(vectors: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int, rounds: int = 12, cost: float = 1.0, seed: int = 11) -> np.ndarray:
    """A linear support vector machine by dual coordinate descent (hinge loss)."""
    w, alpha = np.zeros(size), np.zeros(len(vectors))
    norms = [float(v @ v) or 1.0 for _, v in vectors]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in rng.permutation(len(vectors)):
            slots, values = vectors[k]
            new = min(max(alpha[k] - (signs[k] * float(w[slots] @ values) - 1) / norms[k], 0.0), cost)
            if new != alpha[k]:
                w[slots] += (new - alpha[k]) * signs[k] * values
                alpha[k] = new
    return w


def noise(count: int, seed: int = 7) -> list[str]:
    """Lines that hold no language: symbols, letters at random, encoded bytes, repeated signs."""
    rng = np.random.default_rng(seed)
    letters, consonants = "abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz"
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    out = []
    for k in range(count):
        n = int(rng.integers(20, 120))
        kind = k % 9
        pick = lambda chars, n=n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
        if kind == 0:
            out.append(pick("!#$%&*+-/<=>?@[]^_{|}~:;\\0123456789 "))
        elif kind == 1:
            out.append(pick(base64))
        elif kind == 2:
            out.append(" ".join(pick("0123456789abcdef", 2) for _ in range(n // 3)))
        elif kind == 3:
            some = pick(consonants, int(rng.integers(6, 14)))
            out.append(" ".join(pick(some, int(rng.integers(2, 9))) for _ in range(n // 6)))
        elif kind == 4:
            out.append(" ".join(pick(letters, int(rng.integers(2, 9))) for _ in range(n // 6)))
        elif kind == 5:
            unit = pick("?.~=-xX0□■*#_ ", int(rng.integers(1, 4)))
            out.append(unit * (n // len(unit)))
        elif kind == 6:
            wrong = "".join(chr(i) for i in rng.integers(0x3000, 0x9FA0, n // 2)).encode().decode("cp1252", "replace")
            out.append("".join(wrong[i] for i in rng.permutation(len(wrong))))
        elif kind == 7:
            out.append(" ".join(pick(letters + letters.upper(), int(rng.integers(3, 14))) for _ in range(n // 8)))
        else:
            out.append(" ".join(pick("0123456789.,-/:", int(rng.integers(1, 8))) for _ in range(n // 5)))
    return out


_MAIL = re.compile(r"[\w.+-]*[@＠][\w.-]+|[\w.+-]+ ?[\[(]at[\])] ?[\w.]+(?: ?\(dot\) ?\w+)?")
#: A rough cut into sentences and lines; what follows an abbreviation is joined again by pieces().
_CUT = re.compile(r"[。！？｡]+[”」』）\"]*|[.!?]+[\"”»)]*[^\S\n]+(?![a-zß-ÿа-яё])|\n+")
_CUT_THAI = re.compile(_CUT.pattern + r"|(?<=[ก-๎]) (?=[ก-๎])")
_THAI = re.compile(r"[ก-๎]")
_SHORT = re.compile(r"(?:^|\s)\S{1,4}\.\s*\Z")


def pieces(text: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches of a text that get a language each: sentences and lines, cheaply cut."""
    out, start = [], 0
    for m in (_CUT_THAI if _THAI.search(text) else _CUT).finditer(text):
        end = m.end()
        if text[end - 1] != "\n" and end - start < 40 and text[m.start()] == "." and _SHORT.search(text, start, end):
            continue
        if text[start:end].strip():
            out.append((start, end))
        start = end
    if text[start:].strip():
        out.append((start, len(text)))
    return out


class Identifier:
    """Weights of the family machines and of the pairs inside a family, fitted on labelled texts."""

    def __init__(self, labelled: Iterable[tuple[str, str]], words: Iterable[tuple[str, str]] = (), seed: int = 11, units_per_language: int = 900):
        self.words: dict[str, set[str]] = {}
        for x, w in words:
            self.words.setdefault(x, set()).add(w)
        rng = np.random.default_rng(seed)
        by: dict[str, list[str]] = {x: [] for x in LANGUAGES}
        for t, x in labelled:
            if x in by:
                t = t[:SAMPLE_CHARS]
                by[x] += [_MAIL.sub(" ", t[a:b]) for a, b in pieces(t) if b - a >= 8 and any(c.isalpha() for c in t[a:b])]
        units = [(u, x) for x, own in by.items() for u in (own if len(own) <= units_per_language else [own[k] for k in rng.choice(len(own), units_per_language, replace=False)])]
        junk = [(u, "und") for u in noise(2 * units_per_language)]
        for again in (False, True):  # wrong labels and foreign segments go before the second fit
            if again:
                guess = self.languages([u for u, _ in units])
                units = [(u, x) for (u, x), (g, _) in zip(units, guess) if g == x]
            self._fit([*units, *junk])

    def _fit(self, units: list[tuple[str, str]]) -> None:
        script = _shares([u for u, _ in units])
        every = np.arange(script.shape[1])
        own = np.array([x for _, x in units])
        in_family = lambda names: np.isin(own, [x for f in names for x in FAMILIES[f]])
        # scripts decide between the families that have one of their own, and the Latin rest
        self.groups = [(f,) for f in FAMILIES if f not in LATIN] + [LATIN]
        targets = np.stack([np.where(in_family(g), 1.0, -1.0) for g in self.groups], 1)
        balance = 1 / np.maximum((targets > 0).sum(0), 1)[targets.argmax(1)]
        weighted = script * balance[:, None]
        self.script = np.linalg.solve(script.T @ weighted + 1e-4 * np.eye(len(every)), weighted.T @ targets)  # ridge regression on the shares
        latin = np.flatnonzero(in_family(LATIN))
        vectors = dict(zip(latin.tolist(), _features([units[k][0] for k in latin])))
        self.latin = np.zeros((BUCKETS, 3 + 2), np.float32)
        self.latin_script = np.zeros((script.shape[1] + 1, 3))
        dense = BUCKETS + np.arange(len(every) + 1)
        seen = np.zeros(1 << 16, np.int32)
        for i in latin:
            if own[i] != "und":
                np.add.at(seen, vectors[i][0], 1)
        # how usual the letter groups of a text are in the Latin languages: groups of 2 and 3 letters that several units hold
        self.usual = (seen >= 3).astype(np.float32)
        # how many of a text's letter groups are known tells whether there is a language; which one it is does not depend on that
        known = USUAL_WEIGHT * (0.75 - _usual(self.usual, [units[i][0] for i in latin]))
        both = [[(np.concatenate([vectors[i][0], dense]), np.concatenate([vectors[i][1], script[i], [u * k]])) for i, k in zip(latin, known)] for u in (0.0, 1.0)]
        for k, f in enumerate(LATIN):
            w = _machine(both[f == "none"], np.where(in_family((f,))[latin], 1.0, -1.0), BUCKETS + len(dense))
            self.latin[:, k], self.latin_script[:, k] = w[:BUCKETS], w[BUCKETS:]
        for k, f in enumerate(LATIN[:2]):
            self.latin[:, 3 + k] = self._pair(own, FAMILIES[f], vectors)
        # the share of Kana is a feature of this pair's machine, beside the n-grams
        at = np.flatnonzero(np.isin(own, FAMILIES["han_kana"]))
        rows = [(np.append(v, [BUCKETS, BUCKETS + 1]), np.append(x, [KANA_WEIGHT * script[i, KANA], BIAS])) for i, (v, x) in zip(at, _features([units[i][0] for i in at]))]
        w = _machine(rows, np.where(own[at] == FAMILIES["han_kana"][0], 1.0, -1.0), BUCKETS + 2)
        self.han, self.kana = w[:BUCKETS, None].astype(np.float32), w[BUCKETS:].tolist()

    @staticmethod
    def _pair(own, pair: tuple[str, str], vectors) -> np.ndarray:
        at = np.flatnonzero(np.isin(own, pair))
        rows = [vectors[i] for i in at]
        return _machine(rows, np.where(own[at] == pair[0], 1.0, -1.0), BUCKETS)

    def languages(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, confidence) of each text; a text without a letter is `und`."""
        if not texts:
            return []
        shares = _shares(texts)
        scores = shares @ self.script
        group = scores.argmax(1)
        group[shares[:, [*range(DIGITS)]].sum(1) == 0] = len(self.groups) - 1
        ordered = np.sort(scores, 1)
        sure = (2 * (ordered[:, -1] - ordered[:, -2])).tolist()
        out: list[tuple[str, float]] = [("und", 1.0)] * len(texts)
        for g, (family, *rest) in enumerate(self.groups):
            if not rest and family != "han_kana":
                for k in np.flatnonzero(group == g).tolist():
                    out[k] = (FAMILIES[family][0], _confidence(sure[k]))
        han = np.flatnonzero(group == self.groups.index(("han_kana",)))
        if len(han):
            pair = _sums(self.han, [texts[k] for k in han])[:, 0] + self.kana[0] * KANA_WEIGHT * shares[han, KANA] + self.kana[1] * BIAS
            for k, s in zip(han.tolist(), pair.tolist()):
                out[k] = (FAMILIES["han_kana"][0 if s > 0 else 1], _confidence(min(4 * abs(s), sure[k])))
        latin = np.flatnonzero((group == len(self.groups) - 1) & (shares[:, :2].sum(1) > 0))
        if len(latin):
            own = [texts[k] for k in latin]
            sums = _sums(self.latin, own)
            sums[:, :3] += np.hstack([shares[latin], USUAL_WEIGHT * (0.75 - _usual(self.usual, own))[:, None]]) @ self.latin_script
            family = sums[:, :2].argmax(1)
            at = np.arange(len(own))
            best, other, pair = sums[at, family], sums[at, 1 - family], sums[at, 3 + family]
            none = sums[:, 2] > best
            margin = np.where(none, sums[:, 2] - best, np.minimum(best - other, 2 * np.abs(pair)))
            for k, f, first, n, m in zip(latin.tolist(), family.tolist(), (pair > 0).tolist(), none.tolist(), margin.tolist()):
                out[k] = ("und" if n else FAMILIES[LATIN[f]][0 if first else 1], _confidence(m))
        return out


def _confidence(margin: float) -> float:
    return 1 / (1 + exp(-3 * max(-100.0, margin)))


_WORD = re.compile(r"[^\W\d_]+")
_OF_LATIN = {x for f in LATIN[:2] for x in FAMILIES[f]}


def confirmed(identifier: Identifier, sentence: str, language: str, main: str) -> bool:
    """Whether the function words of a sentence speak for its language too, where it and the main one are both written in Latin."""
    words = identifier.words
    if language not in _OF_LATIN or main not in _OF_LATIN or language not in words or main not in words:
        return True
    found = _WORD.findall(sentence.lower())
    return sum(w in words[language] for w in found) > sum(w in words[main] for w in found)


#: Marks that end a sentence.
_ENDS = re.compile(r"[.!?。！？…｡][\"'”’»」』）)\]]*\s*\Z")
_WIDE = re.compile(r"[⺀-鿿가-힣][^⺀-鿿가-힣]*[⺀-鿿가-힣][^⺀-鿿가-힣]*[⺀-鿿가-힣]")


def whole_sentence(unit: str) -> bool:
    """Whether a piece is a sentence of its own, not a heading, an entry or a remnant."""
    unit = unit.strip()
    n = len(unit)
    if _WIDE.search(unit):
        return n >= 4 and bool(_ENDS.search(unit))
    if _THAI.search(unit):
        return n >= 8
    return unit.count(" ") >= 1 and bool(_ENDS.search(unit))


def profile(texts: list[str], identifier: Identifier) -> list[tuple[list[tuple[int, int, str, float]], dict[str, float], str, float]]:
    """For each text: segments (start, end, language, confidence), whole sentences' languages with their share, main language, confidence."""
    units = [pieces(t) for t in texts]
    flat = []
    for t, own in zip(texts, units):
        own_text = [t[a:b] for a, b in own]
        if "@" in t or "＠" in t or "(at)" in t or "[at]" in t:
            own_text = [_MAIL.sub(" ", p) if "@" in p or "＠" in p or "(at)" in p or "[at]" in p else p for p in own_text]
        flat += own_text
    guesses = identifier.languages(flat)
    out, at = [], 0
    for t, own in zip(texts, units):
        told = guesses[at : at + len(own)]
        at += len(own)
        mass: dict[str, float] = {}
        for (a, b), (x, c) in zip(own, told):
            mass[x] = mass.get(x, 0.0) + (b - a) * c
        main = max(mass, key=mass.get) if mass else "und"
        present: dict[str, float] = {}
        segments: list[list] = []
        for (a, b), (x, c) in zip(own, told):
            if x != main and (x == "und" or c < SURE or not whole_sentence(t[a:b]) or not confirmed(identifier, t[a:b], x, main)):
                x = main  # remnants go with the rest
            elif x != main or (x not in present and x != "und" and whole_sentence(t[a:b])):
                present[x] = present.get(x, 0.0) + (b - a)
            if segments and segments[-1][2] == x:
                segments[-1][1] = b
            else:
                segments.append([a, b, x, 0.0, 0])
            segments[-1][3] += (b - a) * c
            segments[-1][4] += b - a
        total = sum(b - a for a, b in own) or 1
        sure = mass.get(main, 0.0) / max(1, sum(b - a for (a, b), (x, _) in zip(own, told) if x == main))
        out.append(([(a, b, x, round(float(s / n), 4)) for a, b, x, s, n in segments], {x: m / total for x, m in present.items()}, main, round(float(sure), 4) if own else 1.0))
    return out


def spoken(main: str, present: dict[str, float]) -> list[str]:
    """Languages of a text: those of its whole sentences, else the main one."""
    if main == "und":
        return sorted(present) or ["und"]
    return sorted(present) or [main]


def sample(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """(text, label) of at most `per_language` documents of each label, chosen by a hash of the id; of each the first SAMPLE_CHARS characters are used."""
    labelled = docs.select(F.substring("text", 1, SAMPLE_CHARS).alias("text"), normal_label(F.col("lang")).alias("label"), F.xxhash64("doc_id").alias("h")).where(F.col("label").isin(*LANGUAGES) & (F.length("text") > 40))
    top = labelled.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))).where(F.col("n") <= per_language)
    return [(r.text, r.label) for r in top.orderBy("label", "n").collect()]


def identify(docs: DataFrame, words: DataFrame | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """doc_id, language, confidence, languages (those of whole sentences, with the main one), segments of every document.

    The machines are fitted on a bounded sample of the documents of `fit_on` (by default `docs`) by their labels. `words` (lang, word) are
    function words, by which a sentence in another language than the rest is confirmed where both are written in Latin. Every text is then read
    whole in one narrow pass. Null, empty and letterless texts have the language `und`, confidence 1 and no segments; repeated rows repeat.
    """
    spark = docs.sparkSession
    ship(spark)
    known = [] if words is None else [(r.lang, r.word) for r in small_rows(words.select("lang", "word").where("lang is not null and word is not null"), 20_000, "the table of function words")]
    fitted = spark.sparkContext.broadcast(Identifier(sample(docs if fit_on is None else fit_on), known).__dict__)  # weights of a fixed size
    schema = "doc_id bigint, language string, confidence double, languages array<string>, segments array<struct<start:int,end:int,language:string,confidence:double>>"
    segment = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("language", pa.string()), ("confidence", pa.float64())]))

    def make():
        known = Identifier.__new__(Identifier)
        known.__dict__.update(fitted.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(1))
            told = []
            k = 0
            while k < len(texts):
                to, room = k, 200_000
                while to < len(texts) and (to == k or room > len(texts[to])):
                    room -= len(texts[to])
                    to += 1
                told += profile(texts[k:to], known)
                k = to
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([m for _, _, m, _ in told]), pa.array([c for *_, c in told], pa.float64()),
                    pa.array([spoken(m, p) for _, p, m, _ in told], pa.list_(pa.string())),
                    pa.array([[dict(zip(("start", "end", "language", "confidence"), x)) for x in s] for s, *_ in told], segment),
                ],
                names=["doc_id", "language", "confidence", "languages", "segments"],
            )

        return work

    return map_arrow(spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")), make, schema)


def segments(docs: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """doc_id, doc_language, doc_confidence, segment_no, seg_start, seg_end, language, confidence: the documents' segments in order.

    A document without a segment has one row with nulls in the last five columns.
    """
    told = identify(docs, words).select("doc_id", F.col("language").alias("doc_language"), F.col("confidence").alias("doc_confidence"), F.posexplode_outer("segments").alias("segment_no", "s"))
    return told.select("doc_id", "doc_language", "doc_confidence", "segment_no", F.col("s.start").alias("seg_start"), F.col("s.end").alias("seg_end"), "s.language", "s.confidence")


def mislabelled(docs: DataFrame, statistics: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """doc_id, language: documents whose label or whose run's language is missing or wrong, or whose text mixes languages; a row for each language.

    A label in another spelling is right. A document without a run has no label there and is found; of several runs each must be right.
    """
    told = identify(docs, words).select("doc_id", "languages")
    labels = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(normal_label(F.col("lang")), F.lit("?")).alias("label"))
    runs = statistics.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(normal_label(F.col("language")), F.lit("?")).alias("run")).groupBy("doc_id").agg(F.min("run").alias("low"), F.max("run").alias("high"))
    joined = told.join(labels, "doc_id").join(runs, "doc_id", "left")
    only = F.col("languages")[0]
    right = (F.size("languages") == 1) & (F.col("label") == only) & (F.col("low") == only) & (F.col("high") == only)
    return joined.where(~F.coalesce(right, F.lit(False))).select("doc_id", F.explode("languages").alias("language")).distinct()
