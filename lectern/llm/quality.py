"""Text quality statistics per document, exact ranks of them per language, outlier scores from tail probabilities, and the kind of text."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import code_points, texts_of
from ..session import cut, map_arrow, ship, small_rows, spread

#: Statistics that are ranked, and the side that is unusual for prose: low (-1) or high (1).
RANKED = {"sentence_cover": -1, "punct_line_share": -1, "letter_typicality": -1, "different_letters": -1, "symbol_ratio": 1, "table_share": 1, "list_share": 1}
#: Those of which only the most unusual counts: a text is no prose in one way or another.
ONE_OF = ("letter_typicality", "different_letters", "symbol_ratio", "table_share", "list_share")
#: Ranks are among the different texts with at least so many sentences; a language takes part with so many ranks of all languages together.
SENTENCES, SHRINK = 2, 50
#: Sum of negative log tail probabilities from which a text is no prose: three independent statistics of prose sum up to it in 1 of 10,000 texts.
OUTLIER = 14.0
#: Few texts with sentences can't be passed by much: then this share of what their ranks can tell at most is enough.
OF_MOST = 0.8
#: Ranked values have so many decimals and at most so many different letters, so the table of ranks is bounded whatever the input.
DECIMALS, MOST_LETTERS = 3, 500
#: Characters a sentence covers on average, in alphabetic scripts, and in Han, Kana and Hangul.
SENTENCE_CHARS, WIDE_SENTENCE_CHARS = 85, 35
#: What kind an unusual text is: without a readable language where the mean log probability of its letter transitions is lower, or its share of
#: symbols higher, or its different letters fewer; else a table or a list, whichever holds more of it.
UNREADABLE, SYMBOLS, LETTERS = -3.05, 0.42, 6
_PAIR_BITS = 18

_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[。！？]|(?<=[^\W\d_])[.!?](?=[\s\"”»)]|$)|[)\"”»][.!?](?=\s|$)|(?<=\d)[.!?](?=\s+[A-ZÀ-ÞА-Я]|$)")
_END = re.compile(r"[.!?。！？…][\"'”’»」』）)\]]*\s*\Z")
_THAI, _THAI_GAP = re.compile(r"[ก-๎]"), re.compile(r"(?<=[ก-๎]) (?=[ก-๎])")
_BULLET = re.compile(r"\s*(?:[•\-*–—·◦▪‣□☐✓☑○●►+]|\[[ xX]?\]|\(?\d{1,3}[.)、]|\(?[a-zA-Z][.)]|[一二三四五六七八九十]+、|\(?[ivx]+[.)])\s*\S")
_GAP = re.compile(r"\S {2,}(?=\S)")
_CELLS = re.compile(r"[|\t,;]| {2,}")
#: The languages whose function words stand inside running text, and the one whose stand at the end of words.
INSIDE, ATTACHED = ("zh", "ja", "th"), ("ko",)


@cache
def _classes() -> np.ndarray:
    """0 for signs, 1 for white space, 2 for digits, 3 for letters of scripts without case or spaces, else the case-folded letter."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x30000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if c.isspace():
            out[cp] = 1
        elif c.isdigit():
            out[cp] = 2
        elif 0xE01 <= cp <= 0xE4E or (cp >= 0x1100 and c.isalpha()):
            out[cp] = 3
        elif c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


def _pairs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(classes, first of each pair, its bucket, whether it counts): pairs of neighbours of which one is a letter of an alphabet."""
    c = _classes()[points]
    a, b = c[:-1].astype(np.uint64), c[1:].astype(np.uint64)
    counts = (a > 0) & (b > 0) & (a != 3) & (b != 3) & ((a > 3) | (b > 3))
    bucket = ((a * np.uint64(0x9E3779B97F4A7C15) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - _PAIR_BITS)
    return c, c[:-1] & 0xFFFF, bucket.astype(np.int64), counts


def letter_table(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log counts of pairs of neighbours, and of their first, in buckets of a fixed number, counted over all different texts.

    Copies share one count, so that a text without a language does not become typical by being frequent. Only the hashes of texts are shuffled;
    the repeated ones are a table that Spark broadcasts where it is small.
    """
    size = 1 << _PAIR_BITS
    hashed = docs.select("text", F.xxhash64("text").alias("h"))
    repeated = cut(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    weighted = spread(docs.select("text", F.xxhash64("text").alias("h"))).join(repeated, "h", "left").select("text", (1 / F.coalesce("copies", F.lit(1))).alias("weight"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, weights = texts_of(batch.column(0)), np.asarray(batch.column(1).to_pylist(), float)
            pair, first = np.zeros(size), np.zeros(1 << 16)
            for k in range(0, len(texts), 500):
                points, bounds = code_points([t + "\0" for t in texts[k : k + 500]])
                if len(points) > 1:
                    _, a, bucket, ok = _pairs(points)
                    own = np.repeat(weights[k : k + 500], np.diff(bounds))[:-1][ok]
                    pair += np.bincount(bucket[ok], own, size)
                    first += np.bincount(a[ok], own, 1 << 16)
            at, to = np.flatnonzero(pair), np.flatnonzero(first)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, -1 - to])), pa.array(np.concatenate([pair[at], first[to]]))], names=["slot", "n"])

        return work

    counted = map_arrow(weighted, make, "slot bigint, n double").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # two tables of a fixed size
    pair, first = np.zeros(size), np.zeros(1 << 16)
    slots, n = counted.slot.to_numpy(np.int64), np.round(counted.n.to_numpy(float), 6)
    pair[slots[slots >= 0]], first[-1 - slots[slots < 0]] = n[slots >= 0], n[slots < 0]
    return np.log(pair + 0.5), np.log(first + 30.0)


class Statistics:
    """Computes the statistics of texts, given the letter table and the function words."""

    def __init__(self, pair: np.ndarray, first: np.ndarray, words: list[tuple[str, str]]):
        self.pair, self.first = pair, first
        self.spaced: dict[str, list[str]] = {}
        inside: dict[str, list[str]] = {}
        self.endings = tuple(w for x, w in words if x in ATTACHED)
        for x, w in words:
            if x in INSIDE:
                inside.setdefault(x, []).append(w)
            elif x not in ATTACHED:
                self.spaced.setdefault(w.lower(), []).append(x)
        self.inside = {x: re.compile("|".join(map(re.escape, sorted(own, key=len, reverse=True)))) for x, own in inside.items()}
        self.attached = ATTACHED[0] if self.endings else None

    def common(self, text: str, words: list[str], wide: int, thai: bool, hangul: bool) -> tuple[str, float]:
        """(language, share of its function words) of the language with the highest share; `und` where there is none."""
        shares: dict[str, float] = {}
        for w in words:
            for x in self.spaced.get(w, ()):
                shares[x] = shares.get(x, 0.0) + 1
        n = max(1, len(words))
        shares = {x: c / n for x, c in shares.items()}
        if hangul and self.attached:
            shares[self.attached] = sum(w.endswith(self.endings) for w in words) / n
        letters = max(1, sum(map(len, words)))
        for x, pattern in self.inside.items():
            if (x == "th" and thai) or (x != "th" and wide):
                shares[x] = sum(map(len, pattern.findall(text))) / letters
        best = max(shares, key=lambda x: (shares[x], x), default="und")
        return (best, shares[best]) if shares and shares[best] > 0 else ("und", 0.0)

    def of(self, text: str, typicality: float, letters: int, digits: int, wide: int) -> tuple:
        words = _WORD.findall(text.lower())
        thai = bool(_THAI.search(text))
        hangul = wide > 0 and any("가" <= w[0] <= "힣" for w in words)
        language, common = self.common(text, words, wide, thai, hangul)
        lines = [x for x in text.split("\n") if x.strip()]
        size = sum(map(len, lines)) or 1
        dense = len("".join(text.split()))
        spread_words = sum(len(w) if w[0] >= "぀" and not "가" <= w[0] <= "힣" or _THAI.match(w) else 1 for w in words)
        marks = len(_MARKS.findall(text)) + (len(_THAI_GAP.findall(text)) + sum(len(x) > 45 and bool(_THAI.search(x)) and not _BULLET.match(x) for x in lines) if thai else 0)
        table = listed = ended = items = separated = separated_lines = 0
        for x in lines:
            final = bool(_END.search(x))
            ended += final
            pipes, tabs, gaps = x.count("|"), x.count("\t"), len(_GAP.findall(x))
            commas = max(x.count(","), x.count(";"))
            if pipes >= 2 or tabs or (gaps >= 2 and not final):
                table += len(x)
            elif commas >= 2 and not final and max(map(len, _CELLS.split(x))) <= 45:
                separated += len(x)
                separated_lines += 1
            elif _BULLET.match(x) or (not final and len(x) <= 90):
                listed += len(x)
                items += 1
        if separated_lines >= 3:  # one line with commas is an enumeration
            table += separated
        cover = marks * (WIDE_SENTENCE_CHARS if wide > 0.3 * size else SENTENCE_CHARS) / size
        return (
            language, spread_words, round(letters / max(1, spread_words), 4), round(max(0.0, 1 - (letters + digits) / max(1, dense)), 4), round(ended / max(1, len(lines)), 4), round(common, 4),
            round(min(cover, 4.0), 4), round(float(typicality), 4), len(lines), items, round(table / size, 4), round(listed / size, 4), letters, len(set("".join(words))), marks,
        )

    def batch(self, texts: list[str]) -> list[tuple]:
        points, bounds = code_points([t + "\0" for t in texts])
        c, a, bucket, ok = _pairs(points)
        score = np.where(ok, self.pair[bucket] - self.first[a], 0.0)
        # letters outside the alphabets are readable as they are
        score = np.concatenate([score, [0.0]]) + np.where(c == 3, -2.0, 0.0)
        n = np.concatenate([ok, [False]]).astype(np.int64) + (c == 3)
        word, digit = (c > 2).astype(np.int64), (c == 2).astype(np.int64)
        wide = ((points >= 0x1100) & (c == 3)).astype(np.int64)
        at = bounds[:-1]
        score, n, word, digit, wide = (np.add.reduceat(x, at) for x in (score, n, word, digit, wide))
        return [self.of(t, s / k if k else -9.0, int(l), int(d), int(w)) for t, s, k, l, d, w in zip(texts, score, n, word, digit, wide)]


_COLUMNS = [("language", pa.string()), ("word_count", pa.int32()), ("mean_word_length", pa.float64()), ("symbol_ratio", pa.float64()), ("punct_line_share", pa.float64()), ("common_share", pa.float64()), ("sentence_cover", pa.float64()), ("letter_typicality", pa.float64()), ("line_count", pa.int32()), ("list_lines", pa.int32()), ("table_share", pa.float64()), ("list_share", pa.float64()), ("letters", pa.int32()), ("different_letters", pa.int32()), ("sentences", pa.int32())]
_SCHEMA = "doc_id bigint, text_hash bigint, language string, word_count int, mean_word_length double, symbol_ratio double, punct_line_share double, common_share double, sentence_cover double, letter_typicality double, line_count int, list_lines int, table_share double, list_share double, letters int, different_letters int, sentences int"


def statistics(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, text_hash, language and the statistics of every document.

    language is the one whose function words are most frequent (`und`: none occurs). word_count counts each sign of a script without
    spaces; symbol_ratio is the share of signs that are neither letters nor digits; punct_line_share that of the non-blank lines that end
    in a final mark; common_share that of words that are function words; sentence_cover estimates the share of the text that sentences
    cover; letter_typicality is the mean log probability of neighbouring letters in all different texts. Null and empty texts count as empty: 0
    words, typicality -9. Two narrow passes over the texts.
    """
    spark = docs.sparkSession
    ship(spark)
    pair, first = letter_table(docs)
    words = [(r.lang, r.word) for r in small_rows(common_words.select("lang", "word").where("lang is not null and word is not null").distinct().orderBy("lang", "word"), 20_000, "the table of function words")]
    sent = spark.sparkContext.broadcast((pair.astype(np.float32), first.astype(np.float32), words))  # of a fixed size but for the words

    def make():
        known = Statistics(*sent.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(2))
            rows = [x for k in range(0, len(texts), 200) for x in known.batch(texts[k : k + 200])]
            return pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, (_, t) in zip(zip(*rows), _COLUMNS))], names=["doc_id", "text_hash", *(n for n, _ in _COLUMNS)])

        return work

    return map_arrow(spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")), make, _SCHEMA)


def tail_probabilities(values: DataFrame) -> DataFrame:
    """language, stat, value, low, high, total: exact shares of the rows of a language whose value is at most, and at least, this one, and
    how many rows there are.

    values has language, stat, value. Equal values are counted together first, so a value that a third of all rows share is one row. The
    distinct values are sorted by range partitions; each partition sums up its own counts, and the sums of the partitions before it are its
    offsets.
    """
    counts = values.groupBy("language", "stat", "value").agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange(values.sparkSession.sparkContext.defaultParallelism * 2, "language", "stat", "value").withColumn("part", F.spark_partition_id())
    ranged = cut(ranged)  # range bounds are sampled: the partitions must stay what they are
    own = Window.partitionBy("part", "language", "stat").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranged.groupBy("part", "language", "stat").agg(F.sum("n").alias("part_n"))
    group = Window.partitionBy("language", "stat")
    offsets = sums.select("part", "language", "stat", (F.sum("part_n").over(group.orderBy("part")) - F.col("part_n")).alias("before"), F.sum("part_n").over(group).alias("total"))
    ranks = ranged.withColumn("upto", F.sum("n").over(own)).join(F.broadcast(offsets), ["part", "language", "stat"])  # partitions x languages x statistics rows
    rank = F.col("before") + F.col("upto")
    return ranks.select("language", "stat", "value", (rank / F.col("total")).alias("low"), ((F.col("total") - rank + F.col("n")) / F.col("total")).alias("high"), "total")


_ALL = "*"


class Tails:
    """Tail probabilities of values by the ranks of a language and of all languages together."""

    def __init__(self, rows: pd.DataFrame):
        self.own: dict[tuple[str, str], tuple[np.ndarray, np.ndarray, float]] = {}
        for (language, stat), part in rows.sort_values("value").groupby(["language", "stat"]):
            self.own[language, stat] = (part.value.to_numpy(), part["low" if RANKED[stat] < 0 else "high"].to_numpy(), float(part.total.iloc[0]))

    def threshold(self) -> float:
        """The score from which a text is no prose."""
        n = self.own[_ALL, "sentence_cover"][2] if self.own else 0.0
        return min(OUTLIER, OF_MOST * 3 * float(np.log(n + 1)))

    def _among(self, language: str, stat: str, values: np.ndarray) -> tuple[np.ndarray, float]:
        """How many rows of a language are as unusual as each value, and how many there are."""
        known, share, total = self.own.get((language, stat), (np.zeros(0), np.zeros(0), 0.0))
        if RANKED[stat] < 0:
            return total * np.append(0.0, share)[np.searchsorted(known, values, side="right")], total
        return total * np.append(share, 0.0)[np.searchsorted(known, values, side="left")], total

    def evidence(self, language: str, stat: str, values: np.ndarray) -> np.ndarray:
        """Negative log of the tail probability. Few rows of a language count together with the ranks of all."""
        every, total = self._among(_ALL, stat, values)
        own, n = self._among(language, stat, values) if language != "und" else (0.0, 0.0)
        return -np.log((own + SHRINK * (every + 1) / (total + 1)) / (n + SHRINK))

    def scores(self, languages: np.ndarray, values: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(languages))
        for language in set(languages.tolist()):
            at = np.flatnonzero(languages == language)
            each = {s: self.evidence(language, s, values[s][at]) for s in RANKED}
            out[at] = sum(e for s, e in each.items() if s not in ONE_OF) + np.maximum.reduce([each[s] for s in ONE_OF])
        return out


def _ranked(column: str):
    value = F.least(F.col(column), F.lit(MOST_LETTERS)) if column == "different_letters" else F.col(column)
    return F.round(value.cast("double"), DECIMALS)


def assessed(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """The statistics with outlier_score and text_kind (prose, list, table or junk) of every document.

    A statistic's tail probability is its rank among the different texts of the document's language that hold sentences (`und`: of all
    languages), so that copies make no text usual; a rare language is helped out by the ranks of all. outlier_score is the sum of the
    negative log tail probabilities of sentence_cover and punct_line_share and of the most unusual of letters, symbols, cells and entries. From
    OUTLIER on, a text is no prose: junk where its letters or symbols are unreadable, else a table or a list, whichever holds more of it.
    Empty texts are junk. Repeated rows repeat. Without any text that holds sentences, no text is prose.
    """
    own = cut(statistics(docs, common_words))
    stats = F.array(*[F.struct(F.lit(name).alias("stat"), _ranked(name).alias("value")) for name in RANKED])
    usual = own.where(F.col("sentences") >= SENTENCES).dropDuplicates(["text_hash"])
    long = usual.select(F.explode(F.array("language", F.lit(_ALL))).alias("language"), stats.alias("stats")).where("language <> 'und'").select("language", F.explode("stats").alias("s")).select("language", "s.stat", "s.value")
    # languages x statistics x levels rows, whatever the input
    tails = Tails(tail_probabilities(long).toPandas())
    sent = docs.sparkSession.sparkContext.broadcast(tails)
    names = list(RANKED)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = {s: np.asarray(batch.column(k + 1).to_pylist(), float) for k, s in enumerate(names)}
        scores = sent.value.scores(np.asarray(batch.column(0).to_pylist(), object), values)
        return pa.RecordBatch.from_arrays([pa.array(np.round(scores, 4)), batch.column(len(names) + 1)], names=["outlier_score", "s"])

    kept = [c for c in own.columns if c != "text_hash"]
    schema = f"outlier_score double, s {own.select(F.struct(*kept).alias('s')).schema['s'].dataType.simpleString()}"
    scored = map_arrow(own.select("language", *[_ranked(s).alias(f"v_{s}") for s in names], F.struct(*kept).alias("s")), lambda: work, schema).select("s.*", "outlier_score")
    unreadable = (F.col("letter_typicality") < UNREADABLE) | (F.col("symbol_ratio") > SYMBOLS) | (F.col("different_letters") < LETTERS)
    kind = F.when(F.col("outlier_score") < tails.threshold(), "prose").when(unreadable, "junk").when(F.col("table_share") >= F.col("list_share"), "table").otherwise("list")
    return scored.withColumn("text_kind", kind)
