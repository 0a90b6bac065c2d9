"""Spelling by a dictionary of frequencies: rare words one edit away from frequent ones."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as lex
from ..functions.masks import Page
from ..functions.text import texts_of
from ..session import map_arrow, ship, spread
from .rules import CHECK_ORDER

#: Lower-case words that stand alone; a fixed value.
WORD = "(?<![A-Za-z0-9_'])[a-z]{3,32}(?![A-Za-z0-9_'])"


def frequencies(docs: DataFrame) -> DataFrame:
    """word, n over all texts, counted before the shuffle."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _shortened(word: Column) -> Column:
    """A word and the words that lack one of its letters: two words one edit apart share one of them."""
    places = F.sequence(F.lit(1), F.length(word))
    return F.array_distinct(F.concat(F.array(word), F.transform(places, lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.length(word))))))


def _one_edit(a: str, b: str) -> Column:
    """Whether two words are one edit apart: a letter more, less or other, or two neighbours the other way round."""
    x, y = F.col(a), F.col(b)
    at = lambda w, k: F.substring(w, k, 1)
    rest = lambda w, k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 2, F.length(w)))
    turned = (F.length(x) == F.length(y)) & F.exists(F.sequence(F.lit(1), F.length(x) - 1), lambda k: (at(x, k) == at(y, k + 1)) & (at(x, k + 1) == at(y, k)) & (rest(x, k) == rest(y, k)))
    return (F.levenshtein(x, y) == 1) | turned


def suggestions(docs: DataFrame, dictionary: DataFrame | None = None, known: int = 5, most: int = 3) -> DataFrame:
    """word, place, candidate, n, confident: for each word rarer than `known`, the most frequent dictionary words one edit away.

    Without a dictionary (word, n), the texts' own words that are not rare are it. Candidates are ordered by frequency, then by word;
    confident says of a word that the first occurs ten times or more, and five times as often as the second. The join runs over the words
    that lack one letter, once for each distinct word. A transposition counts as one edit.
    """
    counted = frequencies(docs)
    right = (counted if dictionary is None else dictionary).where(F.col("n") >= known).select(F.col("word").alias("candidate"), "n")
    rare = counted.where(F.col("n") < known).join(right.select(F.col("candidate").alias("word")), "word", "left_anti").select("word")
    left = rare.select("word", F.explode(_shortened(F.col("word"))).alias("key"))
    met = left.join(right.select("candidate", "n", F.explode(_shortened(F.col("candidate"))).alias("key")), "key").select("word", "candidate", "n").distinct().where((F.col("word") != F.col("candidate")) & _one_edit("word", "candidate"))
    order = Window.partitionBy("word").orderBy(F.desc("n"), "candidate")
    ranked = met.withColumn("place", F.row_number().over(order)).withColumn("second", F.lead("n").over(order)).where(F.col("place") <= most)
    sure = F.first(F.when(F.col("place") == 1, (F.col("n") >= 10) & (F.col("n") >= 5 * F.coalesce("second", F.lit(0))))).over(Window.partitionBy("word").orderBy("place"))
    return ranked.withColumn("confident", sure).select("word", "place", "candidate", "n", "confident")


# Right forms in other spellings of the language, and words of the trade.
DIALECT = frozenset("""colour colours coloured colouring colourful favour favours favoured favouring favourite favourites honour honours honoured honouring honourable
labour labours laboured labouring neighbour neighbours behaviour behaviours flavour flavours humour rumour rumours centre centres centred centring metre metres litre litres
theatre theatres fibre fibres analyse analyses analysed analysing organise organises organised organising organisation organisations recognise recognises recognised recognising
realise realises realised realising licence licences defence defences offence offences practise practises practised practising travelling travelled cancelled cancelling labelled
labelling modelling modelled""".split())
TRADE = frozenset("apis backend frontend metadata async runtime webhook webhooks docx pdf json yaml markdown redis postgresql kubernetes docker nginx numpy pydantic fastapi typescript javascript tokenizer tokenizers embeddings".split())
_TOKEN = re.compile(WORD)


def unlisted(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, word, context: lower-case words outside technical text that no list of the rules knows. One narrow pass."""
    ship(docs.sparkSession)
    listed = DIALECT | TRADE | set(lex.ENGLISH_TYPOS)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for d, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            page = Page(t)
            for m in _TOKEN.finditer(t):
                if m[0] not in listed and not page.technical.touches(*m.span()):
                    a, b = max(0, m.start() - 15), min(len(t), m.end() + 15)
                    rows.append((d, *m.span(), m[0], ("..." if a else "") + t[a:b] + ("..." if b < len(t) else "")))
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=["doc_id", "start", "end", "word", "context"])

    return map_arrow(spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")), lambda: work, "doc_id bigint, start int, end int, word string, context string")


def spelling_issues(docs: DataFrame, dictionary: DataFrame | None = None, known: int = 5) -> DataFrame:
    """doc_id, rule_id, type, severity, start, end, original, suggestion, alternatives, confidence, context: each place of a word that the dictionary lacks
    and that is one edit from words it has.

    The first candidate is the suggestion where it is confident, else there is none; all candidates are alternatives.
    """
    told = suggestions(docs, dictionary, known).groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "candidate"))), lambda x: x["candidate"]).alias("alternatives"), F.first("confident").alias("confident"))
    sure = F.col("confident")
    return unlisted(docs).join(told, "word").select(
        "doc_id", F.lit("en_dictionary_spelling").alias("rule_id"), F.lit("typo").alias("type"), F.when(sure, "warning").otherwise("info").alias("severity"), "start", "end", F.col("word").alias("original"),
        F.when(sure, F.col("alternatives")[0]).alias("suggestion"), "alternatives", F.when(sure, 0.8).otherwise(0.55).alias("confidence"), "context",
    )


def as_findings(spelled: DataFrame) -> DataFrame:
    """Spelling issues as raw findings of the rules, in the place of their check, before its other findings."""
    order = Window.partitionBy("doc_id").orderBy("start")
    return spelled.select(
        "doc_id", F.lit(CHECK_ORDER.index("extended_english")).alias("check_ord"), (F.row_number().over(order) - 1_000_000_000).alias("emit_ord"), "type", "severity", "rule_id", "start", "end", "original", "suggestion", "confidence",
        "alternatives", F.lit(False).alias("technical"), F.lit(False).alias("shielded"), "context",
    )
