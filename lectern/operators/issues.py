"""From documents to the table of issues: one Arrow pass of all rules, then relational post-processing."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as lex
from ..functions.masks import Page, Stretches, standing
from ..functions.text import texts_of
from ..session import map_arrow, ship, spread
from . import scenarios
from .rules import Options, findings

#: More raw findings than this in one document are an error of the document, not of the job.
ISSUE_LIMIT = 100_000
_SCHEMA = "doc_id bigint, check_ord int, emit_ord int, type string, severity string, rule_id string, start int, end int, original string, suggestion string, confidence double, alternatives array<string>, technical boolean, shielded boolean, context string"
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.string()]


#: Fields of a settings column and the options they stand for.
_SETTINGS = {"scenario": "scenario", "enable_security": "security", "enable_sensitive": "sensitive", "enable_ad_extreme": "ad_extreme", "enable_extended_rules": "extended", "custom_glossary": "glossary", "banned_words": "banned"}


def own_options(options: Options, settings: dict | None) -> Options:
    """The options with a row's settings in place of their own; null and absent fields change nothing. A glossary is a list of original and standard."""
    changed = {_SETTINGS[k]: v for k, v in (settings or {}).items() if k in _SETTINGS and v is not None}
    if "glossary" in changed:
        changed["glossary"] = tuple((g["original"] or "", g["standard"] or "") for g in changed["glossary"] if g)
    if "banned" in changed:
        changed["banned"] = tuple(w for w in changed["banned"] if w)
    return replace(options, **changed) if changed else options


def raw_issues(docs: DataFrame, options: Options = Options(), doc_id: str = "doc_id", text: str = "text", settings: str | None = None) -> DataFrame:
    """Every finding of the selected rules with its place in the order of checks, before any is dropped.

    technical: touches technical text; shielded: inside a standard form of the glossary. Null, empty and blank texts have none; repeated
    rows repeat theirs. settings names a struct column by which each row has options of its own. One narrow pass that reads the id, the text and that.
    """
    ship(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        own = batch.column(2).to_pylist() if settings else [None] * batch.num_rows
        for d, t, mine in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), own):
            chosen = own_options(options, mine)
            page = Page(t)
            found = findings(t, chosen, page)
            if not found:
                continue
            shields = Stretches(span for _, s in chosen.glossary if s.strip() for span in standing(t, s.strip()))
            for check, k, f in found:
                a, b = max(0, f.start - 15), min(len(t), f.end + 15)
                rows.append((d, check, k, f.type, f.severity, f.rule_id, f.start, f.end, t[f.start : f.end], f.suggestion, f.confidence, list(f.alternatives) or None, page.technical.touches(f.start, f.end), shields.covers(f.start, f.end), ("..." if a else "") + t[a:b] + ("..." if b < len(t) else "")))
        columns = list(zip(*rows)) if rows else [[]] * len(_KINDS)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *([F.col(settings).alias("settings")] if settings else []))
    return map_arrow(spread(source), lambda: work, _SCHEMA)


def _table(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key), F.lit(default))


def with_defaults(issues: DataFrame) -> DataFrame:
    """layer by type, and confidence by rule where the rule gave none."""
    return issues.withColumn("layer", _table(lex.LAYERS, F.col("type"), "discourse")).withColumn("confidence", F.coalesce("confidence", _table(lex.CONFIDENCE, F.col("rule_id"), 0.7)))


def unprotected(issues: DataFrame) -> DataFrame:
    """Drop what touches technical text, but for security, banned words and the glossary's terms."""
    return issues.where((F.col("layer") == "security") | F.col("type").isin("banned_word", "custom_term") | ~F.col("technical"))


def unshielded(issues: DataFrame) -> DataFrame:
    """Drop lexical findings inside a standard form of the glossary."""
    return issues.where(~(F.col("type").isin("typo", "variant_char", "term_consistency") & F.col("shielded")))


_ORDER = ("check_ord", "emit_ord")


def exact_distinct(issues: DataFrame) -> DataFrame:
    """Of equal findings, the first in the order of checks."""
    key = Window.partitionBy("doc_id", "type", "rule_id", "start", "end", "original", "suggestion").orderBy(*_ORDER)
    return issues.withColumn("nth", F.row_number().over(key)).where("nth = 1").drop("nth")


def family_distinct(issues: DataFrame) -> DataFrame:
    """Of findings of one family with the same change, the most specific; `also` names the other rules that met it since, in order.

    Marks and spaces are one family and come before widths; typos and variants are one; other types stand alone. A finding that takes the
    place of another names that one first, and drops what the other had gathered.
    """
    rank = F.when(F.col("type").isin("punctuation", "spacing"), 0).when(F.col("type") == "width_mixed", 1).otherwise(9)
    family = F.when(rank < 9, "format").when(F.col("type").isin("typo", "variant_char"), "lexical").otherwise(F.col("type"))
    key = ["doc_id", "start", "end", "original", "family", "suggestion"]
    ranked = issues.withColumn("rank", rank).withColumn("family", family)
    in_order = Window.partitionBy(*key).orderBy(*_ORDER)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = Window.partitionBy(*key).orderBy("rank", *_ORDER)
    met = ranked.withColumn("place", F.row_number().over(in_order)).withColumn("nth", F.row_number().over(best)).withColumn("met", F.collect_list(F.struct("place", "rule_id", "rank")).over(whole))
    # the one displaced: the best before the winner's place
    before = F.array_sort(F.filter("met", lambda x: x["place"] < F.col("place")), lambda a, b: F.when(a["rank"] != b["rank"], a["rank"] - b["rank"]).otherwise(a["place"] - b["place"]))
    displaced = F.transform(F.slice(before, 1, 1), lambda x: x["rule_id"])
    later = F.transform(F.filter("met", lambda x: x["place"] > F.col("place")), lambda x: x["rule_id"])
    return met.where("nth = 1").withColumn("also", F.filter(F.concat(displaced, later), lambda r: r != F.col("rule_id"))).drop("rank", "family", "place", "nth", "met")


def numbered(issues: DataFrame) -> DataFrame:
    """issue_index in the order of start, end, kind of type, then the order of checks."""
    kind = F.when(F.col("type") == "custom_term", 0).when(F.col("type") == "banned_word", 1).otherwise(2)
    return issues.withColumn("issue_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", kind, *_ORDER)) - 1)


def issues_of(docs: DataFrame, options: Options = Options(), **columns: str) -> DataFrame:
    """The issues of documents: findings with defaults, filtered, without duplicates, in order.

    All post-processing is per document on positions and short strings; the texts don't leave the first pass.
    """
    return of_findings(raw_issues(docs, options, **columns))


def of_findings(raw: DataFrame) -> DataFrame:
    """The issues that raw findings give."""
    found = unshielded(unprotected(with_defaults(raw)))
    return numbered(family_distinct(exact_distinct(found))).drop("technical", "shielded")


def budget(docs: DataFrame, options: Options = Options(), limit: int = ISSUE_LIMIT) -> DataFrame:
    """doc_id, raw_count, status: ok or too_many, where a document has more raw findings than the limit."""
    return raw_issues(docs, options).groupBy("doc_id").agg(F.count(F.lit(1)).alias("raw_count")).withColumn("status", F.when(F.col("raw_count") > limit, "too_many").otherwise("ok"))


def summary(issues: DataFrame) -> DataFrame:
    """dimension, key, n: issues by type, severity, rule and layer, and in all, of one pass with grouping sets."""
    sets = issues.groupingSets([["type"], ["severity"], ["rule_id"], ["layer"], []], "type", "severity", "rule_id", "layer").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    # the bit of a column is 0 where it groups: type is the highest of the four
    names = {0b0111: "type", 0b1011: "severity", 0b1101: "rule_id", 0b1110: "layer", 0b1111: "total"}
    dimension = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("g").cast("int"))
    return sets.select(dimension.alias("dimension"), F.coalesce("type", "severity", "rule_id", "layer", F.lit("")).alias("key"), F.col("n").cast("bigint").alias("n"))


# Rules whose suggestions tell what to do instead of what to write.
MANUAL = ("mixed_num_format", "mixed_date_format", "numbering_gap", "numbering_order", "numbering_duplicate", "missing_conjunction_pair", "banned_word")


def auto_fixable(issues: DataFrame) -> DataFrame:
    """auto_fixable: there is a suggestion that changes the text, and no hand is needed."""
    return issues.withColumn("auto_fixable", F.coalesce(F.col("suggestion") != F.col("original"), F.lit(False)) & ~F.col("rule_id").isin(*MANUAL))


def canonical(docs: DataFrame, options: Options = Options(), terms: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, place, rule_id, type, severity, layer, start, end, original, suggestion, confidence, context: the issues of the rules and behind them those
    of each document's scenario, in the order of layers, then in their own.

    Columns doc_id, text, scenario, file_type. Scenario issues have no suggestion, belong to the layer of discourse and show 40 signs on either side.
    """
    columns = ["doc_id", "source", "nth", "rule_id", "type", "severity", "layer", "start", "end", "original", "suggestion", "confidence", "context"]
    base = issues_of(docs, options).withColumn("source", F.lit(0)).withColumn("nth", F.col("issue_index")).select(*columns)
    told = scenarios.scenario_issues(docs, terms)
    order = Window.partitionBy("doc_id").orderBy("start", "end", "rule_id")
    own = told.withColumn("source", F.lit(1)).withColumn("nth", F.row_number().over(order)).withColumn("type", F.lit("expression")).withColumn("layer", F.lit("discourse")).withColumn("suggestion", F.lit(None).cast("string")).select(*columns)
    rank = _table({x: k for k, x in enumerate(lex.LAYER_ORDER)}, F.col("layer"), len(lex.LAYER_ORDER))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "source", "nth")) - 1
    return base.unionByName(own).select("doc_id", place.alias("place"), *columns[3:])


def adapted(recorded: DataFrame, docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, issue_row_id, start, end, original, block_index, block_start, block_end, auto_fixable: recorded findings as issues of their texts.

    recorded: doc_id, issue_row_id, rule_id, start, end, original, suggestion. An end that is not behind its start is where `original` ends, if that
    stands there; what has no place in the text is dropped. The original is what the text holds. Only the findings' slices of the texts
    go on. Repeated rows count once.
    """
    rows = recorded.select("doc_id", "issue_row_id", "rule_id", "start", "end", "original", "suggestion").distinct()
    met = rows.join(docs.select("doc_id", "text").where("text is not null"), "doc_id")
    size, reach = F.length("text"), F.col("start") + F.length("original")
    stands = (F.length("original") > 0) & (reach <= size) & (F.col("text").substr(F.col("start") + 1, F.length("original")) == F.col("original"))
    end = F.when(F.col("end") > F.col("start"), F.col("end")).when(stands, reach)
    kept = met.where((F.col("start") >= 0) & (F.col("start") <= size)).withColumn("end", end).where((F.col("end") > F.col("start")) & (F.col("end") <= size))
    sliced = kept.withColumn("original", F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start"))).drop("text")
    return located(auto_fixable(sliced), blocks).drop("block_id", "rule_id", "suggestion")


def located(issues: DataFrame, blocks: DataFrame, width: int = 4096) -> DataFrame:
    """The first block of its document that holds each issue, by an equi-join on document and stretches of `width` signs.

    Issues in no block keep null columns. Repeated block rows count once. Each issue carries a number of its own through the join, and what else it
    has as one struct.
    """
    own = blocks.select("doc_id", "block_index", "block_id", "global_start", "global_end").where("global_end >= global_start").distinct().withColumn("slot", F.explode(F.sequence(F.floor(F.col("global_start") / width), F.floor(F.greatest("global_start", F.col("global_end") - 1) / width))))
    keys = issues.columns
    slotted = issues.select("doc_id", "start", "end", F.floor(F.col("start") / width).alias("slot"), F.struct(*keys).alias("row"), F.xxhash64(*keys).alias("issue_no"))
    met = slotted.join(own, ["doc_id", "slot"], "left").withColumn("inside", (F.col("global_start") <= F.col("start")) & (F.col("end") <= F.col("global_end")))
    at = F.when(F.col("inside"), F.struct("block_index", "block_id", (F.col("start") - F.col("global_start")).alias("block_start"), (F.col("end") - F.col("global_start")).alias("block_end")))
    found = met.groupBy("doc_id", "start", "end", "issue_no").agg(F.min(at).alias("at"), F.first("row").alias("row"))
    return found.select("row.*", "at.block_index", "at.block_id", "at.block_start", "at.block_end")


def navigated(issues: DataFrame, offset: int, layers: tuple[str, ...] = (), severities: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, issue_row_id, start, end: of each document, the issue at a place or the next one behind it, among those of the layers and severities asked for.

    An issue that holds the place comes before one behind it; of equal ones, the shorter and then the earlier row. No filter lets all through. Without an issue there or
    behind, a document has the first one.
    """
    kept = issues
    for column, values in (("layer", layers), ("severity", severities)):
        if values:
            kept = kept.where(F.col(column).isin(*values))
    rank = F.when((F.col("start") <= offset) & (F.col("end") > offset), 0).when(F.col("start") >= offset, 1).otherwise(2)
    best = F.min(F.struct(rank, "start", "end", "issue_row_id"))
    return kept.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.issue_row_id", "b.start", "b.end")


def faults(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """The issues with fault: null, or what is wrong with them against their text: their span, the length of their original, or what it says.

    Each issue meets its text by document; only the slice is compared. Issues of unknown documents are left out.
    """
    met = issues.join(docs.select("doc_id", "text"), "doc_id")
    start, end = F.col("start"), F.col("end")
    wrong = F.when(F.col("text").isNull() | (start < 0) | (end <= start) | (end > F.length("text")), "span").when(F.length("original") != end - start, "length").when(F.col("text").substr(start + 1, end - start) != F.col("original"), "original")
    return met.withColumn("fault", wrong).drop("text")


def within_budget(docs: DataFrame, options: Options = Options(), limit: int = ISSUE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(the issues of the documents whose raw findings are no more than the limit, doc_id and raw_count of the others). A document beyond it is an error of its own and
    has no issues at all, not some."""
    raw = raw_issues(docs, options)
    many = raw.groupBy("doc_id").agg(F.count(F.lit(1)).alias("raw_count")).where(F.col("raw_count") > limit)
    return of_findings(raw.join(many.select("doc_id"), "doc_id", "left_anti")).drop("technical", "shielded"), many
