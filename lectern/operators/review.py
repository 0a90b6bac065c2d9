"""Review of issues by a second reader, reports, terminology and invariants of documents."""

from __future__ import annotations

import csv
import io
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.masks import standing
from ..functions.text import texts_of
from ..session import map_arrow, ship

#: Bounds of an imported terminology, and of the bytes it comes in.
MAX_TERMS, MAX_TERM, MAX_BYTES = 500, 200, 64 << 10


def sample(candidates: DataFrame, quota: int) -> DataFrame:
    """At most `quota` candidates of each document, shared out among the types from the smallest on, evenly spaced within each.

    candidates: doc_id, issue_index, type. A type that needs less than its share leaves the rest to the larger ones. Of a type that may
    show k of n, the places are round(i (n-1) / (k-1)), halves to even; one alone stands in the middle.
    """
    own = candidates.select("doc_id", "issue_index", "type")
    sizes = own.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))
    # going up through the sorted sizes, a type gets its fair part of what the smaller ones left
    listed = sizes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "type"))).alias("types"))  # one entry per type: bounded
    start = F.struct(F.lit(quota).cast("long").alias("left"), F.size("types").cast("long").alias("open"), F.expr("cast(array() as array<struct<type:string,k:bigint>>)").alias("out"))

    def step(a, t):
        k = F.least(t["n"], F.floor(a["left"] / a["open"]))
        return F.struct((a["left"] - k).alias("left"), (a["open"] - 1).alias("open"), F.concat(a["out"], F.array(F.struct(t["type"].alias("type"), k.alias("k")))).alias("out"))

    shares = listed.select("doc_id", F.explode(F.aggregate("types", start, step)["out"]).alias("s")).select("doc_id", "s.type", "s.k")
    placed = own.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("issue_index")) - 1).join(shares, ["doc_id", "type"]).join(sizes, ["doc_id", "type"])
    spots = F.when(F.col("k") == 1, F.array(F.bround((F.col("n") - 1) / 2).cast("long"))).when(F.col("k") > 1, F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.bround(i * (F.col("n") - 1) / (F.col("k") - 1)).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    return placed.where(F.array_contains(spots, F.col("place").cast("long"))).select("doc_id", "issue_index", "type")


def judged(issues: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Issues after a review: false positives go; uncertain ones become hints of at most 0.55; all others stay as they are.

    verdicts: doc_id, issue_index, verdict, one each; issues without one stay.
    """
    met = issues.join(verdicts.select("doc_id", "issue_index", "verdict"), ["doc_id", "issue_index"], "left").where(F.coalesce(F.col("verdict") != "false_positive", F.lit(True)))
    unsure = F.coalesce(F.col("verdict") == "uncertain", F.lit(False))
    return met.withColumn("severity", F.when(unsure, "info").otherwise(F.col("severity"))).withColumn("confidence", F.when(unsure, F.least("confidence", F.lit(0.55))).otherwise(F.col("confidence"))).select(*issues.columns)


def report(issues: DataFrame) -> DataFrame:
    """doc_id, html: a table of each document's issues, escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", F.col("issue_index").cast("string"), safe(F.col("rule_id")), safe(F.col("severity")), safe(F.col("original")), safe(F.col("suggestion"))), F.lit("</td></tr>"))
    rows = issues.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("issue_index", row.alias("row")))).alias("rows"))
    return rows.select("doc_id", F.concat(F.lit("<table>"), F.concat_ws("", F.transform("rows", lambda r: r["row"])), F.lit("</table>")).alias("html"))


def terminology(text: str) -> list[tuple[str, str]]:
    """(word, standard form) of lines in one of several forms: separated by commas, tabs or arrows; comments, blanks, doubles and words that
    are their own standard left out. Too many or too long ones are an error."""
    if len(text.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        raise ValueError("the terminology is too large")
    out: dict[str, str] = {}
    for line in text.lstrip("﻿").splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        line = line.replace("=>", "\t").replace("→", "\t")
        cells = [c.strip() for c in next(csv.reader(io.StringIO(line), delimiter="\t" if "\t" in line else ","))]
        if len(cells) >= 2 and cells[0] and cells[1] and cells[0] != cells[1]:
            if max(map(len, cells[:2])) > MAX_TERM:
                raise ValueError("a term is too long")
            out.setdefault(cells[0], cells[1])
    if len(out) > MAX_TERMS:
        raise ValueError("too many terms")
    return list(out.items())


def block_overlaps(blocks: DataFrame) -> DataFrame:
    """doc_id, block_index: blocks that begin before an earlier one of their document ends, by a running maximum of ends."""
    own = blocks.select("doc_id", "block_index", "global_start", "global_end").distinct()
    order = Window.partitionBy("doc_id").orderBy("global_start", "global_end", "block_index")
    return own.withColumn("reach", F.max("global_end").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("reach > global_start").select("doc_id", "block_index")


def candidates(issues: DataFrame, docs: DataFrame, terms: tuple[str, ...] = (), limit: float = 0.85) -> DataFrame:
    """The issues a reviewer should see: not sure, not about security, not banned, a user's term or a variant, and not touching a place of the user's words.

    issues: doc_id, issue_row_id, start, end, issue_type, layer, confidence. Only the places of the words are joined with the issues, not the texts.
    """
    kept = issues.where((F.col("confidence") >= 0) & (F.col("confidence") < limit) & (F.coalesce("layer", F.lit("")) != "security") & ~F.col("issue_type").startswith("pii") & ~F.col("issue_type").isin("banned_word", "custom_term", "variant_char"))
    words = [t for t in dict.fromkeys(terms) if t]
    if not words:
        return kept
    ship(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(d, [{"s": a, "e": b} for a, b in spans]) for d, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))) if (spans := [x for w in words for x in standing(t, w)])]
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], names=["doc_id", "fixed"])

    places = map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), lambda: work, "doc_id bigint, fixed array<struct<s:int,e:int>>")
    return kept.join(places, "doc_id", "left").where(~F.coalesce(F.exists("fixed", lambda x: (x["s"] < F.col("end")) & (F.col("start") < x["e"])), F.lit(False))).drop("fixed")


# Verdicts of a review, the longest reason, and signs an answer may have for each issue and besides.
VERDICTS, MOST_REASON, ANSWER_EACH, ANSWER_BASE = ("false_positive", "real", "uncertain"), 500, 1500, 200


def _single(pairs: list[tuple]) -> dict:
    fields = dict(pairs)
    if len(fields) < len(pairs):
        raise ValueError("a field stands twice")
    return fields


def read_answer(answer: str | None, expected: int) -> list[tuple[int, str, str]] | str:
    """(issue, verdict, reason) of an answer to a review of `expected` issues, or what is wrong with it: it must judge each issue exactly once."""
    if not answer:
        return "empty"
    if len(answer) > ANSWER_EACH * expected + ANSWER_BASE:
        return "too long"
    body = re.sub(r"\A```[A-Za-z]*\n?|\n?```\Z", "", answer.strip()).strip()
    try:
        told = json.loads(body, object_pairs_hook=_single)
    except ValueError:
        return "no JSON"
    told = told.get("verdicts") if isinstance(told, dict) else told
    if not isinstance(told, list) or not all(isinstance(x, dict) for x in told):
        return "no list"
    out: dict[int, tuple[str, str]] = {}
    for x in told:
        number, verdict, reason = x.get("id"), x.get("verdict"), x.get("reason", "")
        if type(number) is not int or verdict not in VERDICTS or not isinstance(reason, str) or len(reason) > MOST_REASON:
            return "no verdict"
        if not 0 <= number < expected:
            return "unknown issue"
        if number in out:
            return "judged twice"
        out[number] = (verdict, reason)
    return [(n, *v) for n, v in sorted(out.items())] if len(out) == expected else "incomplete"


def answers(reviews: DataFrame) -> DataFrame:
    """doc_id, problem, verdicts: the answers of reviews, read strictly; verdicts are empty where there is a problem. reviews: doc_id, answer, expected."""
    ship(reviews.sparkSession)
    kind = pa.list_(pa.struct([("issue_index", pa.int32()), ("verdict", pa.string()), ("reason", pa.string())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = [read_answer(a, n or 0) for a, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        lists = [[dict(zip(("issue_index", "verdict", "reason"), v)) for v in x] if isinstance(x, list) else [] for x in told]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if isinstance(x, list) else x for x in told], pa.string()), pa.array(lists, kind)], names=["doc_id", "problem", "verdicts"])

    return map_arrow(reviews.select(F.col("doc_id").cast("bigint").alias("doc_id"), "answer", F.col("expected").cast("int").alias("expected")), lambda: work, "doc_id bigint, problem string, verdicts array<struct<issue_index:int,verdict:string,reason:string>>")


def reviewed(issues: DataFrame, reviews: DataFrame) -> DataFrame:
    """The issues after a review whose answers are read strictly, with degraded: an answer with a problem changes nothing and says so.

    issues: doc_id, issue_index, severity, confidence. Documents without an answer are not degraded.
    """
    read = answers(reviews)
    verdicts = read.select("doc_id", F.explode("verdicts").alias("v")).select("doc_id", F.col("v.issue_index").cast("bigint").alias("issue_index"), "v.verdict")
    kept = judged(issues.withColumn("issue_index", F.col("issue_index").cast("bigint")), verdicts)
    return kept.join(read.select("doc_id", F.col("problem").isNotNull().alias("degraded")), "doc_id", "left").withColumn("degraded", F.coalesce("degraded", F.lit(False)))


# What is not shown to a reviewer: code, formulas, links, addresses, assignments, paths, identifiers and secrets.
_HIDDEN = re.compile(
    r"```[\s\S]*?(?:```|\Z)|~~~[\s\S]*?(?:~~~|\Z)|`[^`\n]+`|\$\$[\s\S]*?\$\$|\$[^\n$]+\$|\\\([\s\S]*?\\\)|\\\[[\s\S]*?\\\]|https?://[^\s<>]+|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
    r"|(?m:^[ \t]*(?:def |class |import |from \w+ import |const |let |var |SELECT |INSERT |curl |[A-Za-z_]\w*\s*[=:]).*$)|(?<!\w)(?:[A-Za-z]:\\|\.{0,2}/)[\w./\\-]+|\b\w+_\w+\b|\b[a-z]+[A-Z]\w*\b|\b(?:sk|api|token|secret|password)[_-][A-Za-z0-9_-]{8,}\b"
)


def masked(text: str) -> str:
    """A text with blanks where it must not be shown; places stay, and so do line breaks."""
    return _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def masked_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text: the texts as a reviewer may see them; a null text stays null."""
    ship(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else masked(t) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), lambda: work, "doc_id bigint, text string")


# Confidence of proposed findings, signs of a text in them, and suggestions of one.
LEAST_SURE, MOST_SURE, MOST_SIGNS, MOST_WAYS = 0.65, 0.9, 400, 3


def proposed(findings: DataFrame, docs: DataFrame, known: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """doc_id, start, end, original, suggestions, type, confidence: findings of a reviewer that hold against the texts, without those that are known.

    findings: doc_id, start (null: the only place), chunk_start, chunk_end, original, suggestions, type, confidence. A finding holds where its original stands at
    its place within its chunk, its suggestions are one to three different ones that change it, its type is allowed and its confidence enough; that is at
    most 0.9 in the end. known: doc_id, start, end, suggestion; a finding of which each suggestion is known is left out; of equal ones, one stays.
    """
    trimmed = F.transform("suggestions", lambda s: F.trim(s))
    rows = findings.withColumn("suggestions", trimmed).where(
        (F.length(F.trim("original")) > 0) & (F.length("original") <= MOST_SIGNS) & F.col("type").isin(*types) & F.col("confidence").between(LEAST_SURE, 1.0) & F.size("suggestions").between(1, MOST_WAYS)
        & (F.size(F.array_distinct("suggestions")) == F.size("suggestions")) & ~F.exists("suggestions", lambda s: s.isNull() | (s == "") | (F.length(s) > MOST_SIGNS) | (s == F.trim(F.col("original"))))
    )
    met = rows.join(docs.select("doc_id", "text").where("text is not null"), "doc_id")
    first = F.expr("locate(original, text)")
    again = F.expr("locate(original, text, locate(original, text) + 1)")
    start = F.when(F.col("start").isNotNull(), F.col("start")).when((first > 0) & (again == 0), first - 1)
    placed = met.withColumn("start", start).withColumn("end", F.col("start") + F.length("original"))
    fits = placed.where((F.col("start") >= F.col("chunk_start")) & (F.col("end") <= F.col("chunk_end")) & (F.col("text").substr(F.col("start") + 1, F.length("original")) == F.col("original")))
    told = known.where("suggestion is not null").groupBy("doc_id", "start", "end").agg(F.collect_set(F.trim("suggestion")).alias("had"))
    new = fits.join(told, ["doc_id", "start", "end"], "left").where(F.size(F.array_except("suggestions", F.coalesce("had", F.array().cast("array<string>")))) > 0)
    return new.select("doc_id", "start", "end", "original", "suggestions", "type", F.least("confidence", F.lit(MOST_SURE)).alias("confidence")).dropDuplicates(["doc_id", "start", "end", "suggestions"])


def chips(issues: DataFrame) -> DataFrame:
    """doc_id, html: a line of each document's numbers of issues by severity, for the head of its report."""
    counts = issues.groupBy("doc_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    chip = F.concat(F.lit('<span class="chip">'), F.coalesce("severity", F.lit("")), F.lit(" "), F.col("n").cast("string"), F.lit("</span>"))
    return counts.groupBy("doc_id").agg(F.concat_ws("", F.sort_array(F.collect_list(chip))).alias("html"))
