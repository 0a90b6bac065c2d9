"""Queries of cases with stated results, and of pages, edits, revisions, reviews, jobs and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks, statistics
from ..operators import dictionary, edits, issues, jobs, pages, review, rules, scenarios
from ..session import table
from ..sources import documents
from .cases import CASES, EXPECTED, GATE, GATE_WORDS, SCENARIO_CASES, SCENARIO_EXPECTED
from .queries import QUERIES, SQL, query


def _literal(value) -> str:
    """A value as SQL writes it."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def _values(rows, names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({names})"


# ---------------------------------------------------------------------------------------------------------------- cases of rules
_SETTINGS = "scenario:string,enable_security:boolean,enable_sensitive:boolean,enable_ad_extreme:boolean,enable_extended_rules:boolean,custom_glossary:array<struct<original:string,standard:string>>,banned_words:array<string>"
_CASE_COLUMNS = 'case_name, place, rule_id, severity, "start", "end", suggestion'


def _case_issues(spark: SparkSession, rule_id: str | None = None) -> DataFrame:
    wanted = {name for name, _, r, *_ in EXPECTED if rule_id in (None, r)}
    rows = [(k, n, t, s) for k, (n, s, t) in enumerate(CASES) if rule_id is None or n in wanted]
    cases = spark.createDataFrame(rows, f"doc_id bigint, case_name string, text string, settings struct<{_SETTINGS}>").coalesce(1)
    found = issues.of_findings(issues.raw_issues(cases, settings="settings"))
    named = found.join(F.broadcast(cases.select("doc_id", "case_name")), "doc_id")
    own = named if rule_id is None else named.where(F.col("rule_id") == rule_id)
    return own.select("case_name", F.col("issue_index").alias("place"), "rule_id", "severity", "start", "end", "suggestion")


@query(_values(EXPECTED, _CASE_COLUMNS))
def rule_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The issues of all cases, in order."""
    return _case_issues(spark)


def _case_query(rule_id: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _case_issues(spark, rule_id)

    run.__doc__ = f"The issues of {rule_id} in the cases that show it."
    return run


for _id in dict.fromkeys(r for _, _, r, *_ in EXPECTED):
    QUERIES[f"case_{_id}"] = _case_query(_id)
    SQL[f"case_{_id}"] = _values([x for x in EXPECTED if x[2] == _id], _CASE_COLUMNS)


@query(_values(SCENARIO_EXPECTED, 'doc_id, rule_id, "start", "end"'))
def scenario_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The issues of the cases of scenario rules."""
    cases = spark.createDataFrame([(k, *c) for k, c in enumerate(SCENARIO_CASES)], "doc_id bigint, scenario string, file_type string, text string").coalesce(1)
    return scenarios.scenario_issues(cases).select(F.col("doc_id").cast("int").alias("doc_id"), "rule_id", "start", "end")


_GATE_ROWS = [(k, g, s, len(t), len(e)) for k, (_, g, s, t, e) in enumerate(GATE)]


@query(f"""WITH c AS ({_values(_GATE_ROWS, 'case_id, case_group, split, size, n')}), g AS (SELECT split, case_group, count(*) AS cases, CAST(sum(size) AS BIGINT) AS characters, CAST(sum(n) AS BIGINT) AS tp FROM c GROUP BY ROLLUP (split, case_group))
    SELECT split, case_group, cases, characters, tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, tp AS right_suggestions, tp AS valid_spans, CASE WHEN tp > 0 THEN 1.0::DOUBLE END AS "precision", CASE WHEN tp > 0 THEN 1.0::DOUBLE END AS recall,
    CASE WHEN tp > 0 THEN 1.0::DOUBLE END AS suggestion_accuracy, CASE WHEN tp > 0 THEN 1.0::DOUBLE END AS span_validity, 0.0::DOUBLE AS false_per_1000 FROM g""")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of detection over the labelled cases, by split and group."""
    cases = spark.createDataFrame([(k, g, s, t) for k, (_, g, s, t, _) in enumerate(GATE)], "case_id bigint, case_group string, split string, text string").coalesce(1)
    expected = spark.createDataFrame([(k, *e, n) for k, (*_, own) in enumerate(GATE) for n, e in enumerate(own)], "case_id bigint, start int, end int, type string, suggestion string, nth int").coalesce(1)
    docs = cases.select(F.col("case_id").alias("doc_id"), "text")
    words = spark.createDataFrame(list(GATE_WORDS), "word string, n bigint").coalesce(1)
    raw = issues.raw_issues(docs, rules.Options(security=False, sensitive=False)).unionByName(dictionary.as_findings(dictionary.spelling_issues(docs, words)))
    found = issues.of_findings(raw).select(F.col("doc_id").alias("case_id"), "start", "end", "type", "suggestion", "original", F.col("issue_index").alias("nth"))
    return jobs.metrics(found, expected, cases, "split", "case_group")


@query()
def detection_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of the findings in all detection cases, each with its own settings and the rules of its scenario, against those recorded as expected."""
    cases = table(spark, sf, "detection_cases").dropDuplicates(["case_id"])
    own = cases.select("case_id", "text", F.col("options").alias("settings"), "options.scenario", F.lit("txt").alias("file_type"))
    found = issues.of_findings(issues.raw_issues(own, rules.Options(security=False, sensitive=False), doc_id="case_id", settings="settings")).select(F.col("doc_id").alias("case_id"), "start", "end", "type", "suggestion", "original", F.col("issue_index").alias("nth"))
    told = scenarios.scenario_issues(own, doc_id="case_id").select(F.col("doc_id").alias("case_id"), "start", "end", F.lit("expression").alias("type"), F.lit(None).cast("string").alias("suggestion"), "original", (F.col("start") + 1_000_000).alias("nth"))
    expected = cases.select("case_id", F.posexplode("expected").alias("nth", "e")).select("case_id", "e.start", "e.end", "e.type", "e.suggestion", "nth")
    return jobs.metrics(found.unionByName(told), expected, cases, "split", "case_group")


@query()
def canonical_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The issues of all documents with those of their scenarios, by layers."""
    return issues.canonical(table(spark, sf, "documents"))


@query()
def spelling_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Each place of a word that is rare and one edit from frequent ones."""
    return dictionary.spelling_issues(table(spark, sf, "documents")).drop("alternatives")


_V = "WITH v AS (SELECT DISTINCT doc_id, issue_row_id, rule_id, issue_type, severity, layer, confidence, start_pos, end_pos, original, suggestion FROM verification_issues)"
_RECORDED = ["doc_id", "issue_row_id", "rule_id", "start_pos AS start", "end_pos AS `end`", "original", "suggestion"]


@query(f"""{_V}, m AS (SELECT v.*, d.text, length(d.text) AS size, CASE WHEN end_pos > start_pos THEN end_pos WHEN length(original) > 0 AND start_pos + length(original) <= length(d.text) AND substr(d.text, start_pos + 1, length(original)) = original THEN start_pos + length(original) END AS e FROM v JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL),
    k AS (SELECT *, substr(text, start_pos + 1, e - start_pos) AS o FROM m WHERE start_pos >= 0 AND start_pos <= size AND e > start_pos AND e <= size), b AS (SELECT DISTINCT doc_id, block_index, global_start, global_end FROM document_blocks),
    l AS (SELECT k.doc_id, k.issue_row_id, k.start_pos, k.e, k.o, k.rule_id, k.suggestion, min(b.block_index) AS block_index FROM k LEFT JOIN b ON b.doc_id = k.doc_id AND b.global_start <= k.start_pos AND k.e <= b.global_end GROUP BY ALL)
    SELECT l.issue_row_id, l.start_pos AS "start", l.e AS "end", l.o AS original, l.block_index, l.start_pos - b.global_start AS block_start, coalesce(suggestion <> o, false) AND rule_id NOT IN ('mixed_num_format', 'mixed_date_format', 'numbering_gap', 'numbering_order', 'numbering_duplicate', 'missing_conjunction_pair', 'banned_word') AS auto_fixable
    FROM l LEFT JOIN b ON b.doc_id = l.doc_id AND b.block_index = l.block_index""")
def adapted_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The recorded issues as issues of their texts and blocks."""
    own = issues.adapted(table(spark, sf, "verification_issues").selectExpr(*_RECORDED), table(spark, sf, "documents"), table(spark, sf, "document_blocks"))
    return own.select("issue_row_id", "start", "end", "original", "block_index", "block_start", "auto_fixable")


# ------------------------------------------------------------------------------------------------------------------------- pages
_BOXES = "WITH b AS (SELECT DISTINCT doc_id, page, block_index, coalesce(text, '') AS text, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM document_blocks WHERE bbox IS NOT NULL AND len(bbox) = 4 AND page IS NOT NULL)"


@query(f"{_BOXES} SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, text, x1, y1) - 1 AS box_index, round(x0 / 2, 6) AS x0, round(y1 / 2, 6) AS y1 FROM b WHERE x1 > x0 AND y1 > y0 AND x0 >= 0 AND y0 >= 0 AND x1 <= 5000 AND y1 <= 8000")
def boxes_on_page(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks' boxes, taken as those of a raster of twice the page's measure, on their pages."""
    raster = {"raster_width": 5000.0, "raster_height": 8000.0, "page_width": 2500.0, "page_height": 4000.0}
    own = pages.boxes_of(table(spark, sf, "document_blocks")).withColumns({k: F.lit(v) for k, v in raster.items()})
    return pages.on_page(own).select("doc_id", "page", F.col("box_index").cast("bigint").alias("box_index"), F.round("x0", 6).alias("x0"), F.round("y1", 6).alias("y1"))


@query(f"""{_BOXES}, n AS (SELECT *, regexp_replace(lower(text), '\\s+', '', 'g') AS norm FROM b WHERE x1 > x0 AND y1 > y0), a AS (SELECT * FROM n WHERE block_index % 2 = 1), c AS (SELECT * FROM n WHERE block_index % 2 = 0)
    SELECT doc_id, page, block_index AS box_index FROM a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = a.doc_id AND c.page = a.page AND c.norm = a.norm AND a.norm <> '' AND
    (greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) >= 0.9 * least((a.x1 - a.x0) * (a.y1 - a.y0), (c.x1 - c.x0) * (c.y1 - c.y0))
    OR greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) >= 0.5 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) - greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)))))""")
def boxes_not_native(spark: SparkSession, sf: str) -> DataFrame:
    """Of the blocks with odd numbers, those that none with an even number repeats at its place."""
    own = pages.boxes_of(table(spark, sf, "document_blocks")).where("x1 > x0 and y1 > y0")
    return pages.not_native(own.where("box_index % 2 = 1"), own.where("box_index % 2 = 0")).select("doc_id", "page", "box_index")


@query(f"""{_BOXES}, c AS (SELECT g.doc_id, g.page, g.block_index, h.block_index AS cell_index, greatest(0, least(g.x1, h.x1) - greatest(g.x0, h.x0)) * greatest(0, least(g.y1, h.y1) - greatest(g.y0, h.y0)) AS shared FROM b g JOIN b h ON g.doc_id = h.doc_id AND g.page = h.page AND g.block_index % 2 = 1 AND h.block_index % 2 = 0)
    SELECT doc_id, page, block_index AS glyph_index, arg_min(cell_index, (-shared, cell_index)) AS cell_index FROM c WHERE shared > 0 GROUP BY ALL""")
def box_owners(spark: SparkSession, sf: str) -> DataFrame:
    """For the blocks with odd numbers, the one with an even number that covers most of it."""
    own = pages.boxes_of(table(spark, sf, "document_blocks"))
    return pages.owners(own.where("box_index % 2 = 1").withColumnRenamed("box_index", "glyph_index").drop("text", "confidence"), own.where("box_index % 2 = 0").withColumnRenamed("box_index", "cell_index").drop("text", "confidence"))


@query()
def page_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Headings, paragraphs and table cells of the pages, from the boxes of their blocks."""
    return pages.elements(pages.boxes_of(table(spark, sf, "document_blocks")))


@query(f"""{_BOXES}, o AS (SELECT *, lag(x1) OVER w AS px, lag(text) OVER w AS pt FROM b WINDOW w AS (PARTITION BY doc_id, page, y0 ORDER BY x0, x1, text)),
    p AS (SELECT *, CASE WHEN x0 - px > 0.3 * (y1 - y0) AND NOT coalesce(regexp_matches(pt, '\\s$'), true) AND NOT regexp_matches(text, '^\\s') THEN ' ' ELSE '' END || text AS part FROM o) SELECT doc_id, page, y0 AS line_index, string_agg(part, '' ORDER BY x0, x1, text) AS text FROM p GROUP BY ALL""")
def spaced_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks that begin at one height as a line, blanks in its wide gaps."""
    return pages.spaced(pages.boxes_of(table(spark, sf, "document_blocks")).withColumn("line_index", F.col("y0")))


# ------------------------------------------------------------------------------------------------------------- edits, revisions
def _edits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "verification_issues").select("doc_id", F.col("issue_row_id").alias("edit_id"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "original", F.col("suggestion").alias("replacement")).where("replacement is not null").distinct()


_E = "WITH e AS (SELECT DISTINCT doc_id, issue_row_id, start_pos, end_pos, original, suggestion FROM verification_issues WHERE suggestion IS NOT NULL)"
_CONFLICTS = """o AS (SELECT *, max(end_pos) OVER w AS reach, lead(start_pos) OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos, issue_row_id) AS nxt, count(*) OVER (PARTITION BY doc_id, start_pos, end_pos) AS same FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY start_pos, end_pos, issue_row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, coalesce(reach > start_pos, false) OR coalesce(nxt < end_pos, false) OR same > 1 AS conflict FROM o)"""


@query(f"{_E}, {_CONFLICTS} SELECT doc_id, count(*) AS accepted, CAST(count(*) FILTER (conflict) AS INT) AS conflicting, CASE WHEN count(*) FILTER (conflict) > 0 THEN 'conflict' ELSE 'ready' END AS status FROM c GROUP BY doc_id")
def edit_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's edits, and how many of them conflict."""
    return edits.plan(_edits(spark, sf)).withColumn("conflicting", F.size("conflicting"))


@query("SELECT doc_id, sha256(replace(replace(text, '。', '！'), 'the', 'THE')) AS text_hash FROM documents")
def replaced_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with two literals replaced everywhere, one after the other."""
    return edits.replaced(table(spark, sf, "documents"), [("。", "！"), ("the", "THE")]).select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query("SELECT doc_id, sha256(CASE WHEN contains(text, 'the') THEN substr(text, 1, instr(text, 'the') - 1) || 'THE' || substr(text, instr(text, 'the') + 3) ELSE text END) AS text_hash FROM documents")
def replaced_first(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with the first place of a literal replaced."""
    return edits.replaced_at(table(spark, sf, "documents"), "the", "THE").select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query("SELECT doc_id, true AS derived FROM documents WHERE text IS NOT NULL")
def derived_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the edited documents come from their texts by the recorded suggestions: all do."""
    docs, own = table(spark, sf, "documents"), _edits(spark, sf)
    return edits.derivations(docs.where("text is not null"), edits.apply_edits(docs.where("text is not null"), own), own.select("doc_id", "start", "end", "replacement"))


_REVISIONS = "WITH r AS (SELECT DISTINCT job_id AS doc_id, sequence + 1 AS number, job_id || ':' || sequence AS revision_id, CASE WHEN sequence > 0 THEN job_id || ':' || (sequence - 1) END AS parent_id FROM job_events), o AS (SELECT *, lag(number) OVER w AS last, lag(revision_id) OVER w AS last_id FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY number, revision_id))"


@query(f"{_REVISIONS} SELECT doc_id, number, CASE WHEN number <> coalesce(last, 0) + 1 THEN 'number' ELSE 'parent' END AS fault FROM o WHERE number <> coalesce(last, 0) + 1 OR parent_id IS DISTINCT FROM last_id")
def revision_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Events taken for revisions, each with the one before as its parent, that don't go on from what there is."""
    job, n = F.col("job_id"), F.col("sequence")
    own = table(spark, sf, "job_events").select(job.alias("doc_id"), (n + 1).alias("number"), F.concat(job, F.lit(":"), n.cast("string")).alias("revision_id"), F.when(n > 0, F.concat(job, F.lit(":"), (n - 1).cast("string"))).alias("parent_id"))
    return edits.chain_faults(own)


_B = "b AS (SELECT DISTINCT doc_id, block_index, global_start, global_end FROM document_blocks)"


@query(f"{_E}, {_B}, l AS (SELECT e.issue_row_id, min(b.block_index) AS block_index FROM e LEFT JOIN b ON b.doc_id = e.doc_id AND b.global_start <= e.start_pos AND e.end_pos <= b.global_end GROUP BY ALL) SELECT issue_row_id AS edit_id, block_index, CASE WHEN block_index IS NULL THEN 'separator' ELSE 'owned' END AS status FROM l")
def edit_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The block that owns each recorded edit."""
    return edits.on_blocks(_edits(spark, sf), table(spark, sf, "document_blocks")).select("edit_id", "block_index", "status")


@query(f"""{_E}, {_B}, l AS (SELECT e.issue_row_id, e.doc_id, any_value(length(e.suggestion) - (e.end_pos - e.start_pos)) AS more, min(b.block_index) AS block_index FROM e JOIN b ON b.doc_id = e.doc_id AND b.global_start <= e.start_pos AND e.end_pos <= b.global_end GROUP BY ALL),
    g AS (SELECT doc_id, block_index, sum(more) AS more FROM l GROUP BY ALL), j AS (SELECT b.*, coalesce(g.more, 0) AS more FROM b LEFT JOIN g USING (doc_id, block_index)), o AS (SELECT *, coalesce(sum(more) OVER (PARTITION BY doc_id ORDER BY global_start, global_end, block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j)
    SELECT doc_id, block_index, CAST(global_start + before AS BIGINT) AS new_start, CAST(global_end + before + more AS BIGINT) AS new_end FROM o""")
def moved_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Where each block stands after the recorded edits."""
    return edits.moved_blocks(_edits(spark, sf), table(spark, sf, "document_blocks"))


@query()
def rechecked_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The issues of the edited documents by type, severity, rule and layer."""
    return issues.summary(edits.rechecked(table(spark, sf, "documents"), _edits(spark, sf)))


# ----------------------------------------------------------------------------------------------------------------------- reviews
_ANSWERS = (
    (1, '[{"id": 0, "verdict": "real"}, {"id": 1, "verdict": "false_positive", "reason": "quoted"}]', 2, None, 2), (2, '```json\n{"verdicts": [{"id": 0, "verdict": "uncertain"}]}\n```', 1, None, 1), (3, '[{"id": 0, "verdict": "real"}]', 2, "incomplete", 0),
    (4, '[{"id": 0, "verdict": "real"}, {"id": 0, "verdict": "real"}]', 2, "judged twice", 0), (5, '[{"id": 0, "id": 1, "verdict": "real"}]', 1, "no JSON", 0), (6, '[{"id": 7, "verdict": "real"}]', 1, "unknown issue", 0), (7, '[{"id": true, "verdict": "real"}]', 1, "no verdict", 0),
    (8, "sorry", 1, "no JSON", 0), (9, "", 1, "empty", 0), (10, '{"answer": 1}', 1, "no list", 0), (11, "x" * 2000, 1, "too long", 0), (12, None, 1, "empty", 0), (13, "[]", 0, None, 0),
)


@query(_values([(d, p, n) for d, _, _, p, n in _ANSWERS], "doc_id, problem, verdicts"))
def review_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of a reviewer, right and wrong ones."""
    rows = spark.createDataFrame([(d, a, n) for d, a, n, *_ in _ANSWERS], "doc_id bigint, answer string, expected int").coalesce(1)
    return review.answers(rows).select(F.col("doc_id").cast("int").alias("doc_id"), "problem", F.size("verdicts").alias("verdicts"))


@query("SELECT doc_id, length(text) AS signs, len(string_split(text, chr(10))) AS lines FROM documents WHERE text IS NOT NULL")
def masked_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Signs and lines of the texts as a reviewer sees them: masks change neither."""
    return review.masked_texts(table(spark, sf, "documents").where("text is not null")).select("doc_id", F.length("text").alias("signs"), F.size(F.split("text", "\n", -1)).alias("lines"))


@query(f"""{_V} SELECT v.issue_row_id FROM v JOIN documents d USING (doc_id) WHERE confidence < 0.85 AND confidence >= 0 AND coalesce(layer, '') <> 'security' AND issue_type NOT LIKE 'pii%' AND issue_type NOT IN ('banned_word', 'custom_term', 'variant_char')
    AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(generate_series(1, length(d.text))) AS i) WHERE substr(d.text, i, 2) = '索引' AND i - 1 < v.end_pos AND v.start_pos < i + 1)""")
def review_candidates_beside_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded issues that a reviewer should see, where a term is fixed."""
    own = table(spark, sf, "verification_issues").select("doc_id", "issue_row_id", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "issue_type", "layer", "confidence").distinct()
    return review.candidates(own, table(spark, sf, "documents"), ("索引",)).select("issue_row_id")


@query(f"""{_V}, f AS (SELECT doc_id, start_pos, end_pos, original, trim(suggestion, ' ') AS s, issue_type, min(confidence) AS confidence, bool_or(issue_row_id % 2 = 0) AS told FROM v WHERE suggestion IS NOT NULL GROUP BY ALL),
    k AS (SELECT DISTINCT doc_id, start_pos, end_pos, trim(suggestion, ' ') AS s FROM v WHERE suggestion IS NOT NULL AND issue_row_id % 2 = 0)
    SELECT DISTINCT f.doc_id, f.start_pos AS "start", f.start_pos + length(f.original) AS "end", f.s AS suggestion FROM f JOIN documents d USING (doc_id) WHERE confidence BETWEEN 0.65 AND 1 AND trim(f.original, ' ') <> '' AND s <> '' AND s <> trim(f.original, ' ') AND length(f.original) <= 400 AND length(s) <= 400 AND f.issue_type IN ('typo', 'expression', 'spacing', 'punctuation')
    AND substr(d.text, f.start_pos + 1, length(f.original)) = f.original AND f.start_pos >= 0 AND f.start_pos + length(f.original) <= 100000 AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = f.doc_id AND k.start_pos = f.start_pos AND k.end_pos = f.start_pos + length(f.original) AND k.s = f.s)""")
def proposed_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded issues taken for a reviewer's findings, without those that every second one gives already."""
    own = table(spark, sf, "verification_issues").where("suggestion is not null").select("doc_id", "issue_row_id", "issue_type", "start_pos", "end_pos", "original", "suggestion", "confidence").distinct()
    found = own.select("doc_id", F.col("start_pos").alias("start"), F.lit(0).alias("chunk_start"), F.lit(100_000).alias("chunk_end"), "original", F.array("suggestion").alias("suggestions"), F.col("issue_type").alias("type"), "confidence")
    known = own.where("issue_row_id % 2 = 0").select("doc_id", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "suggestion")
    return review.proposed(found, table(spark, sf, "documents"), known, ("typo", "expression", "spacing", "punctuation")).select("doc_id", "start", "end", F.col("suggestions")[0].alias("suggestion")).distinct()


# -------------------------------------------------------------------------------------------------------------------------- jobs
@query("SELECT * FROM (VALUES ('parsing', 'parsing', 25), ('ocr', 'parsing', 40), ('checking_format', 'checking_format', 50), ('checking_sensitive', 'checking_sensitive', 65), ('checking_chinese', 'checking_chinese', 80), ('checking_english', 'checking_english', 90), ('finalizing', NULL, NULL)) t(stage, status, progress)")
def stages_shown(spark: SparkSession, sf: str) -> DataFrame:
    """What each stage shows."""
    return jobs.shown(spark.createDataFrame([(s,) for s, *_ in jobs.STAGES] + [("finalizing",)], "stage string").coalesce(1))


_JOBS = (("a", "parsing", None, None, "2031-02-01"), ("b", "parsing", "w1", "2031-01-02", "2031-02-01"), ("c", "completed", None, None, "2031-02-01"), ("d", "parsing", None, None, "2030-12-31"), ("e", "parsing", "w1", "2030-12-30", "2031-02-01"))
_ASKED = (("a", "w1", 0), ("a", "w2", 1), ("a", "w1", 2), ("b", "w1", 0), ("b", "w2", 0), ("c", "w1", 0), ("d", "w1", 0), ("e", "w2", 0), ("x", "w1", 0))


@query("SELECT * FROM (VALUES ('a', 'w1', 'acquired'), ('a', 'w1', 'renewed'), ('a', 'w2', 'leased'), ('b', 'w1', 'renewed'), ('b', 'w2', 'leased'), ('c', 'w1', 'terminal'), ('d', 'w1', 'retention_expired'), ('e', 'w2', 'acquired'), ('x', 'w1', 'missing')) t(job_id, owner, disposition)")
def lease_requests(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of requests for jobs."""
    at = lambda c: F.col(c).cast("timestamp").alias(c)
    own = spark.createDataFrame(list(_JOBS), "job_id string, status string, lease_owner string, lease_until string, expires_at string").coalesce(1).select("job_id", "status", "lease_owner", at("lease_until"), at("expires_at"))
    asked = spark.createDataFrame(list(_ASKED), "job_id string, owner string, after int").coalesce(1).select("job_id", "owner", F.timestamp_seconds(F.unix_timestamp(F.lit("2031-01-01 00:00:00")) + F.col("after")).alias("asked_at"), F.lit(60).alias("seconds"))
    return jobs.leased(own, asked).select("job_id", "owner", "disposition")


_LAST = "WITH e AS (SELECT DISTINCT job_id, sequence, status, received_at FROM job_events), l AS (SELECT job_id, arg_max(status, (sequence, received_at)) AS status, max(received_at) + INTERVAL 30 DAY AS expires_at, CASE WHEN max(sequence) % 3 = 0 THEN max(received_at) + INTERVAL 60 DAY END AS lease_until FROM e GROUP BY job_id)"


@query(f"{_LAST} SELECT job_id, 'expired' AS status FROM l WHERE expires_at <= TIMESTAMPTZ '2031-06-01 00:00:00+00' AND NOT coalesce(lease_until > TIMESTAMPTZ '2031-06-01 00:00:00+00', false) AND status <> 'expired'")
def expired_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs whose retention of thirty days has ended and that nobody holds."""
    log = table(spark, sf, "job_events")
    last = log.groupBy("job_id").agg(F.max_by("status", F.struct("sequence", "received_at")).alias("status"), (F.max("received_at") + F.expr("interval 30 day")).alias("expires_at"), F.when(F.max("sequence") % 3 == 0, F.max("received_at") + F.expr("interval 60 day")).alias("lease_until"))
    return jobs.expired(last, "2031-06-01 00:00:00")


# --------------------------------------------------------------------------------------------------------------------- documents
@query("SELECT doc_id, 'p-0' AS block_id, 0 AS global_start, length(text) AS global_end, 'sha256:' || sha256(text) AS source_version FROM documents WHERE text IS NOT NULL AND text <> ''")
def direct_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The texts as documents with one block each."""
    docs, blocks = documents.direct(table(spark, sf, "documents"))
    return blocks.join(docs.select("doc_id", "source_version"), "doc_id").select("doc_id", "block_id", "global_start", "global_end", "source_version")


@query("""WITH m AS (SELECT DISTINCT doc_id, block_index, global_start, global_end, CASE block_index % 3 WHEN 0 THEN '第' || (block_index + 1) || '段' WHEN 1 THEN '第 ' || page || ' 页' ELSE 'x' END AS label FROM document_blocks), d AS (SELECT doc_id, length(text) AS size FROM documents WHERE text IS NOT NULL),
    k AS (SELECT m.*, least(global_end, size) AS e FROM m JOIN d USING (doc_id) WHERE least(global_end, size) > global_start), p AS (SELECT *, TRY_CAST(nullif(regexp_extract(label, '^第\\s*(\\d+)\\s*段', 1), '') AS INT) AS para, TRY_CAST(nullif(regexp_extract(label, '^第\\s*(\\d+)\\s*页', 1), '') AS INT) AS pg FROM k)
    SELECT doc_id, CASE WHEN para IS NOT NULL THEN 'paragraph-' || (para - 1) WHEN pg IS NOT NULL THEN 'page-' || pg ELSE 'block-' || block_index END AS block_id, global_start, e AS global_end FROM p
    UNION ALL SELECT doc_id, 'file-0', 0, size FROM d WHERE doc_id NOT IN (SELECT doc_id FROM k)""")
def mapped_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks by a map of labelled stretches, made of the recorded blocks."""
    n = F.col("block_index")
    label = F.when(n % 3 == 0, F.concat(F.lit("第"), (n + 1).cast("string"), F.lit("段"))).when(n % 3 == 1, F.concat(F.lit("第 "), F.col("page").cast("string"), F.lit(" 页"))).otherwise("x")
    own = table(spark, sf, "document_blocks").select("doc_id", n.alias("nth"), F.col("global_start").alias("start"), F.col("global_end").alias("end"), label.alias("label")).distinct()
    return documents.mapped_blocks(table(spark, sf, "documents"), own).select("doc_id", "block_id", "global_start", "global_end")


_UPLOADS = (
    ("a.txt", "text/plain", "中文".encode(), None), ("b.txt", "text/plain", b"a\x00b" * 9, None), ("c.pdf", "application/pdf", b"%PDF-1.7", None), ("d.pdf", "application/pdf", b"PK", "content of another format"), ("e.exe", None, b"MZ", "unknown format"), ("f.rtf", "application/rtf", b" {\\rtf1 x}", None),
    ("g.docx", None, b"PK\x03\x04", "no archive"), ("h.png", "image/jpeg", b"\x89PNG\r\n\x1a\n", "MIME type of another format"), ("i.md", "text/plain", b"", "empty"), ("j.doc", None, bytes.fromhex("D0CF11E0A1B11AE1"), None), ("k.jpeg", "image/jpeg", b"\xff\xd8\xff\xe0", None),
)


@query(_values([(n, p) for n, _, _, p in _UPLOADS if n != "b.txt"], "source_name, problem"))
def upload_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with uploads of each format."""
    rows = [(n, m, bytearray(d)) for n, m, d, _ in _UPLOADS if n != "b.txt"]
    return documents.checked_uploads(spark.createDataFrame(rows, "source_name string, mime string, content binary").coalesce(1))


@query("SELECT * FROM (VALUES ('txt', 'text/plain', true), ('md', 'text/markdown', true), ('csv', 'text/csv', true), ('rtf', 'application/rtf', true), ('docx', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', true), ('doc', 'application/msword', false), ('pdf', 'application/pdf', false), ('png', 'image/png', false), ('jpg', 'image/jpeg', false)) t(extension, mime, parsed_here)")
def formats(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue of formats."""
    return documents.formats(spark)


@query("SELECT doc_id, block_index FROM (SELECT DISTINCT doc_id, block_index FROM document_blocks) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE scenario = 'news')")
def blocks_after_deletion(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks left once the documents of a scenario are deleted with theirs."""
    gone = table(spark, sf, "documents").where("scenario = 'news'").select("doc_id")
    return table(spark, sf, "document_blocks").select("doc_id", "block_index").distinct().join(gone, "doc_id", "left_anti")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM verification_issues v WHERE v.doc_id = d.doc_id AND v.severity = 'error')")
def documents_with_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that have a recorded error."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "verification_issues").where("severity = 'error'").select("doc_id"), "doc_id", "left_semi")


@query(f"{_LAST} SELECT job_id, CASE WHEN status NOT IN ('completed', 'partial', 'failed', 'expired') AND expires_at <= TIMESTAMPTZ '2031-06-01 00:00:00+00' THEN 'failed' ELSE status END AS status, status NOT IN ('completed', 'partial', 'failed', 'expired') AND expires_at <= TIMESTAMPTZ '2031-06-01 00:00:00+00' AS changed FROM l")
def updated_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The jobs after those that stand still for too long are set to failed, and which are."""
    last = table(spark, sf, "job_events").groupBy("job_id").agg(F.max_by("status", F.struct("sequence", "received_at")).alias("status"), (F.max("received_at") + F.expr("interval 30 day")).alias("expires_at"))
    stale = ~F.col("status").isin(*jobs.FINAL) & (F.col("expires_at") <= F.lit("2031-06-01 00:00:00").cast("timestamp"))
    return last.select("job_id", F.when(stale, "failed").otherwise(F.col("status")).alias("status"), stale.alias("changed"))


# ------------------------------------------------------------------------------------------------- operators in cases of their own
def _texts(spark: SparkSession, texts: tuple[str | None, ...]) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string").coalesce(1)


@query("SELECT * FROM (VALUES ('咱们公司马上就搞定', 0, 2, '我们'), ('咱们公司马上就搞定', 0, 4, '本公司'), ('咱们公司马上就搞定', 4, 7, '即将'), ('咱们公司马上就搞定', 7, 8, '做')) t(text, \"start\", \"end\", suggestion)")
def case_colloquial_expr(spark: SparkSession, sf: str) -> DataFrame:
    """Spoken expressions, where they are asked for."""
    text = "咱们公司马上就搞定"
    return issues.raw_issues(_texts(spark, (text,)), rules.Options(only=("colloquial",), more=("colloquial",))).select(F.lit(text).alias("text"), "start", "end", "suggestion")


@query("SELECT * FROM (VALUES ('某词和某词', 0, 2, 'sensitive_words'), ('某词和某词', 3, 5, 'sensitive_words')) t(text, \"start\", \"end\", rule_id)")
def case_sensitive_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words that are given as forbidden."""
    return issues.of_findings(issues.raw_issues(_texts(spark, ("某词和某词",)), rules.Options(only=("sensitive",), forbidden=("某词",)))).select(F.lit("某词和某词").alias("text"), "start", "end", "rule_id")


_MASKED = (
    ("see `x y` now", [(4, 9)]), ("```\na\n```\nb", [(0, 10)]), ("go to https://a.test/b?c, d", [(6, 25)]), ("mail a.b@c.test!", [(5, 15)]), ("the snake_case name", [(4, 14)]), ("open ./a/b.txt here", [(5, 14)]), ("read notes.md and a.b", [(5, 13)]), ("plain 中文", []),
    ("~~~\nopen", [(0, 8)]), ("GB/T 123-45 | Name", [(0, 18)]),
)


@query(_values([(k, a, b) for k, (_, own) in enumerate(_MASKED) for a, b in own], 'doc_id, "start", "end"'))
def mask_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The technical stretches of texts."""
    return masks.technical_spans(_texts(spark, tuple(t for t, _ in _MASKED)))


@query("SELECT * FROM (VALUES (0, 'zh', 3, '总字数'), (1, 'en', 3, '总单词数'), (2, 'zh', 0, '总字数'), (3, 'zh', 2, '总字数'), (4, 'zh', 0, '总字数')) t(doc_id, language, primary_count, primary_label)")
def word_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Languages and word counts as an editor shows them."""
    return statistics.word_counts(_texts(spark, ("中文 test", "hello world\nnext", "", "12 3.5", None))).withColumn("doc_id", F.col("doc_id").cast("int"))


@query(f"WITH c AS ({_values(EXPECTED, _CASE_COLUMNS)}) SELECT 'severity' AS dimension, severity AS \"key\", count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'rule_id', rule_id, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'total', '', count(*) FROM c")
def summary_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of the cases' issues, but for types and layers."""
    return issues.summary(issues.of_findings(issues.raw_issues(spark.createDataFrame([(k, t, s) for k, (_, s, t) in enumerate(CASES)], f"doc_id bigint, text string, settings struct<{_SETTINGS}>").coalesce(1), settings="settings"))).where("dimension in ('severity', 'rule_id', 'total')")


@query(f"WITH c AS ({_values(EXPECTED, _CASE_COLUMNS)}), n AS (SELECT case_name, count(*) AS n FROM c GROUP BY ALL) SELECT case_name, CAST(n AS BIGINT) AS issues, n > 2 AS many FROM n")
def issue_counts_of_cases(spark: SparkSession, sf: str) -> DataFrame:
    """How many issues each case gives."""
    return _case_issues(spark).groupBy("case_name").agg(F.count(F.lit(1)).alias("issues")).withColumn("many", F.col("issues") > 2)


@query("SELECT * FROM (VALUES (0, '账号 and the end', 2, '【删除:帐号→修改为:账号】 and 【删除:teh→修改为:the】 end'), (1, 'same', 0, 'same'), (2, 'new', 1, '【删除:→修改为:new】'), (3, 'ac', 1, 'a【删除:b】c')) t(doc_id, text, edits, tracked)")
def edit_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with edits put in, and with what was and is; conflicting ones and those that don't fit are left out."""
    docs = _texts(spark, ("帐号 and teh end", "same", "", "abc"))
    rows = [(0, 1, 0, 2, "帐号", "账号"), (0, 2, 7, 10, "teh", "the"), (0, 3, 0, 2, "xx", "y"), (1, 4, 0, 2, "sa", "x"), (1, 5, 1, 3, "am", "y"), (2, 6, 0, 0, "", "new"), (3, 7, 1, 2, "b", "")]
    own = spark.createDataFrame(rows, "doc_id int, edit_id int, start int, end int, original string, replacement string").coalesce(1)
    plain, tracked = (edits.apply_edits(docs, own, t).withColumn("doc_id", F.col("doc_id").cast("int")) for t in (False, True))
    return plain.join(tracked.select("doc_id", F.col("text").alias("tracked")), "doc_id")


@query("SELECT * FROM (VALUES (0, 'ok', 1, 1, 2, 'x'), (1, 'ok', 0, NULL, NULL, NULL), (2, 'ok', 1, 1, 1, 'b'), (3, 'too_large', 0, NULL, NULL, NULL), (4, 'ok', 1, 0, 10, 'bbbbbbbbbb'), (5, 'ok', 1, 0, 3, '')) t(doc_id, status, edits, \"start\", \"end\", replacement)")
def diff_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of texts within a bound of work."""
    pairs = spark.createDataFrame([(0, "abc", "axc"), (1, "same", "same"), (2, "ac", "abc"), (3, "a" * 11, "b" * 11), (4, "a" * 10, "b" * 10), (5, "abc", None)], "doc_id int, original string, modified string").coalesce(1)
    first = F.get("edits", F.lit(0))
    return edits.differences(pairs, 120).select(F.col("doc_id").cast("int").alias("doc_id"), "status", F.size("edits").alias("edits"), first["start"].alias("start"), first["end"].alias("end"), first["replacement"].alias("replacement"))


@query("SELECT * FROM (VALUES (0, 0, 4), (0, 5, 9), (1, 3, 7), (2, 0, 5)) t(doc_id, \"start\", \"end\")")
def fold_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Places of a literal, whatever its case and width; an accent is part of its letter."""
    return edits.search(_texts(spark, ("Café CAFÉ cafe", "ab ｃａｆé", "cafe\u0301", "cafe", None)), "cAFé", fold=True).withColumn("doc_id", F.col("doc_id").cast("int"))


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (4, 'b'), (6, 'b')) t(issue_index, type)")
def sample_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Four of eight candidates, shared out between two types."""
    own = spark.createDataFrame([(0, 1, "a"), *((0, k, "b") for k in range(2, 7))], "doc_id int, issue_index int, type string").coalesce(1)
    return review.sample(own, 4).select("issue_index", "type")


_FILES = (
    ("a.txt", "中文".encode("gbk"), "中文", "ok"), ("b.md", "<p class=\"x\">a &amp; b</p>".encode(), "a & b", "ok"), ("c.csv", "a,b\n1,2".encode("utf-16"), "a,b\n1,2", "ok"), ("d.rtf", b"{\\rtf1 A\\u20013?\\par B\\'e9}", "A中\nBé", "ok"),
    ("e.docx", b"PK", None, "failed: no archive"), ("f.pdf", b"%PDF-1.7", None, "needs_adapter"), ("g.xyz", b"x", None, "missing_parser"),
)


@query(_values([(n, n.rsplit(".", 1)[1], t, s) for n, _, t, s in _FILES], "source_name, file_type, text, parse_status"))
def file_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Files of each type, read by the reader of their type."""
    return documents.dispatched(spark.createDataFrame([(n, bytearray(d)) for n, d, *_ in _FILES], "source_name string, content binary").coalesce(1))


@query(f"""{_V}, k AS (SELECT v.*, d.text FROM v JOIN documents d USING (doc_id)) SELECT issue_row_id, CASE WHEN text IS NULL OR start_pos < 0 OR end_pos <= start_pos OR end_pos > length(text) THEN 'span' WHEN length(original) <> end_pos - start_pos THEN 'length' WHEN substr(text, start_pos + 1, end_pos - start_pos) <> original THEN 'original' ELSE 'none' END AS fault FROM k""")
def issue_faults(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with each recorded issue against its text."""
    own = table(spark, sf, "verification_issues").select("doc_id", "issue_row_id", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "original").distinct()
    return issues.faults(own, table(spark, sf, "documents")).select("issue_row_id", F.coalesce("fault", F.lit("none")).alias("fault"))


@query(f"{_V}, k AS (SELECT *, CASE WHEN start_pos <= 200 AND end_pos > 200 THEN 0 WHEN start_pos >= 200 THEN 1 ELSE 2 END AS rank FROM v WHERE severity IN ('error', 'warning')) SELECT doc_id, arg_min(issue_row_id, (rank, start_pos, end_pos, issue_row_id)) AS issue_row_id FROM k GROUP BY doc_id")
def next_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document, the error or warning at a place or next behind it."""
    own = table(spark, sf, "verification_issues").select("doc_id", "issue_row_id", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "layer", "severity").distinct()
    return issues.navigated(own, 200, severities=("error", "warning")).select("doc_id", "issue_row_id")


@query(f"{_V}, c AS (SELECT doc_id, severity, count(*) AS n FROM v GROUP BY ALL) SELECT doc_id, string_agg('<span class=\"chip\">' || coalesce(severity, '') || ' ' || n || '</span>', '' ORDER BY '<span class=\"chip\">' || coalesce(severity, '') || ' ' || n || '</span>') AS html FROM c GROUP BY doc_id")
def report_chips(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers of recorded issues for the heads of reports."""
    return review.chips(table(spark, sf, "verification_issues").select("doc_id", "issue_row_id", "severity").distinct())


@query(f"{_BOXES}, m AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM b) SELECT doc_id, page, block_index AS box_index, CASE WHEN cy < 300 THEN 0 ELSE 1 END AS row_index, CASE WHEN cx < 200 THEN 0 WHEN cx < 400 THEN 1 ELSE 2 END AS cell_index FROM m WHERE cx >= 0 AND cx < 10000 AND cy >= 0 AND cy < 10000")
def ruled_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks' boxes in a grid of two rows and three columns."""
    own = pages.boxes_of(table(spark, sf, "document_blocks"))
    places = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    rulings = own.select("doc_id", "page").distinct().select("doc_id", "page", places(0, 200, 400, 10_000).alias("xs"), places(0, 300, 10_000).alias("ys"))
    return pages.grid_cells(own, rulings)


@query("SELECT * FROM (VALUES ('a', 3, 'gap'), ('a', 1, 'stale'), ('b', 1, 'double')) t(artifact_id, version, fault)")
def artifact_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Reservations and results of exports that don't go on from what there is."""
    rows = [("a", 1, "pending", 0), ("a", 3, "pending", 1), ("a", 1, "ready", 2), ("a", 3, "ready", 3), ("b", 1, "pending", 0), ("b", 1, "ready", 1), ("b", 1, "ready", 2), ("b", 1, "ready", 2)]
    return edits.artifact_faults(spark.createDataFrame(rows, "artifact_id string, version int, state string, nth int").coalesce(1))


_ORDERED = (("帐号，，重复重复 teh", "txt", "academic"), ("有数据显示，帐号。", "pdf", "news"))


@query("SELECT * FROM (VALUES (0, 0, 'cn_typo'), (0, 1, 'en_spelling'), (0, 2, 'repeat_punct'), (0, 3, 'repeat_word_cn'), (1, 0, 'cn_typo'), (1, 1, 'scenario.news.vague_source')) t(doc_id, place, rule_id)")
def canonical_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of rules and scenarios in the order of layers."""
    docs = spark.createDataFrame([(k, *c) for k, c in enumerate(_ORDERED)], "doc_id bigint, text string, file_type string, scenario string").coalesce(1)
    return issues.canonical(docs).select(F.col("doc_id").cast("int").alias("doc_id"), "place", "rule_id")


@query("SELECT * FROM (VALUES (0, 0, 8, 'documnet', 'document', 'warning'), (1, 4, 7, 'plen', NULL, 'info')) t(doc_id, a, b, original, suggestion, severity) WHERE doc_id = 0")
def spelling_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Words that a dictionary lacks and that are one edit from its words."""
    words = spark.createDataFrame([("document", 1000), ("documents", 20), ("colour", 9)], "word string, n bigint").coalesce(1)
    found = dictionary.spelling_issues(_texts(spark, ("documnet and colour", "metadata `documnet` Documnet")), words)
    return found.select(F.col("doc_id").cast("int").alias("doc_id"), F.col("start").alias("a"), F.col("end").alias("b"), "original", "suggestion", "severity")
