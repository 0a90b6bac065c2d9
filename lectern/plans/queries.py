"""The core's queries over a data folder, and SQL with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identity, statistics
from ..functions import lexicon as lex
from ..operators import dictionary, edits, issues, jobs, layout, review, rules, scenarios
from ..session import table

# Cases of the rules that the documents hardly hold: they stand beside the documents in queries and SQL alike.
CASES = (
    "帐号登录后即可使用，大约三天左右。这份报告来自于总部。",
    "迫不及。他差强人意地完成了工作，认真的说明了原因。",
    "I recieve the mail. He go to school and teh end!!! Wait,,,, what",
    "产品销量第一，独家首选，香港和中国台湾的用户。",
    "会议在2024年和二〇二三年召开，共有3五个人,请注意.",
    "a\n\n\n\nb  \n 行首空格",
    "请联系13800138000或test@example.com，卡号4111111111111111。",
    "目的是为了提高工作效率，原因是天气不好造成的。虽然下雨了。",
    "免费赠送⼈工检查，，改善生活水平，避免事故不再发生。由于天气原因。",
)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    cases = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(CASES)], "doc_id bigint, text string")
    return table(spark, sf, "documents").select("doc_id", "text").unionByName(cases.coalesce(1))


_CASES_SQL = " UNION ALL ".join(f"SELECT {-1 - k}, '{t}'" for k, t in enumerate(CASES))
_DOCS = f"WITH d(doc_id, text) AS (SELECT doc_id, text FROM documents UNION ALL {_CASES_SQL})"
_ISSUES = "WITH v AS (SELECT DISTINCT * FROM verification_issues)"
_EVENTS = "WITH e AS (SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY job_id, sequence ORDER BY received_at, created_at, status, progress, message) nth FROM job_events) WHERE nth = 1)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --------------------------------------------------------------------------------------------------------------- rules, one by one
_CHECK_OF = {
    "cn_typo": "chinese_typos", "cn_redundancy": "chinese_typos", "en_spelling": "english_spelling", "variant_word": "variant_chars", "irregular_char": "variant_chars", "half_in_cn_context": "half_full_width",
    "incomplete_phrase": "missing_chars", "idiom_misuse": "idiom_misuse", "sentence_mixing": "expression_issues", "redundancy": "expression_issues", "collocation_error": "expression_issues", "illogic_double_neg": "expression_issues",
    "repeat_punct_en": "punctuation", "multi_blank_line": "spacing", "trailing_space": "spacing", "mixed_num_format": "number_format", "long_sentence_cn": "long_sentences", "sensitive_rules": "sensitive", "ad_extreme_words": "ad_extreme", "pii_email": "pii",
    "missing_particle": "missing_chars", "de_vs_di": "expression_issues", "repeat_word_en": "repeated_words", "repeat_word_cn": "repeated_words", "repeat_char_cn": "repeated_words", "numbering": "number_format", "mixed_date_format": "number_format",
    "unmatched_quote": "brackets_quotes", "unmatched_bracket": "brackets_quotes", "mixed_width_bracket": "brackets_quotes", "mixed_width_paren": "half_full_width", "half_period_in_cn": "half_full_width", "mixed_punct": "punctuation", "repeat_punct": "punctuation",
    "cn_extra_space": "extra_spaces", "space_before_punct": "extra_spaces", "missing_space_cn_en": "spacing", "leading_space": "spacing", "redundant_de": "grammar_patterns", "term_equivalence": "term_consistency", "term_variant": "term_consistency",
    "en_subject_agreement": "extended_english", "long_sentence_en": "long_sentences", "missing_conjunction_pair": "missing_chars", "missing_subject": "expression_issues", "pii_id": "pii", "pii_bank": "pii", "pii_phone": "pii", "pii_key": "pii",
}


def _matches(pattern: str) -> str:
    """SQL that counts the matches of a pattern in each text."""
    return f"{_DOCS} SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS m FROM d) GROUP BY doc_id"


def _either(words) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def _groups(rule_id: str) -> str:
    entries = dict(rules._REWRITES)[rule_id]
    each = " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) FROM d" for p, *_ in entries)
    return f"{_DOCS} SELECT doc_id, count(*) AS n FROM ({each}) GROUP BY doc_id"


_HAN = "[一-龥]"
_RULE_SQL = {
    "cn_typo": f"{_DOCS}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_either(lex.CHINESE_TYPOS)}')) AS w FROM d) SELECT doc_id, count(*) AS n FROM m WHERE w NOT IN ({', '.join(repr(w) for w in sorted(lex.REDUNDANT_WORDS))}) GROUP BY doc_id",
    "cn_redundancy": f"{_DOCS}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_either(lex.CHINESE_TYPOS)}')) AS w FROM d) SELECT doc_id, count(*) AS n FROM m WHERE w IN ({', '.join(repr(w) for w in sorted(lex.REDUNDANT_WORDS))}) GROUP BY doc_id",
    "en_spelling": f"{_DOCS}, m AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS w FROM d) SELECT doc_id, count(*) AS n FROM m WHERE w IN ({', '.join(repr(k) for k, v in lex.ENGLISH_TYPOS.items() if k != v)}) GROUP BY doc_id",
    "variant_word": _matches(_either(lex.VARIANT_WORDS)),
    "irregular_char": _matches("[" + "".join(lex.RADICALS) + "]"),
    "idiom_misuse": _matches(_either(lex.MISUSED_IDIOMS)),
    "half_in_cn_context": _matches(f"{_HAN}[,;:!?]"),
    "incomplete_phrase": f"{_DOCS}, m AS (SELECT doc_id, unnest(regexp_extract_all(text || '$', '{_either(lex.TRUNCATED_IDIOMS)}[^一-龥]')) AS w FROM d) SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id",
    "sentence_mixing": _groups("sentence_mixing"), "redundancy": _groups("redundancy"), "collocation_error": _groups("collocation_error"), "illogic_double_neg": _groups("illogic_double_neg"),
    "repeat_punct_en": _matches(r"(?:\.{3,}|!{3,}|\?{3,}|,{3,}|;{3,}|:{3,})"),
    "multi_blank_line": _matches(r"\n{3,}"),
    "mixed_num_format": f"{_DOCS}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9０-９]+[零〇一二三四五六七八九]')) FROM d UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '[零〇一二三四五六七八九][十百千]*[0-9０-９]+')) FROM d) SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id",
    "long_sentence_cn": f"{_DOCS}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^。！？\\n]+[。！？]')) AS s FROM d) SELECT doc_id, count(*) AS n FROM m WHERE len(regexp_extract_all(s, '{_HAN}')) > 80 GROUP BY doc_id",
    "sensitive_rules": f"{_DOCS}, m AS (SELECT doc_id, w, length(text) - length(replace(text, w, '')) AS every, length(text) - length(replace(text, '中国' || w, '')) AS good FROM d, (VALUES ('香港'), ('台湾'), ('澳门')) x(w)) SELECT doc_id, CAST(sum(every // 2 - good // 4) AS BIGINT) AS n FROM m GROUP BY doc_id HAVING sum(every // 2 - good // 4) > 0",
    "ad_extreme_words": f"{_DOCS}, m AS (SELECT doc_id, (length(text) - length(replace(text, w, ''))) // length(w) AS k FROM d, (VALUES {', '.join(f'({w!r})' for w in lex.SUPERLATIVES)}) x(w)) SELECT doc_id, CAST(sum(k) AS BIGINT) AS n FROM m GROUP BY doc_id HAVING sum(k) > 0",
    "pii_email": _matches(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
}


_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NO_BLANK = _BLANK.replace("[", "[^", 1)
_RUNS = f"{_DOCS}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9０-９]+[Xx]?')) AS r FROM d), s AS (SELECT doc_id, CASE WHEN length(r) = 18 THEN r ELSE rtrim(r, 'Xx') END AS r FROM m WHERE length(r) = 18 OR length(rtrim(r, 'Xx')) BETWEEN 11 AND 19)"
_DIGIT = "CAST(translate(substr(r, i, 1), '０１２３４５６７８９', '0123456789') AS INT)"
_LUHN = f"list_sum([CASE WHEN (length(r) - i) % 2 = 1 THEN ({_DIGIT} * 2) // 10 + ({_DIGIT} * 2) % 10 ELSE {_DIGIT} END for i in range(1, length(r) + 1)]) % 10 = 0"
_RESIDENT = f"""(length(r) = 18 AND regexp_full_match(r, '[0-9]{{17}}[0-9Xx]') AND try_strptime(substr(r, 7, 8), '%Y%m%d') IS NOT NULL AND TRY_CAST(substr(r, 7, 4) AS INT) BETWEEN 1900 AND 2031
    AND substr('10X98765432', CAST(list_sum([TRY_CAST(substr(r, i, 1) AS INT) * [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2][i] for i in range(1, 18)]) % 11 AS INT) + 1, 1) = upper(substr(r, 18, 1)))"""
_RULE_SQL |= {
    "repeat_punct": _matches("(?:" + "|".join(f"{c}{{2,}}" for c in "，。！？；：、") + ")"),
    "trailing_space": f"{_DOCS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) SELECT doc_id, count(*) AS n FROM l WHERE regexp_matches(x, '{_NO_BLANK}') AND regexp_matches(x, '{_BLANK}$') GROUP BY doc_id",
    "leading_space": f"{_DOCS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) SELECT doc_id, count(*) AS n FROM l WHERE regexp_matches(x, '{_NO_BLANK}') AND regexp_matches(x, '^{_BLANK}') GROUP BY doc_id",
    "mixed_date_format": f"{_DOCS} SELECT doc_id, CAST(1 AS BIGINT) AS n FROM d WHERE regexp_matches(text, '[0-9０-９]{{4}}年') AND regexp_matches(text, '[一二三四五六七八九〇零]{{2,4}}年')",
    "half_period_in_cn": f"{_DOCS}, c AS (SELECT doc_id, len(regexp_extract_all(text, '{_HAN}\\.')) - len(regexp_extract_all(text, '[0-9０-９]\n?{_HAN}\\.')) AS n FROM d) SELECT doc_id, CAST(n AS BIGINT) AS n FROM c WHERE n > 0",
    "missing_particle": f"{_DOCS}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, '由于[^，。！？\n]{{2,20}}原因')) AS w FROM d UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '为了[^，。！？\n]{{2,20}}目的')) FROM d) SELECT doc_id, count(*) AS n FROM m WHERE w NOT LIKE '%的原因' AND w NOT LIKE '%的目的' GROUP BY doc_id",
    "long_sentence_en": f"{_DOCS}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][^.!?\n]+(?:[.!?]|\n|$)')) AS w FROM d) SELECT doc_id, count(*) AS n FROM m WHERE regexp_matches(w, '[.!?]$') AND len(regexp_extract_all(w, '{_NO_BLANK}+')) > 40 GROUP BY doc_id",
    "pii_phone": f"{_RUNS} SELECT doc_id, count(*) AS n FROM s WHERE length(r) = 11 AND regexp_matches(r, '^1[3-9]') GROUP BY doc_id",
    "pii_id": f"{_RUNS} SELECT doc_id, count(*) AS n FROM s WHERE {_RESIDENT} GROUP BY doc_id",
    "pii_bank": f"{_RUNS} SELECT doc_id, count(*) AS n FROM s WHERE length(r) BETWEEN 15 AND 19 AND NOT regexp_matches(r, '[Xx]') AND NOT coalesce({_RESIDENT}, false) AND {_LUHN} GROUP BY doc_id",
}


def _rule_query(rule_id: str, check: str):
    options = rules.Options(only=(check,), ad_extreme=True)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = issues.raw_issues(_documents(spark, sf), options)
        wanted = F.col("rule_id").startswith("numbering_") if rule_id == "numbering" else F.col("rule_id") == rule_id
        return found.where(wanted).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))

    run.__doc__ = f"Findings of {rule_id} in each document, before any is dropped."
    return run


for _id, _check in _CHECK_OF.items():
    QUERIES[f"rule_{_id}"] = _rule_query(_id, _check)
    if _id in _RULE_SQL:
        SQL[f"rule_{_id}"] = _RULE_SQL[_id]


# ------------------------------------------------------------------------------------------------------------------ the pipeline
@query()
def issue_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of all documents by type, severity, rule and layer."""
    return issues.summary(issues.issues_of(_documents(spark, sf)))


@query()
def issue_table(spark: SparkSession, sf: str) -> DataFrame:
    """The issues of all documents in order."""
    return issues.auto_fixable(issues.issues_of(_documents(spark, sf))).select("doc_id", "issue_index", "rule_id", "type", "severity", "layer", "start", "end", "original", "suggestion", "confidence", "auto_fixable")


@query()
def issue_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their number of raw findings against the limit."""
    return issues.budget(_documents(spark, sf), limit=50)


@query()
def scenario_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of the consistency rules of each document's scenario."""
    return scenarios.scenario_issues(table(spark, sf, "documents"))


_SKIPPED = [(s, f"scenario.{s}.{name}") for s, own in scenarios.RULES.items() for name, whole, *_ in own if whole]


@query(f"SELECT doc_id, rule_id FROM documents JOIN (VALUES {', '.join(map(str, _SKIPPED))}) t(scenario, rule_id) USING (scenario) WHERE coalesce(lower(file_type) NOT IN ('txt', 'md', 'markdown'), true)")
def skipped_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that a document's file type rules out."""
    return scenarios.skipped_rules(table(spark, sf, "documents"))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(regexp_replace(text, '[^A-Za-z0-9_'']', ' ', 'g'), '[A-Za-z0-9_'']+')) AS w FROM documents), f AS (SELECT w AS word, count(*) AS n FROM t WHERE regexp_full_match(w, '[a-z]{3,32}') GROUP BY w),
    c AS (SELECT a.word, b.word AS candidate, b.n FROM f a JOIN f b ON a.n < 5 AND b.n >= 5 AND abs(length(a.word) - length(b.word)) <= 1 AND damerau_levenshtein(a.word, b.word) = 1),
    r AS (SELECT *, row_number() OVER w AS place, lead(n) OVER w AS second FROM c WINDOW w AS (PARTITION BY word ORDER BY n DESC, candidate)),
    s AS (SELECT word, n >= 10 AND n >= 5 * coalesce(second, 0) AS confident FROM r WHERE place = 1)
    SELECT r.word, r.place, r.candidate, r.n, s.confident FROM r JOIN s USING (word) WHERE r.place <= 3""")
def dictionary_spelling(spark: SparkSession, sf: str) -> DataFrame:
    """Rare words with the frequent words one edit away."""
    return dictionary.suggestions(table(spark, sf, "documents"))


# ------------------------------------------------------------------------------------------------------- counts and identities
@query("""SELECT doc_id, length(text) AS char_count, length(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g')) AS char_count_no_space,
    len(string_split(text, chr(10))) AS line_count, len(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g')) > 0)) AS paragraph_count FROM documents""")
def document_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Signs, lines and paragraphs of every document."""
    return statistics.counts(table(spark, sf, "documents"))


@query()
def document_words(spark: SparkSession, sf: str) -> DataFrame:
    """Language and word count of every document as an editor shows them."""
    return statistics.word_counts(table(spark, sf, "documents"))


@query("SELECT DISTINCT s.doc_id, s.char_count AS recorded, length(d.text) AS actual FROM text_statistics s JOIN documents d USING (doc_id) WHERE s.char_count <> length(d.text)")
def stale_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded counts that are not those of the text."""
    recorded = table(spark, sf, "text_statistics").select("doc_id", "char_count").distinct()
    return statistics.counts(table(spark, sf, "documents")).select("doc_id", F.col("char_count").alias("actual")).join(recorded.withColumnRenamed("char_count", "recorded"), "doc_id").where("recorded <> actual").select("doc_id", "recorded", "actual")


@query("SELECT doc_id, 'sha256:' || sha256(text) AS version FROM documents")
def document_version(spark: SparkSession, sf: str) -> DataFrame:
    """The version of every document by its content."""
    return table(spark, sf, "documents").select("doc_id", identity.source_version(F.col("text")).alias("version"))


@query("""WITH d AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('document:' || file_type || ':' || coalesce(source_name, '') || ':sha256:' || sha256(text))) AS h FROM documents)
    SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS identity FROM d""")
def document_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers of documents by type, name and version."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", identity.document_identity(F.col("file_type"), F.coalesce("source_name", F.lit("")), identity.source_version(F.col("text"))).alias("identity"))


# ------------------------------------------------------------------------------------------------------------------------ blocks
@query("SELECT DISTINCT b.doc_id, b.block_index FROM document_blocks b JOIN documents d USING (doc_id) WHERE substring(d.text, b.global_start + 1, b.global_end - b.global_start) <> b.text OR b.block_end - b.block_start <> length(b.text)")
def wrong_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that are not the slice of their text that they claim."""
    blocks = table(spark, sf, "document_blocks").select("doc_id", "block_index", "global_start", "global_end", "block_start", "block_end", F.col("text").alias("block_text")).distinct()
    met = blocks.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return met.where((F.col("text").substr(F.col("global_start") + 1, F.col("global_end") - F.col("global_start")) != F.col("block_text")) | (F.col("block_end") - F.col("block_start") != F.length("block_text"))).select("doc_id", "block_index").distinct()


@query(f"""{_ISSUES}, b AS (SELECT DISTINCT doc_id, block_index, global_start, global_end FROM document_blocks)
    SELECT v.issue_row_id, min(b.block_index) AS block_index FROM v LEFT JOIN b ON b.doc_id = v.doc_id AND b.global_start <= v.start_pos AND v.end_pos <= b.global_end GROUP BY v.issue_row_id""")
def issue_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The first block that holds each recorded issue."""
    own = table(spark, sf, "verification_issues").select("issue_row_id", "doc_id", F.col("start_pos").alias("start"), F.col("end_pos").alias("end")).distinct()
    return issues.located(own, table(spark, sf, "document_blocks")).select("issue_row_id", "block_index")


_AREA = """e AS (SELECT DISTINCT doc_id, page, unnest([y0, y1]) AS y FROM b), s AS (SELECT *, lead(y) OVER (PARTITION BY doc_id, page ORDER BY y) AS upto FROM e), i AS (SELECT s.doc_id, s.page, y, upto, x0, x1 FROM s JOIN b ON s.doc_id = b.doc_id AND s.page = b.page AND y0 <= y AND upto <= y1),
    o AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i), a AS (SELECT doc_id, page, round(sum(greatest(0, x1 - greatest(x0, coalesce(reach, x0))) * (upto - y)), 4) AS area FROM o GROUP BY ALL)"""
_BOXED = "b AS (SELECT DISTINCT doc_id, page, block_index, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM document_blocks WHERE bbox IS NOT NULL AND len(bbox) = 4 AND page IS NOT NULL AND bbox[3] > bbox[1] AND bbox[4] > bbox[2]{})"


@query(f"""WITH {_BOXED.format(' AND block_index % 2 = 0')}, {_AREA}, t AS (SELECT DISTINCT doc_id, block_index, page, length(text) AS n FROM document_blocks WHERE page IS NOT NULL AND block_index % 2 = 1), c AS (SELECT doc_id, page, coalesce(sum(n), 0) AS chars FROM t GROUP BY ALL),
    m AS (SELECT doc_id, page, coalesce(chars, 0) AS chars, least(1, coalesce(area, 0) / 20000) AS cover FROM c FULL JOIN a USING (doc_id, page)) SELECT doc_id, page, CASE WHEN chars < 1 AND cover > 0 THEN 'scanned' WHEN cover >= 0.5 AND chars >= 1 THEN 'mixed' ELSE 'text' END AS page_kind FROM m""")
def page_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as text, scanned or mixed, where every second block is taken for a picture."""
    blocks = table(spark, sf, "document_blocks")
    return layout.page_kinds(blocks.where("block_index % 2 = 1"), blocks.where("block_index % 2 = 0"), 20_000.0).select("doc_id", "page", "page_kind")


@query("""WITH b AS (SELECT DISTINCT doc_id, block_index, text FROM document_blocks),
    o AS (SELECT doc_id, block_index, length(text) AS n, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY block_index) AS upto FROM b WHERE text <> '')
    SELECT doc_id, block_index, CAST(upto - n - 1 AS BIGINT) AS joined_start, CAST(upto - 1 AS BIGINT) AS joined_end FROM o""")
def block_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where each block would stand in the text of all its document's blocks, joined by line breaks."""
    return layout.joined_offsets(table(spark, sf, "document_blocks"))


@query(f"WITH {_BOXED.format('')}, {_AREA} SELECT doc_id, page, area FROM a")
def box_area(spark: SparkSession, sf: str) -> DataFrame:
    """Area that the boxes of each page cover together."""
    return layout.union_area(table(spark, sf, "document_blocks"))


@query(f"""WITH {_BOXED.format('').replace('block_index,', 'block_index, text,', 1)}, m AS (SELECT p.doc_id, p.page, p.block_index AS first, q.block_index, greatest(0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0, least(p.y1, q.y1) - greatest(p.y0, q.y0)) AS shared, (p.x1 - p.x0) * (p.y1 - p.y0) + (q.x1 - q.x0) * (q.y1 - q.y0) AS both_
    FROM b p JOIN b q ON p.doc_id = q.doc_id AND p.page = q.page AND p.text = q.text AND p.block_index < q.block_index) SELECT doc_id, page, block_index, min(first) AS repeats FROM m WHERE shared >= 0.5 * (both_ - shared) AND shared > 0 GROUP BY ALL""")
def repeated_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of a page with the same text and nearly the same box."""
    return layout.overlapping_boxes(table(spark, sf, "document_blocks"))


# ------------------------------------------------------------------------------------------------------------- recorded issues
@query(f"{_ISSUES} SELECT rule_id, severity, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM v GROUP BY rule_id, severity")
def recorded_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded issues by rule and severity."""
    return table(spark, sf, "verification_issues").select("issue_row_id", "rule_id", "severity", "confidence").distinct().groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"{_ISSUES} SELECT CASE issue_type {' '.join(f'WHEN {t!r} THEN {lex.LAYER_LABELS[x]!r}' for t, x in lex.LAYERS.items())} ELSE '语篇/语体层' END AS layer_label, count(*) AS n FROM v GROUP BY 1")
def localized_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded issues by the label of their type's layer."""
    own = table(spark, sf, "verification_issues").select("issue_row_id", "issue_type").distinct().withColumn("own_layer", issues._table(lex.LAYERS, F.col("issue_type"), "discourse"))
    return own.groupBy(issues._table(lex.LAYER_LABELS, F.col("own_layer"), "").alias("layer_label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_ISSUES} SELECT issue_row_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos, CASE issue_type WHEN 'custom_term' THEN 0 WHEN 'banned_word' THEN 1 ELSE 2 END, issue_row_id) - 1 AS place FROM v")
def issue_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each recorded issue in its document."""
    kind = F.when(F.col("issue_type") == "custom_term", 0).when(F.col("issue_type") == "banned_word", 1).otherwise(2)
    order = Window.partitionBy("doc_id").orderBy("start_pos", "end_pos", kind, "issue_row_id")
    return table(spark, sf, "verification_issues").select("issue_row_id", "doc_id", "start_pos", "end_pos", "issue_type").distinct().select("issue_row_id", (F.row_number().over(order) - 1).cast("bigint").alias("place"))


@query(f"{_ISSUES} SELECT issue_row_id FROM v WHERE confidence < 0.85 AND coalesce(layer, '') <> 'security' AND issue_type NOT LIKE 'pii%' AND issue_type NOT IN ('banned_word', 'custom_term', 'variant_char')")
def review_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded issues that a reviewer should see."""
    own = table(spark, sf, "verification_issues").select("issue_row_id", "confidence", "layer", "issue_type").distinct()
    return own.where((F.col("confidence") < 0.85) & (F.coalesce("layer", F.lit("")) != "security") & ~F.col("issue_type").startswith("pii") & ~F.col("issue_type").isin("banned_word", "custom_term", "variant_char")).select("issue_row_id")


@query(f"""{_ISSUES}, o AS (SELECT issue_row_id, doc_id, start_pos, end_pos, max(end_pos) OVER w AS reach, lead(start_pos) OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos, issue_row_id) AS nxt, count(*) OVER (PARTITION BY doc_id, start_pos, end_pos) AS same
    FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY start_pos, end_pos, issue_row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT issue_row_id, coalesce(reach > start_pos, false) OR coalesce(nxt < end_pos, false) OR same > 1 AS conflict FROM o""")
def edit_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Which recorded issues can't all be accepted."""
    own = table(spark, sf, "verification_issues").select("doc_id", F.col("issue_row_id").alias("edit_id"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end")).distinct()
    return edits.conflicts(own).select(F.col("edit_id").alias("issue_row_id"), "conflict")


@query("""WITH e AS (SELECT DISTINCT doc_id, issue_row_id, start_pos, end_pos, original, suggestion FROM verification_issues WHERE suggestion IS NOT NULL),
    f AS (SELECT e.*, d.text FROM e JOIN documents d USING (doc_id) WHERE start_pos >= 0 AND end_pos >= start_pos AND end_pos <= length(d.text) AND substr(d.text, start_pos + 1, end_pos - start_pos) = original),
    o AS (SELECT *, max(end_pos) OVER w AS reach, count(*) OVER (PARTITION BY doc_id, start_pos, end_pos) AS same, lag(end_pos, 1, 0) OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos, issue_row_id) AS prev FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY start_pos, end_pos, issue_row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT doc_id FROM o GROUP BY doc_id HAVING bool_or(coalesce(reach > start_pos, false) OR same > 1)),
    s AS (SELECT doc_id, string_agg(substr(text, prev + 1, start_pos - prev) || suggestion, '' ORDER BY start_pos, end_pos) || substr(any_value(text), max(end_pos) + 1) AS t, count(*) AS n FROM o WHERE doc_id NOT IN (SELECT doc_id FROM g) GROUP BY doc_id)
    SELECT d.doc_id, sha256(coalesce(s.t, d.text)) AS text_hash, CAST(coalesce(s.n, 0) AS INT) AS edits FROM documents d LEFT JOIN s USING (doc_id)""")
def edited_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the recorded suggestions put in, where these fit their text and don't conflict."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    own = table(spark, sf, "verification_issues").where("suggestion is not null").select("doc_id", F.col("issue_row_id").alias("edit_id"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "original", F.col("suggestion").alias("replacement")).distinct()
    return edits.apply_edits(docs, own).select("doc_id", F.sha2("text", 256).alias("text_hash"), "edits")


@query("WITH t AS (SELECT doc_id, text, '编辑' AS w FROM documents) SELECT doc_id, CAST((length(text) - length(replace(text, w, ''))) // length(w) AS BIGINT) AS places FROM t WHERE contains(text, w)")
def literal_search(spark: SparkSession, sf: str) -> DataFrame:
    """How often a literal stands in each document."""
    return edits.search(table(spark, sf, "documents"), "编辑").groupBy("doc_id").agg(F.count(F.lit(1)).alias("places"))


@query()
def review_sample(spark: SparkSession, sf: str) -> DataFrame:
    """At most five recorded candidates of each document, shared out among types."""
    own = table(spark, sf, "verification_issues").where("confidence < 0.85").select("doc_id", F.col("issue_row_id").alias("issue_index"), F.col("issue_type").alias("type")).distinct()
    return review.sample(own, 5)


_SAFE = "replace(replace(replace(coalesce({}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""WITH v AS (SELECT DISTINCT doc_id, issue_row_id, rule_id, severity, original, suggestion FROM verification_issues), r AS (SELECT doc_id, issue_row_id, '<tr><td>' || issue_row_id || '</td><td>' || {_SAFE.format('rule_id')} || '</td><td>' || {_SAFE.format('severity')} || '</td><td>' || {_SAFE.format('original')} || '</td><td>' || {_SAFE.format('suggestion')} || '</td></tr>' AS x FROM v)
    SELECT doc_id, '<table>' || string_agg(x, '' ORDER BY issue_row_id, x) || '</table>' AS html FROM r GROUP BY doc_id""")
def issue_report(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's recorded issues as a table of markup."""
    own = table(spark, sf, "verification_issues").select("doc_id", F.col("issue_row_id").alias("issue_index"), "rule_id", "severity", "original", "suggestion").distinct()
    return review.report(own)


@query("""WITH b AS (SELECT DISTINCT doc_id, block_index, global_start, global_end FROM document_blocks), o AS (SELECT *, max(global_end) OVER (PARTITION BY doc_id ORDER BY global_start, global_end, block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b)
    SELECT doc_id, block_index FROM o WHERE reach > global_start""")
def overlapping_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that begin inside an earlier one."""
    return review.block_overlaps(table(spark, sf, "document_blocks"))


@query(f"{_ISSUES}, v2 AS (SELECT issue_row_id, severity, confidence, CASE issue_row_id % 3 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'uncertain' END AS verdict FROM v) SELECT issue_row_id, CASE WHEN verdict = 'uncertain' THEN 'info' ELSE severity END AS severity, CASE WHEN verdict = 'uncertain' THEN least(confidence, 0.55) ELSE confidence END AS confidence FROM v2 WHERE verdict IS DISTINCT FROM 'false_positive'")
def judged_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded issues after made-up verdicts on two thirds of them."""
    own = table(spark, sf, "verification_issues").select("doc_id", F.col("issue_row_id").alias("issue_index"), "severity", "confidence").distinct()
    verdicts = own.select("doc_id", "issue_index", F.when(F.col("issue_index") % 3 == 0, "false_positive").when(F.col("issue_index") % 3 == 1, "uncertain").alias("verdict")).where("verdict is not null")
    return review.judged(own, verdicts).select(F.col("issue_index").alias("issue_row_id"), "severity", "confidence")


# -------------------------------------------------------------------------------------------------------------------------- jobs
@query(f"{_EVENTS} SELECT job_id, max(sequence) AS sequence, arg_max(status, sequence) AS status, arg_max(progress, sequence) AS progress FROM e GROUP BY job_id")
def job_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The last state of each job."""
    return jobs.latest(table(spark, sf, "job_events"))


_STEP_SQL = "CASE {} " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(jobs.STEPS)) + " END"


@query(f"""{_EVENTS}, w AS (SELECT *, {_STEP_SQL.format('status')} AS step, lag(status) OVER o AS b_status, lag({_STEP_SQL.format('status')}) OVER o AS b_step, lag(progress) OVER o AS b_progress, lag(sequence) OVER o AS b_sequence FROM e WINDOW o AS (PARTITION BY job_id ORDER BY sequence))
    SELECT job_id, sequence, 'after_final' AS problem FROM w WHERE b_status IN ('completed', 'partial', 'failed', 'expired') UNION ALL SELECT job_id, sequence, 'step_back' FROM w WHERE step < b_step
    UNION ALL SELECT job_id, sequence, 'progress_falls' FROM w WHERE progress < b_progress UNION ALL SELECT job_id, sequence, 'missing_event' FROM w WHERE sequence > coalesce(b_sequence, -1) + 1""")
def job_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Events that do not go on from the one before."""
    return jobs.violations(table(spark, sf, "job_events"))


@query(f"{_EVENTS} SELECT job_id, sequence, status, progress FROM e WHERE sequence > 3")
def job_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Events after the fourth of each job."""
    return jobs.resumed(table(spark, sf, "job_events"), 3)


@query(f"{_EVENTS} SELECT job_id, sequence, CASE WHEN status = 'parsing' AND progress >= 40 THEN 'ocr' WHEN status = 'checking_english' AND progress >= 95 THEN 'finalizing' ELSE status END AS stage FROM e")
def job_stages(spark: SparkSession, sf: str) -> DataFrame:
    """The stage shown for each event."""
    return jobs.stage(table(spark, sf, "job_events"))


@query(f"{_EVENTS}, l AS (SELECT job_id, arg_max(status, sequence) AS status, max(received_at) AS last_seen FROM e GROUP BY job_id) SELECT job_id, status FROM l WHERE status NOT IN ('completed', 'partial', 'failed', 'expired') AND last_seen < TIMESTAMPTZ '2031-06-01 00:00:00+00' ORDER BY last_seen, job_id LIMIT 100")
def job_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred stale jobs to take up first."""
    return jobs.claims(table(spark, sf, "job_events"), "2031-06-01 00:00:00").select("job_id", "status")


# ---------------------------------------------------------------------------------------------------------------------- catalogue
@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{c}')" for s, own in rules.PROFILES.items() for c in own) + ") t(scenario, check_name)")
def scenario_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """The checks of each scenario's profile."""
    return spark.createDataFrame([(s, c) for s, own in rules.PROFILES.items() for c in own], "scenario string, check_name string")


from . import further  # noqa: E402, F401  registers its queries here
