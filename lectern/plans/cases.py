"""Cases that show each rule at work: texts with their settings, for queries whose expected rows stand in the SQL as plain values."""

from __future__ import annotations

#: (name, settings, text). Settings left out are those of Options.
CASES: tuple[tuple[str, dict, str], ...] = (
    ("typo", {}, "请登录帐号，不要涉及到别的。"),
    ("spelling", {}, "We RECIEVE teh mail."),
    ("agreement", {"enable_extended_rules": True}, "She usually have a plan.\nThey was late."),
    ("variants", {}, "请老搭当换个脚色。"),
    ("radical", {}, "⼈工检查。"),
    ("idiom", {"scenario": "general"}, "他差强人意地完成了任务。"),
    ("truncated", {}, "他迫不及。"),
    ("pair", {}, "虽然下雨了。只有三次。"),
    ("particle", {}, "由于天气原因，会议改期。"),
    ("mixing", {}, "原因是管理不善造成的。"),
    ("redundancy", {}, "大约三天左右完成。"),
    ("collocation", {}, "改善生活水平很重要。"),
    ("negation", {}, "避免事故不再发生。"),
    ("subject", {}, "通过学习使成绩提高。"),
    ("adverb", {}, "他认真的完成任务。"),
    ("crowd", {}, "这是的的测试。"),
    ("repeated mark", {}, "测试，，内容"),
    ("repeated half mark", {}, "Wait!!! Now"),
    ("half mark", {}, "中文,正文"),
    ("half mark before words", {}, "你好, hello"),
    ("half stop", {}, "结束."),
    ("mixed brackets", {}, "说明(甲）结束"),
    ("open bracket", {}, "说明(甲"),
    ("lone quote", {}, 'a "b" "c'),
    ("extra space", {}, "今天翻 译文章，再看一遍"),
    ("spaced out", {}, "我们 今天 去 公园 玩"),
    ("wide gap", {}, "One  two"),
    ("space before mark", {}, "今天好 ，他说"),
    ("space before closer", {}, "今天好 ）他说"),
    ("tight words", {"enable_extended_rules": True}, "使用AI工具"),
    ("line edges", {"enable_extended_rules": True}, " one \n\n\n\ntwo"),
    ("words twice", {}, "我们我们处理，the the end"),
    ("signs thrice", {}, "好好好的"),
    ("mixed numerals", {}, "数量5五，另有5五。"),
    ("mixed years", {}, "2024年与二〇二三年"),
    ("list gap", {}, "1. 甲\n3. 乙\n2. 丙"),
    ("list double", {}, "1. 甲\n2. 乙\n2. 丙\n3. 丁"),
    ("nested list", {}, "1. 甲\n  1. 乙\n  2. 丙\n2. 丁"),
    ("equal terms", {}, "微软发布产品。Microsoft更新。Microsoft维护。"),
    ("defined term", {}, "采用人工智能（AI）。后文使用AI和人工智能。"),
    ("one gloss", {}, "正文采用苹果公司（Apple）。其他地方写作Apple公司。"),
    ("spelt terms", {}, "iPhone, IPhone, iPhone"),
    ("glossary", {"custom_glossary": [{"original": "AI", "standard": "人工智能"}]}, "AI和APP都很好。"),
    ("banned", {"banned_words": ["唯一"], "enable_ad_extreme": True}, "这是唯一最佳的产品。"),
    ("territory", {}, "香港和中国香港。"),
    ("territory off", {"enable_sensitive": False}, "香港和中国香港。"),
    ("identity", {}, "身份证号：11010519491231002X"),
    ("card and phone", {}, "卡号4111111111111111，电话13800138000"),
    ("mail", {}, "联系 test@example.com"),
    ("mail off", {"enable_security": False}, "联系 test@example.com"),
    ("key", {}, "token = abcdefgh12"),
    ("code", {}, "```python\nrecieve = '中文?'\n```"),
    ("link", {}, "https://example.test/中文?q=1"),
    ("technical profile", {"scenario": "technical"}, "他差强人意地完成了任务。"),
    ("blank", {}, " \n\t"),
)

#: (case, place, rule, severity, start, end, suggestion) of the issues each case gives, in order.
EXPECTED: tuple[tuple[str, int, str, str, int, int, str | None], ...] = (
    ("typo", 0, "cn_typo", "error", 3, 5, "账号"),
    ("typo", 1, "cn_redundancy", "info", 8, 11, "涉及"),
    ("spelling", 0, "en_spelling", "error", 3, 10, "RECEIVE"),
    ("spelling", 1, "en_spelling", "error", 11, 14, "the"),
    ("agreement", 0, "en_subject_agreement", "warning", 12, 16, "has"),
    ("agreement", 1, "en_subject_agreement", "warning", 30, 33, "were"),
    ("variants", 0, "variant_word", "warning", 2, 4, "搭档"),
    ("variants", 1, "variant_word", "warning", 6, 8, "角色"),
    ("radical", 0, "irregular_char", "error", 0, 1, "人"),
    ("idiom", 0, "idiom_misuse", "info", 1, 5, "不尽如人意"),
    ("truncated", 0, "incomplete_phrase", "error", 1, 4, "迫不及待"),
    ("pair", 0, "missing_conjunction_pair", "warning", 0, 2, "（建议补全关联词：虽然……但是/却）"),
    ("particle", 0, "missing_particle", "warning", 0, 6, "由于天气的原因"),
    ("mixing", 0, "sentence_mixing", "warning", 0, 10, "原因是管理不善"),
    ("redundancy", 0, "redundancy", "warning", 0, 6, "大约三天"),
    ("collocation", 0, "collocation_error", "warning", 0, 6, "提高生活水平"),
    ("negation", 0, "illogic_double_neg", "warning", 0, 8, None),
    ("subject", 0, "missing_subject", "warning", 0, 5, "通过学习，"),
    ("adverb", 0, "de_vs_di", "warning", 1, 6, "认真地完成"),
    ("crowd", 0, "redundant_de", "info", 0, 6, "这是的测试"),
    ("repeated mark", 0, "repeat_punct", "warning", 2, 4, "，"),
    ("repeated half mark", 0, "repeat_punct_en", "warning", 4, 7, "!"),
    ("half mark", 0, "mixed_punct", "warning", 2, 3, "，"),
    ("half mark before words", 0, "half_in_cn_context", "warning", 2, 3, "，"),
    ("half stop", 0, "half_period_in_cn", "warning", 2, 3, "。"),
    ("mixed brackets", 0, "mixed_width_bracket", "warning", 2, 5, "（甲）"),
    ("open bracket", 0, "unmatched_bracket", "warning", 2, 3, "()"),
    ("lone quote", 0, "unmatched_quote", "warning", 6, 7, None),
    ("extra space", 0, "cn_extra_space", "error", 2, 5, "翻译"),
    ("wide gap", 0, "multi_space", "warning", 3, 5, " "),
    ("space before mark", 0, "space_before_punct", "error", 3, 5, "，"),
    ("space before closer", 0, "space_before_close_bracket", "warning", 2, 5, "好）"),
    ("space before closer", 1, "space_before_punct", "error", 3, 5, "）"),
    ("tight words", 0, "missing_space_cn_en", "info", 1, 3, "用 A"),
    ("tight words", 1, "missing_space_cn_en", "info", 3, 5, "I 工"),
    ("line edges", 0, "leading_space", "info", 0, 1, ""),
    ("line edges", 1, "trailing_space", "info", 4, 5, ""),
    ("line edges", 2, "multi_blank_line", "info", 5, 9, "\n\n"),
    ("words twice", 0, "repeat_word_cn", "warning", 0, 4, "我们"),
    ("words twice", 1, "repeat_word_en", "warning", 7, 14, "the"),
    ("signs thrice", 0, "repeat_char_cn", "warning", 0, 3, "好好"),
    ("mixed numerals", 0, "missing_space_cn_en", "info", 1, 3, "量 5"),
    ("mixed numerals", 1, "missing_space_cn_en", "info", 2, 4, "5 五"),
    ("mixed numerals", 2, "mixed_num_format", "info", 2, 4, None),
    ("mixed numerals", 3, "missing_space_cn_en", "info", 6, 8, "有 5"),
    ("mixed numerals", 4, "missing_space_cn_en", "info", 7, 9, "5 五"),
    ("mixed numerals", 5, "mixed_num_format", "info", 7, 9, None),
    ("mixed years", 0, "mixed_date_format", "info", 0, 5, None),
    ("mixed years", 1, "missing_space_cn_en", "info", 3, 5, "4 年"),
    ("list gap", 0, "numbering_gap", "warning", 5, 7, None),
    ("list gap", 1, "numbering_order", "warning", 10, 12, None),
    ("list double", 0, "numbering_duplicate", "warning", 10, 12, None),
    ("nested list", 0, "leading_space", "info", 5, 7, ""),
    ("nested list", 1, "leading_space", "info", 12, 14, ""),
    ("equal terms", 0, "term_equivalence", "warning", 7, 16, "微软"),
    ("equal terms", 1, "missing_space_cn_en", "info", 15, 17, "t 更"),
    ("equal terms", 2, "term_equivalence", "warning", 19, 28, "微软"),
    ("equal terms", 3, "missing_space_cn_en", "info", 27, 29, "t 维"),
    ("defined term", 0, "missing_space_cn_en", "info", 14, 16, "用 A"),
    ("defined term", 1, "missing_space_cn_en", "info", 16, 18, "I 和"),
    ("one gloss", 0, "missing_space_cn_en", "info", 21, 23, "作 A"),
    ("one gloss", 1, "term_equivalence", "warning", 22, 29, "苹果公司"),
    ("one gloss", 2, "missing_space_cn_en", "info", 26, 28, "e 公"),
    ("spelt terms", 0, "term_variant", "warning", 8, 14, "iPhone"),
    ("glossary", 0, "custom_glossary", "warning", 0, 2, "人工智能"),
    ("glossary", 1, "missing_space_cn_en", "info", 1, 3, "I 和"),
    ("glossary", 2, "missing_space_cn_en", "info", 2, 4, "和 A"),
    ("glossary", 3, "missing_space_cn_en", "info", 5, 7, "P 都"),
    ("banned", 0, "banned_word", "error", 2, 4, "（请替换或删除该禁用词）"),
    ("banned", 1, "ad_extreme_words", "error", 2, 4, None),
    ("banned", 2, "ad_extreme_words", "error", 4, 6, None),
    ("territory", 0, "sensitive_rules", "warning", 0, 2, "中国香港"),
    ("identity", 0, "pii_id", "error", 5, 23, "***"),
    ("card and phone", 0, "missing_space_cn_en", "info", 1, 3, "号 4"),
    ("card and phone", 1, "pii_bank", "error", 2, 18, "***"),
    ("card and phone", 2, "missing_space_cn_en", "info", 20, 22, "话 1"),
    ("card and phone", 3, "pii_phone", "error", 21, 32, "***"),
    ("mail", 0, "pii_email", "error", 3, 19, "***"),
    ("key", 0, "pii_key", "error", 0, 18, "***"),
)

#: (scenario, file type, text) of cases of the scenario rules, and (case, rule, start, end) of what they give.
SCENARIO_CASES: tuple[tuple[str, str, str], ...] = (
    ('academic', 'txt', '文献[2]给出方法。\n参考文献\n[1] 张三，研究。'),
    ('academic', 'txt', '文献[1]给出方法。\n参考文献\n[1] 张三，研究。'),
    ('academic', 'pdf', '文献[2]给出方法。\n参考文献\n[1] 张三，研究。'),
    ('academic', 'md', '图1：流程\n本文图2说明结果。'),
    ('academic', 'pdf', '缩写 AB：甲方法\n缩写 AB：乙方法'),
    ('business', 'txt', '项目：甲\n开始日期：2026-09-20\n结束日期：2026-09-10'),
    ('business', 'txt', '项目：甲\n开始日期：2026-09-01\n结束日期：2026-09-10'),
    ('legal', 'txt', '第一条 总则\n按照本合同第3条执行。'),
    ('legal', 'pdf', '第一条 总则\n按照本合同第3条执行。'),
    ('news', 'pdf', '标题：青山地震造成3人受伤\n导语：青山地震造成5人受伤。'),
    ('news', 'pdf', '标题：三月青山新增3家企业\n导语：三月青山新增5家企业。'),
    ('news', 'pdf', '发布日期：2024年3月1日\n昨日（2024年2月28日）召开会议。'),
    ('news', 'pdf', '发布日期：2024年3月1日\n昨日（2024年2月29日）召开会议。'),
    ('news', 'pdf', '有数据显示，参与人数增长。'),
    ('news', 'pdf', '据统计，人数增长（来源：市政府）。'),
    ('news', 'pdf', '> 有数据显示\n \n有数据显示，增长。'),
    ('technical', 'pdf', '支持版本：1.2.0 - 2.0.0\n当前版本：2.1.0'),
    ('technical', 'pdf', '支持版本：1.2 - 2.0\n当前版本：1.10'),
    ('technical', 'txt', '操作步骤：\n步骤1：打开。\n步骤2：失败时返回步骤3。'),
    ('technical', 'txt', '步骤1：先看。\n操作步骤：\n步骤1：打开。\n步骤2：失败时返回步骤3。'),
    ('technical', 'pdf', '参数定义：\nuser_id：编号\n示例：\n```json\n{"UserId": 1, "extra": 2}\n```'),
    ('technical', 'pdf', '参数定义：\nuser_id：编号\n示例：\n```json\n{"nested": {"UserId": 1}}\n```'),
    ('general', 'txt', '有数据显示，参与人数增长。'),
)
SCENARIO_EXPECTED: tuple[tuple[int, str, int, int], ...] = (
    (0, "scenario.academic.citation_reference", 2, 5),
    (3, "scenario.academic.caption_reference", 6, 10),
    (4, "scenario.academic.abbreviation_definition", 16, 19),
    (5, "scenario.business.date_order", 26, 36),
    (7, "scenario.legal.missing_clause", 9, 15),
    (9, "scenario.news.headline_count", 23, 24),
    (11, "scenario.news.relative_date", 15, 29),
    (13, "scenario.news.vague_source", 0, 5),
    (15, "scenario.news.vague_source", 10, 15),
    (16, "scenario.technical.version_range", 24, 29),
    (18, "scenario.technical.missing_step", 23, 26),
    (20, "scenario.technical.parameter_spelling", 31, 37),
)

#: Labelled cases of the quality gate: (name, group, split, text, (start, end, type, suggestion) of what must be found).
GATE: tuple[tuple[str, str, str, str, tuple], ...] = (
    ('common transposition', 'english', 'regression', 'teh', ((0, 3, 'typo', 'the'),)),
    ('dictionary candidate', 'english', 'regression', 'documment', ((0, 9, 'typo', 'document'),)),
    ('singular agreement', 'english', 'regression', 'She have a plan.', ((4, 8, 'grammar', 'has'),)),
    ('valid noun dose', 'english', 'regression', 'The dose is low.', ()),
    ('british spelling', 'english', 'regression', 'The colour is grey.', ()),
    ('chinese typo', 'chinese', 'regression', '按步就班。', ((0, 4, 'typo', '按部就班'),)),
    ('valid noun phrase', 'chinese', 'regression', '这是认真的工作态度。', ()),
    ('explicit subject', 'chinese', 'regression', '我们通过认真研究使方案更加完善。', ()),
    ('technical URL', 'technical', 'regression', 'https://example.test/中文?q=1', ()),
    ('fenced code', 'technical', 'regression', "```python\nrecieve = '中文?'\n```", ()),
    ('list gap', 'structure', 'regression', '1. 首项\n3. 末项', ((6, 8, 'number_format', None),)),
    ('same number and optional spacing at multiple locations', 'structure', 'regression', '5五，5五。', ((0, 2, 'number_format', None), (0, 2, 'spacing', '5 五'), (3, 5, 'number_format', None), (3, 5, 'spacing', '5 五'))),
    ('plural agreement holdout', 'english', 'holdout', 'We has the answer.', ((3, 6, 'grammar', 'have'),)),
    ('uppercase curated spelling', 'english', 'holdout', 'RECIEVE', ((0, 7, 'typo', 'RECEIVE'),)),
    ('ordinary correct English', 'english', 'holdout', 'They work every day.', ()),
    ('valid subjunctive', 'english', 'holdout', 'We insist she have a choice.', ()),
    ('plural British forms', 'english', 'holdout', 'The colours are beautiful.', ()),
    ('technical names', 'technical', 'holdout', 'PostgreSQL supports JSON.', ()),
    ('inline spelling example', 'technical', 'holdout', 'Use `teh` as an example.', ()),
    ('identifier not word', 'technical', 'holdout', 'recieve_value', ()),
    ('typo in Chinese sentence', 'chinese', 'holdout', '他迫不急待。', ((1, 5, 'typo', '迫不及待'),)),
    ('valid Chinese description', 'chinese', 'holdout', '这是仔细的研究工作。', ()),
    ('repeated phrase', 'chinese', 'holdout', '我们我们出发。', ((0, 4, 'repetition', '我们'),)),
    ('duplicate list item', 'structure', 'holdout', '1. A\n2. B\n2. C', ((10, 12, 'number_format', None),)),
    ('separate lists', 'structure', 'holdout', '1. A\n2. B\n\n1. C\n2. D', ()),
    ('version numbers', 'structure', 'holdout', '1.2.0\n2.3.0\n4.0.0', ()),
)
#: Words of a dictionary for the gate, with their frequencies.
GATE_WORDS = (("document", 1000), ("plan", 900), ("dose", 50))
