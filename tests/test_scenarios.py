"""Scenario rules, with both kinds of line breaks and signs outside the basic plane."""

import pytest

from lectern.operators.scenarios import numeral, scenario_findings, scenario_issues


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize(
    ("scenario", "text", "expected"),
    [
        ("academic", "😀文献[2]给出方法。\n参考文献\n[1] 张三，研究。", ["[2]"]),
        ("academic", "文献[1]给出方法。\n参考文献\n[1] 张三，研究。", []),
        ("academic", "文献[2]给出方法。\n参考文献\n[1] 张三。\n张四。", []),
        ("academic", "见本文图3。\n图1 方法\n图2 结果", ["本文图3"]),
        ("academic", "缩写 AI：人工智能\n缩写 AI：智能系统", ["智能系统"]),
        ("academic", "缩写 AI：人工智能\n\n缩写 AI：智能系统", []),
        ("business", "项目：甲\n开始日期：2026-09-20\n结束日期：2026-09-10", ["2026-09-10"]),
        ("business", "项目：甲\n开始日期：2026-09-20\n备注\n结束日期：2026-09-10", []),
        ("legal", "买卖合同\n第一条 甲\n依本合同第3条办理。", ["本合同第3条"]),
        ("news", "标题：事故造成3人受伤\n导语：事故造成5人受伤", ["5"]),
        ("news", "标题：事故可能造成3人受伤\n导语：事故可能造成5人受伤", []),
        ("news", "发布日期：2026年9月8日\n今日（2026年9月7日）召开。", ["今日（2026年9月7日）"]),
        ("news", "据统计，增长一倍。据统计局发布的数据，增长。", ["据统计"]),
        ("technical", "支持版本：1.2 - 2.0\n当前版本：2.1", ["2.1"]),
        ("technical", "操作步骤：\n步骤1：开\n步骤2：返回步骤3", ["步骤3"]),
    ],
)
def test_scenario(scenario, text, expected, newline):
    text = text.replace("\n", newline)
    assert [text[a:b] for a, b, *_ in scenario_findings(text, scenario, True)] == expected


def test_incomplete_structure():
    assert not scenario_findings("文献[2]给出。\n参考文献\n[1] 张三。", "academic", False)


@pytest.mark.parametrize(("s", "n"), [("12", 12), ("三", 3), ("十", 10), ("十二", 12), ("二十", 20), ("一百零三", 103), ("一百一十", 110), ("一百三", None), ("零", None), ("012", None)])
def test_numeral(s, n):
    assert numeral(s) == n


def test_table(spark):
    rows = [(1, None, "news", "txt"), (2, "据统计，增长。", None, None), (3, "据统计，增长。", "news", None)]
    assert [r.doc_id for r in scenario_issues(spark.createDataFrame(rows, "doc_id bigint, text string, scenario string, file_type string")).collect()] == [3]
