"""Rules for SQL: a table function that gives the findings of a text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.rules import Options, findings
from ..session import ship


class _Findings:
    def eval(self, text: str, scenario: str) -> Iterator[tuple]:
        for _, _, f in findings(text or "", Options(scenario=scenario or "general")):
            yield f.rule_id, f.type, f.severity, f.start, f.end, f.suggestion


def register(spark: SparkSession, name: str = "issues_in") -> None:
    """Registers name(text, scenario) as a table function: rule_id, type, severity, start, end, suggestion."""
    ship(spark)
    spark.udtf.register(name, udtf(_Findings, returnType="rule_id string, type string, severity string, start int, end int, suggestion string"))
