"""A registry of checkers: functions from documents to issues, run together and brought into one order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as lex

Checker = Callable[[DataFrame], DataFrame]
#: Columns that every checker's issues must have.
COLUMNS = ("doc_id", "nth", "rule_id", "type", "severity", "layer", "start", "end", "original", "suggestion", "confidence")


class Registry:
    """Checkers by name, in the order they were registered."""

    def __init__(self) -> None:
        self._checkers: dict[str, Checker] = {}

    def register(self, name: str, checker: Checker) -> None:
        if name in self._checkers:
            raise ValueError(f"{name} is registered already")
        self._checkers[name] = checker

    def run(self, docs: DataFrame) -> DataFrame:
        """The issues of all checkers with checker and place: by layer, then by checker, then by `nth` of the checker's own order."""
        if not self._checkers:
            raise LookupError("no checker is registered")
        parts = [check(docs).select(*COLUMNS).withColumn("checker", F.lit(name)).withColumn("checker_no", F.lit(k)) for k, (name, check) in enumerate(self._checkers.items())]
        rank = F.element_at(F.create_map(*[x for k, layer in enumerate(lex.LAYER_ORDER) for x in (F.lit(layer), F.lit(k))]), F.col("layer"))
        order = Window.partitionBy("doc_id").orderBy(F.coalesce(rank, F.lit(len(lex.LAYER_ORDER))), "checker_no", "nth")
        return reduce(DataFrame.unionByName, parts).withColumn("place", F.row_number().over(order) - 1).drop("checker_no")
