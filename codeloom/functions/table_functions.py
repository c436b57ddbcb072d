"""Table functions for SQL: searches in code, and signals from a provider in batches.

`register(spark)` makes the searches known to SQL:

    SELECT u.unit_id, f.* FROM units u, LATERAL code_usages(u.code, 'run') f
    SELECT u.unit_id, f.* FROM units u, LATERAL code_definitions(u.code, 'run', true) f
    SELECT u.unit_id, f.* FROM units u, LATERAL code_section(u.code, 3, 7) f

`register_signals(spark, provider)` does so for a function over a table, whose partitions are
conversations with the provider of so many rows a call:

    SELECT * FROM unit_signals(TABLE(SELECT unit_id, code FROM units) PARTITION BY bucket ORDER BY unit_id)

A null code has no line; names are taken literally.  Rows are read one at a time and a call holds at
most `batch` of them, whatever the size of the partition.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

from codeloom.operators.entries import CONFIDENCES, SIGNAL_KINDS

# Words that begin a definition; a usage search shows so many lines of a unit.
DEFINING = "def|func|function|fn|class|sub"
MOST_MATCHES = 3
BATCH = 25


@udtf(returnType="line int, content string")
class CodeUsages:
    """The first lines (from 1) of the code at which `name(` is called, stripped."""

    def eval(self, code: str, name: str) -> Iterator[tuple]:
        if code is None or not name:
            return
        pattern, shown = re.compile(rf"\b{re.escape(name)}\s*\(", re.ASCII), 0
        for i, line in enumerate(code.split("\n")):
            if pattern.search(line):
                yield i + 1, line.strip()
                shown += 1
                if shown == MOST_MATCHES:
                    return


@udtf(returnType="line int, name string, content string")
class CodeDefinitions:
    """Lines that define `name` (or, if not exact, a name that holds it in any case)."""

    def eval(self, code: str, name: str, exact: bool) -> Iterator[tuple]:
        if code is None or not name:
            return
        for i, line in enumerate(code.split("\n")):
            if m := re.match(rf"\s*(?:{DEFINING})\s+([A-Za-z_][A-Za-z0-9_]*)", line):
                found = m[1]
                if found == name if exact else name.lower() in found.lower():
                    yield i + 1, found, line.strip()


@udtf(returnType="line int, content string")
class CodeSection:
    """Lines first..last of the code, counted from 1 and clamped."""

    def eval(self, code: str, first: int, last: int) -> Iterator[tuple]:
        if code is None or first is None or last is None:
            return
        for i, line in enumerate(code.split("\n")[max(0, first - 1) : max(0, last)]):
            yield max(1, first) + i, line


SIGNAL = "bucket string, call int, unit_id string, kind string, confidence string, reason string, error string"


def signal_function(provider: Callable[[list[dict]], str], batch: int = BATCH):
    """The table function that asks `provider` about at most `batch` rows at a time (all of a partition if batch is not positive).

    The provider gets dicts (unit_id, code) and answers JSON: {"signals": [{unit_id, kind, confidence,
    reason}]}.  Signals of other kinds, confidences or units than asked are left out.  A call that
    raises or does not answer JSON gives one row with the error; the other calls go on.
    """
    kinds, confidences = frozenset(SIGNAL_KINDS), frozenset(CONFIDENCES)

    class UnitSignals:
        def __init__(self) -> None:
            self.held: list[dict] = []
            self.call, self.bucket = 0, None

        def eval(self, row: Row) -> Iterator[tuple]:
            self.bucket = None if row["bucket"] is None else str(row["bucket"])
            self.held.append({"unit_id": row["unit_id"], "code": row["code"]})
            if batch > 0 and len(self.held) == batch:
                yield from self._ask()

        def terminate(self) -> Iterator[tuple]:
            if self.held:
                yield from self._ask()

        def _ask(self) -> Iterator[tuple]:
            held, call = self.held, self.call
            self.held, self.call = [], call + 1
            asked = {h["unit_id"] for h in held}
            try:
                found = json.loads(provider(held))["signals"]
                rows = [(s["unit_id"], s["kind"], s["confidence"], str(s.get("reason") or "")[:500]) for s in found if s.get("unit_id") in asked and s.get("kind") in kinds and s.get("confidence") in confidences]
            except Exception as e:  # what a provider raises is data here: one call's failure is one row
                yield self.bucket, call, None, None, None, None, f"{type(e).__name__}: {e}"
                return
            for r in rows:
                yield self.bucket, call, *r, None

    return udtf(UnitSignals, returnType=SIGNAL)


def unit_signals(units: DataFrame, provider: Callable[[list[dict]], str], batch: int = BATCH) -> DataFrame:
    """SIGNAL rows of units (bucket, unit_id, code): calls of a bucket take its units in order."""
    table = units.select("bucket", "unit_id", "code").asTable().partitionBy("bucket").orderBy("unit_id")
    return signal_function(provider, batch)(table)


def register(spark: SparkSession) -> None:
    spark.udtf.register("code_usages", CodeUsages)
    spark.udtf.register("code_definitions", CodeDefinitions)
    spark.udtf.register("code_section", CodeSection)


def register_signals(spark: SparkSession, provider: Callable[[list[dict]], str], batch: int = BATCH, name: str = "unit_signals") -> None:
    spark.udtf.register(name, signal_function(provider, batch))
