"""A data source that writes one JSON report: parts by the tasks, then one document, all or nothing.

`frame.write.format("codeloom_report").option("path", file).save()` takes rows rule_id, result (JSON
text).  Each task writes the results of its partition, one a line, to a part file of its own and
tells how many of which rule it wrote.  The commit joins head, parts (in the order of the partitions, so
a sorted frame gives a sorted report) and tail in a file beside the target, and renames it over the
target: a reader sees the old report or the new one, never half of one.  An abort removes the parts
and leaves what was there.  A repeated or speculative attempt writes another part, and only that of
the attempt that Spark accepts is named in its message.

Results go from file to file, not through memory; rules and their counts do, so they must be few.
The target's folder must be mounted where driver and executors run.  A target that is a link is refused.

Options: `layout` sarif (default) or findings; `tool`, `version`; a save mode of append or error keeps
an existing report and fails, overwrite replaces it.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from codeloom.sources.sinks import SARIF_SCHEMA, SARIF_VERSION

NAME = "codeloom_report"


@dataclass
class Part(WriterCommitMessage):
    partition: int
    file: str
    counts: dict[str, int]


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        self.layout, self.tool, self.version = options.get("layout", "sarif"), options.get("tool", "codeloom"), options.get("version", "1")
        if self.layout not in ("sarif", "findings"):
            raise ValueError(f"layout {self.layout}")
        if os.path.islink(self.path):
            raise ValueError(f"{self.path} is a link")
        if os.path.lexists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Part:
        task = TaskContext.get()
        os.makedirs(self.parts, exist_ok=True)
        file = f"{self.parts}/{task.partitionId():06d}-{task.taskAttemptId()}"
        counts: Counter = Counter()
        with open(file, "x", encoding="utf-8") as f:
            for row in iterator:
                if row.result is not None:
                    f.write(row.result.replace("\n", " ") + "\n")
                    counts[row.rule_id or ""] += 1
        return Part(task.partitionId(), file, dict(counts))

    def _ends(self, counts: Counter) -> tuple[str, str]:
        rules = sorted(counts)
        if self.layout == "findings":
            head = {"tool": self.tool, "version": self.version}
            tail = {"statistics": {"total": counts.total(), "by_rule": {r: counts[r] for r in rules}}}
            return json.dumps(head)[:-1] + ', "findings": [\n', "], " + json.dumps(tail)[1:] + "\n"
        driver = {"name": self.tool, "version": self.version, "rules": [{"id": r} for r in rules]}
        head = {"$schema": SARIF_SCHEMA, "version": SARIF_VERSION, "runs": [{"tool": {"driver": driver}}]}
        return json.dumps(head)[:-3] + ', "results": [\n', "]}]}\n"

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        counts: Counter = Counter()
        for m in parts:
            counts.update(m.counts)
        head, tail = self._ends(counts)
        beside = f"{self.path}.new-{uuid.uuid4().hex}"
        try:
            with open(beside, "x", encoding="utf-8") as out:
                out.write(head)
                left = counts.total()
                for m in parts:
                    with open(m.file, encoding="utf-8") as f:
                        for line in f:
                            left -= 1
                            out.write(line if not left else line[:-1] + ",\n")
                out.write(tail)
                out.flush()
                os.fsync(out.fileno())
            os.replace(beside, self.path)
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(beside)
            self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        with contextlib.suppress(FileNotFoundError):
            for name in os.listdir(self.parts):
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(f"{self.parts}/{name}")
            with contextlib.suppress(OSError):  # a straggling attempt may still write
                os.rmdir(self.parts)


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "rule_id string, result string"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(dict(self.options), overwrite)


def write_report(results: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """results: rule_id, result (JSON text), in the order of the report where they are sorted."""
    results.sparkSession.dataSource.register(ReportSource)
    results.select("rule_id", "result").write.format(NAME).mode(mode).options(path=path, **options).save()
