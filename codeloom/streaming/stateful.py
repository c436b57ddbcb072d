"""Streams with keyed state and timers: job logs, step progress, shared back-off.

Each is a StatefulProcessor under `transformWithState` in event time: values of state survive a
stop, timers fire when the watermark passes them, and a run that is stopped and resumed from its
checkpoint returns what one run returns.  Rows of one key in one micro-batch are taken in order of time
and of `seq`; later batches come after.  The state store must be RocksDB (see `use_state_store`).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from codeloom.streaming.live import MOST_BYTES, MOST_LINES

JITTER_MS = 2000  # Fixed value: waiters leave a back-off spread over two seconds


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(at) -> int:
    return int(at.replace(microsecond=0).timestamp()) * 1000 + at.microsecond // 1000


def _schema(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


# ------------------------------------------------------------- a replayable source of log files


class LogReader(DataSourceStreamReader):
    """An offset is the number of bytes taken of each file; only whole lines are taken, so that any
    range of offsets reads the same lines again."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.split_bytes = int(options.get("split_bytes", 32 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        with os.scandir(self.path) as found:
            for e in found:
                if e.name.endswith(".log") and e.is_file(follow_symlinks=False):
                    out[e.name] = self._end_of_lines(e.path)
        return dict(sorted(out.items()))

    @staticmethod
    def _end_of_lines(path: str) -> int:
        with open(path, "rb") as f:
            at = f.seek(0, os.SEEK_END)
            while at > 0:
                start = max(0, at - (1 << 16))
                f.seek(start)
                if (place := f.read(at - start).rfind(b"\n")) >= 0:
                    return start + place + 1
                at = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Ranges of bytes; a line belongs to the range in which it begins."""
        out = []
        for name, stop in end.items():
            at = start.get(name, 0)
            while at < stop:
                out.append(InputPartition((name, start.get(name, 0), at, min(at + self.split_bytes, stop))))
                at += self.split_bytes
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, first, start, stop = partition.value
        with open(os.path.join(self.path, name), "rb") as f:
            f.seek(start)
            at = start
            if start > first:  # the line that the range before has begun
                f.seek(start - 1)
                at = start - 1 + len(f.readline())
            while at < stop:
                line = f.readline()
                yield name.removesuffix(".log"), at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codeloom_logs"

    def schema(self) -> str:
        return "job string, seq long, line string"

    def streamReader(self, schema) -> LogReader:
        return LogReader(dict(self.options))


def log_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """job, seq (the line's place in bytes), line of the *.log files below `path` as they grow."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("codeloom_logs").options(path=path, **options).load()


# ------------------------------------------------------------- job logs


class LogIndex(StatefulProcessor):
    """Numbers a job's lines, stops at the cap, ends with its terminal event or after silence."""

    def __init__(self, idle_ms: int, forget_ms: int, most_lines: int, most_bytes: int):
        self.idle_ms, self.forget_ms, self.most_lines, self.most_bytes = idle_ms, forget_ms, most_lines, most_bytes

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", _schema(next=LongType(), size=LongType(), full=BooleanType(), done=BooleanType(), seen=LongType()))

    def _wake(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, size, full, done, seen = self.state.get() if self.state.exists() else (0, 0, False, False, None)
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            now = _millis(r.at)
            # silence counts by the rows' own times, so that it does not matter whether the timer came first
            if seen is not None and not done and now >= seen + self.idle_ms:
                done, seen = True, seen + self.idle_ms
                yield Row(job=key[0], index=n, event="expired", data=None)
            if done:
                if now < seen + self.forget_ms:
                    continue
                n, size, full, done = 0, 0, False, False
            seen = max(now, seen or now)
            if r.line is not None and not full:
                size += len(r.line.encode("utf-8"))
                full = n >= self.most_lines or size > self.most_bytes
                if not full:
                    yield Row(job=key[0], index=n, event="line", data=r.line)
                    n += 1
            if r.status is not None:
                done = True
                yield Row(job=key[0], index=n, event="done", data=r.status)
        self.state.update((n, size, full, done, seen))
        self._wake(seen + (self.forget_ms if done else self.idle_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            n, size, full, done, seen = self.state.get()
            if done:
                self.state.clear()
            else:
                self.state.update((n, size, full, True, seen + self.idle_ms))
                self._wake(seen + self.idle_ms + self.forget_ms)
                yield Row(job=key[0], index=n, event="expired", data=None)

    def close(self) -> None:
        pass


def indexed_log(lines: DataFrame, late: str = "0 seconds", idle_seconds: int = 3600, forget_seconds: int = 86_400, most_lines: int = MOST_LINES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """job, index, event, data of streamed (job, at, seq, line, status).

    Events are 'line' (indices from 0, never shifted, none beyond the cap), then one of 'done' (a row with a
    status; its data) or 'expired' (no row for so long), with the next index.  What comes after the end
    is left out while the job is remembered (`forget_seconds` from its end), and begins a new one after that.  A client that has seen index i wants the rows above i.
    """
    rows = lines.select("job", "at", "seq", "line", "status").withWatermark("at", late)
    processor = LogIndex(idle_seconds * 1000, forget_seconds * 1000, most_lines, most_bytes)
    return rows.groupBy("job").transformWithState(processor, "job string, index long, event string, data string", "Append", "EventTime")


# ------------------------------------------------------------- step progress


class StepProgress(StatefulProcessor):
    """Counts a step's units and its cost above the first total."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle) -> None:
        self.state = handle.getValueState("step", _schema(done=LongType(), base=DoubleType(), last=DoubleType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        done, base, last = self.state.get() if self.state.exists() else (0, None, None)
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            if base is None:
                base = last = r.base_cost
            done += 1
            yield Row(step=key[0], done=done, label=r.label if len(r.label) <= 50 else r.label[:47] + "...", unit_cost=r.total_cost - last, step_cost=r.total_cost - base, is_summary=done % self.every == 0 and done < r.total)
            last = r.total_cost
        self.state.update((done, base, last))

    def close(self) -> None:
        pass


def step_progress(events: DataFrame, every: int = 10, late: str = "0 seconds") -> DataFrame:
    """step, done, label, unit_cost, step_cost, is_summary of streamed (step, at, seq, label, total, base_cost, total_cost).

    Costs are of the whole run: the step's is what has been added since its first row's base_cost.
    A summary falls due at every so many units, but not at the last.
    """
    rows = events.select("step", "at", "seq", "label", "total", "base_cost", "total_cost").withWatermark("at", late)
    return rows.groupBy("step").transformWithState(StepProgress(every), "step string, done long, label string, unit_cost double, step_cost double, is_summary boolean", "Append", "EventTime")


# ------------------------------------------------------------- shared back-off


class Backoff(StatefulProcessor):
    """One deadline a provider, which only grows; a timer says when it is over."""

    def __init__(self, base_ms: int):
        self.base_ms = base_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", _schema(until=LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        until = self.until.get()[0] if self.until.exists() else None
        before = until
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            new = _millis(r.at) + max(int((r.retry_after or 0) * 1000), self.base_ms)
            if until is None or new > until:
                until = new
                yield Row(provider=key[0], event="extended", at_ms=_millis(r.at), until_ms=until)
        if until != before:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(until)
            self.until.update((until,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.until.exists() and self.until.get()[0] <= at:
            self.until.clear()
            yield Row(provider=key[0], event="ready", at_ms=at, until_ms=at)

    def close(self) -> None:
        pass


def shared_backoff(reports: DataFrame, base_seconds: float = 30, late: str = "0 seconds") -> DataFrame:
    """provider, event, at_ms, until_ms of streamed rate-limit reports (provider, at, seq, retry_after seconds or null).

    'extended' where a report moves the deadline (its time plus the longer of retry_after and base) on,
    'ready' once the watermark has passed the deadline.
    """
    rows = reports.select("provider", "at", "seq", "retry_after").withWatermark("at", late)
    return rows.groupBy("provider").transformWithState(Backoff(int(base_seconds * 1000)), "provider string, event string, at_ms long, until_ms long", "Append", "EventTime")


def wakes_at(until_ms: Column, worker: Column) -> Column:
    """When a waiter goes on: the deadline and up to two seconds, the same for the same waiter and deadline."""
    return until_ms + F.pmod(F.xxhash64(worker, until_ms), F.lit(JITTER_MS))
