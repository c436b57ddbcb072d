"""Streams: job logs, progress, back-off and checkpoints as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A job's log stops at the first of these.
MOST_LINES, MOST_BYTES = 20_000, 8 << 20


def json_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """New JSON-lines files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


def capped_log(lines: DataFrame, most_lines: int = MOST_LINES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """job, index, line of streamed (job, at, line): indexed in order of `at`, cut for good at the cap.

    Indices never shift: what comes after the cap is left out, and a later batch goes on counting.
    State is three numbers a job.  Rows of one batch are ordered; later batches come after."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, size, full = state.get if state.exists else (0, 0, False)
        for batch in batches:
            if full or batch.empty:
                continue
            batch = batch.sort_values(["at", "line"], kind="stable")
            total = size + batch["line"].str.encode("utf-8").str.len().cumsum()
            fits = (total <= most_bytes) & (n + pd.Series(range(1, len(batch) + 1), index=batch.index) <= most_lines)
            fits = fits.cummin()
            got = batch[fits]
            full = len(got) < len(batch)
            if len(got):
                yield pd.DataFrame({"job": key[0], "index": range(n, n + len(got)), "line": got["line"].tolist()})
                n, size = n + len(got), int(total[fits].iloc[-1])
        state.update((n, size, bool(full)))

    rows = lines.where("line IS NOT NULL").select("job", "at", "line")
    return rows.groupBy("job").applyInPandasWithState(keep, "job string, index long, line string", "n long, size long, full boolean", "append", "NoTimeout")


def replay(log: DataFrame, last_seen: int | None) -> DataFrame:
    """Rows after the last index that a client has seen; all for a new client."""
    return log if last_seen is None else log.where(F.col("index") > last_seen)


def progress(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """window start, job, n, errors, cost of streamed (job, at timestamp, status, cost), late rows taken up to `late`."""
    w = F.window("at", window)
    rows = events.withWatermark("at", late).groupBy(w.alias("w"), "job")
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("cost").alias("cost"))
    return out.select(F.col("w.start").alias("start"), "job", "n", "errors", "cost")


def backoff_deadline(events: DataFrame, base_seconds: int = 30) -> DataFrame:
    """provider, until (unix seconds): the shared deadline, the greatest of reported time plus the longer of retry_after and base."""
    until = F.unix_timestamp("at") + F.greatest(F.coalesce("retry_after", F.lit(0)), F.lit(base_seconds))
    return events.groupBy("provider").agg(F.max(until).alias("until"))


def remaining_seconds(elapsed: Column, done: Column, restored: Column, total: Column) -> Column:
    """Expected seconds left: this session's rate times what is left; null before the first unit."""
    own = done - restored
    return F.when(own > 0, elapsed / own * F.greatest(total - done, F.lit(0)))
