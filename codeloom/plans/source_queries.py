"""Queries through the engine's own sources: a tree of files, streams with state."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import state_table
from codeloom.plans.catalog import VERDICT_SQL, read, register
from codeloom.sources import report_writer, sinks, tree_source
from codeloom.sources.shared import shared_path
from codeloom.streaming import stateful


@register(
    "exported_tree",
    """WITH d AS (SELECT coalesce(text, '') AS text, coalesce(nullif(lang, ''), '__HIVE_DEFAULT_PARTITION__') AS l, coalesce(nullif(source, ''), '__HIVE_DEFAULT_PARTITION__') AS s FROM documents)
SELECT 'lang=' || l || '/source=' || s AS folder, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n_bytes
FROM d GROUP BY folder""",
)
def exported_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a tree of text files, one folder a language and source, read back through the tree source."""
    path = shared_path(spark, "tree")
    docs = read(spark, sf_dir, "documents").select("text", "lang", "source")
    docs.write.partitionBy("lang", "source").option("maxRecordsPerFile", 500).text(path)
    files = tree_source.entries(spark, path, max_bytes=1 << 30).where("extension = '.txt' AND state = 'regular'")
    text = F.col("content").cast("string")
    lines = F.length(text) - F.length(F.translate(text, "\n", ""))
    return files.groupBy(F.regexp_extract("rel", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.sum(lines).cast("long").alias("n_lines"), F.sum("length").alias("n_bytes"))


def drained(stream: DataFrame, tag: str) -> DataFrame:
    """What a stream returns once all that is there has been taken."""
    path = shared_path(stream.sparkSession, tag)
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stateful.use_state_store(spark)  # a glob, since a stream of a single file is refused
    return spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").select("*", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))


@register(
    "streamed_job_log",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job, ts, event_id, event_type = 'signup' AS ends, props, epoch_us(ts) // 1000 AS ms, row_number() OVER w - 1 AS n,
    lag(epoch_us(ts) // 1000) OVER w AS before, coalesce(lag(event_type = 'signup') OVER w, false) AS ended FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT *, bool_or(ended OR coalesce(ms - before >= 172800000, false)) OVER (PARTITION BY job ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS dead FROM e),
silent AS (SELECT job, count(*) AS n FROM d WHERE NOT dead GROUP BY job HAVING NOT bool_or(ends) AND max(ms) + 172800000 <= (SELECT max(ms) FROM e))
SELECT job, n AS index, CASE WHEN ends THEN 'done' ELSE 'line' END AS event, CASE WHEN ends THEN 'signup' ELSE props END AS data FROM d WHERE NOT dead
UNION ALL SELECT job, n, 'expired', NULL FROM silent""",
)
def streamed_job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each user: numbered lines up to the first sign-up or two days of silence."""
    ends = F.col("event_type") == "signup"
    rows = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("job"), "at", "seq", F.when(~ends, F.col("props")).alias("line"), F.when(ends, F.col("event_type")).alias("status"))
    return drained(stateful.indexed_log(rows, idle_seconds=172_800, forget_seconds=10**9), "job-log")


@register(
    "streamed_progress",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS step, props AS label, CAST(event_id AS DOUBLE) AS c, row_number() OVER w AS done,
    CAST(event_id AS DOUBLE) - coalesce(lag(CAST(event_id AS DOUBLE)) OVER w, 1.0) AS unit_cost FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT step, done, label, unit_cost, c - 1.0 AS step_cost, done % 10 = 0 AND done < 60 AS is_summary FROM e""",
)
def streamed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of a step for each user, with summaries every ten units."""
    rows = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("step"), "at", "seq", F.col("props").alias("label"), F.lit(60).alias("total"), F.lit(1.0).alias("base_cost"), F.col("event_id").cast("double").alias("total_cost"))
    return drained(stateful.step_progress(rows), "progress")


@register(
    "streamed_backoff",
    """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS provider, ts, event_id, (epoch_us(ts) // 1000) AS at_ms, (epoch_us(ts) // 1000) + greatest(CAST(trunc(coalesce(value, 0) * 1000) AS BIGINT), 30000) AS until_ms FROM events WHERE event_type = 'error'),
m AS (SELECT *, max(until_ms) OVER (PARTITION BY provider ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT provider, 'extended' AS event, at_ms, until_ms FROM m WHERE before IS NULL OR until_ms > before
UNION ALL SELECT provider, 'ready', max(until_ms), max(until_ms) FROM r GROUP BY provider HAVING max(until_ms) <= (SELECT max(at_ms) FROM r)""",
)
def streamed_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The back-off deadline that errors set for each user, and when it is over."""
    rows = event_stream(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").cast("string").alias("provider"), "at", "seq", F.col("value").alias("retry_after"))
    return drained(stateful.shared_backoff(rows), "backoff")


REPORT_LEVELS = "CASE verdict WHEN 'vulnerable' THEN 'error' WHEN 'bypassable' THEN 'warning' ELSE 'note' END"


@register(
    "written_report",
    f"""WITH r AS (SELECT doc_id, {VERDICT_SQL} AS verdict, coalesce(source, '') AS file FROM documents d JOIN labels l USING (doc_id))
SELECT verdict AS rule_id, {REPORT_LEVELS} AS level, file AS uri, 'document ' || doc_id AS message FROM r""",
)
def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as findings of one report, written by the report source and read back line by line."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("file")).join(read(spark, sf_dir, "labels"), "doc_id").withColumn("verdict", F.expr(VERDICT_SQL))
    found = rows.select("file", F.col("doc_id").cast("string").alias("function"), "verdict", F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("message"), F.lit(None).cast("int").alias("start_line"), F.expr(REPORT_LEVELS).alias("level"))
    folder = shared_path(spark, "report")
    os.makedirs(folder.removeprefix("file://"))
    report_writer.write_report(sinks.sarif_results(found, F.col("level")).repartitionByRange("rule_id", "result").sortWithinPartitions("rule_id", "result"), f"{folder}/report.sarif")
    lines = spark.read.text(f"{folder}/report.sarif").where("startswith(value, '{\"ruleId\"')").select(F.regexp_replace("value", ",$", "").alias("r"))
    kind = "ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>"
    r = lines.select(F.from_json("r", kind).alias("r"))
    return r.select(F.col("r.ruleId").alias("rule_id"), "r.level", F.col("r.locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("uri"), F.col("r.message.text").alias("message"))


@register(
    "resumed_state",
    """WITH o AS (SELECT 'o' || o_orderkey AS unit, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, o_totalprice AS t, md5(o_orderpriority) AS code FROM orders),
d AS (SELECT unit, code,
    CASE WHEN s = 'P' OR p = '1-URGENT' THEN 'second' WHEN s = 'F' THEN 'first' END AS last, CASE WHEN s = 'P' OR p = '1-URGENT' THEN t > 200000 ELSE false END AS failed,
    CASE WHEN s = 'F' AND NOT (p = '1-URGENT') AND k % 5 = 0 THEN 'old' ELSE code END AS held FROM o)
SELECT unit, CASE WHEN last IS NULL THEN 'new' WHEN held <> code THEN 'changed' WHEN failed THEN 'failed' ELSE 'adopted' END AS status,
  CASE WHEN last IS NOT NULL AND held = code AND NOT failed THEN last END AS state FROM d""",
)
def resumed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as units: filled ones were done first (a fifth with other code), pending and urgent ones again later; what a third run adopts."""
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("unit"), "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", F.md5(F.col("o_orderpriority").cast("binary")).alias("code_digest"))
    table = state_table.StateTable(spark, shared_path(spark, "state"))
    table.sync("backend")
    old = F.when(F.col("o_orderkey") % 5 == 0, F.lit("old")).otherwise(F.col("code_digest"))
    table.append(o.where("o_orderstatus = 'F'").select("unit", old.alias("code_digest"), F.lit("first").alias("state"), F.lit(False).alias("is_error")))
    table.append(o.where("o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'").select("unit", "code_digest", F.lit("second").alias("state"), (F.col("o_totalprice") > 200000).alias("is_error")))
    return table.resume(o.select("unit", "code_digest")).select("unit", "status", "state")
