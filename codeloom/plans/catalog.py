"""Registry of the engine's own queries over the driver tables, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


VERDICT_SQL = """CASE WHEN toxic IS NULL THEN 'error' WHEN toxic = 1 AND quality = 0 THEN 'vulnerable' WHEN toxic = 1 THEN 'bypassable'
 WHEN quality = 0 THEN 'inconclusive' ELSE 'safe' END"""


@register(
    "worst_verdict_per_file",
    f"""WITH r AS (SELECT source, {VERDICT_SQL} AS verdict FROM documents d JOIN labels l USING (doc_id)),
p AS (SELECT source, verdict, CASE verdict WHEN 'vulnerable' THEN 0 WHEN 'bypassable' THEN 1 WHEN 'inconclusive' THEN 2 WHEN 'safe' THEN 4 ELSE 5 END AS rank FROM r),
w AS (SELECT source AS file, min(rank) AS worst_rank, count(*) AS n_findings FROM p GROUP BY source)
SELECT file, worst_rank, n_findings, row_number() OVER (ORDER BY worst_rank, n_findings DESC, file) AS position FROM w""",
)
def worst_verdict_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id").withColumn("verdict", F.expr(VERDICT_SQL))
    rank = F.expr("CASE verdict WHEN 'vulnerable' THEN 0 WHEN 'bypassable' THEN 1 WHEN 'inconclusive' THEN 2 WHEN 'safe' THEN 4 ELSE 5 END")
    out = rows.groupBy(F.col("source").alias("file")).agg(F.min(rank).alias("worst_rank"), F.count(F.lit(1)).alias("n_findings"))
    return out.withColumn("position", F.row_number().over(Window.orderBy("worst_rank", F.desc("n_findings"), "file")))
