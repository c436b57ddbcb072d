"""An inverted index over texts: trigram postings written once, intersected for each query, hits verified.

A query is a literal that every hit must hold, and a pattern that decides.  The literal's trigrams
(of lower-case text) name its postings; only the rarest few are read and intersected, since a
candidate is verified anyway, and the pattern runs on candidates alone.  Postings are range-partitioned
and sorted by (gram, node), so a query's grams prune row groups, and a gram that most texts hold is
spread over many files.  A literal of fewer than three characters has no trigram: those queries, and no
others, run over all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_QUERY_GRAMS = 200_000
POSTINGS_A_TASK = 2_000_000  # about 150 MB while they are sorted
CHARS_A_TASK = 16 << 20


def grams(text: Column) -> Column:
    """The distinct trigrams of the lower-cased text: what stands behind each empty match, in one pass."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


@dataclass(frozen=True)
class Index:
    """texts: node, text; postings: gram, node; counts: gram, n."""

    texts: DataFrame
    postings: DataFrame
    counts: DataFrame


def _tasks(spark: SparkSession, size: int | None, each: int) -> int:
    """So many tasks that each gets about `each`, and no fewer than a shuffle has: a task's memory does not grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // each))


def build(texts: DataFrame, path: str, pieces: int = 1 << 16) -> Index:
    """The index of texts (node, text) below `path`; null nodes and texts are left out, several texts of a node are searched each.

    A long text is cut into pieces that overlap by two characters before its grams are taken, so that
    no row holds more than a piece's grams."""
    spark = texts.sparkSession
    rows = texts.select("node", "text").where("node IS NOT NULL AND text IS NOT NULL")
    rows.repartition(_tasks(spark, rows.agg(F.sum(F.length("text").cast("long"))).first()[0], CHARS_A_TASK), "node").write.mode("overwrite").parquet(f"{path}/texts")
    held = spark.read.schema(rows.schema).parquet(f"{path}/texts")
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(pieces))
    cut = held.select("node", F.explode(F.transform(starts, lambda i: F.substr(F.col("text"), i + 1, F.lit(pieces + 2)))).alias("piece"))
    cut.select("node", F.explode(grams(F.col("piece"))).alias("gram")).write.mode("overwrite").parquet(f"{path}/found")
    found = spark.read.schema("node " + held.schema["node"].dataType.simpleString() + ", gram string").parquet(f"{path}/found")
    found.repartitionByRange(_tasks(spark, found.count(), POSTINGS_A_TASK), "gram", "node").sortWithinPartitions("gram", "node").write.mode("overwrite").parquet(f"{path}/postings")
    postings = spark.read.schema(found.schema).parquet(f"{path}/postings")
    # a gram that two pieces of a text hold is counted twice: counts only order the grams
    postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{x}") for x in ("texts", "postings", "counts")))


def candidates(index: Index, queries: DataFrame, rarest: int = 4) -> DataFrame:
    """(query, node) whose texts hold the `rarest` (at most 63) trigrams of the query's literal; of queries without a trigram nothing."""
    asked = queries.select("query", F.explode(grams(F.col("literal"))).alias("gram"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.coalesce("n", F.lit(0)), "gram"))
    best = asked.join(index.counts, "gram", "left").withColumn("place", rank).where(F.col("place") <= rarest)
    # a gram that no text holds ends its query
    need = best.groupBy("query").agg(F.count(F.lit(1)).alias("need"), F.min(F.coalesce("n", F.lit(0))).alias("least")).where("least > 0").drop("least")
    terms = best.join(need, "query").select("query", "gram", "need", "n", F.expr("shiftleft(1L, place - 1)").alias("bit"))
    count, rows = terms.agg(F.count(F.lit(1)), F.sum("n")).first()
    terms = terms.drop("n")
    terms = F.broadcast(terms) if count <= MOST_QUERY_GRAMS else terms
    # a bit a gram, so that a gram which two pieces of a text hold counts once
    met = index.postings.join(terms, "gram").select("query", "node", "need", "bit").repartition(_tasks(index.postings.sparkSession, rows, POSTINGS_A_TASK), "query", "node")
    return met.groupBy("query", "node").agg(F.bit_or("bit").alias("bits"), F.first("need").alias("need")).where(F.bit_count("bits") == F.col("need")).select("query", "node")


def search(index: Index, queries: DataFrame, shown: Column | None = None) -> DataFrame:
    """query, node and `shown` (an expression over text, pattern and literal) of the texts that match.

    queries: query (unique), literal, pattern (a regular expression; null: the literal itself, case and all).
    """
    q = queries.select("query", "literal", "pattern").where("literal IS NOT NULL")
    short = F.length(F.lower("literal")) < 3
    tasks = _tasks(index.texts.sparkSession, index.texts.agg(F.sum(F.length("text").cast("long"))).first()[0], CHARS_A_TASK)
    met = candidates(index, q.where(~short)).join(q, "query").repartition(tasks, "node").join(index.texts.repartition(tasks, "node"), "node")
    if not q.where(short).isEmpty():
        met = met.unionByName(index.texts.join(F.broadcast(q.where(short)), F.contains("text", "literal") | F.col("pattern").isNotNull()).select(met.columns))
    hit = F.when(F.col("pattern").isNull(), F.contains("text", "literal")).otherwise(F.regexp_like("text", "pattern"))
    return met.where(hit).select("query", "node", *([] if shown is None else [shown.alias("shown")]))


def usage_queries(names: DataFrame) -> DataFrame:
    """Queries for calls of names (name): the name as a whole word, then a bracket."""
    quoted = F.concat(F.lit("\\Q"), F.col("name"), F.lit("\\E"))
    return names.where("name IS NOT NULL AND NOT contains(name, '\\\\E')").select(F.col("name").alias("query"), F.col("name").alias("literal"), F.concat(F.lit("\\b"), quoted, F.lit("\\s*\\(")).alias("pattern"))


def usages(index: Index, names: DataFrame, most: int = 3) -> DataFrame:
    """name, node, lines: the first `most` lines (from 1) of each text that calls the name."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(F.regexp_like(x, F.col("pattern")), i + 1))
    return search(index, usage_queries(names), F.slice(F.array_compact(lines), 1, most)).select(F.col("query").alias("name"), "node", F.col("shown").alias("lines"))
