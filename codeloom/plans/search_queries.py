"""Queries through the trigram index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import search_index as si
from codeloom.plans.catalog import read, register
from codeloom.plans.table_function_queries import CODE, CODE_SQL
from codeloom.sources.shared import shared_path


@register(
    "indexed_phrases",
    """WITH q AS (SELECT item_id, array_to_string(string_split(text, ' ')[3:5], ' ') AS literal FROM benchmark WHERE len(string_split(text, ' ')) >= 5)
SELECT item_id, doc_id FROM q JOIN documents d ON contains(d.text, q.literal)""",
)
def indexed_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold the third to fifth word of a benchmark item."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), "text")
    index = si.build(docs, shared_path(spark, "phrases"))
    words = F.split("text", " ", -1)
    q = read(spark, sf_dir, "benchmark").where(F.size(words) >= 5).select(F.col("item_id").alias("query"), F.array_join(F.slice(words, 3, 3), " ").alias("literal"), F.lit(None).cast("string").alias("pattern"))
    return si.search(index, q).select(F.col("query").alias("item_id"), F.col("node").alias("doc_id"))


@register(
    "indexed_usages",
    f"""WITH c AS (SELECT p_partkey AS node, string_split({CODE_SQL}, chr(10)) AS l FROM part), n AS (SELECT DISTINCT 'f' || p_size AS name FROM part),
u AS (SELECT name, node, i + 1 AS line FROM c, n, unnest(range(len(l))) v(i) WHERE regexp_matches(l[i + 1], '\\b' || name || '\\s*\\('))
SELECT name, node, array_to_string(list_slice(list(line ORDER BY line), 1, 3), ',') AS lines FROM u GROUP BY name, node""",
)
def indexed_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each function that some part defines is called."""
    part = read(spark, sf_dir, "part")
    index = si.build(part.selectExpr("p_partkey AS node", f"{CODE} AS text"), shared_path(spark, "usages"))
    names = part.selectExpr("concat('f', p_size) AS name").distinct()
    return si.usages(index, names).select("name", "node", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))
