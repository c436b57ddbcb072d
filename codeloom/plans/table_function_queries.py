"""Queries through table functions: parts as code, documents as units of a provider."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import table_functions as tf
from codeloom.plans.catalog import read, register

# each part defines f<size> and calls two or three others
CODE = "concat('def f', p_size, '(x):\\n    y = f', p_size % 7, ' (x)\\n    return g.f', p_size % 5, '(y)', if(p_size % 4 = 0, concat('\\n\\ndef F', p_size, 'b():\\n    xf3(1); f3(f3(2))'), ''))"
CODE_SQL = "'def f' || p_size || '(x):\n    y = f' || p_size % 7 || ' (x)\n    return g.f' || p_size % 5 || '(y)' || CASE WHEN p_size % 4 = 0 THEN '\n\ndef F' || p_size || 'b():\n    xf3(1); f3(f3(2))' ELSE '' END"
LINES_SQL = f"l AS (SELECT p_partkey, i + 1 AS line, string_split(code, chr(10))[i + 1] AS content FROM (SELECT p_partkey, {CODE_SQL} AS code FROM part), unnest(range(len(string_split(code, chr(10))))) u(i))"


def code_view(spark: SparkSession, sf_dir: str) -> None:
    tf.register(spark)
    read(spark, sf_dir, "part").selectExpr("p_partkey", f"{CODE} AS code").createOrReplaceTempView("codeloom_code")


@register("usages_in_code", f"WITH {LINES_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY line) AS n FROM l WHERE regexp_matches(content, '\\bf3\\s*\\(')) SELECT p_partkey, CAST(line AS INTEGER) AS line, trim(content) AS content FROM m WHERE n <= 3")
def usages_in_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    code_view(spark, sf_dir)
    return spark.sql("SELECT p_partkey, u.line, u.content FROM codeloom_code, LATERAL code_usages(code, 'f3') u")


@register("definitions_in_code", f"WITH {LINES_SQL} SELECT p_partkey, CAST(line AS INTEGER) AS line, regexp_extract(content, 'def ([A-Za-z_0-9]+)', 1) AS name FROM l WHERE regexp_matches(content, '^\\s*def [A-Za-z_0-9]*[fF]4')")
def definitions_in_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    code_view(spark, sf_dir)
    return spark.sql("SELECT p_partkey, d.line, d.name FROM codeloom_code, LATERAL code_definitions(code, 'f4', false) d")


@register("sections_of_code", f"WITH {LINES_SQL} SELECT p_partkey, CAST(line AS INTEGER) AS line, content FROM l WHERE line BETWEEN 2 AND 4")
def sections_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    code_view(spark, sf_dir)
    return spark.sql("SELECT p_partkey, s.line, s.content FROM codeloom_code, LATERAL code_section(code, 2, 4) s")


def pattern_provider(rows: list[dict]) -> str:
    """A provider that answers from patterns, in the place of a model."""
    out = []
    for r in rows:
        code = r["code"] or ""
        if "@" in code:
            out.append({"unit_id": r["unit_id"], "kind": "external_input", "confidence": "medium", "reason": "address"})
        if re.search("[0-9]{3}", code):
            out.append({"unit_id": r["unit_id"], "kind": "entry_point", "confidence": "high", "reason": "number"})
    return json.dumps({"signals": out})


@register(
    "batched_signals",
    """WITH d AS (SELECT CAST(doc_id % 50 AS VARCHAR) AS bucket, CAST(doc_id AS VARCHAR) AS unit_id, coalesce(text, '') AS code,
    CAST((row_number() OVER (PARTITION BY doc_id % 50 ORDER BY CAST(doc_id AS VARCHAR)) - 1) // 25 AS INTEGER) AS call FROM documents)
SELECT bucket, call, unit_id, 'external_input' AS kind, 'medium' AS confidence, 'address' AS reason FROM d WHERE contains(code, '@')
UNION ALL SELECT bucket, call, unit_id, 'entry_point', 'high', 'number' FROM d WHERE regexp_matches(code, '[0-9]{3}')""",
)
def batched_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, 25 a call, with the patterns' answers."""
    docs = read(spark, sf_dir, "documents").select((F.col("doc_id") % 50).cast("string").alias("bucket"), F.col("doc_id").cast("string").alias("unit_id"), F.col("text").alias("code"))
    return tf.unit_signals(docs, pattern_provider).drop("error")
