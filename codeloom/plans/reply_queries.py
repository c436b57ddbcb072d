"""Queries over model replies; JSON texts made of the documents' labels stand in for what a model says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import results as rs
from codeloom.plans.catalog import VERDICT_SQL, read, register

# One text of JSON a document, the same in both dialects.
JSON = f"""CASE doc_id % 11 WHEN 0 THEN '{{"finding": "' || v || '", "confidence": ' || (n_chars % 30) / 10.0 || '}}'
 WHEN 1 THEN '{{"verdict": " ' || v || ' ", "severity": " Critical ", "cwe_id": "CWE-' || n_chars || '", "confidence": true}}'
 WHEN 2 THEN '{{"verdict": "say ' || lang || '", "finding": "' || upper(v) || '", "confidence": "high", "cwe_name": "' || source || '"}}'
 WHEN 3 THEN '{{"verdict": "' || lang || '", "finding": [' || n_chars || ',"' || v || '"]}}' WHEN 4 THEN '{{"verdict": null, "finding": "' || v || '", "severity": 3, "cwe_id": ' || n_chars || '}}'
 WHEN 5 THEN '{{"reasoning": "' || lang || '", "confidence": null}}' WHEN 6 THEN '{{"finding": {{"a":' || doc_id || '}}, "confidence": -0.5}}' WHEN 7 THEN '{{"verdict": "  ", "finding": "' || lang || '"}}'
 WHEN 8 THEN '{{"finding": " ' || v || '", "verdict": 7}}' WHEN 9 THEN '[' || doc_id || ']' ELSE '{{"verdict": "' || v || '", "finding": "safe", "severity": "' || lang || '"}}' END"""
ROWS = f"SELECT d.doc_id, source, lang, n_chars, {VERDICT_SQL} AS v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.withColumn("v", F.expr(VERDICT_SQL)).selectExpr("doc_id AS id", f"{JSON} AS json")


KNOWN = "'VULNERABLE', 'BYPASSABLE', 'INCONCLUSIVE', 'PROTECTED', 'SAFE', 'INSUFFICIENT_CONTEXT', 'ERROR'"


@register("normalized_replies", f"""WITH r AS ({ROWS}), j AS (SELECT doc_id AS id, CAST({JSON} AS JSON) AS j FROM r),
f AS (SELECT id, json_type(j, '$.verdict') = 'VARCHAR' AND trim(j->>'$.verdict') <> '' AS said, upper(trim(j->>'$.verdict')) AS word, j->>'$.verdict' AS verdict, json_type(j, '$.finding') = 'VARCHAR' AS text, j->>'$.finding' AS finding,
 lower(trim(j->>'$.severity')) AS sev, json_type(j, '$.severity') AS sk, j->>'$.cwe_id' AS cwe, j->>'$.confidence' AS conf, json_type(j, '$.confidence') AS ck FROM j),
g AS (SELECT *, coalesce(said, false) AS s, coalesce(said AND word IN ({KNOWN}), false) AS known, coalesce(text AND upper(trim(finding)) IN ({KNOWN}) AND lower(trim(finding)) <> 'insufficient_context', false) AS usable, coalesce(text AND upper(finding) IN ({KNOWN}), false) AS stands FROM f),
h AS (SELECT *, CASE WHEN known THEN word WHEN s AND usable THEN upper(trim(finding)) WHEN NOT s AND stands THEN upper(finding) ELSE 'ERROR' END AS w, NOT known AND CASE WHEN s THEN NOT usable ELSE NOT stands END AS failed,
 CASE WHEN ck IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, conf::DOUBLE)) END AS number FROM g)
SELECT id, w AS verdict, CASE WHEN failed THEN 'error' ELSE finding END AS finding, CASE WHEN s AND NOT known THEN verdict END AS raw_verdict, CASE WHEN failed THEN finding END AS raw_finding,
 CASE WHEN w IN ('VULNERABLE', 'BYPASSABLE') THEN CASE WHEN sk = 'VARCHAR' AND sev IN ('critical', 'high', 'medium', 'low') THEN sev WHEN w = 'VULNERABLE' THEN 'high' ELSE 'medium' END END AS severity,
 coalesce(TRY_CAST(replace(cwe, 'CWE-', '') AS BIGINT), 0) AS cwe, number AS confidence, CASE WHEN number IS NULL THEN conf END AS raw_confidence FROM h""")
def normalized_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reply with its canonical verdict, finding, severity, weakness and confidence."""
    out = rs.normalized(replies(spark, sf_dir))
    return out.select("id", "verdict", "finding", "raw_verdict", "raw_finding", "severity", F.col("cwe").cast("long").alias("cwe"), "confidence", "raw_confidence")


LIST = """CASE id % 5 WHEN 0 THEN '{"results": [' || json || ', ' || id || ', null, ' || json || ']}' WHEN 1 THEN '{"results": ' || json || '}' WHEN 2 THEN '{"results": "' || CASE WHEN id % 2 = 0 THEN '' ELSE 'none' END || '"}'
 WHEN 3 THEN '{"other": ' || json || '}' ELSE '{"results": [[' || json || '], "x", ' || json || ', {}]}' END"""


@register("quarantined_results", f"""WITH r AS ({ROWS}), j AS (SELECT doc_id AS id, {JSON} AS json FROM r), c AS (SELECT id, CAST({LIST} AS JSON) -> '$.results' AS x FROM j),
e AS (SELECT id, list_transform(CAST(x AS JSON[]), lambda y: coalesce(json_type(y), 'NULL')) AS kinds FROM c WHERE json_type(x) = 'ARRAY')
SELECT c.id, coalesce(len(list_filter(kinds, lambda k: k = 'OBJECT')), 0) AS n_kept, CASE WHEN kinds IS NOT NULL THEN len(list_filter(kinds, lambda k: k <> 'OBJECT')) WHEN x IS NULL OR CAST(x AS VARCHAR) IN ('""', '{{}}', 'null') THEN 0 ELSE 1 END AS n_dropped FROM c LEFT JOIN e USING (id)""")
def quarantined_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects kept of each container of results, and what was counted out."""
    out = rs.result_objects(replies(spark, sf_dir).selectExpr("id", f"{LIST} AS json"))
    return out.select("id", F.size("kept").cast("long").alias("n_kept"), F.col("n_dropped").cast("long").alias("n_dropped"))
