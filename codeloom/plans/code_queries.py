"""Queries over code texts: pages with their tags turned into comments, literals and line breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import code_text
from codeloom.plans.catalog import read, register

CHANGES = (("<!--", "/*"), ("-->", "*/"), ("<br>", "\n// "), ("</p>", "\n"), ("&amp;", '\\"'), ("<li>", "r#"), ("</li>", "#"), ("<b>", "'"), ("<p>", "f (x)"))


def code_sql() -> str:
    out = "html"
    for old, new in CHANGES:
        out = f"replace({out}, '{old}', {' || chr(10) || '.join(repr_sql(x) for x in new.split(chr(10)))})"
    return out


def repr_sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def code_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("html")
    for old, new in CHANGES:
        code = F.replace(code, F.lit(old), F.lit(new))
    return read(spark, sf_dir, "pages").select("page_id", code.alias("code"))


PIECES_SQL = """(?s)//[^\\n]*|/\\*.*?(?:\\*/|\\z)|"(?:[^"\\\\]|\\\\.)*(?:"|\\\\?\\z)|''(?:[^''\\\\]|\\\\.)*(?:''|\\\\?\\z)|[^/"'']+|/"""
BLANKED = f"""b AS (SELECT page_id, array_to_string(list_transform(regexp_extract_all(code, '{PIECES_SQL}'), lambda p: CASE WHEN p[1:2] IN ('//', '/*') THEN regexp_replace(p, '[^\\n]', ' ', 'g')
 WHEN p[1] IN ('"', '''') THEN regexp_replace(regexp_replace(p, '(?s)\\\\.', '  ', 'g'), '[^\\n]', ' ', 'g') ELSE p END), '') AS plain FROM c)"""
CODE = f"WITH c AS (SELECT page_id, {code_sql()} AS code FROM pages), "


@register("blanked_code", CODE + BLANKED + " SELECT page_id, length(plain) AS n, md5(plain) AS digest FROM b")
def blanked_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of each code text with comments and literals blanked."""
    plain = code_text.blanked_c(F.col("code"))
    return code_rows(spark, sf_dir).select("page_id", plain.alias("plain")).select("page_id", F.length("plain").cast("long").alias("n"), F.md5(F.col("plain").cast("binary")).alias("digest"))


@register("blanked_rust_code", CODE + """b AS (SELECT page_id, regexp_replace(code, '(?s)r#".*?"#|r"[^"]*"|"(?:\\\\[^\\n]|[^"\\\\])*"|''(?:\\\\[^\\n]|[^''\\\\])''', ' ', 'g') AS plain FROM c) SELECT page_id, length(plain) AS n, md5(plain) AS digest FROM b""")
def blanked_rust_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = code_text.blanked_rust(F.col("code"))
    return code_rows(spark, sf_dir).select("page_id", plain.alias("plain")).select("page_id", F.length("plain").cast("long").alias("n"), F.md5(F.col("plain").cast("binary")).alias("digest"))


@register("called_outside_literals", CODE + BLANKED + """, n AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(plain, '\\b([a-zA-Z_][a-zA-Z0-9_]*)\\s*\\(', 1)) AS name FROM b),
r AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(code, '\\b([a-zA-Z_][a-zA-Z0-9_]*)\\s*\\(', 1)) AS name FROM c)
SELECT name, count(*) AS n_raw, count(n.page_id) AS n FROM r LEFT JOIN n USING (page_id, name) WHERE name NOT IN ('if', 'while', 'for', 'switch', 'return', 'sizeof', 'typeof', 'alignof', 'offsetof', 'case', 'else') GROUP BY name""")
def called_outside_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each called name with the pages that hold such a call anywhere, and outside comments and literals."""
    code = F.col("code")
    rows = code_rows(spark, sf_dir).select(code_text.called_names(code).alias("own"), F.array_except(code_text.called_names(code, "python"), F.array(*map(F.lit, code_text.NO_CALLS["c"]))).alias("raw"))
    return rows.select("own", F.explode("raw").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(F.array_contains("own", F.col("name"))).alias("n"))
