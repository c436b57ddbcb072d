"""Queries over function indexes, with parts as functions and their brands as languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.catalog import read, register
from codeloom.sources import function_index as fi
from codeloom.sources.shared import shared_path


@register("indexed_functions", """WITH s AS (SELECT s_nationkey % 10 AS m, sum(s_acctbal) > 0 AS ok FROM supplier GROUP BY 1)
SELECT p_brand AS language, CASE WHEN p_size % 3 = 0 THEN 'function' ELSE p_type END AS unit_type, count(*) AS n, count(*) FILTER (p_size % 2 = 1) AS n_methods, sum(length(p_name)) AS n_code, min(p_size) AS first_line
FROM part JOIN s ON right(p_brand, 1) = CAST(m AS VARCHAR) AND ok GROUP BY 1, 2""")
def indexed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, written by brand and read back for the brands whose suppliers' balance is above zero."""
    units = read(spark, sf_dir, "part").selectExpr("p_brand AS language", "concat('f', p_partkey) AS id", "concat('n', p_partkey) AS name", "p_name AS code", "IF(p_size % 3 = 0, NULL, p_type) AS unit_type", "p_size AS start", "p_size + 1 AS end", "IF(p_size % 2 = 1, p_brand, '') AS class_name")
    folder = shared_path(spark, "function-index")
    fi.write_index(units, folder)
    ok = read(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 10).cast("string").alias("m")).agg((F.sum("s_acctbal") > 0).alias("ok"))
    outcomes = units.select("language").distinct().join(ok, F.right("language", F.lit(1)) == F.col("m")).select("language", "ok")
    f = F.col("function")
    return fi.read_index(spark, folder, outcomes).groupBy("language", f["unitType"].alias("unit_type")).agg(
        F.count(F.lit(1)).alias("n"), F.count(f["className"]).alias("n_methods"), F.sum(F.length(f["code"])).alias("n_code"), F.min(f["startLine"]).alias("first_line"))
