"""Queries of paths, symbols, prices, names and chains over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as fx
from codeloom.operators import graph as g
from codeloom.operators import remediation as rm
from codeloom.plans.catalog import read, register
from codeloom.plans.graph_queries import EDGES, edges, seeds
from codeloom.sources import languages as lang

FILES = "SELECT 'd' || (p_partkey % 7) || '/s' || (p_partkey % 11) || '/f' || (p_partkey % 50) || '.py' AS path FROM part"


@register("resolved_paths", f"""WITH f AS (SELECT DISTINCT path FROM ({FILES})), w AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN 'd1/' WHEN 1 THEN '' ELSE '' END || 's' || (s_suppkey % 13) || '/f' || (s_suppkey % 60) || '.py' AS rel FROM supplier),
 m AS (SELECT rel, count(f.path) AS n, min(f.path) AS sole, coalesce(bool_or(f.path = rel), false) AS exact FROM w LEFT JOIN f ON f.path = rel OR ends_with(f.path, '/' || rel) GROUP BY rel)
SELECT rel, CASE WHEN exact THEN rel WHEN n = 1 THEN sole END AS path, CASE WHEN exact THEN 'exact' WHEN n = 1 THEN 'suffix' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS how FROM m""")
def resolved_paths(spark, sf_dir):
    files = read(spark, sf_dir, "part").select(F.expr("concat('d', p_partkey % 7, '/s', p_partkey % 11, '/f', p_partkey % 50, '.py')").alias("path"))
    wanted = read(spark, sf_dir, "supplier").select(F.expr("concat(if(s_suppkey % 4 = 0, 'd1/', ''), 's', s_suppkey % 13, '/f', s_suppkey % 60, '.py')").alias("rel"))
    return rm.resolved_paths(wanted, files)


@register("innermost_symbols", """WITH h AS (SELECT o_orderkey AS hit_id, 'f' || (o_orderkey % 40) AS file, o_orderkey % 97 AS line FROM orders),
 s AS (SELECT 'f' || (p_partkey % 40) AS file, p_name || p_partkey AS symbol, p_partkey % 60 AS a, p_partkey % 60 + p_size AS b FROM part)
SELECT h.hit_id, (SELECT symbol FROM s WHERE s.file = h.file AND h.line BETWEEN a AND b ORDER BY b - a, symbol LIMIT 1) AS symbol FROM h""")
def innermost_symbols(spark, sf_dir):
    hits = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hit_id"), F.expr("concat('f', o_orderkey % 40)").alias("file"), (F.col("o_orderkey") % 97).alias("line"))
    p = read(spark, sf_dir, "part")
    symbols = p.select(F.expr("concat('f', p_partkey % 40)").alias("file"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("symbol"), (F.col("p_partkey") % 60).alias("start"), (F.col("p_partkey") % 60 + F.col("p_size")).alias("end"))
    return rm.innermost(hits, symbols)


@register("impact_levels", """WITH u AS (SELECT l_suppkey AS symbol, 'm' || (l_partkey % 9) || (CASE WHEN l_partkey % 50 = 0 THEN '/api/x' ELSE '' END) AS file, 'm' || (l_suppkey % 9) AS own, l_quantity > 3 AS t FROM lineitem),
 p AS (SELECT symbol, count(DISTINCT file) FILTER (NOT t AND file <> own) AS n_files, coalesce(bool_or(NOT t AND file <> own AND file LIKE '%/api/x'), false) AS hinted FROM u GROUP BY symbol)
SELECT symbol, n_files, CASE WHEN n_files = 0 THEN 'low' WHEN n_files >= 3 OR hinted THEN 'high' ELSE 'medium' END AS level FROM p""")
def impact_levels(spark, sf_dir):
    u = read(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS symbol", "concat('m', l_partkey % 9, if(l_partkey % 50 = 0, '/api/x', '')) AS file", "concat('m', l_suppkey % 9) AS own_file", "l_quantity > 3 AS is_test")
    return rm.impact(u)


@register("test_support", """SELECT l_partkey AS file, CASE WHEN count(*) FILTER (l_returnflag = 'R') >= 1 OR count(*) FILTER (l_returnflag = 'A') >= 2 THEN 'Good' WHEN count(*) FILTER (l_returnflag = 'A') >= 1 THEN 'Some' ELSE 'None' END AS support FROM lineitem GROUP BY 1""")
def test_support(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "R", "same-file").when(F.col("l_returnflag") == "A", "same-module").otherwise("repo")
    return rm.test_support(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file"), kind.alias("proximity")))


@register("ground_truth", """SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'VULNERABLE' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'SAFE' ELSE 'UNKNOWN' END AS expected FROM customer""")
def ground_truth(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    return rm.ground_truth(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"))


@register("priced_models", """WITH p AS (SELECT DISTINCT lower(p_brand) AS model, p_size FROM part WHERE p_size < 3), one AS (SELECT model, max(p_size) AS price FROM p GROUP BY model)
SELECT p_partkey AS id, coalesce(price, 0)::DOUBLE AS price_in, price IS NULL AS unpriced FROM (SELECT p_partkey, lower(p_brand) AS model FROM part) LEFT JOIN one USING (model)""")
def priced_models(spark, sf_dir):
    """Prices are known by bare id; half of the calls name the model with vendor and date."""
    p = read(spark, sf_dir, "part")
    prices = p.where("p_size < 3").groupBy(F.lower("p_brand").alias("model")).agg(F.max("p_size").cast("double").alias("price_in"), F.lit(0.0).alias("price_out"))
    stamped = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("vendor/"), "p_brand", F.lit("-20250101"))).otherwise(F.lower("p_brand"))
    return rm.priced(p.select(F.col("p_partkey").alias("id"), stamped.alias("model")), prices).select("id", "price_in", "unpriced")


@register("merged_datasets", """WITH u AS (SELECT n AS language, k AS id FROM (SELECT 'go' AS n, 'u' || c_custkey AS k FROM customer UNION ALL SELECT 'python', 'u' || s_suppkey FROM supplier))
SELECT language, CASE WHEN dense_rank() OVER (PARTITION BY id ORDER BY language) > 1 THEN language || '::' || id ELSE id END AS id FROM u""")
def merged_datasets(spark, sf_dir):
    go = read(spark, sf_dir, "customer").selectExpr("'go' AS language", "concat('u', c_custkey) AS id")
    return rm.merged_datasets(go.unionByName(read(spark, sf_dir, "supplier").selectExpr("'python' AS language", "concat('u', s_suppkey) AS id")))


@register("three_matches_per_key", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3""")
def three_matches_per_key(spark, sf_dir):
    return rm.head_per_key(read(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], 3, F.col("ts"), F.col("event_id")).drop("ts")


@register("entry_path_lengths", EDGES + "r AS (SELECT node, 0 AS d FROM seeds UNION SELECT e.dst, r.d + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.d < 15) SELECT node, CAST(min(d) AS INT) AS calls FROM r GROUP BY node")
def entry_path_lengths(spark, sf_dir):
    return g.entry_paths(edges(spark, sf_dir), seeds(spark, sf_dir)).select("node", (F.size("path") - 1).alias("calls"))


@register("lineage_roots", """WITH RECURSIVE r AS (SELECT c_custkey AS node, c_custkey AS up, 0 AS steps FROM customer UNION ALL SELECT node, up // 2, steps + 1 FROM r WHERE up // 2 > 0)
SELECT node, min(up) AS root, CAST(max(steps) AS BIGINT) AS steps FROM r WHERE node > 0 GROUP BY node""")
def lineage_roots(spark, sf_dir):
    p = read(spark, sf_dir, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("node"), F.expr("nullif(c_custkey div 2, 0)").alias("parent"))
    return g.lineage(p).select("node", "root", "steps")


@register("effective_values", """WITH RECURSIVE r AS (SELECT c_custkey AS node, c_custkey AS up, 0 AS steps FROM customer WHERE c_custkey > 0 UNION ALL SELECT node, up // 2, steps + 1 FROM r WHERE up // 2 > 0)
SELECT node, arg_min(CASE WHEN up % 5 = 0 THEN up END, CASE WHEN up % 5 = 0 THEN steps END) AS value FROM r GROUP BY node""")
def effective_values(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("node"))
    return g.nearest_ancestor(c.withColumn("parent", F.expr("nullif(node div 2, 0)")), c.where("node % 5 = 0").withColumn("value", F.col("node")))


@register("path_languages", """WITH e AS (SELECT page_id, list_extract(['.py','.TS','.hpp','.rs','.md','.rake'], (page_id % 6 + 1)::INT) AS e FROM pages)
SELECT page_id, CASE e WHEN '.py' THEN 'python' WHEN '.TS' THEN 'javascript' WHEN '.hpp' THEN 'c' WHEN '.rs' THEN 'rust' WHEN '.rake' THEN 'ruby' END AS language,
 CASE e WHEN '.py' THEN 'python' WHEN '.TS' THEN 'typescript' WHEN '.hpp' THEN 'cpp' WHEN '.rs' THEN 'rust' WHEN '.rake' THEN 'ruby' ELSE '' END AS fence FROM e""")
def path_languages(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, (".py", ".TS", ".hpp", ".rs", ".md", ".rake"))), (F.col("page_id") % 6 + 1).cast("int"))
    p = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("src/a.b/f"), ext).alias("path"))
    return p.select("page_id", lang.language(F.col("path")).alias("language"), lang.fence(F.col("path")).alias("fence"))


@register("safe_filenames", """WITH n AS (SELECT page_id, repeat(url, (page_id % 9)::INT) AS u FROM pages), s AS (SELECT *, replace(replace(replace(replace(u, '/', '__'), chr(92), '__'), ':', '_'), ' ', '_') AS f FROM n)
SELECT page_id, CASE WHEN length(f) > 233 THEN left(f, 233) || '_' || left(sha256(u), 16) ELSE f END AS name FROM s""")
def safe_filenames(spark, sf_dir):
    long = F.repeat(F.col("url"), (F.col("page_id") % 9).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", fx.safe_filename(long).alias("name"))


@register("collapsed_lines", "SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '(\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}])\\z', ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]', ' ', 'g')) AS line_sha256 FROM documents")
def collapsed_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(fx.collapsed(F.col("text")).cast("binary"), 256).alias("line_sha256"))


@register("neutralized_boundaries", f"""SELECT doc_id, sha256(text || chr(10) || '{fx.NEUTRAL}' || chr(10) || 'x') AS code_sha256 FROM documents""")
def neutralized_boundaries(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(fx.neutralized(F.concat("text", F.lit(f"\n  // {fx.BOUNDARY}\nx"))).cast("binary"), 256).alias("code_sha256"))


@register("eta_labels", "SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE (s // 3600) || 'h' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' END AS label FROM (SELECT event_id, event_id * 37 % 9000 AS s FROM events)")
def eta_labels(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", fx.duration(F.col("event_id") * 37 % 9000).alias("label"))
