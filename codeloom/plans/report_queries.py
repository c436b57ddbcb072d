"""Queries over reports, prose, identities and brace languages; the driver tables stand in for their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import code_text, prose
from codeloom.operators import graph as g
from codeloom.operators import reports as rp
from codeloom.plans.catalog import read, register
from codeloom.plans.graph_queries import EDGES, edges, units
from codeloom.sources import brace_units as bu

RESULTS = """WITH r AS (SELECT 'r' || l_suppkey AS repository, 'f' || l_partkey % 9 AS file, 'm' || l_partkey % 7 AS function, CAST(l_linenumber AS INT) AS cwe,
 CASE l_orderkey % 6 WHEN 0 THEN 'vulnerable' WHEN 1 THEN 'bypassable' WHEN 2 THEN 'inconclusive' WHEN 3 THEN 'protected' ELSE 'safe' END AS verdict, CASE l_orderkey % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN 'agreed' WHEN 2 THEN 'confirmed' END AS stage2 FROM lineitem),
 o AS (SELECT repository, file, function, cwe, min(CASE verdict WHEN 'vulnerable' THEN 0 ELSE 1 END) AS rank, min(stage2) AS stage2 FROM r WHERE verdict IN ('vulnerable', 'bypassable') AND coalesce(stage2, '') <> 'rejected' GROUP BY 1, 2, 3, 4),
 f AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY rank, file, function, cwe) AS number FROM o) """


def result_rows(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").selectExpr(
        "concat('r', l_suppkey) AS repository", "concat('f', l_partkey % 9) AS file", "concat('m', l_partkey % 7) AS function", "l_linenumber AS cwe",
        "CASE l_orderkey % 6 WHEN 0 THEN 'vulnerable' WHEN 1 THEN 'bypassable' WHEN 2 THEN 'inconclusive' WHEN 3 THEN 'protected' ELSE 'safe' END AS verdict", "CASE l_orderkey % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN 'agreed' WHEN 2 THEN 'confirmed' END AS stage2",
    )


@register("pipeline_findings", RESULTS + "SELECT repository, number, 'VULN-' || lpad(CAST(number AS VARCHAR), CAST(greatest(3, length(CAST(number AS VARCHAR))) AS INT), '0') AS id, file, function, cwe, CASE rank WHEN 0 THEN 'vulnerable' ELSE 'bypassable' END AS verdict, stage2, CASE rank WHEN 0 THEN 'high' ELSE 'medium' END AS severity FROM f")
def pipeline_findings(spark, sf_dir):
    return rp.pipeline_findings(result_rows(spark, sf_dir))


@register("pipeline_output", RESULTS + """SELECT r.repository, count(*) AS total, count(*) FILTER (verdict = 'vulnerable') AS vulnerable, count(*) FILTER (verdict = 'safe') AS safe,
 coalesce((SELECT string_agg(file || function || cwe, ',' ORDER BY number) FROM f WHERE f.repository = r.repository), '') AS findings FROM r GROUP BY r.repository""")
def pipeline_output(spark, sf_dir):
    r = result_rows(spark, sf_dir)
    out = rp.pipeline_output(r, rp.pipeline_findings(r))
    return out.select("repository", "total", "vulnerable", "safe", F.array_join(F.transform("findings", lambda x: F.concat(x["file"], x["function"], x["cwe"].cast("string"))), ",").alias("findings"))


@register("step_reports", """SELECT o_custkey AS run, row_number() OVER w AS place, 's' || o_orderkey AS step, o_orderstatus AS status, o_orderkey % 60 AS seconds, round(sum(o_orderkey % 9 * 0.25) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, 's' || o_orderkey), 6)::DOUBLE AS running_cost FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, 's' || o_orderkey)""")
def step_reports(spark, sf_dir):
    return rp.step_reports(read(spark, sf_dir, "orders").selectExpr("o_custkey AS run", "concat('s', o_orderkey) AS step", "o_orderdate AS at", "o_orderstatus AS status", "o_orderkey % 60 AS seconds", "o_orderkey % 9 * 0.25D AS cost"))


LANG = """l AS (SELECT src % 4 AS language, src, dst FROM edges WHERE src % 4 = dst % 4), s AS (SELECT c_custkey % 4 AS language, c_custkey AS node FROM customer WHERE c_custkey % 4 IN (0, 1) AND c_mktsegment = 'MACHINERY'),
 r AS (SELECT language, node FROM s UNION SELECT l.language, l.dst FROM r JOIN l ON l.language = r.language AND l.src = r.node)"""


@register("refiltered_units", EDGES + LANG + " SELECT node % 4 AS language, count(*) AS n FROM units WHERE node % 4 <> 0 OR node IN (SELECT node FROM r WHERE language = 0) GROUP BY 1")
def refiltered_units(spark, sf_dir):
    lang = F.col("src") % 4
    e = edges(spark, sf_dir).where("src % 4 = dst % 4").select(lang.alias("language"), "src", "dst")
    entries = read(spark, sf_dir, "customer").where("c_custkey % 4 IN (0, 1) AND c_mktsegment = 'MACHINERY'").selectExpr("c_custkey % 4 AS language", "c_custkey AS node")
    measured = spark.range(4).where("id <> 1").select(F.col("id").alias("language"))
    own = units(spark, sf_dir).select((F.col("node") % 4).alias("language"), "node")
    return rp.refiltered(own, e, entries, measured).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@register("changed_units", """WITH a AS (SELECT c_custkey AS node, c_mktsegment AS d FROM customer WHERE c_nationkey <> 3), b AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 10 = 0 THEN 'x' ELSE c_mktsegment END AS d FROM customer WHERE c_nationkey <> 7)
SELECT coalesce(a.node, b.node) AS node, CASE WHEN b.node IS NULL THEN 'new' WHEN a.node IS NULL THEN 'gone' WHEN a.d = b.d THEN 'unchanged' ELSE 'changed' END AS action FROM a FULL JOIN b ON a.node = b.node""")
def changed_units(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return rp.changed_units(c.where("c_nationkey <> 3").selectExpr("c_custkey AS node", "c_mktsegment AS digest"), c.where("c_nationkey <> 7").selectExpr("c_custkey AS node", "IF(c_custkey % 10 = 0, 'x', c_mktsegment) AS digest"))


@register("retry_rounds", "SELECT c_custkey AS node, least(c_custkey % 6, 3) AS round, c_custkey % 6 > 3 AS failed FROM customer")
def retry_rounds(spark, sf_dir):
    def step(rows, i):
        return rows.select("node", F.lit(i).cast("long").alias("round"), (F.col("node") % 6 > i).alias("failed"))

    return rp.retried(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")), step, F.col("failed"))


@register("language_coverage", """WITH l AS (SELECT n_nationkey AS language, n_nationkey % 6 <> 0 AS ok FROM nation), r AS (SELECT n_nationkey AS language, 'k' || k AS key, n_nationkey * 10 + k AS value FROM nation, range(5) t(k) WHERE n_nationkey % (k + 2) <> 1)
SELECT key, CAST(sum(value) AS BIGINT) AS total, (SELECT coalesce(string_agg(x.language, ',' ORDER BY x.language), '') FROM (SELECT CAST(language AS VARCHAR) AS language FROM l WHERE ok AND language NOT IN (SELECT q.language FROM r q WHERE q.key = r.key)) x) AS missing FROM r WHERE language IN (SELECT language FROM l WHERE ok) GROUP BY key""")
def language_coverage(spark, sf_dir):
    n = read(spark, sf_dir, "nation").selectExpr("string(n_nationkey) AS language", "n_nationkey")
    told = n.crossJoin(spark.range(5).withColumnRenamed("id", "k")).where("n_nationkey % (k + 2) <> 1").selectExpr("language", "concat('k', k) AS key", "n_nationkey * 10 + k AS value")
    return rp.language_coverage(told, n.selectExpr("language", "n_nationkey % 6 <> 0 AS ok"))


@register("units_with_callers", EDGES + """f AS (SELECT node AS start, node, 0 AS depth FROM seeds UNION SELECT f.start, e.dst, f.depth + 1 FROM f JOIN edges e ON e.src = f.node WHERE f.depth < 2), b AS (SELECT node AS start, node, 0 AS depth FROM seeds UNION SELECT b.start, e.src, b.depth + 1 FROM b JOIN edges e ON e.dst = b.node WHERE b.depth < 2),
 d AS (SELECT start, string_agg(node, ',' ORDER BY depth, node) AS deps FROM (SELECT start, node, min(depth) AS depth FROM f WHERE node <> start GROUP BY 1, 2) GROUP BY 1), u AS (SELECT start, string_agg(node, ',' ORDER BY depth, node) AS callers FROM (SELECT start, node, min(depth) AS depth FROM b WHERE node <> start GROUP BY 1, 2) GROUP BY 1)
SELECT node, deps, callers FROM seeds LEFT JOIN d ON d.start = node LEFT JOIN u ON u.start = node""")
def units_with_callers(spark, sf_dir):
    seeds = read(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("node"))
    out = rp.units_with_callers(seeds, edges(spark, sf_dir), 2)
    return out.select("node", F.array_join("deps", ",").alias("deps"), F.array_join("callers", ",").alias("callers"))


TEXT = "concat('See src/f', p_partkey % 7, '.py and lib/x.go or data.txt; call `run_', p_partkey % 5, '` with `a` or MyClass, snake_case_', 'name. src/f', p_partkey % 7, '.py')"


@register("prose_terms", """SELECT p_partkey, 'src/f' || p_partkey % 7 || '.py,lib/x.go' AS files, 'run_' || p_partkey % 5 AS terms, 'run_' || p_partkey % 5 || ',snake_case_name,MyClass' AS symbols FROM part""")
def prose_terms(spark, sf_dir):
    t = F.expr(TEXT)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(prose.file_paths(t), ",").alias("files"), F.array_join(prose.backtick_terms(t), ",").alias("terms"), F.array_join(prose.symbols(t), ",").alias("symbols"))


@register("review_bullets", """SELECT p_partkey, 'one ' || p_partkey % 9 || '|two' || CASE WHEN p_partkey % 9 = 4 THEN '' ELSE '|one 4' END AS bullets FROM part""")
def review_bullets(spark, sf_dir):
    text = F.expr("concat('Intro\n- one ', p_partkey % 9, '.\n * two \n- Summary: no\n\u2022  one   4\n-two\n- one 4')")
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(prose.bullets(text), "|").alias("bullets"))


@register("names_found", "SELECT p_partkey, p_name = 'small ring' AS exact, lower(p_name) LIKE '%ring%' AS part FROM part")
def names_found(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", prose.name_matches(F.col("p_name"), F.lit("small ring"), True).alias("exact"), prose.name_matches(F.col("p_name"), F.lit("RING")).alias("part"))


DIGEST = """sha256('t' || p_partkey % 3 || chr(0) || '')"""


@register("fingerprints", f"""SELECT p_partkey, 'sha256:' || sha256('{{"adapter_type":"api","config_base_url":null,"model":"m' || p_partkey % 4 || '","phase":"analyze","provider_name":"p","scheme_version":2,"templates_sha":"sha256:' || {DIGEST} || '"}}') AS fingerprint,
 CASE WHEN p_partkey % 11 = 0 THEN 'reset' WHEN p_partkey % 5 = 0 AND p_partkey % 2 = 0 THEN 'legacy' WHEN p_partkey % 5 = 0 THEN 'new' WHEN p_partkey % 3 = 0 THEN 'match' ELSE 'reset' END AS status FROM part""")
def fingerprints(spark, sf_dir):
    now = prose.fingerprint(F.lit("analyze"), F.expr("concat('m', p_partkey % 4)"), F.lit("p"), F.lit("api"), F.lit(None).cast("string"), F.expr("array(concat('t', p_partkey % 3), NULL)"))
    present = F.expr("p_partkey % 5 <> 0 OR p_partkey % 11 = 0")
    stored = F.when(F.expr("p_partkey % 3 = 0"), now).otherwise("sha256:old")
    return read(spark, sf_dir, "part").select("p_partkey", now.alias("fingerprint"), prose.identity_status(stored, present, F.expr("p_partkey % 11 <> 0"), F.expr("p_partkey % 2 = 0"), now).alias("status"))


CODE = """concat('// f0() {', chr(10), 'static int f', p_partkey, '(int a) {', chr(10), '  char *s = "h(";', chr(10), '  if (a) { f', p_partkey + 1, '(s); }', chr(10), '  return g(a); /* k() */', chr(10), '}', chr(10), 'int g(int a);', chr(10))"""


@register("c_units", "SELECT 'p' || p_partkey || '.c' AS path, 'f' || p_partkey AS name, CAST(2 AS INT) AS start, CAST(6 AS INT) AS \"end\", 'f' || p_partkey || ',f' || (p_partkey + 1) || ',g' AS calls FROM part")
def c_units(spark, sf_dir):
    files = read(spark, sf_dir, "part").select(F.expr("concat('p', p_partkey, '.c')").alias("path"), F.lit("c").alias("language"), F.expr(CODE).alias("code"))
    return bu.units(files).select("path", "name", "start", "end", F.array_join(code_text.called_names(F.col("code")), ",").alias("calls"))


@register("c_call_edges", "SELECT 'f' || p_partkey AS src, 'f' || (p_partkey + 1) AS dst FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)")
def c_call_edges(spark, sf_dir):
    files = read(spark, sf_dir, "part").select(F.expr("concat('p', p_partkey, '.c')").alias("path"), F.lit("c").alias("language"), F.expr(CODE).alias("code"))
    return bu.call_edges(g._checkpointed(bu.units(files).withColumn("id", F.col("name"))))
