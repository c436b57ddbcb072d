"""Queries over entry points, signals and checks; customers, parts and events stand in for their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import entries as en
from codeloom.plans.catalog import read, register

PATH = """CASE p_partkey % 8 WHEN 0 THEN 'build.rs' WHEN 1 THEN 'src/build.rs' WHEN 2 THEN 'examples/demo.py' WHEN 3 THEN 'a\\benches\\b.rs' WHEN 4 THEN 'crate/src/examples/x.rs' WHEN 5 THEN 'pkg/main.go' WHEN 6 THEN '' ELSE NULL END"""


@register("non_runtime_mains", "SELECT p_partkey, p_partkey % 8 IN (0, 2, 3) AS aux FROM part")
def non_runtime_mains(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", en.is_non_runtime_main(F.expr(PATH.replace("\\", "\\\\"))).alias("aux"))


ENTRY = """SELECT c_custkey AS node, CASE c_custkey % 4 WHEN 0 THEN 'route' WHEN 1 THEN 'main' WHEN 2 THEN 'handler' ELSE NULL END AS unit_type, c_custkey % 10 = 0 AS synthetic, c_custkey % 15 = 0 AS non_runtime_main,
 c_custkey % 3 = 0 AS typed, c_custkey % 2 = 0 AS input FROM customer WHERE c_mktsegment = 'MACHINERY'"""


def entry_rows(spark, sf_dir):
    e = read(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'")
    reasons = F.expr("array_compact(array(IF(c_custkey % 3 = 0, 'unit_type:route', NULL), IF(c_custkey % 2 = 0, 'input_pattern:argv:x', NULL)))")
    return e.select(F.col("c_custkey").alias("node"), F.expr("CASE c_custkey % 4 WHEN 0 THEN 'route' WHEN 1 THEN 'main' WHEN 2 THEN 'handler' END").alias("unit_type"), reasons.alias("reasons"),
                    F.expr("c_custkey % 10 = 0").alias("synthetic"), F.expr("c_custkey % 15 = 0").alias("non_runtime_main"))


@register("real_entries", f"WITH e AS ({ENTRY}) SELECT node FROM e WHERE NOT synthetic")
def real_entries(spark, sf_dir):
    e = entry_rows(spark, sf_dir)
    return en.real_entries(e.select("node"), e.select("node", "synthetic"))


@register("entry_statistics", f"""WITH e AS ({ENTRY}) SELECT 'unit_type' AS kind, coalesce(unit_type, 'unknown') AS key, CAST(count(*) AS DOUBLE) AS n FROM e GROUP BY 2
UNION ALL SELECT 'reason', 'unit_type', CAST(count(*) AS DOUBLE) FROM e WHERE typed UNION ALL SELECT 'reason', 'input_pattern', CAST(count(*) AS DOUBLE) FROM e WHERE input
UNION ALL SELECT 'total', 'total_entry_points', CAST(count(*) AS DOUBLE) FROM e UNION ALL SELECT 'total', 'total_functions', CAST(count(*) AS DOUBLE) FROM customer
UNION ALL SELECT 'total', 'entry_point_percentage', round((SELECT count(*) FROM e) / (SELECT count(*) FROM customer) * 100, 1)""")
def entry_statistics(spark, sf_dir):
    return en.entry_statistics(entry_rows(spark, sf_dir), read(spark, sf_dir, "customer"))


@register("seed_classes", f"WITH e AS ({ENTRY}) SELECT count(*) FILTER (NOT synthetic AND NOT non_runtime_main AND typed) AS structural, count(*) FILTER (NOT synthetic AND NOT non_runtime_main AND NOT typed) AS incidental, count(*) AS entries FROM e")
def seed_classes(spark, sf_dir):
    return en.seed_classes(entry_rows(spark, sf_dir))


@register("blackout_warnings", """WITH c AS (SELECT p_partkey, p_partkey % 5 * 10 AS original, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE p_partkey % 5 * 9 END AS kept, p_partkey % 2 AS structural, p_partkey % 4 AS entries, p_partkey % 7 % 2 AS extra, p_partkey % 11 = 0 AS lib FROM part)
SELECT p_partkey, CASE WHEN original <= 0 OR lib THEN NULL WHEN kept = 0 THEN 'total' WHEN structural = 0 THEN
 CASE WHEN entries = 0 AND extra > 0 THEN 'extra' WHEN entries = 0 THEN NULL WHEN extra > 0 THEN 'mixed' ELSE 'incidental' END || CASE WHEN 1 - kept / original >= 0.9 THEN ':core' ELSE ':partial' END END AS warning FROM c""")
def blackout_warnings(spark, sf_dir):
    c = read(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_partkey % 5 * 10 AS original", "CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE p_partkey % 5 * 9 END AS kept", "p_partkey % 2 AS structural", "p_partkey % 4 AS entries", "p_partkey % 7 % 2 AS extra", "p_partkey % 11 = 0 AS library_mode"
    )
    return en.blackout(c).select("p_partkey", "warning")


SIGNAL = """event_id, CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_id % 2000 END AS unit, CASE event_id % 5 WHEN 0 THEN 'entry_point' WHEN 1 THEN 'external_input' WHEN 2 THEN 'cross_process' WHEN 3 THEN 'entry_point' ELSE 'gossip' END AS kind,
 CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'sure' END AS confidence"""


def signal_rows(spark, sf_dir):
    s = read(spark, sf_dir, "events").select("event_id", F.expr("CASE WHEN event_id % 19 <> 0 THEN string(event_id % 2000) END").alias("unit_id"), F.expr("CASE event_id % 5 WHEN 0 THEN 'entry_point' WHEN 1 THEN 'external_input' WHEN 2 THEN 'cross_process' WHEN 3 THEN 'entry_point' ELSE 'gossip' END").alias("kind"))
    return s.withColumn("confidence", F.expr("CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'sure' END")).withColumn("reason", F.expr("concat(repeat('r', int(event_id % 600)), event_id)"))


def unit_rows(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("node"), F.expr("c_custkey % 9 = 0").alias("is_entry_point"))


PARSED = f"""WITH s AS (SELECT {SIGNAL} FROM events), p AS (SELECT *, CASE WHEN unit IS NULL THEN 'missing_id' WHEN kind = 'gossip' THEN 'bad_kind' WHEN confidence = 'sure' THEN 'bad_confidence' WHEN unit NOT IN (SELECT c_custkey FROM customer) THEN 'unknown_unit_id' ELSE 'kept' END AS outcome FROM s) """


@register("parsed_signals", PARSED + "SELECT CAST(unit AS VARCHAR) AS unit_id, outcome, count(*) AS n, CAST(sum(least(event_id % 600 + length(CAST(event_id AS VARCHAR)), 500)) AS BIGINT) AS reason_chars FROM p GROUP BY 1, 2")
def parsed_signals(spark, sf_dir):
    rows = en.parsed_signals(signal_rows(spark, sf_dir), unit_rows(spark, sf_dir))
    return rows.groupBy("unit_id", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("reason")).alias("reason_chars"))


@register("applied_signals", PARSED + """, k AS (SELECT *, kind = 'entry_point' AND confidence = 'high' AS sure FROM p WHERE outcome = 'kept'),
 a AS (SELECT unit, count(*) AS n, min(event_id) FILTER (sure) AS why FROM k GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS node, c_custkey % 9 = 0 OR why IS NOT NULL AS is_entry_point, CASE WHEN c_custkey % 9 <> 0 AND why IS NOT NULL THEN 'llm_reachability: ' || substr(repeat('r', CAST(why % 600 AS INT)) || why, 1, 500) END AS entry_point_reason, coalesce(n, 0) AS n_signals
FROM customer LEFT JOIN a ON a.unit = c_custkey""")
def applied_signals(spark, sf_dir):
    units = unit_rows(spark, sf_dir)
    raw = signal_rows(spark, sf_dir).where("event_id % 19 <> 0")
    known = en.parsed_signals(raw.withColumn("reason", F.concat_ws("|", "event_id", "reason")), units).where("outcome = 'kept'")
    ordinal = F.substring_index("reason", "|", 1).cast("long")
    signals = known.select("unit_id", "kind", "confidence", ordinal.alias("ordinal")).join(raw.select(F.col("event_id").alias("ordinal"), F.substring("reason", 1, 500).alias("reason")), "ordinal")
    return en.applied_signals(units, signals)


@register("entries_of_units", "SELECT DISTINCT o_custkey AS node FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey > 5)")
def entries_of_units(spark, sf_dir):
    return en.entries_of_units(read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("node")), read(spark, sf_dir, "customer").where("c_nationkey > 5").select(F.col("c_custkey").alias("node")))


@register("unit_errors", """SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 10 = 0 THEN 'missing id' END, CASE WHEN p_partkey % 6 = 0 THEN 'empty primary_code' END, CASE WHEN p_partkey % 8 = 0 THEN 'missing deps_inlined' END, CASE WHEN p_partkey % 9 = 0 THEN 'missing files_included' END,
 CASE WHEN p_partkey % 8 IN (1, 3) AND (p_partkey % 9 = 0 OR p_partkey % 3 = 0) THEN 'inlined without files' END, CASE WHEN p_partkey % 8 IN (1, 3) AND p_partkey % 9 <> 0 AND p_partkey % 3 = 2 AND p_partkey % 2 = 1 THEN 'several files without boundary' END) AS errors FROM part""")
def unit_errors(spark, sf_dir):
    p = read(spark, sf_dir, "part").selectExpr(
        "p_partkey", "IF(p_partkey % 10 = 0, '', string(p_partkey)) AS id", "IF(p_partkey % 6 = 0, NULL, 'code') AS primary_code", "IF(p_partkey % 8 = 0, NULL, p_partkey % 8 IN (1, 3)) AS deps_inlined",
        "IF(p_partkey % 9 = 0, NULL, slice(array('a', 'b', 'c'), 1, int(p_partkey % 3))) AS files_included",
    )
    return p.select("p_partkey", F.array_join(en.unit_errors(F.lit(False)), ",").alias("errors"))


@register("missing_fields", """SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN 'repository' END, 'application_type', 'pipeline_stats', 'results', CASE WHEN p_partkey % 3 = 0 THEN 'findings' END) AS missing FROM part""")
def missing_fields(spark, sf_dir):
    keys = F.expr("array_compact(array('analysis_date', IF(p_partkey % 2 <> 0, 'repository', NULL), IF(p_partkey % 3 <> 0, 'findings', NULL), 'extra'))")
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(en.missing_fields(keys, en.OUTPUT_FIELDS), ",").alias("missing"))


@register("threat_model_violations", """WITH s AS (SELECT 's' || s_suppkey AS name, CASE s_suppkey % 4 WHEN 0 THEN 'trusted' WHEN 1 THEN 'untrusted' WHEN 2 THEN 'maybe' ELSE NULL END AS trust, CASE WHEN s_suppkey % 5 <> 0 THEN 'n' || s_nationkey % 30 END AS component FROM supplier),
 p AS (SELECT 'c' || c_custkey AS name, CASE c_custkey % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'local' ELSE 'roof' END AS position, 's' || c_custkey AS source FROM customer)
SELECT 'bad_trust' AS violation, name, trust AS reference FROM s WHERE trust IS NULL OR trust = 'maybe' UNION ALL SELECT 'bad_position', name, position FROM p WHERE position = 'roof'
UNION ALL SELECT 'unknown_component', name, component FROM s WHERE component IS NOT NULL AND component NOT IN (SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey < 20) UNION ALL SELECT 'unknown_source', name, source FROM p WHERE source NOT IN (SELECT name FROM s)""")
def threat_model_violations(spark, sf_dir):
    components = read(spark, sf_dir, "nation").where("n_nationkey < 20").selectExpr("concat('n', n_nationkey) AS name")
    sources = read(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) AS name", "CASE s_suppkey % 4 WHEN 0 THEN 'trusted' WHEN 1 THEN 'untrusted' WHEN 2 THEN 'maybe' END AS trust", "IF(s_suppkey % 5 <> 0, concat('n', s_nationkey % 30), NULL) AS component")
    profiles = read(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS name", "CASE c_custkey % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'local' ELSE 'roof' END AS position", "concat('s', c_custkey) AS source")
    return en.threat_model_violations(components, sources, profiles)


@register("permissive_warnings", """SELECT p_partkey AS model, concat_ws(',', CASE WHEN p_partkey % 3 = 1 OR (p_partkey % 3 = 2 AND p_partkey % 4 = 0) THEN 'all_trusted' END, CASE WHEN p_partkey % 5 = 1 THEN 'local_only' END, CASE WHEN p_size > 3 * greatest(p_partkey % 7, 1) THEN 'mostly_excluded' END) AS warnings FROM part""")
def permissive_warnings(spark, sf_dir):
    m = read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS model", "slice(array('Trusted', IF(p_partkey % 4 = 0, 'trusted', 'untrusted')), 1, int(p_partkey % 3)) AS trusts", "CASE p_partkey % 5 WHEN 0 THEN array() WHEN 1 THEN array('local', 'physical') ELSE array('local', 'remote') END AS positions",
        "p_partkey % 7 AS n_criteria", "p_size AS n_excluded",
    )
    return en.permissive_warnings(m)


@register("untrusted_boundaries", """SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN 'http' END, CASE WHEN p_partkey % 3 = 0 THEN 'cli' END) AS untrusted, p_partkey % 4 <> 0 AND p_partkey % 2 <> 0 AND p_partkey % 3 <> 0 AS local_only FROM part""")
def untrusted_boundaries(spark, sf_dir):
    levels = F.expr("map('http', IF(p_partkey % 2 = 0, 'Untrusted input', 'trusted'), 'cli', IF(p_partkey % 3 = 0, 'untrusted', NULL))")
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(en.untrusted_boundaries(levels), ",").alias("untrusted"), en.suppresses_local_only(F.expr("p_partkey % 4 = 0"), levels).alias("local_only"))
