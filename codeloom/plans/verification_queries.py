"""Queries over verification, checkpoints, usage and steps; documents, orders and events stand in for their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import errors
from codeloom.operators import verification as ve
from codeloom.plans.catalog import read, register
from codeloom.plans.finding_queries import RES, results

ORIGIN = "CASE doc_id % 4 WHEN 0 THEN 'safe' WHEN 1 THEN 'inconclusive' WHEN 2 THEN 'Vulnerable' ELSE '' END"
NOW = "CASE doc_id % 23 WHEN 5 THEN 'Probably Fine' WHEN 6 THEN 'insufficient_context' WHEN 7 THEN 'protected' ELSE finding END"
VER = RES + f""", v AS (SELECT doc_id, doc_id % 17 = 0 AS error, doc_id % 19 = 0 AS incomplete, doc_id % 3 <> 0 AS agree, doc_id % 5 = 0 AS rewritten, lower(verdict) AS first,
 replace(lower(coalesce(nullif({NOW}, ''), verdict, '')), 'insufficient_context', 'inconclusive') AS now, lower({ORIGIN}) AS origin FROM res),
 k AS (SELECT *, list_position(['vulnerable','bypassable','inconclusive','protected','safe'], now) AS rank_now, list_position(['vulnerable','bypassable','inconclusive','protected','safe'], first) AS rank_first FROM v),
 b AS (SELECT *, CASE WHEN error THEN 'error' WHEN incomplete THEN 'review' WHEN rank_now IS NULL AND now <> '' THEN 'error' WHEN agree THEN 'agreed' ELSE 'disagreed' END AS arm FROM k)"""
OUTCOMES = VER + """, o AS (SELECT count(*) FILTER (arm = 'agreed') AS agreed,
 count(*) FILTER (arm = 'disagreed' AND now IN ('safe', '') AND origin <> 'safe') AS disagreed,
 count(*) FILTER (arm = 'disagreed' AND now = 'inconclusive' AND origin <> 'inconclusive') AS disagreed_inconclusive,
 count(*) FILTER (arm = 'disagreed' AND now = 'protected') AS disagreed_protected,
 count(*) FILTER (arm = 'agreed' AND rewritten AND now = 'protected') AS consistency_protected,
 count(*) FILTER (arm = 'agreed' AND rewritten AND now = 'safe') AS consistency_safe,
 count(*) FILTER (arm = 'agreed' AND rewritten AND now = 'inconclusive') AS consistency_inconclusive,
 count(*) FILTER (arm = 'review') AS needs_review,
 count(*) FILTER (arm IN ('agreed', 'disagreed') AND now IN ('vulnerable', 'bypassable')) AS confirmed_vulnerabilities,
 count(*) FILTER (arm = 'error') AS error_count,
 count(*) FILTER (arm IN ('agreed', 'disagreed') AND rank_now > rank_first) AS downgraded,
 count(*) FILTER (arm IN ('agreed', 'disagreed') AND rank_now < rank_first) AS upgraded,
 count(*) FILTER (origin = 'inconclusive' AND (error OR (NOT incomplete AND now <> 'inconclusive' AND now <> ''))) AS escalated_inconclusive_moved,
 count(*) FILTER (origin = 'safe' AND (error OR (NOT incomplete AND now <> 'safe' AND now <> ''))) AS escalated_safe_moved FROM b)"""


def verified(spark, sf_dir):
    r = results(spark, sf_dir)
    return r.select("doc_id", F.expr("doc_id % 17 = 0").alias("error"), F.expr("doc_id % 19 = 0").alias("incomplete"), F.expr("doc_id % 3 <> 0").alias("agree"), F.expr("doc_id % 5 = 0").alias("rewritten"),
                    F.expr(NOW).alias("finding"), "verdict", F.expr(ORIGIN).alias("stage1_finding"))


@register("verification_outcomes", OUTCOMES + " SELECT * FROM o")
def verification_outcomes(spark, sf_dir):
    return ve.verification_outcomes(verified(spark, sf_dir))


@register("post_verify_metrics", OUTCOMES + """, f AS (SELECT count(*) AS total, count(*) FILTER (first = 'inconclusive') AS i, count(*) FILTER (first = 'protected') AS p, count(*) FILTER (first = 'safe') AS s, count(*) FILTER (first = 'error') AS e FROM v)
SELECT total, confirmed_vulnerabilities AS vulnerable, CAST(0 AS BIGINT) AS bypassable, i + disagreed_inconclusive + consistency_inconclusive - escalated_inconclusive_moved AS inconclusive,
 p + disagreed_protected + consistency_protected AS protected, s + disagreed + consistency_safe - escalated_safe_moved AS safe, e + error_count AS errors, needs_review FROM f, o""")
def post_verify_metrics(spark, sf_dir):
    rows = verified(spark, sf_dir)
    n = lambda word: F.count_if(F.lower("verdict") == word)
    first = rows.agg(F.count(F.lit(1)).alias("total"), n("inconclusive").alias("inconclusive"), n("protected").alias("protected"), n("safe").alias("safe"), n("error").alias("errors"))
    return ve.post_verify_metrics(first, ve.verification_outcomes(rows))


@register("verified_recount", VER + "SELECT CASE WHEN error THEN 'errors' WHEN incomplete THEN 'needs_review' WHEN rank_now IS NULL THEN 'errors' ELSE now END AS bucket, count(*) AS n FROM k GROUP BY 1")
def verified_recount(spark, sf_dir):
    return ve.verified_recount(verified(spark, sf_dir))


AGENT = "CASE c_custkey % 6 WHEN 0 THEN 'exploitable' WHEN 1 THEN 'neutral' WHEN 2 THEN 'vulnerable_internal' WHEN 3 THEN 'security_control' ELSE NULL END"
SINGLE = "CASE WHEN c_custkey % 12 = 4 THEN 'exploitable' END"
CLASSED = f"WITH u AS (SELECT c_custkey AS node, coalesce({AGENT}, {SINGLE}) AS security_class FROM customer) "


def classed(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), ve.security_class(F.expr(AGENT), F.expr(SINGLE)).alias("security_class"))


@register("unit_classes", CLASSED + "SELECT node, security_class FROM u")
def unit_classes(spark, sf_dir):
    return classed(spark, sf_dir)


@register("exploitable_units", CLASSED + "SELECT node, security_class = 'exploitable' AS strict FROM u WHERE security_class IN ('exploitable', 'vulnerable_internal')")
def exploitable_units(spark, sf_dir):
    u = classed(spark, sf_dir)
    strict = ve.exploitable(u).select("node", F.lit(True).alias("hit"))
    return ve.exploitable(u, strict=False).join(strict, "node", "left").select("node", F.col("hit").isNotNull().alias("strict"))


@register("class_reduction", CLASSED + """SELECT security_class, count(*) AS n, (SELECT count(*) FROM u WHERE security_class = 'exploitable') AS kept,
 round((1 - (SELECT count(*) FROM u WHERE security_class = 'exploitable') / (SELECT count(*) FROM u)) * 100, 1) AS reduction_percentage FROM u GROUP BY 1""")
def class_reduction(spark, sf_dir):
    return ve.class_reduction(classed(spark, sf_dir))


@register("stage2_gate", RES + "SELECT count(*) FILTER (finding IN ('vulnerable', 'bypassable')) > 0 AS gate_open FROM res")
def stage2_gate(spark, sf_dir):
    return ve.gate_open(results(spark, sf_dir), F.col("finding").isin("vulnerable", "bypassable"))


RAW = """CASE event_id % 9 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'VULNERABLE' WHEN 2 THEN ' safe ' WHEN 3 THEN 'SAY WHAT' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN 'error' ELSE 'BYPASSABLE' END"""
RAW2 = """CASE event_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN NULL WHEN 2 THEN ' ' ELSE 'vulnerable' END"""


@register("retried_results", f"""WITH e AS (SELECT event_id, {RAW} AS verdict, {RAW2} AS finding FROM events)
SELECT event_id, coalesce(verdict = 'ERROR', false) OR coalesce(finding = 'error', false) OR (trim(coalesce(verdict, '')) = '' AND trim(coalesce(finding, '')) = '')
 OR (trim(coalesce(verdict, '')) <> '' AND upper(trim(verdict)) NOT IN ('VULNERABLE', 'SAFE', 'PROTECTED', 'BYPASSABLE', 'INCONCLUSIVE', 'INSUFFICIENT_CONTEXT', 'ERROR')) AS is_error FROM e""")
def retried_results(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", errors.stage1_is_error(F.expr(RAW), F.expr(RAW2)).alias("is_error"))


KIND = "CASE event_id % 8 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'api_status' WHEN 2 THEN 'parse_error' WHEN 3 THEN 'empty_completion' WHEN 4 THEN 'unknown' ELSE NULL END"
MESSAGE = """CASE event_id % 13 WHEN 0 THEN 'Error code: 529 - overloaded_error' WHEN 1 THEN 'read 15002 bytes' WHEN 2 THEN 'the model refused the request: timeout' WHEN 3 THEN 'Prompt is too long: 300000'
 WHEN 4 THEN 'can only afford 429. Error code: 402' WHEN 5 THEN 'no usable content' WHEN 6 THEN 'line 1 column 429' WHEN 7 THEN 'Request too large for model' WHEN 8 THEN 'the output budget was consumed'
 WHEN 9 THEN 'LLMRateLimitError: wait' WHEN 10 THEN 'HTTP 501 not implemented' WHEN 11 THEN NULL ELSE 'Too many requests' END"""
STATUS = "CASE event_id % 7 WHEN 0 THEN 500 WHEN 1 THEN 429 WHEN 2 THEN 402 WHEN 3 THEN 400 END"
LIMIT = "CASE WHEN event_id % 16 = 0 THEN 'quota' ELSE 'throttle' END"
ERRORS = f"WITH e AS (SELECT event_id, {KIND} AS kind, lower(coalesce({MESSAGE}, '')) AS m, {STATUS} AS status, {LIMIT} AS lim FROM events) "


def error_columns():
    return F.expr(KIND), F.expr(MESSAGE), F.expr(STATUS), F.expr(LIMIT)


@register("retryable_errors", ERRORS + """SELECT event_id, CASE WHEN kind IS NOT NULL THEN
   CASE WHEN kind = 'rate_limit' AND lim = 'quota' THEN false WHEN kind IN ('rate_limit', 'parse_error', 'empty_completion') THEN true
    WHEN kind = 'api_status' THEN (m NOT LIKE '%refused the request%' AND m LIKE '%no usable content%') OR coalesce(status, 0) >= 500 ELSE false END
  ELSE m NOT LIKE '%refused the request%' AND (regexp_matches(m, '\\b(500|502|503|504|520|522|523|524|529)\\b') OR regexp_matches(m, 'rate_limit|connection|timeout|overloaded|no usable content|empty completion')) END AS retryable,
  m LIKE '%output budget was consumed%' AS budget, CASE WHEN kind IS NULL THEN m LIKE '%rate_limit%' ELSE kind = 'rate_limit' END AS rate_limited FROM e""")
def retryable_errors(spark, sf_dir):
    kind, message, status, limit = error_columns()
    return read(spark, sf_dir, "events").select("event_id", errors.is_retryable(kind, message, status, limit).alias("retryable"), errors.is_budget_exhausted(message).alias("budget"), errors.is_rate_limited(kind, message).alias("rate_limited"))


@register("error_buckets", ERRORS + """SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN m LIKE '%prompt is too long%' THEN 'context_overflow' WHEN kind = 'parse_error' THEN 'api' WHEN kind = 'rate_limit' AND lim = 'quota' THEN 'quota' WHEN kind = 'rate_limit' THEN 'rate_limit'
 WHEN kind IS NOT NULL AND status = 402 THEN 'payment_required' WHEN kind IS NOT NULL AND status = 429 THEN 'rate_limit' WHEN m LIKE '%request too large%' THEN 'payload_too_large' WHEN m LIKE 'llmratelimiterror%' THEN 'rate_limit'
 WHEN m LIKE '%error code: 402%' THEN 'payment_required' WHEN m LIKE '%error code: 529%' THEN 'api' WHEN regexp_matches(m, '\\b429\\b') OR m LIKE '%too many requests%' THEN 'rate_limit' ELSE 'api' END AS bucket FROM e) GROUP BY 1""")
def error_buckets(spark, sf_dir):
    return ve.error_histogram(read(spark, sf_dir, "events"), errors.summary_bucket(*error_columns()))


@register("agentic_statistics", """WITH u AS (SELECT o_orderkey % 4 <> 0 AS has, CASE WHEN o_orderkey % 11 = 0 THEN 'timeout' WHEN o_orderkey % 13 = 0 THEN 'rate_limit' END AS err, o_orderkey % 3 AS n, o_orderkey % 10 = 0 AS failed, o_orderkey % 7 AS it,
 CASE o_orderkey % 6 WHEN 0 THEN 'exploitable' WHEN 1 THEN 'security_control' WHEN 2 THEN 'vulnerable_internal' WHEN 3 THEN 'incomplete' WHEN 4 THEN NULL ELSE 'neutral' END AS cls FROM orders), g AS (SELECT * FROM u WHERE has AND err IS NULL)
SELECT count(*) AS units_processed, count(*) FILTER (NOT failed AND n > 0) AS units_with_context, CAST(sum(it) AS BIGINT) AS total_iterations, CAST(sum(n) FILTER (NOT failed) AS BIGINT) AS functions_added,
 count(*) FILTER (cls = 'security_control') AS security_controls_found, count(*) FILTER (cls = 'exploitable') AS exploitable_found, count(*) FILTER (cls = 'vulnerable_internal') AS vulnerable_found,
 count(*) FILTER (cls = 'incomplete') AS incomplete_found, count(*) FILTER (coalesce(cls, 'neutral') = 'neutral') AS neutral_found, (SELECT count(*) FROM u WHERE has AND err IS NOT NULL) AS errors,
 (SELECT string_agg(err || ':' || n, ',' ORDER BY err) FROM (SELECT err, count(*) AS n FROM u WHERE has AND err IS NOT NULL GROUP BY err)) AS error_types FROM g""")
def agentic_statistics(spark, sf_dir):
    cls = F.expr("CASE o_orderkey % 6 WHEN 0 THEN 'exploitable' WHEN 1 THEN 'security_control' WHEN 2 THEN 'vulnerable_internal' WHEN 3 THEN 'incomplete' WHEN 4 THEN NULL ELSE 'neutral' END")
    units = read(spark, sf_dir, "orders").select(
        F.expr("o_orderkey % 4 <> 0").alias("has_context"), F.expr("CASE WHEN o_orderkey % 11 = 0 THEN 'timeout' WHEN o_orderkey % 13 = 0 THEN 'rate_limit' END").alias("error_type"), F.expr("slice(array('a', 'b'), 1, int(o_orderkey % 3))").alias("include_functions"),
        F.expr("o_orderkey % 10 = 0").alias("assembly_failed"), cls.alias("security_class"), F.expr("o_orderkey % 7").alias("iterations"),
    )
    return ve.agentic_statistics(units).withColumn("error_types", F.array_join(F.transform(F.map_entries("error_types"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","))


@register("cache_usage", """SELECT event_id, CAST(greatest(event_id % 50 - 5, 0) + event_id % 7 AS BIGINT) AS cache_read, CAST(event_id % 11 AS BIGINT) AS cache_read_inclusive, CAST(event_id % 3 AS BIGINT) AS cache_write, CAST(greatest(2 - event_id % 5, 0) AS BIGINT) AS cache_write_inclusive FROM events""")
def cache_usage(spark, sf_dir):
    turns = F.expr("array(map('cache_read_input_tokens', event_id % 50 - 5, 'cached_tokens', event_id % 11), cast(null as map<string, bigint>), map('cache_read_input_tokens', event_id % 7, 'cache_creation_input_tokens', event_id % 3, 'cache_write_tokens', 2 - event_id % 5))")
    return read(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in ve.cache_counts(turns).items()))


@register("usage_totals", """SELECT count(*) AS calls, CAST(sum(l_linenumber * 100) AS BIGINT) AS input_tokens, CAST(sum(l_linenumber * 10) AS BIGINT) AS output_tokens, CAST(sum(l_linenumber * 110) AS BIGINT) AS total_tokens,
 round(coalesce(sum(CASE WHEN l_suppkey % 5 <> 0 THEN l_linenumber * 0.25 END), 0), 6)::DOUBLE AS cost, coalesce((SELECT string_agg(DISTINCT 'm' || l_suppkey % 10, ',' ORDER BY 'm' || l_suppkey % 10) FROM lineitem WHERE l_suppkey % 5 = 0), '') AS unpriced_models FROM lineitem""")
def usage_totals(spark, sf_dir):
    calls = read(spark, sf_dir, "lineitem").select(
        F.expr("concat('m', l_suppkey % 10)").alias("model"), F.expr("bigint(l_linenumber * 100)").alias("input_tokens"), F.expr("bigint(l_linenumber * 10)").alias("output_tokens"), F.expr("CASE WHEN l_suppkey % 5 <> 0 THEN l_linenumber * 0.25D END").alias("cost")
    )
    return ve.usage_totals(calls)


@register("merged_usage", """SELECT o_custkey AS name, CAST(sum(o_orderkey % 100) AS BIGINT) AS input_tokens, CAST(sum(o_orderkey % 10) AS BIGINT) AS output_tokens, round(sum(o_totalprice), 6) AS cost,
 string_agg('d' || o_orderkey || ',e', ',' ORDER BY o_orderkey) AS details FROM orders GROUP BY 1""")
def merged_usage(spark, sf_dir):
    parts = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("part"), F.expr("o_orderkey % 100").alias("input_tokens"), F.expr("o_orderkey % 10").alias("output_tokens"), F.col("o_totalprice").alias("cost"), F.expr("array(concat('d', o_orderkey), 'e')").alias("details")
    )
    return ve.merged_usage(parts)


@register("step_deltas", """WITH s AS (SELECT o_custkey AS run, o_orderkey AS step, sum(o_orderkey % 50) OVER w AS tokens, sum(o_orderkey % 8 * 0.5) OVER w AS cost FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT run, step, CAST(tokens - coalesce(lag(tokens) OVER w, 0) AS BIGINT) AS tokens, round(cost - coalesce(lag(cost) OVER w, 0), 6)::DOUBLE AS cost,
 CASE WHEN step % 9 = 0 THEN 'error' WHEN step % 14 = 0 THEN 'interrupted' WHEN step % 5 = 0 OR step % 6 = 0 THEN 'partial' ELSE 'success' END AS status FROM s WINDOW w AS (PARTITION BY run ORDER BY step)""")
def step_deltas(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    s = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("step"), F.sum(F.expr("o_orderkey % 50")).over(w).alias("tokens"), F.sum(F.expr("o_orderkey % 8 * 0.5D")).over(w).alias("cost"),
        F.expr("o_orderkey % 9 = 0").alias("failed"), F.expr("o_orderkey % 14 = 0").alias("interrupted"), F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE -1 END").alias("error_count"), F.expr("CASE WHEN o_orderkey % 6 = 0 THEN 2 END").alias("incomplete_count"),
    )
    return ve.step_deltas(s)


CP = """CASE o_orderkey % 12 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'missing_id' WHEN 2 THEN 'rate_limit' WHEN 3 THEN 'analysis_error' WHEN 4 THEN 'verification_error' WHEN 5 THEN 'build' WHEN 6 THEN 'error_key' END"""


@register("checkpoint_summary", f"""WITH c AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'analyze' WHEN 1 THEN 'verify' ELSE 'enhance' END AS step, {CP} AS error_type, o_orderkey % 12 IN (7, 8) AS waiting FROM orders)
SELECT step, count(*) FILTER (error_type IS NULL AND NOT waiting) AS completed, count(*) FILTER (error_type IS NULL AND waiting) AS incomplete, count(error_type) AS errors, count(*) AS total FROM c GROUP BY 1""")
def checkpoint_summary(spark, sf_dir):
    return ve.checkpoint_summary(checkpoints(spark, sf_dir))


def checkpoints(spark, sf_dir):
    at = lambda sql: F.expr(sql.replace("@", "o_orderkey % 12"))
    return read(spark, sf_dir, "orders").select(
        at("CASE o_orderkey % 3 WHEN 0 THEN 'analyze' WHEN 1 THEN 'verify' ELSE 'enhance' END").alias("step"), at("CASE WHEN @ <> 1 THEN string(o_orderkey) END").alias("id"), at("@ <> 0").alias("readable"),
        at("CASE WHEN @ = 2 THEN 'rate_limit' END").alias("context_error"), at("@ IN (3, 9)").alias("has_result"), at("CASE WHEN @ = 9 THEN 'SAFE' WHEN @ = 3 THEN 'ERROR' END").alias("verdict"), F.lit(None).cast("string").alias("finding"),
        at("@ IN (4, 7, 10)").alias("has_verification"), F.lit(False).alias("verification_empty"), at("CASE WHEN @ = 4 THEN 'error' WHEN @ = 10 THEN 'safe' END").alias("correct_finding"), at("@ IN (4, 7)").alias("incomplete"),
        at("CASE WHEN @ = 5 THEN 'ERROR' ELSE 'CONFIRMED' END").alias("status"), F.lit("Docker build failed: no space").alias("details"), at("@ IN (4, 6)").alias("error"), at("CASE WHEN @ = 8 THEN 'incomplete' END").alias("security_class"),
    )


@register("checkpoint_errors", f"SELECT {CP} AS error_type, count(*) AS n FROM orders WHERE o_orderkey % 12 < 7 GROUP BY 1")
def checkpoint_errors(spark, sf_dir):
    return ve.checkpoint_state(checkpoints(spark, sf_dir)).where("error_type IS NOT NULL").groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


DETAILS = "CASE o_orderkey % 6 WHEN 0 THEN 'Test generation failed' WHEN 1 THEN ' Docker build failed' WHEN 2 THEN 'Container execution timed out after 60s' WHEN 3 THEN 'Container did not produce valid JSON output' WHEN 4 THEN NULL ELSE 'odd' END"


@register("dynamic_test_counts", f"""WITH c AS (SELECT o_orderkey % 4 = 0 AS failed, {DETAILS} AS d, CASE o_orderkey % 6 WHEN 0 THEN 'generation' WHEN 1 THEN 'build' WHEN 2 THEN 'timeout' WHEN 3 THEN 'execution' ELSE 'other' END AS cat FROM orders)
SELECT CASE WHEN failed THEN 'errors' ELSE 'completed' END AS bucket, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'error:' || cat, count(*) FROM c WHERE failed OR cat = 'timeout' GROUP BY 1""")
def dynamic_test_counts(spark, sf_dir):
    return ve.dynamic_test_counts(read(spark, sf_dir, "orders").select(F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'ERROR' ELSE 'CONFIRMED' END").alias("status"), F.expr(DETAILS).alias("details")))


@register("dropped_block_kinds", "SELECT key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'kind' || p_partkey % 5 AS key, p_size AS n FROM part UNION ALL SELECT 'image', p_partkey % 3 FROM part) GROUP BY 1")
def dropped_block_kinds(spark, sf_dir):
    return ve.summed_maps(read(spark, sf_dir, "part").select(F.expr("map(concat('kind', p_partkey % 5), bigint(p_size), 'image', p_partkey % 3)").alias("kinds")), "kinds")


@register("promotable_skips", "SELECT p_partkey, CAST(p_size + CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 0 END AS BIGINT) AS n FROM part")
def promotable_skips(spark, sf_dir):
    skips = F.expr("map('entry_point/high', bigint(p_size), IF(p_partkey % 2 = 0, 'entry_point/medium', 'external_input/high'), 4L, 'odd', 9L)")
    return read(spark, sf_dir, "part").select("p_partkey", ve.promotable_skips(skips, ("high", "medium")).alias("n"))


@register("reachability_totals", """WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey END AS orphan, s_suppkey % 7 AS dead, CASE WHEN s_suppkey % 9 = 0 THEN 'many orphans' ELSE '' END AS advisory FROM supplier),
 f AS (SELECT key, sum(n) AS n FROM (SELECT 'f' || s_suppkey % 40 AS key, s_suppkey AS n FROM r UNION ALL SELECT 'g' || s_suppkey % 3, 1 FROM r) GROUP BY 1 ORDER BY n DESC, key LIMIT 20)
SELECT 'count' AS kind, 'pruned_orphan_count' AS key, CAST(sum(orphan) AS BIGINT) AS n FROM r UNION ALL SELECT 'count', 'pruned_in_dead_cluster_count', CAST(sum(dead) AS BIGINT) FROM r UNION ALL SELECT 'count', 'reachability_baseline_languages', count(orphan) FROM r
UNION ALL SELECT 'file', key, CAST(n AS BIGINT) FROM f UNION ALL SELECT 'advisory', 'l' || s_suppkey || ': ' || advisory, NULL FROM r WHERE advisory <> ''""")
def reachability_totals(spark, sf_dir):
    r = read(spark, sf_dir, "supplier").select(
        F.expr("concat('l', s_suppkey)").alias("language"), F.expr("CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey END").alias("orphan"), F.expr("s_suppkey % 7").alias("dead"),
        F.expr("map(concat('f', s_suppkey % 40), s_suppkey, concat('g', s_suppkey % 3), 1L)").alias("by_file"), F.expr("CASE WHEN s_suppkey % 9 = 0 THEN 'many orphans' ELSE '' END").alias("advisory"),
    )
    return ve.reachability_totals(r)


@register("smoke_score", """WITH f AS (SELECT o_custkey AS unit_id, count(*) AS times FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), w AS (SELECT DISTINCT o_custkey AS unit_id FROM orders WHERE o_orderstatus = 'O')
SELECT coalesce(f.unit_id, w.unit_id) AS unit_id, CASE WHEN f.times IS NOT NULL AND c.c_custkey IS NULL THEN 'unknown' WHEN f.times > 1 THEN 'duplicate' WHEN f.times IS NULL THEN 'missed' WHEN w.unit_id IS NULL THEN 'unexpected' ELSE 'hit' END AS outcome
FROM f FULL JOIN w ON f.unit_id = w.unit_id LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 3) c ON c.c_custkey = coalesce(f.unit_id, w.unit_id)""")
def smoke_score(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit_id"), "o_orderstatus")
    units = read(spark, sf_dir, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("unit_id"))
    return ve.smoke_score(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), units)


@register("index_statistics", "SELECT count(*) AS total_functions, count(DISTINCT p_name) AS unique_names, (SELECT count(DISTINCT p_brand) FROM part) AS total_files, (SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)) AS most_in_a_file FROM part")
def index_statistics(spark, sf_dir):
    return ve.index_statistics(read(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("name")))


@register("stale_checkpoints", f"SELECT c_custkey AS node, CASE c_custkey % 4 WHEN 0 THEN 'incomplete' WHEN 1 THEN 'unknown' ELSE 'neutral' END IN ('incomplete', 'error', 'unknown') AND {AGENT} IS NOT NULL AS stale FROM customer")
def stale_checkpoints(spark, sf_dir):
    stored = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'incomplete' WHEN 1 THEN 'unknown' ELSE 'neutral' END")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), ve.is_stale_checkpoint(stored, F.expr(AGENT)).alias("stale"))
