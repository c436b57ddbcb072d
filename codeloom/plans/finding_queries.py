"""Queries over findings: the labels of documents stand in for stage-one results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import taxonomy as tx
from codeloom.functions import text as fx
from codeloom.operators import accounting as ac
from codeloom.operators import prefix
from codeloom.plans.catalog import VERDICT_SQL, read, register

RES = f"""WITH res AS (SELECT doc_id, source || ':' || doc_id AS unit_id, source AS file, lang, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'insufficient_context' ELSE {VERDICT_SQL} END AS finding,
 upper({VERDICT_SQL}) AS verdict, toxic, quality, CAST(doc_id % 5 AS INT) AS cwe, n_chars FROM documents LEFT JOIN labels USING (doc_id)) """


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    verdict = F.expr(VERDICT_SQL)
    finding = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 11 == 0, "insufficient_context").otherwise(verdict)
    return d.select(
        "doc_id", F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("unit_id"), F.col("source").alias("file"), "lang",
        finding.alias("finding"), F.upper(verdict).alias("verdict"), "toxic", "quality", (F.col("doc_id") % 5).cast("int").alias("cwe"), "n_chars",
    )


BUCKET_SQL = """CASE WHEN lower(coalesce(finding, verdict)) = 'insufficient_context' THEN 'inconclusive'
 WHEN lower(coalesce(finding, verdict)) IN ('vulnerable','bypassable','inconclusive','protected','safe') THEN lower(coalesce(finding, verdict)) ELSE 'error' END"""


@register("count_verdicts", RES + f"SELECT {BUCKET_SQL} AS bucket, count(*) AS n FROM res GROUP BY 1")
def count_verdicts(spark, sf_dir):
    return results(spark, sf_dir).groupBy(tx.counted_bucket(F.col("finding"), F.col("verdict")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@register("chart_series", RES + f"""SELECT b AS bucket, count(*) AS n, CASE b WHEN 'vulnerable' THEN 0 WHEN 'bypassable' THEN 1 WHEN 'inconclusive' THEN 2 WHEN 'protected' THEN 3 ELSE 4 END AS place
 FROM (SELECT {BUCKET_SQL} AS b FROM res) WHERE b <> 'error' GROUP BY b""")
def chart_series(spark, sf_dir):
    rows = count_verdicts(spark, sf_dir)
    return rows.withColumn("place", tx.rank(F.col("bucket"))).where("place IS NOT NULL")


@register("taxonomy_memberships", """SELECT * FROM (VALUES ('agreed', true, true, true), ('bypassable', true, false, true), ('confirmed', true, true, true), ('error', true, false, false),
 ('inconclusive', false, false, false), ('protected', false, false, false), ('rejected', false, false, false), ('safe', false, false, false), ('unverified', true, false, false), ('vulnerable', true, true, true))
 t(name, disclosure, dynamic, patch)""")
def taxonomy_memberships(spark, sf_dir):
    names = sorted({*tx.STAGE2, *tx.FINDING_ORDER, tx.ERROR})
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    return rows.select("name", F.col("name").isin(*tx.DISCLOSURE_ELIGIBLE).alias("disclosure"), F.col("name").isin(*tx.DYNAMIC_TESTABLE).alias("dynamic"), F.col("name").isin(*tx.PATCH_ELIGIBLE).alias("patch"))


SEV_SQL = RES + """, s AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 AND lower(coalesce(finding, verdict)) IN ('vulnerable','bypassable') THEN 'inconclusive' ELSE lower(coalesce(finding, verdict)) END AS display,
 CASE doc_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' ELSE 'odd' END AS stored, CASE WHEN doc_id % 2 = 0 THEN 'model' ELSE 'derived' END AS src FROM res)
SELECT doc_id, display, CASE WHEN display NOT IN ('vulnerable','bypassable') THEN '' WHEN stored <> 'odd' AND src = 'model' THEN stored WHEN display = 'vulnerable' THEN 'high' ELSE 'medium' END AS severity FROM s"""


@register("finding_severity", SEV_SQL)
def finding_severity(spark, sf_dir):
    r = results(spark, sf_dir)
    reason = F.when(F.col("doc_id") % 13 == 0, "Max iterations reached").otherwise("")
    display = tx.display_verdict(F.col("finding"), F.col("verdict"), F.lit(None).cast("string"), reason)
    stored = F.when(F.col("doc_id") % 3 == 0, "critical").when(F.col("doc_id") % 3 == 1, "low").otherwise("odd")
    source = F.when(F.col("doc_id") % 2 == 0, "model").otherwise("derived")
    return r.select("doc_id", display.alias("display"), tx.severity(display, stored, source).alias("severity"))


@register("clamped_confidence", """SELECT event_id, CASE WHEN r IN ('NaN', 'Infinity', 'high', 'true') THEN NULL ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, TRY_CAST(r AS DOUBLE))) END AS confidence FROM
 (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN 'high' WHEN 3 THEN '1.5' WHEN 4 THEN '-0.3' WHEN 5 THEN '0.75' WHEN 6 THEN 'true' ELSE '0.5' END AS r FROM events)""")
def clamped_confidence(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ("NaN", "Infinity", "high", "1.5", "-0.3", "0.75", "true", "0.5"))), (F.col("event_id") % 8 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", tx.confidence(raw).alias("confidence"))


@register("stage2_candidates", RES + """SELECT doc_id FROM res WHERE finding IN ('vulnerable','bypassable') OR (finding = 'safe' AND doc_id % 4 = 0) OR (finding = 'inconclusive' AND (cwe <> 0 OR doc_id % 3 = 0))""")
def stage2_candidates(spark, sf_dir):
    r = results(spark, sf_dir)
    cls = F.when(F.col("doc_id") % 4 == 0, "exploitable").otherwise("neutral")
    vector = F.when(F.col("doc_id") % 3 == 0, "form field").otherwise("  ")
    return r.where(tx.is_stage2_candidate(F.col("finding"), cls, F.col("cwe"), vector)).select("doc_id")


@register("coerced_cwe", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 79 WHEN 1 THEN 918 WHEN 2 THEN 918 WHEN 3 THEN 0 ELSE 0 END AS cwe FROM orders""")
def coerced_cwe(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, (" cwe-79", "918", "918.0", "true", "text"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", fx.coerce_cwe(raw).alias("cwe"))


@register("csv_findings", RES + """SELECT unit_id, CASE WHEN doc_id % 6 < 4 THEN chr(39) || p ELSE p END AS cell FROM (SELECT *, list_extract(['=','+','-','@','a',' '], (doc_id % 6 + 1)::INT) || file AS p FROM res)""")
def csv_findings(spark, sf_dir):
    cell = F.concat(F.element_at(F.array(*map(F.lit, "=+-@a ")), (F.col("doc_id") % 6 + 1).cast("int")), F.col("file"))
    return results(spark, sf_dir).select("unit_id", fx.csv_safe(cell).alias("cell"))


@register("identity_keys", RES + """, k AS (SELECT doc_id, left(sha256(file || '|' || lang || '|' || cwe), 12) AS key FROM res), d AS (SELECT DISTINCT key FROM k),
 n AS (SELECT key, count(*) OVER (PARTITION BY left(key, 6)) a, count(*) OVER (PARTITION BY left(key, 8)) b, count(*) OVER (PARTITION BY left(key, 10)) c FROM d)
SELECT doc_id, key AS identity_key, CASE WHEN a = 1 THEN left(key, 6) WHEN b = 1 THEN left(key, 8) WHEN c = 1 THEN left(key, 10) ELSE key END AS display,
 row_number() OVER (PARTITION BY key ORDER BY doc_id) AS copy FROM k JOIN n USING (key)""")
def identity_keys(spark, sf_dir):
    k = results(spark, sf_dir).select("doc_id", fx.identity_key(F.col("file"), F.col("lang"), F.col("cwe")).alias("key"))
    copy = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    return k.join(ac.display_ids(k), "key").select("doc_id", F.col("key").alias("identity_key"), "display", copy.alias("copy"))


@register("inconsistent_patterns", RES + """, p AS (SELECT regexp_replace(n, '^(build_|get_|create_|make_|init_|setup_|default_|cached_|new_)+', '') AS pattern, """ + BUCKET_SQL + """ AS b FROM
 (SELECT *, (CASE doc_id % 3 WHEN 0 THEN 'get_' WHEN 1 THEN 'build_new_' ELSE '' END) || file || '_' || (doc_id % 9) AS n FROM res))
SELECT pattern, count(*) AS n, count(DISTINCT b) AS n_verdicts FROM p GROUP BY pattern HAVING count(*) >= 2 AND count(DISTINCT b) > 1""")
def inconsistent_patterns(spark, sf_dir):
    prefix = F.when(F.col("doc_id") % 3 == 0, "get_").when(F.col("doc_id") % 3 == 1, "build_new_").otherwise("")
    name = F.concat(prefix, "file", F.lit("_"), (F.col("doc_id") % 9).cast("string"))
    r = results(spark, sf_dir).select(fx.signature_pattern(name).alias("pattern"), tx.counted_bucket(F.col("finding"), F.col("verdict")).alias("b"))
    return r.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("b").alias("n_verdicts")).where("n >= 2 AND n_verdicts > 1")


@register("unit_files", """SELECT o_orderkey, 'src/a' || o_custkey || ':b' || (o_orderkey % 3) AS last_colon, 'src/a' || o_custkey AS first_colon FROM orders""")
def unit_files(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    unit = F.expr("concat('src/a', o_custkey, ':b', o_orderkey % 3, ':f')")
    return o.select("o_orderkey", fx.file_last_colon(unit).alias("last_colon"), fx.file_first_colon(unit).alias("first_colon"))


@register("confusion_metrics", """WITH c AS (SELECT count(*) FILTER (toxic = 1 AND p) tp, count(*) FILTER (toxic = 0 AND p) fp, count(*) FILTER (toxic = 1 AND NOT p) fn, count(*) FILTER (toxic = 0 AND NOT p) tn
 FROM (SELECT toxic, regexp_matches(text, 'idiot|moron|scum|trash|clown') AS p FROM documents JOIN labels USING (doc_id)))
SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def confusion_metrics(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "text").join(read(spark, sf_dir, "labels"), "doc_id")
    return ac.confusion(rows, F.col("toxic") == 1, F.col("text").rlike("idiot|moron|scum|trash|clown"))


@register("numbered_findings", RES + f"""SELECT doc_id, row_number() OVER (ORDER BY CASE {BUCKET_SQL} WHEN 'vulnerable' THEN 0 WHEN 'bypassable' THEN 1 WHEN 'inconclusive' THEN 2 WHEN 'protected' THEN 3 WHEN 'safe' THEN 4 ELSE 9 END, doc_id) AS position FROM res""")
def numbered_findings(spark, sf_dir):
    place = F.coalesce(tx.rank(tx.counted_bucket(F.col("finding"), F.col("verdict"))), F.lit(9))
    return prefix.numbered(results(spark, sf_dir).select("doc_id", place.alias("place")), "position", F.col("place"), F.col("doc_id")).select("doc_id", "position")


@register("limited_units", RES + """SELECT doc_id FROM res ORDER BY CASE finding WHEN 'vulnerable' THEN 2 WHEN 'bypassable' THEN 1 ELSE 0 END DESC, doc_id LIMIT 25""")
def limited_units(spark, sf_dir):
    place = F.when(F.col("finding") == "vulnerable", 2).when(F.col("finding") == "bypassable", 1).otherwise(0)
    return results(spark, sf_dir).orderBy(place.desc(), "doc_id").limit(25).select("doc_id")


@register("top_files", RES + """SELECT file, count(*) AS n FROM res WHERE finding IS NULL GROUP BY file ORDER BY n DESC, file LIMIT 20""")
def top_files(spark, sf_dir):
    return results(spark, sf_dir).where("finding IS NULL").groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file").limit(20)


@register("budget_fit", RES + """SELECT doc_id, file, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(n_chars) OVER (PARTITION BY file ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM res) WHERE used <= 50000""")
def budget_fit(spark, sf_dir):
    return ac.budget_prefix(results(spark, sf_dir), ["file"], "n_chars", 50_000, F.col("doc_id")).select("doc_id", "file", "used")


@register("detected_languages", """SELECT lang AS language, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, lang) = 1 OR count(*) >= greatest(5, ceil(0.02 * sum(count(*)) OVER ()))) AS selected FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def detected_languages(spark, sf_dir):
    return ac.language_selection(read(spark, sf_dir, "documents").select(F.col("lang").alias("language")))


@register("markdown_summary", RES + f""", c AS (SELECT {BUCKET_SQL} AS b, count(*) AS n FROM res GROUP BY 1)
SELECT '| verdict | count |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || b || ' | ' || n || ' |', chr(10) ORDER BY b) AS markdown FROM c""")
def markdown_summary(spark, sf_dir):
    c = count_verdicts(spark, sf_dir)
    line = F.concat(F.lit("| "), "bucket", F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    body = F.array_join(F.sort_array(F.collect_list(line)), "\n")
    return c.agg(F.concat(F.lit("| verdict | count |\n|---|---|\n"), body).alias("markdown"))


@register("sarif_rules", RES + f"""SELECT b AS rule_id, max(CASE b WHEN 'vulnerable' THEN 3 WHEN 'bypassable' THEN 2 ELSE 0 END) AS max_rank, min(doc_id) AS first_seen, count(*) AS n FROM (SELECT *, {BUCKET_SQL} AS b FROM res) GROUP BY b""")
def sarif_rules(spark, sf_dir):
    r = results(spark, sf_dir).withColumn("rule_id", tx.counted_bucket(F.col("finding"), F.col("verdict")))
    level = F.when(F.col("rule_id") == "vulnerable", 3).when(F.col("rule_id") == "bypassable", 2).otherwise(0)
    return r.groupBy("rule_id").agg(F.max(level).alias("max_rank"), F.min("doc_id").alias("first_seen"), F.count(F.lit(1)).alias("n"))


@register("resume_delta", """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'errored' ELSE 'completed' END AS kind FROM orders o WHERE o_orderkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM orders c WHERE c.o_orderkey % 2 = 0 AND c.o_orderkey = o.o_orderkey)) GROUP BY kind""")
def resume_delta(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    gone = o.where("o_orderkey % 3 <> 0").join(o.where("o_orderkey % 2 = 0").select("o_orderkey"), "o_orderkey", "left_anti")
    return gone.groupBy(F.when(F.col("o_orderstatus") == "F", "errored").otherwise("completed").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("adopted_checkpoints", """SELECT u.o_orderkey, CASE WHEN c.o_orderkey IS NOT NULL AND c.o_orderstatus <> 'F' THEN 'adopted' ELSE 'recompute' END AS action FROM orders u LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) c USING (o_orderkey)""")
def adopted_checkpoints(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    cp = o.where("o_orderkey % 2 = 0").withColumnRenamed("o_orderstatus", "status")
    return o.join(cp, "o_orderkey", "left").select("o_orderkey", F.when(F.col("status").isNotNull() & (F.col("status") != "F"), "adopted").otherwise("recompute").alias("action"))


@register("merged_dynamic_results", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), l AS (SELECT user_id, event_type, event_id % 4 AS guard FROM t WHERE n = 1)
SELECT c_custkey AS id, CASE WHEN l.guard = c.c_custkey % 4 THEN l.event_type END AS attempted FROM customer c LEFT JOIN l ON l.user_id = c.c_custkey""")
def merged_dynamic_results(spark, sf_dir):
    tests = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", F.col("event_id").alias("ord"), F.col("event_type").alias("status"), (F.col("event_id") % 4).alias("guard"))
    found = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).alias("guard"))
    return ac.merge_last_result(found, tests, "guard").select("id", F.col("dynamic_testing_attempted").alias("attempted"))


@register("usage_cost", """SELECT p_brand AS model, round(sum(l_quantity / 1e6 * p_retailprice), 6) AS cost, count(*) AS calls, bool_or(p_brand = 'Brand#11') AS unpriced FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def usage_cost(spark, sf_dir):
    u = read(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return u.groupBy(F.col("p_brand").alias("model")).agg(F.round(F.sum(F.col("l_quantity") / 1e6 * F.col("p_retailprice")), 6).alias("cost"), F.count(F.lit(1)).alias("calls"), F.bool_or(F.col("p_brand") == "Brand#11").alias("unpriced"))


HUNK_SQL = "WITH u AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_returnflag AS file, CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_linenumber END AS s, CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_linenumber + 2 END AS e FROM lineitem), h(file, a, b) AS (VALUES ('A', 2, 3), ('N', 6, 9)) "


def _units(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    known = F.col("l_orderkey") % 17 != 0
    u = li.select(F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("id"), F.col("l_returnflag").alias("file"), F.when(known, F.col("l_linenumber")).alias("start"), F.when(known, F.col("l_linenumber") + 2).alias("end"))
    return u, spark.createDataFrame([("A", 2, 3), ("N", 6, 9)], "file string, a int, b int")


@register("diff_overlap", HUNK_SQL + "SELECT id FROM u WHERE EXISTS (SELECT 1 FROM h WHERE h.file = u.file AND s <= b AND e >= a)")
def diff_overlap(spark, sf_dir):
    return ac.overlapping(*_units(spark, sf_dir)).select("id")


@register("finding_containment", HUNK_SQL + "SELECT id FROM u WHERE EXISTS (SELECT 1 FROM h WHERE h.file = u.file AND (a BETWEEN s AND e OR b BETWEEN s AND e))")
def finding_containment(spark, sf_dir):
    return ac.containing_an_end(*_units(spark, sf_dir)).select("id")


@register("diff_selected", HUNK_SQL + "SELECT id, coalesce(file IN ('A', 'N') AND (s IS NULL OR EXISTS (SELECT 1 FROM h WHERE h.file = u.file AND s <= b AND e >= a)), false) AS diff_selected FROM u")
def diff_selected(spark, sf_dir):
    u, h = _units(spark, sf_dir)
    return ac.diff_selected(u, h, h).select("id", "diff_selected")


@register("backoff_intervals", """WITH e AS (SELECT event_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 60 + event_id % 120 AS e FROM events WHERE event_type = 'error' OR event_id % 9 = 0),
 m AS (SELECT *, CASE WHEN s <= max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM e), r AS (SELECT *, sum(n) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT min(s) AS start, max(e) AS "end", count(*) AS n FROM r GROUP BY g""")
def backoff_intervals(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("event_type = 'error' OR event_id % 9 = 0")
    s = F.unix_timestamp("ts")
    return prefix.merged_intervals(e.select(s.alias("start"), (s + 60 + F.col("event_id") % 120).alias("end")))


@register("log_cap", """SELECT event_id, n - 1 AS index FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n, sum(length(props)) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b FROM events) WHERE n <= 5000 AND b <= 40000""")
def log_cap(spark, sf_dir):
    e = prefix.ordered(read(spark, sf_dir, "events").select("event_id", "ts", "props"), F.col("ts"), F.col("event_id"))
    e = prefix.carried(e, {"n": F.lit(1).cast("long"), "b": F.length("props").cast("long")})
    return e.where("n <= 5000 AND b <= 40000").select("event_id", (F.col("n") - 1).alias("index"))


@register("resolved_names", """SELECT 'p' || p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN 'p' || p_partkey ELSE NULL END AS resolved FROM part""")
def resolved_names(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey")
    index = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("mod.n"), F.col("p_partkey").cast("string")).alias("name"))
    return ac.resolve_names(p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name")), index)


@register("newly_failing", """(SELECT 'new' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'))
 UNION ALL (SELECT 'fixed', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))
 UNION ALL (SELECT 'pre_existing', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))""")
def newly_failing(spark, sf_dir):
    """Before: customers of open orders; after: customers of filled ones."""
    o = read(spark, sf_dir, "orders")
    before, after = o.where("o_orderstatus = 'O'").select("o_custkey").distinct(), o.where("o_orderstatus = 'F'").select("o_custkey").distinct()
    both = before.withColumn("b", F.lit(True)).join(after.withColumn("a", F.lit(True)), "o_custkey", "full")
    kind = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "fixed").otherwise("pre_existing")
    return both.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("sanitized_urls", "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def sanitized_urls(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", fx.base_url(F.col("url")).alias("base"), fx.slug(F.col("url")).alias("slug"))


@register("code_sections", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS section, CASE WHEN length(text) > 100 THEN left(text, 100) || chr(10) || '... [truncated]' ELSE text END AS head FROM documents")
def code_sections(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", fx.section(F.col("text"), 2, 3).alias("section"), fx.trimmed(F.col("text"), 100).alias("head"))
