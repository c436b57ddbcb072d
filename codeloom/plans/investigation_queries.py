"""Queries over candidate files, patches and test runs; line items, orders and parts stand in for their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import investigation as iv
from codeloom.plans.catalog import read, register

HITS = "SELECT l_orderkey % 500 AS c, 'f' || l_partkey % 60 AS path, l_linenumber % 5 AS tier, 100 + l_partkey % 60 * 10 AS size, 20 + l_suppkey % 30 AS snippet FROM lineitem"


def hit_rows(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 500 AS case", "concat('f', l_partkey % 60) AS path", "l_linenumber % 5 AS tier", "100 + l_partkey % 60 * 10 AS size", "20 + l_suppkey % 30 AS snippet")


@register("ranked_context", f"""WITH h AS ({HITS}), b AS (SELECT c, path, max(tier) AS tier, max(size) AS size, max(snippet) AS snippet FROM h GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS place FROM b WINDOW w AS (PARTITION BY c ORDER BY tier DESC, path)),
 u AS (SELECT *, sum(CASE WHEN place = 1 THEN size ELSE snippet END) OVER (PARTITION BY c ORDER BY place) AS used FROM r)
SELECT c AS "case", path, place, CASE WHEN place = 1 THEN 'full' ELSE 'snippet' END AS mode FROM u WHERE place = 1 OR used <= 900""")
def ranked_context(spark, sf_dir):
    return iv.ranked_context(hit_rows(spark, sf_dir), 900)


@register("selected_candidates", """WITH h AS (SELECT o_custkey AS c, CASE WHEN o_orderkey % 17 <> 0 THEN 'f' || o_orderkey END AS path, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 4 END AS tier FROM orders),
 r AS (SELECT *, path IS NOT NULL AND tier IS NOT NULL AS valid, row_number() OVER (PARTITION BY c, path IS NOT NULL AND tier IS NOT NULL ORDER BY tier DESC, path) AS place FROM h)
SELECT c AS "case", path, tier, CASE WHEN NOT valid THEN 'excluded_by_policy' WHEN place <= 3 THEN 'selected' ELSE 'excluded_by_cap' END AS outcome FROM r""")
def selected_candidates(spark, sf_dir):
    c = read(spark, sf_dir, "orders").selectExpr("o_custkey AS case", "IF(o_orderkey % 17 <> 0, concat('f', o_orderkey), NULL) AS path", "IF(o_orderkey % 13 <> 0, o_orderkey % 4, NULL) AS tier")
    return iv.selected_candidates(c, 3)


@register("latest_success", """WITH s AS (SELECT o_custkey % 300 AS project, 'l' || o_orderkey % 3 AS language, 'h' || o_orderkey % 7 AS sha, o_orderdate AS started, o_orderstatus = 'F' AS ok, o_orderkey % 4 = 0 AS legacy, o_orderkey AS scan FROM orders),
 k AS (SELECT * FROM s WHERE ok AND (NOT legacy OR NOT EXISTS (SELECT 1 FROM s b WHERE b.ok AND NOT b.legacy AND b.project = s.project AND b.language = s.language AND b.sha = s.sha)))
SELECT project, max(started) AS started FROM k GROUP BY 1""")
def latest_success(spark, sf_dir):
    s = read(spark, sf_dir, "orders").selectExpr("o_custkey % 300 AS project", "concat('l', o_orderkey % 3) AS language", "concat('h', o_orderkey % 7) AS sha", "o_orderdate AS started", "IF(o_orderstatus = 'F', 'success', 'failed') AS status", "o_orderkey % 4 = 0 AS legacy")
    return iv.latest_success(s).select("project", "started")


@register("limit_modes", """SELECT c_nationkey AS dataset, CASE WHEN count(*) <= 6 THEN 'no-selection-all-units-under-limit' WHEN bool_or(c_custkey % 40 = 0) THEN 'entry-path-bfs' ELSE 'file-order-head-slice' END AS mode FROM customer GROUP BY 1""")
def limit_modes(spark, sf_dir):
    return iv.limit_modes(read(spark, sf_dir, "customer").selectExpr("c_nationkey AS dataset", "c_custkey AS node", "c_custkey % 40 = 0 AS is_entry_point"), 6)


@register("file_batches", """WITH RECURSIVE f AS (SELECT p_size AS job, p_name || p_partkey AS path, p_partkey * 37 % 900 AS size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey * 37 % 900, p_name || p_partkey) AS i FROM part),
 b AS (SELECT job, path, i, size + length(path) + 50 AS used, CAST(0 AS BIGINT) AS batch FROM f WHERE i = 1
 UNION ALL SELECT f.job, f.path, f.i, CASE WHEN b.used + f.size + length(f.path) + 50 > 2000 THEN 0 ELSE b.used END + f.size + length(f.path) + 50, b.batch + CASE WHEN b.used + f.size + length(f.path) + 50 > 2000 THEN 1 ELSE 0 END FROM b JOIN f ON f.job = b.job AND f.i = b.i + 1)
SELECT job, path, batch FROM b""")
def file_batches(spark, sf_dir):
    return iv.file_batches(read(spark, sf_dir, "part").selectExpr("p_size AS job", "concat(p_name, p_partkey) AS path", "p_partkey * 37 % 900 AS size"), 2000)


@register("chunked_units", "SELECT c_custkey, c_nationkey, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 7 AS BIGINT) AS chunk FROM customer")
def chunked_units(spark, sf_dir):
    return iv.chunks(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", 7)


@register("merged_outputs", """WITH o AS (SELECT o_orderkey AS ordinal, 's' || o_custkey % 9 AS section, CASE WHEN o_orderkey % 10 <> 0 THEN 'k' || o_custkey END AS key, 'v' || o_orderkey AS value FROM orders)
SELECT section, key, CASE WHEN key IS NULL THEN min_by(value, ordinal) ELSE max_by(value, ordinal) END AS value FROM o GROUP BY 1, 2""")
def merged_outputs(spark, sf_dir):
    return iv.merged_outputs(read(spark, sf_dir, "orders").selectExpr("o_orderkey AS ordinal", "concat('s', o_custkey % 9) AS section", "IF(o_orderkey % 10 <> 0, concat('k', o_custkey), NULL) AS key", "concat('v', o_orderkey) AS value"))


@register("language_partitions", "SELECT nullif(lang, 'en') AS language, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1")
def language_partitions(spark, sf_dir):
    return iv.language_partitions(read(spark, sf_dir, "documents").select(F.nullif("lang", F.lit("en")).alias("language"), F.col("doc_id").alias("node")))


@register("delta_preserved", """WITH l AS (SELECT l_orderkey AS patch, 'f' || l_partkey % 3 AS file, l_linenumber AS place, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS sign FROM lineitem),
 x AS (SELECT patch, file, string_agg(sign || l_partkey, ',' ORDER BY sign, place, l_partkey) AS s FROM l GROUP BY 1, 2), y AS (SELECT patch, file, string_agg(sign || CASE WHEN l_suppkey % 20 = 0 THEN 0 ELSE l_partkey END, ',' ORDER BY sign, place, CASE WHEN l_suppkey % 20 = 0 THEN 0 ELSE l_partkey END) AS s FROM l WHERE l_suppkey % 31 <> 0 GROUP BY 1, 2)
SELECT coalesce(x.patch, y.patch) AS patch, coalesce(x.file, y.file) AS file, x.s IS NOT DISTINCT FROM y.s AS same FROM x FULL JOIN y ON x.patch = y.patch AND x.file = y.file""")
def delta_preserved(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS patch", "concat('f', l_partkey % 3) AS file", "l_linenumber AS place", "IF(l_linenumber % 2 = 0, '+', '-') AS sign", "l_partkey AS line", "l_suppkey")
    after = rows.where("l_suppkey % 31 <> 0").withColumn("line", F.expr("IF(l_suppkey % 20 = 0, 0L, line)"))
    return iv.delta_preserved(rows, after)


@register("unique_occurrences", """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS raw FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, list_transform(raw, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS ls FROM d),
 p AS (SELECT doc_id, list_filter(range(1, len(ls) + 1), lambda i: ls[i] = ls[1] AND (len(ls) < 2 OR (i < len(ls) AND ls[i + 1] = ls[2]))) AS hits FROM n)
SELECT doc_id, CASE WHEN len(hits) = 1 THEN CAST(hits[1] - 1 AS INT) END AS place FROM p""")
def unique_occurrences(spark, sf_dir):
    lines = F.transform(F.split("text", "\n", -1), lambda x: iv.normalized_line(F.concat(F.lit("+"), x)))
    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", lines.alias("lines")).select("doc_id", iv.unique_occurrence(F.slice("lines", 1, 2), F.col("lines")).alias("place"))


LINES = """SELECT 'f' || o_custkey AS file, o_orderkey AS line, CASE o_orderkey % 7 WHEN 0 THEN 'def m' || o_orderkey % 50 || '(self):' WHEN 1 THEN '  eval(x); eval(y)' WHEN 2 THEN '# eval(z)' WHEN 3 THEN 'os.system(cmd)' ELSE 'medieval(1)' END AS text FROM orders"""


def line_rows(spark, sf_dir):
    text = "CASE o_orderkey % 7 WHEN 0 THEN concat('def m', o_orderkey % 50, '(self):') WHEN 1 THEN '  eval(x); eval(y)' WHEN 2 THEN '# eval(z)' WHEN 3 THEN 'os.system(cmd)' ELSE 'medieval(1)' END AS text"
    return read(spark, sf_dir, "orders").selectExpr("concat('f', o_custkey) AS file", "o_orderkey AS line", text)


@register("attributed_sinks", f"""WITH l AS ({LINES}), m AS (SELECT *, last_value(nullif(regexp_extract(text, 'def (\\w+)', 1), '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY line) AS method FROM l)
SELECT file, method, min(line) AS line FROM m WHERE method IS NOT NULL AND ltrim(text)[1] <> '#' AND regexp_matches(text, '\\beval\\(|os\\.system') GROUP BY 1, 2""")
def attributed_sinks(spark, sf_dir):
    return iv.attributed_sinks(line_rows(spark, sf_dir), r"def (\w+)", r"\beval\(|os\.system")


@register("grepped_files", f"""WITH l AS ({LINES}), h AS (SELECT file, line, len(regexp_extract_all(text, '\\beval\\b')) + len(regexp_extract_all(text, '\\bsystem\\b')) AS n FROM l)
SELECT file, CAST(sum(n) AS BIGINT) AS total, min(line) AS line FROM h WHERE n > 0 GROUP BY 1 ORDER BY total DESC, file LIMIT 3""")
def grepped_files(spark, sf_dir):
    return iv.grepped_files(line_rows(spark, sf_dir), ("eval", "system"))


@register("definition_files", "SELECT DISTINCT 'small ring' AS symbol, p_brand AS file FROM part WHERE p_name = 'small ring' UNION ALL SELECT DISTINCT p_name, p_brand FROM part WHERE p_name LIKE 'large%'")
def definition_files(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    symbols = p.where("p_name LIKE 'large%' OR p_name = 'small ring'").select(F.col("p_name").alias("symbol")).distinct()
    return iv.definition_files(symbols, p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("file")))


@register("containing_functions", """WITH f AS (SELECT p_brand AS file, p_partkey AS ordinal, 'p' || p_partkey AS name, p_partkey % 700 AS s, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 700 + p_size END AS e FROM part), h AS (SELECT c_custkey AS hit, 'Brand#' || c_nationkey AS file, c_custkey * 13 % 800 AS line FROM customer),
 b AS (SELECT hit, h.file, line, min_by(name, ordinal) FILTER (s <= line AND line <= e) AS within, arg_min(name, abs(s - line) * 10000000 + s * 10000 + ordinal) AS nearest FROM h LEFT JOIN f ON f.file = h.file GROUP BY 1, 2, 3)
SELECT hit, file, line, coalesce(within, nearest) AS name, CASE WHEN within IS NOT NULL THEN 'contains' WHEN nearest IS NOT NULL THEN 'nearest' ELSE 'none' END AS how FROM b""")
def containing_functions(spark, sf_dir):
    f = read(spark, sf_dir, "part").selectExpr("p_brand AS file", "p_partkey AS ordinal", "concat('p', p_partkey) AS name", "p_partkey % 700 AS start", "IF(p_partkey % 4 <> 0, p_partkey % 700 + p_size, NULL) AS end")
    return iv.containing_functions(read(spark, sf_dir, "customer").selectExpr("c_custkey AS hit", "concat('Brand#', c_nationkey) AS file", "c_custkey * 13 % 800 AS line"), f)


REL = "SELECT DISTINCT 'f' || o_custkey % 200 AS src_file, 'f' || o_orderkey % 230 AS dst_file FROM orders"
CAND = "SELECT c_nationkey AS c, c_custkey AS place, 'f' || c_custkey AS path FROM customer WHERE c_custkey < 210"


def relation_rows(spark, sf_dir):
    candidates = read(spark, sf_dir, "customer").where("c_custkey < 210").selectExpr("c_nationkey AS case", "c_custkey AS place", "concat('f', c_custkey) AS path")
    return iv.file_relations(read(spark, sf_dir, "orders").selectExpr("concat('f', o_custkey % 200) AS src_file", "concat('f', o_orderkey % 230) AS dst_file"), candidates), candidates


@register("file_relations", f"WITH e AS ({REL}), c AS ({CAND}) SELECT src_file AS from_path, dst_file AS to_path FROM e WHERE src_file <> dst_file AND src_file IN (SELECT path FROM c) AND dst_file IN (SELECT path FROM c)")
def file_relations(spark, sf_dir):
    return relation_rows(spark, sf_dir)[0]


@register("candidate_roles", f"""WITH e AS ({REL}), k AS ({CAND}), f AS (SELECT c, min_by(path, place) AS p, min(place) AS low FROM k GROUP BY 1)
SELECT k.c AS "case", k.path, CASE WHEN k.place = f.low THEN 'primary' WHEN EXISTS (SELECT 1 FROM e WHERE (src_file = f.p AND dst_file = k.path) OR (src_file = k.path AND dst_file = f.p)) THEN 'supporting' ELSE 'independent' END AS role FROM k JOIN f USING (c)""")
def candidate_roles(spark, sf_dir):
    relations, candidates = relation_rows(spark, sf_dir)
    return iv.candidate_roles(candidates, relations)


FACTS = """SELECT DISTINCT 'function' AS kind, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE {0} UNION SELECT 'call', o_custkey || '->' || o_orderkey FROM orders WHERE {1} UNION SELECT 'sink', CAST(p_partkey AS VARCHAR) FROM part WHERE {2}"""


@register("evaluated_anchors", f"""WITH b AS ({FACTS.format("c_custkey % 5 <> 0", "o_orderkey % 3 <> 0", "p_size < 30")}), a AS ({FACTS.format("c_custkey % 7 <> 0", "o_orderkey % 4 <> 0", "p_size < 40")})
SELECT coalesce(b.kind, a.kind) AS kind, coalesce(b.key, a.key) AS key, CASE WHEN b.key IS NULL THEN 'new' WHEN a.key IS NULL THEN 'gone' ELSE 'held' END AS status FROM b FULL JOIN a ON a.kind = b.kind AND a.key = b.key""")
def evaluated_anchors(spark, sf_dir):
    def facts(a, b, c):
        return iv.anchor_facts(read(spark, sf_dir, "customer").where(a).select(F.col("c_custkey").alias("node")), read(spark, sf_dir, "orders").where(b).select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")), read(spark, sf_dir, "part").where(c).select(F.col("p_partkey").alias("node")))

    return iv.evaluated_anchors(facts("c_custkey % 5 <> 0", "o_orderkey % 3 <> 0", "p_size < 30"), facts("c_custkey % 7 <> 0", "o_orderkey % 4 <> 0", "p_size < 40"))


@register("source_verification", """WITH h AS (SELECT o_custkey AS patch, o_orderkey % 3 <> 0 AS attempted, CASE WHEN o_orderkey % 31 = 0 THEN 'no_match' WHEN o_orderkey % 17 = 0 THEN 'ambiguous' END AS reason FROM orders)
SELECT patch, CASE WHEN count(*) FILTER (reason = 'no_match') > 0 THEN 'Unverified' WHEN count(*) FILTER (reason = 'ambiguous') > 0 THEN 'Position Unconfirmed' WHEN count(*) FILTER (attempted) > 0 THEN 'Confirmed' ELSE 'Not Verified' END AS value, count(*) FILTER (attempted) AS n_checked FROM h GROUP BY 1""")
def source_verification(spark, sf_dir):
    return iv.source_verification(read(spark, sf_dir, "orders").selectExpr("o_custkey AS patch", "o_orderkey % 3 <> 0 AS attempted", "CASE WHEN o_orderkey % 31 = 0 THEN 'no_match' WHEN o_orderkey % 17 = 0 THEN 'ambiguous' END AS reason"))


@register("compared_runs", """WITH r AS (SELECT p_partkey AS c, p_partkey % 3 = 0 AS ids, p_partkey % 2 AS new, p_partkey % 4 AS xb, p_partkey % 5 AS xa, CASE WHEN p_partkey % 7 < 4 THEN p_size END AS fb, p_partkey % 9 + 10 AS fa FROM part)
SELECT c AS "case", CASE WHEN ids THEN 'ids' WHEN fb IS NOT NULL THEN 'counts' ELSE 'exit_code' END AS evidence, CASE WHEN ids THEN CASE WHEN new > 0 THEN 'regressed' ELSE 'unchanged' END WHEN fb IS NOT NULL THEN CASE WHEN fa > fb THEN 'regressed' ELSE 'unchanged' END
 WHEN xb = 0 AND xa <> 0 THEN 'regressed' WHEN xb <> 0 AND xa = 0 THEN 'fixed' ELSE 'unchanged' END AS outcome FROM r""")
def compared_runs(spark, sf_dir):
    r = read(spark, sf_dir, "part").selectExpr("p_partkey AS case", "p_partkey % 3 = 0 AS ids_complete", "slice(array('t'), 1, int(p_partkey % 2)) AS new_failures", "p_partkey % 4 AS exit_before", "p_partkey % 5 AS exit_after", "IF(p_partkey % 7 < 4, p_size, NULL) AS failed_before", "p_partkey % 9 + 10 AS failed_after")
    return iv.compared_runs(r)


@register("dominant_languages", """WITH n AS (SELECT o_custkey AS repo, CASE o_orderkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'c' END AS language, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2)
SELECT repo, coalesce(arg_max(language, n * 1000000 - first) FILTER (language IS NOT NULL), 'unknown') AS language FROM n GROUP BY 1""")
def dominant_languages(spark, sf_dir):
    return iv.dominant_language(read(spark, sf_dir, "orders").selectExpr("o_custkey AS repo", "o_orderkey AS place", "CASE o_orderkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'c' END AS language"))


@register("best_candidates", """WITH f AS (SELECT p_partkey AS id, p_name AS name, 'r/' || p_size % 3 || '/' || p_brand AS path, p_partkey % 2 = 0 AS fn, p_size % 3 AS d, p_brand AS b FROM part), k AS (SELECT c_custkey AS call, 'small ring' AS name, c_custkey % 4 AS d, 'Brand#' || c_nationkey AS b FROM customer),
 s AS (SELECT call, id, fn, CASE WHEN f.b <> k.b THEN 0 WHEN f.d <> k.d THEN 1 ELSE 2 END AS score FROM k JOIN f USING (name)), r AS (SELECT *, row_number() OVER (PARTITION BY call ORDER BY score DESC, fn DESC, id) AS place FROM s WHERE score > 0) SELECT call, id, score FROM r WHERE place = 1""")
def best_candidates(spark, sf_dir):
    f = read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS name", "concat_ws('/', 'r', p_size % 3, p_brand) AS path", "p_partkey % 2 = 0 AS is_function")
    calls = read(spark, sf_dir, "customer").selectExpr("c_custkey AS call", "'small ring' AS name", "concat_ws('/', c_custkey % 4, concat('Brand#', c_nationkey)) AS hint")
    return iv.best_candidates(calls, f)


@register("inlined_units", """WITH x AS (SELECT c_custkey AS node, unnest([c_custkey % 7, c_custkey % 11 + 3000000, c_custkey % 13]) AS id, generate_subscripts([1, 2, 3], 1) AS pos FROM customer), d AS (SELECT node, string_agg('code ' || p_partkey, chr(10) || chr(10) ORDER BY pos) AS codes, list(DISTINCT p_brand) AS fs FROM x JOIN part ON p_partkey = id GROUP BY 1)
SELECT c_custkey AS node, 'own ' || c_custkey || coalesce(chr(10) || chr(10) || codes, '') AS code, array_to_string(list_sort(list_distinct(list_append(coalesce(fs, []), 'Brand#1'))), ',') AS files FROM customer LEFT JOIN d ON d.node = c_custkey""")
def inlined_units(spark, sf_dir):
    units = read(spark, sf_dir, "customer").selectExpr("c_custkey AS node", "concat('own ', c_custkey) AS code", "'Brand#1' AS file", "array(c_custkey % 7, c_custkey % 11 + 3000000, c_custkey % 13) AS include")
    index = read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "concat('code ', p_partkey) AS dep_code", "p_brand AS dep_file")
    return iv.inlined_units(units, index).withColumn("files", F.array_join("files", ","))


@register("resolved_calls", """WITH f AS (SELECT p_partkey AS id, p_brand AS file, 'n' || p_partkey % 900 AS name, p_partkey % 5 = 0 AS is_method FROM part), k AS (SELECT o_orderkey AS call, 'Brand#' || o_orderkey % 9 AS file, 'n' || o_custkey % 950 AS name FROM orders), i AS (SELECT DISTINCT 'Brand#' || c_custkey % 9 AS file, 'n' || c_custkey % 950 AS name, 'Brand#' || c_nationkey AS target FROM customer WHERE c_custkey % 3 = 0),
 i1 AS (SELECT file, name, min(target) AS target FROM i GROUP BY 1, 2), l AS (SELECT file, name, min(id) AS id FROM f GROUP BY 1, 2), g AS (SELECT name, min(id) AS id FROM f WHERE NOT is_method GROUP BY 1 HAVING count(*) = 1)
SELECT call, CASE WHEN l.id IS NOT NULL THEN l.id WHEN i1.target IS NOT NULL THEN t.id ELSE g.id END AS id FROM k LEFT JOIN l ON l.file = k.file AND l.name = k.name LEFT JOIN i1 ON i1.file = k.file AND i1.name = k.name LEFT JOIN l t ON t.file = i1.target AND t.name = k.name LEFT JOIN g ON g.name = k.name""")
def resolved_calls(spark, sf_dir):
    f = read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_brand AS file", "concat('n', p_partkey % 900) AS name", "p_partkey % 5 = 0 AS is_method")
    calls = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS call", "concat('Brand#', o_orderkey % 9) AS file", "concat('n', o_custkey % 950) AS name")
    imports = read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").selectExpr("concat('Brand#', c_custkey % 9) AS file", "concat('n', c_custkey % 950) AS name", "concat('Brand#', c_nationkey) AS target_file")
    return iv.resolved_calls(calls, f, imports)


def rule_provider(rows):
    """A stand-in for a model: the verdict follows from the text's length; very long texts fail."""
    return [{"verdict": "VULNERABLE" if r["size"] % 5 == 0 else "SAFE", "score": r["size"] / 1000} for r in rows]


@register("provider_verdicts", "SELECT doc_id, n_chars AS size, CASE WHEN n_chars % 5 = 0 THEN 'VULNERABLE' ELSE 'SAFE' END AS verdict, n_chars / 1000 AS score, CAST(NULL AS VARCHAR) AS provider_error FROM documents")
def provider_verdicts(spark, sf_dir):
    return iv.hooked(read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("size")), rule_provider, "verdict string, score double")
