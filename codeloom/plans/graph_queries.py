"""Queries over the stand-in call graph: every customer has three functions, every order is a call.

Entry points are the first functions of all MACHINERY customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import accounting as ac
from codeloom.operators import graph as g
from codeloom.plans.catalog import read, register

EDGES = """WITH RECURSIVE n AS (SELECT count(*) AS c FROM customer), calls AS (SELECT o_custkey + n.c * (o_orderkey % 3) AS src, ((o_orderkey % 100003) * (o_orderkey % 100003) * 31 + o_custkey) % (3 * n.c) AS dst FROM orders, n), edges AS (SELECT DISTINCT src, dst FROM calls WHERE src <> dst),
 units AS (SELECT c_custkey + n.c * k AS node, c_nationkey FROM customer, n, range(3) t(k)), seeds AS (SELECT c_custkey AS node FROM customer WHERE c_mktsegment = 'MACHINERY'), """
CLOSURE = EDGES + "r AS (SELECT node FROM seeds UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.node) "
DEPTHS = EDGES + "r AS (SELECT node, 0 AS depth FROM seeds UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.depth < 100), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node) "


def _size(spark, sf_dir):
    return F.broadcast(read(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("c")))  # one row


def edges(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").crossJoin(_size(spark, sf_dir))
    return o.select((F.col("o_custkey") + F.col("c") * (F.col("o_orderkey") % 3)).alias("src"), F.expr("((o_orderkey % 100003) * (o_orderkey % 100003) * 31 + o_custkey) % (3 * c)").alias("dst")).where("src <> dst").distinct()


def seeds(spark, sf_dir):
    return read(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("node"))


def units(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").crossJoin(_size(spark, sf_dir))
    return c.select(F.explode(F.expr("transform(sequence(0, 2), k -> c_custkey + c * k)")).alias("node"), "c_nationkey")


@register("reachable_closure", CLOSURE + "SELECT node FROM r")
def reachable_closure(spark, sf_dir):
    return g.reachable(edges(spark, sf_dir), seeds(spark, sf_dir))


@register("depth_map", DEPTHS + "SELECT node, depth FROM m")
def depth_map(spark, sf_dir):
    return g.distances(edges(spark, sf_dir), seeds(spark, sf_dir))


@register("limit_by_depth", DEPTHS + "SELECT units.node, depth FROM units LEFT JOIN m ON m.node = units.node ORDER BY depth NULLS LAST, units.node LIMIT 50")
def limit_by_depth(spark, sf_dir):
    d = g.distances(edges(spark, sf_dir), seeds(spark, sf_dir))
    return units(spark, sf_dir).select("node").join(d, "node", "left").orderBy(F.asc_nulls_last("depth"), "node").limit(50)


@register("k_hop_neighbours", EDGES + """w AS (SELECT node AS start, node, 0 AS depth FROM seeds UNION SELECT w.start, e.dst, w.depth + 1 FROM w JOIN edges e ON e.src = w.node WHERE w.depth < 3)
SELECT start, node, min(depth) AS depth FROM w WHERE node <> start GROUP BY start, node""")
def k_hop_neighbours(spark, sf_dir):
    return g.neighbourhood(edges(spark, sf_dir), seeds(spark, sf_dir), 3)


@register("unreachable_units", CLOSURE + "SELECT node FROM units WHERE node NOT IN (SELECT node FROM r)")
def unreachable_units(spark, sf_dir):
    return units(spark, sf_dir).select("node").join(reachable_closure(spark, sf_dir), "node", "left_anti")


@register("reachability_record", CLOSURE + """, k AS (SELECT count(*) AS kept FROM units WHERE node IN (SELECT node FROM r)), t AS (SELECT count(*) AS original FROM units)
SELECT original AS original_units, kept AS reachable_units, original - kept AS filtered_out, round((1 - kept / original) * 100, 1) AS reduction_percentage FROM k, t""")
def reachability_record(spark, sf_dir):
    u = units(spark, sf_dir)
    kept = g.reachability_filter(u, edges(spark, sf_dir), seeds(spark, sf_dir)).withColumn("kept", F.lit(1))
    row = u.join(kept, "node", "left").agg(F.count(F.lit(1)).alias("original_units"), F.count("kept").alias("reachable_units"))
    return row.withColumn("filtered_out", F.col("original_units") - F.col("reachable_units")).withColumn("reduction_percentage", F.round((1 - F.col("reachable_units") / F.col("original_units")) * 100, 1))


@register("prune_telemetry", CLOSURE + """, p AS (SELECT node FROM units WHERE node NOT IN (SELECT node FROM r))
SELECT CASE WHEN node IN (SELECT dst FROM edges) THEN 'dead_cluster' ELSE 'orphan' END AS bucket, count(*) AS n FROM p GROUP BY 1""")
def prune_telemetry(spark, sf_dir):
    e = edges(spark, sf_dir)
    return g.prune_buckets(units(spark, sf_dir), g.reachable(e, seeds(spark, sf_dir)), e).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@register("graph_statistics", EDGES + """d AS (SELECT node, (SELECT count(*) FROM edges WHERE src = node) AS o, (SELECT count(*) FROM edges WHERE dst = node) AS i FROM units)
SELECT count(*) AS n_nodes, CAST(sum(o) AS BIGINT) AS n_edges, max(o) AS max_out, max(i) AS max_in, count(*) FILTER (o = 0 AND i = 0) AS isolated, round(avg(o), 2) AS avg_out FROM d""")
def graph_statistics(spark, sf_dir):
    return g.degree_statistics(edges(spark, sf_dir), units(spark, sf_dir))


@register("newly_reachable", EDGES + """extra AS (SELECT node FROM units WHERE node % 97 = 0), a AS (SELECT node FROM seeds UNION SELECT e.dst FROM a JOIN edges e ON e.src = a.node),
 b AS (SELECT node FROM (SELECT node FROM seeds UNION SELECT node FROM extra) UNION SELECT e.dst FROM b JOIN edges e ON e.src = b.node) SELECT node FROM b EXCEPT SELECT node FROM a""")
def newly_reachable(spark, sf_dir):
    e, s = edges(spark, sf_dir), seeds(spark, sf_dir)
    extra = units(spark, sf_dir).select("node").where("node % 97 = 0")
    return g.reachable(e, s.unionByName(extra)).join(g.reachable(e, s), "node", "left_anti")


@register("callers_one_hop", EDGES + "x AS (SELECT 1) SELECT DISTINCT src AS node FROM edges WHERE dst IN (SELECT node FROM units WHERE node % 50 = 0)")
def callers_one_hop(spark, sf_dir):
    chosen = units(spark, sf_dir).where("node % 50 = 0")
    return edges(spark, sf_dir).join(chosen, F.col("dst") == F.col("node"), "left_semi").select(F.col("src").alias("node")).distinct()


@register("caller_callee_dedup", EDGES + """c AS (SELECT node, c_nationkey % 3 AS cwe FROM units), one AS (SELECT dst, min(src) AS src FROM edges GROUP BY dst HAVING count(DISTINCT src) = 1),
 gone AS (SELECT one.dst FROM one JOIN c a ON a.node = one.src JOIN c b ON b.node = one.dst WHERE a.cwe = b.cwe AND a.cwe <> 0) SELECT node, cwe FROM c WHERE node NOT IN (SELECT dst FROM gone)""")
def caller_callee_dedup(spark, sf_dir):
    confirmed = units(spark, sf_dir).select("node", (F.col("c_nationkey") % 3).alias("cwe"))
    return ac.dedup_caller_callee(confirmed, edges(spark, sf_dir))
