"""Registered queries against their SQL on the smallest tables, and small cases of the operators."""

import os

import duckdb
import pytest

from codeloom.functions import taxonomy as tx
from codeloom.functions import text as fx
from codeloom.operators import accounting as ac
from codeloom.operators import graph as g
from codeloom.plans import catalog, finding_queries, graph_queries, review_queries, verification_queries, entry_queries, investigation_queries, report_queries, source_queries, hierarchy_queries, table_function_queries, search_queries, code_queries, reply_queries, index_queries  # noqa: F401
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalog.SQL[name])
    cols = sorted(want.columns)
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted([plain(r[c]) for c in cols] for r in got.collect()) == sorted([plain(r[i]) for i in at] for r in want.fetchall())


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column).first()[0]


def test_confidence_and_cwe(spark):
    for raw, want in (("NaN", None), ("Infinity", None), ("high", None), ("1.5", 1.0), ("-0.3", 0.0), ("0.25", 0.25), (None, None)):
        assert one(spark, tx.confidence(F.col("x")), x=raw) == want
    for raw, want in (("CWE-79", 79), ("918", 918), ("918.0", 918), ("true", 0), ("text", 0), (None, 0)):
        assert one(spark, fx.coerce_cwe(F.col("x")), x=raw) == want


def test_hunks_fences_and_names(spark):
    assert one(spark, fx.hunk_range(F.col("x")), x="@@ -1,2 +5,3 @@ def f") == [5, 7]
    assert one(spark, fx.hunk_range(F.col("x")), x="@@ -1 +5 @@") == [5, 5]
    assert one(spark, fx.hunk_range(F.col("x")), x="@@ -1,2 +5,0 @@") is None
    assert one(spark, fx.code_fence(F.col("x")), x="a ```` b") == "`````"
    assert one(spark, fx.code_fence(F.col("x")), x="plain") == "```"
    assert one(spark, fx.signature_pattern(F.col("x")), x="get_new_user") == "user"
    assert one(spark, fx.usage_lines(F.col("x"), "run"), x="run()\nrunner()\nx.run (1)") == [1, 3]
    assert one(spark, fx.duration(F.col("x")), x=3725) == "1h02m"


def test_closure_with_cycle_self_call_and_no_seed(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, 6)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (99,)], "node long")
    assert {tuple(r) for r in g.distances(edges, seeds).collect()} == {(1, 0), (99, 0), (2, 1), (3, 2)}
    assert g.reachable(edges, seeds.limit(0)).count() == 0
    units = spark.createDataFrame([(i,) for i in range(1, 7)], "node long")
    assert g.reachability_filter(units, edges, seeds.limit(0)).count() == 6
    pruned = {tuple(r) for r in g.prune_buckets(units, g.reachable(edges, seeds), edges).collect()}
    assert pruned == {(4, "orphan"), (5, "orphan"), (6, "dead_cluster")}


def test_class_orders_of_a_deep_hierarchy(spark):
    deep = spark.createDataFrame([(f"c{i}", [f"c{i - 1}"] if i else []) for i in range(68)], "node string, bases array<string>")
    assert {r.node: r.chain for r in g.method_orders(deep).collect()}["c67"] == [f"c{i}" for i in range(67, -1, -1)]


def test_missing_lines_are_selected(spark):
    units = spark.createDataFrame([(1, "a", None, None), (2, "a", 1, 2), (3, "a", 5, 9), (4, "b", None, None)], "id int, file string, start int, end int")
    hunks = spark.createDataFrame([("a", 6, 7)], "file string, a int, b int")
    assert {r.id: r.diff_selected for r in ac.diff_selected(units, hunks, hunks).collect()} == {1: True, 2: False, 3: True, 4: False}
    assert {r.id for r in ac.containing_an_end(units, hunks).collect()} == {3}


def test_entry_module_without_llm(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0
