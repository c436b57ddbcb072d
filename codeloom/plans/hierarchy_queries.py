"""Class hierarchies and line ranges: parts as classes, orders and line items as units and hunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import accounting as ac
from codeloom.operators import inheritance as ih
from codeloom.operators import intervals as iv
from codeloom.plans.catalog import read, register

# each part is a class below part / 12, and below a mixin of its size; supplier s of a line item defines a method of the part
CHAINS = """p AS (SELECT p_partkey AS k, 'c' || p_partkey AS cls, CASE WHEN p_partkey >= 12 THEN 'c' || p_partkey // 12 END AS parent, 'm' || p_size % 5 AS mixin FROM part),
chains(cls, chain) AS (
  SELECT cls, [cls, mixin] FROM p WHERE parent IS NULL OR parent NOT IN (SELECT cls FROM p)
  UNION ALL
  SELECT p.cls, [p.cls] || c.chain || CASE WHEN list_contains(c.chain, p.mixin) THEN [] ELSE [p.mixin] END FROM p JOIN chains c ON p.parent = c.cls)"""


def class_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    keys = p.select((F.col("p_partkey")).alias("known"))
    up = F.floor(F.col("p_partkey") / 12).cast("long")
    p = p.withColumn("up", F.when(F.col("p_partkey") >= 12, up)).join(keys, F.col("up") == F.col("known"), "left")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    mixin = F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string"))
    return p.select(name(F.col("p_partkey")).alias("node"), F.array_compact(F.array(name(F.col("known")), mixin)).alias("bases"))


@register("class_orders", f"WITH RECURSIVE {CHAINS} SELECT cls, array_to_string(chain, ',') AS chain FROM chains")
def class_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ih.method_orders(class_bases(spark, sf_dir)).select(F.col("node").alias("cls"), F.array_join("chain", ",").alias("chain")).where("cls LIKE 'c%'")


@register(
    "inherited_calls",
    f"""WITH RECURSIVE {CHAINS},
m AS (SELECT DISTINCT 'c' || l_partkey AS cls, 'f' || l_suppkey % 20 AS method, 'c' || l_partkey || '.f' || l_suppkey % 20 AS id FROM lineitem WHERE l_returnflag = 'A'
  UNION SELECT DISTINCT 'm' || p_size % 5, 'f' || p_size % 20, 'm' || p_size % 5 || '.f' || p_size % 20 FROM part),
calls AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS call, 'c' || l_partkey AS cls, 'f' || (l_suppkey + l_linenumber) % 20 AS method, l_linestatus = 'F' AS is_super FROM lineitem),
links AS (SELECT cls, unnest(chain) AS above, unnest(range(len(chain))) AS place FROM chains),
found AS (SELECT c.cls, c.method, c.is_super, arg_min(m.id, place) AS id, arg_min(above, place) AS defined_in
  FROM (SELECT DISTINCT cls, method, is_super FROM calls) c JOIN links l ON l.cls = c.cls AND place >= CASE WHEN c.is_super THEN 1 ELSE 0 END JOIN m ON m.cls = above AND m.method = c.method GROUP BY 1, 2, 3)
SELECT call, f.defined_in, f.id FROM calls c LEFT JOIN found f ON f.cls = c.cls AND f.method = c.method AND f.is_super = c.is_super""",
)
def inherited_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item is a call on its part's class, of its own method or through super."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    cls = F.concat(F.lit("c"), F.col("l_partkey").cast("string"))
    method = lambda n: F.concat(F.lit("f"), (n % 20).cast("string"))
    own = li.where("l_returnflag = 'A'").select(cls.alias("cls"), method(F.col("l_suppkey")).alias("method"))
    mixins = read(spark, sf_dir, "part").select(F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string")).alias("cls"), method(F.col("p_size")).alias("method"))
    methods = own.unionByName(mixins).distinct().withColumn("id", F.concat_ws(".", "cls", "method"))
    calls = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("call"), cls.alias("cls"), method(F.col("l_suppkey") + F.col("l_linenumber")).alias("method"), (F.col("l_linestatus") == "F").alias("is_super"))
    return ih.inherited_calls(calls, ih.places(ih.method_orders(class_bases(spark, sf_dir))), methods).select("call", "defined_in", "id")


FOREST = """f AS (SELECT p_partkey AS node, CASE WHEN p_partkey // 12 > 0 AND p_partkey // 12 IN (SELECT p_partkey FROM part) THEN p_partkey // 12 END AS parent FROM part),
up(node, base) AS (SELECT node, parent FROM f WHERE parent IS NOT NULL UNION SELECT up.node, f.parent FROM up JOIN f ON up.base = f.node WHERE f.parent IS NOT NULL)"""


def class_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = F.floor(F.col("p_partkey") / 12).cast("long")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(up > 0, up).alias("parent"))


@register("subtypes", f"""WITH RECURSIVE {FOREST}
SELECT l_orderkey, l_linenumber, l_partkey AS sub, l_suppkey AS base, l_partkey = l_suppkey OR EXISTS (SELECT 1 FROM up WHERE up.node = l_partkey AND up.base = l_suppkey) AS is_subtype FROM lineitem""")  # fmt: skip
def subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each line item's part is below the part that bears its supplier's number."""
    pairs = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("sub"), F.col("l_suppkey").alias("base"))
    return ih.is_subtype(pairs, ih.nested_intervals(class_forest(spark, sf_dir)))


@register("inherit_closure", f"WITH RECURSIVE {FOREST} SELECT node AS sub, base FROM up")
def inherit_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = class_forest(spark, sf_dir)
    known = f.select(F.col("node").alias("base"))
    return ih.inherit_closure(f.select("node", F.col("parent").alias("base")).join(known, "base", "left_semi"))


# a third of all units and hunks are of one file
HOT_SQL = """WITH u AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, CASE WHEN l_suppkey % 3 = 0 THEN 'src/hot.py' ELSE 'src/s' || l_suppkey || '.py' END AS file,
  l_suppkey AS ordinal, l_orderkey % 20000 AS s, l_orderkey % 20000 + l_linenumber * l_linenumber AS e FROM lineitem),
h AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN 'src/hot.py' ELSE 'src/s' || o_custkey % 100 || '.py' END AS file, o_orderkey % 20000 AS a, o_orderkey % 20000 + o_custkey % 5 AS b FROM orders) """


def hot_units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = lambda hot, n: F.when(hot, "src/hot.py").otherwise(F.concat(F.lit("src/s"), n.cast("string"), F.lit(".py")))
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    start = F.col("l_orderkey") % 20000
    u = li.select(F.concat_ws("-", *li.columns[:4]).alias("id"), path(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey")).alias("file"), F.col("l_suppkey").alias("ordinal"), start.alias("start"), (start + F.col("l_linenumber") * F.col("l_linenumber")).alias("end"))
    a = F.col("o_orderkey") % 20000
    h = read(spark, sf_dir, "orders").select(path(F.col("o_custkey") % 3 == 0, F.col("o_custkey") % 100).alias("file"), a.alias("a"), (a + F.col("o_custkey") % 5).alias("b"))
    return u, h


@register("hot_file_overlap", HOT_SQL + "SELECT id FROM u WHERE EXISTS (SELECT 1 FROM h WHERE h.file = u.file AND s <= b AND e >= a)")
def hot_file_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ac.overlapping(*hot_units(spark, sf_dir)).select("id")


@register(
    "path_matched_findings",
    HOT_SQL
    + """, f AS (SELECT file, min(ordinal) AS ordinal FROM u GROUP BY file), p AS (SELECT DISTINCT substr(file, 5) AS path FROM h),
m AS (SELECT path, arg_min(file, (ordinal, file)) AS file FROM p JOIN f ON ends_with(file, path) OR ends_with(path, file) GROUP BY path)
SELECT id FROM u WHERE EXISTS (SELECT 1 FROM h JOIN m ON m.path = substr(h.file, 5) WHERE m.file = u.file AND (a BETWEEN s AND e OR b BETWEEN s AND e))""",
)
def path_matched_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings know less of the path than the units: 's1.py' is also the ending of no other file here, '1.py' would be."""
    u, h = hot_units(spark, sf_dir)
    return ac.containing_an_end_by_path(u, h.select(F.substr("file", F.lit(5)).alias("path"), "a", "b")).select("id")


@register("first_unit_at_line", HOT_SQL + "SELECT h.file, h.a AS line, arg_min(u.id, (ordinal, u.id)) AS id FROM (SELECT DISTINCT file, a FROM h) h JOIN u ON u.file = h.file AND h.a BETWEEN s AND e GROUP BY 1, 2")
def first_unit_at_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, h = hot_units(spark, sf_dir)
    u = u.withColumn("rank", F.struct("ordinal", "id"))
    return iv.first_range(h, u, "a", "start", "end", "rank", "id").select("file", F.col("line"), F.col("value").alias("id"))
