"""Call-graph operators: closures by a frontier loop of joins, bounded neighbourhoods by unrolled joins.

Edges are (src, dst).  Each round joins the frontier with the edges and drops what was visited;
its rows are checkpointed in the shared folder, so lineage stays short and a lost executor costs
one round.  Frontier and visited sets stay distributed at every size.
"""

from __future__ import annotations

import re
import tempfile
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="codeloom-"))
    return df.checkpoint()


MERGE_EVERY = 8


def _union(layers: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, layers)


def _appended(layers: list[DataFrame], layer: DataFrame) -> list[DataFrame]:
    """The visited layers with one more; every few rounds they are written as one, so that a row is rewritten once in so many rounds."""
    layers = [*layers, layer]
    return [_checkpointed(_union(layers))] if len(layers) > MERGE_EVERY else layers


def distances(edges: DataFrame, seeds: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(node, depth) of all nodes reachable from the seeds (column node), seeds at depth 0."""
    edges = _checkpointed(edges.select("src", "dst").where("src <> dst").distinct())
    frontier = _checkpointed(seeds.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    seen, depth = [frontier], 0
    while most_depth is None or depth < most_depth:
        depth += 1
        step = edges.join(frontier, edges["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = _checkpointed(step.join(_union(seen).select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = _appended(seen, frontier)
    return _union(seen)


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The unbounded closure, seeds included even where they are no functions."""
    return distances(edges, seeds).select("node")


def neighbourhood(edges: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """(start, node, depth) within `hops`, the start itself left out; least depth wins.

    A pair that has been met is not walked from again, so a hub or a cycle is passed once a start."""
    walk = _checkpointed(starts.select(F.col("node").alias("start"), "node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    layers = [walk]
    for d in range(1, hops + 1):
        step = walk.join(edges, walk["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        walk = _checkpointed(step.join(_union(layers).select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if walk.isEmpty():
            break
        layers.append(walk)
    return _union(layers[1:]).where("node <> start") if len(layers) > 1 else walk.limit(0)


def degree_statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    out_d = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    in_d = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    d = nodes.select("node").join(out_d, "node", "left").join(in_d, "node", "left").fillna(0)
    return d.agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("out_degree").alias("n_edges"), F.max("out_degree").alias("max_out"), F.max("in_degree").alias("max_in"),
        F.count_if((F.col("out_degree") == 0) & (F.col("in_degree") == 0)).alias("isolated"), F.round(F.avg("out_degree"), 2).alias("avg_out"),
    )


def reachability_filter(units: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Units (column node) that seeds reach; without any seed all units stay."""
    if seeds.isEmpty():
        return units
    return units.join(reachable(edges, seeds), "node", "left_semi")


def prune_buckets(units: DataFrame, kept: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, bucket) of pruned units: orphan without a caller other than itself, else dead_cluster."""
    callers = edges.where("src <> dst").select(F.col("dst").alias("node")).distinct().withColumn("called", F.lit(True))
    gone = units.join(kept, "node", "left_anti").join(callers, "node", "left")
    return gone.select("node", F.when(F.col("called"), "dead_cluster").otherwise("orphan").alias("bucket"))


def entry_paths(edges: DataFrame, entries: DataFrame, most_depth: int = 15) -> DataFrame:
    """(node, path): a shortest call path from an entry point (column node) to every node within most_depth calls.

    Paths have at most most_depth + 1 nodes; of equally short ones the least is taken."""
    edges = _checkpointed(edges.select("src", "dst").where("src <> dst").distinct())
    frontier = _checkpointed(entries.select("node").where("node IS NOT NULL").distinct().withColumn("path", F.array("node")))
    seen = [frontier]
    for _ in range(most_depth):
        step = edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        frontier = _checkpointed(step.groupBy("node").agg(F.min("path").alias("path")).join(_union(seen).select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = _appended(seen, frontier)
    return _union(seen)


def _doublings(n: int) -> int:
    """Rounds after which pointers that double their reach have passed any chain of n nodes."""
    return n.bit_length() + 1


def lineage(parents: DataFrame) -> DataFrame:
    """(node, root, steps, cyclic) of rows (node, parent), by pointer doubling; a null parent is a root.

    A parent that is no node counts as the root.  Chains that run into a cycle have no root."""
    at = _checkpointed(parents.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    # pointers stop at a root, whose own pointer is null
    for _ in range(_doublings(at.count())):
        ahead = at.where("up IS NOT NULL").select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("steps").alias("more"))
        at = _checkpointed(at.join(ahead, "up", "left").select("node", F.coalesce("far", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("far").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            break
    return at.select("node", F.when(~F.col("moved"), F.coalesce("up", "node")).alias("root"), F.when(~F.col("moved"), F.col("steps")).alias("steps"), F.col("moved").alias("cyclic"))


def nearest_ancestor(parents: DataFrame, values: DataFrame) -> DataFrame:
    """(node, value): a node's own value, else that of its nearest ancestor that has one, else null.

    Unset nodes look past their parents, twice as far in each round; cycles without a value give null."""
    at = _checkpointed(parents.join(values, "node", "left").select("node", F.when(F.col("value").isNull(), F.col("parent")).alias("up"), "value"))
    for _ in range(_doublings(at.count())):
        ahead = at.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("value").alias("theirs"))
        at = _checkpointed(at.join(ahead, "up", "left").select("node", F.when(F.col("value").isNull() & F.col("theirs").isNull(), F.col("far")).alias("up"), F.coalesce("value", "theirs").alias("value")))
        if at.where("up IS NOT NULL").isEmpty():
            break
    return at.select("node", "value")


def method_orders(bases: DataFrame) -> DataFrame:
    """(node, chain): the C3 order of each class of rows (node, bases array, nearest first).

    A class is ordered once all its bases are; unknown bases are classes without bases.  A class
    whose bases have no consistent order gets what can be ordered, then the rest as its bases list it; one that
    inherits from itself, or from such a class, gets a null chain."""
    @F.pandas_udf("array<string>")
    def merged(nodes: pd.Series, lists: pd.Series, own: pd.Series) -> pd.Series:
        def one(node, chains, direct) -> list[str] | None:
            if any(c is None for c in chains):
                return None
            todo, out = [[*c] for c in (*chains, direct) if len(c)], [node]
            while todo:
                behind = {x for c in todo for x in c[1:]}
                head = next((c[0] for c in todo if c[0] not in behind), None)
                if head is None:  # no consistent order: what is left, first come first served
                    return list(dict.fromkeys([*out, *(x for c in todo for x in c)]))
                if head == node:
                    return None
                out.append(head)
                todo = [d for c in todo if (d := [x for x in c if x != head])]
            return out

        return pd.Series([one(*x) for x in zip(nodes, lists, own)])

    rows = bases.select(F.col("node").cast("string").alias("node"), F.coalesce("bases", F.array().cast("array<string>")).alias("bases"))
    pairs = rows.select("node", F.posexplode("bases").alias("at", "base"))
    outside = pairs.select(F.col("base").alias("node")).distinct().join(rows, "node", "left_anti").select("node", F.array("node").alias("chain"))
    done = _checkpointed(rows.where("size(bases) = 0").select("node", F.array("node").alias("chain")).unionByName(outside))
    left = _checkpointed(rows.where("size(bases) > 0"))
    while True:  # until no class becomes ready: each round orders one at least
        known = done.select(F.col("node").alias("base"), F.col("chain").alias("above"), F.lit(1).alias("known"))
        ready = left.select("node", "bases", F.posexplode("bases").alias("at", "base")).join(known, "base", "left")
        ready = ready.groupBy("node", "bases").agg(F.count("known").alias("n"), F.array_sort(F.collect_list(F.struct("at", "above"))).alias("above"))
        ready = ready.where("n = size(bases)").select("node", merged("node", F.transform("above", lambda x: x["above"]), "bases").alias("chain"))
        ready = _checkpointed(ready)
        if ready.isEmpty():
            break
        done = _checkpointed(done.unionByName(ready))
        left = _checkpointed(left.join(ready, "node", "left_anti"))
    rest = left.select("node", F.lit(None).cast("array<string>").alias("chain"))
    return done.join(outside, "node", "left_anti").unionByName(rest)
