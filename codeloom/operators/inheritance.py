"""Calls through class hierarchies, and hierarchies as nested intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import prefix
from codeloom.operators.graph import _checkpointed, method_orders


def places(orders: DataFrame) -> DataFrame:
    """(cls, place, above) of the class orders (node, chain): the class itself has place 0; a class without an order is its own only ancestor."""
    return orders.select(F.col("node").alias("cls"), F.posexplode(F.coalesce("chain", F.array("node"))).alias("place", "above"))


def receiver_types(calls: DataFrame, classes: DataFrame, imports: DataFrame) -> DataFrame:
    """calls (call, file, receiver, ...) with cls, the class that the receiver's type name means in the file.

    classes: cls, file, name; imports: file, name, target_file, target_name.  A class of the same file
    first; else what the name is imported from, and an import that finds nothing ends the search;
    else the only class of that name, if there is one.  Names are reduced to one row a file before they meet."""
    wanted = calls.select("file", F.col("receiver").alias("name")).where("name IS NOT NULL").distinct()
    here = classes.groupBy("file", "name").agg(F.min("cls").alias("here"))
    named = imports.groupBy("file", "name").agg(F.min(F.struct("target_file", F.coalesce("target_name", "name").alias("target_name"))).alias("t")).select("file", "name", "t.*")
    there = classes.groupBy(F.col("file").alias("target_file"), F.col("name").alias("target_name")).agg(F.min("cls").alias("there"))
    lone = classes.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("lone")).where("n = 1").drop("n")
    w = wanted.join(here, ["file", "name"], "left").join(named, ["file", "name"], "left").join(there, ["target_file", "target_name"], "left").join(lone, "name", "left")
    w = w.select("file", F.col("name").alias("receiver"), F.when(F.col("here").isNotNull(), F.col("here")).when(F.col("target_name").isNotNull(), F.col("there")).otherwise(F.col("lone")).alias("cls"))
    return calls.join(w, ["file", "receiver"], "left")


def inherited_calls(calls: DataFrame, chain_places: DataFrame, methods: DataFrame) -> DataFrame:
    """calls (call, cls, method, is_super) with id and defined_in: the first class of cls's order that has the method.

    `super` begins after the class itself; a null class (a receiver of no known type, a failed import)
    gives null, and never a method of the same name elsewhere.  methods: cls, method, id.

    Equal (cls, method) are one row until the end, so that a receiver type which many calls share is
    resolved once.  A class's own methods are looked up directly; only what they don't answer walks the
    order behind the class, and classes with the same order behind them walk it once for all."""
    own = methods.select("cls", "method", "id").groupBy("cls", "method").agg(F.min("id").alias("id"))
    from_super = F.coalesce("is_super", F.lit(False))
    wanted = calls.where("cls IS NOT NULL AND method IS NOT NULL").groupBy("cls", "method").agg(F.max(from_super).alias("up"))
    wanted = wanted.join(own.withColumnRenamed("id", "own_id").withColumn("has", F.lit(True)), ["cls", "method"], "left")
    orders = chain_places.groupBy("cls").agg(F.array_sort(F.collect_list(F.when(F.col("place") > 0, F.struct("place", "above")))).alias("behind"))
    orders = orders.select("cls", "behind", *(F.when(F.size("behind") > 0, F.xxhash64(F.lit(i), "behind")).alias(f"t{i}") for i in (1, 2)))
    asked = wanted.join(orders.select("cls", "t1", "t2"), "cls")
    walks = F.col("up") | F.col("has").isNull()
    tried = asked.where(walks & F.col("t1").isNotNull()).select("t1", "t2", "method").distinct()
    lines = orders.where("t1 IS NOT NULL").groupBy("t1", "t2").agg(F.first("behind").alias("behind")).select("t1", "t2", F.explode("behind").alias("b")).select("t1", "t2", "b.place", F.col("b.above").alias("cls"))
    behind = tried.join(lines, ["t1", "t2"]).join(own, ["cls", "method"]).groupBy("t1", "t2", "method").agg(F.min(F.struct("place", "cls", "id")).alias("b"))
    key = [F.when(walks, F.col(t)).alias(t) for t in ("t1", "t2")]  # null meets nothing
    found = asked.select("cls", "method", "has", "own_id", *key).join(behind, ["t1", "t2", "method"], "left").where("has OR b IS NOT NULL").select("cls", "method", "has", "own_id", "b")
    out = calls.join(found, ["cls", "method"], "left")
    at_class = ~from_super & F.col("has")
    picked = {"defined_in": F.when(at_class, F.col("cls")).otherwise(F.col("b.cls")), "id": F.when(at_class, F.col("own_id")).otherwise(F.col("b.id"))}
    return out.select("cls", "method", *(c for c in calls.columns if c not in ("cls", "method")), *(c.alias(n) for n, c in picked.items()))


def nested_intervals(parents: DataFrame) -> DataFrame:
    """(node, parent, depth, lo, hi) of a forest (node, parent): a node's descendants, and only they, have lo within (its lo, its hi).

    A parent that is no node counts as none.  Nodes on or below a cycle get no interval and are left out.
    Depths go down a level a round, sizes up, and the place among the earlier siblings' sizes comes
    from one running total over all nodes in (depth, parent, node) order, so that a class with any number
    of direct subclasses is no group of its own."""
    rows = parents.select("node", "parent").where("node IS NOT NULL").groupBy("node").agg(F.min("parent").alias("parent"))
    known = rows.select(F.col("node").alias("k"))
    rows = _checkpointed(rows.join(known, F.col("parent") == F.col("k"), "left").select("node", F.col("k").alias("parent")))
    level = _checkpointed(rows.where("parent IS NULL").withColumn("depth", F.lit(0)))
    layers = []
    while not level.isEmpty():
        layers.append(level)
        up = level.select(F.col("node").alias("u"), (F.col("depth") + 1).alias("depth"))
        level = _checkpointed(rows.join(up, F.col("parent") == F.col("u")).select("node", "parent", "depth"))
    if not layers:
        return rows.select("node", "parent", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi")).limit(0)
    sized, below = [], None
    for layer in reversed(layers):
        size = layer.withColumn("size", F.lit(1).cast("long"))
        if below is not None:
            sums = below.groupBy(F.col("parent").alias("s")).agg(F.sum("size").alias("more"))
            size = layer.join(sums, F.col("node") == F.col("s"), "left").select("node", "parent", "depth", (F.coalesce("more", F.lit(0)) + 1).alias("size"))
        below = _checkpointed(size)
        sized.append(below)
    everyone = sized[0]
    for s in sized[1:]:
        everyone = everyone.unionByName(s)
    total = prefix.carried(prefix.ordered(everyone, F.col("depth"), F.col("parent"), F.col("node")), {"total": F.col("size")})
    total = prefix.plain(total).withColumn("before", F.col("total") - F.col("size")).drop("total")
    first = total.groupBy("depth", F.col("parent").alias("p")).agg(F.min("before").alias("base"))
    placed = total.alias("t").join(first.alias("f"), (F.col("t.depth") == F.col("f.depth")) & F.col("t.parent").eqNullSafe(F.col("p"))).select("node", "parent", "t.depth", "size", (F.col("before") - F.col("base")).alias("offset"))
    placed = _checkpointed(placed)
    out = _checkpointed(placed.where("depth = 0").select("node", "parent", "depth", F.col("offset").alias("lo"), (F.col("offset") + F.col("size")).alias("hi")))
    done = [out]
    for depth in range(1, len(layers)):
        up = out.select(F.col("node").alias("u"), (F.col("lo") + 1).alias("start"))
        out = placed.where(F.col("depth") == depth).join(up, F.col("parent") == F.col("u"))
        out = _checkpointed(out.select("node", "parent", "depth", (F.col("start") + F.col("offset")).alias("lo"), (F.col("start") + F.col("offset") + F.col("size")).alias("hi")))
        done.append(out)
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def is_subtype(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs (sub, base) with is_subtype, by two look-ups of labels: no closure. A class is its own subtype; unknown classes are none."""
    a = labels.select(F.col("node").alias("sub"), F.col("lo").alias("a_lo"))
    b = labels.select(F.col("node").alias("base"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    inside = (F.col("a_lo") >= F.col("b_lo")) & (F.col("a_lo") < F.col("b_hi"))
    return pairs.join(a, "sub", "left").join(b, "base", "left").select(*pairs.columns, F.coalesce(inside, F.lit(False)).alias("is_subtype"))


def inherit_closure(bases: DataFrame) -> DataFrame:
    """(sub, base) of all proper ancestors over (node, base), classes with several bases and cycles included.

    Pairs are extended by squaring: each round joins what is known with itself and keeps what is new,
    so a chain of n classes takes log n rounds.  A class on a cycle is its own ancestor."""
    pairs = _checkpointed(bases.select(F.col("node").alias("sub"), "base").where("sub IS NOT NULL AND base IS NOT NULL").distinct())
    while True:
        longer = pairs.join(pairs.select(F.col("sub").alias("base"), F.col("base").alias("far")), "base").select("sub", F.col("far").alias("base"))
        more = _checkpointed(longer.distinct().join(pairs, ["sub", "base"], "left_anti"))
        if more.isEmpty():
            return pairs
        pairs = _checkpointed(pairs.unionByName(more))


__all__ = ["inherit_closure", "inherited_calls", "is_subtype", "method_orders", "nested_intervals", "places", "receiver_types"]
