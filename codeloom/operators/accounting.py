"""Joins and accounting over findings, hunks, checkpoints and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators import intervals as iv
from codeloom.operators.graph import _checkpointed


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key: first-wins or last-wins by what `order` says."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedup_caller_callee(confirmed: DataFrame, edges: DataFrame) -> DataFrame:
    """Drops a callee with exactly one caller if both are confirmed under the same nonzero cwe.

    confirmed: node, cwe, ...; edges: src, dst."""
    single = edges.groupBy("dst").agg(F.count_distinct("src").alias("n"), F.min("src").alias("src")).where("n = 1")
    caller = confirmed.select(F.col("node").alias("src"), F.col("cwe").alias("caller_cwe"))
    callee = confirmed.select(F.col("node").alias("dst"), "cwe")
    drop = single.join(caller, "src").join(callee, "dst").where("caller_cwe = cwe AND cwe <> 0").select(F.col("dst").alias("node")).distinct()
    return confirmed.join(drop, "node", "left_anti")


FEW_RANGES = 1000  # so many ranges or lines are sent to every task instead


def _few(rows: DataFrame, few: int) -> bool:
    return rows.limit(few + 1).count() <= few


def _meeting(units: DataFrame, hunks: DataFrame) -> DataFrame:
    """Distinct (file, start, end) of units that meet a hunk of their file: one of the two starts within the other."""
    hunks = _checkpointed(hunks.select("file", F.col("a").alias("start"), F.col("b").alias("end")).where("file IS NOT NULL").distinct())
    own = iv.distinct_ranges(units, hunks, "start", "end")
    begun = iv.ranges_hit(own, hunks, "start")
    within = iv.lines_hit(own, hunks, "start").withColumnRenamed("line", "start")
    return begun.unionByName(own.join(within, ["file", "start"], "left_semi").select("file", "start", "end")).distinct()


def overlapping(units: DataFrame, hunks: DataFrame, few: int = FEW_RANGES) -> DataFrame:
    """Units whose [start, end] meets a hunk [a, b] of the same file."""
    hunks = hunks.select("file", "a", "b").where("a <= b")
    if _few(hunks, few):
        h = F.broadcast(hunks.select(F.col("file").alias("h_file"), F.col("a").alias("h_a"), F.col("b").alias("h_b")))
        return units.join(h, (F.col("file") == F.col("h_file")) & (F.col("start") <= F.col("end")) & (F.col("start") <= F.col("h_b")) & (F.col("end") >= F.col("h_a")), "left_semi")
    return iv.joined(units, _meeting(units, hunks), ["file", "start", "end"], "left_semi").select(units.columns)


def containing_an_end(units: DataFrame, found: DataFrame, few: int = FEW_RANGES) -> DataFrame:
    """Units in which a finding of the same file starts or ends; one that encloses the unit does not count."""
    ends = found.select("file", F.explode(F.array("a", "b")).alias("line"))
    if _few(ends, few):
        e = F.broadcast(ends.select(F.col("file").alias("e_file"), F.col("line").alias("e_line")))
        return units.join(e, (F.col("file") == F.col("e_file")) & F.col("e_line").between(F.col("start"), F.col("end")), "left_semi")
    ends = _checkpointed(ends.distinct())
    met = iv.ranges_hit(iv.distinct_ranges(units, ends, "start", "end"), ends, "line")
    return iv.joined(units, met, ["file", "start", "end"], "left_semi").select(units.columns)


def containing_an_end_by_path(units: DataFrame, found: DataFrame) -> DataFrame:
    """The same where files are named by more or less of their path: a finding (path, a, b) is of the first
    of the units' files (by `ordinal`) that equals its path, ends with it or that it ends with."""
    files = units.groupBy("file").agg(F.min("ordinal").alias("ordinal"))
    return containing_an_end(units, found.select("path", "a", "b").distinct().join(iv.first_file(found, files), "path").select("file", "a", "b"))


def diff_selected(units: DataFrame, changed: DataFrame, hunks: DataFrame, few: int = FEW_RANGES) -> DataFrame:
    """units with diff_selected: an unchanged file is out, missing lines are in, else by overlap of the unit's own lines.

    Few hunks are one row a file, sent to every task: units are then only read."""
    files = changed.select("file").where("file IS NOT NULL").distinct().withColumn("_changed", F.lit(True))
    out = iv.joined(units, files, ["file"], "left")
    hunks = hunks.select("file", "a", "b").where("a <= b")
    if _few(hunks, few):
        spans = F.broadcast(hunks.groupBy("file").agg(F.collect_list(F.struct("a", "b")).alias("_spans")))
        meets = (F.col("start") <= F.col("end")) & F.exists("_spans", lambda h: (F.col("start") <= h["b"]) & (F.col("end") >= h["a"]))
        out = out.join(spans, "file", "left").withColumn("_hit", meets).drop("_spans")
    else:
        out = iv.joined(out, _meeting(units, hunks).withColumn("_hit", F.lit(True)), ["file", "start", "end"], "left")
    chosen = F.coalesce("_changed", F.lit(False)) & (F.col("start").isNull() | F.col("end").isNull() | F.coalesce("_hit", F.lit(False)))
    return out.select(*units.columns, chosen.alias("diff_selected"))


def merge_last_result(findings: DataFrame, tests: DataFrame, guard: str) -> DataFrame:
    """findings left-joined with the last test of their id whose guard column agrees."""
    last = first_by(tests, ["id"], F.desc("ts"), F.desc("ord")).select("id", F.col("status"), F.col(guard).alias("_guard"))
    out = findings.join(last, "id", "left")
    agrees = F.col("_guard").eqNullSafe(F.col(guard))
    tested = F.when(agrees & F.col("status").isin("CONFIRMED", "NOT_REPRODUCED"), F.col("status"))
    tried = F.when(agrees & ~F.col("status").isin("CONFIRMED", "NOT_REPRODUCED"), F.col("status"))
    return out.withColumn("dynamic_testing", tested).withColumn("dynamic_testing_attempted", tried).drop("status", "_guard")


def language_selection(files: DataFrame, least: int = 5, share: float = 0.02) -> DataFrame:
    """language, n, selected: at least max(least, ceil(share x all)) files, the most frequent always."""
    counts = files.where("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    top = F.row_number().over(Window.orderBy(F.desc("n"), "language")) == 1
    return counts.select("language", "n", (top | (F.col("n") >= F.greatest(F.lit(least), F.ceil(share * total)))).alias("selected"))


def confusion(rows: DataFrame, expected: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn and the ratios, 0 where a denominator is 0."""
    c = rows.agg(
        F.count_if(expected & predicted).alias("tp"), F.count_if(~expected & predicted).alias("fp"),
        F.count_if(expected & ~predicted).alias("fn"), F.count_if(~expected & ~predicted).alias("tn"),
    )
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(
        "tp", "fp", "fn", "tn", F.round(F.coalesce(p, F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(r, F.lit(0.0)), 6).alias("recall"),
        ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def display_ids(keys: DataFrame, widths: tuple[int, ...] = (6, 8, 10, 12)) -> DataFrame:
    """key, display: the shortest prefix that no other distinct key shares, else the whole key."""
    d = keys.select("key").distinct()
    out = F.col("key")
    for w in reversed(widths):
        d = d.withColumn(f"_n{w}", F.count(F.lit(1)).over(Window.partitionBy(F.left("key", F.lit(w)))))
    for w in reversed(widths):
        out = F.when(F.col(f"_n{w}") == 1, F.left("key", F.lit(w))).otherwise(out)
    return d.select("key", out.alias("display"))


def budget_prefix(rows: DataFrame, keys: list[str], size: str, budget: int, *order: Column) -> DataFrame:
    """The longest prefix of each group whose sizes add up to no more than the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def resolve_names(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """wanted(name) to ids of index(id, name): by id, else by name, else by last dotted part."""
    by_name = index.groupBy("name").agg(F.min("id").alias("_by_name"))
    by_last = index.groupBy(F.element_at(F.split("name", "\\."), -1).alias("_last")).agg(F.min("id").alias("_by_last"))
    w = wanted.join(index.select(F.col("id").alias("_id")), F.col("name") == F.col("_id"), "left").join(by_name, "name", "left")
    w = w.withColumn("_last", F.element_at(F.split("name", "\\."), -1)).join(by_last, "_last", "left")
    return w.select("name", F.coalesce("_id", "_by_name", "_by_last").alias("resolved"))
