"""The report document, step reports, incremental runs and retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import taxonomy as tx
from codeloom.operators import graph as g


def pipeline_findings(results: DataFrame) -> DataFrame:
    """Findings of each repository, once a (file, function, cwe), worst first, numbered, with severity.

    results: repository, file, function, cwe, verdict, stage2.  A rejected finding is left out."""
    seen = results.where(F.col("verdict").isin("vulnerable", "bypassable") & ~F.coalesce(F.col("stage2") == "rejected", F.lit(False)))
    one = seen.groupBy("repository", "file", "function", "cwe").agg(F.min(tx.rank(F.col("verdict"))).alias("rank"), F.min("stage2").alias("stage2"))
    order = Window.partitionBy("repository").orderBy("rank", "file", "function", "cwe")
    word = F.element_at(F.array(*map(F.lit, tx.FINDING_ORDER)), F.col("rank") + 1)
    rows = one.withColumn("number", F.row_number().over(order)).withColumn("verdict", word)
    return rows.select("repository", "number", F.format_string("VULN-%03d", "number").alias("id"), "file", "function", "cwe", "verdict", "stage2", tx.severity(F.col("verdict"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("severity"))


def pipeline_output(results: DataFrame, findings: DataFrame) -> DataFrame:
    """One row a repository: counts of verdicts, and its findings in order as one array."""
    n = lambda word: F.count_if(F.col("verdict") == word).alias(word)
    counts = results.groupBy("repository").agg(F.count(F.lit(1)).alias("total"), *map(n, tx.FINDING_ORDER))
    listed = findings.groupBy("repository").agg(F.array_sort(F.collect_list(F.struct("number", "id", "file", "function", "cwe", "verdict", "stage2", "severity"))).alias("findings"))
    return counts.join(listed, "repository", "left").withColumn("findings", F.coalesce("findings", F.expr("filter(array(named_struct('number', 0, 'id', '', 'file', '', 'function', '', 'cwe', 0, 'verdict', '', 'stage2', '', 'severity', '')), x -> false)").cast(listed.schema["findings"].dataType)))


def step_reports(steps: DataFrame) -> DataFrame:
    """(run, place, step, status, seconds, running_cost) of steps (run, step, at, status, seconds, cost), by time; ties by name."""
    order = Window.partitionBy("run").orderBy("at", "step")
    return steps.select("run", F.row_number().over(order).alias("place"), "step", "status", "seconds", F.round(F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("running_cost"))


def refiltered(units: DataFrame, edges: DataFrame, entries: DataFrame, measured: DataFrame) -> DataFrame:
    """Units (language, node) kept by one closure over all languages; languages without a graph (not in measured), or without entries, keep all."""
    key = lambda d, c: d.withColumn(c, F.struct("language", c))
    keyed_edges = edges.select(F.struct("language", "src").alias("src"), F.struct("language", F.col("dst").alias("src")).alias("dst"))
    reached = g.reachable(keyed_edges, entries.select(F.struct("language", F.col("node").alias("src")).alias("node"))).select(F.col("node.language").alias("language"), F.col("node.src").alias("node"))
    seeded = entries.select("language").distinct().join(measured.select("language").distinct(), "language", "left_semi")
    cut = units.join(seeded, units["language"].eqNullSafe(seeded["language"]), "left_semi")
    return cut.join(reached, ["language", "node"], "left_semi").unionByName(units.join(seeded, units["language"].eqNullSafe(seeded["language"]), "left_anti"))


def changed_units(units: DataFrame, last: DataFrame) -> DataFrame:
    """(node, action) against the last successful run (node, digest): new, changed, unchanged or gone."""
    both = units.select("node", F.col("digest").alias("now")).join(last.select("node", F.col("digest").alias("before")), "node", "full_outer")
    return both.select("node", F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("before"), "unchanged").otherwise("changed").alias("action"))


def retried(rows: DataFrame, step: Callable[[DataFrame, int], DataFrame], failed: Column, most_rounds: int = 3) -> DataFrame:
    """rows (node, ...) through `step(rows, round)`; rows whose result `failed` run again, the last result wins.

    Each round's results are checkpointed, so that no row runs twice in one round."""
    done, left = None, rows
    for i in range(most_rounds + 1):
        out = g._checkpointed(step(left, i))
        again = out.where(failed)
        last = i == most_rounds or again.isEmpty()
        kept = out if last else out.where(~F.coalesce(failed, F.lit(False)))
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        left = left.join(again.select("node"), "node", "left_semi")
    return done


def language_coverage(reports: DataFrame, languages: DataFrame) -> DataFrame:
    """(key, total, missing): each key summed over the languages that report it, the others by name; failed languages are not read.

    reports: language, key, value; languages: language, ok."""
    good = languages.where("ok").select("language")
    own = reports.join(good, "language").groupBy("key").agg(F.sum("value").alias("total"), F.collect_set(F.when(F.col("value").isNotNull(), F.col("language"))).alias("told"))
    names = good.agg(F.collect_set("language").alias("all"))  # one row: the languages of a run
    return own.crossJoin(names).select("key", "total", F.array_join(F.sort_array(F.array_except("all", "told")), ",").alias("missing"))


def units_with_callers(units: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """(node, deps, callers) of units (node): what is called within `hops`, and what calls within `hops`, nearest first."""
    down = g.neighbourhood(edges, units, hops).groupBy(F.col("start").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", F.col("node").alias("n")))), lambda x: x["n"]).alias("deps"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    up = g.neighbourhood(back, units, hops).groupBy(F.col("start").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", F.col("node").alias("n")))), lambda x: x["n"]).alias("callers"))
    return units.select("node").join(down, "node", "left").join(up, "node", "left")
