"""Accounting of verification, checkpoints, usage and steps: one aggregation each.

Rows of verified results have the columns error, incomplete, agree (booleans), finding, verdict
(the stage-one word), stage1_finding, rewritten (a consistency pass changed the finding).
Null booleans count as false; an empty table gives one row of zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import errors
from codeloom.functions import taxonomy as tx


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _word(*names: str) -> Column:
    """The first word given, lower-cased, legacy words folded; '' without one."""
    return tx.fold_legacy(F.lower(F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit(""))))


def verification_outcomes(rows: DataFrame) -> DataFrame:
    """The fourteen counters of a verification run, as one row.

    An errored row is an error before all else; one that could not finish needs review; a finding
    outside the vocabulary is an error.  Rows that came in as inconclusive or safe and were moved
    retire their first count (escalated_*_moved)."""
    r = rows.select(_flag("error").alias("error"), _flag("incomplete").alias("incomplete"), _flag("agree").alias("agree"), _flag("rewritten").alias("rewritten"), _word("finding", "verdict").alias("now"), _word("stage1_finding").alias("origin"), F.lower(F.coalesce("verdict", F.lit(""))).alias("first"))
    now, origin = F.col("now"), F.col("origin")
    known = now.isin(*tx.FINDING_ORDER) | (now == "")
    done = ~F.col("error") & ~F.col("incomplete") & known
    agreed, disagreed = done & F.col("agree"), done & ~F.col("agree")
    worst = now.isin("vulnerable", "bypassable")
    moved = lambda word: (origin == word) & (F.col("error") | (~F.col("incomplete") & (now != word) & (now != "")))
    change = tx.rank(now) - tx.rank(F.col("first"))
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return r.agg(
        count(agreed, "agreed"),
        count(disagreed & ~worst & ~now.isin("inconclusive", "protected") & (origin != "safe"), "disagreed"),
        count(disagreed & (now == "inconclusive") & (origin != "inconclusive"), "disagreed_inconclusive"),
        count(disagreed & (now == "protected"), "disagreed_protected"),
        count(agreed & F.col("rewritten") & (now == "protected"), "consistency_protected"),
        count(agreed & F.col("rewritten") & (now == "safe"), "consistency_safe"),
        count(agreed & F.col("rewritten") & (now == "inconclusive"), "consistency_inconclusive"),
        count(~F.col("error") & F.col("incomplete"), "needs_review"),
        count(done & worst, "confirmed_vulnerabilities"),
        count(F.col("error") | (~F.col("incomplete") & ~known), "error_count"),
        count(done & (change > 0), "downgraded"),
        count(done & (change < 0), "upgraded"),
        count(moved("inconclusive"), "escalated_inconclusive_moved"),
        count(moved("safe"), "escalated_safe_moved"),
    )


def post_verify_metrics(first: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row of metrics after verification, from one row of stage-one counts and one of outcomes.

    first: total, inconclusive, protected, safe, errors.  The buckets still sum to the total."""
    row = first.crossJoin(outcomes)  # one row each
    return row.select(
        "total", F.col("confirmed_vulnerabilities").alias("vulnerable"), F.lit(0).cast("long").alias("bypassable"),
        (F.col("inconclusive") + F.col("disagreed_inconclusive") + F.col("consistency_inconclusive") - F.col("escalated_inconclusive_moved")).alias("inconclusive"),
        (F.col("protected") + F.col("disagreed_protected") + F.col("consistency_protected")).alias("protected"),
        (F.col("safe") + F.col("disagreed") + F.col("consistency_safe") - F.col("escalated_safe_moved")).alias("safe"),
        (F.col("errors") + F.col("error_count")).alias("errors"), "needs_review",
    )


def verified_recount(rows: DataFrame) -> DataFrame:
    """(bucket, n) after verification: errors first, then what needs review, then the finding."""
    word = _word("finding", "verdict")
    bucket = F.when(_flag("error"), "errors").when(_flag("incomplete"), "needs_review").when(word.isin(*tx.FINDING_ORDER), word).otherwise("errors")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def security_class(agent: Column, single: Column) -> Column:
    """A unit's class: the agent's, else the single-shot one."""
    return F.coalesce(agent, single)


def exploitable(units: DataFrame, strict: bool = True) -> DataFrame:
    """Units (security_class) to analyse: exploitable ones, unless strict those with internal flaws too."""
    return units.where(F.col("security_class").isin("exploitable", *(() if strict else ("vulnerable_internal",))))


def class_reduction(units: DataFrame) -> DataFrame:
    """(security_class, n, kept, reduction_percentage): histogram of classes and how much the filter saves."""
    n = units.groupBy("security_class").agg(F.count(F.lit(1)).alias("n"))
    total = units.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("security_class") == "exploitable").alias("kept"))
    return n.crossJoin(F.broadcast(total)).select("security_class", "n", "kept", F.when(F.col("total") > 0, F.round((1 - F.col("kept") / F.col("total")) * 100, 1)).otherwise(0.0).alias("reduction_percentage"))


def gate_open(rows: DataFrame, candidate: Column) -> DataFrame:
    """One row: whether any row is worth a second stage."""
    return rows.agg(F.coalesce(F.bool_or(candidate), F.lit(False)).alias("gate_open"))


def agentic_statistics(units: DataFrame) -> DataFrame:
    """One row over units (has_context, error_type, include_functions, assembly_failed, security_class, iterations).

    A unit with an error counts as nothing but an error; `error_types` is the map of their types, which must be few, to their numbers."""
    has, err = _flag("has_context"), F.col("error_type").isNotNull()
    good = has & ~err
    added = good & ~_flag("assembly_failed") & (F.size("include_functions") > 0)
    cls = lambda *words: F.count_if(good & F.coalesce(F.col("security_class"), F.lit("neutral")).isin(*words))
    known = ("security_control", "exploitable", "vulnerable_internal", "incomplete")
    flat = units.agg(
        F.count_if(good).alias("units_processed"), F.count_if(added).alias("units_with_context"), F.coalesce(F.sum(F.when(good, F.coalesce("iterations", F.lit(0)))), F.lit(0)).alias("total_iterations"),
        F.coalesce(F.sum(F.when(added, F.size("include_functions"))), F.lit(0)).cast("long").alias("functions_added"), cls("security_control").alias("security_controls_found"), cls("exploitable").alias("exploitable_found"),
        cls("vulnerable_internal").alias("vulnerable_found"), cls("incomplete").alias("incomplete_found"), (F.count_if(good) - cls(*known)).alias("neutral_found"), F.count_if(has & err).alias("errors"),
    )
    kinds = error_histogram(units.where(has & err), F.col("error_type")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n")))).alias("error_types"))
    return flat.join(F.broadcast(kinds))  # one row each


def error_histogram(rows: DataFrame, bucket: Column) -> DataFrame:
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# The names under which providers report cached tokens.
CACHE_FIELDS = {
    "cache_read": ("cache_read_input_tokens",),
    "cache_read_inclusive": ("cached_tokens", "cached_content_token_count"),
    "cache_write": ("cache_creation_input_tokens",),
    "cache_write_inclusive": ("cache_write_tokens",),
}


def cache_counts(turns: Column) -> dict[str, Column]:
    """Sums over an array of maps (one a turn, null turns are absent): positive numbers of each family."""
    present = F.filter(turns, lambda t: t.isNotNull())

    def total(names: tuple[str, ...]) -> Column:
        out = F.lit(0).cast("long")
        zero = F.lit(0).cast("long")
        for key in map(F.lit, names):
            positive = F.transform(present, lambda t: F.greatest(F.coalesce(F.try_element_at(t, key).cast("long"), zero), zero))  # noqa: B023  used at once
            out = out + F.aggregate(positive, zero, lambda a, x: a + x)
        return out

    return {name: F.coalesce(total(fields), F.lit(0).cast("long")) for name, fields in CACHE_FIELDS.items()}


def usage_totals(calls: DataFrame) -> DataFrame:
    """One row over calls (model, input_tokens, output_tokens, cost; a null cost is an unpriced model)."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return calls.agg(
        F.count(F.lit(1)).alias("calls"), n("input_tokens").alias("input_tokens"), n("output_tokens").alias("output_tokens"), n(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("cost").isNull(), F.col("model")))), ",").alias("unpriced_models"),
    )


def merged_usage(parts: DataFrame) -> DataFrame:
    """One row a group (name): sums of the parts' usage and their details in order of part."""
    details = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "details"))), lambda x: x["details"]))
    return parts.groupBy("name").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.array_join(details, ",").alias("details"))


def step_deltas(snapshots: DataFrame) -> DataFrame:
    """run, step, deltas of running totals (tokens, cost) against the run's step before, and the step's status.

    Rows: run, step, tokens, cost, failed, interrupted, error_count, incomplete_count."""
    own = Window.partitionBy("run").orderBy("step")
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    status = F.when(_flag("failed"), "error").when(_flag("interrupted"), "interrupted").when(positive("error_count") | positive("incomplete_count"), "partial").otherwise("success")
    return snapshots.select(
        "run", "step", (F.col("tokens") - F.coalesce(F.lag("tokens").over(own), F.lit(0))).alias("tokens"),
        F.round(F.col("cost") - F.coalesce(F.lag("cost").over(own), F.lit(0.0)), 6).alias("cost"), status.alias("status"),
    )


def checkpoint_state(rows: DataFrame) -> DataFrame:
    """rows with state (completed, incomplete, errors) and error_type.

    Rows: id, readable, context_error (type), has_result, verdict, finding, has_verification,
    verification_empty, correct_finding, incomplete, status, details, error (top level), security_class.
    A context error wins over a result, that over a verification, that over a test status; a
    top-level error makes any other state an error."""
    v_error = _flag("verification_empty") | F.coalesce(F.col("correct_finding") == "error", F.lit(False))
    kind = (
        F.when(~F.coalesce("readable", F.lit(True)), "unreadable")
        .when(F.coalesce("id", F.lit("")) == "", "missing_id")
        .when(F.col("context_error").isNotNull(), F.col("context_error"))
        .when(_flag("has_result"), F.when(errors.stage1_is_error(F.col("verdict"), F.col("finding")), "analysis_error"))
        .when(_flag("has_verification"), F.when(v_error, "verification_error"))
        .when(F.coalesce(F.col("status") == "ERROR", F.lit(False)), errors.dynamic_test_category(F.col("details")))
    )
    kind = F.coalesce(kind, F.when(_flag("error"), "error_key"))
    by_arm = F.col("context_error").isNull() & ~_flag("has_result") & _flag("has_verification") & _flag("incomplete")
    waiting = by_arm | F.coalesce(F.col("security_class") == "incomplete", F.lit(False))
    return rows.withColumn("error_type", kind).withColumn("state", F.when(F.col("error_type").isNotNull(), "errors").when(waiting, "incomplete").otherwise("completed"))


def checkpoint_summary(rows: DataFrame) -> DataFrame:
    """(step, completed, incomplete, errors, total) of checkpoint rows by step."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return checkpoint_state(rows).groupBy("step").agg(count("completed"), count("incomplete"), count("errors"), F.count(F.lit(1)).alias("total"))


def dynamic_test_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n) of test checkpoints (status, details): completed, errors, and error:<category>; a timed-out test that completed counts as a timeout too."""
    category = F.concat(F.lit("error:"), errors.dynamic_test_category(F.col("details")))
    failed = F.coalesce(F.col("status") == "ERROR", F.lit(False))
    late = F.when(F.btrim("details").startswith("Container execution timed out"), "error:timeout")
    return rows.select(F.explode(F.array_compact(F.array(F.when(failed, "errors").otherwise("completed"), F.when(failed, category).otherwise(late)))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def summed_maps(rows: DataFrame, column: str) -> DataFrame:
    """(key, n): the sums of a map column's values over all rows."""
    return rows.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("n"))


def promotable_skips(by_class: Column, promote: tuple[str, ...]) -> Column:
    """How many skipped signals of a map 'kind/confidence' -> n could have promoted an entry point."""
    hits = F.filter(F.map_entries(by_class), lambda e: e["key"].isin(*(f"entry_point/{p}" for p in promote)))
    return F.coalesce(F.aggregate(hits, F.lit(0).cast("long"), lambda a, e: a + e["value"]), F.lit(0).cast("long"))


def reachability_totals(records: DataFrame, most_files: int = 20) -> DataFrame:
    """(kind, key, n) over per-language records (language, orphan, dead, by_file map, advisory): sums, the top files, advisories by language.

    A null count was not measured and adds nothing; no count at all gives no row."""
    sums = records.agg(F.sum("orphan").alias("pruned_orphan_count"), F.sum("dead").alias("pruned_in_dead_cluster_count"), F.count("orphan").alias("reachability_baseline_languages"))
    names = ("pruned_orphan_count", "pruned_in_dead_cluster_count", "reachability_baseline_languages")
    sums = sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).alias("n")) for n in names))).alias("x")).select(F.lit("count").alias("kind"), "x.key", "x.n").where("n IS NOT NULL")
    files = summed_maps(records, "by_file").orderBy(F.desc("n"), "key").limit(most_files).select(F.lit("file").alias("kind"), "key", "n")
    told = records.where("advisory <> ''").select(F.lit("advisory").alias("kind"), F.concat_ws(": ", "language", "advisory").alias("key"), F.lit(None).cast("long").alias("n"))
    return sums.unionByName(files).unionByName(told)


def smoke_score(flagged: DataFrame, expected: DataFrame, units: DataFrame) -> DataFrame:
    """(unit_id, outcome): missed, unexpected or hit; flagged ids that no unit has are 'unknown', ids flagged twice 'duplicate'."""
    n = flagged.groupBy("unit_id").agg(F.count(F.lit(1)).alias("times"))
    both = n.join(expected.select("unit_id").distinct().withColumn("wanted", F.lit(True)), "unit_id", "full_outer").join(units.select("unit_id").distinct().withColumn("known", F.lit(True)), "unit_id", "left")
    outcome = F.when(F.col("times").isNotNull() & F.col("known").isNull(), "unknown").when(F.col("times") > 1, "duplicate").when(F.col("times").isNull(), "missed").when(F.col("wanted").isNull(), "unexpected").otherwise("hit")
    return both.select("unit_id", outcome.alias("outcome"))


def index_statistics(functions: DataFrame) -> DataFrame:
    """One row over functions (file, name): totals and the most functions of a file."""
    per_file = functions.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("total_files"), F.max("n").alias("most_in_a_file"))
    return functions.agg(F.count(F.lit(1)).alias("total_functions"), F.count_distinct("name").alias("unique_names")).crossJoin(per_file)  # one row each


def is_stale_checkpoint(stored: Column, now: Column, sentinels: tuple[str, ...] = ("incomplete", "error", "unknown")) -> Column:
    """A checkpoint stamped with a sentinel class whose unit has a real class by now."""
    return F.coalesce(stored.isin(*sentinels) & now.isNotNull() & ~now.isin(*sentinels), F.lit(False))
