"""Entry points, reachability signals, and the checks that untrusted documents must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reasons that mark a real entry point, and the words a signal may use.
STRUCTURAL_REASONS = ("unit_type", "decorator", "name")
SIGNAL_KINDS = ("entry_point", "external_input", "cross_process")
CONFIDENCES = ("high", "medium", "low")
PROMOTE_AT = ("high",)


def real_entries(entries: DataFrame, functions: DataFrame) -> DataFrame:
    """Entries (node) that are no synthetic harness; functions: node, synthetic (null is false)."""
    return entries.join(functions.where("synthetic").select("node"), "node", "left_anti")


def is_non_runtime_main(path: Column) -> Column:
    """A build script, example or benchmark: build.rs, or below examples/ or benches/, never below src/."""
    parts = F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/", -1)
    above = F.slice(parts, 1, F.size(parts) - 1)
    aux = F.array_contains(above, "examples") | F.array_contains(above, "benches")
    return ~F.array_contains(above, "src") & ((F.element_at(parts, -1) == "build.rs") | aux)


def entry_statistics(entries: DataFrame, functions: DataFrame) -> DataFrame:
    """(kind, key, n) of entries (node, unit_type, reasons): by type, by reason category, and the totals."""
    kinds = entries.groupBy(F.lit("unit_type").alias("kind"), F.coalesce("unit_type", F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    reasons = entries.select(F.explode("reasons").alias("reason")).groupBy(F.lit("reason").alias("kind"), F.substring_index("reason", ":", 1).alias("key")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    n = entries.agg(F.count(F.lit(1)).alias("e")).crossJoin(functions.agg(F.count(F.lit(1)).alias("f")))  # one row each
    percent = F.when(F.col("f") > 0, F.round(F.col("e") / F.col("f") * 100, 1)).otherwise(0.0)
    totals = n.select(F.explode(F.array(F.struct(F.lit("total_entry_points").alias("key"), F.col("e").cast("double").alias("n")), F.struct(F.lit("total_functions").alias("key"), F.col("f").cast("double").alias("n")), F.struct(F.lit("entry_point_percentage").alias("key"), percent.alias("n")))).alias("x"))
    return kinds.unionByName(reasons).unionByName(totals.select(F.lit("total").alias("kind"), "x.key", "x.n"))


def seed_classes(entries: DataFrame) -> DataFrame:
    """One row: structural and incidental entries, harnesses and non-runtime mains left out."""
    counted = ~F.coalesce("synthetic", F.lit(False)) & ~F.coalesce("non_runtime_main", F.lit(False))
    structural = F.exists("reasons", lambda r: F.substring_index(r, ":", 1).isin(*STRUCTURAL_REASONS))
    return entries.agg(F.count_if(counted & structural).alias("structural"), F.count_if(counted & ~F.coalesce(structural, F.lit(False))).alias("incidental"), F.count(F.lit(1)).alias("entries"))


def blackout(counts: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row of (original, kept, structural, incidental, entries, extra, library_mode) with the kind of warning, or null.

    Nothing is ever filtered by it: 'total', or 'structureless' with who seeded the run (extra,
    mixed, incidental) and whether the core may have been dropped."""
    reduced = (1 - F.col("kept") / F.col("original")) >= threshold
    who = F.when((F.col("entries") == 0) & (F.col("extra") > 0), "extra").when(F.col("entries") == 0, None).when(F.col("extra") > 0, "mixed").otherwise("incidental")
    kind = F.when((F.col("original") <= 0) | F.col("library_mode"), None).when(F.col("kept") == 0, "total").when(F.col("structural") == 0, F.concat(who, F.when(reduced, ":core").otherwise(":partial")))
    return counts.withColumn("warning", kind)


def parsed_signals(items: DataFrame, units: DataFrame) -> DataFrame:
    """Raw signals (unit_id, kind, confidence, reason) with outcome: kept, or why not (first rule that fails).

    The reason is cut to 500 characters; ids must be those of units (node)."""
    known = units.select(F.col("node").alias("unit_id")).distinct().withColumn("known", F.lit(True))
    outcome = (
        F.when(F.coalesce("unit_id", F.lit("")) == "", "missing_id")
        .when(~F.coalesce(F.col("kind").isin(*SIGNAL_KINDS), F.lit(False)), "bad_kind")
        .when(~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False)), "bad_confidence")
        .when(F.col("known").isNull(), "unknown_unit_id")
        .otherwise("kept")
    )
    return items.join(known, "unit_id", "left").select("unit_id", "kind", "confidence", F.substring(F.coalesce("reason", F.lit("")), 1, 500).alias("reason"), outcome.alias("outcome"))


def applied_signals(units: DataFrame, signals: DataFrame, promote_at: tuple[str, ...] = PROMOTE_AT) -> DataFrame:
    """units (node, is_entry_point) with n_signals, is_entry_point promoted where a sure signal says so, and the reason.

    signals: unit_id, ordinal, kind, confidence, reason; the first promoting one gives the reason.
    Signals of unknown units change nothing."""
    sure = (F.col("kind") == "entry_point") & F.col("confidence").isin(*promote_at)
    own = signals.groupBy(F.col("unit_id").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.when(sure, F.col("reason")), F.when(sure, F.col("ordinal"))).alias("why"), F.bool_or(F.coalesce(sure, F.lit(False))).alias("sure"))
    before = F.coalesce("is_entry_point", F.lit(False))
    promoted = F.coalesce("sure", F.lit(False)) & ~before
    return units.join(own, "node", "left").select("node", (before | promoted).alias("is_entry_point"), F.when(promoted, F.concat(F.lit("llm_reachability: "), F.coalesce("why", F.lit("")))).alias("entry_point_reason"), F.coalesce("n", F.lit(0)).alias("n_signals"))


def entries_of_units(entries: DataFrame, units: DataFrame) -> DataFrame:
    return entries.join(units.select("node").where("node IS NOT NULL"), "node", "left_semi").distinct()


def _compact(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(True)), message) for broken, message in rules)))


def unit_errors(has_boundary: Column) -> Column:
    """Names of the rules that a unit (id, primary_code, deps_inlined, files_included) breaks, in order."""
    files, inlined = F.col("files_included"), F.coalesce("deps_inlined", F.lit(False))
    n = F.when(files.isNull(), 0).otherwise(F.size(files))
    return _compact(
        (F.coalesce("id", F.lit("")) == "", "missing id"), (F.coalesce("primary_code", F.lit("")) == "", "empty primary_code"), (F.col("deps_inlined").isNull(), "missing deps_inlined"),
        (files.isNull(), "missing files_included"), (inlined & (n == 0), "inlined without files"), (inlined & (n > 1) & ~has_boundary, "several files without boundary"),
    )


# What a report document and each of its findings must have.
OUTPUT_FIELDS = ("repository", "analysis_date", "application_type", "pipeline_stats", "results", "findings")
FINDING_FIELDS = ("id", "name", "short_name", "location", "cwe_id", "cwe_name", "stage1_verdict", "stage2_verdict")


def missing_fields(keys: Column, required: tuple[str, ...]) -> Column:
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(keys, F.array().cast("array<string>")))


def threat_model_violations(components: DataFrame, sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """(violation, name, reference) of a threat model in tables: bad words, and references to what is not there.

    components: name; sources: name, trust, component; profiles: name, position, source."""
    trust, position = ("trusted", "semi_trusted", "untrusted"), ("remote", "adjacent", "local", "physical", "supply_chain")
    bad = sources.where(~F.coalesce(F.col("trust").isin(*trust), F.lit(False))).select(F.lit("bad_trust").alias("violation"), "name", F.col("trust").alias("reference"))
    odd = profiles.where(~F.coalesce(F.col("position").isin(*position), F.lit(False))).select(F.lit("bad_position").alias("violation"), "name", F.col("position").alias("reference"))
    no_component = sources.where("component IS NOT NULL").join(components.select(F.col("name").alias("component")), "component", "left_anti").select(F.lit("unknown_component").alias("violation"), "name", F.col("component").alias("reference"))
    no_source = profiles.where("source IS NOT NULL").join(sources.select(F.col("name").alias("source")), "source", "left_anti").select(F.lit("unknown_source").alias("violation"), "name", F.col("source").alias("reference"))
    return bad.unionByName(odd).unionByName(no_component).unionByName(no_source)


def permissive_warnings(models: DataFrame) -> DataFrame:
    """model and its warnings; rows: model, trusts, positions, n_criteria, n_excluded.

    Every input trusted; no attacker from outside; far more is excluded than reported."""
    outside = F.arrays_overlap("positions", F.array(*map(F.lit, ("remote", "adjacent", "supply_chain"))))
    rules = (
        ((F.size("trusts") > 0) & F.forall("trusts", lambda t: F.lower(t) == "trusted"), "all_trusted"),
        ((F.size("positions") > 0) & ~F.coalesce(outside, F.lit(False)), "local_only"),
        (F.col("n_excluded") > 3 * F.greatest(F.col("n_criteria"), F.lit(1)), "mostly_excluded"),
    )
    return models.select("model", F.array_join(_compact(*rules), ",").alias("warnings"))


def untrusted_boundaries(boundaries: Column) -> Column:
    """Sources of a map source -> level that are untrusted."""
    return F.map_keys(F.map_filter(boundaries, lambda k, v: F.coalesce(F.lower(v).contains("untrusted"), F.lit(False))))


def suppresses_local_only(requires_remote: Column, boundaries: Column) -> Column:
    return ~F.coalesce(requires_remote, F.lit(False)) & (F.size(untrusted_boundaries(boundaries)) == 0)
