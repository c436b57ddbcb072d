"""Sinks: tables to CSV, JSON lines, a SARIF document and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import csv_safe

# Columns of the findings export, levels and scores of verdicts.
CSV_COLUMNS = ("file", "unit_id", "unit_description", "unit_code", "severity", "severity_source", "stage2_verdict", "stage2_justification", "stage1_verdict", "stage1_justification", "stage1_confidence", "agentic_classification")
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"


def findings_csv(findings: DataFrame) -> DataFrame:
    """The export's columns, in order, missing ones empty, every cell safe from spreadsheets' formulas."""
    return findings.select(*(csv_safe(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) if c in findings.columns else F.lit("").alias(c) for c in CSV_COLUMNS))


def write_csv(findings: DataFrame, path: str) -> None:
    """Parts with a header each, quoted so that line ends inside cells survive."""
    findings_csv(findings).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def sarif_results(findings: DataFrame, level: Column) -> DataFrame:
    """One SARIF result a finding (file, function, verdict, message, start_line) as JSON text, with its fingerprint."""
    print_of = F.sha2(F.concat_ws("|", "file", "function", "verdict").cast("binary"), 256)
    place = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("verdict").alias("ruleId"), level.alias("level"), F.struct(F.coalesce("message", F.lit("")).alias("text")).alias("message"), place.alias("locations"), F.struct(print_of.alias("primary")).alias("partialFingerprints"))
    return findings.select(F.col("verdict").alias("rule_id"), print_of.alias("fingerprint"), F.to_json(result).alias("result"))


def sarif_document(results: DataFrame, tool: str, version: str) -> DataFrame:
    """The whole document as one row; for reports of a size that one file can hold."""
    rules = F.transform(F.array_sort(F.collect_set("rule_id")), lambda r: F.concat(F.lit('{"id":"'), r, F.lit('"}')))
    head = f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":{{"name":"{tool}","version":"{version}","rules":['
    body = F.array_join(F.array_sort(F.collect_list("result")), ",")
    return results.agg(F.concat(F.lit(head), F.array_join(rules, ","), F.lit(']}},"results":['), body, F.lit("]}]}")).alias("document"))


def markdown_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """line: each row as a Markdown table row; bars in cells are escaped."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "\\|", "\\\\|")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    return rows.select(line.alias("line"))
