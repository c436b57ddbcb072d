"""Documents that analysis tools leave behind, read as tables: JSON, JSONL, checkpoints, diffs, test reports, advisories."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import hunk_range


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, by a declared schema; bad documents give a row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def checkpoints(spark: SparkSession, path: str, schema: str = "id string, status string, result string") -> DataFrame:
    """One JSON file a unit, keyed by the id inside; unreadable files and those without an id are left out.

    Of several files with one id that with the greatest path counts."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    names = [f.name for f in rows.schema]
    packed = F.struct(*names)
    rows = rows.where("id IS NOT NULL").select("id", packed.alias("row"), F.input_file_name().alias("file"))
    return rows.groupBy("id").agg(F.max_by("row", "file").alias("row")).select("row.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """scope, changed_files, hunks of a change list; an unknown scope is an error."""
    doc = read_json(spark, path, "scope string, changed_files array<string>, hunks map<string,array<array<int>>>")
    known = F.col("scope").isin("files", "functions", "callers")
    scope = F.when(known, F.col("scope")).otherwise(F.raise_error(F.concat(F.lit("unknown scope: "), F.coalesce("scope", F.lit("none")))))
    files = F.when(F.col("changed_files").isNull(), F.raise_error(F.lit("changed_files must be a list")).cast("array<string>")).otherwise(F.col("changed_files"))
    return doc.select(scope.alias("scope"), files.alias("changed_files"), "hunks")


def diff_lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """key, at (line, from 0), line of unified diffs."""
    return diffs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))


def diff_hunks(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """key, file, a, b: new-side line ranges of unified diffs; pure deletions have none.

    The file of a hunk is the last '+++ ' line before its header, found by a running aggregate in
    the array of the diff's lines, so no diff is shuffled."""
    lines = F.split(text, "\n", -1)
    start = F.struct(F.lit("").alias("file"), F.array().cast("array<struct<file:string,header:string>>").alias("found"))
    name = lambda x: F.regexp_replace(F.regexp_extract(x, "^\\+\\+\\+ ([^\\t]*)", 1), "^b/", "")
    step = lambda acc, x: (
        F.when(x.startswith("+++ "), F.struct(name(x).alias("file"), acc["found"].alias("found")))
        .when(x.rlike("^@@ -\\d"), F.struct(acc["file"].alias("file"), F.array_append(acc["found"], F.struct(acc["file"].alias("file"), x.alias("header"))).alias("found")))
        .otherwise(acc)
    )
    rows = diffs.select(key, F.explode(F.aggregate(lines, start, step, lambda acc: acc["found"])).alias("h"))
    rows = rows.select(key, "h.file", hunk_range(F.col("h.header")).alias("range")).where("range IS NOT NULL AND file <> '/dev/null'")
    return rows.select(key, "file", F.element_at("range", 1).alias("a"), F.element_at("range", 2).alias("b"))


COUNTS = "passed long, failed long, errors long, skipped long, failed_ids array<string>, mode string"


def _junit(text: str | None) -> tuple | None:
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return None
    tally, bad = {"passed": 0, "failure": 0, "error": 0, "skipped": 0}, []
    cases = list(root.iter("testcase"))
    for case in cases:
        kind = next((k for k in ("failure", "error", "skipped") if case.find(k) is not None), "passed")
        tally[kind] += 1
        if kind in ("failure", "error"):
            bad.append("::".join(x for x in (case.get("classname", ""), case.get("name", "")) if x) if case.get("classname") else case.get("name", ""))
    if cases:
        return tally["passed"], tally["failure"], tally["error"], tally["skipped"], bad, "full"
    sums = {k: sum(int(v) if (v := s.get(k, "")).isdecimal() else 0 for s in root.iter("testsuite")) for k in ("tests", "failures", "errors", "skipped")}
    if sums["tests"] <= 0:
        return None
    rest = sums["tests"] - sums["failures"] - sums["errors"] - sums["skipped"]
    return max(rest, 0), sums["failures"], sums["errors"], sums["skipped"], [], "counts_only"


_TAP = re.compile(r"^(not )?ok\b[ \t]*(\d+)?[ \t]*(?:-[ \t]*)?([^#\n]*)(?:#[ \t]*(\w+))?", re.M)


def _tap(text: str | None) -> tuple | None:
    passed = failed = skipped = 0
    bad = []
    for m in _TAP.finditer(text or ""):
        if (m[4] or "").upper() in ("SKIP", "TODO"):
            skipped += 1
        elif m[1]:
            failed += 1
            bad.append(m[3].strip() or m[2] or "")
        else:
            passed += 1
    return (passed, failed, 0, skipped, bad, "full") if passed + failed + skipped else None


def test_counts(text: Column, kind: str) -> Column:
    """Counts of a JUnit XML or TAP report (kind 'junit' or 'tap') as a struct; null where it is none."""
    parse = {"junit": _junit, "tap": _tap}[kind]

    @F.pandas_udf(COUNTS)
    def counts(texts: pd.Series) -> pd.DataFrame:
        names = [c.split()[0] for c in COUNTS.split(", ")]
        return pd.DataFrame([parse(t) or (None,) * len(names) for t in texts], columns=names)

    parsed = counts(text)
    return F.when(parsed["mode"].isNotNull(), parsed)


def first_json_block(text: Column, schema_name: str) -> Column:
    """The first fenced json block (comments stripped, newlines normalised) whose `schema` is schema_name, as text."""
    clean = F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), "(?s)<!--.*?-->", "")
    blocks = F.regexp_extract_all(clean, F.lit("(?s)(?:^|\\n)```json[ \\t]*\\n(.*?)\\n```"), F.lit(1))
    return F.try_element_at(F.filter(blocks, lambda b: F.get_json_object(b, "$.schema") == schema_name), F.lit(1))


# The metric that counts, newest first.
CVSS = ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")
METRIC = "array<struct<cvssData:struct<baseScore:double,baseSeverity:string>,baseSeverity:string>>"
ADVISORY = (
    "struct<id:string,weaknesses:array<struct<description:array<struct<lang:string,value:string>>>>,metrics:struct<" + ",".join(f"{k}:{METRIC}" for k in CVSS)
    + ">,configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string>>>>>>,references:array<struct<url:string>>>"
)


def advisories(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, cve_id, cwes, score, severity, products (five at most, as listed), references of advisory records."""
    r = rows.select(key, F.from_json(text, ADVISORY).alias("c"))
    said = F.flatten(F.coalesce(F.col("c.weaknesses.description"), F.array().cast("array<array<struct<lang:string,value:string>>>")))
    cwes = F.array_distinct(F.transform(F.filter(said, lambda x: (x["lang"] == "en") & (x["value"] != "")), lambda x: x["value"]))
    metric = F.coalesce(*(F.try_element_at(F.col(f"c.metrics.{k}"), F.lit(1)) for k in CVSS))
    score = F.coalesce(metric["cvssData"]["baseScore"].cast("string"), F.lit("N/A"))
    severity = F.upper(F.coalesce(F.nullif(metric["cvssData"]["baseSeverity"], F.lit("")), F.nullif(metric["baseSeverity"], F.lit("")), F.lit("UNKNOWN")))
    cpe = F.flatten(F.transform(F.flatten(F.col("c.configurations.nodes")), lambda n: n["cpeMatch"]))
    products = F.slice(F.array_distinct(F.transform(F.filter(cpe, lambda x: x["vulnerable"] & (x["criteria"] != "")), lambda x: x["criteria"])), 1, 5)
    return r.select(
        key, F.col("c.id").alias("cve_id"), cwes.alias("cwes"), score.alias("score"), severity.alias("severity"),
        F.coalesce(products, F.array().cast("array<string>")).alias("products"), F.slice(F.filter(F.col("c.references.url"), lambda u: u != ""), 1, 5).alias("references"),
    )


def _objects(text: str) -> Iterator[str]:
    """The outermost {...} of a text, braces inside strings not counted."""
    depth = at = 0
    quoted = escaped = False
    for i, ch in enumerate(text):
        if quoted:
            quoted, escaped = (escaped or ch != '"'), (ch == "\\" and not escaped)
        elif ch == '"' and depth:
            quoted, escaped = True, False
        elif ch == "{":
            at = i if not depth else at
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if not depth:
                yield text[at : i + 1]


def json_object(text: Column) -> Column:
    """The only outermost JSON object in prose; null where there is none or more than one that parses."""

    @F.pandas_udf("string")
    def pick(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            good = []
            for span in _objects(t or ""):
                try:
                    good.append(span) if isinstance(json.loads(span), dict) else None
                except ValueError:
                    pass
            return good[0] if len(good) == 1 else None

        return texts.map(one)

    return pick(text)
