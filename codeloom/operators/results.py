"""Model replies as rows: containers of untrusted results, and the one shape that a result has afterwards.

Replies are JSON texts, read as variants, so the type of each field is seen before its value.
Bare NaN and Infinity, which some writers emit, count as texts of that name.  A reply that is no
object, no JSON or null has the error shape.  A key that stands twice in an object makes it no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import taxonomy as tx
from codeloom.functions import text as fx

# The verdicts of stage one, and the findings that stand for a verdict.
VERDICTS = ("VULNERABLE", "BYPASSABLE", "INCONCLUSIVE", "PROTECTED", "SAFE", "INSUFFICIENT_CONTEXT", "ERROR")
FINDING_WORDS = ("vulnerable", "safe", "protected", "bypassable", "inconclusive", "insufficient_context")
NUMBER_PIECES = r'(?s)"(?:[^"\\]++|\\.)*+"|-?Infinity|NaN|[^"NI-]++|.'


def parsed(json: Column) -> Column:
    """The variant of a JSON text, null where it is none."""
    word = lambda p: F.when(p.isin("NaN", "Infinity", "-Infinity"), F.concat(F.lit('"'), p, F.lit('"'))).otherwise(p)
    quoted = F.array_join(F.transform(F.regexp_extract_all(json, F.lit(NUMBER_PIECES), F.lit(0)), word), "")
    return F.try_parse_json(F.when(json.rlike("NaN|Infinity"), quoted).otherwise(json))


def kind(v: Column) -> Column:
    """object, array, string, boolean, null or number; null where nothing is."""
    t = F.schema_of_variant(v)
    return F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").when(t.isNotNull(), "number")


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text(v: Column) -> Column:
    """A string as it is, anything else as JSON; null for null."""
    k = kind(v)
    return F.when(k == "string", F.try_variant_get(v, "$", "string")).when(k != "null", F.to_json(v))


def result_objects(containers: DataFrame, key: str = "results") -> DataFrame:
    """containers (id, json) -> id, kept (array of the list's objects as JSON, in order), n_dropped.

    An element that is no object is dropped and counted; something else in the list's place counts as
    one, an empty value or none as nothing."""
    rows = containers.select("id", _field(parsed(F.col("json")), key).alias("v"))
    rows = rows.select("id", kind(F.col("v")).alias("k"), F.to_json("v").alias("j"), F.try_variant_get("v", "$", "array<variant>").alias("list"))
    objects = F.transform(F.filter("list", lambda x: F.coalesce(kind(x) == "object", F.lit(False))), lambda x: F.to_json(x))
    empty = F.coalesce(F.col("k"), F.lit("null")).isin("null") | F.coalesce(F.col("j").isin("{}", '""'), F.lit(False))
    kept = F.when(F.col("k") == "array", objects).otherwise(F.array().cast("array<string>"))
    dropped = F.when(F.col("k") == "array", F.size("list") - F.size(objects)).when(empty, 0).otherwise(1)
    return rows.select("id", kept.alias("kept"), dropped.alias("n_dropped"))


def normalized(replies: DataFrame) -> DataFrame:
    """replies (id, json) -> id and the canonical fields of each result.

    A known verdict stands, upper-cased.  An unknown one is kept as raw_verdict: a usable finding takes
    its place, else the row is an error.  Without a verdict the finding decides; what is no finding's
    word is an error and kept as raw_finding.  Only findings carry a severity: the model's own, or
    high and medium.  A confidence is a finite number in [0, 1]; what is none is kept as raw_confidence.
    """
    v = F.col("v")
    r = replies.select("id", parsed(F.col("json")).alias("v"))
    r = r.select("id", *[_field(v, n).alias(f"f_{n}") for n in ("verdict", "finding", "severity", "cwe_id", "cwe_name", "confidence")])
    r = r.select("*", *[kind(F.col(f"f_{n}")).alias(f"k_{n}") for n in ("verdict", "finding", "severity", "confidence")], *[_text(F.col(f"f_{n}")).alias(n) for n in ("verdict", "finding", "severity", "cwe_id", "cwe_name", "confidence")])
    c = F.col
    said = F.coalesce((c("k_verdict") == "string") & (F.btrim("verdict") != ""), F.lit(False))
    word = F.upper(F.btrim("verdict"))
    text = F.coalesce(c("k_finding") == "string", F.lit(False))
    usable = text & F.lower(F.btrim("finding")).isin(*tx.FINDING_ORDER, tx.ERROR)
    known = said & word.isin(*VERDICTS)
    stands = text & F.lower("finding").isin(*FINDING_WORDS, tx.ERROR)
    verdict = F.when(known, word).when(said & usable, F.upper(F.btrim("finding"))).when(~said & stands, F.upper("finding")).otherwise("ERROR")
    failed = ~known & F.when(said, ~usable).otherwise(~stands)
    odd = failed & c("finding").isNotNull() & (~text | ~said | (F.btrim("finding") != ""))
    ranked = F.when((c("k_severity") == "string") & F.lower(F.btrim("severity")).isin(*tx.SEVERITIES), F.lower(F.btrim("severity")))
    number = F.when(c("k_confidence") == "number", tx.confidence(c("confidence")))
    r = r.withColumns({"w": verdict, "rank": ranked, "number": number, "failed": failed, "odd": odd, "said_raw": said & ~known})
    risky = c("w").isin("VULNERABLE", "BYPASSABLE")
    return r.select(
        "id", c("w").alias("verdict"), F.when(c("failed"), tx.ERROR).otherwise(c("finding")).alias("finding"), F.when(c("said_raw"), c("verdict")).alias("raw_verdict"), F.when(c("odd"), c("finding")).alias("raw_finding"),
        F.when(risky, F.coalesce("rank", F.when(c("w") == "VULNERABLE", "high").otherwise("medium"))).alias("severity"), F.when(risky, F.when(c("rank").isNotNull(), "model").otherwise("derived")).alias("severity_source"),
        fx.coerce_cwe(c("cwe_id")).alias("cwe"), "cwe_name", c("number").alias("confidence"), F.when(c("number").isNull(), c("confidence")).alias("raw_confidence"),
    )
