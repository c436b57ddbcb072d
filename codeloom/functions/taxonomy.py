"""Verdict and severity vocabulary, and the expressions over it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabulary that results must use.
FINDING_ORDER = ("vulnerable", "bypassable", "inconclusive", "protected", "safe")
ERROR = "error"
SEVERITIES = ("critical", "high", "medium", "low")
STAGE2 = ("confirmed", "agreed", "unverified", "rejected")
LEGACY = {"insufficient_context": "inconclusive"}
DISCLOSURE_ELIGIBLE = ("confirmed", "agreed", "unverified", "vulnerable", "bypassable", "error")
DISCLOSURE_DROPPED = ("rejected", "safe", "protected", "inconclusive")
DYNAMIC_TESTABLE = ("confirmed", "agreed", "vulnerable")
PATCH_ELIGIBLE = ("confirmed", "agreed", "vulnerable", "bypassable")


def fold_legacy(finding: Column) -> Column:
    out = finding
    for old, new in LEGACY.items():
        out = F.when(finding == old, new).otherwise(out)
    return out


def rank(finding: Column) -> Column:
    """Place in the order of findings; null for unknown words."""
    out = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(FINDING_ORDER))):
        out = F.when(finding == name, i).otherwise(out)
    return out


def _present(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def counted_bucket(finding: Column, verdict: Column) -> Column:
    """The counting read: finding first, then verdict; legacy words folded, unknown ones are errors."""
    word = fold_legacy(F.lower(F.coalesce(_present(finding), verdict)))
    return F.when(word.isin(*FINDING_ORDER), word).otherwise(ERROR)


def display_verdict(finding: Column, verdict: Column, explanation: Column, reasoning: Column) -> Column:
    word = F.lower(F.btrim(F.coalesce(_present(finding), verdict, F.lit(""))))
    reason = F.btrim(F.coalesce(_present(explanation), reasoning, F.lit("")))
    return F.when(word.isin("vulnerable", "bypassable") & (reason == "Max iterations reached"), "inconclusive").otherwise(word)


def severity(display: Column, stored: Column, source: Column) -> Column:
    """Only findings have one; a model's own rank stays, any other is derived again."""
    derived = F.when(display == "vulnerable", "high").otherwise("medium")
    own = F.when(stored.isin(*SEVERITIES) & (source == "model"), stored).otherwise(derived)
    return F.when(display.isin("vulnerable", "bypassable"), own).otherwise("")


def confidence(raw: Column) -> Column:
    """A stored number clamped to [0, 1]; anything that is no finite number is null."""
    x = raw.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def is_stage2_candidate(finding: Column, classification: Column, cwe: Column, attack_vector: Column) -> Column:
    disagrees = (finding == "safe") & F.coalesce(classification.isin("exploitable", "vulnerable_internal"), F.lit(False))
    unsure = (finding == "inconclusive") & ((F.coalesce(cwe, F.lit(0)) != 0) | (F.btrim(F.coalesce(attack_vector, F.lit(""))) != ""))
    return F.coalesce(finding.isin("vulnerable", "bypassable") | disagrees | unsure, F.lit(False))
