"""Classes of errors: what may be run again, and the bucket that a summary counts an error in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and codes that decide.
STAGE1_VERDICTS = ("VULNERABLE", "BYPASSABLE", "INCONCLUSIVE", "PROTECTED", "SAFE", "INSUFFICIENT_CONTEXT", "ERROR")
RETRYABLE_TYPES = ("rate_limit", "connection", "timeout", "parse_error")
RETRYABLE_CODES = ("500", "502", "503", "504", "520", "522", "523", "524", "529")
RETRYABLE_WORDS = ("rate_limit", "connection", "timeout", "overloaded", "no usable content", "empty completion")
REFUSAL = "refused the request"
BUDGET_WORDS = ("output budget was consumed", "consumed the token budget", "reasoning consumed the budget")
OVERFLOW_WORDS = ("prompt is too long", "maximum context length", "context_length_exceeded", "exceeds the maximum number of input tokens", "input token count", "exceed context limit")
PAYLOAD_WORDS = ("total text input size exceeds", "request too large", "payload too large", "request entity too large")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def stage1_is_error(verdict: Column, finding: Column) -> Column:
    """Verdict first: an explicit error, neither word given, or a verdict outside the vocabulary."""
    word, other = F.btrim(F.coalesce(verdict, F.lit(""))), F.btrim(F.coalesce(finding, F.lit("")))
    explicit = F.coalesce(verdict == "ERROR", F.lit(False)) | F.coalesce(finding == "error", F.lit(False))
    return explicit | ((word == "") & (other == "")) | ((word != "") & ~F.upper(word).isin(*STAGE1_VERDICTS))


def is_rate_limited(kind: Column, message: Column) -> Column:
    """kind: the type of a structured error, null for an error that is only a message."""
    return F.when(kind.isNotNull(), kind == "rate_limit").otherwise(F.coalesce(F.lower(message).contains("rate_limit"), F.lit(False)))


def message_is_retryable(message: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    codes = F.regexp_extract_all(text, F.lit(r"\b(5\d{2})\b"), F.lit(1))
    return ~text.contains(REFUSAL) & (F.arrays_overlap(codes, F.array(*map(F.lit, RETRYABLE_CODES))) | _any(text, RETRYABLE_WORDS))


def is_retryable(kind: Column, message: Column, status: Column, limit_kind: Column) -> Column:
    """Whether an error may pass when it is tried again; a spent quota and a refusal do not."""
    text = F.lower(F.coalesce(message, F.lit("")))
    empty = ~text.contains(REFUSAL) & (text.contains("no usable content") | text.contains("empty completion"))
    structured = (
        F.when((kind == "rate_limit") & F.coalesce(limit_kind == "quota", F.lit(False)), False)
        .when(kind.isin(*RETRYABLE_TYPES) | (kind == "empty_completion"), True)
        .when(kind == "api_status", empty | (F.coalesce(status, F.lit(0)) >= 500))
        .otherwise(False)
    )
    return F.when(kind.isNotNull(), structured).otherwise(message_is_retryable(message))


def is_budget_exhausted(message: Column) -> Column:
    return _any(F.coalesce(message, F.lit("")), BUDGET_WORDS)


def summary_bucket(kind: Column, message: Column, status: Column, limit_kind: Column) -> Column:
    """The class that a summary counts an error in, most telling sign first."""
    text = F.lower(F.coalesce(message, F.lit("")))
    code = F.regexp_extract(text, r"error code: (\d{3})\b", 1)
    is_ = lambda c, v: F.coalesce(c == v, F.lit(False))
    return (
        F.when(_any(text, OVERFLOW_WORDS), "context_overflow")
        .when(is_(kind, "parse_error"), "api")
        .when(is_(kind, "rate_limit"), F.when(is_(limit_kind, "quota"), "quota").otherwise("rate_limit"))
        .when(kind.isNotNull() & is_(status, 402), "payment_required")
        .when(kind.isNotNull() & is_(status, 429), "rate_limit")
        .when(_any(text, PAYLOAD_WORDS), "payload_too_large")
        .when(text.startswith("llmratelimiterror"), "rate_limit")
        .when(code == "429", "rate_limit")
        .when(code == "402", "payment_required")
        .when(code != "", "api")
        .when(text.rlike(r"\b429\b") | text.contains("too many requests"), "rate_limit")
        .when(text.rlike(r"\b402\b") | text.contains("payment required"), "payment_required")
        .otherwise("api")
    )


def dynamic_test_category(details: Column) -> Column:
    """The stage in which a dynamic test failed."""
    text = F.btrim(F.coalesce(details, F.lit("")))
    return (
        F.when(text.startswith("Test generation"), "generation")
        .when(text.startswith("Docker build failed"), "build")
        .when(text.startswith("Container execution timed out"), "timeout")
        .when(text.startswith("Docker execution was not attempted") | text.startswith("Container did not produce valid JSON output"), "execution")
        .otherwise("other")
    )
