"""Terms, bullets and identities in prose and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the endings that a file in prose may have.
FILE_ENDINGS = "py|js|ts|rb|go|java|c|cpp|h|php|cs"
SCHEME_VERSION = 2


def file_paths(text: Column) -> Column:
    """Paths with a known ending, once each in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b([\w][\w/\-]*\.(?:{FILE_ENDINGS}))\b"), F.lit(1)))


def backtick_terms(text: Column, most: int = 15) -> Column:
    """Names of two letters or more after a backtick, once each in order, the first fifteen."""
    found = F.regexp_extract_all(text, F.lit("`([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x) >= 2)), 1, most)


def symbols(text: Column, generic: tuple[str, ...] = (), most: int = 10) -> Column:
    """Backticked names, then snake_case and CamelCase words, of four letters or more, once each, the first ten."""
    kinds = (r"`([A-Za-z_][A-Za-z0-9_]*)\s*\(?", r"\b([a-z][a-z0-9]+(?:_[a-z][a-z0-9]+)+)\b", r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b")
    found = F.concat(*(F.regexp_extract_all(text, F.lit(k), F.lit(1)) for k in kinds))
    return F.slice(F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 4) & ~F.lower(x).isin(*generic, ""))), 1, most)


def bullets(text: Column, most: int = 6) -> Column:
    """Bullet lines without their mark, outer blanks and dots, once each, headings left out, the first six."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r", -1), lambda x: x.rlike(r"^\s*[-*\u2022]\s+"))
    clean = F.transform(lines, lambda x: F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(x, F.lit(" \t")), r"^[\-*\u2022\s]+", ""), r"\s+", " "), F.lit(" .")))
    heading = r"(?i)^(still vulnerable|edge cases|potential issues|potential issue|edge case|summary)\b"
    return F.slice(F.array_distinct(F.filter(clean, lambda x: (x != "") & ~x.rlike(heading))), 1, most)


def name_matches(name: Column, wanted: Column, exact: bool = False) -> Column:
    """Equality, or a part of the name in any case."""
    return name == wanted if exact else F.lower(name).contains(F.lower(wanted))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; nulls are written."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def templates_digest(texts: Column) -> Column:
    """Digest of prompt texts in order; a null text counts as empty."""
    joined = F.array_join(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit(""))), "\x00")
    return F.concat(F.lit("sha256:"), F.sha2(joined.cast("binary"), 256))


def fingerprint(phase: Column, model: Column, provider: Column, adapter: Column, base_url: Column, texts: Column) -> Column:
    """The digest by which checkpoints of one backend are told from another's."""
    key = {"scheme_version": F.lit(SCHEME_VERSION), "phase": phase, "model": model, "provider_name": provider, "adapter_type": adapter, "config_base_url": base_url, "templates_sha": templates_digest(texts)}
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(key).cast("binary"), 256))


def identity_status(stored: Column, present: Column, readable: Column, has_units: Column, now: Column) -> Column:
    """What becomes of stored checkpoints: match, legacy, new, or reset (another backend, or an unreadable stamp)."""
    return (
        F.when(present & ~F.coalesce(readable, F.lit(False)), "reset").when(~present & has_units, "legacy").when(~present, "new").when(stored.eqNullSafe(now), "match").otherwise("reset")
    )
