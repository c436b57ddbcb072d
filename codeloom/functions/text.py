"""Scalar functions over ids, prose, code and diffs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIXES = ("build_", "get_", "create_", "make_", "init_", "setup_", "default_", "cached_", "new_")


def coerce_cwe(raw: Column) -> Column:
    """'CWE-79', '918' or 918.0 as a number; anything else is 0."""
    x = F.regexp_replace(F.upper(F.btrim(raw)), "^CWE-", "").try_cast("double")
    return F.coalesce(x.try_cast("int"), F.lit(0))


def csv_safe(value: Column) -> Column:
    return F.when(value.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def identity_key(file: Column, function: Column, cwe: Column) -> Column:
    text = F.concat_ws("|", file, function, F.coalesce(cwe, F.lit(0)).cast("string"))
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)


def file_last_colon(unit_id: Column) -> Column:
    return F.when(F.instr(unit_id, ":") > 0, F.regexp_extract(unit_id, "(?s)^(.*):", 1)).otherwise(unit_id)


def file_first_colon(unit_id: Column) -> Column:
    return F.substring_index(unit_id, ":", 1)


def signature_pattern(name: Column) -> Column:
    return F.regexp_replace(name, "^(" + "|".join(PREFIXES) + ")+", "")


def code_fence(text: Column) -> Column:
    """A fence one longer than the longest run of backticks, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), lambda x: F.length(x))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def hunk_range(header: Column) -> Column:
    """New-side [first, last] line of '@@ -a,b +c,d @@'; d defaults to 1, deletions give null."""
    first = F.regexp_extract(header, "^@@ -\\d+(?:,\\d+)? \\+(\\d+)", 1).try_cast("int")
    count = F.coalesce(F.nullif(F.regexp_extract(header, "^@@ -\\d+(?:,\\d+)? \\+\\d+,(\\d+)", 1), F.lit("")).try_cast("int"), F.lit(1))
    return F.when(first.isNotNull() & (count > 0), F.array(first, first + count - 1))


def has_excluded_segment(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def is_public(name: Column, exported: Column) -> Column:
    """Exported (by default) and the last dotted part not underscored."""
    return F.coalesce(exported, F.lit(True)) & ~F.element_at(F.split(name, "\\."), -1).startswith("_")


def section(text: Column, start: int, end: int) -> Column:
    """Lines start..end, counted from 1 and clamped."""
    first = max(1, start)
    return F.array_join(F.slice(F.split(text, "\n", -1), first, max(0, end - first + 1)), "\n")


def trimmed(text: Column, most_chars: int, marker: str = "\n... [truncated]") -> Column:
    return F.when(F.length(text) > most_chars, F.concat(F.left(text, F.lit(most_chars)), F.lit(marker))).otherwise(text)


def usage_lines(text: Column, name: str) -> Column:
    """Line numbers (from 1) at which `name(` is called."""
    marked = F.transform(F.split(text, "\n", -1), lambda line, i: F.when(line.rlike(f"\\b{name}\\s*\\("), i + 1))
    return F.array_compact(marked)


def base_url(url: Column) -> Column:
    """Scheme, host, port and path only."""
    return F.regexp_extract(F.regexp_replace(url, "^([a-z][a-z0-9+.\\-]*://)[^/@]*@", "$1"), "^([^?#]*)", 1)


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def duration(seconds: Column) -> Column:
    """59s, 1m05s, 1h02m."""
    s = seconds.cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes = F.concat(F.floor(s / 3600).cast("string"), F.lit("h"), two(F.floor(s % 3600 / 60)), F.lit("m")), F.concat(F.floor(s / 60).cast("string"), F.lit("m"), two(s % 60), F.lit("s"))
    return F.when(seconds < 60, F.concat(F.rint(seconds.cast("double")).cast("long").cast("string"), F.lit("s"))).when(seconds < 3600, minutes).otherwise(hours)


def cost(usd: Column) -> Column:
    """Dollars: four digits below a cent, else two."""
    return F.when(usd < 0.01, F.format_string("$%.4f", usd.cast("double"))).otherwise(F.format_string("$%.2f", usd.cast("double")))


# The line between files of one unit, and the line that replaces a forged one.
BOUNDARY = "========== File Boundary =========="
BOUNDARY_LINE = f"(?m)^[ \\t]*(?:#|//)?[ \\t]*{BOUNDARY}[ \\t]*$"
NEUTRAL = "# boundary-shaped line from scanned source, neutralized"


def neutralized(source: Column) -> Column:
    """Untrusted source without lines that look like the boundary between files."""
    return F.regexp_replace(source, BOUNDARY_LINE, NEUTRAL)


def boundary_parts(code: Column) -> Column:
    """The files of a concatenated unit, the target first."""
    return F.split(code, BOUNDARY_LINE, -1)


LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


def collapsed(text: Column) -> Column:
    """One line: each line end becomes a space, one at the very end goes."""
    return F.regexp_replace(F.regexp_replace(text, f"(?:{LINE_ENDS})\\z", ""), LINE_ENDS, " ")


def safe_filename(unit_id: Column, most: int = 233) -> Column:
    """An id as a file name; long ones are cut and end in 16 digits of their SHA-256."""
    name = F.translate(F.replace(F.replace(unit_id, F.lit("/"), F.lit("__")), F.lit("\\"), F.lit("__")), ": ", "__")
    return F.when(F.length(name) > most, F.concat(F.left(name, F.lit(most)), F.lit("_"), F.left(F.sha2(unit_id.cast("binary"), 256), F.lit(16)))).otherwise(name)


# Shapes of credentials; the first group stays.
MASK = "***REDACTED***"
DENSE = "(?=[A-Za-z0-9._\\-]*[A-Za-z0-9]{16})[A-Za-z0-9._\\-]+"
SECRETS = (
    "(?i)(\\b(?:api[_-]?key|key)\\s*(?:[=:]|%3[Dd])\\s*)[A-Za-z0-9._\\-]{8,}",
    "(?i)(\\bBearer\\s+)[A-Za-z0-9._\\-]{12,}",
    f"()sk-{DENSE}",
    "()AIza[A-Za-z0-9_\\-]{30,}",
)


def redacted(text: Column) -> Column:
    for shape in SECRETS:
        text = F.regexp_replace(text, shape, "$1" + MASK)
    return text


def stage1_verdict(note: Column, updated_from: Column, finding: Column, verdict: Column) -> Column:
    """The verdict before stage two: the word after 'from' in a note of change, else the recorded one, else the present."""
    before = F.when(note.contains("Changed from"), F.nullif(F.regexp_extract(note, "(?:^|\\s)from\\s+(\\S+)", 1), F.lit("")))
    return F.coalesce(before, F.nullif(updated_from, F.lit("")), F.nullif(finding, F.lit("")), verdict, F.lit(""))


def remote_identity(url: Column) -> Column:
    """A git remote as https://host/path, without user, port or .git; '' for what is no remote."""
    raw = F.btrim(url)
    scp = "^(?:[^:@/\\\\\\s]+@)?([A-Za-z0-9.\\-]{2,}):([A-Za-z0-9._~%+\\-][A-Za-z0-9._~%+/\\-]*)$"
    web = "^[a-z][a-z0-9+.\\-]*://(?:[^/@]*@)?([A-Za-z0-9.\\-]+)(?::\\d+)?/([^?#]+)"
    path = lambda x: F.regexp_replace(F.btrim(x, F.lit("/")), "\\.git$", "")
    whole = lambda p: F.concat(F.lit("https://"), F.lower(F.regexp_extract(raw, p, 1)), F.lit("/"), path(F.regexp_extract(raw, p, 2)))
    return F.when(raw.contains("://"), F.when(raw.rlike(web), whole(web)).otherwise("")).when(raw.rlike(scp), whole(scp)).otherwise("")


def first_match(text: Column, patterns: list[str]) -> Column:
    """What the first pattern that matches (in order of the list) found; null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, f"({p})", 1), F.lit("")) for p in patterns))


def vulnerability_class(text: Column, by_cwe: dict[str, str], by_word: dict[str, str]) -> Column:
    """A CWE number before a keyword, keywords in order."""
    number = F.regexp_extract(text, "(?i)CWE-(\\d+)", 1)
    out = F.lit(None).cast("string")
    for word, name in reversed(by_word.items()):
        out = F.when(F.lower(text).contains(word), name).otherwise(out)
    for cwe, name in by_cwe.items():
        out = F.when(number == cwe, name).otherwise(out)
    return out
