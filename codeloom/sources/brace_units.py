"""Functions of brace languages: definitions by one pattern a language, bodies by matching braces.

No parser is at hand, so comments and literals are blanked first (length and lines stay), a
definition is what the language's pattern finds outside of them, and its body ends where its
first brace closes; without one it ends with the text.  Declarations without a body are left out.
A null text has no functions; an unknown language gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import code_text

HIDDEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)""", re.S)
RUST_HIDDEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\\n])'""", re.S)
DEFINITIONS = {
    "c": re.compile(r"^[ \t]*(?!(?:else|return|if|while|for|switch)\b)[A-Za-z_][\w\s*]*?[\s*](?P<name>[A-Za-z_]\w*)[ \t]*\([^;{}]*\)\s*(?=\{)", re.M),
    "go": re.compile(r"^func\s+(?:\((?P<owner>[^)]*)\)\s*)?(?P<name>[A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\(", re.M),
    "rust": re.compile(r"\bfn\s+(?P<name>[A-Za-z_]\w*)"),
    "zig": re.compile(r"\bfn\s+(?P<name>[A-Za-z_]\w*)\s*\("),
    "swift": re.compile(r"\bfunc\s+(?P<name>[A-Za-z_]\w*)"),
    "php": re.compile(r"\bfunction\s+&?(?P<name>[A-Za-z_]\w*)\s*\("),
    "javascript": re.compile(r"\bfunction\s*\*?\s+(?P<name>[A-Za-z_$][\w$]*)\s*\("),
}


def blanked(code: str, language: str = "c") -> str:
    """The text with comments and literals as blanks; line breaks stay."""
    return (RUST_HIDDEN if language == "rust" else HIDDEN).sub(lambda m: re.sub(r"[^\n]", " ", m.group()), code)


def functions_of(code: str, language: str) -> list[tuple[str, str | None, int, int, str]]:
    """(name, receiver, first line, last line, text) of each function with a body, in order."""
    pattern = DEFINITIONS.get(language)
    if pattern is None or not code:
        return []
    plain, out = blanked(code, language), []
    for m in pattern.finditer(plain):
        opened = re.compile(r"[{;]").search(plain, m.end())
        if opened is None or opened.group() == ";":
            continue
        depth, end = 0, len(plain)
        for b in re.compile(r"[{}]").finditer(plain, opened.start()):
            depth += 1 if b.group() == "{" else -1
            if not depth:
                end = b.end()
                break
        owner = (m.groupdict().get("owner") or "").split()
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        out.append((m["name"], owner[-1].lstrip("*") if owner else None, plain.count("\n", 0, start) + 1, plain.count("\n", 0, end) + 1, code[start:end]))
    return out


def units(files: DataFrame) -> DataFrame:
    """path, name, receiver, start, end, code of the functions in files (path, language, code)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *f) for path, language, code in zip(frame["path"], frame["language"], frame["code"]) for f in functions_of(code or "", language or "")]
            yield pd.DataFrame(rows, columns=["path", "name", "receiver", "start", "end", "code"])

    return files.select("path", "language", "code").mapInPandas(run, "path string, name string, receiver string, start int, end int, code string")


def call_edges(functions: DataFrame, language: str = "c") -> DataFrame:
    """(src, dst) between functions (id, path, name, receiver, code): a name in the same file, else the only free function of that name.

    Names of Python's own functions and modules are found in the same file only."""
    calls = functions.select(F.col("id").alias("src"), "path", F.explode(code_text.called_names(F.col("code"), language)).alias("called"))
    local = functions.groupBy("path", F.col("name").alias("called")).agg(F.min("id").alias("near"))
    free = functions.where("receiver IS NULL")
    if language == "python":
        free = free.where(~F.col("name").isin(*code_text.PYTHON_OWN))
    lone = free.groupBy(F.col("name").alias("called")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("far")).where("n = 1").drop("n")
    rows = calls.join(local, ["path", "called"], "left").join(lone, "called", "left")
    return rows.select("src", F.coalesce("near", "far").alias("dst")).where("dst IS NOT NULL AND src <> dst").distinct()
