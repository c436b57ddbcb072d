"""The language table: extension to language, fence and template, as column functions and as a small DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# They decide which files are read and under which language.
SKIP_DIRS = ("node_modules", "__pycache__", "venv", ".venv", "dist", "build", ".git", "vendor", ".build", ".swiftpm", "DerivedData", "Pods", "Carthage", "xcuserdata")
EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".ts": "javascript", ".jsx": "javascript", ".tsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".go": "go", ".c": "c", ".h": "c", ".cpp": "c", ".hpp": "c", ".cc": "c", ".cxx": "c", ".hxx": "c", ".hh": "c",
    ".rb": "ruby", ".rake": "ruby", ".php": "php", ".zig": "zig", ".swift": "swift", ".rs": "rust",
}
FENCES = {".ts": "typescript", ".tsx": "typescript", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hxx": "cpp", ".hh": "cpp"}
TEMPLATES = {"python": "python", "javascript": "node", "go": "go", "ruby": "ruby", "php": "php"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def extension(path: Column) -> Column:
    """Lower-cased last extension with its dot; '' for names without one and for dotfiles."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, "^.+(\\.[^.]+)$", 1))


def language(path: Column) -> Column:
    return _lookup(EXTENSIONS, extension(path))


def fence(path: Column) -> Column:
    """The info string of a code fence: by extension, else by language, else ''."""
    return F.coalesce(_lookup(FENCES, extension(path)), language(path), F.lit(""))


def template(lang: Column) -> Column:
    """The runnable template of a language, null where it has none."""
    return _lookup(TEMPLATES, lang)


def registry(spark: SparkSession) -> DataFrame:
    rows = [(e, n, FENCES.get(e, n), TEMPLATES.get(n)) for e, n in EXTENSIONS.items()]
    return spark.createDataFrame(rows, "extension string, language string, fence string, docker_template string")
