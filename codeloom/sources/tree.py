"""Source trees as tables of files.

A tree is read by Spark's binary file source, listed in parallel and filtered before contents are
read: name, size and folder rules see only the path and length columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.sources import languages as lang

MOST_BYTES = 10 << 20


def files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """path, rel (below root), length and content of every file; `pattern` is a glob on names."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    bare = root.split("://", 1)[-1].rstrip("/")
    at = F.instr(F.col("path"), bare + "/") + len(bare) + 1
    return reader.load(root).select("path", F.substr(F.col("path"), at).alias("rel"), "length", "content")


def folders(rel: Column) -> Column:
    """The folder names of a relative path, outermost first."""
    parts = F.split(rel, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def first_skipped(rel: Column, names: tuple[str, ...] = lang.SKIP_DIRS) -> Column:
    """The outermost folder that is pruned (whole names, never parts of them), or null."""
    return F.try_element_at(F.filter(folders(rel), lambda x: x.isin(*names)), F.lit(1))


def is_test(rel: Column) -> Column:
    """A test by folder or by name: test/ or tests/, test_*, *_test.*, *.test.*, *.spec.*."""
    name = F.lower(F.element_at(F.split(rel, "/"), -1))
    return F.exists(folders(F.lower(rel)), lambda x: x.isin("test", "tests", "__tests__", "spec")) | name.rlike("^test_|_test\\.[a-z]+$|\\.(test|spec)\\.[a-z]+$|^test\\.py$")


def kept(tree: DataFrame, names: tuple[str, ...] = lang.SKIP_DIRS) -> DataFrame:
    return tree.where(first_skipped(F.col("rel"), names).isNull())


def skipped_folders(tree: DataFrame, examples: int = 5) -> DataFrame:
    """name, n_files, examples (least paths, so many), truncated of the folders that are pruned."""
    gone = tree.select("rel", first_skipped(F.col("rel")).alias("name")).where("name IS NOT NULL")
    per = gone.groupBy("name", F.expr("substring(rel, 1, locate('/' || name || '/', '/' || rel) + length(name) - 1)").alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("folder")))
    out = per.groupBy("name").agg(F.sum("n").alias("n_files"), F.count(F.lit(1)).alias("n_folders"), F.array_sort(F.collect_list(F.when(F.col("place") <= examples, F.col("folder")))).alias("examples"))
    return out.withColumn("truncated", F.col("n_folders") > examples)


def sources(tree: DataFrame, most_bytes: int = MOST_BYTES, tests: bool = False) -> DataFrame:
    """rel, language, length, source: supported files outside pruned folders, UTF-8, at most so long.

    A file without extension counts as Python if its first line is a python shebang."""
    rows = kept(tree).where(F.col("length") <= most_bytes)
    rows = rows if tests else rows.where(~is_test(F.col("rel")))
    name = F.element_at(F.split("rel", "/"), -1)
    head = F.decode(F.substring("content", 1, 100), "UTF-8")
    shebang = F.when(~name.contains("."), F.when(head.rlike("^#![^\\n]*python"), "python"))
    rows = rows.withColumn("language", F.coalesce(lang.language(F.col("rel")), shebang)).where("language IS NOT NULL")
    return rows.where(F.expr("is_valid_utf8(CAST(content AS STRING))")).select("rel", "language", "length", F.col("content").cast("string").alias("source"))


def unreadable(tree: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """reason, n: supported files that `sources` leaves out for their size or encoding."""
    rows = kept(tree).where(lang.language(F.col("rel")).isNotNull())
    reason = F.when(F.col("length") > most_bytes, "too_large").when(~F.expr("is_valid_utf8(CAST(content AS STRING))"), "not_utf8")
    return rows.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def scan_statistics(found: DataFrame) -> DataFrame:
    """language, n_files, bytes; most files first, then by name."""
    return found.groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes")).orderBy(F.desc("n_files"), "language")
