"""Joins of line ranges and lines by dyadic blocks.

A block of level l holds 2^l lines.  A range is the union of at most 2 log(length) disjoint blocks, and a
line lies in exactly one block a level, so "the line is in the range" is an equality of (file,
level, block).  A long range is few keys, a file of any length spreads over its blocks, and both
sides are distinct before they meet: a hot file's lines are one row at its upper levels.

Ranges are whole and inclusive; one that ends before it starts, or lacks a bound, meets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators import prefix
from codeloom.operators.graph import _checkpointed

FEW_FILES = 100_000  # names of so many files are sent to every task
MOST_SENT = 250_000  # and so many distinct keys, of about 100 bytes


def _pair(start: Column, end: Column, level: Column) -> Column:
    """The blocks of a level, two at most, in the tiling of [start, end]; a null block where there is none."""
    shifted = lambda x: F.call_function("shiftright", x, level)
    left, right = -shifted(-start.cast("long")), shifted(end.cast("long") + 1)  # the level's whole blocks: left to right - 1
    odd = lambda x: (left < right) & (x.bitwiseAND(1) == 1)
    held = lambda x, block: F.struct(level.cast("int").alias("level"), F.when(odd(x), block).alias("block"))
    return F.array(held(left, left), held(right, right - 1))


def _levels(start: Column, end: Column) -> Column:
    """0 to the level of the greatest block that the range can hold."""
    return F.sequence(F.lit(0), F.length(F.bin(F.greatest(end.cast("long") - start.cast("long") + 1, F.lit(1)))) - 1)


def blocks(start: Column, end: Column) -> Column:
    """array of (level, block) that tile [start, end]."""
    return F.when(start <= end, F.filter(F.flatten(F.transform(_levels(start, end), lambda level: _pair(start, end, level))), lambda x: x["block"].isNotNull()))


def cut(ranges: DataFrame) -> DataFrame:
    """ranges (start, end, ...) with a row for each of their `blocks`: rows are dealt by level first, so that the arithmetic is compiled."""
    start, end = F.col("start"), F.col("end")
    each = ranges.where(start <= end).select("*", F.explode(_levels(start, end)).alias("_level"))
    return each.select(*ranges.columns, F.inline(_pair(start, end, F.col("_level")))).where("block IS NOT NULL")


def of_files(ranges: DataFrame, lines: DataFrame, few: int = FEW_FILES) -> DataFrame:
    """The ranges of files that lines have; of more than a few files all ranges, which the joins sort out."""
    files = lines.select("file").where("file IS NOT NULL").distinct()
    return ranges.join(F.broadcast(files), "file", "left_semi") if files.limit(few + 1).count() <= few else ranges.where("file IS NOT NULL")


def joined(rows: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows joined with few or many distinct keys: a few go to every task, so that rows are not shuffled and no hot key meets in one."""
    other = _checkpointed(other)
    return rows.join(F.broadcast(other) if other.count() <= MOST_SENT else other, keys, how)


def line_keys(lines: DataFrame, line: str, ranges: DataFrame) -> DataFrame:
    """Distinct file, line and a row for each level that a block of the ranges (start, end) can have."""
    longest = ranges.where("start <= end").agg(F.max(F.col("end").cast("long") - F.col("start").cast("long") + 1)).first()[0]
    at = lines.select("file", F.col(line).cast("long").alias("line")).where("file IS NOT NULL AND line IS NOT NULL").distinct()
    held = F.array(*(F.struct(F.lit(x).alias("level"), F.shiftright("line", x).alias("block")) for x in range(longest.bit_length()))) if longest else F.array().cast("array<struct<level:int,block:long>>")
    return at.select("*", F.inline(held))


def distinct_ranges(ranges: DataFrame, lines: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct (file, start, end) of the files that lines have, written once: what the joins below read."""
    return _checkpointed(of_files(ranges, lines).select("file", F.col(start).alias("start"), F.col(end).alias("end")).where("start <= end").distinct())


def ranges_hit(ranges: DataFrame, lines: DataFrame, line: str) -> DataFrame:
    """The distinct ranges (file, start, end) that hold some line of their file."""
    met = line_keys(lines, line, ranges).select("file", "level", "block").distinct()
    return cut(ranges).join(met, ["file", "level", "block"], "left_semi").select("file", "start", "end").distinct()


def lines_hit(lines: DataFrame, ranges: DataFrame, line: str) -> DataFrame:
    """Distinct (file, line) that lie in some of the distinct ranges (file, start, end) of their file."""
    met = cut(ranges).select("file", "level", "block").distinct()
    return line_keys(lines, line, ranges).join(met, ["file", "level", "block"], "left_semi").select("file", "line").distinct()


def first_range(lines: DataFrame, ranges: DataFrame, line: str, start: str, end: str, ordinal: str, value: str) -> DataFrame:
    """(file, line, value) of each line's first range by `ordinal`: equal ranges keep only their first before they are cut, and so
    does a block, so nothing grows with the ranges that pile up on it."""
    own = of_files(ranges, lines).select("file", F.col(start).alias("start"), F.col(end).alias("end"), F.struct(F.col(ordinal).alias("o"), F.col(value).alias("v")).alias("first"))
    own = _checkpointed(own.where("start <= end").groupBy("file", "start", "end").agg(F.min("first").alias("first")))
    best = cut(own).groupBy("file", "level", "block").agg(F.min("first").alias("first"))
    met = line_keys(lines, line, own).join(best, ["file", "level", "block"])
    return met.groupBy("file", "line").agg(F.min("first").alias("first")).select("file", "line", F.col("first.v").alias("value"))


def nearest_start(lines: DataFrame, ranges: DataFrame, line: str, start: str, ordinal: str, value: str) -> DataFrame:
    """(file, line, value) of the range of its file that starts nearest to each line, ties to the smaller start, then the smaller ordinal.

    Starts and lines stand in one order; the nearest start before a line, and in the opposite order the
    nearest after it, is what a prefix over the partitions carries, however many lines a file has."""
    begun = ranges.where("file IS NOT NULL").groupBy("file", F.col(start).cast("long").alias("start")).agg(F.min(F.struct(F.col(ordinal).alias("o"), F.col(value).alias("value"))).alias("first")).where("start IS NOT NULL")
    at = lines.select("file", F.col(line).cast("long").alias("line")).where("file IS NOT NULL AND line IS NOT NULL").distinct()

    def side(sign: int) -> DataFrame:
        place = sign * F.col("start")
        held = begun.select("file", place.alias("v"), F.lit(0).alias("kind"), F.struct("file", place.alias("v"), "first").alias("held"))
        asked = at.select("file", (sign * F.col("line")).alias("v"), F.lit(1).alias("kind"))
        rows = prefix.ordered(held.unionByName(asked, allowMissingColumns=True), F.col("file"), F.col("v"), F.col("kind"))
        near = prefix.carried(rows, before={"near": F.col("held")}).where("kind = 1 AND near.file = file")
        return near.select("file", (sign * F.col("v")).alias("line"), (sign * F.col("near.v")).alias("start"), F.col("near.first").alias("first"))

    both = side(1).unionByName(side(-1))
    best = F.min(F.struct(F.abs(F.col("line") - F.col("start")).alias("d"), "start", "first")).alias("best")
    return both.groupBy("file", "line").agg(best).select("file", "line", F.col("best.first.value").alias("value"))


def first_file(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file): the first of files (file, ordinal) that equals the path, ends with it, or that it ends with.

    Every ending of each distinct path or file is a key, so that both directions are equalities."""
    p, f = paths.select("path").where("path <> ''").distinct(), files.where("file <> ''").groupBy("file").agg(F.min("ordinal").alias("ordinal"))
    endings = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(F.col(c), i))
    longer_path = p.select("path", F.explode(endings("path")).alias("end")).join(f.select("file", "ordinal", F.col("file").alias("end")), "end")
    longer_file = f.select("file", "ordinal", F.explode(endings("file")).alias("end")).join(p.select("path", F.col("path").alias("end")), "end")
    both = longer_path.select("path", "file", "ordinal").unionByName(longer_file.select("path", "file", "ordinal"))
    return both.groupBy("path").agg(F.min_by("file", F.struct("ordinal", "file")).alias("file"))
