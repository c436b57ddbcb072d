"""Operators of patch review: paths, enclosing symbols, hunks, impact and test support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators import intervals as iv


def resolved_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """rel, path, how for distinct paths `rel` of wanted against the column path of files.

    exact; else, with two parts or more, the only file that ends in them (suffix); else ambiguous
    or unresolved.  The join is on every suffix of a file's path, so it is an equi-join."""
    files, asked = files.select("path").distinct(), wanted.select("rel").where("rel IS NOT NULL").distinct()
    parts = F.split("path", "/")
    ends = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))).alias("rel"))
    ends = ends.where((F.col("rel") == F.col("path")) | F.col("rel").contains("/"))
    met = ends.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("only"), F.bool_or(F.col("rel") == F.col("path")).alias("exact"))
    out = asked.join(met, "rel", "left")
    how = F.when(F.col("exact"), "exact").when(F.col("n") == 1, "suffix").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return out.select("rel", F.when(F.col("exact"), F.col("rel")).when(F.col("n") == 1, F.col("only")).alias("path"), how.alias("how"))


def innermost(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """hit_id, symbol: the shortest symbol (file, symbol, start, end) whose lines hold the hit (hit_id, file, line); ties by name, a null one last.

    Equal places are looked up once, and equal ranges and blocks of lines keep only their first symbol,
    so neither the hits of a line nor the symbols that pile up on it multiply."""
    rank = F.struct((F.col("end") - F.col("start")).alias("span"), F.col("symbol").isNull().alias("unnamed"), "symbol")
    first = iv.first_range(hits, symbols.withColumn("rank", rank), "line", "start", "end", "rank", "symbol")
    asked = hits.select("hit_id", "file", F.col("line").cast("long").alias("line"))
    return iv.joined(asked, first, ["file", "line"], "left").select("hit_id", F.col("value").alias("symbol"))


def impact(usages: DataFrame, hints: str = "(^|/)(routes?|views?|handlers?|controllers?|api|cli|main)(/|\\.|$)") -> DataFrame:
    """symbol, n_files, level from usages (symbol, file, own_file, is_test): low, medium or high by files outside tests and its own."""
    outside = ~F.col("is_test") & (F.col("file") != F.col("own_file"))
    per = usages.groupBy("symbol").agg(F.count_distinct(F.when(outside, F.col("file"))).alias("n_files"), F.coalesce(F.bool_or(outside & F.col("file").rlike(hints)), F.lit(False)).alias("hinted"))
    level = F.when(F.col("n_files") == 0, "low").when((F.col("n_files") >= 3) | F.col("hinted"), "high").otherwise("medium")
    return per.select("symbol", "n_files", level.alias("level"))


def test_support(tests: DataFrame) -> DataFrame:
    """file, support from rows (file, proximity): Good, Some or None."""
    n = lambda k: F.count_if(F.col("proximity") == k)
    return tests.groupBy("file").agg(F.when((n("same-file") >= 1) | (n("same-module") >= 2), "Good").when(n("same-module") >= 1, "Some").otherwise("None").alias("support"))


def repaired_header(header: Column, body: Column) -> Column:
    """A hunk header with the counts that its body (array of lines) has; what is no header stays."""
    old, new = F.size(F.filter(body, lambda x: x.rlike("^[- ]") | (x == ""))), F.size(F.filter(body, lambda x: x.rlike("^[+ ]") | (x == "")))
    shape = "^@@ -(\\d+)(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@(.*)$"
    part = lambda i: F.regexp_extract(header, shape, i)
    return F.when(header.rlike(shape), F.concat(F.lit("@@ -"), part(1), F.lit(","), old.cast("string"), F.lit(" +"), part(2), F.lit(","), new.cast("string"), F.lit(" @@"), part(3))).otherwise(header)


def is_empty_hunk(body: Column) -> Column:
    return ~F.exists(body, lambda x: x.rlike("^[-+]"))


def model_family(model: Column) -> Column:
    """A model id without vendor slug and date stamp, dots as dashes."""
    return F.replace(F.regexp_replace(F.regexp_replace(F.lower(model), "^.*/", ""), "[-@](20\\d{6}|20\\d{2}-\\d{2}-\\d{2})$", ""), F.lit("."), F.lit("-"))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, ...) with price_in, price_out: by exact id, else by family, the bare id first; without either the row is unpriced."""
    exact = prices.groupBy("model").agg(F.max(F.struct("price_in", "price_out")).alias("exact"))
    family = prices.withColumn("family", model_family(F.col("model")))
    family = family.groupBy("family").agg(F.min(F.struct(F.length("model").alias("long"), "model", "price_in", "price_out")).alias("near"))
    out = usage.withColumn("_family", model_family(F.col("model"))).join(exact, "model", "left").join(family, F.col("_family") == F.col("family"), "left")
    price = lambda c: F.coalesce(F.col(f"exact.{c}"), F.col(f"near.{c}"))
    return out.select(*usage.columns, F.coalesce(price("price_in"), F.lit(0.0)).alias("price_in"), F.coalesce(price("price_out"), F.lit(0.0)).alias("price_out"), price("price_in").isNull().alias("unpriced"))


def ground_truth(rows: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """rows (id, ...) with expected: VULNERABLE, SAFE or UNKNOWN; positives win."""
    p, n = positives.select("id").distinct().withColumn("_p", F.lit(True)), negatives.select("id").distinct().withColumn("_n", F.lit(True))
    out = rows.join(p, "id", "left").join(n, "id", "left")
    return out.withColumn("expected", F.when(F.col("_p"), "VULNERABLE").when(F.col("_n"), "SAFE").otherwise("UNKNOWN")).drop("_p", "_n")


def merged_datasets(parts: DataFrame) -> DataFrame:
    """parts (language, id, ...) in one: the second and later languages with an id carry language::id; languages in order of name."""
    again = F.dense_rank().over(Window.partitionBy("id").orderBy("language")) > 1
    return parts.withColumn("id", F.when(again, F.concat_ws("::", "language", "id")).otherwise(F.col("id")))


def head_per_key(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key; the window's limit is pushed below its shuffle by Spark."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_at") <= n).drop("_at")
