"""Line dedup on levelled sorted runs of line hashes.

The state is a set of runs: tables bucketed and sorted by a 128-bit line key, one file a bucket, each
row with the number of documents seen to hold that line.  A batch of documents becomes one run of
level 0, after a merge anti-join against the decided runs (keys already known to be frequent need no
more counting; a key in an open run does, so open runs meet the batch when they are compacted).
When a level holds two runs they are merged into one run of the next level: a sort-merge join of two
tables that lie in order already, so that nothing is shuffled; keys that reach `min_docs` are decided
from then on.  Batches are aggregated before they are dealt to buckets, so a very frequent line is a
few rows by then.

Defined results: a null or empty text is one empty line, and empty lines are never dropped;
repeated rows count as documents of their own; rows with a null doc_id are kept and counted;
an empty table gives an empty result; further columns pass through `dedup_lines` untouched.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEY = ["_ln_h1", "_ln_h2"]


def line_key(line: Column) -> Column:
    return common.ascii_lower(common.strip_blanks(line))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(line: Column) -> Column:
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias(KEY[0]), F.xxhash64(F.lit(17), key).alias(KEY[1]))


@contextmanager
def _ordered_scans(spark: SparkSession) -> Iterator[None]:
    """Within it, plans rely on the order of tables with one sorted file a bucket."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """The levelled store.  `add` takes one row per document and distinct line key."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, buckets: int = 8):
        self.spark, self.min_docs, self.buckets = spark, min_docs, buckets
        self.scratch = common.Scratch(spark, "line-runs")
        self.levels: dict[int, list[str]] = defaultdict(list)
        self.decided: list[str] = []
        self.made: list[str] = []

    def _write(self, df: DataFrame) -> str:
        name = f"codeloom_run_{uuid.uuid4().hex}"
        with _ordered_scans(self.spark):
            df.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.scratch.base}/{name}").saveAsTable(name)
        self.made.append(name)
        return name

    def _decided(self, name: str) -> DataFrame:
        return self.spark.table(name).where(F.col("n") >= self.min_docs)

    def add(self, keyed: DataFrame) -> None:
        run = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).repartition(self.buckets, *KEY)
        for old in self.decided:
            run = run.join(self._decided(old).select(*KEY).hint("merge"), KEY, "left_anti")
        self.levels[0].append(self._write(run))
        level = 0
        while len(self.levels[level]) >= 2:
            self.compact(level)
            level += 1

    def merged(self, a: str, b: str) -> DataFrame:
        """Two runs as one, without the keys that are decided in either."""
        x, y = (self.spark.table(name) for name in (a, b))
        both = x.withColumnRenamed("n", "x").hint("merge").join(y.withColumnRenamed("n", "y"), KEY, "full_outer")
        return both.select(*KEY, (F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))).alias("n"))

    def compact(self, level: int) -> None:
        """The level's runs become one of the next; keys that are decided in them stay in the merged run's decided part."""
        a, b = self.levels.pop(level)
        name = self._write(self.merged(a, b))
        for old in (a, b):  # its keys are all in the new run
            self.decided = [x for x in self.decided if x != old]
            self._forget(old)
        self.decided.append(name)
        self.levels[level + 1].append(name)

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.made.remove(name)
        self.scratch.drop(name)

    def frequent(self) -> DataFrame:
        """All keys found in at least `min_docs` documents, once each; the runs end with it."""
        runs = [(level, name) for level, own in sorted(self.levels.items()) for name in own]
        while len(runs) > 1:
            (_, a), (_, b) = runs[:2]
            self.levels = defaultdict(list, {0: [a, b]})
            self.compact(0)
            runs = [(1, self.levels[1][0]), *runs[2:]]
        out = self.scratch.store(self._decided(runs[0][1]).select(*KEY), "frequent")
        for name in list(self.made):
            self._forget(name)
        return out


def dedup_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, bucket_rows: int = 500_000) -> DataFrame:
    """`docs` with the lines dropped whose key is in `min_docs` documents or more.

    Adds _ln_n (lines before) and _ln_dropped.  A document of dropped lines only keeps ''.
    """
    spark = docs.sparkSession
    lines = docs.select(
        "doc_id",
        F.explode(
            F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: line_key(x) != ""), _hash))
        ).alias("k"),
    ).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("_ln_batch"), *(F.col("k")[c].alias(c) for c in KEY))
    lines = common.stored(lines, "line-keys", "_ln_batch")
    store = LineRuns(spark, min_docs, max(1, -(-lines.count() // (batches * bucket_rows))))
    for b in range(batches):
        store.add(lines.where(F.col("_ln_batch") == b))
    hits = (
        lines.join(store.frequent(), KEY)
        .groupBy(F.col("doc_id").alias("_ln_doc"))
        .agg(F.collect_set(F.struct(*KEY)).alias("_ln_drop"))
    )
    out = docs.join(hits, F.col("doc_id").eqNullSafe(F.col("_ln_doc")), "left")
    kept = F.when(
        F.col("_ln_drop").isNull(), _lines(F.col("text"))
    ).otherwise(F.filter(_lines(F.col("text")), lambda x: (line_key(x) == "") | ~F.array_contains(F.col("_ln_drop"), _hash(x))))
    n = F.size(_lines(F.col("text"))).cast("long")
    out = out.withColumn("_ln_kept", kept).withColumn("_ln_n", n)
    out = out.withColumn("_ln_dropped", F.col("_ln_n") - F.size("_ln_kept"))
    text = F.when(F.col("_ln_drop").isNull(), F.col("text")).otherwise(F.array_join("_ln_kept", "\n"))
    return out.withColumn("text", text).drop("_ln_doc", "_ln_drop", "_ln_kept")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("_ln_n").alias("n_lines"),
        F.col("_ln_dropped").alias("n_dropped"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP1_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM f)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (SELECT key FROM f)), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
