"""What the training-data operators share: table access, the shared folder, words and hashes.

Words are runs of anything but the six ASCII blanks (space and \\x09-\\x0D).  On the Python side
texts travel as UTF-8 bytes, because ``bytes.split()`` cuts at exactly those six.
"""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    A private folder is set only where that setting is missing and all runs in one process, as in
    tests; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if sc.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="codeloom-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/codeloom-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: its lineage ends there."""
    path = shared_path(df.sparkSession, tag)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Named tables of one run in a fresh shared folder, which can be dropped once nothing reads them."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base = spark, shared_path(spark, tag)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """Marked for broadcast if it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= most_rows else df


def trim() -> None:
    """Gives memory that this Python process has freed back to the system; glibc keeps it otherwise, elsewhere nothing is done."""
    if sys.platform == "linux" and (give := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        give(0)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def strip_blanks(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def ordered_lang_free(docs: DataFrame) -> DataFrame:
    """doc_id and the text as bytes: all that the Python side of an operator gets to see."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def window_hashes(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """One 64-bit hash for each `width` consecutive word hashes (none if there are fewer)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out = out * np.uint64(0x2545F4914F6CDD1D) + (hashes[i : i + n] ^ base)
        out ^= out >> np.uint64(29)
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Enough partitions that each gets about `per_partition` rows, and all cores have work."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_partition))
