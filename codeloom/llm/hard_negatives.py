"""Hard negatives by norm-bucketed maximum inner product search.

Candidates are sorted by norm (a range shuffle on norm and id, so equal norms spread) and packed into
buckets: a row of the bucket table holds up to `bucket_rows` vectors of nearly equal norm, their ids
and labels, and the largest norm.  Anchors come in blocks of bounded bytes.  Each block is broadcast and
searched in two scans of the bucket table, without shuffling a vector:

1. positives: the best `n_positives` rows of the anchor's own label;
2. negatives: for each positive its window of scores, from `low_percent` of the positive's score to
   that score, and the best `n_negatives` rows of other labels inside it.

By Cauchy-Schwarz |anchor| * a bucket's largest norm bounds every score of the bucket.  A bucket is
pruned for a window where that bound is under the window's lower limit, or under its running kth
score once it is full.  The least norm that any window of the block needs is also a filter on the
scan of the bucket table.  Nothing else is skipped: the search is exact.

Scores are exact integers: float64 products where no sum can pass 2^53, Python integers otherwise.
A score beyond a long counts as the nearest long.

Defined results: a row with a null id, label or vector, or with a null or non-finite component
(also after scaling) takes no part; vectors of unequal lengths are padded with zeros, an empty
vector scores 0; a positive never bears its anchor's id; rows that share an id are otherwise rows of
their own, as candidates and as anchors; a window over a negative score is empty, one over 0 holds
only 0; an anchor without a positive gives no row; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LONG = np.iinfo(np.int64)
EXACT = float(1 << 53)
BUCKET = "n int, dim int, top_norm double, ids binary, labels binary, norms binary, matrix binary"
FOUND = "slot int, score long, other_id long"


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """id, label, whole-numbered components (as doubles) and norm of the rows that take part."""
    # Spark's floor of a double is a long, which saturates; doubles of 2^53 or more are whole already
    whole = lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform("vector", lambda x: whole(x.cast("double") * scale)).alias("v"))
    v = v.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(~bad)
    return v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _packer(most_rows: int):
    """Consecutive rows of `usable` packed into rows of BUCKET."""

    def packed(ids: list, labels: list, vectors: list, norms: list) -> pa.RecordBatch:
        dim = max(map(len, vectors))
        m = np.zeros((len(ids), dim))
        for i, v in enumerate(vectors):
            m[i, : len(v)] = v
        with np.errstate(over="ignore"):
            narrow = m.astype(np.float32)
        cells = [len(ids), dim, max(norms), np.array(ids).tobytes(), np.array(labels).tobytes(), np.array(norms).tobytes(), (narrow if np.array_equal(narrow, m) else m).tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], names=[x.split()[0] for x in BUCKET.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        for batch in batches:
            v = batch.column("v")
            ends = np.cumsum([0, *(len(x) for x in v)])
            flat = v.flatten().to_numpy(zero_copy_only=False)
            for i, row in enumerate(zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("norm").to_pylist())):
                for column, cell in zip(held, (row[0], row[1], flat[ends[i] : ends[i + 1]], row[2])):
                    column.append(cell)
                if len(held[0]) == most_rows:
                    yield packed(*held)
                    held = [[], [], [], []]
        if held[0]:
            yield packed(*held)

    return pack


def unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels, norms and the matrix of a row of BUCKET."""
    n, dim = row["n"], row["dim"]
    kind = np.float32 if len(row["matrix"]) == 4 * n * dim else np.float64
    whole = [np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("labels", np.int64), ("norms", np.float64))]
    return *whole, np.frombuffer(row["matrix"], kind).reshape(n, dim).astype(np.float64)


def padded(m: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def scores(anchors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """All inner products as longs."""
    dim = max(anchors.shape[1], others.shape[1])
    a, b = padded(anchors, dim), padded(others, dim)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * dim < EXACT:
        return (a @ b.T).astype(np.int64)
    rows = [[[int(x) for x in row] for row in m] for m in (a, b)]
    return np.array([[min(max(sum(x * y for x, y in zip(p, q)), LONG.min), LONG.max) for q in rows[1]] for p in rows[0]], np.int64).reshape(len(a), len(b))


class Best:
    """The best k (score, id) of each slot: higher scores, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.k, self.rows, self.kth = k, [[] for _ in range(slots)], np.full(slots, -np.inf)

    def offer(self, slot: int, found: np.ndarray, ids: np.ndarray) -> None:
        held = self.rows[slot]
        if len(held) == self.k:
            keep = found >= held[-1][0]
            found, ids = found[keep], ids[keep]
        if len(found) > self.k:
            keep = found >= np.partition(found, len(found) - self.k)[-self.k]
            found, ids = found[keep], ids[keep]
            order = np.lexsort((ids, ~found))[: self.k]  # ~ turns longs round without overflow
            found, ids = found[order], ids[order]
        if len(found):
            held = sorted(held + list(zip(found.tolist(), ids.tolist())), key=lambda r: (-r[0], r[1]))[: self.k]
            self.rows[slot] = held
            if len(held) == self.k:
                self.kth[slot] = held[-1][0]


def _searcher(block, k: int, windows=None, chunk: int = 1024):
    """mapInArrow over buckets: the best k of every slot in each task.

    Without windows a slot is an anchor and takes rows of its label; with them it is an (anchor,
    lower, upper) and takes rows of other labels with such scores.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, norms, anchors = block.value
        slots = [(i, None, None) for i in range(len(ids))] if windows is None else windows.value
        best = Best(len(slots), k)
        owner = np.array([s[0] for s in slots], int)
        of_anchor: list[list[int]] = [[] for _ in ids]
        for s, i in enumerate(owner):
            of_anchor[i].append(s)
        low = np.array([-np.inf if s[1] is None else float(s[1]) for s in slots])
        for batch in batches:
            for row in batch.to_pylist():
                c_ids, c_labels, _, vectors = unpacked(row)
                bound = norms * row["top_norm"] * (1 + 1e-9)  # over any error of the norms
                pruned = bound[owner] < np.maximum(low, best.kth)
                alive = np.unique(owner[~pruned])
                for begin in range(0, len(alive), chunk):
                    some = alive[begin : begin + chunk]
                    for a, line in zip(some, scores(anchors[some], vectors)):
                        same = c_labels == labels[a]
                        mask = same & (c_ids != ids[a]) if windows is None else ~same
                        for s in of_anchor[a]:
                            if not pruned[s]:
                                inside = mask if windows is None else mask & (line >= slots[s][1]) & (line <= slots[s][2])
                                best.offer(s, line[inside], c_ids[inside])
        if found := [(s, *r) for s, rows in enumerate(best.rows) for r in rows]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.int64()))], names=["slot", "score", "other_id"])

    return search


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each slot over all tasks; Spark limits each window group before its shuffle."""
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.col("score").desc(), "other_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _blocks(packed: DataFrame, most_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Packed anchors in blocks of about `most_rows`, each under twice that; one is on the driver at a time."""
    held = []

    def joined():
        dim = max(x[3].shape[1] for x in held)
        return *(np.concatenate([x[c] for x in held]) for c in range(3)), np.concatenate([padded(x[3], dim) for x in held])

    for row in packed.toLocalIterator():
        held.append(unpacked(row.asDict()))
        if sum(len(x[0]) for x in held) >= most_rows:
            yield joined()
            held = []
    if held:
        yield joined()


def mine(vectors: DataFrame, is_anchor: Column, scale: int = 256, n_positives: int = 5, n_negatives: int = 5, low_percent: int = 80, bucket_rows: int = 2048, block_bytes: int = 8 << 20) -> DataFrame:
    """vectors: id, label, vector.  Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    scratch = common.Scratch(spark, "negatives")
    rows = usable(vectors, scale)
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    parts = common.partitions_for(spark, n, 64 * bucket_rows)
    order = [F.col("norm").desc(), F.col("id")]
    buckets = scratch.store(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_packer(bucket_rows), BUCKET), "buckets")
    block_rows = max(1, block_bytes // (8 * max(1, dim or 0)))
    packed = scratch.store(rows.where(is_anchor).mapInArrow(_packer(block_rows), BUCKET), "anchors")

    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    scratch.store(spark.createDataFrame([], out), "found/block=-1")
    for at, arrays in enumerate(_blocks(packed, block_rows)):
        block = spark.sparkContext.broadcast(arrays)
        near = _ranked(buckets.mapInArrow(_searcher(block, n_positives), FOUND), n_positives).select("slot", "other_id", "score").collect()
        slots, names = [], []
        for r in sorted(near, key=lambda r: (r.slot, -r.score, r.other_id)):
            if r.score >= 0:
                slots.append((r.slot, -(-low_percent * r.score // 100), r.score))
                names.append((len(names), int(arrays[0][r.slot]), r.other_id, r.score))
        if slots:
            windows = spark.sparkContext.broadcast(slots)
            least = min(low / arrays[2][i] if arrays[2][i] else 0.0 for i, low, _ in slots) * (1 - 1e-9)
            found = buckets.where(~(F.col("top_norm") < float(least))).mapInArrow(_searcher(block, n_negatives, windows), FOUND)
            name = F.broadcast(spark.createDataFrame(names, "n_slot int, anchor_id long, positive_id long, positive_score long"))
            pairs = _ranked(found, n_negatives).join(name, F.col("slot") == F.col("n_slot"))
            scratch.store(pairs.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), f"found/block={at}")
            windows.unpersist()
        block.unpersist()
    return spark.read.schema(out).parquet(f"{scratch.base}/found").drop("block")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = common.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(v.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same AND other_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
"""
