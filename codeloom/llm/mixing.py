"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: sources share `share` of all tokens by weight; a target stops at `most` times its
   source's size and the excess is shared again by weight among the rest.
2. Blocks of `block_tokens` tokens are given to sources by highest quotients, then each source's
   blocks to its shards by highest quotients on the shards' sizes.
3. In a shard, documents stand in seeded order and their tokens form one stream cut into blocks.
   Every block is taken quota // blocks times; quota % blocks of them once more, those that a seeded
   permutation of the shard's blocks (b -> a b + c modulo their number, a without common divisor)
   puts first.  A document takes the tokens of the taken blocks that lie in it.

Shards hold about `shard_tokens` tokens and at most about `shard_rows` rows, so a hot source is many
shards; rows go to shards by doc_id and text, so null or repeated ids with different texts spread.
Only one row per source and one per shard reach the driver.  Defined results: null and empty texts have size 0 and take 0;
a null source is a source of its own (last); repeated rows are documents of their own, told apart
by nothing but their place; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

WEIGHTS = (5, 2, 1)
#: Shard quotas are broadcast up to this many shards (about 64 bytes each), joined by shuffle beyond.
BROADCAST_SHARDS = 200_000


def sainte_lague(weights: Sequence[float], seats: int) -> np.ndarray:
    """Seats by the highest quotients w / (2 s + 1); ties go to the earlier party."""
    w = np.asarray(weights, float)
    out = np.zeros(len(w), np.int64)
    if seats <= 0 or not len(w) or w.max() <= 0:
        return out
    lo, hi = 0.0, 2 * (seats + len(w)) / w.sum() + 2 / w.max()
    for _ in range(100):  # the largest multiplier that gives out no more than the seats
        mid = (lo + hi) / 2
        if np.floor(w * mid + 0.5).sum() <= seats:
            lo = mid
        else:
            hi = mid
    out = np.floor(w * lo + 0.5).astype(np.int64)
    heap = [(-w[i] / (2 * out[i] + 1), i) for i in range(len(w)) if w[i] > 0]
    heapq.heapify(heap)
    for _ in range(int(seats - out.sum())):
        _, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (-w[i] / (2 * out[i] + 1), i))
    return out


def targets(sizes: Sequence[int], share: float = 1.5, most: float = 2.0, weights: Sequence[int] = WEIGHTS) -> list[float]:
    """Targets of sources already in order; the excess over `most` x size is reshared by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out: list[float] = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(w[i] for i in open_)
        full = [i for i in open_ if left * w[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in full]
    return out


def permutation(n: int, seed: str) -> tuple[int, int]:
    """a, c of the seeded permutation b -> (a b + c) mod n of n blocks, which leaves the last, short block last."""
    rng = random.Random(seed)
    a = rng.randrange(1, max(2, n))
    while math.gcd(a, n) > 1:
        a = rng.randrange(1, n)
    return a, (n - 1) * (1 - a) % max(1, n)


def mix_sources(
    docs: DataFrame, share: float = 1.5, most: int = 2, weights: Sequence[int] = WEIGHTS, block_tokens: int = 32, shard_tokens: int = 4_000_000, seed: int = 7, shard_rows: int = 200_000
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per document.

    shard_tokens: raise it with the corpus (2**28 gives 100,000 shards at 100 TB).
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", common.word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_mx_at"))
    sized = common.stored(sized, "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    per_source.sort(key=lambda r: (r.source is None, r.source or ""))
    goal = targets([r.s for r in per_source], share, most, weights)
    blocks = sainte_lague(goal, int(sum(goal) // block_tokens))
    shards = {r.source: max(1, -(-r.s // shard_tokens), -(-r.n // shard_rows)) for r in per_source}
    source_schema = T.StructType().add("_mx_source", "string").add("_mx_shards", "long").add("source_size", "long").add("target", "double")
    by_source = spark.createDataFrame([(r.source, shards[r.source], r.s, g) for r, g in zip(per_source, goal)], source_schema)
    placed = sized.join(F.broadcast(by_source), F.col("source").eqNullSafe(F.col("_mx_source")), "left").drop("_mx_source")
    placed = placed.withColumn("_mx_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_mx_at"), "_mx_shards")).drop("_mx_shards")
    per_shard: dict = {}
    for r in placed.groupBy("source", "_mx_shard").agg(F.sum("size").alias("s")).orderBy("source", "_mx_shard").toLocalIterator():
        per_shard.setdefault(r.source, []).append((r._mx_shard, r.s))
    rows = []
    for r, n in zip(per_source, blocks):
        own = sorted(per_shard.get(r.source, []))
        there = [-(-s // block_tokens) for _, s in own]
        quota = [min(int(q), most * b) for q, b in zip(sainte_lague([s for _, s in own], int(n)), there)]
        spare = int(n) - sum(quota)  # what a full shard cannot take goes to those with room
        for i, b in enumerate(there):
            give = min(spare, most * b - quota[i])
            quota[i], spare = quota[i] + give, spare - give
        for (shard, _), q, b in zip(own, quota, there):
            a, c = permutation(b, f"{seed} {r.source} {shard}")
            rows.append((r.source, shard, q // b if b else 0, q % b if b else 0, b, a, c))
    schema = T.StructType().add("_mx_source", "string")
    for name in ("_mx_s", "_mx_base", "_mx_more", "_mx_n", "_mx_a", "_mx_c"):
        schema = schema.add(name, "long")
    quotas = spark.createDataFrame(rows, schema)
    quotas = F.broadcast(quotas) if len(rows) <= BROADCAST_SHARDS else quotas
    order = Window.partitionBy("source", "_mx_shard").orderBy("_mx_at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("_mx_hi", F.sum("size").over(order))
    out = out.join(quotas, F.col("source").eqNullSafe(F.col("_mx_source")) & (F.col("_mx_shard") == F.col("_mx_s")), "left")
    # the words of the document in each block that is taken once more
    lo, hi = "(_mx_hi - size)", "_mx_hi"
    inside = f"cast(least({hi}, (b + 1) * {block_tokens}) - greatest({lo}, b * {block_tokens}) as bigint)"
    extra = F.expr(
        f"CASE WHEN size > 0 AND _mx_more > 0 THEN aggregate(filter(sequence({lo} div {block_tokens}, ({hi} - 1) div {block_tokens}), b -> (_mx_a * b + _mx_c) % _mx_n < _mx_more), "
        f"cast(0 as bigint), (t, b) -> t + {inside}) ELSE cast(0 as bigint) END"
    )
    taken = F.when(F.col("size") > 0, F.col("size") * F.col("_mx_base") + extra).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
