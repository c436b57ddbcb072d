"""Running totals in a global order, without one task for all rows.

Rows are range-partitioned and sorted by a unique order, and written once.  Each partition gives its
totals: one row, so that carrying them over all partitions is small.  A row's running value is what
earlier partitions carry plus what its own partition has up to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.graph import _checkpointed

PART, ORDER = "_x_part", "_x_order"


def ordered(df: DataFrame, *order: Column) -> DataFrame:
    """df with its partition in the order; what `carried` works on.  `order` should be unique: ties are in any order, and many of them meet in one partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn(ORDER, F.struct(*(x.alias(f"o{i}") for i, x in enumerate(order))))
    return _checkpointed(keyed.repartitionByRange(n, ORDER).withColumn(PART, F.spark_partition_id()))


def carried(rows: DataFrame, sums: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """rows of `ordered` with running sums up to and with each row, and the greatest of what comes `before` it (null at first)."""
    sums, before = sums or {}, before or {}
    local = Window.partitionBy(PART).orderBy(ORDER)
    upto, earlier = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(PART).agg(*(F.sum(c).alias(f"_x_s_{n}") for n, c in sums.items()), *(F.max(c).alias(f"_x_m_{n}") for n, c in before.items()))
    over = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    carry = totals.select(
        F.col(PART).alias("_x_p"), *(F.coalesce(F.sum(f"_x_s_{n}").over(over), F.lit(0)).alias(f"_x_s_{n}") for n in sums), *(F.max(f"_x_m_{n}").over(over).alias(f"_x_m_{n}") for n in before)
    )
    out = rows.select("*", *(F.sum(c).over(upto).alias(f"_x_l_{n}") for n, c in sums.items()), *(F.max(c).over(earlier).alias(f"_x_k_{n}") for n, c in before.items()))
    out = out.join(F.broadcast(carry), F.col(PART) == F.col("_x_p"))
    found = {n: F.coalesce(F.col(f"_x_l_{n}"), F.lit(0)) + F.col(f"_x_s_{n}") for n in sums} | {n: F.greatest(f"_x_k_{n}", f"_x_m_{n}") for n in before}
    return out.select(*rows.columns, *(c.alias(n) for n, c in found.items()))


def plain(rows: DataFrame) -> DataFrame:
    return rows.drop(PART, ORDER)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with its place in the order, from 1."""
    return plain(carried(ordered(df, *order), {name: F.lit(1).cast("long")}))


def next_fit(rows: DataFrame, group: str, size: str, most: int, *order: Column) -> DataFrame:
    """rows with batch: in the group's order, a new batch when the next row would take its sizes above `most`.

    A row above the bound has a batch of its own; null and negative sizes count as 0.  Prefix sums give each row the row at which
    the batch after its own would begin, if a batch began with it; the batches that do begin are found
    by pointer jumping from each group's first row, in as many rounds as the logarithm of their number.
    """
    cost = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    at = carried(ordered(rows, F.col(group), *order), {"_n_i": F.lit(1).cast("long"), "_n_sum": cost})
    first = at.groupBy(F.col(group).alias("_n_g")).agg(F.min("_n_i").alias("_n_first"), F.max("_n_i").alias("_n_last"), F.min_by(F.col("_n_sum") - cost, "_n_i").alias("_n_base"))
    at = _checkpointed(plain(at).join(first, F.col(group).eqNullSafe(F.col("_n_g"))).drop("_n_g"))
    # a batch from row i holds the rows j with sum(j) <= sum(i) - size(i) + most: both kinds of value in one order
    ends = at.select(F.col("_n_sum").alias("v"), F.lit(0).alias("kind"), "_n_i", "_n_last")
    starts = at.select((F.col("_n_sum") - cost + F.lit(most)).alias("v"), F.lit(1).alias("kind"), "_n_i", "_n_last")
    # sums run over all groups, so they ascend with the row number; a group's last row bounds the count
    met = carried(ordered(ends.unionByName(starts), F.col("v"), F.col("kind"), F.col("_n_i")), {"n": (F.col("kind") == 0).cast("long")}).where("kind = 1")
    far = F.greatest(F.least(F.col("n"), F.col("_n_last")), F.col("_n_i")) + 1
    hop = _checkpointed(met.select(F.col("_n_i").alias("i"), F.when(far <= F.col("_n_last"), far).alias("to")))
    begun = _checkpointed(first.select(F.col("_n_first").alias("i")))
    while True:
        ahead = begun.join(hop, "i").where("to IS NOT NULL").select(F.col("to").alias("i"))
        if ahead.isEmpty():
            break
        begun = _checkpointed(begun.unionByName(ahead).distinct())
        twice = hop.select(F.col("i").alias("to"), F.col("to").alias("beyond"))
        hop = _checkpointed(hop.where("to IS NOT NULL").join(twice, "to").select("i", F.col("beyond").alias("to")).where("to IS NOT NULL"))
    flagged = at.join(begun.select(F.col("i").alias("_n_b")), F.col("_n_i") == F.col("_n_b"), "left")
    counted = carried(ordered(flagged, F.col("_n_i")), {"_n_batch": F.col("_n_b").isNotNull().cast("long")})
    low = counted.groupBy(F.col(group).alias("_n_g")).agg(F.min("_n_batch").alias("_n_low"))
    out = plain(counted).join(low, F.col(group).eqNullSafe(F.col("_n_g")))
    return out.select(*rows.columns, (F.col("_n_batch") - F.col("_n_low")).alias("batch"))


def merged_intervals(rows: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Touching or overlapping [start, end] joined to maximal ones (start, end, n); null bounds take no part."""
    r = rows.select(F.col(start).alias("start"), F.col(end).alias("end")).where("start IS NOT NULL AND end IS NOT NULL")
    at = carried(ordered(r.groupBy("start", "end").agg(F.count(F.lit(1)).alias("n")), F.col("start"), F.col("end")), before={"reach": F.col("end")})
    new = (F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("long")
    runs = carried(_checkpointed(at.withColumn("new", new)), {"run": F.col("new")})
    return runs.groupBy("run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("run")

