"""Picking and ranking without putting a whole group into one task.

``row_number`` over a hot group sorts that group in one task. Picks are written as
``min_by`` aggregates instead (combined map-side, one row per group and task), and
ranks and running totals are split over ordered buckets whose offsets are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_order
from ..session import materialize


def pick_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
             largest: bool = False) -> DataFrame:
    """One whole row per group: the smallest (or largest) by ``order``.

    Give ``order`` a unique last element to make the pick deterministic.
    """
    pick = F.max_by if largest else F.min_by
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    picked = df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def pick_hashed(df: DataFrame, keys: Sequence[str], ident: str, seed: int) -> DataFrame:
    """One pseudo-random row per group, reproducible for a seed."""
    return pick_one(df, keys, [hash_order(seed, ident), F.col(ident)])


def hashed_rank(df: DataFrame, keys: Sequence[str], ident: str, seed: int,
                rank: str = "rank", size: str = "group_size") -> DataFrame:
    """Position (1-based) of each row in its group's hash order, and the group size.

    The first three hex digits of the hash cut every group into 4096 even buckets, so
    the sort of the largest group is spread over 4096 tasks; bucket offsets are a table
    of at most 4096 rows per group.
    """
    h = df.withColumn("_h", hash_order(seed, ident)).withColumn("_b", F.substring("_h", 1, 3))
    sizes = h.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        group = Window.partitionBy(*keys)
    else:
        group = Window.partitionBy(F.lit(0))
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(group).alias(size))
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", ident)
    ranked = h.withColumn("_rn", F.row_number().over(inside))
    return (ranked.join(offsets, [*keys, "_b"])
            .withColumn(rank, F.col("_rn") + F.col("_off"))
            .drop("_h", "_b", "_rn", "_off"))


def hashed_sample(df: DataFrame, n: int, ident: str, seed: int) -> DataFrame:
    """Exactly ``n`` rows (or all), the first in hash order.

    Counts per hash prefix (at most 65536 rows) tell how far the sample reaches; only rows
    up to that prefix are sorted, each task keeping ``n`` at most.
    """
    h = df.withColumn("_h", hash_order(seed, ident)).withColumn("_b", F.substring("_h", 1, 4))
    sizes = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    reach = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")).where(
        F.col("_off") < n).agg(F.max("_b").alias("_last"))
    return (h.crossJoin(F.broadcast(reach)).where(F.col("_b") <= F.col("_last"))  # reach: one row
            .orderBy("_h", ident).limit(n).drop("_h", "_b", "_last"))


def running_total(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Global running sum over ``order``, whose columns together are unique.

    The table is cut into even ranges of the order and written once, so that its ranges
    stay put; each range is summed by itself and shifted by the total of the ranges before.
    """
    upto = (Window.unboundedPreceding, 0)
    b = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    totals = b.groupBy("_p").agg(F.sum(value).alias("_t"))  # one row per range
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(*upto)
    return (b.withColumn("_in", F.sum(value).over(inside)).join(F.broadcast(offsets), "_p")
            .withColumn(out, F.col("_in") + F.col("_off")).drop("_p", "_in", "_off"))
