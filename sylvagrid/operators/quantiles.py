"""Exact quantiles (linear interpolation) whose memory does not grow with the data.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer. That
is right for a pixel with some dozens of observations and wrong for a whole table or a
hot group. ``distributed_quantiles`` finds the same order statistics by narrowing:

1. count per logarithmic value bucket (a fixed number of buckets whatever the data),
2. count per linear sub-bucket inside the few buckets that hold a wanted rank,
3. count per distinct value inside the few sub-buckets that hold one.

Every step is a map-side combined count, and every window runs over counts. NaN is skipped
like NULL, and a negative zero is a zero.

Whole-column quantiles write the wanted columns once and never evaluate their source again.
The written rows are counted: up to ``NATIVE_GROUP_ROWS`` of them fit the built-in's buffer,
more are narrowed down. Both give the same bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .sizing import checked_broadcast

_LOG_STEPS = 512        # buckets per unit of log1p: value buckets about 0.2 % wide
_LINEAR_STEPS = 16384   # sub-buckets per value bucket
NATIVE_GROUP_ROWS = 1_000_000


def _value(name: str) -> Column:
    """The column as a double without NaN and negative zero."""
    v = F.col(name).cast("double")
    return F.when(~F.isnan(v), F.when(v == 0, F.lit(0.0)).otherwise(v))


def _log_bucket(v: Column) -> Column:
    # Monotone in v: log1p is semi-monotonic by the Java specification.
    return F.when(v < 0, -F.floor(F.log1p(-v) * _LOG_STEPS) - 1).otherwise(
        F.floor(F.log1p(v) * _LOG_STEPS)).cast("long")


def _ranks(n: Column, probs: Sequence[float]) -> Column:
    """Wanted 0-based ranks as array<struct(p, weight, upper, r)>."""
    items = []
    for p in probs:
        pos = F.lit(float(p)) * (n - 1)
        frac = pos - F.floor(pos)
        for upper, rank in ((False, F.floor(pos)), (True, F.ceil(pos))):
            weight = frac if upper else F.ceil(pos) - pos
            items.append(F.struct(F.lit(float(p)).alias("p"), weight.cast("double").alias("weight"),
                                  F.lit(upper).alias("upper"), rank.cast("long").alias("r")))
    return F.array(*items)


def _locate(counts: DataFrame, keys: list[str], order: str, probs: Sequence[float]) -> DataFrame:
    """Rows of a count table that hold a wanted rank (``_w``), and the rank of their first row."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    c = (counts.withColumn("_hi", F.col("_first") + F.sum("_n").over(upto))
         .withColumn("_lo", F.col("_hi") - F.col("_n")))
    hit = F.filter(_ranks(F.col("_total"), probs), lambda x: (x["r"] >= F.col("_lo")) & (x["r"] < F.col("_hi")))
    return (c.withColumn("_w", hit).where(F.size("_w") > 0)
            .drop("_first").withColumnRenamed("_lo", "_first").drop("_n", "_hi"))


def distributed_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                          keys: Sequence[str] = ()) -> DataFrame:
    """Columns keys..., p, q: one row per group and probability. NULL values are skipped.

    Three scans and three map-side combined counts; nothing is kept per input row.
    """
    keys = list(keys)
    base = df.select(*keys, _value(value).alias("_v")).where(
        F.col("_v").isNotNull()).withColumn("_b1", _log_bucket(F.col("_v")))

    l1 = base.groupBy(*keys, "_b1").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    l1 = l1.withColumn("_total", F.sum("_n").over(w)).withColumn("_first", F.lit(0).cast("long"))
    t1 = _locate(l1, keys, "_b1", probs).drop("_w")

    def sub_bucket() -> Column:
        span = F.col("_max") - F.col("_min")
        return F.when(span > 0, F.floor((F.col("_v") - F.col("_min")) / span * _LINEAR_STEPS)).otherwise(
            0).cast("long")

    # The located buckets: at most two wanted ranks per probability and group.
    carried = [*keys, "_b1", "_min", "_max", "_total", "_first"]
    l2 = base.join(_small(t1, keys), [*keys, "_b1"]).withColumn("_b2", sub_bucket()).groupBy(
        *carried, "_b2").agg(F.count(F.lit(1)).alias("_n"))
    t2 = _locate(l2, [*keys, "_b1"], "_b2", probs).drop("_w")

    l3 = base.join(_small(t2, keys), [*keys, "_b1"]).where(F.col("_b2") == sub_bucket()).groupBy(
        *carried, "_b2", "_v").agg(F.count(F.lit(1)).alias("_n"))
    t3 = _locate(l3, [*keys, "_b1", "_b2"], "_v", probs)

    found = t3.select(*keys, "_v", F.explode("_w").alias("_x"))
    upper = F.col("_x.upper")
    low, high = F.max(F.when(~upper, F.col("_v"))), F.max(F.when(upper, F.col("_v")))
    below, above = F.max(F.when(~upper, F.col("_x.weight"))), F.max(F.when(upper, F.col("_x.weight")))
    # The built-in's own interpolation, so that both ways give the same bits.
    return found.groupBy(*keys, F.col("_x.p").alias("p")).agg(
        F.when(low == high, low).otherwise(below * low + above * high).alias("q"))


def _small(t: DataFrame, keys: list[str]) -> DataFrame:
    # Without keys the table has at most 2 * len(probs) rows; with keys that many per
    # group, and it is counted before it is broadcast.
    return checked_broadcast(t)[0] if keys else F.broadcast(t)


def _native(df: DataFrame, keys: list[str], named: dict[str, tuple[str, float]]) -> DataFrame:
    """Built-in exact percentiles, one buffer per value column for all its probabilities."""
    probs: dict[str, list[float]] = {}
    for v, p in named.values():
        probs.setdefault(v, []).append(float(p))
    buffers = df.groupBy(*keys).agg(*[
        F.percentile(_value(v), F.array(*[F.lit(p) for p in ps])).alias(f"_q_{v}")
        for v, ps in probs.items()])
    return buffers.select(*keys, *[
        F.col(f"_q_{v}")[probs[v].index(float(p))].alias(n) for n, (v, p) in named.items()])


def stored_columns(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, int]:
    """Some columns of a table, written once to the shared folder, and their number of rows."""
    path = scratch_path(df.sparkSession, "columns")
    df.select(*dict.fromkeys(columns)).write.parquet(path)
    kept = df.sparkSession.read.parquet(path)
    return kept, kept.count()


def stored_quantiles(kept: DataFrame, n: int, named: dict[str, tuple[str, float]], native_rows: int = NATIVE_GROUP_ROWS) -> DataFrame:
    """One row: quantiles of the columns of a written table of ``n`` rows (name -> column, p)."""
    if n <= native_rows:
        return _native(kept, [], named)
    values = sorted({v for v, _ in named.values()})
    if len(values) == 1:
        kept = kept.select(F.lit(values[0]).alias("_name"), F.col(values[0]).alias("_value"))
    else:
        kept = kept.select(F.explode(F.array(*[F.struct(F.lit(v).alias("_name"), _value(v).alias("_value")) for v in values])).alias("_x")).select("_x.*")
    q = distributed_quantiles(kept, "_value", sorted({p for _, p in named.values()}), ["_name"])
    return q.agg(*[F.max(F.when((F.col("_name") == v) & (F.col("p") == p), F.col("q"))).alias(n) for n, (v, p) in named.items()])


def columns_quantiles(df: DataFrame, named: dict[str, tuple[str, float]], native_rows: int = NATIVE_GROUP_ROWS) -> DataFrame:
    """One row: quantiles of several columns of a table (name -> column, p)."""
    kept, n = stored_columns(df, sorted({v for v, _ in named.values()}))
    return stored_quantiles(kept, n, named, native_rows)


def table_quantiles(df: DataFrame, value: str, named: dict[str, float], native_rows: int = NATIVE_GROUP_ROWS) -> DataFrame:
    """One row: the named quantiles of a whole column."""
    return columns_quantiles(df, {name: (value, p) for name, p in named.items()}, native_rows)


def group_quantiles(df: DataFrame, keys: Sequence[str], named: dict[str, tuple[str, float]],
                    native_rows: int = NATIVE_GROUP_ROWS) -> DataFrame:
    """Exact quantiles per group: ``named`` maps an output name to (value column, p).

    Groups of up to ``native_rows`` rows use the built-in ``percentile``, one shuffle for
    all columns. Larger groups go through ``distributed_quantiles``, so no task ever holds
    one of them. A counting pass over the key columns finds them; there are at most
    rows / native_rows, and mostly none.
    """
    keys = list(keys)
    values = sorted({v for v, _ in named.values()})
    large, n_large = checked_broadcast(
        df.groupBy(*keys).count().where(F.col("count") > native_rows).select(*keys))
    # Rows travel as plain values and meet their group before any buffer is filled: a
    # serialised percentile buffer per row would be several times the size of the row.
    narrow = df.select(*keys, *values)
    if n_large == 0:
        return _native(narrow.repartition(*keys), keys, named)
    small_groups = _native(narrow.join(large, keys, "left_anti").repartition(*keys), keys, named)

    longer = df.join(large, keys, "left_semi").select(
        *keys, F.explode(F.array(*[
            F.struct(F.lit(v).alias("_name"), _value(v).alias("_value")) for v in values
        ])).alias("_x")).select(*keys, "_x._name", "_x._value")
    q = distributed_quantiles(longer, "_value", sorted({p for _, p in named.values()}), [*keys, "_name"])
    large_groups = q.groupBy(*keys).agg(*[
        F.max(F.when((F.col("_name") == v) & (F.col("p") == p), F.col("q"))).alias(n)
        for n, (v, p) in named.items()])
    # A large group without any value still is a group.
    return small_groups.unionByName(large.join(large_groups, keys, "left"))


def group_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str],
                  native_rows: int = NATIVE_GROUP_ROWS) -> DataFrame:
    return group_quantiles(df, keys, {v: (v, 0.5) for v in values}, native_rows)
