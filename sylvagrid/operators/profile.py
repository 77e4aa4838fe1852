"""Numbers behind the profile of a point table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.cleaning import clip
from .quantiles import columns_quantiles, stored_columns, stored_quantiles, table_quantiles
from .sizing import checked_broadcast

TAIL = {"q0900": 0.90, "q0950": 0.95, "q0990": 0.99, "q0995": 0.995, "q0999": 0.999}


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample std, min, quartiles, max as one row. The column is written once."""
    kept, n = stored_columns(df, [column])
    m = kept.agg(F.count(column).alias("count"), F.avg(column).alias("mean"),
                 F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    q = stored_quantiles(kept, n, {"q25": (column, 0.25), "q50": (column, 0.5), "q75": (column, 0.75)})
    return m.crossJoin(F.broadcast(q))  # one row each


def tail(df: DataFrame, column: str, limits: Sequence[float] = (500, 1000)) -> DataFrame:
    kept, n = stored_columns(df, [column])
    over = kept.agg(*[F.count_if(F.col(column) > x).alias(f"over_{int(x)}") for x in limits])
    return stored_quantiles(kept, n, {name: (column, p) for name, p in TAIL.items()}).crossJoin(F.broadcast(over))


def median_ratio(df: DataFrame, numerator: str, denominator: str) -> DataFrame:
    q = columns_quantiles(df, {"a": (numerator, 0.5), "b": (denominator, 0.5)})
    return q.select(F.try_divide("a", "b").alias("ratio"))


def _bucket(v: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bucket, the upper edge in the last one; one bucket for a constant."""
    i = F.floor((v - low) / (high - low) * bins)
    return F.when(high > low, F.least(i, F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")


def histogram(df: DataFrame, column: str, bins: int = 60, upper: float | None = None,
              by: Sequence[str] = ()) -> DataFrame:
    """Counts per equal-width bin between the smallest and the (clipped) largest value.

    ``by`` gives each group its own range, as overlaid histograms have.
    """
    by = list(by)
    v = df.select(*by, clip(column, high=upper).alias("v")).where(F.col("v").isNotNull())
    span = v.groupBy(*by).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    # Without groups exactly one row; with groups the size is checked before a broadcast.
    joined = v.join(checked_broadcast(span)[0], by) if by else v.crossJoin(F.broadcast(span))
    counted = joined.withColumn("bin", _bucket(F.col("v"), F.col("low"), F.col("high"), bins))
    return counted.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        (F.min("low") + F.col("bin") * (F.min("high") - F.min("low")) / bins).alias("left_edge"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 60) -> DataFrame:
    span = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    b = df.select(x, y).crossJoin(F.broadcast(span))  # span: one row
    return (b.withColumn("bx", _bucket(F.col(x), F.col("x0"), F.col("x1"), bins))
            .withColumn("by", _bucket(F.col(y), F.col("y0"), F.col("y1"), bins))
            .groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n")))


def uncertainty_histogram(df: DataFrame, label: str = "agbd", se: str = "agbd_se",
                          label_below: float = 400.0, bins: int = 60) -> DataFrame:
    """Label against standard error, below a label limit and the 99th percentile of the error."""
    stored, n = stored_columns(df, [label, se])
    limit = stored_quantiles(stored, n, {"p99": (se, 0.99)})
    kept = stored.crossJoin(F.broadcast(limit)).where((F.col(label) < label_below) & (F.col(se) < F.col("p99")))
    return histogram_2d(kept.select(label, se), label, se, bins)


def monthly_counts(df: DataFrame, ts: str) -> DataFrame:
    """Rows per month, months without rows included, with the growing-season flag."""
    counts = df.groupBy(F.date_trunc("month", ts).cast("date").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))
    months = counts.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return months.join(counts, "month", "left").select(
        F.last_day("month").alias("month_end"), F.coalesce("n", F.lit(0)).alias("n"),
        times.growing_season("month").alias("growing"))


def category_counts(df: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """Counts of several categories in one pass: (category, value, n).

    Every row yields one (category, value) pair per category; pairs are combined
    map-side before the shuffle, so only the distinct pairs travel.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("category"), c.cast("string").alias("value"))
                      for k, c in categories.items()])
    return df.select(F.explode(pairs).alias("x")).groupBy("x.category", "x.value").agg(
        F.count(F.lit(1)).alias("n"))


def stretch(df: DataFrame, column: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Percentile stretch of a column to [0, 1]."""
    q = table_quantiles(df, column, {"_lo": low, "_hi": high})
    scaled = (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)
    return df.crossJoin(F.broadcast(q)).withColumn("stretched", clip(scaled, 0.0, 1.0)).drop("_lo", "_hi")


def hexbin(df: DataFrame, x: str, y: str, limit: float, grid: int = 60, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per hexagon on [0, limit]^2: the nearer of two shifted rectangular lattices."""
    ny = int(grid / 3 ** 0.5)
    pad = 1e-9 * limit
    sx, sy = (limit + 2 * pad) / grid, (limit + 2 * pad) / ny
    p = df.select(*keys, ((F.col(x) + pad) / sx).alias("u"), ((F.col(y) + pad) / sy).alias("v"))
    i1, j1, i2, j2 = F.rint("u"), F.rint("v"), F.floor("u"), F.floor("v")
    du1, dv1 = F.col("u") - i1, F.col("v") - j1
    du2, dv2 = F.col("u") - i2 - 0.5, F.col("v") - j2 - 0.5
    d1 = du1 * du1 + 3 * (dv1 * dv1)
    d2 = du2 * du2 + 3 * (dv2 * dv2)
    first = d1 < d2
    hexed = p.select(
        *keys, F.when(first, 0).otherwise(1).alias("lattice"),
        F.when(first, i1).otherwise(i2).cast("long").alias("i"),
        F.when(first, j1).otherwise(j2).cast("long").alias("j"))
    # The lattice limits are tested on aggregated copies of the bin: tested on the bin itself
    # they would move below the aggregate and repeat the distances for every comparison.
    bins = hexed.groupBy(*keys, "lattice", "i", "j").agg(
        F.count(F.lit(1)).alias("n"), F.min("lattice").alias("_l"), F.min("i").alias("_i"), F.min("j").alias("_j"))
    inside = (F.col("_i") >= 0) & (F.col("_j") >= 0) & F.when(
        F.col("_l") == 0, (F.col("_i") <= grid) & (F.col("_j") <= ny)).otherwise(
        (F.col("_i") < grid) & (F.col("_j") < ny))
    return bins.where(inside).drop("_l", "_i", "_j")
