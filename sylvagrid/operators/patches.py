"""From points and rasters to training patches: blocks, strata, split, windows, statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (BLOCK_M, CELL_M, LABEL_CAP, N_STRATA, PATCH_HALF, S2_NODATA, TRAIN_FRAC,
                         VAL_FRAC, VALID_YEARS)
from ..functions import geo
from ..functions.text import landcover_name
from ..session import materialize
from .quantiles import table_quantiles
from .ranking import hashed_rank
from .raster import TILE, focal_sums, halo_tiles
from .shots import label_cap, thin_per_cell, year_filter
from .sizing import checked_broadcast

SUMMARY_ROWS = 512  # patches in hand at once when only their summary is kept


def extraction_table(shots: DataFrame, years=VALID_YEARS, cap: float = LABEL_CAP,
                     cell: float = CELL_M, seed: int = 42,
                     keep: Sequence[str] | None = ("shot_number", "agbd", "easting", "northing", "year_")) -> DataFrame:
    """Year filter, label cap and thinning of projected shots, reduced to ``keep``."""
    return thin_per_cell(label_cap(year_filter(shots, years), cap), cell, seed, keep=keep)


def with_blocks(df: DataFrame, size: float = BLOCK_M, x: str = "easting", y: str = "northing") -> DataFrame:
    return df.withColumn("block_id", geo.block_id(x, y, size))


def block_means(df: DataFrame, label: str = "agbd") -> DataFrame:
    """Mean label per block.

    Summed as decimals: the result does not depend on the order in which partial sums
    arrive, so a recomputed block gets the same stratum.
    """
    d = F.col(label).cast("decimal(18,9)")
    return df.where(F.col(label).isNotNull()).groupBy("block_id").agg(
        F.sum(d).cast("double").alias("_s"), F.count(F.lit(1)).alias("n_shots")).select(
        "block_id", (F.col("_s") / F.col("n_shots")).alias("block_mean"), "n_shots")


def block_strata(means: DataFrame, n_strata: int = N_STRATA) -> DataFrame:
    """Quantile stratum (0-based) of each block: right-closed bins, the ends clipped."""
    means = materialize(means)  # a row per block, read twice; cut from the scan of the shots
    edges = table_quantiles(means, "block_mean", {f"_e{k}": k / n_strata for k in range(1, n_strata)})
    above = F.lit(0)
    for k in range(1, n_strata):
        above = above + F.when(F.col("block_mean") > F.col(f"_e{k}"), 1).otherwise(0)
    return means.crossJoin(F.broadcast(edges)).withColumn("stratum", above).select(  # edges: one row
        *means.columns, "stratum")


def block_split(strata: DataFrame, train: float = TRAIN_FRAC, val: float = VAL_FRAC,
                seed: int = 42) -> DataFrame:
    """Split of each block, proportional within its stratum: 0 train, 1 val, 2 test.

    Counts are truncated, so the test split takes what rounding leaves.
    """
    if train + val >= 1.0:
        raise ValueError("train + val must be below 1")
    r = hashed_rank(strata, ["stratum"], "block_id", seed, "_r", "_n")
    n_train = F.floor(F.col("_n") * F.lit(train))
    n_val = F.floor(F.col("_n") * F.lit(val))
    split = F.when(F.col("_r") <= n_train, 0).when(F.col("_r") <= n_train + n_val, 1).otherwise(2)
    return r.withColumn("split", split).drop("_r", "_n")


def stratified_block_split(df: DataFrame, label: str = "agbd", size: float = BLOCK_M,
                           n_strata: int = N_STRATA, train: float = TRAIN_FRAC, val: float = VAL_FRAC,
                           seed: int = 42) -> DataFrame:
    """Shots with block_id and split; all shots of a block share one split.

    The block side of the join back is one row per block, broadcast when it is counted to
    be short. Beyond that (10 km blocks of the whole Earth are about five million) the
    join is shuffled and a block with a third of all shots is split by its skew handling.
    ``df`` is read twice; pass a written table when it is costly.
    """
    b = with_blocks(df, size)
    means = block_means(b, label)
    assigned = block_split(block_strata(means, n_strata), train, val, seed).select("block_id", "split")
    return b.join(checked_broadcast(assigned)[0], "block_id")


def split_summary(df: DataFrame, label: str = "agbd") -> DataFrame:
    """Shots, blocks and mean label per split. Blocks are combined first, so no distinct
    set of block ids is built per split."""
    per_block = df.groupBy("split", "block_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("s"))
    return per_block.groupBy("split").agg(
        F.sum("n").alias("n_shots"), F.count(F.lit(1)).alias("n_blocks"),
        (F.sum("s") / F.sum("n")).alias("mean_label"))


def leaking_blocks(df: DataFrame) -> DataFrame:
    """Blocks found in more than one split; must be empty."""
    return df.groupBy("block_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).where(
        F.col("a") != F.col("b")).select("block_id")


# ---- windows around points ----

def window_keys(centers: DataFrame, half: int) -> DataFrame:
    """Exact pixel keys of the square window around each center (columns crow, ccol)."""
    off = F.sequence(F.lit(-half), F.lit(half))
    return (centers.withColumn("dr", F.explode(off)).withColumn("dc", F.explode(off))
            .withColumn("row_", F.col("crow") + F.col("dr"))
            .withColumn("col_", F.col("ccol") + F.col("dc")))


def read_windows(centers: DataFrame, pixels: DataFrame, bands: Sequence[str], half: int,
                 on: Sequence[str] = ("row_", "col_")) -> DataFrame:
    """Window pixels of each center; a pixel outside the grid stays as a row of NULLs."""
    return window_keys(centers, half).join(pixels.select(*on, *bands), list(on), "left")


def stack_bands(pixels: DataFrame, static: DataFrame | None) -> DataFrame:
    """Yearly bands joined with the bands that do not depend on the year."""
    return pixels if static is None else pixels.join(static, ["row_", "col_"], "left")


def distinct_centers(points: DataFrame) -> DataFrame:
    """Points often share a pixel; each window is cut once per distinct center."""
    return points.select("year", "crow", "ccol").distinct()


def extract_patches(points: DataFrame, pixels: DataFrame, bands: Sequence[str], half: int = PATCH_HALF,
                    drop_incomplete: bool = True) -> DataFrame:
    """Patch of every (year, crow, ccol) point by exact keys: an equi-join, no range join.

    Incomplete windows (outside the grid or any nodata) are dropped before any array is
    built: nodata pixels are filtered out and short windows fail the count. One group
    collects at most (2 * half + 1)**2 pixels, because a pixel table has unique keys.

    The optimizer does not see how much the windows multiply the centers, so neither they
    nor the patches may become a broadcast side: the windows are the preserved side of a
    left join, and the patches are merged with the points on the key they are grouped by.
    """
    side = 2 * half + 1
    w = window_keys(distinct_centers(points), half)
    px = pixels.select("year", "row_", "col_", *bands)
    if drop_incomplete:
        # Only complete pixels count; the Parquet reader also skips by the null statistics.
        px = px.where(valid_pixel(bands))
    px = px.withColumn("_hit", F.lit(True))
    cell = F.struct("dr", "dc", *bands)
    if drop_incomplete:
        cell = F.when(F.col("_hit"), cell)  # the list skips NULL
    g = w.join(px, ["year", "row_", "col_"], "left").groupBy("year", "crow", "ccol").agg(
        F.array_sort(F.collect_list(cell)).alias("cells"))
    if drop_incomplete:
        g = g.where(F.size("cells") == side * side)
    flat = F.flatten(F.array(*[F.col("cells")[b].cast("array<float>") for b in bands]))
    return points.join(g.select("year", "crow", "ccol", flat.alias("patch")).hint("merge"), ["year", "crow", "ccol"])


def extract_patches_tiled(points: DataFrame, pixels: DataFrame, bands: Sequence[str],
                          half: int = PATCH_HALF, tile: int = 64, fill: Sequence[float] | None = None,
                          summary: Callable[[np.ndarray], dict[str, np.ndarray]] | None = None, summary_schema: str = "") -> DataFrame:
    """The same patches by halo tiles: every pixel travels about once instead of once per window.

    A task holds one tile: (tile + 2 * half)**2 pixels and at most tile**2 distinct
    centers, whatever the number of points. With ``fill`` missing pixels take the given
    value per band; without it incomplete windows are dropped.

    ``summary`` takes patches, ``SUMMARY_ROWS`` at most, as (patch, band, pixel) and gives the
    columns of ``summary_schema``, a value per patch. They come back in place of the patch, so
    that no patch leaves its task.
    """
    bands = list(bands)
    side = 2 * half + 1
    span = tile + 2 * half
    centers = distinct_centers(points).withColumns({
        "tile_row": F.floor(F.col("crow") / tile).cast("long"),
        "tile_col": F.floor(F.col("ccol") / tile).cast("long")})
    px = halo_tiles(pixels.select("year", "row_", "col_", *bands), tile, half)
    fills = None if fill is None else np.asarray(fill, dtype="float32")

    added = T.StructType([T.StructField("patch", T.ArrayType(T.FloatType()))]) if summary is None else T._parse_datatype_string(summary_schema)
    empty = pd.DataFrame({c: pd.Series([], dtype=object if c == "patch" else "int64")
                          for c in ("year", "crow", "ccol", *added.names)})

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return empty
        r0 = int(left["tile_row"].iloc[0]) * tile - half
        c0 = int(left["tile_col"].iloc[0]) * tile - half
        block = np.full((len(bands), span, span), np.nan, dtype="float32")
        if len(right):
            rows = right["row_"].to_numpy() - r0
            cols = right["col_"].to_numpy() - c0
            for i, b in enumerate(bands):
                v = right[b].to_numpy(dtype="float32", na_value=np.nan)
                block[i, rows, cols] = np.where(v == S2_NODATA, np.nan, v)
        if fills is not None:
            block = np.where(np.isnan(block), fills[:, None, None], block)
        windows = np.lib.stride_tricks.sliding_window_view(block, (side, side), axis=(1, 2))
        r = left["crow"].to_numpy() - r0 - half
        c = left["ccol"].to_numpy() - c0 - half
        if summary is not None:
            parts = []
            for i in range(0, len(left), SUMMARY_ROWS):
                w = windows[:, r[i:i + SUMMARY_ROWS], c[i:i + SUMMARY_ROWS]].transpose(1, 0, 2, 3).reshape(-1, len(bands), side * side)
                whole = ~np.isnan(w).any(axis=(1, 2))
                part = left.iloc[i:i + SUMMARY_ROWS].loc[whole, ["year", "crow", "ccol"]].reset_index(drop=True)
                parts.append(part.assign(**summary(w[whole])))
            return pd.concat(parts, ignore_index=True)
        cut_out = windows[:, r, c].transpose(1, 0, 2, 3).reshape(len(left), -1)
        keep = ~np.isnan(cut_out).any(axis=1) if fills is None else np.ones(len(left), dtype=bool)
        res = left.loc[keep, ["year", "crow", "ccol"]].reset_index(drop=True)
        res["patch"] = pd.Series(list(cut_out[keep]), dtype=object)
        return res

    keys = ["year", "tile_row", "tile_col"]
    cut_schema = T.StructType([T.StructField("year", T.IntegerType()), T.StructField("crow", T.LongType()),
                               T.StructField("ccol", T.LongType()), *added.fields])
    centers = centers.withColumn("year", F.col("year").cast("int"))
    px = px.withColumn("year", F.col("year").cast("int"))
    # Tiles without a center are dropped before the pixels travel. The tile list has at
    # most one row per tile**2 pixels; its measured size decides the join.
    wanted = centers.select(*keys).distinct()
    px = px.join(wanted, keys, "left_semi")
    patches = centers.groupBy(*keys).cogroup(px.groupBy(*keys)).applyInPandas(cut, cut_schema)
    return points.join(patches.hint("merge"), ["year", "crow", "ccol"])


def patch_pixels(patches: DataFrame, channels: Sequence[str], size: int) -> DataFrame:
    """(channel, value) of every pixel of every patch."""
    area = size * size
    names = F.array(*[F.lit(c) for c in channels])
    e = patches.select(*[c for c in patches.columns if c != "patch"], F.posexplode("patch").alias("pos", "value"))
    return e.withColumn("channel", F.element_at(names, (F.floor(F.col("pos") / area) + 1).cast("int"))).drop("pos")


def normalisation_table(patches: DataFrame, channels: Sequence[str], size: int) -> DataFrame:
    """Mean, population std and pixel count per channel over the training split."""
    px = patch_pixels(patches.where(F.col("split") == 0).select("patch"), channels, size)
    v = F.col("value").cast("double")
    ok = px.where(~F.isnan("value") & (F.col("value") != S2_NODATA))
    return ok.groupBy("channel").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
                                     F.count(v).alias("n_pixels"))


def valid_pixel(bands: Sequence[str]) -> Column:
    """TRUE where no band is missing in any of its codings."""
    ok = F.lit(True)
    for b in bands:
        ok = ok & F.col(b).isNotNull() & (F.col(b) != S2_NODATA) & ~F.isnan(b)
    return ok


def complete_centers(pixels: DataFrame, bands: Sequence[str], half: int, tile: int = TILE) -> DataFrame:
    """Pixels whose whole window is inside the grid and valid, found without cutting any window."""
    side = 2 * half + 1
    v = pixels.select("year", "row_", "col_", F.when(valid_pixel(bands), F.lit(1.0)).alias("_ok"))
    return focal_sums(v, ["_ok"], half, ["year"], tile).where(F.col("_ok__n") == side * side).select(
        "year", "row_", "col_")


def normalisation_by_weights(points: DataFrame, pixels: DataFrame, bands: Sequence[str], half: int,
                             tile: int = TILE) -> DataFrame:
    """The normalisation table of the training patches without the patches.

    A pixel counts once for every training window that covers it, and that number is a
    moving sum of the training points per pixel. So the statistics are one weighted
    aggregate over the grid instead of one value per patch pixel. ``points`` has year,
    crow, ccol and split.
    """
    per_center = points.where(F.col("split") == 0).groupBy(
        "year", F.col("crow").alias("row_"), F.col("ccol").alias("col_")).agg(F.count(F.lit(1)).alias("_c"))
    centers = complete_centers(pixels, bands, half, tile).join(per_center, ["year", "row_", "col_"])
    px = pixels.select("year", "row_", "col_", *[F.col(b).cast("float").cast("double").alias(b) for b in bands])
    px = px.join(centers, ["year", "row_", "col_"], "left")
    w = F.col("_c__s")
    weighted = focal_sums(px, ["_c"], half, ["year"], tile).where(w > 0)
    sums = weighted.agg(*[x for b in bands for x in (
        F.sum(w * F.col(b)).alias(f"{b}__s"), F.sum(w * F.col(b) * F.col(b)).alias(f"{b}__q"))],
        F.sum(w).cast("long").alias("n_pixels"))  # one row
    stats = F.array(*[F.struct(
        F.lit(b).alias("channel"), (F.col(f"{b}__s") / F.col("n_pixels")).alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.col(f"{b}__q") / F.col("n_pixels")
                          - F.pow(F.col(f"{b}__s") / F.col("n_pixels"), 2))).alias("std")) for b in bands])
    # Without a training window there is no row, as in the table from patches.
    return sums.where(F.col("n_pixels") > 0).select(F.explode(stats).alias("x"), "n_pixels").select(
        "x.channel", "x.mean", "x.std", "n_pixels")


def majority_class(centers: DataFrame, landcover: DataFrame, half: int, ident: Sequence[str]) -> DataFrame:
    """Most frequent class of the window clipped to the grid, ties to the smallest code.

    Class 0 (nodata) takes part, and purity divides by the clipped window.
    """
    c = centers.select(*ident, "crow", "ccol")
    distinct = c.select("crow", "ccol").distinct()
    # A left join, so that the windows (many more rows than estimated) are never broadcast.
    counts = (read_windows(distinct, landcover, ["lc_class"], half)
              .groupBy("crow", "ccol", "lc_class").agg(F.count(F.lit(1)).alias("n")))
    inside = F.col("lc_class").isNotNull()
    best = counts.groupBy("crow", "ccol").agg(
        F.max(F.when(inside, F.struct(F.col("n"), (-F.col("lc_class")).alias("neg")))).alias("best"),
        F.sum(F.when(inside, F.col("n"))).alias("total"))
    per_center = best.select("crow", "ccol", (-F.col("best.neg")).cast("int").alias("lc_class"),
                             (F.col("best.n") / F.col("total")).alias("lc_purity"))
    # No overlap with the grid at all: class 0 with purity 0.
    joined = c.join(per_center, ["crow", "ccol"], "left")
    return joined.select(*ident, F.coalesce("lc_class", F.lit(0)).alias("lc_class"),
                         F.coalesce("lc_purity", F.lit(0.0)).alias("lc_purity")).withColumn(
        "lc_name", landcover_name("lc_class"))
