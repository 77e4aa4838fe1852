"""Rasters as pixel tables (row_, col_, bands...): composites, regridding, focal operators.

A pixel table holds one row per pixel (and year); composites produce such tables.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CLEAR_SCL, MAX_CLOUD
from ..functions import sensors
from ..functions.cleaning import nan_to_null, positive
from .quantiles import group_medians

PIXEL = ("row_", "col_")
TILE = 256  # side of a processing tile in pixels


def clear_sky(obs: DataFrame, bands: Sequence[str], scl: str = "scl",
              keep: Collection[int] = CLEAR_SCL) -> DataFrame:
    """Mask the bands of observations that are not clear; the class column goes."""
    ok = F.col(scl).isin(*keep)
    return obs.withColumns({b: F.when(ok, nan_to_null(b)) for b in bands}).drop(scl)


def low_cloud(obs: DataFrame, limit: float = MAX_CLOUD) -> DataFrame:
    return obs.where(F.col("cloud") <= limit)


def in_area(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int], tile: int = TILE) -> DataFrame:
    """Pixels inside inclusive row and column limits.

    A table stored by tile (columns ``tile_row`` and ``tile_col``) is also cut by the tiles
    that the area touches, so the folders of all others are never listed or read.
    """
    out = pixels.where(F.col("row_").between(*rows) & F.col("col_").between(*cols))
    for key, (low, high) in {"tile_row": rows, "tile_col": cols}.items():
        if key in pixels.columns:
            out = out.where(F.col(key).between(low // tile, high // tile))
    return out


def optical_composite(obs: DataFrame, bands: Sequence[str], years: Collection[int] | None = None,
                      max_cloud: float = MAX_CLOUD, area: tuple[tuple[int, int], tuple[int, int]] | None = None,
                      tile: int = TILE) -> DataFrame:
    """Annual per-pixel band median of clear observations from not too cloudy scenes.

    ``area`` limits it to inclusive (rows, columns) ranges, see ``in_area``.
    """
    o = low_cloud(obs if area is None else in_area(obs, *area, tile), max_cloud)
    if years is not None:
        o = o.where(F.col("year").isin(*years))
    return group_medians(clear_sky(o, bands), ["year", *PIXEL], list(bands))


def index_composite(obs: DataFrame, nir: str, red: str, year: int, month: int) -> DataFrame:
    """Median over one month of the per-observation index (index first, then median)."""
    o = clear_sky(low_cloud(obs).where((F.col("year") == year) & (F.col("month") == month)), [nir, red])
    return group_medians(o.withColumn("ndvi", sensors.ndvi(nir, red)), list(PIXEL), ["ndvi"])


def sar_composite(obs: DataFrame) -> DataFrame:
    """Annual medians in linear power, then decibel; incidence median, then degrees."""
    o = obs.withColumns({"vv": positive("vv"), "vh": positive("vh"), "lia": nan_to_null("lia")})
    m = group_medians(o, ["year", *PIXEL], ["vv", "vh", "lia"])
    return m.select("year", *PIXEL, sensors.to_db("vv").alias("VV_dB"), sensors.to_db("vh").alias("VH_dB"),
                    sensors.to_degrees("lia").alias("LIA_deg"))


def mosaic(tiles: DataFrame, values: Sequence[str], order: str = "tile_order") -> DataFrame:
    """Union of overlapping tiles: the first tile with a value wins in each cell."""
    return tiles.groupBy(*PIXEL).agg(*[
        F.min_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])


def regrid_bilinear(targets: DataFrame, source: DataFrame, value: str,
                    keys: Sequence[str] = PIXEL, y: str = "sy", x: str = "sx", tile: int = TILE) -> DataFrame:
    """Value of ``source`` at fractional pixel positions (whole numbers are pixel centers).

    Source pixels travel once, to the tile they lie in and, on its first row or column, to
    the neighbour whose last gap they close. Targets travel to the tile of the gap they lie
    in and follow its pixels in one stream: a task holds one tile as an array and meets any
    number of targets in batches. Missing corners give their weight up, as nodata does.
    """
    names = [f"_k{i}" for i in range(len(keys))]

    def tiles(c: str) -> Column:
        low, high = F.floor((F.col(c) - 1) / tile).cast("long"), F.floor(F.col(c) / tile).cast("long")
        return F.explode(F.sequence(low, high))

    s = source.select(F.col("row_").cast("double").alias("_y"), F.col("col_").cast("double").alias("_x"),
                      F.col(value).cast("double").alias("_v"), "row_", "col_").where(F.col("_v").isNotNull())
    s = s.withColumn("_tr", tiles("row_")).withColumn("_tc", tiles("col_")).drop("row_", "col_")
    t = targets.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x"),
                       F.floor(F.floor(y) / tile).cast("long").alias("_tr"), F.floor(F.floor(x) / tile).cast("long").alias("_tc"))
    both = s.withColumn("_kind", F.lit(0)).unionByName(t.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    stream = both.repartition("_tr", "_tc").sortWithinPartitions("_tr", "_tc", "_kind").select("_tr", "_tc", "_kind", "_y", "_x", "_v", *names)

    def blend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grid = None, np.full((tile + 1, tile + 1), -np.inf)
        for batch in batches:
            tr, tc, kind, yy, xx, v = (batch[c].to_numpy(zero_copy_only=False) for c in ("_tr", "_tc", "_kind", "_y", "_x", "_v"))
            edges = np.flatnonzero((tr[1:] != tr[:-1]) | (tc[1:] != tc[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(kind)]):
                if a == b:
                    continue
                if (tr[a], tc[a]) != now:
                    now = (tr[a], tc[a])
                    grid.fill(-np.inf)
                if kind[a] == 0:
                    np.maximum.at(grid, ((yy[a:b] - tr[a] * tile).astype(int), (xx[a:b] - tc[a] * tile).astype(int)), v[a:b])
                    continue
                known = np.isfinite(yy[a:b]) & np.isfinite(xx[a:b])
                r, c = np.where(known, yy[a:b], 0.0), np.where(known, xx[a:b], 0.0)
                r0, c0 = np.floor(r), np.floor(c)
                i = np.where(known, r0 - tr[a] * tile, 0).astype(int)
                j = np.where(known, c0 - tc[a] * tile, 0).astype(int)
                top, total = np.zeros(b - a), np.zeros(b - a)
                for di in (0, 1):
                    for dj in (0, 1):
                        w = (r - r0 if di else 1 - (r - r0)) * (c - c0 if dj else 1 - (c - c0))
                        corner = grid[i + di, j + dj]
                        ok = corner > -np.inf
                        top += np.where(ok, w * np.where(ok, corner, 0.0), 0.0)
                        total += np.where(ok, w, 0.0)
                good = known & (total > 0)
                out = pa.array(top / np.where(good, total, 1.0), mask=~good)
                yield pa.RecordBatch.from_arrays([*(batch[n].slice(a, b - a) for n in names), out], [*keys, value])

    schema = T.StructType([T.StructField(k, targets.schema[k].dataType) for k in keys] + [T.StructField(value, T.DoubleType())])
    return stream.mapInArrow(blend, schema)


def regrid_nearest(targets: DataFrame, source: DataFrame, value: str,
                   keys: Sequence[str] = PIXEL, y: str = "sy", x: str = "sx") -> DataFrame:
    """Categorical regrid: the pixel that holds the position, never a mix."""
    t = targets.select(*[F.col(k).alias(f"t_{k}") for k in keys],
                       F.floor(F.col(y) + 0.5).cast("long").alias("row_"),
                       F.floor(F.col(x) + 0.5).cast("long").alias("col_"))
    return t.join(source.select(*PIXEL, value), list(PIXEL), "left").select(
        *[F.col(f"t_{k}").alias(k) for k in keys], value)


def with_extent(df: DataFrame) -> DataFrame:
    """Adds the last row and column of the grid (one aggregated row, joined to every pixel)."""
    return df.crossJoin(F.broadcast(df.agg(F.max("row_").alias("_last_row"), F.max("col_").alias("_last_col"))))


def halo_tiles(pixels: DataFrame, tile: int, half: int) -> DataFrame:
    """Every pixel once per tile whose halo holds it (mostly one, four at a corner)."""
    def tiles(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - half) / tile).cast("long"),
                          F.floor((F.col(c) + half) / tile).cast("long"))

    return (pixels.withColumn("tile_row", F.explode(tiles("row_")))
            .withColumn("tile_col", F.explode(tiles("col_"))))


def gather_tiles(df: DataFrame, keys: Sequence[str], tile: int, half: int) -> DataFrame:
    """Halo tiles with all pixels of a tile in one partition.

    Windows over the rows and over the columns of a tile then need no further shuffle,
    and no window is longer than a tile side with its halo, however wide the grid is.
    """
    return halo_tiles(df, tile, half).repartition(*keys, "tile_row", "tile_col")


def own_pixels(df: DataFrame, tile: int) -> DataFrame:
    """Drops the halo copies: each pixel is kept by the tile it lies in."""
    return df.where((F.floor(F.col("row_") / tile) == F.col("tile_row"))
                    & (F.floor(F.col("col_") / tile) == F.col("tile_col"))).drop("tile_row", "tile_col")


def _gradient(along: str, across: str, value: str, last: Column, step: float) -> Column:
    """Central difference with one-sided ends; NULL next to a missing pixel."""
    w = Window.partitionBy("tile_row", "tile_col", across).orderBy(along)
    at = F.col(along)
    prev = F.when(F.lag(along).over(w) == at - 1, F.lag(value).over(w))
    nxt = F.when(F.lead(along).over(w) == at + 1, F.lead(value).over(w))
    v = F.col(value)
    return (F.when(at == 0, (nxt - v) / step).when(at == last, (v - prev) / step)
            .otherwise((nxt - prev) / (2 * step)))


def slope(df: DataFrame, height: int | None = None, width: int | None = None, value: str = "elevation_m",
          step: float = 10.0, out: str = "slope_deg", tile: int = TILE) -> DataFrame:
    """Slope in degrees from central differences, one-sided at the edges of the grid."""
    if height is None or width is None:
        g = with_extent(df)
    else:
        g = df.withColumns({"_last_row": F.lit(height - 1), "_last_col": F.lit(width - 1)})
    g = gather_tiles(g, [], tile, 1)
    g = g.withColumn("_dx", _gradient("col_", "row_", value, F.col("_last_col"), step))
    g = g.withColumn("_dy", _gradient("row_", "col_", value, F.col("_last_row"), step))
    deg = F.degrees(F.atan(F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))))
    return own_pixels(g.withColumn(out, F.when(F.col(value).isNotNull(), deg)).drop(
        "_dx", "_dy", "_last_row", "_last_col"), tile)


def focal_sums(df: DataFrame, values: Sequence[str], half: int, keys: Sequence[str] = (),
               tile: int = TILE) -> DataFrame:
    """Sum, sum of squares and count of the square window around every pixel.

    Separable: a moving sum along the columns of each row, then along the rows of each
    column. The pixels travel once, to their tiles, whatever the window size.
    """
    keys = list(keys)
    place = [*keys, "tile_row", "tile_col"]
    across = Window.partitionBy(*place, "row_").orderBy("col_").rangeBetween(-half, half)
    down = Window.partitionBy(*place, "col_").orderBy("row_").rangeBetween(-half, half)
    parts = {}
    for v in values:
        parts[f"{v}__s"] = F.col(v)
        parts[f"{v}__q"] = F.col(v) * F.col(v)
        parts[f"{v}__n"] = F.col(v).isNotNull().cast("long")
    d = gather_tiles(df, keys, tile, half)
    columns = d.columns
    d = d.select(*columns, *[e.alias(k) for k, e in parts.items()])
    d = d.select(*columns, *[F.sum(k).over(across).alias(k) for k in parts])
    return own_pixels(d.select(*columns, *[F.sum(k).over(down).alias(k) for k in parts]), tile)


def focal_stats(df: DataFrame, values: Sequence[str], half: int, keys: Sequence[str] = (),
                tile: int = TILE) -> DataFrame:
    """Window mean, population std and valid count of every pixel."""
    s = focal_sums(df, values, half, keys, tile)
    cols = []
    for v in values:
        n = F.col(f"{v}__n")
        mean = F.try_divide(F.col(f"{v}__s"), n)
        var = F.try_divide(F.col(f"{v}__q"), n) - mean * mean
        cols += [mean.alias(f"{v}_mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias(f"{v}_std"),
                 n.alias(f"{v}_n")]
    return s.select(*df.columns, *cols)


def stride_pixels(df: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th pixel of both axes."""
    return df.where((F.col("row_") % step == 0) & (F.col("col_") % step == 0))


def averaged_overview(df: DataFrame, values: Sequence[str], factor: int, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.floor(F.col("row_") / factor).cast("long").alias("row_"),
                      F.floor(F.col("col_") / factor).cast("long").alias("col_")).agg(
        *[F.avg(v).alias(v) for v in values])


def band_stats(df: DataFrame, bands: Sequence[str], positive_only: bool = False) -> DataFrame:
    """Long table of min, max, mean, population std, valid count and valid share per band."""
    def val(b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(b)) if positive_only else F.col(b)

    aggs = [F.count(F.lit(1)).alias("total")]
    for b in bands:
        v = val(b)
        aggs.append(F.struct(F.lit(b).alias("band"), F.min(v).alias("min"), F.max(v).alias("max"),
                             F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
                             F.count(v).alias("n_valid")).alias(b))
    one = df.agg(*aggs)
    return one.select("total", F.explode(F.array(*[F.col(b) for b in bands])).alias("x")).select(
        "x.*", (F.col("x.n_valid") * 100.0 / F.col("total")).alias("valid_pct"))


def grid_shapes(maps: DataFrame, by: str) -> DataFrame:
    return maps.groupBy(by).agg((F.max("row_") + 1).alias("height"), (F.max("col_") + 1).alias("width"))


def require_one_grid(maps: DataFrame, by: str) -> DataFrame:
    """One row (height, width, n_maps); an error when the maps disagree."""
    s = grid_shapes(maps, by).agg(
        F.min("height").alias("height"), F.max("height").alias("h2"),
        F.min("width").alias("width"), F.max("width").alias("w2"), F.count(F.lit(1)).alias("n_maps"))
    same = (F.col("height") == F.col("h2")) & (F.col("width") == F.col("w2"))
    return s.select("height", "width", F.when(same, F.col("n_maps")).otherwise(
        F.raise_error(F.lit("maps are on different grids")).cast("long")).alias("n_maps"))
