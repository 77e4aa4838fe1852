"""Sinks. All of them write from the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo


def write_shards(df: DataFrame, path: str, by: str = "granule") -> None:
    """One folder per input unit; a unit without surviving rows leaves none.

    Rows are rebalanced by unit first: few files for each, several writers for a large one.
    """
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)


def compact_shards(spark: SparkSession, shards: str, out: str, tile_deg: float = 0.25) -> None:
    """Shards to one table clustered by place, so that a box filter skips files.

    Rows are range-partitioned by tile and then shot, so a tile with a third of all rows
    is spread over several files.
    """
    df = spark.read.parquet(shards)
    tiled = df.withColumns({"_ty": geo.cell_index("lat_lowestmode", tile_deg),
                            "_tx": geo.cell_index("lon_lowestmode", tile_deg)})
    (tiled.repartitionByRange("_ty", "_tx", "shot_number")
     .sortWithinPartitions("_ty", "_tx", "shot_number").drop("_ty", "_tx")
     .write.mode("overwrite").parquet(out))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], spread: Sequence[str] = ()) -> None:
    """Partitioned Parquet. With ``spread`` the rows are first range-partitioned by the
    partition columns and ``spread``, so a big partition gets several writers and a small
    one a single file."""
    if spread:
        df = df.repartitionByRange(*by, *spread)
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Keeps an existing output and does nothing then."""
    df.write.mode("ignore").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_raster(pixels: DataFrame, grid: geo.Grid, bands: Sequence[str], path: str,
                 tile: int = 256) -> None:
    """Pixel table clustered by tile, and a one-row table of grid metadata next to it."""
    tiled = pixels.withColumns({"_tr": geo.cell_index("row_", tile), "_tc": geo.cell_index("col_", tile)})
    (tiled.repartitionByRange("_tr", "_tc").sortWithinPartitions("_tr", "_tc", "row_", "col_")
     .drop("_tr", "_tc").write.mode("overwrite").parquet(f"{path}/pixels"))
    grid_row(pixels.sparkSession, grid, bands).write.mode("overwrite").parquet(f"{path}/grid")


def grid_row(spark: SparkSession, g: geo.Grid, bands: Sequence[str]) -> DataFrame:
    return spark.range(1).select(
        F.lit(g.x0).alias("x0"), F.lit(g.y0).alias("y0"), F.lit(g.dx).alias("dx"), F.lit(g.dy).alias("dy"),
        F.lit(g.height).cast("long").alias("height"), F.lit(g.width).cast("long").alias("width"),
        F.lit(g.epsg).alias("epsg"), F.array(*[F.lit(b) for b in bands]).alias("bands"))


def as_json(record: Column, name: str = "json") -> Column:
    return F.to_json(record).alias(name)
