"""Readers: typed, pruned and pushed down to the file format."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..constants import AOIS
from ..functions import geo
from ..functions.cleaning import clean_columns
from ..operators.shots import clip_to_box, quality_filter, tag_beam, tag_granule, with_default_pft


def aoi_table(spark: SparkSession) -> DataFrame:
    """The named areas of interest (a fixed dimension of two rows)."""
    rows = [(n, w, s, e, nn) for n, w, s, e, nn in AOIS]
    arr = F.array(*[F.struct(F.lit(n).alias("aoi"), F.lit(w).alias("west"), F.lit(s).alias("south"),
                             F.lit(e).alias("east"), F.lit(nn).alias("north")) for n, w, s, e, nn in rows])
    return spark.range(1).select(F.explode(arr).alias("x")).select("x.*")


def get_aoi(name: str) -> tuple[float, float, float, float]:
    """(west, south, east, north) of a named area."""
    for n, w, s, e, nn in AOIS:
        if n == name:
            return (w, s, e, nn)
    raise KeyError(f"unknown AOI {name!r}; known: {sorted(a[0] for a in AOIS)}")


def with_aoi(df: DataFrame, name: str | Column) -> DataFrame:
    """Box columns of each row's area; an unknown name is an error that lists the known ones."""
    known = sorted(a[0] for a in AOIS)
    key = F.col(name) if isinstance(name, str) else name
    dim = F.broadcast(aoi_table(df.sparkSession))  # two rows
    j = df.withColumn("_aoi", key).join(dim, F.col("_aoi") == F.col("aoi"), "left")
    ok = F.when(F.col("aoi").isNotNull(), F.col("west")).otherwise(F.raise_error(
        F.concat(F.lit("unknown AOI "), F.coalesce("_aoi", F.lit("NULL")), F.lit(f"; known: {known}"))).cast("double"))
    return j.withColumn("west", ok).drop("_aoi")


def read_shots(spark: SparkSession, path: str, box=None, quality: Mapping | None = None,
               schema: StructType | None = None) -> DataFrame:
    """Shot table, optionally clipped and quality-filtered ({} for the default thresholds).

    Both filters apply to the stored columns, so they reach the Parquet scan; only then
    NaN becomes NULL in the measured columns.
    """
    df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    df = with_default_pft(df)
    if box is not None:
        df = clip_to_box(df, box)
    if quality is not None:
        df = quality_filter(df, quality)
    return clean_columns(df, [c for c in ("agbd", "agbd_se", "sensitivity") if c in df.columns])


GRANULE_FOLDER = "granule="


def read_granules(spark: SparkSession, path: str, box, names: Collection[str] | None = None) -> DataFrame:
    """Granule files: one scan over the files of all granule folders, tagged from each file's path.

    ``names`` keeps some granules. The name is an expression of the file's metadata alone, so
    files of other granules are dropped from the scan before any is opened.
    """
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    name = F.url_decode(F.substring(folder, len(GRANULE_FOLDER) + 1, 1 << 20))
    df = spark.read.schema(schemas.SHOTS).option("recursiveFileLookup", "true").parquet(path)
    if names is not None:
        df = df.where(name.isin(*names))
    df = clip_to_box(df, box).withColumn("granule", name)
    return tag_granule(with_default_pft(tag_beam(df)))


def union_beams(beams: Mapping[str, DataFrame]) -> DataFrame:
    """Union of per-beam tables; a table without a column yields NULL (plant type: -1)."""
    out = None
    for name, df in beams.items():
        tagged = df.withColumn("beam", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return tag_beam(with_default_pft(out))


def read_geo_points(spark: SparkSession, path: str, lonlat: bool = False) -> DataFrame:
    """GeoParquet points without their geometry: the column is never read from disk.

    With ``lonlat`` the geometry, well-known binary, is read as columns ``lon`` and ``lat``.
    """
    df = spark.read.parquet(path)
    if not lonlat:
        return df.drop("geometry")
    lon, lat = geo.wkb_point("geometry")
    return df.withColumns({"lon": lon, "lat": lat}).drop("geometry")


def read_metrics_csv(spark: SparkSession, path: str, schema: StructType = schemas.METRICS) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType().add("aoi_name", "string").add("selection_strategy", "string").add(
        "years", schemas.MANIFEST_YEARS)
    return spark.read.schema(schema).json(path, multiLine=True)


def read_dataset_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DATASET_META).json(path, multiLine=True)


def normalisation_from_meta(meta: DataFrame, channels: Sequence[str], min_std: float = 1e-8) -> DataFrame:
    """(channel, mean, std, n_pixels) of the wanted channels; a near-zero std is an error."""
    m = meta.select(F.explode("normalization").alias("channel", "s")).where(F.col("channel").isin(*channels))
    std = F.when(F.col("s.std") >= min_std, F.col("s.std")).otherwise(F.raise_error(
        F.concat(F.lit("near-zero std for channel "), F.col("channel"))).cast("double"))
    return m.select("channel", F.col("s.mean").alias("mean"), std.alias("std"), "s.n_pixels")


def failed_ids(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct first fields of a tab-separated failure log, in order; blank lines skipped."""
    return (lines.where(F.trim(column) != "")
            .select(F.split_part(F.col(column), F.lit("\t"), F.lit(1)).alias("granule_ur"))
            .distinct().orderBy("granule_ur"))


def read_failure_log(spark: SparkSession, path: str) -> DataFrame:
    return failed_ids(spark.read.text(path))


def select_bands(pixels: DataFrame, bands: Collection[str], keys: Collection[str] = ("year", "row_", "col_")) -> DataFrame:
    """Some bands of a pixel table in the order given; an unknown band is an error, the others are never read."""
    if missing := [b for b in bands if b not in pixels.columns]:
        raise ValueError(f"unknown bands {missing}; known: {pixels.columns}")
    return pixels.select(*keys, *bands)


def raster_year(pixels: DataFrame, static: DataFrame, year: int, bands: Collection[str]) -> DataFrame:
    """Yearly bands of one year (a pruned partition) with the static bands."""
    return pixels.where(F.col("year") == year).select("row_", "col_", *bands).join(
        static, ["row_", "col_"], "left")


def split_rows(patches: DataFrame, split: int) -> DataFrame:
    """Rows of one split (a pruned partition of the stored table); an empty split is an error."""
    rows = patches.where(F.col("split") == split)
    if rows.isEmpty():
        raise ValueError(f"no patches in split {split}")
    return rows


def tile_names(boxes: DataFrame) -> DataFrame:
    """One row per one-degree tile that a (west, south, east, north) box touches."""
    lat = boxes.withColumn("lat", F.explode(geo.degree_span("south", "north")))
    both = lat.withColumn("lon", F.explode(geo.degree_span("west", "east")))
    return both.withColumn("tile", geo.degree_tile_name("lat", "lon"))
