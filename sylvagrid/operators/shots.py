"""Footprint table: clip, tag, quality filter, year and label filters, screening."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from functools import reduce
from itertools import chain
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LABEL_CAP, POWER_BEAMS, QUALITY_DEFAULTS, VALID_YEARS
from ..functions import geo, times
from ..functions.cleaning import nan_to_null
from ..functions.text import hash_order
from .ranking import pick_one


def clip_to_box(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Points inside (west, south, east, north); reaches the Parquet scan as a filter."""
    return df.where(geo.in_box("lon_lowestmode", "lat_lowestmode", *box))


def tag_beam(df: DataFrame) -> DataFrame:
    return df.withColumn("is_power_beam", F.col("beam").isin(*POWER_BEAMS))


def tag_granule(df: DataFrame, name: str = "granule") -> DataFrame:
    """Acquisition time and orbit from the file name."""
    return df.withColumns({"acq_datetime": times.granule_timestamp(name),
                           "orbit": times.granule_orbit(name)})


def with_default_pft(df: DataFrame) -> DataFrame:
    """The plant type is -1 where a source has no such column."""
    if "pft_class" not in df.columns:
        return df.withColumn("pft_class", F.lit(-1))
    return df.withColumn("pft_class", F.coalesce(F.col("pft_class").cast("int"), F.lit(-1)))


# Each quality rule's column, comparison and threshold setting.
QUALITY_RULES = (
    ("l4_quality_flag", "equal", "l4_quality_flag"),
    ("l2_quality_flag", "equal", "l2_quality_flag"),
    ("degrade_flag", "equal", "degrade_flag"),
    ("sensitivity", "least", "min_sensitivity"),
    ("agbd", "least", "min_agbd"),
)


def _quality_parts(quality: Mapping | None) -> dict[str, list[Column]]:
    """Conjuncts of every rule: the comparison, which reaches the scan, and the guard against NaN above it."""
    limits = {**QUALITY_DEFAULTS, **(quality or {})}
    return {c: [F.col(c) == limits[k]] if how == "equal" else [F.col(c) >= limits[k], ~F.isnan(c)] for c, how, k in QUALITY_RULES}


def quality_conditions(quality: Mapping | None = None) -> dict[str, Column]:
    """Named conditions; each one is TRUE or FALSE, never NULL, and NaN fails."""
    return {k: F.coalesce(reduce(and_, parts), F.lit(False)) for k, parts in _quality_parts(quality).items()}


def quality_filter(df: DataFrame, quality: Mapping | None = None) -> DataFrame:
    """Rows that pass every rule."""
    return df.where(reduce(and_, chain.from_iterable(_quality_parts(quality).values())))


def quality_pass_counts(df: DataFrame, quality: Mapping | None = None) -> DataFrame:
    """Rows passing each condition by itself, in one pass: (condition, passed, total)."""
    conds = quality_conditions(quality)
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in conds.items()])
    return one.select("total", F.explode(F.array(*[
        F.struct(F.lit(k).alias("condition"), F.col(k).alias("passed")) for k in conds])).alias("x")
    ).select("x.condition", "x.passed", "total")


YEAR_SOURCES = {  # the first column that a table has tells the year
    "acq_datetime": F.year,
    "acquisition_year": lambda c: F.col(c).cast("int"),
    "year": lambda c: F.col(c).cast("int"),
    "delta_time": lambda c: F.year(times.mission_time(c)),
}


def acquisition_year(columns: Collection[str]) -> Column:
    """Year by the first of ``YEAR_SOURCES`` there is."""
    source = next((c for c in YEAR_SOURCES if c in columns), "delta_time")
    return YEAR_SOURCES[source](source)


def year_filter(df: DataFrame, years: Collection[int] = VALID_YEARS) -> DataFrame:
    return df.withColumn("year_", acquisition_year(df.columns)).where(F.col("year_").isin(*years))


def label_cap(df: DataFrame, cap: float = LABEL_CAP) -> DataFrame:
    """The cap itself is kept; NaN is not."""
    return df.where((F.col("agbd") <= cap) & ~F.isnan("agbd"))


def in_catalogue(df: DataFrame, box: tuple[float, float, float, float],
                 first: str, last: str) -> DataFrame:
    """Catalogue rows whose footprint box touches ``box`` within inclusive dates."""
    w, s, e, n = box
    return df.where((F.col("east") >= w) & (F.col("west") <= e)
                    & (F.col("north") >= s) & (F.col("south") <= n)
                    & times.within_dates("start", first, last))


def granule_counts(df: DataFrame, box: tuple[float, float, float, float],
                   by: str = "granule") -> DataFrame:
    """Shots in the box and shots with a positive label, per granule."""
    return clip_to_box(df, box).groupBy(by).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(nan_to_null("agbd") > 0).alias("n_land"))


def first_land_granule(counts: DataFrame, order: str, first: int = 15, min_land: int = 200) -> DataFrame:
    """First granule with enough land shots among the first ``first`` in catalogue order.

    Both steps keep at most ``first`` rows per task.
    """
    head = counts.orderBy(order).limit(first)
    return head.where(F.col("n_land") >= min_land).orderBy(order).limit(1)


def funnel(df: DataFrame, years: Collection[int], cap: float, cell_size: float, seed: int,
           grid: geo.Grid | None = None, half: int = 0, ident: str = "shot_number") -> DataFrame:
    """Counts after each step of the extraction filter, from one shuffle.

    The scan is combined per thinning cell: a cell yields its three row counts and the
    one shot that survives the thinning, which is then tested against the grid edge.
    """
    in_year = F.coalesce(F.col("year_").isin(*years), F.lit(False))
    kept = in_year & F.coalesce((F.col("agbd") <= cap) & ~F.isnan("agbd"), F.lit(False))
    cells = df.withColumn("year_", acquisition_year(df.columns)).select(
        geo.cell_index("easting", cell_size).alias("cx"), geo.cell_index("northing", cell_size).alias("cy"),
        in_year.alias("in_year"), kept.alias("kept"), "easting", "northing", ident)
    order = F.when(F.col("kept"), F.struct(hash_order(seed, ident), F.col(ident)))
    per_cell = cells.groupBy("cx", "cy").agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_if("in_year").alias("n_year"),
        F.count_if("kept").alias("n_cap"),
        F.min_by(F.struct("easting", "northing"), order).alias("pick"))
    inside = F.lit(True)
    if grid is not None:
        inside = geo.in_bounds(geo.pixel_row("pick.northing", grid), geo.pixel_col("pick.easting", grid),
                               grid, half)
    return per_cell.agg(
        F.sum("n_raw").alias("raw"), F.sum("n_year").alias("after_year_filter"),
        F.sum("n_cap").alias("after_agbd_cap"),
        F.count_if(F.col("n_cap") > 0).alias("after_spatial_subsample"),
        F.count_if((F.col("n_cap") > 0) & inside).alias("after_edge_drop"))


def thin_per_cell(df: DataFrame, cell_size: float, seed: int, ident: str = "shot_number",
                  x: str = "easting", y: str = "northing", keep: Sequence[str] | None = None) -> DataFrame:
    """At most one pseudo-random shot per square cell anchored at (0, 0).

    A picked row travels whole, so name the columns to ``keep`` and only those are read.
    """
    cells = df.withColumns({"_cx": geo.cell_index(x, cell_size), "_cy": geo.cell_index(y, cell_size)})
    if keep is not None:
        cells = cells.select("_cx", "_cy", *dict.fromkeys([ident, *keep]))
    return pick_one(cells, ["_cx", "_cy"], [hash_order(seed, ident), F.col(ident)]).drop("_cx", "_cy")


def with_utm(df: DataFrame, zone: int = 29, lon: str = "lon_lowestmode", lat: str = "lat_lowestmode") -> DataFrame:
    e, n = geo.utm_xy(lon, lat, zone)
    return df.withColumns({"easting": e, "northing": n})
