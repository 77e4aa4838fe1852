"""Wall-to-wall maps: stride sampling, masking, ensembles, agreement with a product."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ARTIFACT_MIN, LANDCOVER_NAMES, MAP_MAX, MAP_STRIDE, MIN_STD, PATCH_HALF
from ..functions.cleaning import clip, valid_mask, zscore
from ..functions.text import lookup
from .metrics import agreement_by_bin
from .quantiles import stored_columns, stored_quantiles
from .raster import focal_sums, regrid_bilinear, with_extent


def is_stride_center(height: int | Column, width: int | Column, half: int = PATCH_HALF, stride: int = MAP_STRIDE) -> Column:
    r, c = F.col("row_"), F.col("col_")
    return ((r >= half) & (r < height - half) & ((r - half) % stride == 0)
            & (c >= half) & (c < width - half) & ((c - half) % stride == 0))


def stride_map(pixels: DataFrame, bands: Sequence[str], norm: DataFrame, weights: Mapping[str, float],
               intercept: float, height: int | None = None, width: int | None = None, half: int = PATCH_HALF,
               stride: int = MAP_STRIDE) -> DataFrame:
    """Map of a linear score of window means in normalised space.

    Missing pixels count as the channel mean (0 after normalising), so a window mean is
    the sum over present pixels divided by the full window. The result is clipped to
    [0, 500] and kept only where every channel is present at the window center.
    ``norm`` has one row per channel.
    """
    area = float((2 * half + 1) ** 2)
    wide = norm.agg(*[x for b in bands for x in (
        F.max(F.when(F.col("channel") == b, F.col("mean"))).alias(f"{b}__m"),
        F.max(F.when(F.col("channel") == b, F.col("std"))).alias(f"{b}__d"))])
    if height is None or width is None:
        px = with_extent(pixels)
    else:
        px = pixels.withColumns({"_last_row": F.lit(height - 1), "_last_col": F.lit(width - 1)})
    z = px.crossJoin(F.broadcast(wide)).select(  # wide: one row
        "row_", "col_", "_last_row", "_last_col", *[zscore(b, F.col(f"{b}__m"), F.col(f"{b}__d"), MIN_STD).alias(b) for b in bands])
    ok = F.lit(True)
    for b in bands:
        ok = ok & F.col(b).isNotNull()
    f = focal_sums(z.withColumn("center_ok", ok), list(bands), half).where(
        is_stride_center(F.col("_last_row") + 1, F.col("_last_col") + 1, half, stride))
    score = F.lit(float(intercept))
    for b in bands:
        score = score + F.lit(float(weights[b])) * F.coalesce(F.col(f"{b}__s"), F.lit(0.0)) / area
    return f.select(
        ((F.col("row_") - half) / stride).cast("long").alias("row_"),
        ((F.col("col_") - half) / stride).cast("long").alias("col_"),
        F.when(F.col("center_ok"), clip(score, 0.0, MAP_MAX)).alias("agbd"))


def coverage(maps: DataFrame, by: Sequence[str] = (), value: str = "agbd") -> DataFrame:
    return maps.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"), F.count(value).alias("n_valid"),
                                 (F.count(value) * 100.0 / F.count(F.lit(1))).alias("coverage_pct"))


def mask_artifacts(maps: DataFrame, value: str = "agbd", limit: float = ARTIFACT_MIN) -> DataFrame:
    """Values at or above the limit become nodata; doing it twice changes nothing."""
    return maps.withColumn(value, F.when(F.col(value) < limit, F.col(value)))


def artifact_report(maps: DataFrame, by: Sequence[str], value: str = "agbd",
                    limit: float = ARTIFACT_MIN) -> DataFrame:
    return maps.groupBy(*by).agg(
        F.count(value).alias("n_valid"), F.count_if(F.col(value) >= limit).alias("n_artifact"),
        F.try_divide(F.count_if(F.col(value) >= limit) * 100.0, F.count(value)).alias("artifact_pct"))


def ensemble(maps: DataFrame, n_members: int, value: str = "agbd") -> DataFrame:
    """Mean and sample deviation where all members are valid, NULL elsewhere."""
    full = F.count(value) == n_members
    return maps.groupBy("row_", "col_").agg(
        F.when(full, F.avg(value)).alias("mean_agbd"), F.when(full, F.stddev_samp(value)).alias("std_agbd"))


def mean_cv() -> Column:
    """Mean coefficient of variation in per cent, where the mean is above 10."""
    return F.avg(F.when(F.col("mean_agbd") > 10, F.col("std_agbd") / F.col("mean_agbd") * 100)).alias("cv_mean_pct")


def ensemble_summary(ens: DataFrame) -> DataFrame:
    """Range, mean, median of the mean map; the same and p95 of the deviation; mean CV.

    The two columns are written once; everything is read from there.
    """
    ens, n = stored_columns(ens, ["mean_agbd", "std_agbd"])
    basic = ens.agg(
        F.count("mean_agbd").alias("n_valid"), F.min("mean_agbd").alias("mean_min"),
        F.avg("mean_agbd").alias("mean_mean"), F.max("mean_agbd").alias("mean_max"),
        F.min("std_agbd").alias("std_min"), F.avg("std_agbd").alias("std_mean"),
        F.max("std_agbd").alias("std_max"), mean_cv())
    q = stored_quantiles(ens, n, {"mean_median": ("mean_agbd", 0.5), "std_median": ("std_agbd", 0.5), "std_p95": ("std_agbd", 0.95)})
    return basic.crossJoin(F.broadcast(q))  # one row each


def valid_extent(df: DataFrame, value: str, pad: int = 2) -> DataFrame:
    """Bounding rows and columns of the valid pixels, padded and kept inside the grid."""
    ok = valid_mask(value)
    return df.agg(
        F.greatest(F.min(F.when(ok, F.col("row_"))) - pad, F.lit(0)).alias("r0"),
        F.least(F.max(F.when(ok, F.col("row_"))) + pad, F.max("row_")).alias("r1"),
        F.greatest(F.min(F.when(ok, F.col("col_"))) - pad, F.lit(0)).alias("c0"),
        F.least(F.max(F.when(ok, F.col("col_"))) + pad, F.max("col_")).alias("c1"))


def crop_to_valid(df: DataFrame, value: str, pad: int = 2) -> DataFrame:
    box = valid_extent(df, value, pad)  # one row
    return df.crossJoin(F.broadcast(box)).where(
        F.col("row_").between(F.col("r0"), F.col("r1")) & F.col("col_").between(F.col("c0"), F.col("c1"))
    ).drop("r0", "r1", "c0", "c1")


def forest_pairs(ours: DataFrame, product: DataFrame) -> DataFrame:
    """Pixels where our map is valid and the product claims biomass."""
    both = ours.where(F.col("agbd").isNotNull()).select("row_", "col_", "agbd")
    return both.join(product.where(F.col("ref_agb") > 0).select("row_", "col_", "ref_agb"), ["row_", "col_"])


def on_our_grid(product: DataFrame, ours: DataFrame, factor: float, value: str = "ref_agb") -> DataFrame:
    """A product whose pixels are ``factor`` of ours wide, both grids with one corner, brought to our pixels.

    Our pixel centers are fractional positions in the product's grid; its values are mixed there.
    """
    def place(c: str) -> Column:
        return (F.col(c) + 0.5) / factor - 0.5

    return regrid_bilinear(ours.select("row_", "col_", place("row_").alias("sy"), place("col_").alias("sx")), product, value)


def compare_with_product(ours: DataFrame, product: DataFrame, factor: float = 1.0) -> DataFrame:
    """Agreement overall and by bins of the product's value, after it has been brought to our grid."""
    theirs = product if factor == 1 else on_our_grid(product, ours, factor)
    return agreement_by_bin(forest_pairs(ours, theirs), "agbd", "ref_agb")


def zero_by_class(ours: DataFrame, product: DataFrame, landcover: DataFrame) -> DataFrame:
    """Where the product is zero: pixels, share and our mean per land cover class.

    Class 0 is not reported but stays in the denominator.
    """
    sel = (ours.where(F.col("agbd").isNotNull()).select("row_", "col_", "agbd")
           .join(product.where(F.col("ref_agb") == 0).select("row_", "col_"), ["row_", "col_"])
           .join(landcover.select("row_", "col_", "lc_class"), ["row_", "col_"], "left")
           .withColumn("lc_class", F.coalesce("lc_class", F.lit(0))))
    per = sel.groupBy("lc_class").agg(F.count(F.lit(1)).alias("n"), F.avg("agbd").alias("our_mean_agbd"))
    total = per.agg(F.sum("n").alias("total"))  # one row
    name = lookup("lc_class", LANDCOVER_NAMES, F.concat(F.lit("class_"), F.col("lc_class").cast("string")))
    return per.crossJoin(F.broadcast(total)).where(F.col("lc_class") != 0).select(
        "lc_class", name.alias("lc_name"), "n", (F.col("n") * 100.0 / F.col("total")).alias("pct_of_zero"),
        "our_mean_agbd")


def disagreement_crosstab(ens: DataFrame, landcover: DataFrame, steps: Sequence[float],
                          names: Sequence[str] = ("low", "middle", "high")) -> DataFrame:
    """Pixels, their share of the class and our mean by land cover class and step of the members' deviation.

    ``steps`` are the lower ends of all levels but the first. Pixels are aggregated once; the
    shares come from the few cells of the table.
    """
    level = F.lit(names[0])
    for step, name in zip(steps, names[1:], strict=True):
        level = F.when(F.col("std_agbd") >= step, F.lit(name)).otherwise(level)
    both = ens.where(F.col("std_agbd").isNotNull()).join(landcover.where(F.col("lc_class") != 0), ["row_", "col_"])
    cells = both.groupBy("lc_class", level.alias("disagreement")).agg(F.count(F.lit(1)).alias("n"), F.avg("mean_agbd").alias("mean_agbd"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("lc_class"))  # over a few rows per class
    return cells.withColumn("pct_of_class", share)


def class_distribution(df: DataFrame, code: str = "lc_class", keep_zero: bool = True) -> DataFrame:
    """Count and share per class."""
    d = df if keep_zero else df.where(F.col(code) > 0)
    per = d.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select(
        code, lookup(F.col(code).cast("int"), LANDCOVER_NAMES, "unknown").alias("lc_name"), "n",
        (F.col("n") * 100.0 / F.col("total")).alias("pct"))
