"""Explicit schemas, so that no read infers types."""

from __future__ import annotations

from pyspark.sql import types as T

SHOTS = T.StructType([
    T.StructField("shot_number", T.LongType()),
    T.StructField("lat_lowestmode", T.DoubleType()),
    T.StructField("lon_lowestmode", T.DoubleType()),
    T.StructField("agbd", T.DoubleType()),
    T.StructField("agbd_se", T.DoubleType()),
    T.StructField("l4_quality_flag", T.IntegerType()),
    T.StructField("l2_quality_flag", T.IntegerType()),
    T.StructField("degrade_flag", T.IntegerType()),
    T.StructField("sensitivity", T.DoubleType()),
    T.StructField("delta_time", T.DoubleType()),
    T.StructField("pft_class", T.IntegerType()),
    T.StructField("beam", T.StringType()),
    T.StructField("is_power_beam", T.BooleanType()),
    T.StructField("acq_datetime", T.TimestampType()),
    T.StructField("orbit", T.IntegerType()),
    T.StructField("granule", T.StringType()),
])

SCENE = T.StructType([
    T.StructField("scene_name", T.StringType()),
    T.StructField("acquisition", T.StringType()),
    T.StructField("orbit_direction", T.StringType()),
    T.StructField("path_number", T.LongType()),
    T.StructField("frame_number", T.LongType()),
    T.StructField("polarization", T.StringType()),
    T.StructField("size_gb", T.DoubleType()),
    T.StructField("days_from_15th", T.LongType()),
])

# years -> month -> scene
MANIFEST_YEARS = T.MapType(T.StringType(), T.MapType(T.StringType(), SCENE))

NORM_STAT = T.StructType([
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("n_pixels", T.LongType()),
])

DATASET_META = T.StructType([
    T.StructField("channels", T.ArrayType(T.StringType())),
    T.StructField("normalization", T.MapType(T.StringType(), NORM_STAT)),
])

METRICS = T.StructType(
    [T.StructField("variant", T.StringType())]
    + [T.StructField(f"{m}_{s}", T.DoubleType())
       for m in ("rmse", "mae", "r2", "bias", "rel_rmse_pct") for s in ("mean", "std")]
    + [T.StructField("n_seeds", T.LongType()), T.StructField("n_patches", T.LongType())]
)

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
