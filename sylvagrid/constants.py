"""Fixed values shared by the operators.

Everything in this module is a contract value (names, codes, thresholds) that
results depend on; none of it is derived.
"""

from __future__ import annotations

# Beam names in order; the power beams are the second half.
BEAMS = (
    "BEAM0000", "BEAM0001", "BEAM0010", "BEAM0011",
    "BEAM0101", "BEAM0110", "BEAM1000", "BEAM1011",
)
POWER_BEAMS = ("BEAM0101", "BEAM0110", "BEAM1000", "BEAM1011")

# Quality thresholds.
QUALITY_DEFAULTS = {
    "l4_quality_flag": 1,
    "l2_quality_flag": 1,
    "degrade_flag": 0,
    "min_sensitivity": 0.95,
    "min_agbd": 0.0,
}

# Footprint file name pattern (year, day of year, h, m, s, orbit).
GRANULE_PATTERN = r"GEDI04_A_(\d{4})(\d{3})(\d{2})(\d{2})(\d{2})_O(\d+)_"
MISSION_EPOCH = "2018-01-01 00:00:00"

# Areas of interest (name, west, south, east, north).
AOIS = (
    ("dev", -8.5, 42.6, -7.3, 43.6),
    ("full", -9.5, 41.5, -5.5, 43.5),
)

# Channel registry; the order is a contract.
S2_BANDS = ("B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B11", "B12")
S1_BANDS = ("VV_dB", "VH_dB", "LIA_deg")
DEM_BANDS = ("elevation_m", "slope_deg")
CHANNELS = S2_BANDS + S1_BANDS + DEM_BANDS
VARIANT_CHANNELS = {
    "s1_only": S1_BANDS + DEM_BANDS,
    "s2_only": S2_BANDS + DEM_BANDS,
    "early": CHANNELS,
    "late": CHANNELS,
}
VARIANT_ORDER = ("s1_only", "s2_only", "early", "late")
VARIANT_LABELS = {
    "s1_only": "S1-only",
    "s2_only": "S2-only",
    "early": "Early fusion",
    "late": "Late fusion",
}
RUN_NAMES = {
    "s1_only": "s1_only",
    "s2_only": "s2_only",
    "early": "early_fusion",
    "late": "late_fusion",
}
SEEDS = (42, 7, 123)

# Nodata sentinels.
S2_NODATA = -32768.0
MAP_NODATA = -9999.0

# Scene classes kept by the clear-sky mask.
CLEAR_SCL = (4, 5, 6, 7)
MAX_CLOUD = 70.0

# Land cover codes.
LANDCOVER_NAMES = {
    10: "tree_cover", 20: "shrubland", 30: "grassland", 40: "cropland",
    50: "built_up", 60: "bare_sparse", 70: "snow_ice", 80: "water",
    90: "wetland", 95: "mangroves", 100: "moss_lichen",
}
REPORTED_LANDCOVER = {10: "tree_cover", 30: "grassland", 40: "cropland"}
LANDCOVER_STRATA = ("tree_cover", "grassland", "cropland", "other")

# Label bins (right-open) of the metric tables.
LABEL_BINS = (0, 50, 100, 150, 200, 500)
PRODUCT_BINS = (0, 50, 100, 150, 200, 300)

# Dataset building and mapping.
VALID_YEARS = (2020, 2021, 2022)
LABEL_CAP = 500.0
CELL_M = 100.0
BLOCK_M = 10_000.0
BLOCK_ID_SCALE = 100_000
TRAIN_FRAC = 0.70
VAL_FRAC = 0.15
N_STRATA = 5
PATCH_HALF = 12
MAP_STRIDE = 10
MAP_MAX = 500.0
ARTIFACT_MIN = 450.0
HUBER_DELTA = 30.0
MIN_STD = 1e-8
PATIENCE = 5
MIN_DELTA = 0.05

# Fixed value: names of the remote jobs that belong to this project.
JOB_PREFIX = "biomass_s1_"
