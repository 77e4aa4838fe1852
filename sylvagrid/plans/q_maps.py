"""Queries over maps: masking, ensembles, agreement with another product."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import MAP_STRIDE, PATCH_HALF
from ..functions.text import landcover_name
from ..operators import maps, metrics, raster
from .q_raster import HALF
from .registry import query, r, rounded

MASKED = "SELECT seed, row_, col_, CASE WHEN agbd < 450 THEN agbd END AS agbd, ref_agb FROM fx_maps"
ENS = f"""ens AS (SELECT row_, col_, CASE WHEN COUNT(agbd) = 3 THEN AVG(agbd) END AS mean_agbd,
  CASE WHEN COUNT(agbd) = 3 THEN STDDEV_SAMP(agbd) END AS std_agbd FROM ({MASKED}) m GROUP BY 1, 2)"""


def masked(t):
    return maps.mask_artifacts(t.fx_maps)


def ens(t):
    return maps.ensemble(masked(t), 3)


def product(t):
    return t.fx_maps.where("seed = 42").select("row_", "col_", "ref_agb")


def ours(t):
    return ens(t).select("row_", "col_", F.col("mean_agbd").alias("agbd"))


@query("flt12_artifact_mask", MASKED)
def flt12(t):
    return maps.mask_artifacts(masked(t))  # twice: idempotent


@query("rst10_artifact_report", """SELECT seed, COUNT(agbd) AS n_valid, COUNT(*) FILTER (agbd >= 450) AS n_artifact,
  ROUND(COUNT(*) FILTER (agbd >= 450) * 100e0 / COUNT(agbd), 6) AS artifact_pct FROM fx_maps GROUP BY 1""")
def rst10(t):
    return rounded(maps.artifact_report(t.fx_maps, ["seed"]), ["artifact_pct"])


@query("agg10_ensemble", f"""WITH {ENS} SELECT row_, col_, ROUND(mean_agbd, 6) AS mean_agbd, ROUND(std_agbd, 6) AS std_agbd FROM ens""")
def agg10(t):
    return rounded(ens(t), ["mean_agbd", "std_agbd"])


@query("agg11_coefficient_of_variation", f"""WITH {ENS} SELECT ROUND(AVG(CASE WHEN mean_agbd > 10 THEN std_agbd / mean_agbd * 100 END), 6)
  AS cv_mean_pct FROM ens""")
def agg11(t):
    return ens(t).agg(maps.mean_cv()).select(r("cv_mean_pct"))


@query("rst9_ensemble_summary", f"""WITH {ENS} SELECT COUNT(mean_agbd) AS n_valid, ROUND(MIN(mean_agbd), 6) AS mean_min,
  ROUND(AVG(mean_agbd), 6) AS mean_mean, ROUND(MAX(mean_agbd), 6) AS mean_max, ROUND(MIN(std_agbd), 6) AS std_min,
  ROUND(AVG(std_agbd), 6) AS std_mean, ROUND(MAX(std_agbd), 6) AS std_max,
  ROUND(AVG(CASE WHEN mean_agbd > 10 THEN std_agbd / mean_agbd * 100 END), 6) AS cv_mean_pct,
  ROUND(quantile_cont(mean_agbd, 0.5), 6) AS mean_median, ROUND(quantile_cont(std_agbd, 0.5), 6) AS std_median,
  ROUND(quantile_cont(std_agbd, 0.95), 6) AS std_p95 FROM ens""")
def rst9(t):
    d = maps.ensemble_summary(ens(t))
    return rounded(d, [c for c in d.columns if c != "n_valid"])


@query("set4_valid_in_all", "SELECT row_, col_ FROM fx_maps WHERE agbd IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) = 3")
def set4(t):
    return maps.ensemble(t.fx_maps, 3).where(F.col("mean_agbd").isNotNull()).select("row_", "col_")


@query("agg24_map_coverage", """SELECT seed, COUNT(*) AS n_cells, COUNT(agbd) AS n_valid,
  ROUND(COUNT(agbd) * 100e0 / COUNT(*), 6) AS coverage_pct FROM fx_maps GROUP BY 1""")
def agg24(t):
    return rounded(maps.coverage(t.fx_maps, ["seed"]), ["coverage_pct"])


@query("jn8_map_by_map", """SELECT a.row_, a.col_, a.agbd AS a, b.agbd AS b FROM fx_maps a JOIN fx_maps b
  ON a.row_ = b.row_ AND a.col_ = b.col_ WHERE a.seed = 42 AND b.seed = 7""")
def jn8(t):
    m = t.fx_maps
    shape = F.broadcast(raster.require_one_grid(m, "seed"))  # one row; an error on different grids
    a = m.where("seed = 42").select("row_", "col_", F.col("agbd").alias("a"))
    b = m.where("seed = 7").select("row_", "col_", F.col("agbd").alias("b"))
    return a.join(b, ["row_", "col_"]).crossJoin(shape).where("n_maps > 0").select("row_", "col_", "a", "b")


PAIRS = f"""WITH {ENS}, pairs AS (SELECT e.mean_agbd AS y, f.ref_agb AS x FROM ens e JOIN fx_maps f ON f.row_ = e.row_ AND f.col_ = e.col_
  AND f.seed = 42 WHERE e.mean_agbd IS NOT NULL AND f.ref_agb > 0)"""
AGREE = """COUNT(*) AS n, ROUND(SQRT(AVG((y - x) * (y - x))), 6) AS rmse, ROUND(AVG(ABS(y - x)), 6) AS mae, ROUND(AVG(y - x), 6) AS bias,
  ROUND(CASE WHEN COUNT(*) > 1 THEN CORR(y, x) END, 6) AS corr, ROUND(AVG(y), 6) AS our_mean, ROUND(AVG(x), 6) AS ref_mean"""
AGREE_COLS = ["rmse", "mae", "bias", "corr", "our_mean", "ref_mean"]


@query("agg7_agreement", f"{PAIRS} SELECT {AGREE} FROM pairs")
def agg7(t):
    return rounded(metrics.agreement(maps.forest_pairs(ours(t), product(t)), "agbd", "ref_agb"), AGREE_COLS)


BIN_PAIRS = " UNION ALL ".join(
    f"SELECT 'ref_{lo}-{hi}' AS stratum, {AGREE} FROM pairs WHERE x >= {lo} AND x < {hi}"
    for lo, hi in ((0, 50), (50, 100), (100, 150), (150, 200), (200, 300)))


@query("agg8_agreement_by_bin", f"{PAIRS} SELECT 'overall' AS stratum, {AGREE} FROM pairs UNION ALL {BIN_PAIRS}")
def agg8(t):
    return rounded(metrics.agreement_by_bin(maps.forest_pairs(ours(t), product(t)), "agbd", "ref_agb"), AGREE_COLS)


FACTOR = 2
# The product on a grid of pixels twice as wide, mixed at our pixel centers.
ON_OURS = f"""coarse AS (SELECT CAST(FLOOR(row_ / {FACTOR}e0) AS BIGINT) AS r, CAST(FLOOR(col_ / {FACTOR}e0) AS BIGINT) AS c, AVG(ref_agb) AS v
  FROM fx_maps WHERE seed = 42 GROUP BY 1, 2),
place AS (SELECT row_, col_, mean_agbd, (row_ + 0.5e0) / {FACTOR} - 0.5e0 AS sy, (col_ + 0.5e0) / {FACTOR} - 0.5e0 AS sx FROM ens),
corner AS (SELECT row_, col_, mean_agbd, CAST(FLOOR(sy) AS BIGINT) + i AS r, CAST(FLOOR(sx) AS BIGINT) + j AS c,
  (1 - ABS(sy - FLOOR(sy) - i)) * (1 - ABS(sx - FLOOR(sx) - j)) AS w FROM place CROSS JOIN (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) b(j)),
matched AS (SELECT row_, col_, mean_agbd AS y, SUM(w * v) / SUM(w) AS x FROM corner JOIN coarse USING (r, c) GROUP BY ALL)"""


def coarse_product(t):
    return raster.averaged_overview(product(t), ["ref_agb"], FACTOR)


@query("rst11_product_comparison", f"""WITH {ENS}, {ON_OURS}, pairs AS (SELECT y, x FROM matched WHERE y IS NOT NULL AND x > 0)
SELECT 'overall' AS stratum, {AGREE} FROM pairs UNION ALL {BIN_PAIRS}""")
def rst11(t):
    return rounded(maps.compare_with_product(ours(t), coarse_product(t), FACTOR), AGREE_COLS)


@query("agg18_linear_fit", f"""{PAIRS} SELECT ROUND(REGR_SLOPE(y, x), 6) AS slope, ROUND(REGR_INTERCEPT(y, x), 6) AS intercept,
  COUNT(*) AS n FROM pairs""")
def agg18(t):
    return rounded(metrics.linear_fit(maps.forest_pairs(ours(t), product(t)), "ref_agb", "agbd"), ["slope", "intercept"])


ZERO = f"""WITH {ENS}, z AS (SELECT g.lc_class, e.mean_agbd AS v FROM ens e JOIN fx_maps f ON f.row_ = e.row_ AND f.col_ = e.col_
  AND f.seed = 42 JOIN fx_grid g ON g.row_ = e.row_ AND g.col_ = e.col_ WHERE e.mean_agbd IS NOT NULL AND f.ref_agb = 0)"""
ZERO_ROWS = ZERO + """ SELECT lc_class, CASE lc_class WHEN 10 THEN 'tree_cover' WHEN 30 THEN 'grassland' WHEN 40 THEN 'cropland'
  WHEN 50 THEN 'built_up' END AS lc_name, COUNT(*) AS n, ROUND(COUNT(*) * 100e0 / (SELECT COUNT(*) FROM z), 6) AS pct_of_zero,
  ROUND(AVG(v), 6) AS our_mean_agbd FROM z WHERE lc_class <> 0 GROUP BY 1"""


def zero_table(t):
    return rounded(maps.zero_by_class(ours(t), product(t), t.fx_grid), ["pct_of_zero", "our_mean_agbd"])


@query("agg9_share_by_class", ZERO_ROWS)
def agg9(t):
    return zero_table(t)


# How far the ensemble's members lie apart, in steps, against land cover.
STEPS = (5.0, 20.0)
CROSS = f"""WITH {ENS}, d AS (SELECT g.lc_class, e.mean_agbd AS v, CASE WHEN std_agbd < {STEPS[0]!r}e0 THEN 'low' WHEN std_agbd < {STEPS[1]!r}e0 THEN 'middle'
  ELSE 'high' END AS disagreement FROM ens e JOIN fx_grid g ON g.row_ = e.row_ AND g.col_ = e.col_ WHERE e.std_agbd IS NOT NULL AND g.lc_class <> 0)
SELECT lc_class, disagreement, COUNT(*) AS n, ROUND(COUNT(*) * 100e0 / SUM(COUNT(*)) OVER (PARTITION BY lc_class), 6) AS pct_of_class,
  ROUND(AVG(v), 6) AS mean_agbd FROM d GROUP BY 1, 2"""


@query("rst12_disagreement_crosstab", CROSS)
def rst12(t):
    d = maps.disagreement_crosstab(ens(t), t.fx_grid.select("row_", "col_", "lc_class"), STEPS)
    return d.select("lc_class", "disagreement", "n", r("pct_of_class"), r("mean_agbd"))


@query("rst12_zero_of_product", ZERO_ROWS + " ORDER BY 1")
def rst12_zero(t):
    return zero_table(t).orderBy("lc_class")


@query("jn9_three_way", f"""WITH {ENS} SELECT e.row_, e.col_, ROUND(e.mean_agbd, 6) AS agbd, f.ref_agb, g.lc_class FROM ens e
JOIN fx_maps f ON f.row_ = e.row_ AND f.col_ = e.col_ AND f.seed = 42 JOIN fx_grid g ON g.row_ = e.row_ AND g.col_ = e.col_""")
def jn9(t):
    return ours(t).join(product(t), ["row_", "col_"]).join(
        t.fx_grid.select("row_", "col_", "lc_class"), ["row_", "col_"]).select(
        "row_", "col_", r("agbd"), "ref_agb", "lc_class")


@query("jn12_code_names", """SELECT patch_id, CASE lc_class WHEN 10 THEN 'tree_cover' WHEN 20 THEN 'shrubland' WHEN 30 THEN 'grassland'
  WHEN 40 THEN 'cropland' WHEN 80 THEN 'water' WHEN 90 THEN 'wetland' ELSE 'unknown' END AS lc_name
FROM (SELECT patch_id, CASE WHEN lc_class = 50 THEN 51 ELSE lc_class END AS lc_class FROM fx_patch_landcover) q""")
def jn12(t):
    code = F.when(F.col("lc_class") == 50, 51).otherwise(F.col("lc_class"))
    return t.fx_patch_landcover.select("patch_id", landcover_name(code).alias("lc_name"))


BANDS = ("band1", "band2")
WEIGHTS = {"band1": 60.0, "band2": -25.0}
def centers_sql(half, stride):
    return f"""mx AS (SELECT MAX(row_) + 1 AS h, MAX(col_) + 1 AS w FROM fx_grid),
c AS (SELECT g.* FROM fx_grid g, mx WHERE row_ >= {half} AND row_ < h - {half} AND (row_ - {half}) % {stride} = 0 AND col_ >= {half}
  AND col_ < w - {half} AND (col_ - {half}) % {stride} = 0)"""


def map_sql(half, stride):
    area = f"{float((2 * half + 1) ** 2)!r}e0"
    return f"""WITH st AS (SELECT AVG(band1) AS m1, STDDEV_POP(band1) AS s1, AVG(band2) AS m2, STDDEV_POP(band2) AS s2
  FROM fx_grid), z AS (SELECT row_, col_, (band1 - m1) / s1 AS z1, (band2 - m2) / s2 AS z2 FROM fx_grid, st), {centers_sql(half, stride)}
SELECT CAST((c.row_ - {half}) / {stride} AS BIGINT) AS row_, CAST((c.col_ - {half}) / {stride} AS BIGINT) AS col_,
  CASE WHEN MAX(c.band1) IS NOT NULL THEN ROUND(LEAST(GREATEST(80e0 + 60e0 * COALESCE(SUM(z1), 0e0) / {area}
    - 25e0 * COALESCE(SUM(z2), 0e0) / {area}, 0e0), 500e0), 6) END AS agbd
FROM c JOIN z ON z.row_ BETWEEN c.row_ - {half} AND c.row_ + {half} AND z.col_ BETWEEN c.col_ - {half} AND c.col_ + {half}
GROUP BY c.row_, c.col_"""


CENTERS = centers_sql(HALF, 3)


def stride_map(t, half, stride):
    g = t.fx_grid.select("row_", "col_", *BANDS)
    norm = raster.band_stats(g, list(BANDS)).select(F.col("band").alias("channel"), "mean", "std")
    return rounded(maps.stride_map(g, BANDS, norm, WEIGHTS, 80.0, half=half, stride=stride), ["agbd"])


@query("rst8_stride_map", map_sql(HALF, 3))
def rst8(t):
    return stride_map(t, HALF, 3)


@query("rst8_full_geometry", map_sql(PATCH_HALF, MAP_STRIDE))
def rst8_full(t):
    """Windows of 25 x 25 pixels at every tenth pixel, as maps are made."""
    return stride_map(t, PATCH_HALF, MAP_STRIDE)


@query("flt11_center_pixel_mask", f"""WITH {CENTERS} SELECT CAST((row_ - {HALF}) / 3 AS BIGINT) AS row_,
  CAST((col_ - {HALF}) / 3 AS BIGINT) AS col_, band1 IS NOT NULL AS valid FROM c""")
def flt11(t):
    g = t.fx_grid.select("row_", "col_", *BANDS)
    norm = raster.band_stats(g, list(BANDS)).select(F.col("band").alias("channel"), "mean", "std")
    m = maps.stride_map(g, BANDS, norm, WEIGHTS, 80.0, half=HALF, stride=3)
    return m.select("row_", "col_", F.col("agbd").isNotNull().alias("valid"))
