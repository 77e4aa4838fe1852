"""Queries over the footprint table: sources, filters, joins on ids, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..constants import BEAMS
from ..functions import geo
from ..functions.cleaning import clip
from ..operators import patches, ranking, scenes, shots
from ..session import materialize, scratch_path
from ..sources import readers, writers
from .fixtures import BLOCK, CELL, YEARS
from .registry import query, r

BOX = (-8.5, 42.6, -7.3, 43.6)
IN_BOX = "lon_lowestmode BETWEEN -8.5 AND -7.3 AND lat_lowestmode BETWEEN 42.6 AND 43.6"
QUALITY_SQL = ("l4_quality_flag = 1 AND l2_quality_flag = 1 AND degrade_flag = 0 "
               "AND sensitivity >= 0.95e0 AND agbd >= 0")
YEARS_SQL = "EXTRACT(YEAR FROM acq_datetime) IN (1996, 1997, 1998)"

# The split of the flagship query, used by several checks.
SPLIT_SQL = f"""
cand AS (SELECT *, CAST(FLOOR(easting / {CELL}e0) AS BIGINT) AS cx, CAST(FLOOR(northing / {CELL}e0) AS BIGINT) AS cy,
    md5(CONCAT('42|', CAST(shot_number AS VARCHAR(20)))) AS h
  FROM fx_shots WHERE {QUALITY_SQL} AND {YEARS_SQL} AND agbd <= 500),
thin AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cx, cy ORDER BY h, shot_number) AS rn FROM cand) q
  WHERE rn = 1),
blk AS (SELECT *, CAST(FLOOR(easting / {BLOCK}e0) AS BIGINT) * 100000 + CAST(FLOOR(northing / {BLOCK}e0) AS BIGINT)
    AS block_id FROM thin),
bm AS (SELECT block_id, AVG(agbd) AS m FROM blk GROUP BY block_id),
edges AS (SELECT quantile_cont(m, 0.2) AS e1, quantile_cont(m, 0.4) AS e2, quantile_cont(m, 0.6) AS e3,
    quantile_cont(m, 0.8) AS e4 FROM bm),
strat AS (SELECT block_id, m, CASE WHEN m > e1 THEN 1 ELSE 0 END + CASE WHEN m > e2 THEN 1 ELSE 0 END
    + CASE WHEN m > e3 THEN 1 ELSE 0 END + CASE WHEN m > e4 THEN 1 ELSE 0 END AS stratum FROM bm, edges),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY stratum ORDER BY md5(CONCAT('42|', CAST(block_id AS VARCHAR(20)))),
    block_id) AS rn, COUNT(*) OVER (PARTITION BY stratum) AS n FROM strat),
sp AS (SELECT block_id, stratum, m, CASE WHEN rn <= FLOOR(n * 0.7e0) THEN 0
    WHEN rn <= FLOOR(n * 0.7e0) + FLOOR(n * 0.15e0) THEN 1 ELSE 2 END AS split FROM rk),
assigned AS (SELECT blk.*, sp.stratum, sp.split FROM blk JOIN sp ON blk.block_id = sp.block_id)
"""


def extracted(t):
    return patches.extraction_table(shots.quality_filter(t.fx_shots), YEARS, 500.0, CELL)


def assigned(t):
    return patches.stratified_block_split(materialize(extracted(t)), size=BLOCK)


@query("split_summary", f"""WITH {SPLIT_SQL}
SELECT split, COUNT(*) AS n_shots, COUNT(DISTINCT block_id) AS n_blocks, ROUND(AVG(agbd), 6) AS mean_label
FROM assigned GROUP BY split""")
def split_summary(t):
    return patches.split_summary(assigned(t)).select("split", "n_shots", "n_blocks", r("mean_label"))


# ---- sources ----

@query("src1_box_clip", f"""SELECT shot_number, lon_lowestmode, lat_lowestmode, agbd FROM fx_shots
WHERE beam = 'BEAM0101' AND {IN_BOX}""")
def src1(t):
    return shots.clip_to_box(t.fx_shots.where(F.col("beam") == "BEAM0101"), BOX).select(
        "shot_number", "lon_lowestmode", "lat_lowestmode", "agbd")


def beam_tables(t, columns=None):
    """One stored table per beam; together they are read once."""
    path = scratch_path(t.spark, "beams")
    s = t.fx_shots if columns is None else t.fx_shots.select("beam", *columns)
    writers.write_partitioned(s, path, ["beam"])
    return {b: t.spark.read.parquet(f"{path}/beam={b}") for b in BEAMS}


TAGS_SQL = """CASE WHEN granule LIKE 'GEDI04_A_%' THEN CAST(make_timestamp(CAST(SUBSTR(granule, 10, 4) AS BIGINT), 1, 1,
    CAST(SUBSTR(granule, 17, 2) AS BIGINT), CAST(SUBSTR(granule, 19, 2) AS BIGINT),
    CAST(SUBSTR(granule, 21, 2) AS DOUBLE)) + to_days(CAST(SUBSTR(granule, 14, 3) AS INTEGER) - 1) AS VARCHAR) END"""


@query("src2_granule_scan", f"""SELECT granule, {TAGS_SQL} AS acquired,
  CASE WHEN granule LIKE 'GEDI04_A_%' THEN CAST(SUBSTR(granule, 25, 5) AS INTEGER) ELSE -1 END AS orbit,
  beam, beam IN ('BEAM0101', 'BEAM0110', 'BEAM1000', 'BEAM1011') AS is_power_beam, COUNT(*) AS n
FROM fx_shots WHERE {IN_BOX} GROUP BY ALL""")
def src2(t):
    path = scratch_path(t.spark, "granules")
    writers.write_partitioned(t.fx_shots.select("shot_number", "lon_lowestmode", "lat_lowestmode", "pft_class", "beam", "granule"),
                              path, ["granule"], ["shot_number"])
    u = readers.read_granules(t.spark, path, BOX)
    return u.groupBy("granule", "acq_datetime", "orbit", "beam", "is_power_beam").agg(
        F.count(F.lit(1)).alias("n")).withColumn("acquired", F.col("acq_datetime").cast("string")).drop("acq_datetime")


@query("src3_missing_column_default", """SELECT beam, CAST(pft_class AS INTEGER) AS pft_class, COUNT(*) AS n FROM (
  SELECT beam, CASE WHEN beam = 'BEAM1011' THEN -1 ELSE pft_class END AS pft_class FROM fx_shots) q GROUP BY 1, 2""")
def src3(t):
    parts = beam_tables(t, ["shot_number", "pft_class"])
    u = readers.union_beams({**parts, "BEAM1011": parts["BEAM1011"].drop("pft_class")})
    return u.groupBy("beam", "pft_class").agg(F.count(F.lit(1)).alias("n"))


@query("src4_parquet_shots", f"""SELECT beam, COUNT(*) AS n, ROUND(AVG(agbd), 6) AS mean_agbd FROM fx_shots
WHERE {IN_BOX} GROUP BY beam""")
def src4(t):
    path = scratch_path(t.spark, "shots")
    writers.write_table(t.fx_shots, path)
    return readers.read_shots(t.spark, path, BOX).groupBy("beam").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("agbd"), 6).alias("mean_agbd"))


@query("src5_geo_points", "SELECT shot_number, agbd, lon_lowestmode AS lon, lat_lowestmode AS lat FROM fx_shots WHERE agbd > 400")
def src5(t):
    path = scratch_path(t.spark, "geo")
    s = t.fx_shots.select("shot_number", "agbd", geo.point_wkb("lon_lowestmode", "lat_lowestmode").alias("geometry"))
    writers.write_table(s, path)
    return readers.read_geo_points(t.spark, path, lonlat=True).where("agbd > 400").select("shot_number", "agbd", "lon", "lat")


@query("src8_failure_log", """SELECT DISTINCT split_part(value, '\t', 1) AS granule_ur FROM fx_failures
WHERE TRIM(value) <> ''""")
def src8(t):
    path = scratch_path(t.spark, "failures")
    t.fx_failures.write.text(path)
    return readers.read_failure_log(t.spark, path)


@query("src13_split_scan", f"""WITH {SPLIT_SQL} SELECT shot_number, block_id, agbd FROM assigned WHERE split = 1""")
def src13(t):
    return readers.split_rows(assigned(t), 1).select("shot_number", "block_id", "agbd")


@query("src15_catalogue_search", """SELECT granule_ur, west, south, east, north FROM fx_catalogue
WHERE east >= -8.5 AND west <= -7.3 AND north >= 42.6 AND south <= 43.6
  AND CAST(start AS DATE) BETWEEN DATE '1996-06-01' AND DATE '1998-12-31'""")
def src15(t):
    return shots.in_catalogue(t.fx_catalogue, BOX, "1996-06-01", "1998-12-31").select(
        "granule_ur", "west", "south", "east", "north")


# ---- filters ----

@query("flt1_quality_cascade", f"""SELECT shot_number, agbd, sensitivity FROM fx_shots WHERE {QUALITY_SQL}""")
def flt1(t):
    return shots.quality_filter(t.fx_shots).select("shot_number", "agbd", "sensitivity")


@query("flt1_quality_nan_and_override", """SELECT shot_number, agbd FROM fx_shots
WHERE l4_quality_flag = 1 AND l2_quality_flag = 1 AND degrade_flag = 0 AND sensitivity >= 0.98e0
  AND agbd >= 100 AND shot_number % 101 <> 0 AND shot_number % 103 <> 0""")
def flt1b(t):
    nan = F.lit(float("nan"))
    s = t.fx_shots.withColumns({
        "sensitivity": F.when(F.col("shot_number") % 101 == 0, nan).otherwise(F.col("sensitivity")),
        "agbd": F.when(F.col("shot_number") % 103 == 0, nan).otherwise(F.col("agbd"))})
    return shots.quality_filter(s, {"min_sensitivity": 0.98, "min_agbd": 100.0}).select("shot_number", "agbd")


@query("flt2_condition_pass_counts", """SELECT u.condition, u.passed, (SELECT COUNT(*) FROM fx_shots) AS total FROM (
  SELECT 'l4_quality_flag' AS condition, COUNT(*) FILTER (l4_quality_flag = 1) AS passed FROM fx_shots
  UNION ALL SELECT 'l2_quality_flag', COUNT(*) FILTER (l2_quality_flag = 1) FROM fx_shots
  UNION ALL SELECT 'degrade_flag', COUNT(*) FILTER (degrade_flag = 0) FROM fx_shots
  UNION ALL SELECT 'sensitivity', COUNT(*) FILTER (sensitivity >= 0.95e0) FROM fx_shots
  UNION ALL SELECT 'agbd', COUNT(*) FILTER (agbd >= 0) FROM fx_shots) u""")
def flt2(t):
    return shots.quality_pass_counts(t.fx_shots)


@query("flt3_year_membership", f"SELECT shot_number FROM fx_shots WHERE {YEARS_SQL}")
def flt3(t):
    return shots.year_filter(t.fx_shots, YEARS).select("shot_number")


@query("flt3_year_from_delta_time", """SELECT shot_number,
  CAST(EXTRACT(YEAR FROM TIMESTAMP '2018-01-01' + to_microseconds(CAST(delta_time * 1000000 AS BIGINT))) AS INTEGER)
    AS year_ FROM fx_shots
WHERE EXTRACT(YEAR FROM TIMESTAMP '2018-01-01' + to_microseconds(CAST(delta_time * 1000000 AS BIGINT)))
  IN (2020, 2021, 2022)""")
def flt3b(t):
    return shots.year_filter(t.fx_shots.select("shot_number", "delta_time")).select("shot_number", "year_")


@query("flt4_label_cap", "SELECT shot_number, agbd FROM fx_shots WHERE agbd <= 500")
def flt4(t):
    return shots.label_cap(t.fx_shots).select("shot_number", "agbd")


GRID = geo.Grid(500000.0, 4746000.0, 10.0, 10.0, 3000, 3000)

FUNNEL_SQL = f"""WITH picks AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY CAST(FLOOR(easting / {CELL}e0) AS BIGINT),
    CAST(FLOOR(northing / {CELL}e0) AS BIGINT) ORDER BY md5(CONCAT('42|', CAST(shot_number AS VARCHAR(20)))),
    shot_number) AS rn FROM fx_shots WHERE {YEARS_SQL} AND agbd <= 500),
px AS (SELECT FLOOR((4746000e0 - northing) / 10e0) AS rr, FLOOR((easting - 500000e0) / 10e0) AS cc
  FROM picks WHERE rn = 1)
SELECT (SELECT COUNT(*) FROM fx_shots) AS raw,
  (SELECT COUNT(*) FROM fx_shots WHERE {YEARS_SQL}) AS after_year_filter,
  (SELECT COUNT(*) FROM fx_shots WHERE {YEARS_SQL} AND agbd <= 500) AS after_agbd_cap,
  (SELECT COUNT(*) FROM px) AS after_spatial_subsample,
  (SELECT COUNT(*) FROM px WHERE rr >= 12 AND rr < 2988 AND cc >= 12 AND cc < 2988) AS after_edge_drop"""


@query("flt5_funnel_counts", FUNNEL_SQL)
def flt5(t):
    return shots.funnel(t.fx_shots, YEARS, 500.0, CELL, 42, GRID, 12)


@query("flt6_in_bounds", """SELECT shot_number, CAST(FLOOR((4746000e0 - northing) / 10e0) AS BIGINT) AS row_,
  CAST(FLOOR((easting - 500000e0) / 10e0) AS BIGINT) AS col_ FROM fx_shots
WHERE FLOOR((4746000e0 - northing) / 10e0) >= 12 AND FLOOR((4746000e0 - northing) / 10e0) < 2988
  AND FLOOR((easting - 500000e0) / 10e0) >= 12 AND FLOOR((easting - 500000e0) / 10e0) < 2988""")
def flt6(t):
    p = t.fx_shots.select("shot_number", geo.pixel_row("northing", GRID).alias("row_"),
                          geo.pixel_col("easting", GRID).alias("col_"))
    return p.where(geo.in_bounds("row_", "col_", GRID, 12))


FLT16_SQL = f"""SELECT granule, COUNT(*) AS n_total, COUNT(*) FILTER (agbd > 0) AS n_land FROM fx_shots
WHERE lon_lowestmode BETWEEN -9.5 AND -5.5 AND lat_lowestmode BETWEEN 41.5 AND 43.5 GROUP BY granule"""


@query("flt16_land_screen", FLT16_SQL)
def flt16(t):
    return shots.granule_counts(t.fx_shots, readers.get_aoi("full"))


@query("srt3_first_land_granule", f"""WITH c AS ({FLT16_SQL}), head AS (SELECT * FROM c ORDER BY granule LIMIT 15)
SELECT * FROM head WHERE n_land >= 100 ORDER BY granule LIMIT 1""")
def srt3(t):
    c = shots.granule_counts(t.fx_shots, readers.get_aoi("full"))
    return shots.first_land_granule(c, "granule", min_land=100)


@query("prj1_power_beam_flag", """SELECT beam IN ('BEAM0101', 'BEAM0110', 'BEAM1000', 'BEAM1011') AS is_power_beam,
  COUNT(*) AS n FROM fx_shots GROUP BY 1""")
def prj1(t):
    return shots.tag_beam(t.fx_shots).groupBy("is_power_beam").agg(F.count(F.lit(1)).alias("n"))


@query("prj2_clip", """SELECT patch_id, variant, seed, GREATEST(pred_agbd, 0e0) AS low,
  LEAST(GREATEST(pred_agbd, 0e0), 500e0) AS both_ends FROM fx_predictions""")
def prj2(t):
    return t.fx_predictions.select("patch_id", "variant", "seed", clip("pred_agbd", 0.0).alias("low"),
                                   clip("pred_agbd", 0.0, 500.0).alias("both_ends"))


# ---- joins and set operations on ids ----

FAILED_SQL = "failed AS (SELECT DISTINCT split_part(value, '\t', 1) AS granule_ur FROM fx_failures WHERE TRIM(value) <> '')"


@query("jn2_failed_lookup", f"""WITH {FAILED_SQL}
SELECT failed.granule_ur, c.seq, c.seq IS NOT NULL AS found FROM failed
LEFT JOIN fx_catalogue c ON failed.granule_ur = c.granule_ur""")
def jn2(t):
    return scenes.lookup_failures(readers.failed_ids(t.fx_failures), t.fx_catalogue).select(
        "granule_ur", "seq", "found")


@query("jn3_skip_processed", """SELECT granule_ur, seq FROM fx_catalogue c
WHERE NOT EXISTS (SELECT 1 FROM fx_done d WHERE d.granule_ur = c.granule_ur)""")
def jn3(t):
    return scenes.to_do(t.fx_catalogue, t.fx_done, "granule_ur").select("granule_ur", "seq")


@query("jn4_keep_processed", """SELECT granule_ur, seq FROM fx_catalogue c
WHERE EXISTS (SELECT 1 FROM fx_done d WHERE d.granule_ur = c.granule_ur)""")
def jn4(t):
    return scenes.already_done(t.fx_catalogue, t.fx_done, "granule_ur").select("granule_ur", "seq")


@query("jn16_aoi_lookup", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'full' ELSE 'dev' END AS aoi,
  CASE WHEN c_custkey % 3 = 0 THEN -9.5e0 ELSE -8.5e0 END AS west,
  CASE WHEN c_custkey % 3 = 0 THEN 43.5e0 ELSE 43.6e0 END AS north FROM customer""")
def jn16(t):
    name = F.when(F.col("c_custkey") % 3 == 0, "full").otherwise("dev")
    return readers.with_aoi(t.customer.select("c_custkey"), name).select("c_custkey", "aoi", "west", "north")


@query("set1_union_all", """SELECT beam, COUNT(*) AS n, MIN(shot_number) AS first_shot FROM fx_shots GROUP BY beam""")
def set1(t):
    return readers.union_beams(beam_tables(t, ["shot_number"])).groupBy("beam").agg(
        F.count(F.lit(1)).alias("n"), F.min("shot_number").alias("first_shot"))


@query("set2_difference", """SELECT granule_ur FROM fx_catalogue EXCEPT SELECT granule_ur FROM fx_done""")
def set2(t):
    return t.fx_catalogue.select("granule_ur").distinct().join(t.fx_done, "granule_ur", "left_anti")


@query("set3_union_into_state", """SELECT granule_ur FROM fx_done UNION
SELECT granule_ur FROM fx_catalogue""")
def set3(t):
    return t.fx_done.union(t.fx_catalogue.select("granule_ur")).distinct()


@query("win2_thin_per_cell", f"""SELECT shot_number, agbd, year_ FROM (SELECT shot_number, agbd,
  CAST(EXTRACT(YEAR FROM acq_datetime) AS INTEGER) AS year_, ROW_NUMBER() OVER (
    PARTITION BY CAST(FLOOR(easting / {CELL}e0) AS BIGINT), CAST(FLOOR(northing / {CELL}e0) AS BIGINT)
    ORDER BY md5(CONCAT('42|', CAST(shot_number AS VARCHAR(20)))), shot_number) AS rn
  FROM fx_shots WHERE {YEARS_SQL}) q WHERE rn = 1""")
def win2(t):
    return shots.thin_per_cell(shots.year_filter(t.fx_shots, YEARS), CELL, 42, keep=["agbd", "year_"])


WIN8_SQL = """WITH g AS (SELECT acq_datetime, granule, COUNT(*) AS kept FROM fx_shots
  WHERE granule LIKE 'GEDI04_A_%' GROUP BY ALL)
SELECT CAST(acq_datetime AS VARCHAR) AS acquired, granule, kept,
  CAST(SUM(kept) OVER (ORDER BY acq_datetime, granule ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_kept FROM g"""


def granule_totals(t):
    return t.fx_shots.where(F.col("granule").startswith("GEDI04_A_")).groupBy("acq_datetime", "granule").agg(
        F.count(F.lit(1)).alias("kept"))


@query("win8_running_total", WIN8_SQL)
def win8(t):
    out = ranking.running_total(granule_totals(t), ["acq_datetime", "granule"], "kept", "total_kept")
    return out.withColumn("acquired", F.col("acq_datetime").cast("string")).drop("acq_datetime")


@query("win8_running_total_ranges", WIN8_SQL)
def win8b(t):
    out = ranking.running_total(granule_totals(t), ["acq_datetime", "granule"], "kept", "total_kept")
    return out.withColumn("acquired", F.col("acq_datetime").cast("string")).drop("acq_datetime")


# ---- sinks: write, read back, summarise ----

def _per_granule(df):
    return df.groupBy("granule").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("agbd"), 4).alias("total"))


PER_GRANULE_SQL = f"""SELECT granule, COUNT(*) AS n, ROUND(SUM(agbd), 4) AS total FROM fx_shots
WHERE {QUALITY_SQL} GROUP BY granule"""


@query("snk1_shard_per_granule", PER_GRANULE_SQL)
def snk1(t):
    path = scratch_path(t.spark, "shards")
    writers.write_shards(shots.quality_filter(t.fx_shots), path)
    return _per_granule(t.spark.read.parquet(path))


@query("snk2_compaction", PER_GRANULE_SQL)
def snk2(t):
    shards, out = scratch_path(t.spark, "shards"), scratch_path(t.spark, "compact")
    writers.write_shards(shots.quality_filter(t.fx_shots), shards)
    writers.compact_shards(t.spark, shards, out)
    return _per_granule(t.spark.read.parquet(out))


@query("snk3_dataset_store", f"""WITH {SPLIT_SQL} SELECT split, COUNT(*) AS n, COUNT(DISTINCT block_id) AS blocks
FROM assigned GROUP BY split""")
def snk3(t):
    path = scratch_path(t.spark, "store")
    writers.write_partitioned(assigned(t), path, ["split"], ["block_id", "shot_number"])
    return t.spark.read.parquet(path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("block_id").alias("blocks"))


@query("snk4_prediction_table", """SELECT patch_id, variant, seed, ROUND(true_agbd, 2) AS true_agbd, ROUND(pred_agbd, 2) AS pred_agbd FROM (
  SELECT patch_id, variant, seed, CAST(CAST(true_agbd AS FLOAT) AS DOUBLE) AS true_agbd, CAST(CAST(pred_agbd AS FLOAT) AS DOUBLE) AS pred_agbd
  FROM fx_predictions) q""")
def snk4(t):
    path = scratch_path(t.spark, "predictions")
    writers.write_table(t.fx_predictions.withColumns({
        "true_agbd": F.col("true_agbd").cast("float"), "pred_agbd": F.col("pred_agbd").cast("float")}), path)
    return t.spark.read.parquet(path).select("patch_id", "variant", "seed", *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("true_agbd", "pred_agbd")])


@query("snk8_write_once", "SELECT COUNT(*) AS n, MIN(shot_number) AS first_shot FROM fx_shots WHERE shot_number % 2 = 0")
def snk8(t):
    path = scratch_path(t.spark, "once")
    writers.write_once(t.fx_shots.where("shot_number % 2 = 0"), path)
    writers.write_once(t.fx_shots, path)  # keeps the first output
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.min("shot_number").alias("first_shot"))
