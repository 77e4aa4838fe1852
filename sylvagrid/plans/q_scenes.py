"""Queries over scenes, jobs, files, manifests and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..constants import JOB_PREFIX, SEEDS, VARIANT_ORDER
from ..functions import geo, times
from ..operators import scenes
from ..session import scratch_path
from ..sources import readers, writers
from .registry import query, r

START_SQL = "make_timestamp(CAST(year AS BIGINT), CAST(month AS BIGINT), CAST(day AS BIGINT), 0, 0, 0e0) + to_seconds(second_of_day)"
MID_SQL = "make_timestamp(CAST(year AS BIGINT), CAST(month AS BIGINT), 15, 0, 0, 0e0)"
PICK_SQL = f"""picked AS (SELECT * FROM (SELECT *, {START_SQL} AS start, epoch_us({START_SQL}) - epoch_us({MID_SQL}) AS d,
  ROW_NUMBER() OVER (PARTITION BY year, month ORDER BY ABS(epoch_us({START_SQL}) - epoch_us({MID_SQL})), scene_name) AS rn
  FROM fx_scenes) q WHERE rn = 1)"""


def with_start(t):
    start = F.make_timestamp_ntz("year", "month", "day", F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(
        secs=F.col("second_of_day"))
    return t.fx_scenes.withColumn("start", start)


def picked(t):
    return scenes.nearest_to_mid_month(with_start(t))


@query("win1_nearest_to_mid_month", f"""WITH {PICK_SQL} SELECT scene_name, CAST(year AS INTEGER) AS sel_year,
  CAST(month AS INTEGER) AS sel_month, flight_direction, bytes,
  CAST(ABS(FLOOR(d / 86400000000e0)) AS BIGINT) AS days_from_15th FROM picked""")
def win1(t):
    return picked(t).select("scene_name", "sel_year", "sel_month", "flight_direction", "bytes", "days_from_15th")


@query("agg21_manifest_summary", f"""WITH {PICK_SQL} SELECT COUNT(*) AS n_scenes, ROUND(SUM(bytes) / 1e9, 6) AS total_gb,
  COUNT(*) FILTER (flight_direction = 'ASCENDING') AS n_ascending,
  COUNT(*) FILTER (flight_direction <> 'ASCENDING') AS n_descending FROM picked""")
def agg21(t):
    return scenes.manifest_summary(picked(t)).withColumn("total_gb", F.round("total_gb", 6))


def manifest_rows(t):
    p = picked(t).select(
        "sel_year", "sel_month", "scene_name",
        F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("acquisition"),
        F.col("flight_direction").alias("orbit_direction"), F.lit(1).cast("long").alias("path_number"),
        F.lit(2).cast("long").alias("frame_number"), F.lit("VV+VH").alias("polarization"),
        (F.col("bytes") / 1e9).alias("size_gb"), "days_from_15th")
    return scenes.manifest(p, [f.name for f in schemas.SCENE.fields])


FLAT_SQL = f"""WITH {PICK_SQL} SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, scene_name,
  strftime(start, '%Y-%m-%dT%H:%M:%SZ') AS acquisition, ROUND(bytes / 1e9, 6) AS size_gb FROM picked"""


@query("map1_manifest_flatten", FLAT_SQL)
def map1(t):
    # One row per year (three), folded into the nested year -> month -> scene map.
    nested = manifest_rows(t).agg(F.map_from_entries(F.collect_list(F.struct("year", "months"))).alias("years"))
    return scenes.flatten_manifest(nested).select("year", "month", "scene_name", "acquisition", r("size_gb"))


@query("src7_manifest_json", FLAT_SQL)
def src7(t):
    path = scratch_path(t.spark, "manifest")
    nested = manifest_rows(t).agg(F.map_from_entries(F.collect_list(F.struct("year", "months"))).alias("years"))
    writers.write_json(nested.withColumn("aoi_name", F.lit("dev")), path)
    return scenes.flatten_manifest(readers.read_manifest(t.spark, path)).select(
        "year", "month", "scene_name", "acquisition", r("size_gb"))


@query("snk7_manifest_json", f"""WITH {PICK_SQL} SELECT CAST(year AS VARCHAR) AS year, CONCAT('{{', string_agg(CONCAT('"',
  CAST(month AS VARCHAR), '":{{"scene_name":"', scene_name, '","days_from_15th":',
  CAST(CAST(ABS(FLOOR(d / 86400000000e0)) AS BIGINT) AS VARCHAR), '}}'), ',' ORDER BY CAST(month AS VARCHAR)), '}}') AS json
FROM picked GROUP BY 1""")
def snk7(t):
    m = scenes.manifest(picked(t), ["scene_name", "days_from_15th"])
    return m.select("year", writers.as_json(F.col("months")))


@query("jsn1_state_round_trip", """SELECT event_id, CAST(props->>'k' AS BIGINT) AS k,
  CONCAT('{"id":', CAST(event_id AS VARCHAR), ',"k":', props->>'k', ',"kind":"', event_type, '"}') AS json FROM events""")
def jsn1(t):
    k = F.from_json("props", "k BIGINT").getField("k")
    return t.events.select("event_id", k.alias("k"), F.to_json(F.struct(
        F.col("event_id").alias("id"), k.alias("k"), F.col("event_type").alias("kind"))).alias("json"))


@query("win4_newest_job", """SELECT granule, job_id, status_code FROM fx_jobs WHERE name LIKE 'biomass\\_s1\\_%' ESCAPE '\\'
QUALIFY ROW_NUMBER() OVER (PARTITION BY granule ORDER BY request_time DESC, job_id DESC) = 1""")
def win4(t):
    jobs = t.fx_jobs.where(F.col("name").startswith(JOB_PREFIX))
    return scenes.newest(jobs, ["granule"], "request_time", "job_id").select("granule", "job_id", "status_code")


DISK_SQL = """disk AS (SELECT scene_name, COUNT(*) FILTER (LOWER(file_name) LIKE '%.tif') AS n_tifs,
  COUNT(*) FILTER (LOWER(file_name) LIKE '%\\_vv.tif' ESCAPE '\\') > 0 AS has_vv,
  COUNT(*) FILTER (LOWER(file_name) LIKE '%\\_vh.tif' ESCAPE '\\') > 0 AS has_vh,
  COUNT(*) FILTER (LOWER(file_name) LIKE '%inc\\_map%.tif' ESCAPE '\\') > 0 AS has_inc,
  COUNT(*) FILTER (LOWER(file_name) LIKE '%.zip') > 0 AS has_zip, ROUND(SUM(size) / 1e6, 1) AS total_mb
  FROM fx_files GROUP BY 1)"""


@query("jn15_scene_files", f"WITH {DISK_SQL} SELECT * FROM disk")
def jn15(t):
    return scenes.scene_files(t.fx_files)


AUDIT_SQL = f"""WITH {DISK_SQL}, last AS (SELECT granule, status_code FROM fx_jobs
  WHERE name LIKE 'biomass\\_s1\\_%' ESCAPE '\\'
  QUALIFY ROW_NUMBER() OVER (PARTITION BY granule ORDER BY request_time DESC, job_id DESC) = 1),
st AS (SELECT s.scene_name, right(s.scene_name, 12) AS short_name, COALESCE(last.status_code, 'NONE') AS job_status,
  disk.scene_name IS NOT NULL AS on_disk, COALESCE(disk.total_mb, 0e0) AS total_mb,
  CASE WHEN has_vv AND has_vh THEN 'on_disk_complete' WHEN disk.scene_name IS NOT NULL THEN 'on_disk_partial'
    WHEN last.status_code IN ('PENDING', 'RUNNING') THEN 'running'
    WHEN last.status_code = 'SUCCEEDED' THEN 'succeeded_not_fetched'
    WHEN last.status_code = 'FAILED' THEN 'failed' ELSE 'no_job' END AS category
  FROM fx_scenes s LEFT JOIN last ON last.granule = s.scene_name LEFT JOIN disk ON disk.scene_name = s.scene_name)"""


@query("jn10_scene_audit", f"{AUDIT_SQL} SELECT * FROM st")
def jn10(t):
    return scenes.scene_status(t.fx_scenes.select("scene_name"), t.fx_jobs, t.fx_files)


@query("agg19_status_rollup", AUDIT_SQL + " SELECT " + ", ".join(
    f"COUNT(*) FILTER (category = '{c}') AS {c}" for c in scenes.CATEGORIES) + " FROM st")
def agg19(t):
    return scenes.status_rollup(scenes.scene_status(t.fx_scenes.select("scene_name"), t.fx_jobs, t.fx_files))


STATE_SQL = """CASE WHEN user_id % 5 = 0 THEN 'failed' WHEN user_id % 5 = 1 THEN 'running' ELSE 'completed' END"""


def run_state(t):
    """Orchestration state per run name: the status of its first event."""
    from ..operators.ranking import pick_one
    e = t.events.withColumn("name", F.concat(
        F.element_at(F.array(*[F.lit(x) for x in ("late_fusion", "early_fusion", "s2_only", "s1_only")]),
                     (F.col("event_id") % 4 + 1).cast("int")), F.lit("_seed"),
        F.when(F.col("user_id") % 2 == 0, "123").otherwise("7")))
    status = (F.when(F.col("user_id") % 5 == 0, "failed").when(F.col("user_id") % 5 == 1, "running")
              .otherwise("completed"))
    return pick_one(e.select("name", status.alias("status"), "event_id"), ["name"], [F.col("event_id")])


@query("jn11_run_status", f"""WITH plan AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY so, vo) AS INTEGER) AS run_no, variant, seed,
    CONCAT(CASE variant WHEN 'early' THEN 'early_fusion' WHEN 'late' THEN 'late_fusion' ELSE variant END, '_seed',
      CAST(seed AS VARCHAR)) AS name
  FROM (VALUES ('s1_only', 1), ('s2_only', 2), ('early', 3), ('late', 4)) v(variant, vo),
    (VALUES (42, 1), (7, 2), (123, 3)) s(seed, so)),
state AS (SELECT CONCAT(CASE event_id % 4 WHEN 0 THEN 'late_fusion' WHEN 1 THEN 'early_fusion' WHEN 2 THEN 's2_only'
    ELSE 's1_only' END, '_seed', CASE WHEN user_id % 2 = 0 THEN '123' ELSE '7' END) AS name, {STATE_SQL} AS status
  FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY name ORDER BY event_id) = 1),
res AS (SELECT name, run_state, best_val_rmse FROM fx_runs WHERE NOT is_sweep
  QUALIFY ROW_NUMBER() OVER (PARTITION BY name ORDER BY created_at DESC, run_id DESC) = 1)
SELECT run_no, plan.name, variant, seed, COALESCE(status, 'pending') AS orch_status, COALESCE(run_state, '-') AS run_state,
  best_val_rmse, CASE WHEN best_val_rmse IS NOT NULL THEN 'done' WHEN status = 'running' OR run_state = 'running'
    THEN 'running' WHEN status = 'failed' THEN 'failed' ELSE 'pending' END AS outcome
FROM plan LEFT JOIN state ON state.name = plan.name LEFT JOIN res ON res.name = plan.name""")
def jn11(t):
    plan = scenes.schedule(t.events, VARIANT_ORDER, SEEDS)
    return scenes.run_status(plan, run_state(t), t.fx_runs)


@query("src14_degree_tiles", """WITH b AS (SELECT s_suppkey, -9.5e0 + CAST(s_suppkey % 40 AS DOUBLE) / 4e0 AS west,
    -1.5e0 + CAST(s_suppkey % 7 AS DOUBLE) / 2e0 AS south FROM supplier),
lat AS (SELECT *, UNNEST(generate_series(CAST(FLOOR(south) AS BIGINT), CAST(FLOOR(south + 2e0 - 1e-9) AS BIGINT))) AS lat FROM b),
ll AS (SELECT *, UNNEST(generate_series(CAST(FLOOR(west) AS BIGINT), CAST(FLOOR(west + 1.25e0 - 1e-9) AS BIGINT))) AS lon FROM lat)
SELECT s_suppkey, lat, lon, CONCAT('Copernicus_DSM_COG_10_', CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END,
  LPAD(CAST(ABS(lat) AS VARCHAR), 2, '0'), '_00_', CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END,
  LPAD(CAST(ABS(lon) AS VARCHAR), 3, '0'), '_00_DEM') AS tile FROM ll""")
def src14(t):
    b = t.supplier.select("s_suppkey", (-9.5 + F.col("s_suppkey") % 40 / 4.0).alias("west"),
                          (-1.5 + F.col("s_suppkey") % 7 / 2.0).alias("south"))
    b = b.withColumns({"east": F.col("west") + 1.25, "north": F.col("south") + 2.0})
    return readers.tile_names(b).select("s_suppkey", "lat", "lon", "tile")


@query("txt1_granule_name", """SELECT DISTINCT granule, CASE WHEN granule LIKE 'GEDI04_A_%' THEN CAST(make_timestamp(
    CAST(SUBSTR(granule, 10, 4) AS BIGINT), 1, 1, 12, 30, 15e0) + to_days(CAST(SUBSTR(granule, 14, 3) AS INTEGER) - 1)
    AS VARCHAR) END AS acquired,
  CASE WHEN granule LIKE 'GEDI04_A_%' THEN CAST(SUBSTR(granule, 25, 5) AS INTEGER) ELSE -1 END AS orbit FROM fx_shots""")
def txt1(t):
    return t.fx_shots.select("granule", times.granule_timestamp("granule").cast("string").alias("acquired"),
                             times.granule_orbit("granule").alias("orbit")).distinct()


@query("txt2_string_predicates", """SELECT job_id, name LIKE 'biomass\\_s1\\_%' ESCAPE '\\' AS ours, granule LIKE '%7' AS ends,
  LOWER(status_code) LIKE '%ed' AS finished FROM fx_jobs""")
def txt2(t):
    return t.fx_jobs.select("job_id", F.col("name").startswith("biomass_s1_").alias("ours"),
                            F.col("granule").endswith("7").alias("ends"),
                            F.lower("status_code").endswith("ed").alias("finished"))


@query("txt3_last_characters", "SELECT scene_name, right(CONCAT('S1A_IW_GRDH_', scene_name), 12) AS short_name FROM fx_scenes")
def txt3(t):
    return t.fx_scenes.select("scene_name", F.right(F.concat(F.lit("S1A_IW_GRDH_"), F.col("scene_name")),
                                                    F.lit(12)).alias("short_name"))


@query("txt5_box_wkt", """SELECT granule_ur, CONCAT('POLYGON((', w, ' ', s, ', ', e, ' ', s, ', ', e, ' ', n, ', ', w, ' ', n,
  ', ', w, ' ', s, '))') AS wkt FROM (SELECT granule_ur, CAST(ROUND(west, 2) AS VARCHAR) AS w, CAST(ROUND(south, 2) AS VARCHAR)
  AS s, CAST(ROUND(east, 2) AS VARCHAR) AS e, CAST(ROUND(north, 2) AS VARCHAR) AS n FROM fx_catalogue) q""")
def txt5(t):
    return t.fx_catalogue.select("granule_ur", geo.box_wkt(*[F.round(c, 2) for c in (
        "west", "south", "east", "north")]).alias("wkt"))


@query("dat1_iso_time", f"""SELECT scene_name, CAST({START_SQL} AS VARCHAR) AS parsed FROM fx_scenes""")
def dat1(t):
    text = F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    s = with_start(t).select("scene_name", text.alias("iso"))
    return s.select("scene_name", times.parse_iso("iso").cast("string").alias("parsed"))
