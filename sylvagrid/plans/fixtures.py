"""Views of the test tables in the shape the operators expect.

Each view is portable SQL over one or more base tables, so that Spark and the checking
engine derive the very same rows. Base tables are written as ``{name}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..constants import CHANNELS

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

YEARS = (1996, 1997, 1998)
CELL = 1000.0
BLOCK = 5000.0
GRID_WIDTH = 50

VIEWS: dict[str, str] = {
    "fx_shots": """
SELECT o_orderkey AS shot_number,
  -9.5e0 + CAST((o_orderkey * 7919) % 40000 AS DOUBLE) / 10000e0 AS lon_lowestmode,
  41.5e0 + CAST((o_orderkey * 104729) % 25000 AS DOUBLE) / 10000e0 AS lat_lowestmode,
  CAST(500000 + (o_orderkey * 7919) % 30000 AS DOUBLE) AS easting,
  CAST(4716000 + (o_orderkey * 104729) % 30000 AS DOUBLE) AS northing,
  o_totalprice * 1.2e0 / 1000e0 AS agbd,
  2e0 + CAST((o_orderkey * 31) % 1009 AS DOUBLE) / 500e0 AS agbd_se,
  CAST(1000 - o_orderkey % 97 AS DOUBLE) / 1000e0 AS sensitivity,
  CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 END AS l4_quality_flag,
  CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 1 END AS l2_quality_flag,
  CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS degrade_flag,
  CAST((o_orderkey * 259207) % 157680000 AS DOUBLE) AS delta_time,
  CAST(o_orderkey % 8 AS INT) AS beam_no,
  CASE o_orderkey % 8 WHEN 0 THEN 'BEAM0000' WHEN 1 THEN 'BEAM0001' WHEN 2 THEN 'BEAM0010'
    WHEN 3 THEN 'BEAM0011' WHEN 4 THEN 'BEAM0101' WHEN 5 THEN 'BEAM0110' WHEN 6 THEN 'BEAM1000'
    ELSE 'BEAM1011' END AS beam,
  CAST(o_custkey % 7 AS INT) AS pft_class,
  o_orderdate AS acq_datetime,
  CASE WHEN o_orderkey % 37 = 0 THEN CONCAT('unnamed_', CAST(EXTRACT(YEAR FROM o_orderdate) AS VARCHAR(4)), '.h5')
    ELSE CONCAT('GEDI04_A_', CAST(EXTRACT(YEAR FROM o_orderdate) AS VARCHAR(4)),
      LPAD(CAST(EXTRACT(MONTH FROM o_orderdate) * 30 - 15 AS VARCHAR(3)), 3, '0'), '123015_O',
      LPAD(CAST(EXTRACT(MONTH FROM o_orderdate) * 100 AS VARCHAR(5)), 5, '0'), '_02.h5') END AS granule
FROM {orders}""",
    "fx_sar_obs": """
SELECT CAST(EXTRACT(YEAR FROM l_shipdate) AS INT) AS year,
  CAST(EXTRACT(MONTH FROM l_shipdate) AS INT) AS month,
  l_partkey % 10 AS row_, l_suppkey % 10 AS col_,
  CASE WHEN l_quantity = 1 THEN 0e0 ELSE l_extendedprice / 1000000e0 END AS vv,
  CASE WHEN l_quantity = 2 THEN 0e0 ELSE l_extendedprice / 5000000e0 END AS vh,
  l_quantity / 100e0 AS lia,
  CAST(l_quantity AS INT) % 12 AS scl,
  l_extendedprice / 10e0 AS b04, l_extendedprice / 4e0 + l_quantity AS b08,
  CAST(l_suppkey % 100 AS DOUBLE) AS cloud
FROM {lineitem}""",
    "fx_scene_obs": """
SELECT CAST(EXTRACT(YEAR FROM l_shipdate) AS INT) AS year, CAST(EXTRACT(MONTH FROM l_shipdate) AS INT) AS month,
  CAST(FLOOR(l_partkey / 50e0) AS BIGINT) AS row_, l_partkey % 50 AS col_,
  CASE WHEN l_quantity = 1 THEN 0e0 ELSE l_extendedprice / 1000000e0 END AS vv,
  CASE WHEN l_quantity = 2 THEN 0e0 ELSE l_extendedprice / 5000000e0 END AS vh,
  l_quantity / 100e0 AS lia, CAST(l_quantity AS INT) % 12 AS scl,
  l_extendedprice / 10e0 AS b04, l_extendedprice / 4e0 + l_quantity AS b08, CAST(l_suppkey % 100 AS DOUBLE) AS cloud
FROM {lineitem}""",
    "fx_grid": """
SELECT CAST(FLOOR(p_partkey / 50e0) AS BIGINT) AS row_, p_partkey % 50 AS col_,
  CAST(p_size AS DOUBLE) * 4e0 + p_retailprice AS elevation_m,
  CASE p_partkey % 23 WHEN 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS band1,
  CAST((p_partkey * 37) % 101 AS DOUBLE) AS band2,
  CAST(CASE WHEN p_size <= 20 THEN 10 WHEN p_size <= 35 THEN 30 WHEN p_size <= 45 THEN 40
    WHEN p_size <= 48 THEN 50 ELSE 0 END AS INT) AS lc_class
FROM {part}""",
    "fx_channels": """
SELECT CAST(FLOOR(p_partkey / 50e0) AS BIGINT) AS row_, p_partkey % 50 AS col_,
  """ + ",\n  ".join(f"CAST((p_partkey * {37 + 11 * i}) % {997 - 6 * i} AS DOUBLE) * {i % 4 + 1}e0 / 20e0 + CAST(p_size AS DOUBLE) / 10e0 AS {c}"
                     for i, c in enumerate(CHANNELS)) + """
FROM {part}""",
    "fx_points": """
SELECT o_orderkey AS shot_number, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS year,
  (o_orderkey * 7) % (SELECT CAST(FLOOR(MAX(p_partkey) / 50e0) AS BIGINT) + 1 FROM {part}) AS crow,
  (o_orderkey * 13) % 50 AS ccol, o_totalprice * 1.2e0 / 1000e0 AS agbd
FROM {orders}""",
    "fx_predictions": """
SELECT o_orderkey AS patch_id, v.variant AS variant, s.seed AS seed,
  o_totalprice * 1.2e0 / 1000e0 AS true_agbd,
  o_totalprice * 0.9e0 / 1000e0
    + CAST((o_orderkey * 31 + v.k * 17 + s.seed) % 201 - 100 AS DOUBLE) * 0.5e0 * (v.k + 1) AS pred_agbd
FROM {orders}
CROSS JOIN (VALUES ('late', 0), ('early', 1), ('s2_only', 2), ('s1_only', 3)) AS v(variant, k)
CROSS JOIN (VALUES (42), (7), (123)) AS s(seed)""",
    "fx_patch_landcover": """
SELECT o_orderkey AS patch_id,
  CAST(CASE o_custkey % 10 WHEN 0 THEN 10 WHEN 1 THEN 10 WHEN 2 THEN 10 WHEN 3 THEN 30 WHEN 4 THEN 30
    WHEN 5 THEN 40 WHEN 6 THEN 20 WHEN 7 THEN 50 WHEN 8 THEN 80 ELSE 90 END AS INT) AS lc_class,
  CAST(25 + (o_orderkey * 17) % 76 AS DOUBLE) / 100e0 AS lc_purity
FROM {orders} WHERE o_orderstatus <> 'P'""",
    "fx_maps": """
SELECT s.seed AS seed, CAST(FLOOR(p_partkey / 50e0) AS BIGINT) AS row_, p_partkey % 50 AS col_,
  CASE WHEN (p_partkey + s.seed) % 17 = 0 THEN CAST(NULL AS DOUBLE)
    ELSE CAST(p_size AS DOUBLE) * 9.5e0 + CAST((p_partkey * 7 + s.seed) % 11 AS DOUBLE) END AS agbd,
  CASE WHEN p_partkey % 4 = 0 THEN 0e0
    ELSE CAST(p_size AS DOUBLE) * 5e0 + CAST(p_partkey % 60 AS DOUBLE) END AS ref_agb
FROM {part} CROSS JOIN (VALUES (42), (7), (123)) AS s(seed)""",
    "fx_scenes": """
SELECT CONCAT('S1_', CAST(event_id AS VARCHAR(20))) AS scene_name,
  CAST(2020 + event_id % 3 AS INT) AS year, CAST(CASE WHEN event_id % 36 = 5 THEN 7 ELSE 1 + event_id % 12 END AS INT) AS month,  -- no scene in June 2022
  CAST(1 + (event_id * 7) % 28 AS INT) AS day, CAST((event_id * 5) % 86400 AS INT) AS second_of_day,
  CASE WHEN event_type IN ('click', 'view') THEN 'ASCENDING' ELSE 'DESCENDING' END AS flight_direction,
  CAST(event_id % 1000 AS BIGINT) * 1000000 AS bytes
FROM {events}""",
    "fx_jobs": """
SELECT event_id AS job_id, CONCAT('S1_', CAST(user_id AS VARCHAR(20))) AS granule,
  CONCAT(CASE WHEN event_id % 5 = 0 THEN 'other_' ELSE 'biomass_s1_' END, CAST(user_id AS VARCHAR(20))) AS name,
  CASE event_type WHEN 'click' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCEEDED'
    WHEN 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status_code,
  ts AS request_time
FROM {events}""",
    "fx_files": """
SELECT CONCAT('S1_', CAST(event_id % 260 AS VARCHAR(20))) AS scene_name,
  CONCAT('rtc_', CAST(event_id AS VARCHAR(20)), CASE event_id % 7 WHEN 0 THEN '_VV.tif' WHEN 1 THEN '_VH.tif'
    WHEN 2 THEN '_inc_map.tif' WHEN 3 THEN '.zip' WHEN 4 THEN '_DEM.tif' ELSE '.txt' END) AS file_name,
  CAST((event_id * 1009) % 5000000 AS BIGINT) AS size
FROM {events}""",
    "fx_training_log": """
SELECT user_id AS run, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS epoch,
  value AS val_rmse
FROM {events}""",
    "fx_runs": """
SELECT event_id AS run_id, ts AS created_at,
  CONCAT(CASE event_id % 4 WHEN 0 THEN 'late_fusion' WHEN 1 THEN 'early_fusion' WHEN 2 THEN 's2_only'
    ELSE 's1_only' END, '_seed', CASE WHEN user_id % 3 = 0 THEN '42' ELSE '7' END) AS name,
  CASE WHEN event_type = 'error' THEN 'running' ELSE 'finished' END AS run_state,
  CASE WHEN event_type = 'error' THEN CAST(NULL AS DOUBLE) ELSE 40e0 + value END AS best_val_rmse,
  user_id % 10 = 0 AS is_sweep
FROM {events}""",
    "fx_catalogue": """
SELECT CONCAT('G', CAST(o_orderkey AS VARCHAR(20))) AS granule_ur,
  -10e0 + CAST((o_orderkey * 7919) % 600 AS DOUBLE) / 100e0 AS west,
  -9.6e0 + CAST((o_orderkey * 7919) % 600 AS DOUBLE) / 100e0 AS east,
  40e0 + CAST((o_orderkey * 104729) % 600 AS DOUBLE) / 100e0 AS south,
  40.3e0 + CAST((o_orderkey * 104729) % 600 AS DOUBLE) / 100e0 AS north,
  o_orderdate AS start, o_orderkey AS seq
FROM {orders}""",
    "fx_failures": """
SELECT CASE WHEN event_id % 50 = 0 THEN '   '
    ELSE CONCAT('G', CAST((event_id * 3) % 20000 AS VARCHAR(20)), '\t',
      CASE WHEN event_type = 'error' THEN 'download' ELSE 'read' END, '\t', 'message ', event_type) END AS value
FROM {events}""",
    "fx_done": """
SELECT CONCAT('G', CAST(o_orderkey AS VARCHAR(20))) AS granule_ur FROM {orders} WHERE o_orderstatus = 'F'""",
}


def _deps(sql: str) -> list[str]:
    return [b for b in BASE_TABLES if "{" + b + "}" in sql]


class Tables:
    """The base tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        # The views cast zone-less timestamps; the operators assume UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = VIEWS[name].replace("\t", "\\t")
        return self.spark.sql(sql, **{d: self.base(d) for d in _deps(sql)})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("fx_"):
            return self.view(name)
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """Checking SQL with the views it names as common table expressions."""
    used = [v for v in VIEWS if v in sql]
    ctes = ", ".join(f"{v} AS ({VIEWS[v].format(**{b: b for b in BASE_TABLES}).strip()})" for v in used)
    body = sql.strip()
    if not used:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
