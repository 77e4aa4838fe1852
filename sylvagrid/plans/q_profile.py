"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import clip
from ..functions.sensors import ndvi
from ..operators import metrics, profile, quantiles, ranking, shots
from .registry import query, r, rounded

DESCRIBE_SQL = """SELECT COUNT(agbd) AS count, ROUND(AVG(agbd), 6) AS mean, ROUND(STDDEV_SAMP(agbd), 6) AS std,
  MIN(agbd) AS min, MAX(agbd) AS max, ROUND(quantile_cont(agbd, 0.25), 6) AS q25,
  ROUND(quantile_cont(agbd, 0.5), 6) AS q50, ROUND(quantile_cont(agbd, 0.75), 6) AS q75 FROM fx_shots"""


@query("prf1_describe", DESCRIBE_SQL)
def prf1(t):
    return rounded(profile.describe(t.fx_shots, "agbd"), ["mean", "std", "q25", "q50", "q75"])


@query("prf1_describe_distributed", DESCRIBE_SQL)
def prf1b(t):
    s = t.fx_shots
    m = s.agg(F.count("agbd").alias("count"), r(F.avg("agbd")).alias("mean"), r(F.stddev_samp("agbd")).alias("std"),
              F.min("agbd").alias("min"), F.max("agbd").alias("max"))
    q = quantiles.table_quantiles(s, "agbd", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return m.crossJoin(F.broadcast(rounded(q, ["q25", "q50", "q75"])))


@query("prf2_tail", """SELECT ROUND(quantile_cont(agbd, 0.9), 6) AS q0900, ROUND(quantile_cont(agbd, 0.95), 6) AS q0950,
  ROUND(quantile_cont(agbd, 0.99), 6) AS q0990, ROUND(quantile_cont(agbd, 0.995), 6) AS q0995,
  ROUND(quantile_cont(agbd, 0.999), 6) AS q0999, COUNT(*) FILTER (agbd > 500) AS over_500,
  COUNT(*) FILTER (agbd > 1000) AS over_1000 FROM fx_shots""")
def prf2(t):
    return rounded(profile.tail(t.fx_shots, "agbd"), list(profile.TAIL))


@query("prf3_histogram", """WITH v AS (SELECT LEAST(agbd, 500e0) AS v FROM fx_shots),
sp AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM v)
SELECT CAST(LEAST(FLOOR((v - lo) / (hi - lo) * 60), 59) AS BIGINT) AS bin, COUNT(*) AS n,
  ROUND(MIN(lo) + CAST(LEAST(FLOOR((v - lo) / (hi - lo) * 60), 59) AS BIGINT) * (MIN(hi) - MIN(lo)) / 60, 6) AS left_edge
FROM v, sp GROUP BY 1""")
def prf3(t):
    return rounded(profile.histogram(t.fx_shots, "agbd", 60, 500.0), ["left_edge"])


@query("prf3_histogram_by_beam_type", """WITH v AS (SELECT beam_no >= 4 AS is_power_beam, LEAST(agbd, 500e0) AS v FROM fx_shots),
sp AS (SELECT is_power_beam, MIN(v) AS lo, MAX(v) AS hi FROM v GROUP BY 1)
SELECT v.is_power_beam, CAST(LEAST(FLOOR((v - lo) / (hi - lo) * 60), 59) AS BIGINT) AS bin, COUNT(*) AS n
FROM v JOIN sp ON v.is_power_beam = sp.is_power_beam GROUP BY 1, 2""")
def prf3b(t):
    return profile.histogram(shots.tag_beam(t.fx_shots), "agbd", 60, 500.0, ["is_power_beam"]).drop("left_edge")


H2D = """SELECT CAST(LEAST(FLOOR((x - x0) / (x1 - x0) * {n}), {n} - 1) AS BIGINT) AS bx,
  CAST(LEAST(FLOOR((y - y0) / (y1 - y0) * {n}), {n} - 1) AS BIGINT) AS by, COUNT(*) AS n FROM p, sp GROUP BY 1, 2"""


@query("prf4_histogram_2d", f"""WITH p AS (SELECT agbd AS x, agbd_se AS y FROM fx_shots WHERE agbd < 400
  AND agbd_se < (SELECT quantile_cont(agbd_se, 0.99) FROM fx_shots)),
sp AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM p) {H2D.format(n=60)}""")
def prf4(t):
    return profile.uncertainty_histogram(t.fx_shots)


@query("prf4_sensitivity_2d", f"""WITH p AS (SELECT sensitivity AS x, agbd AS y FROM fx_shots WHERE agbd < 400),
sp AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM p) {H2D.format(n=50)}""")
def prf4b(t):
    return profile.histogram_2d(t.fx_shots.where("agbd < 400"), "sensitivity", "agbd", 50)


@query("prf5_monthly_counts", """WITH c AS (SELECT CAST(date_trunc('month', CASE WHEN EXTRACT(MONTH FROM acq_datetime) = 3
  THEN acq_datetime + INTERVAL 1 MONTH ELSE acq_datetime END) AS DATE) AS m, COUNT(*) AS n FROM fx_shots GROUP BY 1),
ms AS (SELECT CAST(UNNEST(generate_series((SELECT MIN(m) FROM c), (SELECT MAX(m) FROM c), INTERVAL 1 MONTH)) AS DATE) AS m)
SELECT last_day(ms.m) AS month_end, COALESCE(c.n, 0) AS n, EXTRACT(MONTH FROM ms.m) BETWEEN 4 AND 9 AS growing
FROM ms LEFT JOIN c ON c.m = ms.m""")
def prf5(t):
    # March counts as April, so that there are months without rows.
    at = F.col("acq_datetime").cast("timestamp")
    moved = F.when(F.month(at) == 3, at + F.expr("interval 1 month")).otherwise(at)
    return profile.monthly_counts(t.fx_shots.withColumn("acq_datetime", moved), "acq_datetime")


@query("prf6_category_counts", """SELECT 'beam' AS category, beam AS value, COUNT(*) AS n FROM fx_shots GROUP BY 2
UNION ALL SELECT 'power', CAST(beam_no >= 4 AS VARCHAR), COUNT(*) FROM fx_shots GROUP BY 2
UNION ALL SELECT 'year', CAST(EXTRACT(YEAR FROM acq_datetime) AS VARCHAR), COUNT(*) FROM fx_shots GROUP BY 2
UNION ALL SELECT 'growing', CAST(EXTRACT(MONTH FROM acq_datetime) BETWEEN 4 AND 9 AS VARCHAR), COUNT(*) FROM fx_shots GROUP BY 2
UNION ALL SELECT 'pft', CAST(pft_class AS VARCHAR), COUNT(*) FROM fx_shots GROUP BY 2""")
def prf6(t):
    return profile.category_counts(shots.tag_beam(t.fx_shots), {
        "beam": F.col("beam"), "power": F.col("is_power_beam"), "year": F.year("acq_datetime"),
        "growing": F.month("acq_datetime").between(4, 9), "pft": F.col("pft_class")})


@query("prf7_median_ratio", """SELECT ROUND(quantile_cont(agbd_se, 0.5) / quantile_cont(agbd, 0.5), 9) AS ratio FROM fx_shots""")
def prf7(t):
    return profile.median_ratio(t.fx_shots, "agbd_se", "agbd").select(r("ratio", 9).alias("ratio"))


@query("prf8_seeded_sample", """SELECT shot_number, agbd FROM fx_shots
ORDER BY md5(CONCAT('42|', CAST(shot_number AS VARCHAR))), shot_number LIMIT 500""")
def prf8(t):
    return ranking.hashed_sample(t.fx_shots.select("shot_number", "agbd"), 500, "shot_number", 42)


@query("prf9_stretch", """WITH q AS (SELECT quantile_cont(band1, 0.02) AS lo, quantile_cont(band1, 0.98) AS hi FROM fx_grid)
SELECT row_, col_, ROUND(CASE WHEN band1 IS NOT NULL THEN LEAST(GREATEST((band1 - lo) / (hi - lo + 1e-9), 0e0), 1e0) END, 6)
  AS stretched FROM fx_grid, q""")
def prf9(t):
    return profile.stretch(t.fx_grid, "band1").select("row_", "col_", r("stretched"))


@query("prf10_ndvi_summary", """WITH v AS (SELECT (b08 - b04) / (b08 + b04) AS v FROM fx_sar_obs WHERE b08 + b04 <> 0)
SELECT COUNT(v) AS count, ROUND(AVG(v), 6) AS mean, ROUND(STDDEV_SAMP(v), 6) AS std, ROUND(MIN(v), 9) AS min,
  ROUND(MAX(v), 9) AS max, ROUND(quantile_cont(v, 0.25), 6) AS q25, ROUND(quantile_cont(v, 0.5), 6) AS q50,
  ROUND(quantile_cont(v, 0.75), 6) AS q75 FROM v""")
def prf10(t):
    v = t.fx_sar_obs.select(ndvi("b08", "b04").alias("ndvi"))
    d = profile.describe(v, "ndvi")
    return rounded(rounded(d, ["mean", "std", "q25", "q50", "q75"]), ["min", "max"], 9)


def hex_sql(src: str, x: str, y: str, limit: int, key: str = "") -> str:
    pad = 1e-9 * limit
    return f"""WITH p AS (SELECT {key}({x} + {pad!r}) / (({limit} + 2 * {pad!r}) / 60) AS u,
  ({y} + {pad!r}) / (({limit} + 2 * {pad!r}) / 34) AS v FROM ({src}) q),
d AS (SELECT {key}round_even(u, 0) AS i1, round_even(v, 0) AS j1, FLOOR(u) AS i2, FLOOR(v) AS j2,
  POW(u - round_even(u, 0), 2) + 3 * POW(v - round_even(v, 0), 2) < POW(u - FLOOR(u) - 0.5e0, 2)
  + 3 * POW(v - FLOOR(v) - 0.5e0, 2) AS f FROM p),
h AS (SELECT {key}CASE WHEN f THEN 0 ELSE 1 END AS lattice, CAST(CASE WHEN f THEN i1 ELSE i2 END AS BIGINT) AS i,
  CAST(CASE WHEN f THEN j1 ELSE j2 END AS BIGINT) AS j FROM d)
SELECT {key}lattice, i, j, COUNT(*) AS n FROM h WHERE i >= 0 AND j >= 0
  AND CASE WHEN lattice = 0 THEN i <= 60 AND j <= 34 ELSE i < 60 AND j < 34 END GROUP BY {key}lattice, i, j"""


@query("prf11_hexbin", hex_sql("SELECT variant, true_agbd, GREATEST(pred_agbd, 0e0) AS p FROM fx_predictions "
                               "WHERE seed = 7", "true_agbd", "p", 500, "variant, "))
def prf11(t):
    p = t.fx_predictions.where("seed = 7").select(
        "variant", "true_agbd", clip("pred_agbd", low=0.0).alias("p"))
    return profile.hexbin(p, "true_agbd", "p", 500.0, keys=["variant"])


@query("prf11_hexbin_maps", hex_sql("SELECT ref_agb, agbd FROM fx_maps WHERE seed = 7 AND agbd IS NOT NULL AND ref_agb > 0",
                                    "ref_agb", "agbd", 300))
def prf11b(t):
    m = t.fx_maps.where("seed = 7 AND agbd IS NOT NULL AND ref_agb > 0")
    return profile.hexbin(m, "ref_agb", "agbd", 300.0)


@query("prf12_panel_metrics", """SELECT variant, COUNT(*) AS n, ROUND(SQRT(AVG(e * e)), 6) AS rmse,
  ROUND(1 - SUM(e * e) / (VAR_POP(true_agbd) * COUNT(*)), 6) AS r2, ROUND(AVG(e), 6) AS bias
FROM (SELECT *, GREATEST(pred_agbd, 0e0) - true_agbd AS e FROM fx_predictions WHERE seed = 7) q GROUP BY 1""")
def prf12(t):
    m = metrics.regression_metrics(t.fx_predictions.where("seed = 7"), ["variant"])
    return m.select("variant", "n", r("rmse"), r("r2"), r("bias"))


@query("srt1_counts_by_key", "SELECT pft_class, COUNT(*) AS n FROM fx_shots GROUP BY 1 ORDER BY 1")
def srt1(t):
    return t.fx_shots.groupBy("pft_class").agg(F.count(F.lit(1)).alias("n")).orderBy("pft_class")


@query("snk9_profile_report", """SELECT 'total' AS item, CAST(COUNT(*) AS DOUBLE) AS value FROM fx_shots
UNION ALL SELECT 'mean', ROUND(AVG(agbd), 6) FROM fx_shots
UNION ALL SELECT 'median', ROUND(quantile_cont(agbd, 0.5), 6) FROM fx_shots
UNION ALL SELECT 'q0999', ROUND(quantile_cont(agbd, 0.999), 6) FROM fx_shots
UNION ALL SELECT 'over_500', CAST(COUNT(*) FILTER (agbd > 500) AS DOUBLE) FROM fx_shots""")
def snk9(t):
    s = t.fx_shots
    d, q = profile.describe(s, "agbd"), profile.tail(s, "agbd")
    one = d.crossJoin(F.broadcast(q))  # one row each
    items = {"total": F.col("count").cast("double"), "mean": r(F.col("mean")), "median": r(F.col("q50")),
             "q0999": r(F.col("q0999")), "over_500": F.col("over_500").cast("double")}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("item"), v.alias("value"))
                                          for k, v in items.items()])).alias("x")).select("x.*")
