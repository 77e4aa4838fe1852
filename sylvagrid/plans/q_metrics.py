"""Queries over the prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import run_name
from ..operators import metrics, scenes
from ..operators.sizing import looked_up
from ..session import scratch_path
from ..sources import readers, writers
from .registry import query, r, rounded

MEAN_STD = [f"{m}_{s}" for m in metrics.MEASURES for s in ("mean", "std")]

# Measures of one group, and mean and spread over seeds, as checking SQL.
CLIPPED = "(SELECT *, GREATEST(pred_agbd, 0e0) - true_agbd AS e FROM {src})"
MEASURES_SQL = """COUNT(*) AS n, SQRT(AVG(e * e)) AS rmse, AVG(ABS(e)) AS mae,
  CASE WHEN VAR_POP(true_agbd) > 0 THEN 1 - SUM(e * e) / (VAR_POP(true_agbd) * COUNT(*)) END AS r2,
  AVG(e) AS bias, CASE WHEN AVG(true_agbd) > 0 THEN SQRT(AVG(e * e)) / AVG(true_agbd) * 100 END AS rel_rmse_pct"""
SPREAD_SQL = ", ".join(
    f"ROUND(AVG({m}), 6) AS {m}_mean, ROUND(CASE WHEN COUNT(*) = 1 THEN 0e0 ELSE STDDEV_SAMP({m}) END, 6) AS {m}_std"
    for m in metrics.MEASURES) + ", COUNT(seed) AS n_seeds, COALESCE(arg_min(n, seed), 0) AS n_patches"
VARIANTS_SQL = "(VALUES ('s1_only'), ('s2_only'), ('early'), ('late')) AS d(variant)"
BIN_SQL = ("CASE WHEN true_agbd >= 0 AND true_agbd < 50 THEN '0-50' WHEN true_agbd >= 50 AND true_agbd < 100 "
           "THEN '50-100' WHEN true_agbd >= 100 AND true_agbd < 150 THEN '100-150' WHEN true_agbd >= 150 AND "
           "true_agbd < 200 THEN '150-200' WHEN true_agbd >= 200 AND true_agbd < 500 THEN '200-500' END")
LC_SQL = ("CASE WHEN lc_class = 10 THEN 'tree_cover' WHEN lc_class = 30 THEN 'grassland' WHEN lc_class = 40 "
          "THEN 'cropland' WHEN lc_class IS NOT NULL THEN 'other' END")
BINS_DIM = "(VALUES ('0-50'), ('50-100'), ('100-150'), ('150-200'), ('200-500')) AS s(stratum)"
LC_DIM = "(VALUES ('tree_cover'), ('grassland'), ('cropland'), ('other')) AS s(stratum)"


def dense_sql(src: str, stratum: str, dim: str, out: str) -> str:
    return f"""WITH src AS ({src}),
ps AS (SELECT variant, seed, {stratum} AS stratum, {MEASURES_SQL}
  FROM (SELECT *, GREATEST(pred_agbd, 0e0) - true_agbd AS e FROM src) q GROUP BY 1, 2, 3),
fullset AS (SELECT d.variant, s.stratum, x.seed, COALESCE(ps.n, 0) AS n, rmse, mae, r2, bias, rel_rmse_pct
  FROM {VARIANTS_SQL} CROSS JOIN {dim} LEFT JOIN (SELECT DISTINCT variant, seed FROM ps) x ON x.variant = d.variant
  LEFT JOIN ps ON ps.variant = d.variant AND ps.seed = x.seed AND ps.stratum = s.stratum)
SELECT variant, stratum AS {out}, {SPREAD_SQL} FROM fullset GROUP BY 1, 2"""


WITH_LC = ("SELECT p.*, l.lc_class FROM fx_predictions p LEFT JOIN fx_patch_landcover l ON p.patch_id = l.patch_id")
BY_BIN = dense_sql("SELECT * FROM fx_predictions", BIN_SQL, BINS_DIM, "agbd_bin")
BY_LC = dense_sql(WITH_LC, LC_SQL, LC_DIM, "landcover")
OVERALL = f"""WITH ps AS (SELECT variant, seed, {MEASURES_SQL} FROM {CLIPPED.format(src='fx_predictions')} q
  GROUP BY 1, 2) SELECT variant, {SPREAD_SQL} FROM ps GROUP BY 1"""


@query("jn1_predictions_landcover", """SELECT p.patch_id, p.variant, p.seed, l.lc_class IS NULL AS missing,
  CASE WHEN lc_class = 10 THEN 'tree_cover' WHEN lc_class = 30 THEN 'grassland' WHEN lc_class = 40
  THEN 'cropland' WHEN lc_class IS NOT NULL THEN 'other' END AS landcover
FROM fx_predictions p LEFT JOIN fx_patch_landcover l ON p.patch_id = l.patch_id""")
def jn1(t):
    return metrics.with_landcover(t.fx_predictions, t.fx_patch_landcover).select(
        "patch_id", "variant", "seed", F.col("landcover").isNull().alias("missing"), "landcover")


@query("agg1_regression_metrics", f"""SELECT variant, seed, n, ROUND(rmse, 6) AS rmse, ROUND(mae, 6) AS mae,
  ROUND(r2, 6) AS r2, ROUND(bias, 6) AS bias, ROUND(rel_rmse_pct, 6) AS rel_rmse_pct FROM (
  SELECT variant, seed, {MEASURES_SQL} FROM {CLIPPED.format(src='fx_predictions')} q GROUP BY 1, 2) z""")
def agg1(t):
    return rounded(metrics.regression_metrics(t.fx_predictions, ["variant", "seed"]), metrics.MEASURES)


# Rows without a prediction (NULL) or with an undefined one (NaN) are not scored.
UNSCORED = """SELECT patch_id, variant, seed, true_agbd, CASE WHEN true_agbd < 60 THEN CAST(NULL AS DOUBLE)
  WHEN true_agbd > 480 THEN CAST('NaN' AS DOUBLE) ELSE pred_agbd END AS pred_agbd FROM {}"""


@query("agg1_with_unscored_rows", f"""SELECT variant, seed, n, ROUND(rmse, 6) AS rmse, ROUND(mae, 6) AS mae,
  ROUND(r2, 6) AS r2, ROUND(bias, 6) AS bias, ROUND(rel_rmse_pct, 6) AS rel_rmse_pct FROM (
  SELECT variant, seed, {MEASURES_SQL} FROM {CLIPPED.format(
      src=f"(SELECT * FROM ({UNSCORED.format('fx_predictions')}) u WHERE pred_agbd IS NOT NULL AND NOT isnan(pred_agbd)) s")} q GROUP BY 1, 2) z""")
def agg1_unscored(t):
    p = t.spark.sql(UNSCORED.format("{p}"), p=t.fx_predictions)
    return rounded(metrics.metrics_from_sums(metrics.running_sums(p, ["variant", "seed"])), metrics.MEASURES)


@query("agg2_mergeable_metrics", f"""SELECT variant, n, ROUND(rmse, 6) AS rmse, ROUND(mae, 6) AS mae,
  ROUND(r2, 6) AS r2, ROUND(bias, 6) AS bias, ROUND(rel_rmse_pct, 6) AS rel_rmse_pct FROM (
  SELECT variant, {MEASURES_SQL} FROM {CLIPPED.format(src='fx_predictions')} q GROUP BY 1) z""")
def agg2(t):
    parts = metrics.running_sums(t.fx_predictions, ["variant", "seed"])
    merged = metrics.merge_sums(parts, ["variant"])
    return rounded(metrics.metrics_from_sums(merged), metrics.MEASURES)


@query("agg3_seed_aggregation", OVERALL)
def agg3(t):
    return rounded(metrics.overall(t.fx_predictions), MEAN_STD)


@query("agg3_single_seed", f"""WITH ps AS (SELECT variant, seed, {MEASURES_SQL}
  FROM {CLIPPED.format(src="(SELECT * FROM fx_predictions WHERE seed = 7)")} q GROUP BY 1, 2)
SELECT variant, {SPREAD_SQL} FROM ps GROUP BY 1""")
def agg3b(t):
    return rounded(metrics.overall(t.fx_predictions.where("seed = 7")), MEAN_STD)


@query("agg4_by_label_bin", BY_BIN)
def agg4(t):
    return rounded(metrics.by_label_bin(t.fx_predictions), MEAN_STD)


@query("agg5_by_landcover", BY_LC)
def agg5(t):
    return rounded(metrics.by_landcover(t.fx_predictions, t.fx_patch_landcover), MEAN_STD)


@query("agg6_dense_strata", dense_sql("SELECT * FROM fx_predictions WHERE true_agbd < 120 AND variant <> 'late'",
                                      BIN_SQL, BINS_DIM, "agbd_bin"))
def agg6(t):
    part = t.fx_predictions.where("true_agbd < 120 AND variant <> 'late'")
    return rounded(metrics.by_label_bin(part), MEAN_STD)


@query("metric_report", f"""SELECT 'overall' AS report, 'all' AS stratum, * FROM ({OVERALL}) a
UNION ALL BY NAME SELECT 'agbd_bin' AS report, agbd_bin AS stratum, * EXCLUDE (agbd_bin) FROM ({BY_BIN}) b
UNION ALL BY NAME SELECT 'landcover' AS report, landcover AS stratum, * EXCLUDE (landcover) FROM ({BY_LC}) c""")
def metric_report(t):
    return rounded(metrics.metric_report(t.fx_predictions, t.fx_patch_landcover), MEAN_STD)


@query("agg17_distinct_counts", """SELECT COUNT(DISTINCT variant) AS n_variants, COUNT(DISTINCT seed) AS n_seeds,
  COUNT(DISTINCT patch_id) AS n_patches FROM fx_predictions""")
def agg17(t):
    p = t.fx_predictions
    return p.agg(F.count_distinct("variant").alias("n_variants"), F.count_distinct("seed").alias("n_seeds"),
                 F.count_distinct("patch_id").alias("n_patches"))


@query("agg22_huber", """SELECT variant, ROUND(AVG(l), 6) AS huber_mean, ROUND(SUM(l), 2) AS huber_sum FROM (
  SELECT variant, CASE WHEN ABS(pred_agbd - true_agbd) <= 30 THEN (pred_agbd - true_agbd) * (pred_agbd - true_agbd) / 2e0
    ELSE 30e0 * (ABS(pred_agbd - true_agbd) - 15e0) END AS l FROM fx_predictions) q GROUP BY 1""")
def agg22(t):
    return metrics.mean_huber(t.fx_predictions, ["variant"]).select(
        "variant", r("huber_mean"), F.round("huber_sum", 2).alias("huber_sum"))


def cell_sql(col: str, pick: str) -> str:
    return f"MAX(CASE WHEN {col} = '{pick}' THEN cell END) AS \"{pick}\""


LABEL_SQL = ("CASE variant WHEN 's1_only' THEN 'S1-only' WHEN 's2_only' THEN 'S2-only' WHEN 'early' "
             "THEN 'Early fusion' ELSE 'Late fusion' END")


def table_sql(dense: str, col: str, strata) -> str:
    cells = ", ".join(cell_sql(col, s) for s in strata)
    return f"""WITH dense AS ({dense}), body AS (SELECT {LABEL_SQL} AS label, {col},
  printf('%.2f +/- %.2f', rmse_mean, rmse_std) AS cell FROM dense),
cnt AS (SELECT 'Patches' AS label, {col}, 'n=' || format('{{:,}}', n_patches) AS cell FROM dense
  WHERE variant = 's1_only')
SELECT label, {cells} FROM (SELECT * FROM body UNION ALL SELECT * FROM cnt) q GROUP BY label"""


@query("agg25_bin_table", table_sql(BY_BIN, "agbd_bin", metrics.bin_labels(metrics.LABEL_BINS)))
def agg25(t):
    dense = rounded(metrics.by_label_bin(t.fx_predictions), MEAN_STD)
    return metrics.spread_table(dense, "agbd_bin", metrics.bin_labels(metrics.LABEL_BINS))


@query("agg25_landcover_table", table_sql(BY_LC, "landcover", metrics.LANDCOVER_STRATA))
def agg25b(t):
    dense = rounded(metrics.by_landcover(t.fx_predictions, t.fx_patch_landcover), MEAN_STD)
    return metrics.spread_table(dense, "landcover", metrics.LANDCOVER_STRATA)


@query("txt6_mean_std_cells", f"""WITH o AS ({OVERALL})
SELECT {LABEL_SQL} AS label, printf('%.3f +/- %.3f', rmse_mean, rmse_std) AS rmse,
  printf('%.3f +/- %.3f', mae_mean, mae_std) AS mae, printf('%.3f', r2_mean) AS r2,
  printf('%+.3f +/- %.3f', bias_mean, bias_std) AS bias FROM o""")
def txt6(t):
    return metrics.overall_table(rounded(metrics.overall(t.fx_predictions), MEAN_STD)).drop("position")


@query("srt4_category_order", f"""WITH o AS ({OVERALL})
SELECT {LABEL_SQL} AS label, CAST(CASE variant WHEN 's1_only' THEN 1 WHEN 's2_only' THEN 2 WHEN 'early' THEN 3 ELSE 4 END
  AS BIGINT) AS position, rmse_mean FROM o ORDER BY 2""")
def srt4(t):
    o = metrics.overall(t.fx_predictions)
    tab = metrics.overall_table(o).select("label", "position")
    lab = o.select(metrics.lookup("variant", metrics.VARIANT_LABELS, F.col("variant")).alias("label"), r("rmse_mean"))
    return tab.join(lab, "label").orderBy("position").select("label", F.col("position").cast("bigint"), "rmse_mean")


@query("srt2_sorted_distinct", "SELECT DISTINCT seed FROM fx_predictions ORDER BY seed")
def srt2(t):
    return t.fx_predictions.select("seed").distinct().orderBy("seed")


@query("jn13_positional_by_id", """SELECT variant, seed, COUNT(*) AS n, SUM(CASE WHEN l.patch_id IS NULL THEN 1 ELSE 0 END)
  ::BIGINT AS unmatched FROM fx_predictions p LEFT JOIN (SELECT o_orderkey AS patch_id FROM orders) l
  ON l.patch_id = p.patch_id GROUP BY 1, 2""")
def jn13(t):
    ids = t.orders.select(F.col("o_orderkey").alias("patch_id"), F.lit(1).alias("_hit"))
    j = looked_up(t.fx_predictions, ids, "patch_id")
    return j.groupBy("variant", "seed").agg(F.count(F.lit(1)).alias("n"),
                                            F.count_if(F.col("_hit").isNull()).alias("unmatched"))


@query("scr3_count_check", """SELECT COUNT(*) AS n_left, (SELECT COUNT(*) FROM orders) AS n_right, TRUE AS equal
FROM fx_predictions WHERE variant = 'late' AND seed = 42""")
def scr3(t):
    return metrics.require_same_count(t.fx_predictions.where("variant = 'late' AND seed = 42"), t.orders,
                                      "predictions and test patches")


@query("txt4_run_name", """SELECT variant, seed, CONCAT(CASE variant WHEN 'early' THEN 'early_fusion' WHEN 'late'
  THEN 'late_fusion' ELSE variant END, '_seed', CAST(seed AS VARCHAR)) AS run, COUNT(*) AS n
FROM fx_predictions GROUP BY ALL""")
def txt4(t):
    return t.fx_predictions.groupBy("variant", "seed", run_name("variant", "seed").alias("run")).agg(
        F.count(F.lit(1)).alias("n"))


@query("src6_metric_csv", OVERALL)
def src6(t):
    path = scratch_path(t.spark, "metrics")
    cols = [f.name for f in schemas.METRICS.fields]
    writers.write_csv(rounded(metrics.overall(t.fx_predictions), MEAN_STD).select(*cols), path)
    return readers.read_metrics_csv(t.spark, path)


@query("snk5_metric_csv", BY_BIN)
def snk5(t):
    path = scratch_path(t.spark, "bins")
    d = rounded(metrics.by_label_bin(t.fx_predictions), MEAN_STD)
    writers.write_csv(d, path)
    return readers.read_metrics_csv(t.spark, path, d.schema)


@query("agg20_score_summary", """SELECT CASE WHEN name LIKE 'late%' THEN 'late' WHEN name LIKE 'early%' THEN 'early'
  WHEN name LIKE 's2%' THEN 's2_only' ELSE 's1_only' END AS variant, COUNT(best_val_rmse) AS n_runs,
  ROUND(AVG(best_val_rmse), 6) AS mean_score, ROUND(STDDEV_SAMP(best_val_rmse), 6) AS std_score
FROM fx_runs WHERE NOT is_sweep GROUP BY 1""")
def agg20(t):
    v = (F.when(F.col("name").startswith("late"), "late").when(F.col("name").startswith("early"), "early")
         .when(F.col("name").startswith("s2"), "s2_only").otherwise("s1_only"))
    s = metrics.score_summary(t.fx_runs.where(~F.col("is_sweep")).withColumn("variant", v), "variant", "best_val_rmse")
    return s.select("variant", "n_runs", r("mean_score"), r("std_score"))


@query("win5_early_stopping", """WITH RECURSIVE st AS (
  SELECT run, 1::BIGINT AS epoch, val_rmse AS best, 1::BIGINT AS best_epoch, 0 AS waited FROM fx_training_log WHERE epoch = 1
  UNION ALL
  SELECT st.run, l.epoch, CASE WHEN l.val_rmse < st.best - 0.05e0 THEN l.val_rmse ELSE st.best END,
    CASE WHEN l.val_rmse < st.best - 0.05e0 THEN l.epoch ELSE st.best_epoch END,
    CASE WHEN l.val_rmse < st.best - 0.05e0 THEN 0 ELSE st.waited + 1 END
  FROM st JOIN fx_training_log l ON l.run = st.run AND l.epoch = st.epoch + 1
  WHERE st.waited < 5)
SELECT run, best_epoch, best AS best_rmse, epoch AS last_epoch FROM st
QUALIFY ROW_NUMBER() OVER (PARTITION BY run ORDER BY epoch DESC) = 1""")
def win5(t):
    return scenes.best_epochs(t.fx_training_log, 5, 0.05)
