"""Operators on hand-made frames: the edge cases of the semantics, and properties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sylvagrid.functions import geo
from sylvagrid.functions.text import hash_order
from sylvagrid.operators import (fusion, maps, metrics, modelling, patches, profile, quantiles, ranking, raster,
                                 scenes, shots)
from sylvagrid.sources import readers, writers

NAN = float("nan")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


# ---- points ----

def quality_frame(spark):
    return spark.createDataFrame(
        [(1, 1, 1, 0, 0.95, 0.0), (2, 1, 1, 0, NAN, 5.0), (3, 1, 1, 0, 0.99, NAN), (4, 1, 1, 0, 0.9499, 5.0),
         (5, 0, 1, 0, 0.99, 5.0), (6, 1, 1, 1, 0.99, 5.0), (7, 1, 1, 0, 0.99, -0.1), (8, 1, 1, 0, None, 1.0)],
        "shot_number LONG, l4_quality_flag INT, l2_quality_flag INT, degrade_flag INT, sensitivity DOUBLE, agbd DOUBLE")


def test_quality_filter_edges(spark):
    q = quality_frame(spark)
    assert rows(shots.quality_filter(q), "shot_number") == [(1,)]
    assert rows(shots.quality_filter(q, {"min_agbd": 1.0}), "shot_number") == []
    passed = {r["condition"]: r["passed"] for r in shots.quality_pass_counts(q).collect()}
    assert passed == {"l4_quality_flag": 7, "l2_quality_flag": 8, "degrade_flag": 7, "sensitivity": 5, "agbd": 6}


def test_year_fallbacks():
    assert "acquisition_year" in str(shots.acquisition_year(["acquisition_year", "year"]))
    assert "delta_time" in str(shots.acquisition_year(["delta_time"]))


def point_frame(spark, n=500, seed=3):
    g = np.random.default_rng(seed)
    return spark.createDataFrame(pd.DataFrame({
        "shot_number": np.arange(n), "easting": g.uniform(-5000, 25000, n), "northing": g.uniform(0, 30000, n),
        "agbd": g.gamma(2.0, 60.0, n)}))


def test_thinning_keeps_one_per_cell_and_ignores_partitioning(spark):
    p = point_frame(spark)
    a = shots.thin_per_cell(p, 2000.0, 42)
    b = shots.thin_per_cell(p.repartition(13, "agbd"), 2000.0, 42)
    assert rows(a) == rows(b)
    cells = a.select(geo.cell_index("easting", 2000.0), geo.cell_index("northing", 2000.0))
    assert cells.distinct().count() == a.count() == p.select(
        geo.cell_index("easting", 2000.0), geo.cell_index("northing", 2000.0)).distinct().count()


def test_split_properties(spark):
    p = point_frame(spark, 3000)
    a = patches.stratified_block_split(p, size=2500.0)
    assert patches.leaking_blocks(a).count() == 0 and a.count() == 3000
    b = patches.stratified_block_split(p.repartition(11, "agbd"), size=2500.0)
    assert rows(a, "shot_number", "split") == rows(b, "shot_number", "split")
    with pytest.raises(ValueError):
        patches.block_split(a, 0.9, 0.1)


def test_strata_by_hand(spark):
    """Ten means 1 to 10: the inner edges are 2.8, 4.6, 6.4 and 8.2; a mean on an edge stays below it."""
    means = [float(x) for x in range(1, 11)]
    df = spark.createDataFrame([(i, m, 1) for i, m in enumerate(means)], "block_id LONG, block_mean DOUBLE, n_shots LONG")
    assert rows(patches.block_strata(df), "block_id", "stratum") == [(i, i // 2) for i in range(10)]
    even = spark.createDataFrame([(i, float(i), 1) for i in range(6)], "block_id LONG, block_mean DOUBLE, n_shots LONG")
    assert rows(patches.block_strata(even), "block_id", "stratum") == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_funnel_is_monotone(spark):
    p = point_frame(spark).withColumn("year", F.lit(2020) + F.col("shot_number") % 4)
    f = shots.funnel(p, (2020, 2021), 200.0, 1000.0, 42, geo.Grid(0.0, 30000.0, 10.0, 10.0, 3000, 2500), 12).first()
    assert f[0] == 500 and all(a >= b for a, b in zip(f, f[1:])) and f[4] > 0


def test_filters_reach_the_scan(spark, tmp_path):
    quality_frame(spark).withColumns({"lon_lowestmode": F.lit(1.0), "lat_lowestmode": F.lit(2.0),
                                      "other": F.lit("x")}).write.parquet(str(tmp_path / "q"))
    d = readers.read_shots(spark, str(tmp_path / "q"), (0.0, 0.0, 3.0, 3.0), {}).select("shot_number", "agbd")
    assert rows(d, "shot_number") == [(1,)]
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    scan = readers.read_shots(spark, str(tmp_path / "q"), (0.0, 0.0, 3.0, 3.0), {}).select(
        "shot_number", "agbd")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = scan[scan.index("PushedFilters"):]
    assert "other" not in scan
    for part in ("GreaterThanOrEqual(sensitivity,0.95)", "EqualTo(l4_quality_flag,1)", "LessThanOrEqual(lat_lowestmode,3.0)"):
        assert part in pushed


def test_one_shuffle_for_focal_windows(spark, tmp_path):
    grid_frame(spark, np.ones((6, 6))).write.parquet(str(tmp_path / "g"))
    f = raster.focal_stats(spark.read.parquet(str(tmp_path / "g")), ["v"], 1)
    assert f._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_first_land_granule(spark):
    c = spark.createDataFrame([(f"g{i:02d}", 500, 300 if i == 14 else 10) for i in range(20)], "granule STRING, n_total LONG, n_land LONG")
    assert shots.first_land_granule(c, "granule").first()["granule"] == "g14"
    assert shots.first_land_granule(c, "granule", first=14).count() == 0


# ---- ranks, picks, quantiles ----

def test_hashed_rank_is_a_row_number(spark):
    d = spark.range(2000).withColumn("g", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5))
    pdf = ranking.hashed_rank(d.withColumn("h", hash_order(42, "id")), ["g"], "id", 42).toPandas()
    for _, part in pdf.groupby("g"):
        part = part.sort_values(["h", "id"])
        assert part["rank"].tolist() == list(range(1, len(part) + 1)) and (part["group_size"] == len(part)).all()


def test_hashed_sample(spark):
    d = spark.range(5000)
    got = rows(ranking.hashed_sample(d, 100, "id", 42))
    want = sorted((r["id"],) for r in d.orderBy(hash_order(42, "id"), "id").limit(100).collect())
    assert got == want
    assert ranking.hashed_sample(d, 9999, "id", 42).count() == 5000


def test_running_total(spark):
    d = spark.range(3000).select("id", (F.col("id") % 7).alias("v"))
    got = rows(ranking.running_total(d.repartition(9, "v"), ["id"], "v", "s"), "id", "s")
    want = np.cumsum(np.arange(3000) % 7)
    assert got == [(i, int(w)) for i, w in enumerate(want)]


PROBS = {"a": 0.0, "b": 0.02, "c": 0.25, "d": 0.5, "e": 0.9, "f": 0.999, "g": 1.0}


@pytest.mark.parametrize("kind", ["normal", "tail", "ties", "constant", "one", "negative", "wide"])
def test_table_quantiles_match_numpy(spark, kind):
    g = np.random.default_rng(11)
    v = {"normal": g.normal(0, 50, 4001), "tail": g.lognormal(3, 2, 3000), "ties": g.integers(0, 4, 5000) * 1.0,
         "constant": np.full(700, 7.25), "one": np.array([3.5]), "negative": -g.gamma(2, 9, 2500),
         "wide": 10.0 ** g.uniform(-8, 9, 3000)}[kind]
    df = spark.createDataFrame(pd.DataFrame({"v": v})).unionByName(spark.sql("SELECT CAST(NULL AS DOUBLE) AS v"))
    got = quantiles.table_quantiles(df, "v", PROBS).first()
    for n, p in PROBS.items():
        assert got[n] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("limit", [0, 300, 10**6])
def test_group_quantiles_with_a_hot_group(spark, limit):
    g = np.random.default_rng(2)
    n = 3000
    key = np.where(np.arange(n) < n // 3, 0, g.integers(1, 40, n))
    pdf = pd.DataFrame({"k": key, "x": g.normal(10, 5, n), "y": g.integers(0, 6, n) * 1.0})
    pdf.loc[pdf["k"] == 39, "y"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    got = quantiles.group_quantiles(df, ["k"], {"xm": ("x", 0.5), "x9": ("x", 0.9), "ym": ("y", 0.5)}, limit).toPandas().set_index("k")
    assert len(got) == pdf["k"].nunique()
    for k, part in pdf.groupby("k"):
        assert got.loc[k, "xm"] == pytest.approx(part["x"].median())
        assert got.loc[k, "x9"] == pytest.approx(part["x"].quantile(0.9))
        ym = part["y"].median()
        assert (math.isnan(ym) and pd.isna(got.loc[k, "ym"])) or got.loc[k, "ym"] == pytest.approx(ym)


def test_quantile_ways_agree_to_the_bit(spark):
    g = np.random.default_rng(6)
    odd = [NAN, None, 0.0, -0.0, float("inf"), float("-inf")]
    data = [(0, float(x)) for x in g.normal(0, 3, 900)] + [(1, x) for x in odd * 3] + [(2, float(i)) for i in range(1, 10)] + [
        (2, NAN)] * 5 + [(3, NAN), (3, None)] + [(4, float(x)) for x in g.integers(0, 3, 200)] + [(5, -0.0), (5, 0.0)]
    df = spark.createDataFrame(data, "k INT, v DOUBLE")
    named = {n: ("v", p) for n, p in PROBS.items()}
    ways = [{r["k"]: [repr(r[n]) for n in PROBS] for r in quantiles.group_quantiles(df, ["k"], named, limit).collect()} for limit in (0, 50, 10**6)]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == 6
    assert ways[0][2] == [repr(float(x)) for x in np.quantile(np.arange(1.0, 10.0), list(PROBS.values()))] or ways[0][2][3] == "5.0"
    assert ways[0][3] == ["None"] * len(PROBS)
    one = quantiles.table_quantiles(df.where("k = 2"), "v", PROBS).first()
    assert [repr(one[n]) for n in PROBS] == ways[0][2]


# ---- metrics ----

def test_unscored_rows_count_nowhere(spark):
    data = [(1, "late", 42, 10.0, 12.0), (2, "late", 42, 30.0, 20.0), (3, "late", 42, 50.0, None), (4, "late", 42, 70.0, NAN),
            (5, "late", 42, None, 9.0), (6, "late", 42, NAN, 9.0)]
    p = preds(spark, data)
    want = {"n": 2, "rmse": pytest.approx(math.sqrt(52)), "mae": 6.0, "r2": pytest.approx(1 - 104 / 200), "bias": -4.0,
            "rel_rmse_pct": pytest.approx(math.sqrt(52) / 20 * 100)}
    assert metrics.regression_metrics(p).first().asDict() == want
    assert metrics.metrics_from_sums(metrics.running_sums(p)).first().asDict() == want
    landcover = spark.createDataFrame([(i, 10) for i in range(1, 7)], "patch_id LONG, lc_class INT")
    report = metrics.metric_report(p, landcover).where("variant = 'late' AND report = 'overall'").first()
    spread = metrics.overall(p).first()
    for m in metrics.MEASURES:
        assert report[f"{m}_mean"] == want[m] and spread[f"{m}_mean"] == want[m]
    assert report["n_patches"] == spread["n_patches"] == 2
    assert metrics.by_label_bin(p).where("variant = 'late'").agg(F.sum("n_patches")).first()[0] == 2


def test_unlisted_variants_are_an_error(spark):
    p = preds(spark, [(1, "other", 42, 10.0, 12.0)])
    with pytest.raises(Exception, match="not a listed variant"):
        metrics.by_label_bin(p).collect()


def preds(spark, data):
    return spark.createDataFrame(data, "patch_id LONG, variant STRING, seed INT, true_agbd DOUBLE, pred_agbd DOUBLE")


def test_metric_edges(spark):
    p = preds(spark, [(1, "late", 42, 10.0, -5.0), (2, "late", 42, 10.0, 20.0), (1, "early", 42, 0.0, 1.0)])
    m = {r["variant"]: r for r in metrics.regression_metrics(p, ["variant"]).collect()}
    assert m["late"]["rmse"] == 10.0 and m["late"]["bias"] == 0.0  # clipped at 0
    assert m["late"]["r2"] is None  # constant truth
    assert m["early"]["rel_rmse_pct"] is None  # mean truth 0
    s = metrics.metrics_from_sums(metrics.running_sums(p, ["variant"])).collect()
    assert {r["variant"]: r["r2"] for r in s} == {"late": None, "early": None}
    empty = metrics.regression_metrics(p.where("false")).first()
    assert empty["n"] == 0 and empty["rmse"] is None


def test_sums_equal_direct_metrics(spark):
    g = np.random.default_rng(0)
    y = g.gamma(2, 50, 900)
    p = preds(spark, [(i, "late", int(i % 3), float(a), float(b)) for i, (a, b) in enumerate(zip(y, y + g.normal(0, 30, 900)))])
    a = metrics.regression_metrics(p, ["variant"]).first()
    b = metrics.metrics_from_sums(metrics.merge_sums(metrics.running_sums(p, ["variant", "seed"]), ["variant"])).first()
    for m in metrics.MEASURES:
        assert a[m] == pytest.approx(b[m], rel=1e-9)


def test_single_seed_and_bins(spark):
    p = preds(spark, [(1, "late", 7, 0.0, 1.0), (2, "late", 7, 50.0, 49.0), (3, "late", 7, 500.0, 400.0)])
    o = metrics.overall(p).first()
    assert o["n_seeds"] == 1 and o["rmse_std"] == 0.0 and o["n_patches"] == 3
    b = {(r["variant"], r["agbd_bin"]): r for r in metrics.by_label_bin(p).collect()}
    assert len(b) == 4 * 5
    assert sum(r["n_patches"] for r in b.values()) == 2  # 500 is in no bin
    assert b[("late", "50-100")]["n_patches"] == 1 and b[("late", "0-50")]["n_patches"] == 1
    assert b[("late", "100-150")]["n_seeds"] == 1 and b[("late", "100-150")]["rmse_mean"] is None
    assert b[("early", "0-50")]["n_seeds"] == 0


def test_report_equals_its_parts(spark):
    g = np.random.default_rng(4)
    p = preds(spark, [(i, v, s, float(y), float(y + g.normal(0, 20))) for i, y in enumerate(g.gamma(2, 60, 120))
                      for v in ("late", "s1_only") for s in (42, 7)])
    lc = spark.createDataFrame([(i, [10, 30, 40, 80][i % 4]) for i in range(100)], "patch_id LONG, lc_class INT")
    rep = {(r["report"], r["variant"], r["stratum"]): r for r in metrics.metric_report(p, lc).collect()}
    for r in metrics.by_landcover(p, lc).collect():
        other = rep[("landcover", r["variant"], r["landcover"])]
        assert (r["n_patches"], r["n_seeds"]) == (other["n_patches"], other["n_seeds"])
        assert r["rmse_mean"] == pytest.approx(other["rmse_mean"]) or r["rmse_mean"] is None
    for r in metrics.overall(p).collect():
        assert r["r2_mean"] == pytest.approx(rep[("overall", r["variant"], "all")]["r2_mean"])


def test_agreement_counts_beyond_last_edge_only_overall(spark):
    d = spark.createDataFrame([(10.0, 20.0), (30.0, 300.0), (5.0, 49.9)], "a DOUBLE, b DOUBLE")
    r = {x["stratum"]: x["n"] for x in metrics.agreement_by_bin(d, "a", "b").collect()}
    assert r == {"overall": 3, "ref_0-50": 2, "ref_50-100": 0, "ref_100-150": 0, "ref_150-200": 0, "ref_200-300": 0}


def test_count_check_raises(spark):
    assert metrics.require_same_count(spark.range(3), spark.range(3), "x").first()["equal"]
    with pytest.raises(Exception, match="row counts differ"):
        metrics.require_same_count(spark.range(3), spark.range(4), "x").collect()


# ---- rasters ----

def grid_frame(spark, a, name="v"):
    h, w = a.shape
    r, c = np.meshgrid(np.arange(h), np.arange(w), indexing="ij")
    pdf = pd.DataFrame({"row_": r.ravel(), "col_": c.ravel(), name: a.ravel()})
    return spark.createDataFrame(pdf).withColumn(name, F.when(~F.isnan(name), F.col(name)))


def to_array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row_", "col_", name).collect():
        out[r[0], r[1]] = np.nan if r[2] is None else r[2]
    return out


def test_slope_by_hand(spark):
    """A plane that rises 10 m a pixel along the columns and 10 * sqrt(2) along the rows is 60 degrees steep everywhere."""
    h, w = 7, 9
    plane = np.array([[10.0 * c + 10 * math.sqrt(2.0) * r for c in range(w)] for r in range(h)])
    for size in ({}, {"height": h, "width": w}, {"tile": 3}):
        got = to_array(raster.slope(grid_frame(spark, plane), value="v", **size), "slope_deg", plane.shape)
        np.testing.assert_allclose(got, np.full((h, w), 60.0), rtol=1e-9)
    # One row 0, 10, 40: differences 10, 20, 30 over 10, 20, 10 m; a missing pixel silences itself and its neighbours.
    row = grid_frame(spark, np.array([[0.0, 10.0, 40.0]] * 2))
    got = to_array(raster.slope(row, value="v"), "slope_deg", (2, 3))
    np.testing.assert_allclose(got[0], [45.0, 63.43494882, 71.56505118], rtol=1e-8)
    holed = np.array([[1.0] * 5] * 5)
    holed[2, 2] = np.nan
    got = to_array(raster.slope(grid_frame(spark, holed), value="v"), "slope_deg", (5, 5))
    assert {(r, c) for r in range(5) for c in range(5) if np.isnan(got[r, c])} == {(2, 2), (1, 2), (3, 2), (2, 1), (2, 3)}


@pytest.mark.parametrize("tile", [2, 3, 256])
def test_focal_equals_explicit_windows(spark, tile):
    a = np.random.default_rng(2).normal(0, 3, (8, 6))
    a[2, 2] = np.nan
    f = raster.focal_stats(grid_frame(spark, a), ["v"], 2, tile=tile)
    assert f.count() == 48
    mean, n = to_array(f, "v_mean", a.shape), to_array(f, "v_n", a.shape)
    std = to_array(f, "v_std", a.shape)
    for i in range(8):
        for j in range(6):
            w = a[max(0, i - 2):i + 3, max(0, j - 2):j + 3]
            w = w[~np.isnan(w)]
            assert n[i, j] == w.size
            assert mean[i, j] == pytest.approx(w.mean()) and std[i, j] == pytest.approx(w.std(), abs=1e-9)


def test_sar_median_before_decibel(spark):
    d = spark.createDataFrame([(2020, m, 0, 0, vv, 0.0, 0.5) for m, vv in ((1, 0.0), (2, 0.01), (3, 1.0), (4, 0.1))],
                              "year INT, month INT, row_ LONG, col_ LONG, vv DOUBLE, vh DOUBLE, lia DOUBLE")
    r = raster.sar_composite(d).first()
    assert r["VV_dB"] == pytest.approx(10 * math.log10(0.1)) and r["VH_dB"] is None
    assert r["LIA_deg"] == pytest.approx(math.degrees(0.5))


def test_optical_composite_masks(spark):
    d = spark.createDataFrame([(2020, 0, 0, 10.0, 4, 100.0), (2020, 0, 0, 10.0, 9, 900.0), (2020, 0, 0, 71.0, 4, 500.0),
                               (2020, 0, 0, 70.0, 7, 200.0), (2020, 0, 1, 0.0, 3, 1.0)],
                              "year INT, row_ LONG, col_ LONG, cloud DOUBLE, scl INT, b DOUBLE")
    assert rows(raster.optical_composite(d, ["b"]), "col_", "b") == [(0, 150.0), (1, None)]


def test_mosaic_first_valid_tile_wins(spark):
    d = spark.createDataFrame([(0, 0, None, 1), (0, 0, 5.0, 2), (0, 0, 7.0, 3), (0, 1, 1.0, 1), (0, 1, 2.0, 2)],
                              "row_ LONG, col_ LONG, v DOUBLE, tile_order INT")
    assert rows(raster.mosaic(d, ["v"])) == [(0, 0, 5.0), (0, 1, 1.0)]


def test_bilinear_weights_and_nodata(spark):
    src = grid_frame(spark, np.array([[0.0, 10.0], [20.0, np.nan]]))
    t = spark.createDataFrame([(0, 0, 0.5, 0.0), (0, 1, 0.0, 0.25), (1, 0, 0.5, 0.5), (1, 1, 5.0, 5.0)],
                              "row_ LONG, col_ LONG, sy DOUBLE, sx DOUBLE")
    assert rows(raster.regrid_bilinear(t, src, "v")) == [(0, 0, 10.0), (0, 1, 2.5), (1, 0, 10.0), (1, 1, None)]


@pytest.mark.parametrize("tile", [2, 3, 256])
def test_bilinear_over_tile_borders(spark, tile):
    g = np.random.default_rng(12)
    a = g.normal(0, 5, (9, 8))
    a[g.random(a.shape) < 0.2] = np.nan
    at = [(i, float(y), float(x)) for i, (y, x) in enumerate(zip(g.uniform(-2, 10, 300), g.uniform(-2, 9, 300)))]
    at += [(300, 2.0, 3.0), (301, None, 1.0), (302, 1.0, float("nan")), (303, -0.5, 7.5)]
    t = spark.createDataFrame(at, "id LONG, sy DOUBLE, sx DOUBLE")
    got = dict(rows(raster.regrid_bilinear(t, grid_frame(spark, a), "v", keys=["id"], tile=tile), "id", "v"))
    assert len(got) == len(at)
    for i, y, x in at:
        top = total = 0.0
        if y is not None and not math.isnan(x):
            for r in (math.floor(y), math.floor(y) + 1):
                for c in (math.floor(x), math.floor(x) + 1):
                    if 0 <= r < 9 and 0 <= c < 8 and not np.isnan(a[r, c]):
                        w = (1 - abs(y - r)) * (1 - abs(x - c))
                        top, total = top + w * a[r, c], total + w
        assert (got[i] is None) == (total == 0)
        assert total == 0 or got[i] == pytest.approx(top / total, rel=1e-9, abs=1e-9)


def test_bilinear_moves_each_pixel_once(spark):
    src = grid_frame(spark, np.zeros((64, 64)))
    t = src.select("row_", "col_", F.col("row_").cast("double").alias("sy"), F.col("col_").cast("double").alias("sx"))
    d = raster.regrid_bilinear(t, src, "v", tile=32)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    s = src.select(F.col("row_"), F.col("col_")).withColumn("n", F.size(F.sequence(F.floor((F.col("row_") - 1) / 32), F.floor(F.col("row_") / 32)))
                                                          * F.size(F.sequence(F.floor((F.col("col_") - 1) / 32), F.floor(F.col("col_") / 32))))
    assert s.agg(F.sum("n")).first()[0] < 1.1 * 64 * 64


def test_area_reads_only_its_tiles(spark, tmp_path):
    obs = grid_frame(spark, np.arange(64.0).reshape(8, 8)).withColumns({
        "year": F.lit(2020), "cloud": F.lit(0.0), "scl": F.lit(4), "tile_row": F.floor(F.col("row_") / 4), "tile_col": F.floor(F.col("col_") / 4)})
    obs.write.partitionBy("tile_row", "tile_col").parquet(str(tmp_path / "obs"))
    d = raster.in_area(spark.read.parquet(str(tmp_path / "obs")), (1, 2), (5, 6), 4)
    assert sorted(r.v for r in d.collect()) == [13.0, 14.0, 21.0, 22.0]
    assert len(d.select("v", F.input_file_name().alias("f")).select(F.element_at(F.split("f", "/"), -2), F.element_at(F.split("f", "/"), -3)).distinct().collect()) == 1
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "tile_row" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_grid_mismatch_raises(spark):
    d = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("b", 0, 0)], "m STRING, row_ LONG, col_ LONG")
    with pytest.raises(Exception, match="different grids"):
        raster.require_one_grid(d, "m").collect()


# ---- patches ----

def raster_years(spark, h=30, w=26):
    g = np.random.default_rng(8)
    base = grid_frame(spark, g.normal(10, 2, (h, w)), "b1").join(
        grid_frame(spark, g.normal(-3, 1, (h, w)), "b2"), ["row_", "col_"])
    y = base.withColumn("year", F.explode(F.array(F.lit(2020), F.lit(2021)))).withColumn("b1", F.col("b1") + F.col("year"))
    bad = (F.col("row_") == 20) & (F.col("col_") == 20) & (F.col("year") == 2021)
    return y.withColumn("b2", F.when(~bad, F.col("b2")).otherwise(F.lit(-32768.0)))


def test_patches_by_keys_and_by_tiles_agree(spark):
    px = raster_years(spark)
    # A third of all points sit on one pixel.
    pts = spark.range(240).select(
        F.col("id").alias("shot_number"), (F.lit(2020) + F.col("id") % 2).alias("year").cast("int"),
        F.when(F.col("id") % 3 == 0, 10).otherwise(F.col("id") * 7 % 30).cast("long").alias("crow"),
        F.when(F.col("id") % 3 == 0, 12).otherwise(F.col("id") * 11 % 26).cast("long").alias("ccol"))
    a = {r["shot_number"]: r["patch"] for r in patches.extract_patches(pts, px, ["b1", "b2"], 3).collect()}
    b = {r["shot_number"]: r["patch"] for r in patches.extract_patches_tiled(pts, px, ["b1", "b2"], 3, tile=8).collect()}
    assert a == b and len(a) >= 80
    arr = {(r["year"], r["row_"], r["col_"]): (r["b1"], r["b2"]) for r in px.collect()}
    for r in pts.collect():
        window = [arr.get((r["year"], r["crow"] + i, r["ccol"] + j)) for i in range(-3, 4) for j in range(-3, 4)]
        ok = all(x is not None and x[1] != -32768.0 for x in window)
        assert (r["shot_number"] in a) == ok
        if ok:
            want = np.array([x[0] for x in window] + [x[1] for x in window], dtype="float32")
            np.testing.assert_array_equal(np.array(a[r["shot_number"]], dtype="float32"), want)


def test_weights_equal_cut_patches(spark):
    px = raster_years(spark)
    pts = spark.range(300).select(
        F.col("id").alias("shot_number"), (F.lit(2020) + F.col("id") % 2).alias("year").cast("int"),
        F.when(F.col("id") % 3 == 0, 10).otherwise(F.col("id") * 7 % 30).cast("long").alias("crow"),
        F.when(F.col("id") % 3 == 0, 12).otherwise(F.col("id") * 11 % 26).cast("long").alias("ccol"),
        (F.col("id") % 4).cast("int").alias("split"))
    cut = patches.extract_patches(pts, px, ["b1", "b2"], 2)
    a = {r["channel"]: r for r in patches.normalisation_table(cut, ["b1", "b2"], 5).collect()}
    b = {r["channel"]: r for r in patches.normalisation_by_weights(pts, px, ["b1", "b2"], 2, tile=8).collect()}
    for c in ("b1", "b2"):
        assert a[c]["n_pixels"] == b[c]["n_pixels"] > 0
        assert a[c]["mean"] == pytest.approx(b[c]["mean"], rel=1e-9)
        assert a[c]["std"] == pytest.approx(b[c]["std"], rel=1e-5)


def test_majority_ties_and_border(spark):
    lc = grid_frame(spark, np.array([[10.0, 10.0, 0.0], [20.0, 20.0, 0.0], [0.0, 0.0, 0.0]]), "lc_class").withColumn(
        "lc_class", F.col("lc_class").cast("int"))
    c = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 50, 50)], "pid LONG, crow LONG, ccol LONG")
    got = rows(patches.majority_class(c, lc, 1, ["pid"]))
    assert got == [(1, 10, 0.5, "tree_cover"), (2, 0, pytest.approx(5 / 9), "unknown"), (3, 0, 0.0, "unknown")]


def test_normalisation_uses_training_rows_and_population_std(spark):
    d = spark.createDataFrame([(0, [1.0, 3.0, 5.0, -32768.0]), (0, [1.0, 3.0, 5.0, 7.0]), (2, [100.0] * 4)],
                              "split INT, patch ARRAY<FLOAT>")
    got = {r["channel"]: r for r in patches.normalisation_table(d, ["x", "y", "z", "u"], 1).collect()}
    assert got["u"]["n_pixels"] == 1 and got["u"]["mean"] == 7.0 and got["u"]["std"] == 0.0
    assert got["x"]["n_pixels"] == 2


def test_empty_split_and_unknown_area_raise(spark, tmp_path):
    d = spark.createDataFrame([(0, 1)], "split INT, v INT")
    with pytest.raises(ValueError):
        readers.split_rows(d, 2)
    with pytest.raises(KeyError):
        readers.get_aoi("nowhere")
    with pytest.raises(Exception, match="unknown AOI"):
        readers.with_aoi(spark.createDataFrame([("mars",)], "n STRING"), "n").collect()


def test_shards_only_for_surviving_rows(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, 42.0, -8.0, 1.0), ("b", 2, 42.1, -8.1, -1.0)],
                              "granule STRING, shot_number LONG, lat_lowestmode DOUBLE, lon_lowestmode DOUBLE, agbd DOUBLE")
    writers.write_shards(d.where("agbd >= 0"), str(tmp_path / "s"))
    assert not (tmp_path / "s" / "granule=b").exists() and (tmp_path / "s" / "granule=a").exists()
    writers.compact_shards(spark, str(tmp_path / "s"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1


# ---- maps ----

def test_ensemble_needs_all_members_and_mask_is_inclusive(spark):
    d = spark.createDataFrame([(0, 0, 10.0), (0, 0, 20.0), (0, 0, 30.0), (0, 1, 10.0), (0, 1, None), (0, 1, 30.0),
                               (0, 2, 450.0), (0, 2, 449.9), (0, 2, 1.0)], "row_ LONG, col_ LONG, agbd DOUBLE")
    e = {r["col_"]: r for r in maps.ensemble(maps.mask_artifacts(d), 3).collect()}
    assert e[0]["mean_agbd"] == 20.0 and e[0]["std_agbd"] == 10.0
    assert e[1]["mean_agbd"] is None and e[2]["mean_agbd"] is None
    assert maps.mask_artifacts(maps.mask_artifacts(d)).where("agbd IS NULL").count() == 2


def test_zero_class_stays_in_denominator(spark):
    ours = spark.createDataFrame([(0, i, 5.0) for i in range(4)], "row_ LONG, col_ LONG, agbd DOUBLE")
    prod = spark.createDataFrame([(0, i, 0.0) for i in range(4)], "row_ LONG, col_ LONG, ref_agb DOUBLE")
    lc = spark.createDataFrame([(0, 0, 10), (0, 1, 0), (0, 2, 0), (0, 3, 77)], "row_ LONG, col_ LONG, lc_class INT")
    assert rows(maps.zero_by_class(ours, prod, lc), "lc_class", "lc_name", "pct_of_zero") == [
        (10, "tree_cover", 25.0), (77, "class_77", 25.0)]


# ---- scenes ----

def test_scene_nearest_to_mid_month(spark):
    s = spark.sql("""SELECT * FROM VALUES ('b', TIMESTAMP_NTZ '2020-01-14 18:00:00'), ('a', TIMESTAMP_NTZ '2020-01-15 06:00:00'),
      ('c', TIMESTAMP_NTZ '2020-01-20 00:00:00'), ('d', TIMESTAMP_NTZ '2020-03-15 00:00:00'), ('e', TIMESTAMP_NTZ '2020-04-14 23:00:00')
      AS t(scene_name, start)""")
    got = rows(scenes.nearest_to_mid_month(s), "sel_month", "scene_name", "days_from_15th")
    # The 14th at 18:00 floors to one day away, the 15th at 06:00 to none; equal distance goes by name.
    assert got == [(1, "a", 0), (3, "d", 0), (4, "e", 1)]


def test_scene_status_categories(spark):
    sc = spark.createDataFrame([(x,) for x in "abcdefg"], "scene_name STRING")
    jobs = spark.createDataFrame([(1, "c", "FAILED", 1), (2, "c", "RUNNING", 2), (3, "d", "SUCCEEDED", 1), (4, "e", "FAILED", 1),
                                  (5, "f", "EXPIRED", 1)], "job_id LONG, granule STRING, status_code STRING, request_time INT")
    jobs = jobs.withColumn("name", F.lit("biomass_s1_x")).unionByName(  # a newer job of another batch decides nothing
        jobs.limit(1).withColumns({"name": F.lit("other"), "granule": F.lit("c"), "request_time": F.lit(9)}))
    files = spark.createDataFrame([("a", "x_VV.tif", 10), ("a", "x_VH.tif", 10), ("b", "x_vv.tif", 10)],
                                  "scene_name STRING, file_name STRING, size LONG")
    got = dict(rows(scenes.scene_status(sc, jobs, files), "scene_name", "category"))
    assert got == {"a": "on_disk_complete", "b": "on_disk_partial", "c": "running", "d": "succeeded_not_fetched",
                   "e": "failed", "f": "no_job", "g": "no_job"}


def test_early_stopping_replay(spark):
    def replay(scores, patience=2, delta=0.05):
        best, best_epoch, wait, last = None, None, 0, 0
        for e, s in enumerate(scores, 1):
            last = e
            if best is None or s < best - delta:
                best, best_epoch, wait = s, e, 0
            else:
                wait += 1
            if wait >= patience:
                break
        return best_epoch, best, last

    g = np.random.default_rng(9)
    runs = {f"r{i}": (50 - np.cumsum(g.normal(0.1, 1, 40))).round(3).tolist() for i in range(12)}
    log = spark.createDataFrame([(k, e, s) for k, v in runs.items() for e, s in enumerate(v, 1)], "run STRING, epoch INT, val_rmse DOUBLE")
    got = {r["run"]: (r["best_epoch"], r["best_rmse"], r["last_epoch"]) for r in scenes.best_epochs(log, 2, 0.05).collect()}
    assert got == {k: replay(v) for k, v in runs.items()}


def test_product_on_a_coarser_grid(spark):
    """A plane keeps its values; a pixel at the corner takes the product's corner pixel."""
    fine = grid_frame(spark, np.zeros((6, 6))).select("row_", "col_", F.lit(1.0).alias("agbd"))
    coarse = grid_frame(spark, np.array([[2.0 * r + 20.0 * c for c in range(3)] for r in range(3)]), "ref_agb")
    got = {(r, c): v for r, c, v in rows(maps.on_our_grid(coarse, fine, 2), "row_", "col_", "ref_agb")}
    assert len(got) == 36 and got[0, 0] == 0.0 and got[5, 5] == 44.0
    assert got[2, 3] == pytest.approx(2.0 * 0.75 + 20.0 * 1.25)


def test_disagreement_by_class(spark):
    ens = spark.createDataFrame([(0, 0, 10.0, 1.0), (0, 1, 20.0, 5.0), (0, 2, 30.0, 20.0), (1, 0, 40.0, 4.9), (1, 1, 1.0, 1.0), (1, 2, 7.0, None)],
                                "row_ LONG, col_ LONG, mean_agbd DOUBLE, std_agbd DOUBLE")
    lc = spark.createDataFrame([(0, 0, 10), (0, 1, 10), (0, 2, 10), (1, 0, 30), (1, 1, 0), (1, 2, 10)], "row_ LONG, col_ LONG, lc_class INT")
    got = rows(maps.disagreement_crosstab(ens, lc, (5.0, 20.0)), "lc_class", "disagreement", "n", "mean_agbd", "pct_of_class")
    third = pytest.approx(100 / 3)
    assert got == [(10, "high", 1, 30.0, third), (10, "low", 1, 10.0, third), (10, "middle", 1, 20.0, third), (30, "low", 1, 40.0, 100.0)]


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_early_stopping_over_many_ranges(spark, parts):
    """One run with most epochs, missing scores, gaps and repeats; ranges cut it anywhere."""
    def replay(log, patience, delta):
        best, best_epoch, wait, last = None, None, 0, None
        for e, s in sorted(log.items()):
            last = e
            if s is not None and (best is None or s < best - delta):
                best, best_epoch, wait = s, e, 0
            else:
                wait += 1
            if wait >= patience:
                break
        return best_epoch, best, last

    g = np.random.default_rng(13)
    logs = {"hot": {2 * e + 1: round(100 - 0.04 * e + float(g.normal(0, 0.4)), 3) for e in range(900)},
            "down": {e: 50.0 - e for e in range(1, 200)}, "flat": {e: 1.0 for e in range(1, 90)}, "short": {1: 3.0}, "none": {1: None, 2: None, 3: None},
            "late": {1: None, 2: 5.0, 3: None, 4: 4.0}}
    table = [(r, e, s) for r, x in logs.items() for e, s in x.items()] + [("hot", 1, 500.0), ("short", 0, -9.0), ("flat", 3, float("nan"))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for patience in (1, 3, 5):
            log = spark.createDataFrame(table, "run STRING, epoch INT, val_rmse DOUBLE").repartition(4)
            got = {r["run"]: (r["best_epoch"], r["best_rmse"], r["last_epoch"]) for r in scenes.best_epochs(log, patience, 0.05).collect()}
            assert got == {k: replay(v, patience, 0.05) for k, v in logs.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError):
        scenes.best_epochs(log, 0, 0.05)


def test_failure_log(spark):
    d = spark.createDataFrame([("b\tread\tx",), ("a\tdownload\ty",), ("  ",), ("b\tread\tz",)], "value STRING")
    assert [r[0] for r in readers.failed_ids(d).collect()] == ["a", "b"]


# ---- profile ----

def test_histogram_edges(spark):
    d = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 600)], "v DOUBLE")
    h = dict(rows(profile.histogram(d, "v", 5, 10.0), "bin", "n"))
    want, _ = np.histogram([0, 1, 2, 3, 10], bins=5)
    assert [h.get(i, 0) for i in range(5)] == want.tolist()


def test_months_without_rows_are_listed(spark):
    d = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '2020-01-03 00:00:00'), (TIMESTAMP_NTZ '2020-04-30 23:00:00') AS t(ts)")
    got = rows(profile.monthly_counts(d, "ts"))
    assert [(str(a), n, g) for a, n, g in got] == [("2020-01-31", 1, False), ("2020-02-29", 0, False),
                                                  ("2020-03-31", 0, False), ("2020-04-30", 1, True)]


# ---- models ----

def feature_frame(spark, n=900):
    g = np.random.default_rng(6)
    y = g.gamma(2, 60, n)
    from sylvagrid.constants import CHANNELS
    cols = {f"{c}_mean": y * 0.01 * (i + 1) + g.normal(0, 3, n) for i, c in enumerate(CHANNELS)}
    return spark.createDataFrame(pd.DataFrame({"patch_id": np.arange(n), "block_id": np.arange(n) % 31, "label": y, **cols}))


def test_one_pass_grid_equals_fitted_models(spark):
    d = feature_frame(spark)
    jobs = [("s2_only", 42), ("late", 7)]
    a = fusion.score_grid(fusion.fit_linear_grid(d, jobs), d)
    b = modelling.score_all(modelling.fit_grid(d, jobs), d).withColumnRenamed("pred_agbd", "other")
    j = a.join(b, ["patch_id", "variant", "seed"])
    assert j.count() == 1800
    assert j.agg(F.max(F.abs(F.col("pred_agbd") - F.col("other")))).first()[0] < 1e-2


def test_search_equals_fitted_models(spark):
    """Elastic nets from sums against Spark ML, and their validation error against its own scores."""
    from pyspark.ml.evaluation import RegressionEvaluator
    d = feature_frame(spark)
    columns = modelling.feature_columns("s1_only")
    train, valid = d.where("block_id % 5 <> 0"), d.where("block_id % 5 = 0")
    got = {(x["reg"], x["mix"]): x["val_rmse"] for x in fusion.search(train, valid, columns, regs=(0.1, 5.0))}
    weighted = train.withColumn("weight", modelling.seed_weights(42))
    for (reg, mix), rmse in got.items():
        pipe = modelling.regression_pipeline(columns)
        lr = pipe.getStages()[-1]
        m = pipe.fit(weighted, {lr.regParam: reg, lr.elasticNetParam: mix, lr.solver: "l-bfgs", lr.maxIter: 1000, lr.tol: 1e-12})
        want = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="rmse").evaluate(m.transform(valid))
        assert rmse == pytest.approx(want, rel=2e-4)


def test_huber_fit_ignores_outliers(spark):
    d = feature_frame(spark).withColumn("label", F.when(F.col("patch_id") % 20 == 0, F.col("label") + 5000).otherwise(F.col("label")))
    d = d.withColumn("label", F.col("label") + 0.0).cache()
    columns = modelling.feature_columns("s1_only")
    model = fusion.fit_huber(d, columns, delta=30.0)
    pull = {r.term: r.gradient for r in fusion.loss_gradient(d, model, delta=30.0).collect()}
    assert pull.keys() == {"intercept", *columns} and max(map(abs, pull.values())) < 1e-5
    clean = fusion.fit_huber(d.where("patch_id % 20 <> 0"), columns, delta=30.0)
    assert abs(model.intercept - clean.intercept) < 15
    assert max(abs(r.gradient) for r in fusion.loss_gradient(d, clean, delta=30.0).collect()) > 0.1


def test_window_features(spark):
    g = np.random.default_rng(3)
    a = g.normal(0, 1, (6, 7))
    points = spark.createDataFrame([(1, 0, 0), (2, 3, 3), (3, 3, 3), (4, 9, 9)], "patch_id LONG, crow LONG, ccol LONG")
    got = dict(rows(modelling.window_features(points, grid_frame(spark, a), ["v"], 1), "patch_id", "v_mean"))
    assert got == {1: pytest.approx(a[:2, :2].mean()), 2: pytest.approx(a[2:5, 2:5].mean()), 3: pytest.approx(a[2:5, 2:5].mean())}


def test_grids_and_unknown_variant():
    assert len(modelling.run_grid()) == 12 and modelling.run_grid()[0][1] == 42
    assert modelling.map_jobs() == [("late", 42), ("late", 7), ("late", 123), ("s2_only", 7), ("s1_only", 7), ("early", 7)]
    with pytest.raises(KeyError):
        modelling.feature_columns("other")


# ---- joins of tables that grow ----

def joins_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_point_to_raster_broadcasts_no_grid(spark):
    from sylvagrid.plans import checks
    plan = joins_of(checks.QUERIES["jn5_point_to_raster"](spark, "/root/testdata/sf0.001"))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan and "explode" not in plan


@pytest.mark.parametrize("name", ["jn13_positional_by_id", "jn1_predictions_landcover"])
def test_predictions_are_streamed_past_the_hashed_side(spark, name):
    from sylvagrid.plans import checks
    plan = joins_of(checks.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


def test_looked_up_keeps_all_rows_in_any_number_of_parts(spark):
    from sylvagrid.operators.sizing import looked_up
    df = spark.createDataFrame([(i % 50 if i % 3 else None, i) for i in range(300)], "k bigint, v bigint")
    side = spark.createDataFrame([(k, f"s{k}") for k in range(40)], "k bigint, s string")
    want = sorted((i, f"s{i % 50}" if i % 3 and i % 50 < 40 else None) for i in range(300))
    for rows in (1, 4, 1000):
        out = looked_up(df, side, "k", rows)
        assert sorted((r.v, r.s) for r in out.collect()) == want
    assert looked_up(df, side, "k", 1).rdd.getNumPartitions() == 40


@pytest.mark.parametrize("fill", [None, [7.0, 8.0, 9.0]])
def test_summaries_of_tiles_equal_those_of_their_patches(spark, fill):
    from sylvagrid.plans import fixtures, q_dataset
    t = fixtures.Tables(spark, "/root/testdata/sf0.01")
    args = (q_dataset.points(t), q_dataset.pixels(t), q_dataset.BANDS, 2, 4, fill)
    want = q_dataset.patch_sums(patches.extract_patches_tiled(*args))
    got = q_dataset.tiled_sums(t, 2, 4, fill)
    assert got.schema == want.schema or [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert got.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
