"""Scalar expressions: edge cases."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvagrid import constants
from sylvagrid.functions import arrays, cleaning, geo, sensors, text, times


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_beams_and_channels():
    assert len(constants.BEAMS) == 8 and set(constants.POWER_BEAMS) <= set(constants.BEAMS)
    assert len(constants.CHANNELS) == 15
    assert [len(constants.VARIANT_CHANNELS[v]) for v in constants.VARIANT_ORDER] == [5, 12, 15, 15]
    for _, w, s, e, n in constants.AOIS:
        assert w < e and s < n


def test_nodata_and_clip_keep_null(spark):
    nan, null = F.lit(float("nan")), F.lit(None).cast("double")
    r = one(spark, cleaning.nan_to_null(nan), cleaning.nan_to_null(null), cleaning.nodata_to_null(F.lit(-32768.0), -32768.0),
            cleaning.nodata_to_null(F.lit(1.5), -32768.0), cleaning.clip(null, 0.0), cleaning.clip(F.lit(-2.0), 0.0),
            cleaning.clip(F.lit(900.0), 0.0, 500.0), cleaning.positive(F.lit(0.0)))
    assert list(r) == [None, None, None, 1.5, None, 0.0, 500.0, None]


def test_zscore_rejects_near_zero_std(spark):
    with pytest.raises(Exception, match="near-zero"):
        one(spark, cleaning.zscore(F.lit(1.0), F.lit(0.0), F.lit(1e-9), 1e-8))


def test_granule_name(spark):
    good = F.lit("GEDI04_A_2020366235959_O12345_02.h5")
    r = one(spark, times.granule_timestamp(good).cast("string"), times.granule_orbit(good),
            times.granule_timestamp(F.lit("other.h5")), times.granule_orbit(F.lit("other.h5")))
    assert list(r) == ["2020-12-31 23:59:59", 12345, None, -1]


def test_floor_cells_below_zero(spark):
    r = one(spark, geo.cell_index(F.lit(-7.0), 2.0), geo.cell_index(F.lit(-8.0), 2.0), geo.cell_index(F.lit(7.0), 2.0))
    assert list(r) == [-4, -4, 3]


def test_two_pixel_conventions(spark):
    g = geo.Grid(0.0, 100.0, 10.0, 10.0, 10, 10)
    r = one(spark, geo.pixel_col(F.lit(25.0), g), geo.pixel_col_rounded(F.lit(25.0), g),
            geo.pixel_col_rounded(F.lit(35.0), g), geo.pixel_row(F.lit(100.0), g))
    assert list(r) == [2, 2, 4, 0]


def test_box_is_inclusive(spark):
    r = one(spark, geo.in_box(F.lit(1.0), F.lit(2.0), 1.0, 2.0, 3.0, 4.0),
            geo.in_box(F.lit(3.0), F.lit(4.0), 1.0, 2.0, 3.0, 4.0),
            geo.in_box(F.lit(3.0001), F.lit(4.0), 1.0, 2.0, 3.0, 4.0))
    assert list(r) == [True, True, False]


def test_degree_tiles_exclusive_upper(spark):
    r = one(spark, geo.degree_span(F.lit(42.0), F.lit(43.0)), geo.degree_span(F.lit(-8.5), F.lit(-7.3)),
            geo.degree_tile_name(F.lit(-3), F.lit(115)))
    assert r[0] == [42] and r[1] == [-9, -8]
    assert r[2] == "Copernicus_DSM_COG_10_S03_00_E115_00_DEM"


def meridian_arc(lat_deg):
    """Length of the WGS84 meridian from the equator, by numerical integration."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    phi = np.linspace(0.0, math.radians(lat_deg), 200001)
    y = a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    return float(np.sum((y[1:] + y[:-1]) / 2) * (phi[1] - phi[0]))


@pytest.mark.parametrize("lat", [0.0, 42.6, 43.55, 70.0])
def test_utm_on_the_central_meridian(spark, lat):
    e, n = one(spark, *geo.utm_xy(F.lit(-9.0), F.lit(lat)))
    assert e == pytest.approx(500000.0, abs=1e-6)
    assert n == pytest.approx(0.9996 * meridian_arc(lat), abs=1e-3)


def test_utm_is_symmetric_and_conformal(spark):
    e1, n1 = one(spark, *geo.utm_xy(F.lit(-8.0), F.lit(43.0)))
    e2, n2 = one(spark, *geo.utm_xy(F.lit(-10.0), F.lit(43.0)))
    assert e1 - 500000 == pytest.approx(500000 - e2, abs=1e-6) and n1 == pytest.approx(n2, abs=1e-6)
    d = 1e-6
    ex, nx = one(spark, *geo.utm_xy(F.lit(-8.0 + d), F.lit(43.0)))
    ey, ny = one(spark, *geo.utm_xy(F.lit(-8.0), F.lit(43.0 + d)))
    cross = (ex - e1) * (ey - e1) + (nx - n1) * (ny - n1)
    assert abs(cross) < 1e-6 * math.hypot(ex - e1, nx - n1) * math.hypot(ey - e1, ny - n1) * 100


def test_sensor_scalars(spark):
    r = one(spark, sensors.to_db(F.lit(100.0)), sensors.to_db(F.lit(0.0)), sensors.ndvi(F.lit(3.0), F.lit(1.0)),
            sensors.ndvi(F.lit(0.0), F.lit(0.0)), sensors.huber(F.lit(-10.0), 30.0), sensors.huber(F.lit(50.0), 30.0))
    assert list(r) == [20.0, None, 0.5, None, 50.0, 1050.0]


def test_names(spark):
    r = one(spark, text.landcover_name(F.lit(95)), text.landcover_name(F.lit(7)), text.run_name(F.lit("early"), F.lit(7)),
            text.band_kind(F.lit("x_VV.tif")), text.band_kind(F.lit("x_inc_map.tif")), text.band_kind(F.lit("x.zip")))
    assert list(r) == ["mangroves", "unknown", "early_fusion_seed7", "VV", "LIA", None]


@pytest.mark.parametrize("turns", range(4))
@pytest.mark.parametrize("h", [False, True])
@pytest.mark.parametrize("v", [False, True])
def test_dihedral_index_matches_numpy(turns, h, v):
    a = np.arange(25).reshape(5, 5)
    want = np.rot90(a, turns)
    want = want[:, ::-1] if h else want
    want = want[::-1, :] if v else want
    assert arrays.dihedral_index(5, turns, h, v) == want.reshape(-1).tolist()


def test_eight_distinct_variants(spark):
    p = F.array(*[F.lit(float(i)) for i in range(9)])
    rows = one(spark, arrays.dihedral_variants(p, 3).alias("x"))["x"]
    assert len({tuple(r["patch"]) for r in rows}) == 8


def test_strided_grid():
    g = geo.Grid(0.0, 1000.0, 10.0, 10.0, 100, 57).strided(12, 10)
    assert (g.height, g.width) == (len(range(12, 88, 10)), len(range(12, 45, 10)))
    assert (g.x0, g.y0, g.dx) == (120.0, 880.0, 100.0)


def test_points_as_well_known_binary(spark):
    values = [0.0, -0.0, 1.0, -8.5, 42.6, 2.0, 0.5, 1 / 3, -1e-7, 123456.789, 2.0**-1022, 5e-324, 1.7976931348623157e308, 3.9999999999999996, 4.000000000000001]
    g = random.Random(1)
    values += [g.uniform(-180, 180) for _ in range(200)] + [g.uniform(-1, 1) * 2.0 ** g.randint(-1000, 1000) for _ in range(200)]
    d = spark.createDataFrame([(i, x, values[-i]) for i, x in enumerate(values)], "i INT, x DOUBLE, y DOUBLE")
    w = d.withColumn("w", geo.point_wkb("x", "y"))
    px, py = geo.wkb_point("w")
    for r in w.select("x", "y", "w", px.alias("px"), py.alias("py")).collect():
        assert bytes(r.w) == struct.pack("<BIdd", 1, 1, r.x, r.y)
        assert (r.px, r.py) == (r.x, r.y)
    odd = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0)], "x DOUBLE, y DOUBLE")
    assert odd.select(geo.point_wkb("x", "y").alias("w")).where("w is not null").count() == 0
    other = spark.createDataFrame([(b"",), (b"lon lat",), (struct.pack(">BIdd", 0, 1, 1.0, 2.0),)], "w BINARY")
    assert other.select(geo.wkb_point("w")[0].alias("x")).where("x is not null").count() == 0
