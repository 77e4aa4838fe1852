"""Coordinates, grids, cells and tile names as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from math import radians, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BLOCK_ID_SCALE
from .cleaning import as_col


@dataclass(frozen=True)
class Grid:
    """A north-up raster grid; (x0, y0) is the outer corner of pixel (0, 0)."""

    x0: float
    y0: float
    dx: float
    dy: float
    height: int
    width: int
    epsg: int = 32629

    def strided(self, half: int, stride: int) -> "Grid":
        """Grid of a map sampled at every ``stride``-th pixel, starting ``half`` in."""
        n_rows = max(0, -(-(self.height - 2 * half) // stride))
        n_cols = max(0, -(-(self.width - 2 * half) // stride))
        return Grid(self.x0 + self.dx * half, self.y0 - self.dy * half,
                    self.dx * stride, self.dy * stride, n_rows, n_cols, self.epsg)


def cell_index(coord: Column | str, size: float) -> Column:
    """Floor division (SQL ``div`` truncates towards zero, which is wrong below 0)."""
    return F.floor(as_col(coord) / F.lit(float(size))).cast("long")


def block_id(easting: Column | str, northing: Column | str, size: float) -> Column:
    return cell_index(easting, size) * F.lit(BLOCK_ID_SCALE).cast("long") + cell_index(northing, size)


def pixel_row(northing: Column | str, g: Grid) -> Column:
    return F.floor((F.lit(g.y0) - as_col(northing)) / F.lit(g.dy)).cast("long")


def pixel_col(easting: Column | str, g: Grid) -> Column:
    return F.floor((as_col(easting) - F.lit(g.x0)) / F.lit(g.dx)).cast("long")


def pixel_row_rounded(northing: Column | str, g: Grid) -> Column:
    """Half-even rounding, the convention of the land cover lookup."""
    return F.rint((F.lit(g.y0) - as_col(northing)) / F.lit(g.dy)).cast("long")


def pixel_col_rounded(easting: Column | str, g: Grid) -> Column:
    return F.rint((as_col(easting) - F.lit(g.x0)) / F.lit(g.dx)).cast("long")


def in_bounds(row: Column | str, col: Column | str, g: Grid, half: int) -> Column:
    r, c = as_col(row), as_col(col)
    return (r >= half) & (r < g.height - half) & (c >= half) & (c < g.width - half)


def in_box(lon: Column | str, lat: Column | str, west: float, south: float,
           east: float, north: float) -> Column:
    """Inclusive on all four sides."""
    return as_col(lon).between(west, east) & as_col(lat).between(south, north)


def box_wkt(w: Column | str, s: Column | str, e: Column | str, n: Column | str) -> Column:
    west, south, east, north = (as_col(c).cast("string") for c in (w, s, e, n))

    def corner(x: Column, y: Column) -> Column:
        return F.concat_ws(" ", x, y)

    ring = F.concat_ws(", ", corner(west, south), corner(east, south), corner(east, north),
                       corner(west, north), corner(west, south))
    return F.concat(F.lit("POLYGON(("), ring, F.lit("))"))


# Layout of a double (exponent bias, mantissa bits) and the head of a little-endian well-known binary point.
_BIAS, _MANTISSA = 1023, 52
_POINT_HEAD = "0101000000"


def _double_bytes(c: Column) -> Column:
    """The eight bytes of a double, lowest first, as hexadecimal text."""
    size = F.abs(c)
    guess = F.greatest(F.floor(F.log2(size)), F.lit(1 - _BIAS)).cast("int")  # the logarithm may round across a power of two
    power = F.when(size < F.pow(F.lit(2.0), guess), guess - 1).when(size >= F.pow(F.lit(2.0), guess + 1), guess + 1).otherwise(guess)
    power = F.greatest(power, F.lit(1 - _BIAS))
    scaled = (size / F.pow(F.lit(2.0), power) * F.lit(float(2**_MANTISSA))).cast("long")
    # Below the smallest power of two the leading one is missing, and the exponent field is 0.
    field = F.shiftleft((power + _BIAS - 1).cast("long"), _MANTISSA) + scaled
    bits = F.when(size == 0, F.lit(0).cast("long")).otherwise(field)
    sign = (c < 0) | (c.cast("string") == "-0.0")
    bits = F.when(sign, bits.bitwiseOR(F.lit(-2**63))).otherwise(bits)
    text = F.lpad(F.hex(bits), 16, "0")
    return F.concat(*[F.substring(text, 15 - 2 * i, 2) for i in range(8)])


def point_wkb(x: Column | str, y: Column | str) -> Column:
    """Well-known binary of a point, little-endian; NULL where a coordinate is NULL or not finite."""
    x, y = as_col(x).cast("double"), as_col(y).cast("double")

    def finite(c: Column) -> Column:
        return F.abs(c) < F.lit(float("inf"))

    return F.when(finite(x) & finite(y), F.unhex(F.concat(F.lit(_POINT_HEAD), _double_bytes(x), _double_bytes(y))))


def _double_at(wkb: Column, place: int) -> Column:
    """The double in bytes ``place`` to ``place`` + 7 (from 1), lowest first."""
    bits = F.lit(0).cast("long")
    for i in range(8):
        byte = F.conv(F.hex(F.substring(wkb, place + i, 1)), 16, 10).cast("long")
        bits = bits.bitwiseOR(F.shiftleft(byte, 8 * i))
    exponent = F.shiftright(bits, _MANTISSA).bitwiseAND(F.lit(2047))
    mantissa = bits.bitwiseAND(F.lit(2**_MANTISSA - 1)).cast("double") / F.lit(float(2**_MANTISSA))
    size = F.when(exponent == 0, mantissa * F.pow(F.lit(2.0), F.lit(1 - _BIAS))).when(
        exponent < 2047, (mantissa + 1) * F.pow(F.lit(2.0), exponent - _BIAS))
    return F.when(bits < 0, -size).otherwise(size)


def wkb_point(wkb: Column | str) -> tuple[Column, Column]:
    """(x, y) of a little-endian well-known binary point; NULL for anything else."""
    b = as_col(wkb)
    good = (F.octet_length(b) == 21) & (F.hex(F.substring(b, 1, 5)) == _POINT_HEAD)
    return F.when(good, _double_at(b, 6)), F.when(good, _double_at(b, 14))


def degree_tile_name(lat: Column | str, lon: Column | str) -> Column:
    """Elevation tile name of a one-degree cell, from its south-west corner."""
    la, lo = as_col(lat), as_col(lon)
    ns = F.when(la >= 0, "N").otherwise("S")
    ew = F.when(lo >= 0, "E").otherwise("W")
    return F.concat(F.lit("Copernicus_DSM_COG_10_"), ns, F.lpad(F.abs(la).cast("string"), 2, "0"),
                    F.lit("_00_"), ew, F.lpad(F.abs(lo).cast("string"), 3, "0"), F.lit("_00_DEM"))


def degree_span(low: Column | str, high: Column | str) -> Column:
    """Array of whole degrees touched by [low, high), the upper bound exclusive."""
    return F.sequence(F.floor(as_col(low)).cast("long"), F.floor(as_col(high) - F.lit(1e-9)).cast("long"))


# WGS84 ellipsoid and the UTM projection constants.
_A = 6378137.0
_F = 1 / 298.257223563
_K0 = 0.9996
_FALSE_EASTING = 500000.0


def utm_zone_meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def utm_xy(lon: Column | str, lat: Column | str, zone: int = 29) -> tuple[Column, Column]:
    """Transverse Mercator by the Krueger series to fourth order (northern hemisphere).

    Truncation error is far below a millimetre inside the zone, and the whole thing
    is column arithmetic, so it stays in generated code.
    """
    n = _F / (2 - _F)
    rect = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    ecc = 2 * sqrt(n) / (1 + n)
    phi = F.radians(as_col(lat))
    lam = F.radians(as_col(lon)) - F.lit(radians(utm_zone_meridian(zone)))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - ecc * F.atanh(ecc * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(series, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(_FALSE_EASTING) + F.lit(_K0 * rect) * east, F.lit(_K0 * rect) * north
