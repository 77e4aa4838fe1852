"""Scalar band arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import as_col


def to_db(power: Column | str) -> Column:
    """Linear power to decibel, NULL unless positive."""
    p = as_col(power)
    return F.when(p > 0, 10.0 * F.log10(p))


def to_degrees(radians: Column | str) -> Column:
    return F.degrees(as_col(radians))


def ratio_db(vv_db: Column | str, vh_db: Column | str) -> Column:
    return as_col(vv_db) - as_col(vh_db)


def ndvi(nir: Column | str, red: Column | str) -> Column:
    n, r = as_col(nir), as_col(red)
    return F.when((n + r) != 0, (n - r) / (n + r))


def huber(error: Column, delta: float) -> Column:
    a = F.abs(error)
    return F.when(a <= delta, error * error / 2.0).otherwise(delta * (a - delta / 2.0))
