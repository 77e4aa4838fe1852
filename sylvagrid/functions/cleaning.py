"""Null handling: every nodata code becomes NULL before any arithmetic.

Spark orders NaN above every number and lets it through ``>=`` filters and into
averages, so NaN never survives the loaders.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def nodata_to_null(c: Column | str, *codes: float) -> Column:
    """NULL for NaN and for each sentinel."""
    c = as_col(c)
    ok = ~F.isnan(c)
    if codes:
        ok = ok & ~c.isin(*codes)
    return F.when(ok, c)


def clean_columns(df: DataFrame, columns: Iterable[str], *codes: float) -> DataFrame:
    return df.withColumns({c: nodata_to_null(c, *codes) for c in columns})


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Clip that keeps NULL (greatest/least alone would turn NULL into the bound)."""
    c = as_col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def positive(c: Column | str) -> Column:
    """Non-positive power is nodata."""
    c = as_col(c)
    return F.when(~F.isnan(c) & (c > 0), c)


def valid_mask(c: Column | str, nodata: float | None = None, zero_is_nodata: bool = False,
               below: float | None = None) -> Column:
    """Boolean (never NULL): present, not a nodata code, optionally > 0 and < a ceiling."""
    c = as_col(c)
    ok = c.isNotNull() & ~F.isnan(c)
    if nodata is not None:
        ok = ok & (c != nodata)
    if zero_is_nodata:
        ok = ok & (c > 0)
    if below is not None:
        ok = ok & (c < below)
    return F.coalesce(ok, F.lit(False))


def zscore(c: Column | str, mean: Column, std: Column, min_std: float) -> Column:
    """(x - mean) / std; a near-zero std is an error, not an infinity."""
    c = as_col(c)
    return F.when(std >= min_std, (c - mean) / std).otherwise(
        F.raise_error(F.lit("near-zero standard deviation in the normalisation table")).cast("double"))


def zscore_filled(c: Column | str, mean: Column, std: Column, min_std: float) -> Column:
    """Mean fill in normalised space: a missing pixel becomes 0."""
    return F.coalesce(zscore(c, mean, std, min_std), F.lit(0.0))
