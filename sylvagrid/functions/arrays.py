"""Array expressions over patches stored channel-major, then row, then column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import as_col


def take_channels(patch: Column | str, channels: Sequence[int], size: int) -> Column:
    """Channel subset of a flat patch of ``size`` x ``size`` pixels per channel."""
    p = as_col(patch)
    area = size * size
    return F.flatten(F.array(*[F.slice(p, c * area + 1, area) for c in channels]))


def dihedral_index(size: int, turns: int, flip_h: bool, flip_v: bool) -> list[int]:
    """Source index of every output pixel: quarter turns counter-clockwise, then flips."""
    out = []
    for r in range(size):
        for c in range(size):
            rr = size - 1 - r if flip_v else r
            cc = size - 1 - c if flip_h else c
            for _ in range(turns % 4):
                rr, cc = cc, size - 1 - rr
            out.append(rr * size + cc)
    return out


def permute(patch: Column | str, index: Sequence[int]) -> Column:
    """Reorder by a literal index array (one expression, no UDF)."""
    p = as_col(patch)
    return F.transform(F.lit(list(index)), lambda i: F.get(p, i))


def dihedral_variants(patch: Column | str, size: int) -> Column:
    """Array of the 8 distinct turns and flips as structs (turns, flip_h, patch)."""
    return F.array(*[
        F.struct(F.lit(k).alias("turns"), F.lit(h).alias("flip_h"),
                 permute(patch, dihedral_index(size, k, h, False)).alias("patch"))
        for h in (False, True) for k in range(4)
    ])


def no_missing(patch: Column | str) -> Column:
    return F.forall(as_col(patch), lambda v: v.isNotNull())
