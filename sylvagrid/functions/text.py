"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import LANDCOVER_NAMES, RUN_NAMES
from .cleaning import as_col


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def lookup(code: Column | str, names: dict, default: Column | str) -> Column:
    """Name of a code from a small fixed dictionary, with a default."""
    d = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.try_element_at(literal_map(names), as_col(code)), d)


def landcover_name(code: Column | str) -> Column:
    return lookup(as_col(code).cast("int"), LANDCOVER_NAMES, "unknown")


def run_name(variant: Column | str, seed: Column | str) -> Column:
    return F.concat(lookup(variant, RUN_NAMES, as_col(variant)), F.lit("_seed"), as_col(seed).cast("string"))


def plus_minus(mean: Column | str, std: Column | str, digits: int = 3) -> Column:
    f = f"%.{digits}f +/- %.{digits}f"
    return F.format_string(f, as_col(mean), as_col(std))


def band_kind(file_name: Column | str) -> Column:
    """VV / VH / LIA from a file name, NULL for anything else."""
    n = F.lower(as_col(file_name))
    return (F.when(n.endswith("_vv.tif"), "VV").when(n.endswith("_vh.tif"), "VH")
            .when(n.contains("inc_map") & n.endswith(".tif"), "LIA"))


def hash_order(seed: int, ident: Column | str) -> Column:
    """Seeded pseudo-random order that any engine reproduces: md5('<seed>|<id>')."""
    return F.md5(F.concat(F.lit(f"{seed}|"), as_col(ident).cast("string")))
