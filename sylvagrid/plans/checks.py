"""All registered queries (importing the modules registers them)."""

from . import q_dataset, q_maps, q_metrics, q_ml, q_profile, q_raster, q_scenes, q_shots, q_stream  # noqa: F401
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
