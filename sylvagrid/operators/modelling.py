"""Comparing sensor-fusion feature sets with Spark ML on one split and several seeds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DEM_BANDS, S1_BANDS, S2_BANDS, SEEDS, VARIANT_CHANNELS, VARIANT_ORDER
from ..functions.text import hash_order
from .raster import focal_stats

LABEL = "label"


def feature_columns(variant: str, suffixes: Sequence[str] = ("_mean",)) -> list[str]:
    """Window feature columns of a variant, by channel name."""
    if variant not in VARIANT_CHANNELS:
        raise KeyError(f"unknown variant {variant!r}; known: {sorted(VARIANT_CHANNELS)}")
    return [f"{c}{s}" for c in VARIANT_CHANNELS[variant] for s in suffixes]


def window_features(points: DataFrame, pixels: DataFrame, bands: Sequence[str], half: int) -> DataFrame:
    """``points`` (crow, ccol) with ``<band>_mean``, the mean of each band's valid pixels around them.

    Windows are moving sums over tiles, so a pixel travels once, and a center that many points
    share is joined, not summed, many times. Points outside the grid or without a valid pixel
    in some band are dropped.
    """
    means = focal_stats(pixels.select("row_", "col_", *bands), bands, half).select(
        F.col("row_").alias("crow"), F.col("col_").alias("ccol"), *[f"{b}_mean" for b in bands])
    return points.join(means.dropna(subset=[f"{b}_mean" for b in bands]), ["crow", "ccol"])


def assembler(columns: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error")


def regression_pipeline(columns: Sequence[str], loss: str = "squaredError", reg: float = 1e-3,
                        prediction: str = "prediction") -> Pipeline:
    """Assemble and fit a linear model, which standardises its features itself.

    Squared error is solved from one pass of normal equations, 15 x 15 at most; the
    Huber loss iterates with tree-combined gradients.
    """
    lr = LinearRegression(featuresCol="features", labelCol=LABEL, predictionCol=prediction, weightCol="weight",
                          regParam=reg, loss=loss, maxIter=50,
                          solver="normal" if loss == "squaredError" else "l-bfgs")
    return Pipeline(stages=[assembler(columns), lr])


def seed_weights(seed: int, ident: str = "patch_id") -> Column:
    """Exponential row weights from a seeded hash (a Bayesian bootstrap).

    Every row stays in; the seed varies the fit as a random initialisation would.
    """
    return -F.log((hash_number(seed, ident).cast("double") + 0.5) / 4294967296.0)


def hash_number(seed: int, ident: Column | str) -> Column:
    """A 32-bit number from a seeded hash that any engine reproduces."""
    return F.conv(F.substring(hash_order(seed, ident), 1, 8), 16, 10).cast("long")


def fit_single(train: DataFrame, columns: Sequence[str], seed: int, loss: str = "squaredError") -> PipelineModel:
    return regression_pipeline(columns, loss).fit(train.withColumn("weight", seed_weights(seed)))


def fold_of(block: str, folds: int) -> Column:
    """Fold of a spatial block, so that neighbours never sit on both sides."""
    return (hash_number(0, block) % folds).cast("int")


class LateFusion:
    """Per-sensor models, each with the terrain channels, joined by a second-stage model.

    The second stage is trained on out-of-fold predictions, folds being spatial blocks,
    so it never sees a prediction of a model that knew the row.
    """

    SENSORS = {"s2": S2_BANDS + DEM_BANDS, "s1": S1_BANDS + DEM_BANDS}

    def __init__(self, seed: int, folds: int = 3, suffixes: Sequence[str] = ("_mean",)):
        self.seed, self.folds, self.suffixes = seed, folds, suffixes
        self.models: dict[str, PipelineModel] = {}
        self.top: PipelineModel | None = None

    def _columns(self, sensor: str) -> list[str]:
        return [f"{c}{s}" for c in self.SENSORS[sensor] for s in self.suffixes]

    def fit(self, train: DataFrame) -> "LateFusion":
        t = train.withColumn("fold", fold_of("block_id", self.folds)).withColumn(
            "weight", seed_weights(self.seed)).persist()
        try:
            held_out = None
            for k in range(self.folds):
                rest, part = t.where(F.col("fold") != k), t.where(F.col("fold") == k)
                for sensor in self.SENSORS:
                    m = regression_pipeline(self._columns(sensor), prediction=f"p_{sensor}").fit(rest)
                    part = m.transform(part).drop("features")
                held_out = part if held_out is None else held_out.unionByName(part)
            for sensor in self.SENSORS:
                self.models[sensor] = regression_pipeline(self._columns(sensor), prediction=f"p_{sensor}").fit(t)
            self.top = regression_pipeline([f"p_{s}" for s in self.SENSORS]).fit(held_out)
        finally:
            t.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for m in self.models.values():
            out = m.transform(out).drop("features")
        return self.top.transform(out).drop("features")


def fit_variant(train: DataFrame, variant: str, seed: int, suffixes: Sequence[str] = ("_mean",)):
    if variant == "late":
        return LateFusion(seed, suffixes=suffixes).fit(train)
    return fit_single(train, feature_columns(variant, suffixes), seed)


def run_grid(variants: Sequence[str] = VARIANT_ORDER, seeds: Sequence[int] = SEEDS) -> list[tuple[str, int]]:
    """Seed-major list of (variant, seed)."""
    return [(v, s) for s in seeds for v in variants]


def fit_grid(train: DataFrame, jobs: Sequence[tuple[str, int]] | None = None,
             suffixes: Sequence[str] = ("_mean",)) -> dict:
    """One Spark ML model per (variant, seed), for losses that a single pass cannot solve.

    The loop runs over a fixed dozen of distributed fits. Linear least-squares models come
    from one pass in ``fusion.fit_linear_grid``.
    """
    kept = train.persist()
    try:
        return {(v, s): fit_variant(kept, v, s, suffixes) for v, s in (jobs or run_grid())}
    finally:
        kept.unpersist()


def score_all(models: Mapping[tuple[str, int], object], test: DataFrame) -> DataFrame:
    """Long prediction table: patch_id, variant, seed, true_agbd, pred_agbd. The patch id
    travels through the scoring, so nothing depends on row order."""
    out = None
    for (variant, seed), m in models.items():
        p = m.transform(test).select("patch_id", F.lit(variant).alias("variant"), F.lit(seed).alias("seed"),
                                     F.col(LABEL).cast("float").alias("true_agbd"),
                                     F.col("prediction").cast("float").alias("pred_agbd"))
        out = p if out is None else out.unionByName(p)
    return out


def map_jobs() -> list[tuple[str, int]]:
    """The fixed list of mapped models: late fusion with every seed, the others with seed 7."""
    return [("late", s) for s in SEEDS] + [(v, 7) for v in ("s2_only", "s1_only", "early")]


def batch_score(df: DataFrame, columns: Sequence[str], make_predict: Callable, batch_size: int = 256,
                out: str = "prediction") -> DataFrame:
    """Scores of a user-supplied array model, loaded once per Python worker.

    ``make_predict`` returns a function from a (batch, features) array to a vector. The
    feature array is built in generated code and crosses to Python as Arrow batches.
    """
    f = predict_batch_udf(make_predict, return_type=T.DoubleType(), batch_size=batch_size,
                          input_tensor_shapes=[[len(columns)]])
    return df.withColumn(out, f(F.array(*[F.col(c).cast("double") for c in columns])))


def linear_predictor(weights: Sequence[float], intercept: float) -> Callable[[], Callable]:
    def make() -> Callable[[np.ndarray], np.ndarray]:
        w = np.asarray(weights, dtype="float64")

        def predict(x: np.ndarray) -> np.ndarray:
            return x @ w + intercept

        return predict

    return make

