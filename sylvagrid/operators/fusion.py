"""Linear models from sums of products, each pass of which is one aggregate.

A weighted least-squares fit needs only sums of products of its columns. One pass yields
those sums per seed and spatial fold, a few hundred numbers each; every variant, every
fold model and the second stage of late fusion are then solved from them. Late fusion of
linear models is again linear, so scoring all models is one projection. A search over
penalties fits and validates every candidate from one pass as well: the squared error of a
linear model on other rows is a quadratic form of their sums. A Huber fit is a sequence of
such sums, each weighted by the residuals of the fit before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CHANNELS, HUBER_DELTA, SEEDS
from .modelling import LABEL, LateFusion, feature_columns, fold_of, run_grid, seed_weights


@dataclass(frozen=True)
class LinearModel:
    columns: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self):
        out = F.lit(self.intercept)
        for c, w in zip(self.columns, self.weights):
            out = out + F.lit(w) * F.col(c)
        return out


def matrices(rows: DataFrame, columns: Sequence[str], weights: Sequence[str], groups: int,
             residual: LinearModel | None = None, delta: float = 0.0) -> np.ndarray:
    """Sums of products of (1, columns, label) by weight column and ``_group`` (0 to ``groups`` - 1).

    Each task folds its rows into one small matrix per weight and group; what reaches the
    driver is weights x groups x (columns + 2)**2 numbers, whatever the row count. With
    ``residual`` a row whose residual under that model is beyond ``delta`` weighs less, so
    that its pull is that of the Huber loss.
    """
    columns, weights = list(columns), list(weights)
    width = len(columns) + 2
    shape = (len(weights), groups, width, width)
    beta = None if residual is None else np.array([residual.intercept, *residual.weights])
    d = rows.select(*[F.col(c).cast("double").alias(c) for c in [*columns, LABEL]], "_group", *weights)

    def fold_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(shape)
        for b in batches:
            z = np.column_stack([np.ones(len(b)), b[columns].to_numpy(), b[LABEL].to_numpy()])
            down = 1.0 if beta is None else delta / np.maximum(np.abs(z[:, -1] - z[:, :-1] @ beta), delta)
            group = b["_group"].to_numpy()
            for i, name in enumerate(weights):
                w = (b[name].to_numpy() * down)[:, None]
                for k in range(groups):
                    m = group == k
                    acc[i, k] += z[m].T @ (z[m] * w[m])
        at = np.flatnonzero(acc)
        yield pd.DataFrame({"cell": at, "v": acc.reshape(-1)[at]})

    out = np.zeros(shape).reshape(-1)
    for r in d.mapInPandas(fold_rows, "cell LONG, v DOUBLE").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out.reshape(shape)


def product_sums(train: DataFrame, columns: Sequence[str], seeds: Sequence[int], folds: int,
                 ident: str = "patch_id", block: str = "block_id") -> dict[tuple[int, int], np.ndarray]:
    """Weighted sums of products of (1, columns, label) per (seed, fold)."""
    weights = {f"_w{s}": seed_weights(s, ident) for s in seeds}
    sums = matrices(train.withColumns({"_group": fold_of(block, folds), **weights}), columns, list(weights), folds)
    return {(s, k): sums[i, k] for i, s in enumerate(seeds) for k in range(folds)}


@dataclass(frozen=True)
class _Standardised:
    """Moments of standardised features and label."""

    use: list[int]
    mean: np.ndarray
    std: np.ndarray
    y_mean: float
    y_std: float
    corr: np.ndarray
    corr_y: np.ndarray

    def coefficients(self, beta: np.ndarray, width: int) -> np.ndarray:
        """Intercept and coefficients in the units of the table, over all columns."""
        out = np.zeros(width - 1)
        out[self.use] = beta * self.y_std / self.std
        out[0] = self.y_mean - out[self.use] @ self.mean
        return out


def _standardised(g: np.ndarray, use: Sequence[int]) -> _Standardised:
    n, use = g[0, 0], list(use)
    mean, y_mean = g[0, use] / n, g[0, -1] / n
    cov = g[np.ix_(use, use)] / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    y_std = float(np.sqrt(max(g[-1, -1] / n - y_mean ** 2, 1e-300)))
    return _Standardised(use, mean, std, float(y_mean), y_std, cov / np.outer(std, std),
                         (g[use, -1] / n - mean * y_mean) / (std * y_std))


def solve(g: np.ndarray, use: Sequence[int], reg: float) -> np.ndarray:
    """Ridge coefficients over the augmented columns (intercept first), on standardised
    features; ``use`` lists the feature positions in the matrix, the label comes last.

    The penalty is scaled by the label's deviation, as Spark ML's linear regression does.
    """
    s = _standardised(g, use)
    return s.coefficients(np.linalg.solve(s.corr + reg / s.y_std * np.eye(len(s.use)), s.corr_y), len(g))


def solve_elastic(g: np.ndarray, use: Sequence[int], reg: float, mix: float, tolerance: float = 1e-12) -> np.ndarray:
    """Elastic-net coefficients: ``mix`` of the penalty on absolute values, the rest on squares.

    Coordinate descent on the sums: a sweep costs (columns)**2, whatever the row count.
    """
    s = _standardised(g, use)
    lasso, ridge = reg * mix / s.y_std, reg * (1 - mix) / s.y_std
    beta = np.zeros(len(s.use))
    for _ in range(10_000):
        moved = 0.0
        for j in range(len(beta)):
            pull = s.corr_y[j] - s.corr[j] @ beta + s.corr[j, j] * beta[j]
            new = np.sign(pull) * max(abs(pull) - lasso, 0.0) / (s.corr[j, j] + ridge)
            moved, beta[j] = max(moved, abs(new - beta[j])), new
        if moved < tolerance:
            break
    return s.coefficients(beta, len(g))


def search(train: DataFrame, valid: DataFrame, columns: Sequence[str], seed: int = 42,
           regs: Sequence[float] = (0.001, 0.1, 1.0), mixes: Sequence[float] = (0.0, 0.5)) -> list[dict]:
    """Validation RMSE of every (reg, mix) on a fixed split, best first, from one pass over both tables."""
    both = train.withColumn("_group", F.lit(0)).withColumn("_w", seed_weights(seed)).unionByName(
        valid.withColumn("_group", F.lit(1)).withColumn("_w", F.lit(1.0)))
    fit, check = matrices(both, columns, ["_w"], 2)[0]
    out = []
    for reg in regs:
        for mix in mixes:
            c = np.append(solve_elastic(fit, range(1, len(columns) + 1), reg, mix), -1.0)
            out.append({"reg": float(reg), "mix": float(mix), "val_rmse": float(np.sqrt(max(c @ check @ c, 0.0) / check[0, 0]))})
    return sorted(out, key=lambda r: r["val_rmse"])


def fit_huber(train: DataFrame, columns: Sequence[str], delta: float = HUBER_DELTA, seed: int = 42,
              iterations: int = 100, tolerance: float = 1e-7) -> LinearModel:
    """Least Huber loss of the given ``delta``, in label units, by reweighted least squares.

    One aggregate per iteration; the fit stops when no prediction at one deviation from the
    mean of a column moves by ``tolerance``. ``train`` is read once per iteration: pass a
    written table.
    """
    rows = train.withColumn("_group", F.lit(0)).withColumn("_w", seed_weights(seed))
    use = range(1, len(columns) + 1)
    model = None
    for _ in range(iterations):
        g = matrices(rows, columns, ["_w"], 1, model, delta)[0, 0]
        coef = solve(g, use, 0.0)
        old, model = model, LinearModel(tuple(columns), tuple(float(x) for x in coef[1:]), float(coef[0]))
        if old and np.abs((coef[1:] - old.weights) * _standardised(g, use).std).max() < tolerance:
            break
    return model


def loss_gradient(rows: DataFrame, model: LinearModel, seed: int = 42, delta: float | None = None) -> DataFrame:
    """(term, gradient): the weighted mean pull of the residuals on each term of a fit.

    Residuals are clipped at ``delta`` (the Huber loss) or not at all (squared error), and
    terms centered and scaled; without penalty every pull is 0 at the least loss.
    """
    e = F.col(LABEL) - model.column()
    pull = e if delta is None else F.greatest(F.lit(-delta), F.least(F.lit(delta), e))
    d = rows.select(*[F.col(c).cast("double").alias(c) for c in model.columns], pull.alias("_e"), seed_weights(seed).alias("_w"))
    sums = d.agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_e")).alias("e"),
                 *[F.sum(F.col("_w") * F.col("_e") * F.col(c)).alias(f"g_{c}") for c in model.columns],
                 *[F.sum(F.col("_w") * F.col(c)).alias(f"m_{c}") for c in model.columns],
                 *[F.stddev_pop(c).alias(f"s_{c}") for c in model.columns])
    n, own = F.col("n"), F.col("e")
    each = [F.struct(F.lit("intercept").alias("term"), (own / n).alias("gradient"))] + [
        F.struct(F.lit(c).alias("term"), ((F.col(f"g_{c}") - own * F.col(f"m_{c}") / n) / n / F.col(f"s_{c}")).alias("gradient")) for c in model.columns]
    return sums.select(F.explode(F.array(*each)).alias("x")).select("x.term", "x.gradient")


def fit_linear_grid(train: DataFrame, jobs: Sequence[tuple[str, int]] | None = None, folds: int = 3,
                    reg: float = 1e-3, suffix: str = "_mean") -> dict[tuple[str, int], LinearModel]:
    jobs = list(jobs or run_grid())
    columns = [f"{c}{suffix}" for c in CHANNELS]
    at = {c: i + 1 for i, c in enumerate(columns)}
    sums = product_sums(train, columns, sorted({s for _, s in jobs}, key=SEEDS.index), folds)
    models = {}
    for variant, seed in jobs:
        parts = [sums[(seed, k)] for k in range(folds)]
        total = sum(parts)
        if variant != "late":
            coef = solve(total, [at[c] for c in feature_columns(variant, (suffix,))], reg)
        else:
            sensors = [[at[f"{c}{suffix}"] for c in chans] for chans in LateFusion.SENSORS.values()]
            stage = np.zeros((len(sensors) + 2,) * 2)
            for k in range(folds):
                # Held-out predictions are linear in the columns, so their product sums are too.
                rows = [np.eye(total.shape[0])[0]]
                rows += [np.append(solve(total - parts[k], use, reg), 0.0) for use in sensors]
                rows.append(np.eye(total.shape[0])[-1])
                t = np.vstack(rows)
                stage += t @ parts[k] @ t.T
            top = solve(stage, range(1, len(sensors) + 1), reg)
            coef = sum(b * solve(total, use, reg) for b, use in zip(top[1:], sensors))
            coef[0] += top[0]
        models[(variant, seed)] = LinearModel(tuple(columns), tuple(float(x) for x in coef[1:]), float(coef[0]))
    return models


def score_grid(models: dict[tuple[str, int], LinearModel], test: DataFrame) -> DataFrame:
    """Long prediction table of all models in one pass over the test table."""
    each = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(s).alias("seed"),
                              m.column().cast("float").alias("pred_agbd")) for (v, s), m in models.items()])
    return test.select("patch_id", F.col(LABEL).cast("float").alias("true_agbd"), F.explode(each).alias("x")).select(
        "patch_id", "x.variant", "x.seed", "true_agbd", "x.pred_agbd")
