"""Regression metrics: overall, per label bin, per land cover, mean and spread over seeds.

All metrics come from sums, so every group is combined map-side and a group that holds
a third of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (HUBER_DELTA, LABEL_BINS, LANDCOVER_STRATA, PRODUCT_BINS,
                         REPORTED_LANDCOVER, VARIANT_LABELS, VARIANT_ORDER)
from ..functions.cleaning import clip
from ..functions.sensors import huber
from ..functions.text import lookup, plus_minus
from .sizing import looked_up

MEASURES = ("rmse", "mae", "r2", "bias", "rel_rmse_pct")


def scored_pair(truth: str = "true_agbd", pred: str = "pred_agbd") -> tuple[Column, Column]:
    """Label and clipped prediction, both NULL unless both are numbers."""
    y, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    both = y.isNotNull() & p.isNotNull() & ~F.isnan(y) & ~F.isnan(p)
    return F.when(both, y), F.when(both, clip(p, low=0.0))


FLAT = 1e-12  # a variance below this share of the mean square is rounding: the truth is constant and R2 undefined


def regression_aggregates(truth: str = "true_agbd", pred: str = "pred_agbd") -> list[Column]:
    """n and the five measures; predictions are clipped at 0, undefined values are NULL.

    A row without label or prediction (NULL or NaN) counts nowhere, n included.
    """
    y, p = scored_pair(truth, pred)
    e = p - y
    spread = F.var_pop(y) * F.count(y)
    total = F.when(spread > F.lit(FLAT) * F.sum(y * y), spread)
    rmse = F.sqrt(F.avg(e * e))
    return [
        F.count(y).alias("n"),
        rmse.alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(total > 0, 1 - F.sum(e * e) / total).alias("r2"),
        F.avg(e).alias("bias"),
        F.when(F.avg(y) > 0, rmse / F.avg(y) * 100).alias("rel_rmse_pct"),
    ]


def regression_metrics(df: DataFrame, keys: Sequence[str] = (), truth: str = "true_agbd",
                       pred: str = "pred_agbd") -> DataFrame:
    return df.groupBy(*keys).agg(*regression_aggregates(truth, pred))


def running_sums(df: DataFrame, keys: Sequence[str] = (), truth: str = "true_agbd",
                 pred: str = "pred_agbd") -> DataFrame:
    """The nine mergeable sums; partial tables can be added up at any time."""
    y, p = scored_pair(truth, pred)
    e = p - y
    return df.groupBy(*keys).agg(
        F.count(y).alias("n"), F.sum(y).alias("sum_y"), F.sum(p).alias("sum_p"),
        F.sum(y * y).alias("sum_yy"), F.sum(p * p).alias("sum_pp"), F.sum(y * p).alias("sum_yp"),
        F.sum(F.abs(e)).alias("sum_abs"), F.sum(e * e).alias("sum_sq"), F.sum(e).alias("sum_err"))


SUMS = ("n", "sum_y", "sum_p", "sum_yy", "sum_pp", "sum_yp", "sum_abs", "sum_sq", "sum_err")


def merge_sums(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in SUMS])


def metrics_from_sums(df: DataFrame) -> DataFrame:
    """Measures from the nine sums (population variance from moments).

    A variance below the rounding error of the moments is the variance of a constant.
    """
    n = F.col("n")
    mean = F.try_divide(F.col("sum_y"), n)
    spread = (F.try_divide(F.col("sum_yy"), n) - mean * mean) * n
    total = F.when(spread > F.lit(FLAT) * F.col("sum_yy"), spread)
    rmse = F.sqrt(F.try_divide(F.col("sum_sq"), n))
    keys = [c for c in df.columns if c not in SUMS]
    return df.select(
        *keys, "n", rmse.alias("rmse"), F.try_divide("sum_abs", n).alias("mae"),
        F.when(total > 0, 1 - F.col("sum_sq") / total).alias("r2"),
        F.try_divide("sum_err", n).alias("bias"),
        F.when(mean > 0, rmse / mean * 100).alias("rel_rmse_pct"))


def seed_spread(per_seed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over seeds (0 for one seed); patches of the lowest seed."""
    aggs = []
    for m in MEASURES:
        aggs.append(F.avg(m).alias(f"{m}_mean"))
        aggs.append(F.when(F.count(F.lit(1)) == 1, F.lit(0.0)).otherwise(F.stddev_samp(m)).alias(f"{m}_std"))
    return per_seed.groupBy(*keys).agg(
        *aggs, F.count("seed").alias("n_seeds"),
        F.coalesce(F.min_by("n", "seed"), F.lit(0)).cast("long").alias("n_patches"))


def label_bin(value: Column | str, edges: Sequence[int], prefix: str = "") -> Column:
    """Right-open bin label; NULL below the first and from the last edge on."""
    v = F.col(value) if isinstance(value, str) else value
    out = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        c = (v >= lo) & (v < hi)
        label = f"{prefix}{lo}-{hi}"
        out = F.when(c, label) if out is None else out.when(c, label)
    return out


def bin_labels(edges: Sequence[int], prefix: str = "") -> list[str]:
    return [f"{prefix}{lo}-{hi}" for lo, hi in zip(edges[:-1], edges[1:])]


def _values(df: DataFrame, name: str, items: Sequence[str]) -> DataFrame:
    """One-column table of fixed values."""
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(i) for i in items])).alias(name))


def dense_spread(sums: DataFrame, strata: Sequence[tuple[str, str | None, Sequence[str]]],
                 variants: Sequence[str] = VARIANT_ORDER) -> DataFrame:
    """Every variant x stratum, also empty ones; each seed of a variant counts in all strata.

    ``sums`` holds the nine sums per (variant, seed, strata columns), some hundreds of
    rows, and ``strata`` lists (report, column or None for all rows, labels). Each row is
    offered to every label and adds its sums where it matches and nothing elsewhere, so the
    result is dense without joining the table to itself.
    """
    labels = [(rep, col, lab) for rep, col, labs in strata for lab in labs]
    offers = F.array(*[F.struct(
        F.lit(rep).alias("report"), F.lit(lab).alias("stratum"),
        (F.coalesce(F.col(col) == lab, F.lit(False)) if col else F.lit(True)).alias("hit"))
        for rep, col, lab in labels])
    unlisted = F.when(~F.col("variant").isin(*variants), F.raise_error(F.concat(F.lit("not a listed variant: "), "variant")))
    offered = sums.where(unlisted.isNull()).select("variant", "seed", *SUMS, F.explode(offers).alias("x"))
    per_seed = metrics_from_sums(offered.groupBy("variant", "seed", "x.report", "x.stratum").agg(
        *[F.coalesce(F.sum(F.when(F.col("x.hit"), F.col(s))), F.lit(0)).alias(s) for s in SUMS]))
    spread = seed_spread(per_seed, ["variant", "report", "stratum"])
    dims = sums.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(v).alias("variant"), F.lit(rep).alias("report"), F.lit(lab).alias("stratum"))
        for v in variants for rep, _, lab in labels])).alias("d")).select("d.*")
    # A variant without any seed: no means, no spread.
    fill = {f"{m}_std": F.when(F.col("n_seeds").isNull(), F.lit(0.0)).otherwise(F.col(f"{m}_std")) for m in MEASURES}
    # At most one row per fixed variant and label.
    return (dims.join(F.broadcast(spread), ["variant", "report", "stratum"], "left").withColumns(fill)
            .withColumns({"n_seeds": F.coalesce("n_seeds", F.lit(0)), "n_patches": F.coalesce("n_patches", F.lit(0))}))


def overall(preds: DataFrame) -> DataFrame:
    return seed_spread(regression_metrics(preds, ["variant", "seed"]), ["variant"])


def by_label_bin(preds: DataFrame, edges: Sequence[int] = LABEL_BINS) -> DataFrame:
    binned = preds.withColumn("agbd_bin", label_bin("true_agbd", edges))
    sums = running_sums(binned, ["variant", "seed", "agbd_bin"])
    return dense_spread(sums, [("agbd_bin", "agbd_bin", bin_labels(edges))]).drop("report").withColumnRenamed(
        "stratum", "agbd_bin")


def with_landcover(preds: DataFrame, landcover: DataFrame) -> DataFrame:
    """Left join on the patch; the reported class is NULL for a patch without one.

    The land cover table grows with the patches, so it is never broadcast.
    """
    named = landcover.select("patch_id", lookup(F.col("lc_class").cast("int"), REPORTED_LANDCOVER,
                                                "other").alias("landcover"))
    return looked_up(preds, named, "patch_id")


def by_landcover(preds: DataFrame, landcover: DataFrame) -> DataFrame:
    sums = running_sums(with_landcover(preds, landcover), ["variant", "seed", "landcover"])
    return dense_spread(sums, [("landcover", "landcover", LANDCOVER_STRATA)]).drop("report").withColumnRenamed(
        "stratum", "landcover")


def metric_report(preds: DataFrame, landcover: DataFrame, edges: Sequence[int] = LABEL_BINS) -> DataFrame:
    """Overall, per bin and per class in one scan and one join: (report, variant, stratum, ...).

    The only pass over the predictions yields one set of sums per (variant, seed, bin,
    class); the three tables are groupings of those few rows.
    """
    tagged = with_landcover(preds, landcover).withColumn("agbd_bin", label_bin("true_agbd", edges))
    sums = running_sums(tagged, ["variant", "seed", "agbd_bin", "landcover"])
    return dense_spread(sums, [("overall", None, ("all",)), ("agbd_bin", "agbd_bin", bin_labels(edges)),
                               ("landcover", "landcover", LANDCOVER_STRATA)])


def mean_huber(df: DataFrame, keys: Sequence[str] = (), delta: float = HUBER_DELTA,
               truth: str = "true_agbd", pred: str = "pred_agbd") -> DataFrame:
    y, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    error = p - y
    loss = huber(F.when(~F.isnan(error), error), delta)
    return df.groupBy(*keys).agg(F.avg(loss).alias("huber_mean"), F.sum(loss).alias("huber_sum"))


def agreement_aggregates(ours: str, theirs: str) -> list[Column]:
    e = F.col(ours) - F.col(theirs)
    n = F.count(F.lit(1))
    return [n.alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
            F.avg(e).alias("bias"), F.when(n > 1, F.corr(ours, theirs)).alias("corr"),
            F.avg(ours).alias("our_mean"), F.avg(theirs).alias("ref_mean")]


def agreement(df: DataFrame, ours: str, theirs: str) -> DataFrame:
    return df.agg(*agreement_aggregates(ours, theirs))


def agreement_by_bin(df: DataFrame, ours: str, theirs: str,
                     edges: Sequence[int] = PRODUCT_BINS) -> DataFrame:
    """Overall row and one row per bin of the other product, empty bins included.

    A value beyond the last edge counts in the overall row only.
    """
    binned = df.select(ours, theirs, label_bin(theirs, edges, "ref_").alias("bin"))
    sets = binned.groupingSets([[], [F.col("bin")]], "bin").agg(
        F.grouping("bin").alias("_all"), *agreement_aggregates(ours, theirs))
    rows = sets.where((F.col("_all") == 1) | F.col("bin").isNotNull()).withColumn(
        "stratum", F.when(F.col("_all") == 1, "overall").otherwise(F.col("bin"))).drop("_all", "bin")
    strata = _values(df, "stratum", ["overall", *bin_labels(edges, "ref_")])
    return strata.join(rows, "stratum", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.count(F.lit(1)).alias("n"))


def spread_table(dense: DataFrame, stratum: str, strata: Sequence[str], digits: int = 2) -> DataFrame:
    """Variants down, strata across, 'mean +/- std' cells, then a row of patch counts."""
    cell = F.concat(F.format_string(f"%.{digits}f", "rmse_mean"), F.lit(" +/- "),
                    F.format_string(f"%.{digits}f", "rmse_std"))
    cells = dense.select(F.col("variant"), stratum, cell.alias("cell"))
    body = cells.groupBy("variant").pivot(stratum, list(strata)).agg(F.first("cell"))
    body = body.withColumn("label", lookup("variant", VARIANT_LABELS, F.col("variant")))
    counts = (dense.where(F.col("variant") == VARIANT_ORDER[0])
              .select(F.concat(F.lit("n="), F.format_number("n_patches", 0)).alias("cell"), stratum)
              .groupBy().pivot(stratum, list(strata)).agg(F.first("cell"))
              .withColumn("label", F.lit("Patches")))
    return body.drop("variant").unionByName(counts).select("label", *strata)


def overall_table(table: DataFrame) -> DataFrame:
    return table.select(
        lookup("variant", VARIANT_LABELS, F.col("variant")).alias("label"),
        plus_minus("rmse_mean", "rmse_std").alias("rmse"), plus_minus("mae_mean", "mae_std").alias("mae"),
        F.format_string("%.3f", "r2_mean").alias("r2"),
        F.format_string("%+.3f +/- %.3f", "bias_mean", "bias_std").alias("bias"),
        F.array_position(F.array(*[F.lit(v) for v in VARIANT_ORDER]), F.col("variant")).alias("position"))


def score_summary(scores: DataFrame, by: str, score: str) -> DataFrame:
    """Mean and sample deviation of a best score; no deviation for a single run."""
    return scores.groupBy(by).agg(
        F.count(score).alias("n_runs"), F.avg(score).alias("mean_score"),
        F.stddev_samp(score).alias("std_score"))


def require_same_count(left: DataFrame, right: DataFrame, what: str) -> DataFrame:
    """One row with both counts; an error when they differ."""
    a = left.agg(F.count(F.lit(1)).alias("n_left"))
    b = right.agg(F.count(F.lit(1)).alias("n_right"))
    both = a.crossJoin(F.broadcast(b))
    check = F.when(F.col("n_left") == F.col("n_right"), F.lit(True)).otherwise(
        F.raise_error(F.lit(f"row counts differ: {what}")).cast("boolean"))
    return both.withColumn("equal", check)
