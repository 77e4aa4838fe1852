"""Modelling queries: one plan from shots to features, split, fits, scores and metrics.

The checking SQL builds the same features, solves the normal equations by elimination and scores
row by row; nothing is taken from the fitted models.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..constants import CHANNELS, HUBER_DELTA, SEEDS, VARIANT_CHANNELS, VARIANT_ORDER
from ..operators import fusion, metrics, modelling
from ..session import materialize
from .q_raster import HALF
from .q_shots import SPLIT_SQL, assigned
from .registry import query, r, rounded

REG, FOLDS = 1e-3, 3
TRAIN, VALID, TEST = 0, 1, 2
COLUMNS = modelling.feature_columns("early")


def features(t):
    """Thinned shots of the block split with the window means of every channel, written once."""
    shots = assigned(t).select("shot_number", "block_id", "split", "agbd")
    points = t.fx_points.select("shot_number", "crow", "ccol").join(shots, "shot_number").select(
        F.col("shot_number").alias("patch_id"), "block_id", "split", F.col("agbd").alias("label"), "crow", "ccol")
    return materialize(modelling.window_features(points, t.fx_channels, CHANNELS, HALF).drop("crow", "ccol"))


def part(d, split):
    return d.where(F.col("split") == split).drop("split")


FEATURES_SQL = f"""{SPLIT_SQL}, feat AS (SELECT a.shot_number AS patch_id, a.block_id, a.split, a.agbd AS label,
  {", ".join(f"AVG(g.{c}) AS {c}" for c in CHANNELS)}
  FROM assigned a JOIN fx_points p ON p.shot_number = a.shot_number
  JOIN fx_channels g ON g.row_ BETWEEN p.crow - {HALF} AND p.crow + {HALF} AND g.col_ BETWEEN p.ccol - {HALF} AND p.ccol + {HALF}
  GROUP BY a.shot_number, a.block_id, a.split, a.agbd),
long AS (SELECT patch_id, block_id, split, label, UNNEST(RANGE(1, {len(CHANNELS) + 1})) AS i, UNNEST([{", ".join(CHANNELS)}]) AS v FROM feat)"""


def number_sql(seed, ident):
    return f"CAST('0x' || SUBSTR(MD5('{seed}|' || CAST({ident} AS VARCHAR)), 1, 8) AS BIGINT)"


def weight_sql(seed, ident="patch_id"):
    return f"-LN(({number_sql(seed, ident)} + 0.5e0) / 4294967296e0)"


FOLD_SQL = f"{number_sql(0, 'block_id')} % {FOLDS}"


def fit_sql(name, source, reg=f"{REG!r}"):
    """Tables that solve a ridge regression per ``model`` of ``source`` (model, row, w, i, v; i = 0 is the label).

    ``{name}`` holds (model, i, beta), i = 0 being the intercept.
    """
    return f"""{name}_mu AS (SELECT model, i, SUM(w * v) / SUM(w) AS mu FROM {source} GROUP BY model, i),
{name}_c AS (SELECT s.model, s.row, s.w, s.i, s.v - u.mu AS v FROM {source} s JOIN {name}_mu u ON u.model = s.model AND u.i = s.i),
{name}_var AS (SELECT model, i, SUM(w * v * v) / SUM(w) AS c FROM {name}_c GROUP BY model, i),
{name}_cov AS (SELECT a.model, a.i, b.i AS j, SUM(a.w * a.v * b.v) / SUM(a.w) AS c FROM {name}_c a JOIN {name}_c b
  ON a.model = b.model AND a.row = b.row WHERE a.i > 0 GROUP BY a.model, a.i, b.i),
{name}_row AS (SELECT c.model, c.i, LIST(c.c / SQRT(a.c * b.c) + CASE WHEN c.i = c.j THEN {reg} / SQRT(y.c) ELSE 0e0 END
    ORDER BY CASE WHEN c.j = 0 THEN 1000 ELSE c.j END) AS r
  FROM {name}_cov c JOIN {name}_var a ON a.model = c.model AND a.i = c.i JOIN {name}_var b ON b.model = c.model AND b.i = c.j
  JOIN {name}_var y ON y.model = c.model AND y.i = 0 GROUP BY c.model, c.i),
{name}_gj(model, k, m) AS (SELECT model, 1, LIST(r ORDER BY i) FROM {name}_row GROUP BY model
  UNION ALL SELECT model, k + 1, LIST_TRANSFORM(m, lambda x, p: CASE WHEN p = k THEN LIST_TRANSFORM(x, lambda y: y / m[k][k])
    ELSE LIST_TRANSFORM(x, lambda y, q: y - x[k] * m[k][q] / m[k][k]) END) FROM {name}_gj WHERE k <= LEN(m)),
{name}_at AS (SELECT model, i, ROW_NUMBER() OVER (PARTITION BY model ORDER BY i) AS p FROM {name}_var WHERE i > 0),
{name}_slope AS (SELECT t.model, t.i, g.m[t.p][LEN(g.m) + 1] * SQRT(y.c / a.c) AS beta FROM {name}_at t
  JOIN {name}_gj g ON g.model = t.model AND g.k = LEN(g.m) + 1 JOIN {name}_var a ON a.model = t.model AND a.i = t.i
  JOIN {name}_var y ON y.model = t.model AND y.i = 0),
{name} AS (SELECT model, i, beta FROM {name}_slope UNION ALL
  SELECT u.model, 0, MIN(u.mu) - SUM(s.beta * m.mu) FROM {name}_mu u JOIN {name}_slope s ON s.model = u.model
  JOIN {name}_mu m ON m.model = s.model AND m.i = s.i WHERE u.i = 0 GROUP BY u.model)"""


def rows_sql(model, where, weight, positions=None):
    """Feature and label rows of one model's fit."""
    use = f" AND i IN ({', '.join(map(str, positions))})" if positions else ""
    return (f"SELECT {model} AS model, patch_id AS row, {weight} AS w, i, v FROM long WHERE {where}{use} "
            f"UNION ALL SELECT {model}, patch_id, {weight}, 0, label FROM feat WHERE {where}")


def scores_sql(fit, where, columns="patch_id, label"):
    return f"""SELECT b.model, {', '.join('l.' + c.strip() for c in columns.split(','))}, SUM(CASE WHEN b.i = l.i THEN b.beta * l.v END) + MAX(CASE WHEN b.i = 0 THEN b.beta END) AS pred
  FROM {fit} b JOIN long l ON (l.i = b.i OR (b.i = 0 AND l.i = 1)) WHERE {where} GROUP BY b.model, {', '.join('l.' + c.strip() for c in columns.split(','))}"""


def positions(channels):
    return [CHANNELS.index(c) + 1 for c in channels]


SENSORS = {s: positions(c) for s, c in modelling.LateFusion.SENSORS.items()}


def single_sql(jobs):
    """Table ``single`` (variant, seed, patch_id, label, pred) over the test rows, for variants of one model."""
    source = " UNION ALL ".join(rows_sql(f"'{v}|{s}'", "split = 0", weight_sql(s), positions(VARIANT_CHANNELS[v])) for v, s in jobs)
    return f"""one_rows AS ({source}), {fit_sql("one", "one_rows")},
single AS (SELECT SPLIT_PART(model, '|', 1) AS variant, CAST(SPLIT_PART(model, '|', 2) AS INTEGER) AS seed, patch_id, label, pred FROM ({scores_sql("one", "split = 2")}) q)"""


def late_sql(seeds):
    """Table ``late`` likewise: sensor models without each fold, their scores of that fold, and a second stage fitted to them."""
    source, held = [], []
    for s in seeds:
        for sensor, use in SENSORS.items():
            source.append(rows_sql(f"'{sensor}|{s}|all'", "split = 0", weight_sql(s), use))
            source += [rows_sql(f"'{sensor}|{s}|{k}'", f"split = 0 AND {FOLD_SQL} <> {k}", weight_sql(s), use) for k in range(FOLDS)]
    place = "CASE SPLIT_PART(model, '|', 1) " + " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(SENSORS)) + " END"
    weight = "CASE SPLIT_PART(model, '|', 2) " + " ".join(f"WHEN '{s}' THEN {weight_sql(s)}" for s in seeds) + " END"
    return f"""sensor_rows AS ({" UNION ALL ".join(source)}), {fit_sql("sensor", "sensor_rows")},
held AS ({scores_sql("sensor", "split = 0", "patch_id, label, block_id")}),
out_of_fold AS (SELECT * FROM held WHERE SPLIT_PART(model, '|', 3) = CAST({FOLD_SQL} AS VARCHAR)),
top_rows AS (SELECT SPLIT_PART(model, '|', 2) AS model, patch_id AS row, {weight} AS w, {place} AS i, pred AS v FROM out_of_fold
  UNION ALL SELECT DISTINCT SPLIT_PART(model, '|', 2), patch_id, {weight}, 0, label FROM out_of_fold), {fit_sql("top", "top_rows")},
parts AS ({scores_sql("sensor", "split = 2")}),
late AS (SELECT 'late' AS variant, CAST(t.model AS INTEGER) AS seed, patch_id, label,
    SUM(CASE WHEN t.i = {place.replace("model", "p.model")} THEN t.beta * pred END) + MAX(CASE WHEN t.i = 0 THEN t.beta END) AS pred
  FROM parts p JOIN top t ON t.model = SPLIT_PART(p.model, '|', 2) WHERE SPLIT_PART(p.model, '|', 3) = 'all' GROUP BY t.model, patch_id, label)"""


# Scores travel as 32-bit floats and count from 0 on, as in the prediction tables.
MEASURES_SQL = """m AS (SELECT variant, seed, COUNT(*) AS n, SQRT(AVG(e * e)) AS rmse, AVG(ABS(e)) AS mae, 1 - SUM(e * e) / (VAR_POP(y) * COUNT(*)) AS r2,
  AVG(e) AS bias, SQRT(AVG(e * e)) / AVG(y) * 100 AS rel_rmse_pct FROM (SELECT variant, seed, CAST(CAST(label AS FLOAT) AS DOUBLE) AS y,
  GREATEST(CAST(CAST(pred AS FLOAT) AS DOUBLE), 0e0) - CAST(CAST(label AS FLOAT) AS DOUBLE) AS e FROM scored) q GROUP BY variant, seed)"""
ONE_SQL = "SELECT variant, seed, n, " + ", ".join(f"ROUND({x}, 3) AS {x}" for x in metrics.MEASURES) + " FROM m"


def scored(t, jobs):
    d = features(t)
    return fusion.score_grid(fusion.fit_linear_grid(part(d, TRAIN), jobs, FOLDS, REG), part(d, TEST))


def measured(df):
    m = metrics.regression_metrics(df, ["variant", "seed"])
    return rounded(m.select("variant", "seed", "n", *metrics.MEASURES), metrics.MEASURES, 3)


@query("ml1_feature_sets", f"""WITH {FEATURES_SQL} SELECT f.variant, f.n AS n_features, COUNT(DISTINCT patch_id) AS n_rows,
  ROUND(SUM(v), 4) AS total, ROUND(SUM(v * label), 2) AS with_label
  FROM (VALUES {", ".join(f"('{v}', CAST({len(c)} AS BIGINT), {positions(c)})" for v, c in VARIANT_CHANNELS.items())}) f(variant, n, used)
  JOIN long ON LIST_CONTAINS(f.used, CAST(i AS INTEGER)) WHERE split = 2 GROUP BY f.variant, f.n""")
def ml1(t):
    d, out = part(features(t), TEST), None
    for v in VARIANT_ORDER:
        x = modelling.assembler(modelling.feature_columns(v)).transform(d).select("label", vector_to_array("features").alias("x"))
        total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
        row = x.agg(F.max(F.size("x")).cast("bigint").alias("n_features"), F.count(F.lit(1)).alias("n_rows"),
                    r(F.sum(total), 4).alias("total"), r(F.sum(total * F.col("label")), 2).alias("with_label")).select(F.lit(v).alias("variant"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("ml2_single_model", f"WITH RECURSIVE {FEATURES_SQL}, {single_sql([('s2_only', 42)])}, scored AS (SELECT * FROM single), {MEASURES_SQL} {ONE_SQL}")
def ml2(t):
    return measured(scored(t, [("s2_only", 42)]))


@query("ml3_late_fusion", f"WITH RECURSIVE {FEATURES_SQL}, {late_sql([42])}, scored AS (SELECT * FROM late), {MEASURES_SQL} {ONE_SQL}")
def ml3(t):
    return measured(scored(t, [("late", 42)]))


@query("ml4_robust_fit", f"""WITH {FEATURES_SQL} SELECT x.term, 0e0 AS gradient, (SELECT COUNT(*) FROM feat WHERE split = 0) AS n
FROM (VALUES ('intercept'), {", ".join(f"('{c}')" for c in modelling.feature_columns("s1_only"))}) x(term)""")
def ml4(t):
    """The Huber loss has no pull left on any term."""
    train, columns = part(features(t), TRAIN), modelling.feature_columns("s1_only")
    model = fusion.fit_huber(train, columns)
    n = train.agg(F.count(F.lit(1)).alias("n"))
    return fusion.loss_gradient(train, model, delta=HUBER_DELTA).select("term", (F.round("gradient", 5) + 0.0).alias("gradient")).crossJoin(F.broadcast(n))


GRID = [(v, s) for v in VARIANT_ORDER if v != "late" for s in SEEDS]


@query("ml5_variant_seed_grid", f"""WITH RECURSIVE {FEATURES_SQL}, {single_sql(GRID)}, {late_sql(SEEDS)},
scored AS (SELECT * FROM single UNION ALL SELECT * FROM late), {MEASURES_SQL}
SELECT variant, {", ".join(f"ROUND(AVG({x}), 3) AS {x}_mean, ROUND(STDDEV_SAMP({x}), 3) AS {x}_std" for x in metrics.MEASURES)},
  COUNT(*) AS n_seeds, MAX(n) AS n_patches FROM m GROUP BY variant""")
def ml5(t):
    return rounded(metrics.overall(scored(t, None)), [f"{m}_{s}" for m in metrics.MEASURES for s in ("mean", "std")], 3)


REGS, SWEEPS = (0.001, 0.1, 1.0), 80


@query("ml6_parameter_search", f"""WITH RECURSIVE {FEATURES_SQL}, search_rows AS ({rows_sql("'early'", "split = 0", weight_sql(42))}),
{fit_sql("plain", "search_rows")},
candidates(reg, mix) AS (VALUES {", ".join(f"({x!r}e0, {m}e0)" for x in REGS for m in (0.0, 0.5))}),
corr AS (SELECT LIST(x ORDER BY i) AS a, LIST(y ORDER BY i) AS b FROM (SELECT c.i, LIST(c.c / SQRT(a.c * b.c) ORDER BY c.j) FILTER (c.j > 0) AS x,
    MAX(c.c / SQRT(a.c * b.c)) FILTER (c.j = 0) AS y FROM plain_cov c JOIN plain_var a ON a.i = c.i JOIN plain_var b ON b.i = c.j GROUP BY c.i) q),
descent(reg, mix, k, beta) AS (SELECT reg, mix, 0, LIST_TRANSFORM(RANGE({len(CHANNELS)}), lambda z: 0e0) FROM candidates
  UNION ALL SELECT reg, mix, k + 1, LIST_TRANSFORM(beta, lambda z, p: CASE WHEN p <> k % {len(CHANNELS)} + 1 THEN z
      ELSE SIGN(pull) * GREATEST(ABS(pull) - reg * mix / sd, 0e0) / (1 + reg * (1 - mix) / sd) END)
    FROM (SELECT reg, mix, k, beta, SQRT(y.c) AS sd, b[k % {len(CHANNELS)} + 1] - LIST_DOT_PRODUCT(a[k % {len(CHANNELS)} + 1], beta) + beta[k % {len(CHANNELS)} + 1] AS pull
      FROM descent, corr, plain_var y WHERE y.i = 0 AND k < {len(CHANNELS) * SWEEPS}) q),
slopes AS (SELECT reg, mix, t.i, beta[t.p] * SQRT(y.c / a.c) AS beta FROM descent JOIN plain_at t ON TRUE JOIN plain_var a ON a.i = t.i
  JOIN plain_var y ON y.i = 0 WHERE k = {len(CHANNELS) * SWEEPS}),
errors AS (SELECT s.reg, s.mix, l.patch_id, l.label - u.mu - SUM(s.beta * (l.v - m.mu)) AS e FROM slopes s JOIN long l ON l.i = s.i
  JOIN plain_mu m ON m.i = s.i JOIN plain_mu u ON u.i = 0 WHERE l.split = 1 GROUP BY s.reg, s.mix, l.patch_id, l.label, u.mu)
SELECT reg, mix, ROUND(SQRT(AVG(e * e)), 3) AS val_rmse FROM errors GROUP BY reg, mix""")
def ml6(t):
    d = features(t)
    found = fusion.search(part(d, TRAIN), part(d, VALID), COLUMNS, regs=REGS)
    return t.spark.createDataFrame([(x["reg"], x["mix"], round(x["val_rmse"], 3)) for x in found], "reg DOUBLE, mix DOUBLE, val_rmse DOUBLE")


W, INTERCEPT = [0.5, -0.25, 0.125, 1.5, 0.75], 3.00000123  # no score lies between two roundings
F_SQL = " + ".join(f"{w!r} * AVG(g.{c})" for w, c in zip(W, VARIANT_CHANNELS["s1_only"]))


@query("scr1_batch_scoring", f"""SELECT p.shot_number AS patch_id, ROUND({INTERCEPT!r}e0 + {F_SQL}, 6) AS prediction FROM fx_points p
JOIN fx_channels g ON g.row_ BETWEEN p.crow - {HALF} AND p.crow + {HALF} AND g.col_ BETWEEN p.ccol - {HALF} AND p.ccol + {HALF}
GROUP BY p.shot_number""")
def scr1(t):
    """Every point's window features scored by a known linear model, in one projection."""
    d = modelling.window_features(t.fx_points, t.fx_channels, VARIANT_CHANNELS["s1_only"], HALF)
    model = fusion.LinearModel(tuple(modelling.feature_columns("s1_only")), tuple(W), INTERCEPT)
    return d.select(F.col("shot_number").alias("patch_id"), r(model.column(), 6).alias("prediction"))


@query("scr2_score_all", f"""WITH RECURSIVE {FEATURES_SQL}, {single_sql([j for j in modelling.map_jobs() if j[0] != "late"])}, {late_sql(SEEDS)},
scored AS (SELECT * FROM single UNION ALL SELECT * FROM late)
SELECT variant, seed, COUNT(*) AS n, ROUND(AVG(pred), 4) AS mean_pred, ROUND(STDDEV_POP(pred), 4) AS std_pred, ROUND(AVG(pred * label), 2) AS with_label
FROM scored GROUP BY variant, seed""")
def scr2(t):
    return scored(t, modelling.map_jobs()).groupBy("variant", "seed").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("pred_agbd"), 4).alias("mean_pred"), r(F.stddev_pop("pred_agbd"), 4).alias("std_pred"),
        r(F.avg(F.col("pred_agbd").cast("double") * F.col("true_agbd")), 2).alias("with_label"))
