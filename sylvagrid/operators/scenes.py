"""Scene selection, manifests and reconciliation with jobs, files and runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..constants import JOB_PREFIX
from ..functions.cleaning import nan_to_null
from ..functions.text import band_kind, run_name
from .ranking import pick_one


def seconds_from_mid_month(ts: Column) -> Column:
    """Signed seconds to the 15th, 00:00, of the same month."""
    # unix_micros needs a zoned timestamp; both operands get the session zone (UTC).
    mid = (F.date_trunc("month", ts) + F.make_dt_interval(days=F.lit(14))).cast("timestamp")
    return (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(mid)) / F.lit(1e6)


def nearest_to_mid_month(scenes: DataFrame, ts: str = "start", name: str = "scene_name",
                         keys: Sequence[str] = ()) -> DataFrame:
    """One scene per year and month: least distance to the 15th, then by name.

    ``days_from_15th`` floors the signed distance before taking its absolute value.
    """
    d = seconds_from_mid_month(F.col(ts))
    s = scenes.withColumns({"sel_year": F.year(ts), "sel_month": F.month(ts), "_d": d})
    best = pick_one(s, [*keys, "sel_year", "sel_month"], [F.abs(F.col("_d")), F.col(name)])
    return best.withColumn("days_from_15th", F.abs(F.floor(F.col("_d") / 86400)).cast("long")).drop("_d")


def manifest(selected: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per year: year key and map month -> scene (at most twelve entries)."""
    entry = F.struct(F.col("sel_month").cast("string").alias("k"), F.struct(*fields).alias("v"))
    return selected.groupBy(F.col("sel_year").cast("string").alias("year")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("months"))


def flatten_manifest(years: DataFrame, column: str = "years") -> DataFrame:
    """Nested year -> month -> scene map as rows."""
    y = years.select(F.explode(column).alias("year", "months"))
    m = y.select("year", F.explode("months").alias("month", "scene"))
    return m.select(F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"), "scene.*")


def manifest_summary(selected: DataFrame) -> DataFrame:
    """Scenes, size and orbit balance; whatever is not ascending counts as descending."""
    up = F.col("flight_direction") == "ASCENDING"
    return selected.agg(F.count(F.lit(1)).alias("n_scenes"), (F.sum("bytes") / 1e9).alias("total_gb"),
                        F.count_if(up).alias("n_ascending"),
                        F.count_if(~F.coalesce(up, F.lit(False))).alias("n_descending"))


def newest(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Newest row per key, the larger ``tie`` value where times are equal."""
    return pick_one(df, keys, [F.col(ts), F.col(tie)], largest=True)


def scene_files(files: DataFrame, scene: str = "scene_name", name: str = "file_name",
                size: str = "size") -> DataFrame:
    """What lies on disk per scene, from a file listing."""
    kind = band_kind(name)
    tif = F.lower(F.col(name)).endswith(".tif")
    return files.groupBy(scene).agg(
        F.count_if(tif).alias("n_tifs"),
        F.coalesce(F.bool_or(kind == "VV"), F.lit(False)).alias("has_vv"),
        F.coalesce(F.bool_or(kind == "VH"), F.lit(False)).alias("has_vh"),
        F.coalesce(F.bool_or(kind == "LIA"), F.lit(False)).alias("has_inc"),
        F.bool_or(F.lower(F.col(name)).endswith(".zip")).alias("has_zip"),
        F.round(F.sum(size) / 1e6, 1).alias("total_mb"))


def scene_status(scenes: DataFrame, jobs: DataFrame, files: DataFrame, prefix: str = JOB_PREFIX) -> DataFrame:
    """Each scene with its newest job, its files and one status.

    Only jobs whose name starts with ``prefix`` count, so that a newer job of another batch
    decides nothing. Jobs and files are reduced to one row per scene (combined map-side) before the joins.
    """
    own = jobs.where(F.col("name").startswith(prefix))
    job = newest(own.select("granule", "request_time", "job_id", "status_code"), ["granule"], "request_time", "job_id").select(
        F.col("granule").alias("scene_name"), "status_code")
    disk = scene_files(files).withColumn("on_disk", F.lit(True))
    j = scenes.join(job, "scene_name", "left").join(disk, "scene_name", "left")
    on_disk = F.coalesce("on_disk", F.lit(False))
    status = F.coalesce("status_code", F.lit("NONE"))
    category = (F.when(on_disk & F.col("has_vv") & F.col("has_vh"), "on_disk_complete")
                .when(on_disk, "on_disk_partial")
                .when(status.isin("PENDING", "RUNNING"), "running")
                .when(status == "SUCCEEDED", "succeeded_not_fetched")
                .when(status == "FAILED", "failed").otherwise("no_job"))
    return j.select(*scenes.columns, F.right("scene_name", F.lit(12)).alias("short_name"),
                    status.alias("job_status"), on_disk.alias("on_disk"),
                    F.coalesce("total_mb", F.lit(0.0)).alias("total_mb"), category.alias("category"))


CATEGORIES = ("on_disk_complete", "on_disk_partial", "running", "succeeded_not_fetched", "failed", "no_job")


def status_rollup(status: DataFrame) -> DataFrame:
    return status.agg(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])


def schedule(spark_df: DataFrame, variants: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Fixed variants x seeds run list, seed-major, with run names."""
    items = [(i, s, v) for i, (s, v) in enumerate([(s, v) for s in seeds for v in variants], start=1)]
    arr = F.array(*[F.struct(F.lit(i).alias("run_no"), F.lit(s).alias("seed"), F.lit(v).alias("variant"))
                    for i, s, v in items])
    return spark_df.sparkSession.range(1).select(F.explode(arr).alias("x")).select("x.*").withColumn(
        "name", run_name("variant", "seed"))


def run_status(plan: DataFrame, state: DataFrame, results: DataFrame) -> DataFrame:
    """Schedule with the orchestration state and the newest result of each run."""
    real = results.where(~F.col("is_sweep")).select("name", "created_at", "run_id", "run_state", "best_val_rmse")
    last = newest(real, ["name"], "created_at", "run_id")
    j = plan.join(state.select("name", "status"), "name", "left").join(
        last.select("name", "run_state", "best_val_rmse"), "name", "left")
    orch = F.coalesce("status", F.lit("pending"))
    run = F.coalesce("run_state", F.lit("-"))
    outcome = (F.when(F.col("best_val_rmse").isNotNull(), "done")
               .when((orch == "running") | (run == "running"), "running")
               .when(orch == "failed", "failed").otherwise("pending"))
    return j.select("run_no", "name", "variant", "seed", orch.alias("orch_status"), run.alias("run_state"),
                    "best_val_rmse", outcome.alias("outcome"))


def lookup_failures(failed: DataFrame, catalogue: DataFrame, key: str = "granule_ur") -> DataFrame:
    """Failed ids joined with the catalogue; ``found`` is FALSE for an unknown id."""
    c = catalogue.withColumn("_found", F.lit(True))
    return failed.join(c, key, "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def to_do(catalogue: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return catalogue.join(done.select(key), key, "left_anti")


def already_done(catalogue: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return catalogue.join(done.select(key), key, "left_semi")


# What a range of a run's epochs does to the state before it: per entry, the state at its end.
ENTRY = "score DOUBLE, skipped LONG, best DOUBLE, best_epoch LONG, waited LONG, stopped BOOLEAN, last LONG"


def epoch_ranges(log: DataFrame, patience: int, min_delta: float) -> DataFrame:
    """Per run and sorted range of its epochs: what the range does to any state that enters it.

    An entering state either improves within the range's first ``patience`` epochs or stops
    there, so a range is told by at most ``patience`` entries (epochs below all before them,
    each with the state at the end of the range if it is the first to improve) and the first
    ``patience`` epochs. A task goes through its rows once and holds no more than that.
    """
    once = log.where("epoch >= 1").groupBy("run", F.col("epoch").cast("long").alias("epoch")).agg(
        F.min(nan_to_null(F.col("val_rmse").cast("double"))).alias("score"))
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = once.repartitionByRange(parts, "run", "epoch").sortWithinPartitions("run", "epoch")
    schema = T.StructType([T.StructField("run", log.schema["run"].dataType), *T.StructType.fromDDL(
        f"place LONG, n LONG, epochs ARRAY<LONG>, entries ARRAY<STRUCT<{', '.join(x.replace(' ', ': ', 1) for x in ENTRY.split(', '))}>>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, like = TaskContext.get().partitionId(), to_arrow_schema(schema)
        now, n, epochs, entries, open_ = None, 0, [], [], False

        def summary(out: list) -> None:
            out.append({"run": now, "place": place, "n": n, "epochs": epochs, "entries": entries})

        for batch in batches:
            done: list[dict] = []
            for key, epoch, score in zip(*(batch[c].to_pylist() for c in ("run", "epoch", "score")), strict=True):
                if not open_ or key != now:
                    if open_:
                        summary(done)
                    open_, now, n, epochs, entries = True, key, 0, [], []
                for e in entries:
                    if e["stopped"]:
                        continue
                    e["last"] = epoch
                    if score is not None and score < e["best"] - min_delta:
                        e.update(best=score, best_epoch=epoch, waited=0)
                    else:
                        e["waited"] += 1
                        e["stopped"] = e["waited"] >= patience
                if len(epochs) < patience:
                    if score is not None and (not entries or score < entries[-1]["score"]):
                        entries.append({"score": score, "skipped": n, "best": score, "best_epoch": epoch, "waited": 0,
                                        "stopped": patience <= 0, "last": epoch})
                    epochs.append(epoch)
                n += 1
            yield pa.RecordBatch.from_pylist(done, schema=like)
        if open_:
            out: list[dict] = []
            summary(out)
            yield pa.RecordBatch.from_pylist(out, schema=like)

    return ordered.mapInArrow(run, schema)


def through(state: dict | None, part: dict, patience: int, min_delta: float) -> dict | None:
    """The state of a run after one more range of its epochs."""
    if state and state["stopped"]:
        return state
    left = patience - state["waited"] if state else patience
    for e in part["entries"]:
        if (state is None or e["score"] < state["best"] - min_delta) and e["skipped"] < left:
            return {k: e[k] for k in ("best", "best_epoch", "waited", "stopped", "last")}
    if state is None:
        state = {"best": None, "best_epoch": None, "waited": 0}
    if part["n"] >= left:
        return state | {"waited": patience, "stopped": True, "last": part["epochs"][left - 1]}
    return state | {"waited": state["waited"] + part["n"], "stopped": False, "last": part["epochs"][-1]}


def best_epochs(log: DataFrame, patience: int, min_delta: float) -> DataFrame:
    """Early stopping replayed per run: best epoch, best score and the last epoch trained.

    Each epoch of a run counts once, a repeated log line by its lowest score. An epoch
    without a score improves nothing; one with a score improves when it beats the best so far by more than ``min_delta``; patience alone ends a
    run. Epochs are folded in sorted ranges and the ranges of a run in order, so no run is
    ever in one place, however long its log.
    """
    if patience < 1:
        raise ValueError("patience must be at least 1")
    schema = T.StructType([T.StructField("run", log.schema["run"].dataType), *T.StructType.fromDDL(
        "best_epoch LONG, best_rmse DOUBLE, last_epoch LONG")])

    def fold(table: pa.Table) -> pa.Table:
        state = None
        for part in sorted(table.to_pylist(), key=lambda p: p["place"]):
            state = through(state, part, patience, min_delta)
        row = {"run": table["run"][0].as_py(), "best_epoch": state["best_epoch"], "best_rmse": state["best"], "last_epoch": state["last"]}
        return pa.Table.from_pylist([row], schema=to_arrow_schema(schema))

    return epoch_ranges(log, patience, min_delta).groupBy("run").applyInArrow(fold, schema)
