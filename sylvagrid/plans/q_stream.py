"""Streaming queries: the events table arrives as a stream of files, in several runs where a run matters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..schemas import EVENTS
from ..session import scratch_path
from ..streaming import ingest
from .registry import query, rounded


RUNS = 3


def stream(t, folder=None, files_per_batch=None):
    s = ingest.file_stream(t.spark, folder or t.folder, EVENTS, "*.parquet" if folder else "events.parquet", files_per_batch)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def share(run):
    """The events that arrive before a run: by id, so that runs overlap in time."""
    return F.pmod("event_id", F.lit(RUNS)) == run


ACCEPT_SQL = "value >= 10 AND event_type <> 'error'"


def accept():
    return (F.col("value") >= 10) & ~F.isnan("value") & (F.col("event_type") != "error")


@query("str1_incremental_ingest", f"""SELECT event_id % {RUNS} AS run, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total,
  CAST(2 AS BIGINT) AS batches FROM events WHERE {ACCEPT_SQL} GROUP BY 1, 2""")
def str1(t):
    src, out, ck = (scratch_path(t.spark, x) for x in ("arrivals", "ingest", "ck"))
    batches = []
    for run in range(RUNS):
        ingest.land(t.base("events").where(share(run)), src, files=2)
        batches.append(len(ingest.ingest(stream(t, src, files_per_batch=1), accept(), out, ck)))
        ingest.ingest(stream(t, src, files_per_batch=1), accept(), out, ck)  # a rerun without arrivals finds nothing new
    run = F.pmod("event_id", F.lit(RUNS)).alias("run")
    return t.spark.read.parquet(out).groupBy(run, "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).withColumn(
        "batches", F.element_at(F.array(*[F.lit(b).cast("bigint") for b in batches]), (F.col("run") + 1).cast("int")))


@query("str2_running_metrics", """SELECT event_type, COUNT(*) AS n, ROUND(SQRT(AVG(e * e)), 6) AS rmse, ROUND(AVG(ABS(e)), 6) AS mae,
  ROUND(1 - SUM(e * e) / (VAR_POP(y) * COUNT(*)), 6) AS r2, ROUND(AVG(e), 6) AS bias,
  ROUND(SQRT(AVG(e * e)) / AVG(y) * 100, 6) AS rel_rmse_pct FROM (
  SELECT event_type, value AS y, GREATEST(value * 0.8e0 - 3e0, 0e0) - value AS e FROM events) q GROUP BY 1""")
def str2(t):
    src, out, ck = (scratch_path(t.spark, x) for x in ("arrivals", "metrics", "ck"))
    broken = [2]  # batches whose publication fails, once

    def publish(batch):
        if batch in broken:
            broken.remove(batch)
            raise ConnectionError("the reader of the results is away")

    def run():
        s = stream(t, src, files_per_batch=1).withColumns({"true_agbd": F.col("value"), "pred_agbd": F.col("value") * 0.8 - 3.0})
        return ingest.running_metrics(s, ["event_type"], out, ck, publish)

    # Four files, a batch each; the third batch is done, fails to be published, and is repeated after the restart.
    ingest.land(t.base("events").where(~share(2)), src, files=3)
    ingest.resumed(run)
    ingest.land(t.base("events").where(share(2)), src, files=1)
    ingest.resumed(run)
    return rounded(metrics.metrics_from_sums(ingest.latest_batch(t.spark, out)), metrics.MEASURES)


@query("str3_windowed_coverage", """WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS s, COUNT(*) AS n,
    COUNT(*) FILTER (EXTRACT(MONTH FROM ts) BETWEEN 4 AND 9) AS n_growing FROM events GROUP BY 1)
SELECT CAST(s AS DATE) AS day, n, n_growing FROM w WHERE s + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 6 HOUR""")
def str3(t):
    out, ck = scratch_path(t.spark, "windows"), scratch_path(t.spark, "ck")
    # Append mode: a window is written once the watermark has passed its end.
    ingest.drain(ingest.windowed_counts(stream(t), "ts", "1 day", "6 hours"), out, ck)
    return t.spark.read.schema("start TIMESTAMP, n LONG, n_growing LONG").parquet(out).select(
        F.to_date("start").alias("day"), "n", "n_growing")


@query("str4_retry_failures", """SELECT CASE WHEN value >= 20 AND event_type <> 'error' THEN 'good'
  WHEN value >= 5 THEN 'recovered' ELSE 'still_failed' END AS outcome, COUNT(*) AS n FROM events GROUP BY 1""")
def str4(t):
    good, bad, ck = (scratch_path(t.spark, x) for x in ("good", "bad", "ck"))
    checks = {"small": F.col("value") >= 20, "error": F.col("event_type") != "error"}
    ingest.quarantine(stream(t), checks, good, bad, ck)
    recovered, still = ingest.retry(t.spark.read.parquet(bad), t.events, "event_id", F.col("value") >= 5)
    parts = {"good": t.spark.read.parquet(good), "recovered": recovered, "still_failed": still}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("outcome"), "n")
        out = row if out is None else out.unionByName(row)
    return out


DELAY_HOURS = 48
# Deliveries: every event in one of four runs by its time, and once more in the next run: sent again as it was, or measured again
# and dated some hours later. A repeat survives if the watermark that the runs before it left has passed its first row's expiry
# but not its own time.
PARTS, LATER_HOURS = 4, 24 * 12
PART_SQL = f"""span AS (SELECT MIN(ts) AS t0, MAX(ts) AS t1 FROM events),
original AS (SELECT event_id, ts, event_type, LEAST({PARTS - 1}, CAST(FLOOR({PARTS} * (EPOCH_US(ts) - EPOCH_US(t0)) / (EPOCH_US(t1) - EPOCH_US(t0) + 1e0)) AS BIGINT)) AS run
  FROM events, span)"""


def deliveries(t):
    """(event_id, ts, event_type, run, again): what arrives before each run."""
    e = t.base("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    at = F.unix_micros("ts")
    span = e.agg(F.min(at).alias("t0"), F.max(at).alias("t1"))
    run = F.least(F.lit(PARTS - 1), F.floor(PARTS * (at - F.col("t0")) / (F.col("t1") - F.col("t0") + F.lit(1.0)))).cast("bigint")
    first = e.crossJoin(F.broadcast(span)).select("event_id", "ts", "event_type", run.alias("run"), F.lit(False).alias("again"))  # one row
    again = first.withColumns({"run": F.col("run") + 1, "again": F.lit(True),
                               "ts": F.when(F.col("event_id") % 2 == 0, F.col("ts")).otherwise(F.timestamp_micros(at + LATER_HOURS * 3_600_000_000))})
    return first.unionByName(again)


@query("str5_duplicate_safe_ingest", f"""WITH {PART_SQL}, again AS (SELECT event_id, event_type, run + 1 AS run,
    CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL {LATER_HOURS} HOUR END AS ts FROM original),
seen AS (SELECT run, MAX(ts) AS newest FROM (SELECT run, ts FROM original UNION ALL SELECT run, ts FROM again) q GROUP BY run),
marks AS (SELECT run + 1 AS run, DATE_TRUNC('milliseconds', MAX(newest) OVER (ORDER BY run)) - INTERVAL {DELAY_HOURS} HOUR AS mark FROM seen),
firsts AS (SELECT o.*, (m.mark IS NULL OR o.ts > m.mark) AS kept FROM original o LEFT JOIN marks m USING (run))
SELECT event_id, event_type, ts, FALSE AS again FROM firsts WHERE kept
UNION ALL
SELECT a.event_id, a.event_type, a.ts, TRUE FROM again a JOIN firsts f USING (event_id) JOIN marks m ON m.run = a.run
WHERE a.ts > m.mark AND (NOT f.kept OR f.ts + INTERVAL {DELAY_HOURS} HOUR <= m.mark)""")
def str5(t):
    src, out, ck = (scratch_path(t.spark, x) for x in ("arrivals", "dedup", "ck"))
    sent = deliveries(t)
    for run in range(PARTS + 1):
        ingest.land(sent.where(F.col("run") == run).drop("run"), src, files=2)
        s = ingest.file_stream(t.spark, src, sent.drop("run").schema)
        ingest.drain(ingest.dedup(s, "event_id", "ts", f"{DELAY_HOURS} hours"), out, ck)
    return t.spark.read.parquet(out).select("event_id", "event_type", "ts", "again")
