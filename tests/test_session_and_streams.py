"""Shared folder rules and streaming = batch."""

import pytest
from pyspark.sql import functions as F

from sylvagrid import session
from sylvagrid.operators import metrics
from sylvagrid.streaming import ingest


def test_shared_dir_is_kept(spark):
    first = session.shared_dir(spark)
    assert session.shared_dir(spark) == first
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
    assert session.materialize(spark.range(5)).count() == 5


class FakeSession:
    """Only what ``shared_dir`` reads: the setting is fixed when a session starts."""

    def __init__(self, settings, master):
        self.settings, self.master = settings, master
        self.sparkContext = self
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return None


def test_named_checkpoint_dir_wins():
    assert session.shared_dir(FakeSession({"spark.checkpoint.dir": "/shared/x"}, "spark://h:1")) == "/shared/x"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        session.shared_dir(FakeSession({}, "spark://h:1"))


SCHEMA = "id LONG, ts TIMESTAMP, v DOUBLE"


def arrive(spark, folder, lo, hi):
    spark.range(lo, hi).select("id", F.timestamp_seconds(F.col("id") * 600 + 1_600_000_000).alias("ts"),
                               (F.col("id") % 10).cast("double").alias("v")).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string(SCHEMA)
    arrive(spark, src, 0, 100)
    ingest.ingest(ingest.file_stream(spark, src, schema), F.col("v") >= 5, out, ck)
    assert spark.read.parquet(out).count() == 50
    arrive(spark, src, 100, 200)
    ingest.ingest(ingest.file_stream(spark, src, schema), F.col("v") >= 5, out, ck)
    got = spark.read.parquet(out)
    assert got.count() == 100 == got.select("id").distinct().count()


def test_running_metrics_equal_batch(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string(SCHEMA)

    def frame(df):
        return df.select((F.col("id") % 3).alias("k"), (F.col("v") * 7 + 1).alias("true_agbd"),
                         (F.col("v") * 6 - 2).alias("pred_agbd"))

    arrive(spark, src, 0, 60)
    ingest.running_metrics(frame(ingest.file_stream(spark, src, schema)), ["k"], out, ck)
    arrive(spark, src, 60, 150)
    ingest.running_metrics(frame(ingest.file_stream(spark, src, schema)), ["k"], out, ck)
    a = {r["k"]: r for r in metrics.metrics_from_sums(ingest.latest_batch(spark, out)).collect()}
    b = {r["k"]: r for r in metrics.regression_metrics(frame(spark.read.parquet(src)), ["k"]).collect()}
    assert a.keys() == b.keys()
    for k in b:
        for m in metrics.MEASURES:
            assert a[k][m] == pytest.approx(b[k][m])


def keyed(df):
    return df.select((F.col("id") % 3).alias("k"), (F.col("v") * 7 + 1).alias("true_agbd"), (F.col("v") * 6 - 2).alias("pred_agbd"))


def test_batches_are_bounded_over_runs(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = spark.createDataFrame([], SCHEMA).schema
    for run in range(3):
        rows = spark.range(run * 40, run * 40 + 40).select("id", F.timestamp_seconds("id").alias("ts"), (F.col("id") % 10).cast("double").alias("v"))
        ingest.land(rows, src, files=4)
        batches = ingest.ingest(ingest.file_stream(spark, src, schema, files_per_batch=2), F.col("v") >= 5, out, ck)
        assert len(batches) == 2 and sum(batches) == 40
        assert ingest.ingest(ingest.file_stream(spark, src, schema, files_per_batch=2), F.col("v") >= 5, out, ck) == []
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [i for i in range(120) if i % 10 >= 5]


def test_a_repeated_batch_counts_once(spark, tmp_path):
    """The stream dies after each of its batches was written, and is started again."""
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = spark.range(90).select("id", F.timestamp_seconds("id").alias("ts"), (F.col("id") % 11).cast("double").alias("v"))
    ingest.land(rows, src, files=3)
    tried, published = [], []

    def publish(batch):
        tried.append(batch)
        if tried.count(batch) == 1:
            raise OSError("away")
        published.append(batch)

    def run():
        return ingest.running_metrics(keyed(ingest.file_stream(spark, src, schema, files_per_batch=1)), ["k"], out, ck, publish)

    ingest.resumed(run, attempts=4)
    assert tried == [0, 0, 1, 1, 2, 2] and published == [0, 1, 2]
    a = {r["k"]: r for r in metrics.metrics_from_sums(ingest.latest_batch(spark, out)).collect()}
    b = {r["k"]: r for r in metrics.regression_metrics(keyed(rows), ["k"]).collect()}
    for k in b:
        assert a[k]["n"] == b[k]["n"] == 30
        for m in metrics.MEASURES:
            assert a[k][m] == pytest.approx(b[k][m])
    with pytest.raises(Exception, match="away"):
        ingest.land(rows, src, files=1)
        ingest.resumed(lambda: ingest.running_metrics(keyed(ingest.file_stream(spark, src, schema)), ["k"], out, ck, lambda b: (_ for _ in ()).throw(OSError("away"))), attempts=2)


def test_repeats_within_and_beyond_the_delay(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = spark.createDataFrame([], "id LONG, ts TIMESTAMP, v DOUBLE").schema
    hour = 3600
    runs = [[(1, 10, 0.0), (2, 11, 0.0), (2, 11, 1.0)],  # hours; watermark afterwards: 11 - 2 = 9
            [(1, 10, 2.0), (3, 14, 0.0)],  # a repeat within the delay; afterwards 12
            [(1, 13, 3.0), (2, 11, 3.0), (4, 12, 0.0), (2, 14, 4.0)],  # id 1 expired at 12; ids 2 at 11 and 4 at 12 are late; id 2 is remembered until 13
            [(2, 15, 5.0), (5, 20, 0.0)], [(2, 19, 6.0), (1, 17, 7.0)]]  # afterwards 12, then 18: both expired, one is late
    for rows in runs:
        ingest.land(spark.createDataFrame(rows, "id LONG, h LONG, v DOUBLE").select("id", F.timestamp_seconds(F.col("h") * hour + 1_600_000_000 // hour * hour).alias("ts"), "v"), src, 1)
        ingest.drain(ingest.dedup(ingest.file_stream(spark, src, schema), "id", "ts", "2 hours"), out, ck)
    got = sorted((r.id, r.v) for r in spark.read.parquet(out).collect())
    assert [i for i, _ in got] == [1, 1, 2, 2, 3, 5] and (1, 3.0) in got and (2, 6.0) in got
