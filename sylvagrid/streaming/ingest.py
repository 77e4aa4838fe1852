"""Incremental ingestion and running results with Structured Streaming.

All state is either checkpointed offsets or mergeable sums. Input is a stream of files;
``availableNow`` drains what has arrived and stops, which is the resumable batch loop.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.metrics import running_sums


def file_stream(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet",
                files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def land(rows: DataFrame, folder: str, files: int) -> None:
    """Add rows to a stream's folder as that many new files."""
    rows.repartition(files).write.mode("append").parquet(folder)


def _finished(q: StreamingQuery) -> list[int]:
    """Rows of each batch that had any, once the stream has stopped."""
    q.awaitTermination()
    return [p.numInputRows for p in q.recentProgress if p.numInputRows]


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> list[int]:
    """Process everything available into Parquet and stop; a rerun continues from the checkpoint.

    Returns the rows of each batch. After the last one the watermark moves on, so a rerun
    sees state expired by all that came before it.
    """
    return _finished(stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
                     .trigger(availableNow=True).start(out))


def drain_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append") -> list[int]:
    return _finished(stream.writeStream.foreachBatch(handle).outputMode(mode)
                     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def resumed(run: Callable[[], list[int]], attempts: int = 3) -> list[int]:
    """Run a drained stream again when it fails, from its checkpoint: the batch that failed is repeated.

    Returns the batches of the attempt that got through; the last attempt's error is raised.
    """
    for left in range(attempts - 1, -1, -1):
        try:
            return run()
        except StreamingQueryException:
            if not left:
                raise
    raise ValueError("no attempts")


def ingest(stream: DataFrame, accept: Column, out: str, checkpoint: str) -> list[int]:
    """Filtered append of new files; files already taken are skipped by the checkpoint."""
    return drain(stream.where(accept), out, checkpoint)


def dedup(stream: DataFrame, ident: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Drops repeats of an id that arrive within the watermark delay, and rows older than the watermark.

    An id is forgotten once the watermark passes its first row's time by ``delay``; a later
    row of it, if not late itself, is taken for new. State is one row per id within reach.
    """
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([ident])


def _complete(spark: SparkSession, out: str):
    """The file system and the folders of complete batches in order, as Hadoop paths."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*/_SUCCESS")
    fs = marks.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, sorted((m.getPath().getParent() for m in fs.globStatus(marks) or []), key=lambda p: p.toString())


def running_metrics(stream: DataFrame, keys: Sequence[str], out: str, checkpoint: str,
                    publish: Callable[[int], None] | None = None) -> list[int]:
    """The nine metric sums per key, rewritten after every batch (complete mode).

    The state is one row per key and grows over the batches, whatever restarts lie between.
    Each batch writes its own folder, so a repeated batch replaces itself; the writer marks a
    folder when it is complete, then ``publish`` is called with the batch's number. An error
    there stops the stream before the batch counts as done. The two newest folders stay.
    """
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch:09d}")
        fs, done = _complete(df.sparkSession, out)
        for old in done[:-2]:
            fs.delete(old, True)
        if publish:
            publish(batch)

    return drain_batches(running_sums(stream, keys), write, checkpoint, "complete")


def latest_batch(spark: SparkSession, out: str) -> DataFrame:
    """Result of the last complete batch; only its folder is read."""
    _, done = _complete(spark, out)
    return spark.read.parquet(done[-1].toString())


def windowed_counts(stream: DataFrame, ts: str, width: str, delay: str) -> DataFrame:
    """Rows per tumbling event-time window."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.month(F.col(ts)).between(4, 9)).alias("n_growing")).select(
        F.col("w.start").alias("start"), "n", "n_growing")


def quarantine(stream: DataFrame, checks: Mapping[str, Column], good: str, bad: str, checkpoint: str) -> None:
    """Rows that fail a check go to a failure table with the first failing check's name."""
    reason = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()])

    def route(df: DataFrame, batch: int) -> None:
        tagged = df.withColumn("reason", reason).persist()  # the batch is read once for both outputs
        try:
            tagged.where(F.col("reason").isNull()).drop("reason").write.mode("overwrite").parquet(
                f"{good}/batch={batch:09d}")
            tagged.where(F.col("reason").isNotNull()).write.mode("overwrite").parquet(f"{bad}/batch={batch:09d}")
        finally:
            tagged.unpersist()

    drain_batches(stream, route, checkpoint)


def retry(failed: DataFrame, catalogue: DataFrame, key: str, accept: Column) -> tuple[DataFrame, DataFrame]:
    """Second attempt over the failure table: (recovered rows, ids that fail again or are unknown)."""
    ids = failed.select(key).distinct()
    again = catalogue.join(ids, key, "left_semi")
    recovered = again.where(accept)
    return recovered, ids.join(recovered.select(key), key, "left_anti")
