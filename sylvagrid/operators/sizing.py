"""Joins and broadcasts of tables whose rows have been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BROADCAST_ROWS = 1_000_000
TASK_ROWS = 2_000_000  # rows of the looked-up side that a task holds


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """An aggregated side table, written once and counted, and its count.

    It is hinted for broadcast up to ``max_rows`` rows and left to a shuffled join beyond.
    """
    m = materialize(df)
    n = m.count()
    return (F.broadcast(m) if n <= max_rows else m), n


def looked_up(df: DataFrame, side: DataFrame, key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` with the columns of ``side``, which has few rows per ``key``; rows without a partner stay.

    ``side`` is counted. A task hashes its part of it and streams ``df`` past, so nothing is sorted
    and ``df`` may have hot keys, which the skew handling splits. A ``side`` of more than ``task_rows``
    for each of the session's shuffle partitions is dealt into more parts; a hot key of ``df`` is
    then streamed by one task.
    """
    parts = -(-side.count() // task_rows)
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df, side = df.repartition(parts, key), side.repartition(parts, key)
    return df.join(side.hint("shuffle_hash"), key, "left")
