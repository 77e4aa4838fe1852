"""Shards along a Hilbert curve over several metadata dimensions.

Language, source and length are each quantised to ``2**bits`` values. The curve's index orders
the cells so that neighbours in the order are neighbours in every dimension; cutting the order
into runs of equal row counts gives shards with narrow ranges in each column, which readers can
prune. DataFrame operations only.

The order's ranks come from counts, not from one global sort: cells are cut into hash buckets of
about ``bucket_rows`` rows (a hot cell into many), bucket counts give offsets, and each bucket
numbers its own rows. Null texts are empty; null metadata is a value of its own. Equal rows are
numbered in any order. Empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS = 40
BITS = 4
BUCKET_ROWS = 100_000
OVERHEAD = 16  # bytes a document takes besides its text


def hilbert_cells(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """All ``2**(dims*bits)`` cells (``x0``, ``x1``, ...) with their place ``curve`` on the curve.

    Rotations are undone from the highest bit down, the result is Gray-coded, and the
    dimensions' bits are interleaved.
    """
    side, last = 1 << bits, dims - 1
    cells = spark.range(side ** dims).select(
        F.array(*[F.pmod(F.floor(F.col("id") / side ** i), F.lit(side)).cast("int") for i in range(dims)]).alias("x"))
    # Steps (bit, dimension) from the highest bit down.
    turned = cells.withColumn("t", F.expr(f"""
        aggregate(sequence(0, {(bits - 1) * dims - 1}), x, (a, s) -> transform(a, (v, j) -> CASE
            WHEN (a[s % {dims}] & shiftleft(1, {bits - 1} - s DIV {dims})) != 0
                THEN IF(j = 0, v ^ (shiftleft(1, {bits - 1} - s DIV {dims}) - 1), v)
            WHEN (j = 0) != (j = s % {dims})
                THEN v ^ ((a[0] ^ a[s % {dims}]) & (shiftleft(1, {bits - 1} - s DIV {dims}) - 1))
            ELSE v END))""") if bits > 1 else F.col("x"))
    grey = turned.withColumn("g", F.expr("transform(t, (v, j) -> aggregate(slice(t, 1, j + 1), 0, (a, w) -> a ^ w))"))
    flip = grey.withColumn("f", F.expr(f"""
        aggregate(sequence(1, {bits}), 0, (a, b) -> IF((g[{last}] & shiftleft(1, b - 1)) != 0, a ^ (shiftleft(1, b - 1) - 1), a))"""))
    placed = flip.withColumn("curve", F.expr(f"""
        aggregate(sequence(0, {bits * dims - 1}), 0,
            (a, s) -> a * 2 + (shiftright(g[s % {dims}] ^ f, {bits - 1} - s DIV {dims}) & 1))"""))
    return placed.select(*[F.col("x")[i].alias(f"x{i}") for i in range(dims)], "curve")


def quantised(value: Column, bits: int) -> Column:
    """A category as one of ``2**bits`` values; null is 0."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.crc32(value.cast("string").cast("binary")), F.lit(1 << bits))).cast("int")


def magnitude(value: Column, bits: int) -> Column:
    """The binary logarithm of a size as one of ``2**bits`` values; null and 0 are 0."""
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.greatest(F.coalesce(value, F.lit(1)), F.lit(1))))).cast("int")


def shard(rows: DataFrame, dims: list[Column], tie: list[Column], shards: int = SHARDS, bits: int = BITS,
          bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``curve``, ``shard`` and ``slot``: runs of the curve's order whose row counts
    differ by one at most.

    ``dims`` are values below ``2**bits``. Rows of a cell are ordered by a hash of ``tie`` and ``tie``.
    """
    spark, names = rows.sparkSession, [f"_x{i}" for i in range(len(dims))]
    cells = hilbert_cells(spark, len(dims), bits)
    cells = F.broadcast(cells.withColumnsRenamed({f"x{i}": n for i, n in enumerate(names)}))  # 2**(dims*bits) rows
    placed = rows.withColumns({**dict(zip(names, dims, strict=True)), "_h": F.xxhash64(*tie)}).join(cells, names)
    counts = placed.groupBy("curve").agg(F.count(F.lit(1)).alias("_n"))
    cuts = F.broadcast(counts.select("curve", F.ceil(F.col("_n") / bucket_rows).alias("_cuts")))  # a row per cell
    # Bucket by the hash's high bits, so that bucket order is hash order.
    share = F.shiftrightunsigned("_h", 33).cast("long")
    placed = placed.join(cuts, "curve").withColumn("_b", F.shiftright(share * F.col("_cuts"), 31))
    sizes = placed.groupBy("curve", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("curve", "_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket, not per document
    offsets = sizes.select("curve", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    total = sizes.agg(F.sum("_n").alias("_all"))
    inside = Window.partitionBy("curve", "_b").orderBy(F.shiftrightunsigned("_h", 1), *tie)
    out = placed.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["curve", "_b"])
    out = out.crossJoin(F.broadcast(total)).withColumn("_rank", F.col("_rank") + F.col("_off"))  # total: one row
    k = F.expr(f"(_rank * {shards}) div _all")
    return out.withColumn("shard", k.cast("int")).withColumn(
        "slot", F.col("_rank") - F.expr(f"(shard * _all + {shards - 1}) div {shards}")).drop(
        *names, "_h", "_b", "_cuts", "_off", "_rank", "_all")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The digest of a sharding of ``documents`` by language, source and length, under the law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", "lang", "source", "n_chars", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    dims = [quantised(F.col("lang"), BITS), quantised(F.col("source"), BITS), magnitude(F.col("n_chars"), BITS)]
    out = shard(rows, dims, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve")
