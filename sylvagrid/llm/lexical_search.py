"""Ranked lexical search of every document for each of many items, in exact integers.

Documents become compact postings once: the terms that any item of a block has, and how often. Scoring is
dense blocked matrix multiplication: a tile of items holds only its own vocabulary, a tile of documents
becomes a matrix of term impacts over that vocabulary, and BLAS multiplies the two in float64. A vocabulary
tile is cut where the partial sums of an item could reach 2**53, so every product and sum is exact, and tiles
are added as 64-bit integers. Each task keeps an item's best documents; a document that ties with the last of
them is compared by id before it is left out, never by arrival. Tasks' lists meet in two levels, so the rows
of one item in one task grow with the square root of the number of tasks.

Items are taken in blocks of ``BLOCK_BYTES`` of text, which alone reach the driver and the tasks; one longer
item is a block of its own. Null and empty texts have no terms and appear in no result; every row counts as a
document and an item of its own, equal ones too. Documents without an id come after all others of their
score, items without an id are ranked under a null id. Empty tables give no rows; columns other than ids and
texts are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_broadcast, slices, small_batches, texts_of, written

TOP = 20
BLOCK_BYTES = 1 << 20
ITEM_TILE, TERM_TILE, DOC_TILE = 64, 2048, 1024
EXACT = 1 << 53
SCALE = 1_000_000  # no document's share of a term's weight reaches it
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(terms, number of the text each stands in); the terms are views of one buffer."""
    data = b"\n".join(texts).translate(LOWER) + b"\n"
    inside = WORD[np.frombuffer(data, np.uint8)].view(np.int8)
    edges = np.flatnonzero(np.diff(inside, prepend=0))  # a term's start, its end, the next one's start, ...
    if not len(edges):
        return pa.array([], pa.binary()), edges
    every = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return every, np.searchsorted(ends, edges[::2], side="right")


def term_ids(texts: list[bytes], vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary number or -1, text number) of each term."""
    every, text = terms(texts)
    found = pc.fill_null(pc.index_in(every, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    return found[::2], text  # every second view is what lies between two terms


class Block:
    """A block of items: their ids, their vocabulary, and (item, term, count) triples."""

    def __init__(self, rows: list[tuple[int | None, bytes]]) -> None:
        self.ids = [i for i, _ in rows]
        counts = []
        for _, text in rows:
            every, _ = terms([text])
            counts.append(Counter(every.take(pa.array(range(0, len(every), 2))).to_pylist()))
        self.vocabulary = pa.array(sorted(set().union(*counts)), pa.binary())
        place = {t: i for i, t in enumerate(self.vocabulary.to_pylist())}
        self.counts = [sorted((place[t], n) for t, n in c.items()) for c in counts]

    def tiles(self, weight: list[int]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first item, items, term numbers, triples) of each tile; an item's partial sum in one stays below 2**53."""
        out = []
        for first in range(0, len(self.ids), ITEM_TILE):
            todo = [list(c) for c in self.counts[first:first + ITEM_TILE]]
            while any(todo):
                columns: dict[int, int] = {}
                triples: list[tuple[int, int, int]] = []
                for i, left in enumerate(todo):
                    room, later = EXACT - 1, []
                    for term, n in left:
                        most = weight[term] * SCALE
                        take = min(n, room // most) if most else n
                        if term not in columns and len(columns) == TERM_TILE:
                            take = 0
                        if take:
                            triples.append((i, columns.setdefault(term, len(columns)), take))
                            room -= take * most
                        if take < n:
                            later.append((term, n - take))
                    todo[i] = later
                out.append((first, len(todo), np.array(list(columns), np.int64), np.array(triples, np.int64)))
        return out


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """All items, in blocks of about ``block_bytes`` of text."""
    rows = items.select(F.col("item_id"), F.col("text").cast("binary").alias("t")).where("octet_length(t) > 0")
    size = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n = -(-size // block_bytes)
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(n)) == k).collect()  # bounded by the block's size
        if block:
            yield Block(sorted(((r["item_id"], bytes(r["t"])) for r in block), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def postings(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, ids, tfs): a document's number of terms, and how often it has those of the vocabulary."""
    known = shared_broadcast(docs.sparkSession, vocabulary.to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(known.value, pa.binary())
        for batch in slices(batches, "text"):
            term, text = term_ids(texts_of(batch["text"]), values)
            n = np.bincount(text, minlength=batch.num_rows)
            hit = term >= 0
            key, tf = np.unique(text[hit].astype(np.int64) * max(1, len(values)) + term[hit], return_counts=True)
            row, term = np.divmod(key, max(1, len(values)))
            at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))], ["doc_id", "n", "ids", "tfs"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])
    return small_batches(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def weights(found: DataFrame, terms_known: int) -> tuple[int, int, list[int]]:
    """(documents with terms, terms in all, weight of each term of the vocabulary)."""
    all_of = found.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    df = [0] * terms_known
    for r in found.select(F.explode("ids").alias("term")).groupBy("term").count().collect():  # a row per term of the block
        df[r["term"]] = r["count"]
    n = all_of["docs"]
    return n, all_of["terms"] or 0, [math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for f in df]


class Best:
    """The best documents of each item so far: by score, then by id."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.least = np.ones(items, np.int64)  # a score that can still be among them
        self.kept = [[np.zeros(0, np.int64)] * 3 for _ in range(items)]  # score, id, id is null

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Scores of a tile whose documents are in order of their ids."""
        may = scores >= self.least[first:first + len(scores), None]
        for i in np.flatnonzero(may.any(1)).tolist():
            at = np.flatnonzero(may[i])
            at = at[np.argsort(-scores[i, at], kind="stable")[:self.top]]  # ties keep the order of ids
            old = self.kept[first + i]
            score, doc, no_id = (np.concatenate(x) for x in zip(old, (scores[i, at], ids[at], null[at]), strict=True))
            pick = np.lexsort((doc, no_id, -score))[:self.top]
            self.kept[first + i] = [score[pick], doc[pick], no_id[pick]]
            if len(pick) == self.top:
                self.least[first + i] = score[pick[-1]]


def scored(found: DataFrame, block: Block, docs: int, all_terms: int, weight: list[int], top: int) -> DataFrame:
    """(item, doc_id, score, task): each task's best documents of every item of the block."""
    shared = shared_broadcast(found.sparkSession, (len(block.ids), block.tiles(weight), np.array(weight, np.int64)))
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", T.LongType()),
                           T.StructField("score", T.LongType()), T.StructField("task", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, tiles, w = shared.value
        best, column = Best(items, top), np.full(len(w), -1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_TILE):
                part = batch.slice(at, DOC_TILE)
                null = pc.is_null(part["doc_id"]).to_numpy(zero_copy_only=False)
                ids = pc.fill_null(part["doc_id"].cast(pa.int64()), 0).to_numpy()
                order = np.lexsort((ids, null))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                term, tf = part["ids"].flatten().to_numpy(), part["tfs"].flatten().to_numpy()
                row = np.repeat(place, pc.list_value_length(part["ids"]).to_numpy())
                n = part["n"].to_numpy()[order]
                m = 75 + (25 * n * docs) // all_terms
                impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
                total, begun = None, -1
                for first, size, columns, triples in tiles:
                    if first != begun:
                        if total is not None:
                            best.add(begun, total, ids[order], null[order])
                        total, begun = np.zeros((size, len(order)), np.int64), first
                    column[columns] = np.arange(len(columns))
                    here = column[term]
                    use = here >= 0
                    impacts = np.zeros((len(columns), len(order)))
                    impacts[here[use], row[use]] = impact[use]
                    counts = np.zeros((size, len(columns)))
                    counts[triples[:, 0], triples[:, 1]] = triples[:, 2]
                    total += (counts @ impacts).astype(np.int64)
                    column[columns] = -1
                if total is not None:
                    best.add(begun, total, ids[order], null[order])
        task = TaskContext.get().partitionId()
        for i, (score, doc, no_id) in enumerate(best.kept):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i)), pa.array(doc, mask=no_id.astype(bool)), pa.array(score),
                                                  pa.array(np.full(len(score), task))], ["item", "doc_id", "score", "task"])

    return found.where(F.size("ids") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), "n", "ids", "tfs").mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` best documents of each item: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    out = None
    for block in item_blocks(items, block_bytes):
        found = written(postings(docs, block.vocabulary))
        n, all_terms, weight = weights(found, len(block.vocabulary))
        lists = scored(found, block, n, all_terms, weight, top)
        fan = max(1, math.isqrt(found.rdd.getNumPartitions()))
        by_score = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        some = Window.partitionBy("item", "share").orderBy(*by_score)
        every = Window.partitionBy("item").orderBy(*by_score)
        first = lists.withColumn("share", F.pmod("task", F.lit(fan))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
        ranked = first.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, v) for i, v in enumerate(block.ids)],
                                      T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", items.schema["item_id"].dataType)]))
        done = written(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # a row per item of the block
        out = done if out is None else out.unionByName(done)
    if out is None:
        return docs.select(F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("rank"),
                           F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return out


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT row_number() OVER () AS q, item_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
wanted AS (SELECT q, item_id, term, count(*) AS times FROM i GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight
      FROM t, s WHERE term IN (SELECT term FROM wanted) GROUP BY term, n_docs),
scores AS (
  SELECT q, item_id, r, doc_id,
         CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM wanted JOIN f USING (term) JOIN t USING (term), s GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
