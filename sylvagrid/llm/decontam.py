"""Benchmark decontamination with a broadcast hash set of word windows.

Benchmark texts are cut into windows of ``width`` words (a shorter item is one window).
The windows go to every task as a hash set, in blocks of bounded size; training texts are
scanned once per block, in one chain of scans without a shuffle. A window whose hash is in
the set is verified word by word before it counts.

Words: A-Z lower-cased, then runs of digits, a-z and non-ASCII characters. Null and empty
texts have no words. Items without words or without an id are left out; items with the same
id count as one. Repeated documents are judged row by row. An empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, merged, mix, ranges, shared_broadcast, slices, small_batches, texts_of, unused, written

WIDTH = 10
BLOCK_BYTES = 16 << 20  # benchmark text per broadcast block
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
               for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = U(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class WindowSet:
    """Distinct windows of a block of items, by length: sorted hashes, a place of each in the items' words, and its items.

    Words are numbered; a window costs some 24 bytes, whatever its length.
    """

    def __init__(self, items: list[tuple[int, bytes]], width: int) -> None:
        self.words: dict[bytes, int] = {}
        self.ids = np.array([i for i, _ in items], np.int64)
        texts = [[self.words.setdefault(x, len(self.words)) for x in words_of(t)] for _, t in items]
        size = np.array([len(t) for t in texts], np.int64)
        self.stream = np.fromiter((w for t in texts for w in t), np.int32, int(size.sum()))
        begin, length = np.cumsum(size) - size, np.minimum(size, width)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for n in np.unique(length[length > 0]).tolist():
            of = np.flatnonzero(length == n)
            count = size[of] - n + 1
            at, item = ranges(begin[of], count), np.repeat(of, count)
            windows = self.stream[at[:, None] + np.arange(n)]
            _, first, inverse = np.unique(windows, axis=0, return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([inverse.reshape(-1), item]), axis=1)
            edge = np.searchsorted(pairs[0], np.arange(len(first) + 1))
            hashes = self.hashed(windows[first].reshape(-1), n)[::n]
            order = np.argsort(hashes, kind="stable")
            self.by_length[n] = hashes[order], at[first[order]], edge[:-1][order], edge[1:][order], pairs[1].astype(np.int32)

    @staticmethod
    def hashed(ids: np.ndarray, n: int) -> np.ndarray:
        """Hash of every ``n`` neighbouring word numbers."""
        v = mix(ids.astype(np.uint64) + U(1))
        out = np.zeros(len(ids) - n + 1, np.uint64)
        for i in range(n):
            out = out * BASE + v[i:len(ids) - n + 1 + i]
        return out

    def scan(self, ids: np.ndarray) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, length, items) of every window that occurs; -1 marks a foreign word."""
        known = ids >= 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        for n, (hashes, at, low, high, items) in self.by_length.items():
            for a, b in edges.reshape(-1, 2)[edges[1::2] - edges[::2] >= n]:
                h = self.hashed(ids[a:b], n)
                place = np.searchsorted(hashes, h)
                for i in np.flatnonzero(hashes[np.minimum(place, len(hashes) - 1)] == h).tolist():
                    k = int(place[i])
                    while k < len(hashes) and hashes[k] == h[i]:  # windows of one hash are told apart by their words
                        if np.array_equal(self.stream[at[k]:at[k] + n], ids[a + i:a + i + n]):
                            yield int(a) + i, n, set(self.ids[items[low[k]:high[k]]].tolist())
                        k += 1


def _scan(batches: Iterator[pa.RecordBatch], block, column: str) -> Iterator[pa.RecordBatch]:
    windows: WindowSet = block.value
    for batch in slices(batches, column):
        n_words, spans, items = [], [], []
        for text, old_spans, old_items in zip(texts_of(batch[column]), batch["_spans"].to_pylist(),
                                              batch["_items"].to_pylist(), strict=True):
            w = words_of(text)
            ids = np.fromiter(map(windows.words.get, w, repeat(-1)), np.int64, len(w))
            hits = list(windows.scan(ids)) if len(w) else []
            n_words.append(len(w))
            if hits:
                flat = np.array(sorted([(i, i + n) for i, n, _ in hits] + list(zip(old_spans[::2], old_spans[1::2], strict=True))))
                a, b = merged(flat[:, 0], flat[:, 1])
                old_spans = np.stack([a, b], 1).reshape(-1).tolist()
                old_items = sorted(set(old_items).union(*(x for _, _, x in hits)))
            spans.append(old_spans)
            items.append(old_items)
        new = {"_words": pa.array(n_words, pa.int64()), "_spans": pa.array(spans, pa.list_(pa.int64())),
               "_items": pa.array(items, pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_arrays([new.get(c, batch[c]) for c in batch.schema.names], batch.schema.names)


def blocks_of(benchmark: DataFrame, width: int, block_bytes: int) -> list[WindowSet]:
    """The benchmark as window sets of at most about ``block_bytes`` of text each."""
    b = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("binary").alias("t")).where(
        "i is not null and t is not null")
    size = b.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        rows = b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()  # one block, bounded by its size
        yield WindowSet([(r["i"], bytes(r["t"])) for r in rows], width)


def find_windows(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``_words`` (word count), ``_spans`` (flat first, end word numbers of maximal
    hit runs) and ``_items`` (ids of the items whose windows occur), which replace columns of
    these names. Other columns stay."""
    longs = F.array().cast("array<bigint>")
    out = small_batches(docs).withColumns({"_text": F.col(text).cast("binary"), "_words": F.lit(0).cast("long"), "_spans": longs, "_items": longs})
    block = None
    for windows in blocks_of(benchmark, width, block_bytes):
        if block is not None:  # a task holds one block: what the last one found is written first
            out = written(out)
            block.destroy()
        block = shared_broadcast(docs.sparkSession, windows)
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema])
        out = out.mapInArrow(lambda it, block=block: _scan(it, block, "_text"), schema)
    return out.drop("_text")


def digest(found: DataFrame) -> DataFrame:
    """The counts and checksums of ``find_windows`` per row."""
    ids = F.array_sort(F.transform("_items", lambda i: i.cast("string")))
    covered = F.aggregate(F.sequence(F.lit(1), (F.size("_spans") / 2).cast("int")), F.lit(0).cast("long"), lambda n, i: n
                          + F.element_at("_spans", (i * 2).cast("int")) - F.element_at("_spans", (i * 2 - 1).cast("int")))
    hit = F.when(F.size("_spans") > 0, covered).otherwise(F.lit(0).cast("long"))
    return found.select(
        "doc_id", F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"))


def _cut(text: bytes, spans: list[int]) -> str:
    """The text without the words of the spans and what lies between them."""
    at = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    out, end = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[end:at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, text[end:]]).decode("utf-8", "replace")


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH,
                  reject_share: float = 0.5) -> DataFrame:
    """``docs`` without hit spans; a document with ``reject_share`` of its words hit is removed.

    Documents without a hit come back unchanged, with all their columns.
    """
    aside = {c: unused(f"_own{c}", docs) for c in ("_text", "_words", "_spans", "_items") if c in docs.columns}
    found = find_windows(docs.withColumnsRenamed(aside), benchmark, text, width)
    own = [aside.get(c, c) for c in docs.columns]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts, keep = batch[text].to_pylist(), []
            for i, (n, spans) in enumerate(zip(batch["_words"].to_pylist(), batch["_spans"].to_pylist(), strict=True)):
                hit = sum(spans[1::2]) - sum(spans[::2])
                keep.append(hit < reject_share * n or not hit)
                if hit:
                    texts[i] = _cut(texts[i].encode(), spans)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch[c] for c in own],
                                             names).filter(pa.array(keep, pa.bool_()))
    names = docs.columns
    return found.mapInArrow(cut, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
dwin AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM dwin JOIN win USING (n, s)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
