"""Byte-level removal of repeats with a run-length index.

Candidate pieces that share anchors are concatenated and indexed: suffixes are sorted by their
first ``least`` symbols (prefix doubling), the Burrows-Wheeler transform is stored as runs, and
the sort position is sampled at run ends. Every piece is then streamed through the index from its
end: each step finds the next run of the piece's next symbol and maps to the row of the suffix one
longer. The row's class tells whether the matching statistic against documents with smaller ids reaches ``least``; such windows
are marked and their bytes removed.

Anchors are minimisers: of every ``least`` bytes, the 20-byte string with the smallest hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, chunks, merged, sliding, unused
from .repeats import remove_repeats, rolling

LEAST = 50
GRAM = 20
STREAM = 256  # bytes of a piece streamed in one lane
I8 = np.int64


def minimisers(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, position) of every gram that is the smallest of some ``window`` bytes."""
    keys, which, where, w = [], [], [], window - gram + 1
    for first, group in chunks(texts):
        data = np.frombuffer(b"\0".join(group) + b"\0", np.uint8)
        size = np.array([len(t) + 1 for t in group], I8)
        n = len(data) - gram + 1
        if n < w:
            continue
        prefix, start = rolling().prefix(data), np.arange(n)
        h = rolling().spans(prefix, start, start + gram)
        inside = start + gram <= np.repeat(np.cumsum(size) - 1, size)[:n]
        h[~inside] = U(2**64 - 1)
        edge = np.zeros(w - 1, np.uint64)
        least = np.concatenate([edge, sliding(h, w, True), edge])
        # A gram is some window's smallest if the largest minimum of its windows is its own.
        at = np.flatnonzero((sliding(least, w, False) == h) & inside)
        text = np.repeat(np.arange(len(group)), size)[at]
        keys.append(h[at])
        which.append(text + first)
        where.append(at - (np.cumsum(size) - size)[text])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, I8), np.zeros(0, I8)
    return np.concatenate(keys), np.concatenate(which), np.concatenate(where)


class RunIndex:
    """Run-length Burrows-Wheeler index of symbols (0 ends a piece), sorted by ``depth`` symbols.

    ``samples`` holds the text position at each run's first and last row. Rows whose first ``depth`` symbols agree are one class.
    """

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        n = len(symbols)
        padded = np.concatenate([symbols, np.zeros(depth + 8, symbols.dtype)])
        key, size = np.zeros(n, I8), min(7, depth)  # 7 symbols of 9 bits
        for i in range(size):
            key = (key << 9) | padded[i:i + n]
        order = np.argsort(key, kind="stable")
        rank = self._ranks(key, order)
        while size < depth:
            step = min(size, depth - size)
            ahead = np.concatenate([rank[step:], np.zeros(step, I8)])
            key = rank * n + ahead
            order = np.argsort(key, kind="stable")
            rank, size = self._ranks(key, order), size + step
        before = np.concatenate([[0], symbols[:-1]])[order]  # the transform
        self.rows = n
        self.row_of = np.empty(n, np.int32)
        self.row_of[order] = np.arange(n, dtype=np.int32)
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.heads, self.symbol = heads, before[heads]
        tails = np.concatenate([heads[1:], [n]]) - 1
        self.samples = order[heads], order[tails]
        length = tails - heads + 1
        by_symbol = np.argsort(self.symbol, kind="stable")
        # Run ends by symbol, and the row that a run's first row maps to (that of the suffix one longer).
        self.ends = self.symbol[by_symbol].astype(I8) * n + tails[by_symbol]
        self.run_head = heads[by_symbol]
        self.target = np.cumsum(length[by_symbol]) - length[by_symbol]
        self.classes = rank[order]
        self.class_row = np.flatnonzero(np.concatenate([[True], self.classes[1:] != self.classes[:-1]]))
        self.symbols = symbols

    @staticmethod
    def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        sorted_ = key[order]
        rank = np.empty(len(key), I8)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        return rank

    def stream(self, stop: np.ndarray, length: np.ndarray):
        """Walks lanes leftwards from text positions ``stop``; yields (step, lanes, classes).

        A lane is at the first row of its class. The next symbol leads to the first run of that
        symbol that ends at or after the row; there is one in the class, the lane's own text.
        """
        order = np.argsort(-length, kind="stable")
        stop, left = stop[order], length[order]
        rows = self.class_row[self.classes[self.row_of[stop]]]
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step))  # lanes with more than ``step`` symbols
            rows = rows[:live]
            if step:
                symbol = self.symbols[stop[:live] - step].astype(I8)
                run = np.searchsorted(self.ends, symbol * self.rows + rows)
                rows = self.target[run] + np.maximum(rows - self.run_head[run], 0)
                rows = self.class_row[self.classes[rows]]
            yield step, order[:live], self.classes[rows]


def matches(text: bytes, sizes: np.ndarray, docs: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, stop) of the maximal byte ranges covered by windows that start in a piece of a
    smaller document."""
    none = np.zeros(0, I8)
    if not len(sizes):
        return none, none, none
    ends = np.cumsum(sizes + 1)
    begin = ends - sizes - 1
    symbols = np.zeros(int(ends[-1]), np.int16)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = np.frombuffer(text, np.uint8).astype(np.int16) + 1
    index = RunIndex(symbols, least)
    # The smallest document of each class, over its whole windows.
    piece_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    room = ends[piece_of] - 1 - np.arange(len(symbols)) >= least
    at = np.flatnonzero(room)
    row = index.row_of[at]
    smallest = np.full(int(index.classes[-1]) + 1, 2**63 - 1, I8)
    np.minimum.at(smallest, index.classes[row], docs[piece_of[at]])
    # Lanes: window starts of a piece, STREAM at a time, each from its right end.
    windows = np.maximum(sizes - least + 1, 0)
    lanes = -(-windows // STREAM)
    lane_piece = np.repeat(np.arange(len(sizes)), lanes)
    nth = np.arange(len(lane_piece)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    first = nth * STREAM
    length = np.minimum(windows[lane_piece] - first, STREAM)
    stop = begin[lane_piece] + first + length - 1
    lane_doc = docs[lane_piece]
    marked = np.zeros(len(symbols), bool)
    for step, lane, classes in index.stream(stop, length):
        hit = smallest[classes] < lane_doc[lane]
        marked[stop[lane[hit]] - step] = True
    start = np.flatnonzero(marked)
    a, b = merged(start, start + least)
    piece = piece_of[a]
    return piece.astype(I8), a - begin[piece], b - begin[piece]


class _Bytes:
    def __init__(self, text: bytes) -> None:
        self.text, self.units = text, len(text)

    def cut(self, start: int, stop: int) -> bytes:
        return self.text[start:stop]

    def places(self, start: np.ndarray, least: int) -> tuple[bytes, np.ndarray, np.ndarray]:
        """A text, and where in it the windows that begin at ``start`` begin and end."""
        return self.text, start, start + least


class ByteRule:
    """Units are bytes; see the module."""

    cutter = _Bytes

    def __init__(self, least: int = LEAST, gram: int = GRAM) -> None:
        self.least, self.gram = least, gram
        self.before, self.after = least - gram, least

    def anchors(self, texts: list[bytes]):
        return minimisers(texts, self.least, self.gram)

    def match(self, text: bytes, sizes: np.ndarray, docs: np.ndarray):
        return matches(text, sizes, docs, self.least)


def spans_of(text: bytes | list[bytes], found, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges to remove: all of a copy (None), else the union of what was found."""
    if found is None:
        n = len(text) if len(text) >= least else 0
        return np.zeros(int(n > 0), I8), np.full(int(n > 0), n, I8)
    return merged(*found)


def without(text: bytes, start: np.ndarray, stop: np.ndarray) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *stop.tolist()], [*start.tolist(), len(text)], strict=True))


def digest(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per document: bytes, removed bytes and runs, and the checksum of what is left."""
    def finish(text: bytes, found):
        a, b = spans_of(text, found, least)
        return len(text), int((b - a).sum()), len(a), hashlib.sha256(without(text, a, b)).hexdigest()

    added = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    return remove_repeats(docs.select("doc_id", "text"), ByteRule(least), finish, added, ["doc_id"])


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with repeats removed from ``text``; characters cut in two are dropped whole.

    Documents left without text are removed; documents without repeats come back unchanged.
    """
    def finish(text: bytes, found):
        a, b = spans_of(text, found, least)
        return (without(text, a, b).decode("utf-8", "ignore") if len(a) else text.decode()), len(a)

    runs = unused("_runs", docs)
    out = remove_repeats(docs, ByteRule(least), finish, {"text": pa.string(), runs: pa.int64()}, docs.columns)
    return out.where((F.col(runs) == 0) | (F.trim("text") != "")).select(*docs.columns)


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT r, doc_id, h, unnest(range(0, octet_length(t) - 49)) AS i FROM d)),
f AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id),
b AS (SELECT r, i, i - 50 > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -100) AS new FROM f),
g AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM b),
x AS (SELECT r, k, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY r, k),
y AS (SELECT r, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a) AS removed, count(*) AS spans FROM x GROUP BY r)
SELECT doc_id, octet_length(t) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, spans + 1), lambda j:
           substr(h, CASE WHEN j = 0 THEN 1 ELSE 2 * z[j] + 1 END,
                  2 * (CASE WHEN j = spans THEN octet_length(t) ELSE a[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE z[j] END))), '') END))
           AS kept_sha256
FROM d LEFT JOIN y USING (r)
"""
