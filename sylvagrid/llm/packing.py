"""Bounded-space online packing of token sequences.

Each task reads its documents in order and keeps a fixed number of open windows. A piece goes
to the open window it fits best. When it fits none, the fullest window is topped up with the
head of the piece and emitted (a gap below ``least_piece`` is left as padding instead). What is
still open at the end of the tasks is merged: groups of ``fan`` tasks, then groups of groups,
each handing on one unfinished window.

No text or token moves between tasks, except the tokens of open windows (at most
``open_windows`` times ``window`` per task). Null texts are empty; a document of no text is its
end token alone. Repeated documents are packed each by itself.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import slices, small_batches

WINDOW = 2048
OPEN_WINDOWS = 32
LEAST_PIECE = 16
END_ID = 1
FAN = 64
MEMO = 300_000  # word encodings remembered by a task
SPACE = re.compile(r"(?<=\S)(?= \S)")


class ByteBpe:
    """Token ids of a byte-level BPE vocabulary file, as little-endian unsigned 32-bit bytes.

    A text is cut before a space that stands between two characters that are no white space, where
    no token can cross (tokens of mixed white space exist, so none of it is parted); words seen before come from a bounded memo, others go to the merge engine with the same ranks.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte_of = {chr(b): b for b in plain} | {
            chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.engine = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.memo: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = array("I", self.engine.encode_ordinary(word)).tobytes()
        if len(self.memo) < MEMO and len(word) <= 64:
            self.memo[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        get, word = self.memo.get, self._word
        return b"".join([get(w) or word(w) for w in SPACE.split(text)])

    def encode(self, text: str) -> bytes:
        if self.split is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p)
                        for p in self.split.split(text) if p)


class Packer:
    """Open windows of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, keep: int, least: int, first_id: int) -> None:
        self.window, self.keep, self.least, self.next_id = window, keep, least, first_id
        self.open: list[list] = []  # [tokens, pieces]
        self.done: list[tuple] = []

    def _emit(self, pieces: list[tuple], is_open: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, offset, is_open,
                              bytes(ids) if is_open else None))
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        ids = memoryview(ids)  # pieces are cut without copying what follows
        step = self.window * 4
        while len(ids) >= step:
            self._emit([(doc, start, ids[:step], total)])
            start, ids = start + self.window, ids[step:]
        while n := len(ids) // 4:
            fits = [w for w in self.open if self.window - w[0] >= n]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.keep:
                self.open.append(best := [0, []])
            else:
                best = max(self.open, key=lambda w: w[0])
                n = self.window - best[0]
                if n < self.least:
                    self.open.remove(best)
                    self._emit(best[1])
                    continue
            best[0] += n
            best[1].append((doc, start, bytes(ids[:4 * n]), total))
            start, ids = start + n, ids[4 * n:]
            if best[0] == self.window:
                self.open.remove(best)
                self._emit(best[1])

    def flush(self) -> None:
        for _, pieces in self.open:
            self._emit(pieces, True)
        self.open = []


FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
          ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()),
          ("ids", pa.binary()), ("task", pa.int64())]
SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, open boolean, ids binary, task bigint")


def _rows(done: list[tuple], task: int) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) if done else [[] for _ in FIELDS[:-1]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip([*columns, [task] * len(done)], FIELDS, strict=True)],
                                      [n for n, _ in FIELDS])


def pack(docs: DataFrame, encoder: Callable[[], ByteBpe], window: int = WINDOW, open_windows: int = OPEN_WINDOWS,
         least_piece: int = LEAST_PIECE, end_id: int = END_ID, fan: int = FAN) -> DataFrame:
    """One row per piece of (doc_id, text): where it starts in its document, its sequence and offset.

    ``encoder`` is called once per task. Every sequence but the last holds at least
    ``window - least_piece + 1`` tokens.
    """
    end = array("I", [end_id]).tobytes()
    docs = small_batches(docs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        tokens, packer = encoder(), Packer(window, open_windows, least_piece, task << 32)
        for batch in slices(batches, "text"):
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = tokens.encode(text or "") + end
                packer.add(doc, 0, ids, len(ids) // 4)
            yield _rows(packer.done, task)
            packer.done = []
        packer.flush()
        yield _rows(packer.done, task)

    def merge(level: int):
        def run(key, pieces):
            group = key[0].as_py()
            packer = Packer(window, open_windows, 1, (level << 56) | (group << 32))
            t = pieces.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pydict()
            for doc, start, ids, total in zip(t["doc_id"], t["start"], t["ids"], t["doc_tokens"], strict=True):
                packer.add(doc, start, ids, total)
            rest = sorted((w for w in packer.open), key=lambda w: -w[0])
            last = Packer(window, 1, 1, packer.next_id)
            for _, held in rest:  # one unfinished window is handed on
                for doc, start, ids, total in held:
                    last.add(doc, start, ids, total)
            last.flush()
            return pa.Table.from_batches([_rows(packer.done + last.done, group)])
        return run

    pieces = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(place, SCHEMA))
    closed, rest, level = [pieces.where("not open")], pieces.where("open"), 0
    tasks = (rest.agg(F.max("task").alias("m")).first()["m"] or 0) + 1
    while True:
        level += 1
        tasks = -(-tasks // fan)
        merged = rest.groupBy(F.floor(F.col("task") / fan).alias("g")).applyInArrow(merge(level), SCHEMA)
        if tasks == 1:
            closed.append(merged)
            break
        merged = materialize(merged)
        closed.append(merged.where("not open"))
        rest = merged.where("open")
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out.drop("open", "ids", "task")


def public_encoder(name: str = "byte_bpe_50k.json") -> Callable[[], ByteBpe]:
    """Encoder of a vocabulary installed on every executor."""
    def make() -> ByteBpe:
        import public_tokenizers
        return ByteBpe(public_tokenizers.path(name), public_tokenizers.PATTERN)
    return make
