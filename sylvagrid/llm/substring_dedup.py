"""Word-level removal of repeats with difference-cover anchors.

A difference cover of a period holds residues such that any two positions, moved right together
by less than the period, both land on one. Words are hashed only at cover positions, as strings of
``least - period + 1`` words: any match of ``least`` words has an aligned anchor that both sides
hash. From shared anchors both sides extend to every window around them, and windows are compared
exactly: words are numbered, and numbers of pairs, fours, eights and so on stand for equal words.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, merged
from .repeats import remove_repeats
from .suffix_dedup import rolling, spans_of

LEAST = 50
PERIOD = 31
I8 = np.int64


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences are all residues of the period."""
    def grow(chosen: tuple[int, ...], covered: frozenset[int], size: int) -> tuple[int, ...] | None:
        if len(covered) == period:
            return chosen
        left = size - len(chosen)
        if not left or period - len(covered) > 2 * sum(range(len(chosen), size)):
            return None
        for x in range(chosen[-1] + 1, period):
            new = covered | {(x - y) % period for y in chosen} | {(y - x) % period for y in chosen}
            if found := grow((*chosen, x), new, size):
                return found
        return None

    return next(c for size in count(1) if (c := grow((0,), frozenset([0]), size)))


def cover_anchors(texts: list[bytes], least: int, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, word position) of the word strings at cover positions."""
    cover, gram = np.zeros(period, bool), least - period + 1
    cover[list(difference_cover(period))] = True
    keys, which, where = [np.zeros(0, np.uint64)], [np.zeros(0, I8)], [np.zeros(0, I8)]
    for first, group in chunks(texts):
        words = [t.split() for t in group]
        n = np.array([len(w) for w in words], I8)
        data = np.frombuffer(b"\n".join(b" ".join(w) for w in words if w) + b"\n", np.uint8)
        stop = np.flatnonzero((data == 32) | (data == 10))
        start = np.concatenate([[0], stop[:-1] + 1])
        text = np.repeat(np.arange(len(group)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        pick = np.flatnonzero(cover[at % period] & (at + gram <= n[text])) if len(at) else at
        prefix = rolling().prefix(data)
        keys.append(rolling().spans(prefix, start[pick], stop[pick + gram - 1]))
        which.append(text[pick] + first)
        where.append(at[pick])
    return np.concatenate(keys), np.concatenate(which), np.concatenate(where)


def matches(text: bytes, sizes: np.ndarray, docs: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, stop) of the maximal word ranges covered by windows that start in a piece of a
    smaller document."""
    ends = np.cumsum(sizes)
    known: dict[bytes, int] = {}
    pieces = [text[a:b].split() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    n = np.array([len(w) for w in pieces], I8)
    ids = np.array([known.setdefault(x, len(known)) for w in pieces for x in w], I8)
    piece = np.repeat(np.arange(len(n)), n)
    begin = np.cumsum(n) - n
    room = begin[piece] + n[piece] - np.arange(len(ids)) >= least
    size = 1
    while size < least and len(ids) > size:  # numbers of strings of ``size`` words
        step = min(size, least - size)
        ahead = np.concatenate([ids[step:], np.zeros(step, I8)])
        ids, size = np.unique(ids * (int(ids.max()) + 1) + ahead, return_inverse=True)[1], size + step
    at = np.flatnonzero(room)
    if not len(at):
        return at, at, at
    smallest = np.full(int(ids.max()) + 1, 2**63 - 1, I8)
    np.minimum.at(smallest, ids[at], docs[piece[at]])
    start = at[smallest[ids[at]] < docs[piece[at]]]
    apart = start + piece[start]  # one place between pieces, so that none runs into the next
    a, b = merged(apart, apart + least)
    owner = piece[start[np.searchsorted(apart, a)]]
    return owner, a - owner - begin[owner], b - owner - begin[owner]


class _Words:
    def __init__(self, text: bytes) -> None:
        self.words = text.split()
        self.units = len(self.words)

    def cut(self, start: int, stop: int) -> bytes:
        return b" ".join(self.words[start:stop])

    def places(self, start: np.ndarray, least: int) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words as one text, and where in it the windows that begin at ``start`` begin and end."""
        size = np.array([len(w) for w in self.words], I8)
        end = np.cumsum(size + 1) - 1
        return b" ".join(self.words), (end - size)[start], end[start + least - 1]


class WordRule:
    """Units are words; see the module."""

    cutter = _Words

    def __init__(self, least: int = LEAST, period: int = PERIOD) -> None:
        self.least, self.period = least, period
        self.before, self.after = period - 1, least

    def anchors(self, texts: list[bytes]):
        return cover_anchors(texts, self.least, self.period)

    def match(self, text: bytes, sizes: np.ndarray, docs: np.ndarray):
        return matches(text, sizes, docs, self.least)


def remove_long_matches(docs: DataFrame, least: int = LEAST, period: int = PERIOD) -> DataFrame:
    """``doc_id``, word counts and the kept words (joined by a space) of every document.

    Words are runs between ASCII white space, unchanged; null and empty texts have none.
    """
    def finish(text: bytes, found):
        words = text.split()
        a, b = spans_of(words, found, least)
        kept = [w for s, e in zip([0, *b.tolist()], [*a.tolist(), len(words)], strict=True) for w in words[s:e]]
        return len(words), len(words) - len(kept), b" ".join(kept).decode()

    added = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}
    return remove_repeats(docs.select("doc_id", "text"), WordRule(least, period), finish, added, ["doc_id"])


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS m FROM x) WHERE m < doc_id),
g AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM f),
y AS (SELECT r, list(j) AS gone FROM g GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
           list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)), lambda j: w[j]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN y USING (r)
"""
