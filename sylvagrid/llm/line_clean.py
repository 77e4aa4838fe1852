"""Line-first cleaning: judge every line, drop the lines that fail, then judge what is left.

A line fails when it
* is navigation: three or more lone separators that make a quarter of its words,
* is symbol junk: more than one of ``#*$%&|<>`` per two words,
* stutters: a quarter of its words repeat the word before,
* is boilerplate: it holds one of the fixed phrases,
* is short and has no closing punctuation (headings, menus; not a long line cut off),
* repeats an earlier line of the document.
Lines without a word are neither failed nor counted. A document that keeps less than
``least_share`` of its words is rejected, as is one that fails the base rules (few words, or
many words in repeated windows). Null and empty texts have no words and are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

# Fixed values of the rules.
SYMBOLS = b"#*$%&|<>"
SEPARATORS = ("|", ">", "·", "•", "»", "›")
PHRASES = ("licensed under", "all rights reserved", "copyright", "cookie", "privacy policy", "terms of use",
           "terms of service", "javascript", "subscribe", "click here", "sign in", "log in")
CLOSING = (".", "!", "?", "…", ":", ";", '"', "'", ")", "”", "’", "»")
WINDOW = 8
MIN_WORDS = 20
SHORT_LINE = 12  # words
LEAST_SHARE = 0.5

_SEPS = {s.encode() for s in SEPARATORS}
_BOILER = re.compile("|".join(map(re.escape, PHRASES)).encode())
_ENDS = tuple(c.encode() for c in CLOSING)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_NOT_INNER = bytes(b for b in range(256) if not 128 <= b < 192)  # all but UTF-8 continuation bytes
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more, exactly.

    Windows are numbered by doubling: equal numbers mean equal words.
    """
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    size = 1
    while size < width:
        step = min(size, width - size)
        pair = ids[:len(ids) - step] * n + ids[step:]
        if size + step == width:
            ids = pair
            break
        ids = np.unique(pair, return_inverse=True)[1]
        size += step
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    hit = np.zeros(len(ids), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """Whether a line with words fails a rule that looks at the line alone."""
    separators = sum(w in _SEPS for w in words)
    return (separators >= 3 and 4 * separators >= len(words)
            or 2 * len(line.translate(None, _NOT_SYMBOL)) > len(words)
            or 4 * sum(map(eq, words, words[1:])) > len(words)
            or len(words) < SHORT_LINE and not words[-1].endswith(_ENDS)
            or _BOILER.search(line.translate(_LOWER)) is not None)


def judge(text: bytes) -> tuple[int, int, int, int, int, int, list[bytes]]:
    """Counts of a text, the words it keeps, and the lines it keeps."""
    words = text.split()
    lines, seen, dup, kept_words, kept = text.split(b"\n"), set(), 0, 0, []
    for line in lines:
        w = line.split()
        if not w:
            continue
        if line in seen:
            dup += 1
            continue
        seen.add(line)
        if not line_fails(line, w):
            kept_words += len(w)
            kept.append(line)
    chars = sum(map(len, words)) - len(text.translate(None, _NOT_INNER))
    return (len(words), chars, len(text.translate(None, _NOT_SYMBOL)), dup, repeated_words(words), kept_words, kept)


def clean_lines(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS,
                least_share: float = LEAST_SHARE) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and ``clean_text`` (the surviving lines)."""
    added = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
             "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "clean_text": pa.string()}
    own = [c for c in small_batches(docs).columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            columns: dict[str, list] = {c: [] for c in added}
            for t in batch[text].to_pylist():
                n, chars, symbols, dup, repeat, kept_words, lines = judge((t or "").encode())
                failed = n < min_words or 100 * repeat > 30 * n
                row = (n, chars, symbols, dup, repeat, failed, not failed and kept_words >= least_share * n,
                       b"\n".join(lines).decode())
                for c, v in zip(added, row, strict=True):
                    columns[c].append(v)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), *(pa.array(columns[c], k) for c, k in added.items())],
                                             [*own, *added])

    kinds = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema),
                        *(f"`{c}` {kinds[k]}" for c, k in added.items())])
    return docs.select(*own).mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    out = clean_lines(docs.select("doc_id", F.col("text")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_W = r"'[^\x20\x09-\x0D]+'"
_SEP_SQL = ", ".join(f"'{s}'" for s in SEPARATORS)
_END_SQL = " OR ".join("ends_with(w[len(w)], '" + c.replace("'", "''") + "')" for c in CLOSING)
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents),
lines AS (
  SELECT r, line, min(p) AS p, count(*) AS copies FROM (
    SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM d)
  WHERE len(regexp_extract_all(line, {_W})) > 0 GROUP BY r, line),
judged AS (
  SELECT r, len(w) AS n, copies,
         NOT (len(list_filter(w, lambda x: x IN ({_SEP_SQL}))) >= 3 AND 4 * len(list_filter(w, lambda x: x IN ({_SEP_SQL}))) >= len(w))
         AND NOT 2 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > len(w)
         AND NOT 4 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > len(w)
         AND (len(w) >= {SHORT_LINE} OR {_END_SQL})
         AND NOT regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(PHRASES)}') AS ok
  FROM (SELECT *, regexp_extract_all(line, {_W}) AS w FROM lines)),
by_doc AS (SELECT r, sum(copies - 1) AS dup, sum(n) FILTER (ok) AS left_words FROM judged GROUP BY r),
win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM (
    SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (
      SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8))),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM win WHERE c > 1) GROUP BY r),
base AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, coalesce(left_words, 0) AS left_words
  FROM d LEFT JOIN by_doc USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * left_words >= n_words AS kept
FROM base
"""
