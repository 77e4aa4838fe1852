"""Toxicity scores of deobfuscated text.

A noisy channel writes letters as look-alike digits and signs, spaces them out and repeats them.
Words that show such traces become character lattices; Viterbi decoding finds the letters that the
channel and a character trigram model of the whole corpus make likeliest. Words with a doubled letter
and words split in parts are read a second way: where the letters from a word's beginning on, without
gaps and repeats, begin like a learned feature, that place becomes a lattice of its own, and what it
decodes to is read besides the text, not in its place. No other place could decode to a feature, so
nothing else needs decoding. Restored text is scored by the word and word-beginning that is most toxic
in the labelled rows.

The language model counts every character of every document. The scorer is fitted on at most about
``TRAINING_ROWS`` labelled rows, picked by a hash of the id; equal texts count once. Null and empty texts score the base
value. Rows that repeat are scored alike; labels without an id or a value are left out, and several
labels of one id count as toxic if one is. Without labels every score is the base value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, U, chunks, mix, shared_broadcast, slices, small_batches
from .suffix_dedup import rolling

TRAINING_ROWS = 20_000
FOLDS = 5
BASE_SCORE = 0.05
LEAST_STRENGTH = 0.25  # features of less are not kept
TOXIC = 0.5  # a score of toxic texts; second readings look for features of that strength
MEMO = 30_000
MEMO_LETTERS = 64  # longer words are decoded anew each time

# Letters that a sign can stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c",
}
# Channel log-probabilities.
SUBSTITUTED, COLLAPSED, PAIR_COLLAPSED, DROPPED, KEPT_SIGN, UNSPACED, KEPT_SPACE = -1.5, -1.0, -2.5, -4.0, -8.0, -0.5, -3.0
TRACE = re.compile(
    r"[^\W\d_][0-9@$€]|[0-9@$€!|+(](?=[^\W\d_])"  # a letter beside a sign
    r"|([^\W\d_])\1\1"  # a letter three times
    r"|(?<!\S)\w(?:[ .*_-]\w){2,}(?![^\s.,;:!?])")  # letters spaced out
PART = re.compile(r"[^\W\d_]+")
GAP = re.compile(r"(?:[^\w]|_){1,3}(?=[^\W\d_])")  # signs or spaces between the parts of a word
SPLIT = (0.0, -1.0)  # log-probabilities of a kept and of a dropped gap between parts
HEAD = 4  # letters of a feature that a second reading needs
EDGE = re.compile(r"\A(?:([^\w\s])\1+)|(?:([^\w\s])\2+)\Z")

# Symbols of the language model: 0 ends words, a-z, the letters U+00DF to U+00FF, any other letter.
SYMBOLS = 61
LATIN = np.zeros(0x250, np.uint8)
LATIN[97:123] = np.arange(1, 27)
LATIN[0xDF:0x100] = np.arange(27, 60)
LATIN[[0xF7]] = 0
LATIN[0x100:] = 60


def symbols_of(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(code < len(LATIN), LATIN[np.minimum(code, len(LATIN) - 1)], 60).astype(np.int32)


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigram counts over the lower-cased texts of all rows; at most ``SYMBOLS``**3 rows are collected."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in slices(batches, "text", CHUNK):
            for _, group in chunks((t or "" for t in batch["text"].to_pylist()), 1 << 20):
                s = np.concatenate([[0, 0], symbols_of("\0\0".join(group).lower()), [0]])
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = small_batches(docs).select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    for r in rows:
        counts[r["gram"]] = r["n"]
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of a symbol after two others, smoothed by shorter contexts."""
    one = counts.sum((0, 1)) + 1
    two = counts.sum(0) + 5 * one / one.sum()
    two = two / two.sum(1, keepdims=True)
    three = counts + 5 * two
    return np.log(three / three.sum(2, keepdims=True)).astype(np.float32)


class Decoder:
    """Viterbi decoding of words under a language model."""

    def __init__(self, model: np.ndarray, targets: frozenset[bytes] = frozenset()) -> None:
        self.model = model.tolist()
        self.memo: dict[tuple[str, bool], str] = {}
        self.symbol = lru_cache(None)(lambda c: int(symbols_of(c)[0]))
        self.targets = {t for t in targets if len(t) >= HEAD}
        self.longest = max(map(len, self.targets), default=0)
        self.heads = np.zeros(1 << 6 * HEAD, bool)
        for t in self.targets:
            self.heads[sum(x << 6 * (HEAD - 1 - i) for i, x in enumerate(t[:HEAD]))] = True
        self.hashes = {}
        for size in {len(t) for t in self.targets}:
            every = np.frombuffer(b"".join(t for t in self.targets if len(t) == size), np.uint8)
            at = np.arange(0, len(every), size)
            self.hashes[size] = np.sort(rolling().spans(rolling().prefix(every), at, at + size))

    def options(self, sign: str, run: int, spaced: bool, split: bool = False) -> list[tuple[str, float]]:
        """What a run of one sign may stand for, with its channel log-probability."""
        if self.symbol(sign):
            letters = [(sign, 0.0)]
        elif sign in LOOKS_LIKE:
            letters = [(x, SUBSTITUTED) for x in LOOKS_LIKE[sign]]
        elif split:
            return [(sign * run, SPLIT[0]), ("", SPLIT[1])]
        else:
            return [(sign * run, KEPT_SPACE if spaced else 0.0), ("", UNSPACED if spaced else DROPPED)]
        if run == 1:
            out = letters
        elif run == 2:
            out = [o for x, c in letters for o in ((x + x, c), (x, c + PAIR_COLLAPSED))]
        else:
            out = [o for x, c in letters for o in ((x, c + COLLAPSED), (x + x, c + COLLAPSED))]
        return out if self.symbol(sign) else [*out, (sign * run, KEPT_SIGN), *([] if sign.isdigit() else [("", DROPPED)])]

    def decode(self, word: str, split: bool = False) -> str:
        if (known := self.memo.get((word, split))) is not None:
            return known
        spaced = " " in word or all(len(p) < 2 for p in re.split(r"[.*_-]", word))
        states, last = {(0, 0): (0.0, "")}, ""
        for m in re.finditer(r"(.)\1*", word, re.S):
            nexts: dict[tuple[int, int], tuple[float, str]] = {}
            letters = LOOKS_LIKE.get(m[1], m[1])
            again = [("", COLLAPSED)] if set(letters) & set(last) else []  # the letter before in another guise
            last = letters
            for out, cost in self.options(m[1], len(m[0]), spaced, split) + again:
                ids = [self.symbol(c) for c in out]
                for (a, b), (score, text) in states.items():
                    score += cost
                    for c in ids:
                        if c or b:  # signs in a row end one word once
                            score += self.model[a][b][c]
                        a, b = (b, c) if c else (0, 0)
                    if score > nexts.get((a, b), (-1e30, ""))[0]:
                        nexts[a, b] = (score, text + out)
            states = nexts
        best = max((s + (self.model[a][b][0] if b else 0.0), t) for (a, b), (s, t) in states.items())[1]
        if len(self.memo) < MEMO and len(word) <= MEMO_LETTERS:
            self.memo[word, split] = best
        return best

    def restored(self, texts: list[str]) -> list[str]:
        """Each text lower-cased with every suspicious word decoded, and second readings in lines of their own."""
        texts = [self.replaced(t.lower()) for t in texts]
        out, ends = [], np.cumsum([len(t) + 1 for t in texts])
        at = self.places("\n".join(texts))
        own = np.searchsorted(ends, at, side="right")
        cut = np.searchsorted(own, np.arange(len(texts) + 1))
        for i, t in enumerate(texts):
            here = at[cut[i]:cut[i + 1]] - (ends[i] - len(t) - 1)
            out.append("\n".join([t, *sorted(self.readings(t, here.tolist()))]))
        return out

    def readings(self, text: str, places: list[int]) -> set[str]:
        """Second readings of the places that begin like a target once gaps and repeats are left out."""
        out: set[str] = set()
        for at in places:
            end, letters, parts, hit = at, [], 0, 0
            while m := PART.match(text, end):
                parts, end = parts + 1, m.end()
                last = 0
                for x in map(self.symbol, m[0]):
                    if x != last:
                        letters.append(x)
                    if len(letters) == self.longest:
                        break
                    last = x
                known = [n for n in range(hit + 1, min(len(letters), self.longest) + 1) if bytes(letters[:n]) in self.targets]
                if known:
                    hit = known[-1]
                    word = text[at:end]
                    if (parts > 1 or len(letters) < len(m[0])) and (read := self.decode(word, parts > 1)) != word:
                        out.add(read)
                if len(letters) >= self.longest or not (gap := GAP.match(text, end)):
                    break
                end = gap.end()
        return out

    def places(self, text: str) -> np.ndarray:
        """Beginnings of words from which on the next letters, with gaps or repeats left out, are a target."""
        if not self.targets:
            return np.zeros(0, np.int64)
        s = symbols_of(text).astype(np.uint8)
        before = np.concatenate([[0], s[:-1]])
        first = (s > 0) & (before == 0)
        keep = np.flatnonzero(first | ((s > 0) & (s != before)))
        n = len(keep) - HEAD + 1
        if n < 1:
            return np.zeros(0, np.int64)
        t = s[keep]
        code = sum(t[i:i + n].astype(np.int32) << 6 * (HEAD - 1 - i) for i in range(HEAD))
        at = np.flatnonzero(self.heads[code] & first[keep[:n]])
        if not len(at):
            return at
        hit, prefix = np.zeros(len(at), bool), rolling().prefix(t)
        for size, known in self.hashes.items():
            end = at + size
            may = np.flatnonzero((end <= len(keep)) & (keep[np.minimum(end, len(keep)) - 1] - keep[at] >= size))  # not as it stands
            h = rolling().spans(prefix, at[may], end[may])
            hit[may] |= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        return keep[at[hit]]

    def replaced(self, text: str) -> str:
        out, end = [], 0
        for m in TRACE.finditer(text):
            a, b = m.span()
            if a < end:
                continue
            while a > end and not text[a - 1].isspace():
                a -= 1
            while b < len(text) and not text[b].isspace():
                b += 1
            word = text[a:b]
            core = EDGE.sub("", word)  # repeated signs at an end are decoration
            core, tail = (core, "") if (cut := len(core.rstrip(".,;:!?)\"'"))) == len(core) else (core[:cut], core[cut:])
            out += [text[end:a], (self.decode(core) if TRACE.search(core) else core) + tail]
            end = b
        return "".join([*out, text[end:]]) if out else text


WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[97:123] = True
WORD_BYTE[128:] = True
BEGINNINGS = (4, 5, 6, 7)


class Words:
    """Words of a list of texts, their hashed beginnings and their texts' numbers."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        inside = WORD_BYTE[data].view(np.int8)
        edge = np.diff(np.concatenate([[0], inside, [0]]))
        self.start, self.stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = np.array([len(t) + 1 for t in texts])
        self.text = np.searchsorted(np.cumsum(size), self.start, side="right")
        self.prefix = rolling().prefix(data)

    def head(self) -> np.ndarray:
        """Hash of the first four bytes (of all of a shorter word)."""
        return rolling().spans(self.prefix, self.start, np.minimum(self.start + 4, self.stop))

    def features(self, pick: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word numbers, hashes, bytes): whole words, then beginnings by length."""
        yield pick, mix(rolling().spans(self.prefix, self.start[pick], self.stop[pick]) + U(1)), self.stop[pick] - self.start[pick]
        for n in BEGINNINGS:
            long = pick[self.stop[pick] - self.start[pick] >= n]
            yield long, mix(rolling().spans(self.prefix, self.start[long], self.start[long] + n) + U(n)), np.full(len(long), n)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def training_labels(labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, toxic) outside the held-out fold; all of them, or a hash-picked share of about ``limit`` rows."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    share = min(1.0, limit / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def target(feature: bytes) -> bytes:
    """The symbols of a feature, repeats left out; nothing where it is cut inside a letter."""
    s = symbols_of(feature.decode("utf-8", "ignore"))
    return bytes(s[np.concatenate([[True], s[1:] != s[:-1]])].astype(np.uint8)) if len(s) else b""


def fit(docs: DataFrame, labels: DataFrame, model, limit: int = TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, frozenset[bytes]]:
    """(hashes, strengths, first-four-byte hashes, second readings' targets) of the features that mark toxic texts.

    A feature's strength is a cautious estimate of the share of toxic rows among the rows that have it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model.value)
        for batch in slices(batches, "text", CHUNK):
            toxic = batch["toxic"].to_numpy(zero_copy_only=False).astype(bool)
            texts = [t.encode() for t in decoder.restored(["" if t is None else t for t in batch["text"].to_pylist()])]
            for first, group in chunks(texts):
                words = Words(group)
                head, pick = words.head(), np.arange(len(words.start))
                at, key, length = (np.concatenate(x) for x in zip(*words.features(pick), strict=True))
                order = np.lexsort((words.text[at], key))
                at, key = at[order], key[order]
                text = words.text[at]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])]) if len(key) else np.zeros(0, bool)
                at, key = at[new], key[new]
                edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else at
                bad = toxic[first + words.text[at]].astype(np.int64)
                n = np.diff(np.concatenate([edge, [len(key)]])).astype(np.int64)
                t = np.add.reduceat(bad, edge) if len(edge) else n
                whole = b"\n".join(group)
                size = length[order][new][edge] if len(edge) else edge
                said = [whole[a:a + m] if b else None for a, m, b in zip(words.start[at[edge]].tolist(), size.tolist(), t.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key[edge].view(np.int64)), pa.array(head[at[edge]].view(np.int64)),
                                                  pa.array(t), pa.array(n), pa.array(said, pa.binary())], ["key", "head", "bad", "n", "said"])

    sample = F.broadcast(training_labels(labels, limit))  # about ``limit`` rows at most
    # A text that many rows repeat says as much as one row.
    rows = docs.select("doc_id", "text").join(sample, "doc_id").groupBy(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).agg(
        F.first("text").alias("text"), (F.max("toxic") == 1).alias("toxic")).select("text", "toxic")
    counts = rows.mapInArrow(run, "key bigint, head bigint, bad bigint, n bigint, said binary").groupBy("key").agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.min("head").alias("head"), F.max("said").alias("said"))
    strength = (F.col("bad") - F.sqrt("bad")) / (F.col("n") + 1)
    strong = counts.select("key", "head", "said", strength.alias("p")).where(F.col("p") >= LEAST_STRENGTH).collect()  # bounded by the sample
    key = np.array([r["key"] for r in strong], np.int64).view(np.uint64)
    order = np.argsort(key)
    heads = np.unique(np.array([r["head"] for r in strong], np.int64).view(np.uint64))
    return key[order], np.array([r["p"] for r in strong])[order], heads, frozenset(target(bytes(r["said"])) for r in strong if r["p"] >= TOXIC)


def score(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS, corpus: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; the language model counts ``corpus`` (``docs`` if not given).

    Columns of ``docs`` that bear these names are replaced.
    """
    spark = docs.sparkSession
    model = shared_broadcast(spark, language_model(count_trigrams(corpus if corpus is not None else docs)))
    fitted = shared_broadcast(spark, fit(docs, labels, model, limit))
    own = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, strength, heads, targets = fitted.value
        decoder = Decoder(model.value, targets)
        for batch in slices(batches, "text", CHUNK):
            best = np.full(batch.num_rows, BASE_SCORE)
            texts = [t.encode() for t in decoder.restored(["" if t is None else t for t in batch["text"].to_pylist()])] if len(keys) else []
            for first, group in chunks(texts):
                words = Words(group)
                head = words.head()
                pick = np.flatnonzero(heads[np.minimum(np.searchsorted(heads, head), len(heads) - 1)] == head)
                for at, key, _ in words.features(pick):
                    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    hit = keys[place] == key
                    np.maximum.at(best, first + words.text[at[hit]], strength[place[hit]])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), pa.array(best), pa.array((best >= TOXIC).astype(np.int32))],
                                             [*own, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema), "score double, predicted int"])
    return docs.select(*own).mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic, all columns as they were."""
    kept = docs.withColumnsRenamed({c: f"_own_{c}" for c in ("score", "predicted")})
    out = score(kept, labels).where("predicted = 0").drop("score", "predicted")
    return out.withColumnsRenamed({f"_own_{c}": c for c in ("score", "predicted")}).select(*docs.columns)
