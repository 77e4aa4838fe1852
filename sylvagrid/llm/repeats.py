"""Removal of long repeats: the data flow that the byte and the word operator share.

A rule says what a unit is (a byte, a word), which positions of a text are anchors, and how a set
of text pieces is matched. Then:

1. Documents are dealt once into row buckets of bounded size. Whole copies are found by digest;
   only the first of them goes on.
2. A row bucket sends each of its anchors once, with the number of its rows, to the bucket of the
   anchor's hash. Anchors that two or more rows share are sent back, each with the smallest of
   those rows, its leader.
3. Around shared anchors each row cuts the pieces that can hold a match. Neighbouring pieces with
   one leader are one piece. Pieces go to their leader's bucket and are matched there.
4. An anchor of more than ``HOT`` rows has no leader. Its windows (all strings of ``least`` units
   that hold it) are told apart inside the row bucket, and each goes on once, as a hash with its
   smallest and largest document, to the bucket of that hash. The texts of windows that different
   documents share follow the same way and are compared; the smallest document comes back.
5. Covered units go back to the rows, which remove them.

Equal matches always share an anchor, so they have one leader or one window and meet. What a
task holds of one passage is one entry per row bucket, never one per row. Between the steps only
packed numbers, candidate pieces and shared windows move; the exchange of the documents is planned
once and read four times.

A row is known by a hash of id and text: rows that repeat both are one row. A null id counts as
larger than every other; a null text is empty.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, U, mix, parts, ranges, texts_of, trimmed, written

BUCKET_BYTES = 4 << 20
HOT = 1_000
I8, U8, U4 = np.int64, np.uint64, np.uint32

# What the steps send: to bucket g, from bucket b, packed numbers and texts.
SENT = "g int, kind int, b int, x binary, y binary, z binary, w binary, text binary"
COPIES, ANCHORS, PIECES, COVERED, WINDOWS, RUNS, SHARED, SHOWN, FIRST = range(9)

_hash: list[RollingHash] = []


def rolling() -> RollingHash:
    """One set of power tables per worker."""
    if not _hash:
        _hash.append(RollingHash())
    return _hash[0]


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[column].to_pylist()), kind)


def _split(by: np.ndarray, order: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Places of each value of ``by``, in the given order."""
    if not len(order):
        return []
    v = by[order]
    cut = np.flatnonzero(v[1:] != v[:-1]) + 1
    return [(int(v[s]), order[s:e]) for s, e in zip([0, *cut], [*cut, len(v)], strict=True)]


def _sent(g: int, kind: int, b: int, *columns: np.ndarray, text: bytes | None = None) -> tuple:
    packed = [c.tobytes() for c in columns]
    return (g, kind, b, *packed, *[None] * (4 - len(packed)), text)


def _table(rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    names = [f.split() for f in SENT.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(names, columns, strict=True)})


def _of(table: pa.Table, *kinds: int) -> pa.Table:
    return table.filter(pa.compute.is_in(table["kind"], pa.array(kinds, pa.int32())))


def _passed(table: pa.Table, *kinds: int) -> list[tuple]:
    """Messages of a bucket to itself, unchanged."""
    return [tuple(m.values()) for m in _of(table, *kinds).to_pylist()]


def _senders(table: pa.Table, column: str, width: int) -> np.ndarray:
    """The sending bucket of every number of a packed column."""
    return np.repeat(table["b"].to_numpy().astype(I8), [len(x) // width for x in table[column].to_pylist()])


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where a new group of equal sorted values begins."""
    if not len(columns[0]):
        return np.zeros(0, I8)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _occurrences(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, window number) of the windows that a bucket's runs stand for."""
    runs = _of(table, RUNS)
    r, s, u, n = (_joined(runs, c, U4).astype(I8) for c in "xyzw")
    return np.repeat(r, n), ranges(s, n), ranges(u, n)


def _firsts(left: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row keys of a bucket in order, and where each is found first: numbers the same in every step."""
    return np.unique(left["_k"].to_numpy(), return_index=True)


def remove_repeats(docs: DataFrame, rule, finish: Callable, added: dict[str, pa.DataType], keep: list[str],
                   bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """``keep`` columns of ``docs`` and what ``finish(text, ranges)`` says of every row.

    ``ranges`` are [start, stop) unit ranges to remove, sorted by start; they may overlap.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = int(max(parts(docs), -(-size // bucket_bytes)))
    kept = [c for c in keep if c != "text"]
    own = [f"_own{i}" for i in range(len(kept))]  # columns travel under names of our own
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(kept, own, strict=True)], F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_doc"), text.alias("_t"))
    rows = rows.withColumn("_k", F.xxhash64("_doc", "_t")).withColumn("_b", F.pmod("_k", F.lit(n)).cast("int"))
    keyed = rows.select("_b", "_k", "_doc", F.unhex(F.md5("_t")).alias("_m"))
    # Written first: the join then reads two shuffles of its own, and a digest that many rows share is split as skewed.
    several = written(keyed.groupBy("_m").agg(F.min("_doc").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    copies = keyed.join(several, "_m").where("_doc > _first").select(F.col("_b").alias("b"), F.col("_k").alias("k"))
    least, before, after = rule.least, rule.before, rule.after

    def live(left, copied):
        """Numbers of the rows that are no copies, and their anchors."""
        ks, at = _firsts(left)
        number = np.flatnonzero(~np.isin(ks, copied))
        keys, which, where = rule.anchors(texts_of(left["_t"].take(pa.array(at[number]))))
        return keys, number[which], where.astype(I8)

    def anchors(key, left, right):
        b, copied = key[0].as_py(), right["k"].to_numpy().astype(I8)
        keys, r, _ = live(left, copied)
        order = np.lexsort((r, keys))
        keys, r = keys[order], r[order]
        first = _edges(keys, r)
        keys, r = keys[first], r[first]
        first = _edges(keys)
        keys, low, count = keys[first], r[first].astype(U4), np.diff(np.concatenate([first, [len(keys)]])).astype(U4)
        to = (mix(keys) % U(n)).astype(np.int32)
        out = [_sent(a, ANCHORS, b, keys[i], low[i], count[i]) for a, i in _split(to, np.argsort(to, kind="stable"))]
        return _table([*out, _sent(b, COPIES, b, copied)] if len(copied) else out)

    def shared(key, table):
        found, out = _of(table, ANCHORS), _passed(table, COPIES)
        keys, count, b = _joined(found, "x", U8), _joined(found, "z", U4).astype(I8), _senders(found, "x", 8)
        order = np.argsort(keys, kind="stable")
        k, b, count = keys[order], b[order], count[order]
        r = (b << 32) | _joined(found, "y", U4)[order]
        first = _edges(k)
        if len(k):
            total, each = np.add.reduceat(count, first), np.diff(np.concatenate([first, [len(k)]]))
            lead = np.repeat(np.where(total > hot, -1, np.minimum.reduceat(r, first)), each)
            pick = np.flatnonzero(np.repeat(total > 1, each))
            out += [_sent(to, ANCHORS, 0, k[i], lead[i]) for to, i in _split(b, pick[np.argsort(b[pick], kind="stable")])]
        return _table(out)

    def windows(b, cutters, docs_of, r, start, stop):
        """Messages of the distinct windows that start in the given ranges of rows."""
        order = np.lexsort((start, r))
        r, start, stop = r[order], start[order], stop[order]
        place = ranges((r << 32) + start, stop - start)
        place = np.unique(place)
        r, s = place >> 32, place & 0xFFFFFFFF
        hashes, cuts = np.zeros(len(r), U8), []
        first = _edges(r)
        for i, e in zip(first.tolist(), [*first[1:].tolist(), len(r)], strict=True):
            flat, x, y = cutters[int(r[i])].places(s[i:e], least)
            hashes[i:e] = rolling().spans(rolling().prefix(np.frombuffer(flat, np.uint8)), x, y)
            cuts.append((i, e, flat, x, y))
        _, head, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        same = head[inverse]  # the first place with the same hash; with the same text but for clashes
        owner, x, y = np.zeros(len(r), I8), np.zeros(len(r), I8), np.zeros(len(r), I8)
        for c, (i, e, _, *ends) in enumerate(cuts):
            owner[i:e], x[i:e], y[i:e] = c, *ends
        flats, other = [c[2] for c in cuts], {}
        again = np.flatnonzero(same != np.arange(len(same)))
        to = same[again]
        for i, a, f, z, j, g, k, l in zip(again.tolist(), owner[again].tolist(), x[again].tolist(), y[again].tolist(),
                                          to.tolist(), owner[to].tolist(), x[to].tolist(), y[to].tolist(), strict=True):
            if flats[a][f:z] != flats[g][k:l]:
                same[i] = other.setdefault(flats[a][f:z], i)
        head, u = np.unique(same, return_inverse=True)
        low, high = np.full(len(head), 2**63 - 1, I8), np.full(len(head), -2**63, I8)
        np.minimum.at(low, u, docs_of[r])
        np.maximum.at(high, u, docs_of[r])
        hashes = hashes[head]
        to = (mix(hashes) % U(n)).astype(np.int32)
        out = [_sent(g, WINDOWS, b, hashes[i], low[i], high[i], i.astype(U4)) for g, i in _split(to, np.argsort(to, kind="stable"))]
        new = _edges(r, s - np.arange(len(s)), u - np.arange(len(u)))
        length = np.diff(np.concatenate([new, [len(r)]]))
        return [*out, _sent(b, RUNS, b, *(v.astype(U4) for v in (r[new], s[new], u[new], length)))]

    def pieces(key, left, right):
        b, out, found = key[0].as_py(), _passed(right, COPIES), _of(right, ANCHORS)
        if not len(found):
            return _table(out)
        known, leads = _joined(found, "x", U8), _joined(found, "y", I8)
        order = np.argsort(known)
        known, leads = known[order], leads[order]
        keys, r, p = live(left, _joined(_of(right, COPIES), "x", I8))
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[place] == keys
        r, p, lead = r[hit], p[hit], leads[place[hit]]
        ks, at = _firsts(left)
        used = np.unique(r)
        texts = dict(zip(used.tolist(), texts_of(left["_t"].take(pa.array(at[used]))), strict=True))
        docs_of = left["_doc"].to_numpy()[at]
        cutters = {i: rule.cutter(t) for i, t in texts.items()}
        length = np.zeros(len(ks), I8)
        length[used] = [c.units for c in cutters.values()]
        order = np.lexsort((p, lead, r))
        r, p, lead = r[order], p[order], lead[order]
        start, stop = np.maximum(p - before, 0), np.minimum(p + after, length[r])
        common = (lead < 0) & (stop - start >= least)
        if common.any():
            out += windows(b, cutters, docs_of, r[common], start[common], stop[common] - least + 1)
        r, lead, start, stop = (v[lead >= 0] for v in (r, lead, start, stop))
        if not len(r):
            return _table(out)
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (lead[1:] != lead[:-1]) | (start[1:] > stop[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(r)]]) - 1
        r, lead, start, stop = r[first], lead[first], start[first], stop[last]
        to = (mix(lead.view(U8)) % U(n)).astype(np.int32)
        for g, i in _split(to, np.lexsort((r, to))):
            i = i[stop[i] - start[i] >= least]
            if len(i):
                cut = [cutters[x].cut(s, e) for x, s, e in zip(r[i].tolist(), start[i].tolist(), stop[i].tolist(), strict=True)]
                out.append(_sent(g, PIECES, b, (b << 32) | r[i], docs_of[r[i]], start[i].astype(U4),
                                 np.array([len(c) for c in cut], U4), text=zstd.compress(b"".join(cut), 1)))
        return _table(out)

    def matched(key, table):
        out, found = _passed(table, COPIES, RUNS), _of(table, PIECES)
        if len(found):
            text = b"".join(zstd.decompress(t) for t in found["text"].to_pylist())
            r, doc, at = _joined(found, "x", I8), _joined(found, "y", I8), _joined(found, "z", U4).astype(I8)
            which, start, stop = rule.match(text, _joined(found, "w", U4).astype(I8), doc)
            r, start, stop = r[which], start + at[which], stop + at[which]
            out += [_sent(to, COVERED, 0, (r[i] & 0xFFFFFFFF).astype(U4), start[i].astype(U4), stop[i].astype(U4))
                    for to, i in _split(r >> 32, np.lexsort((start, r)))]
        found = _of(table, WINDOWS)
        if len(found):
            hashes = _joined(found, "x", U8)
            order = np.argsort(hashes, kind="stable")
            h, b, u = hashes[order], _senders(found, "x", 8)[order], _joined(found, "w", U4)[order]
            first = _edges(h)
            low, high = np.minimum.reduceat(_joined(found, "y", I8)[order], first), np.maximum.reduceat(_joined(found, "z", I8)[order], first)
            pick = np.flatnonzero(np.repeat(low < high, np.diff(np.concatenate([first, [len(h)]]))))
            out += [_sent(to, SHARED, 0, h[i], u[i]) for to, i in _split(b, pick[np.argsort(b[pick], kind="stable")])]
        return _table(out)

    def shown(key, left, right):
        """The texts of windows that documents seem to share."""
        b, out, found = key[0].as_py(), _passed(right, COPIES, COVERED, RUNS), _of(right, SHARED)
        if not len(found):
            return _table(out)
        hashes, wanted = _joined(found, "x", U8), _joined(found, "y", U4).astype(I8)
        order = np.argsort(wanted)
        hashes, wanted = hashes[order], wanted[order]
        r, s, u = _occurrences(right)
        place = np.minimum(np.searchsorted(wanted, u), len(wanted) - 1)
        hit = wanted[place] == u
        r, s, place = r[hit], s[hit], place[hit]
        at = _firsts(left)[1]
        doc = left["_doc"].to_numpy()[at][r]
        low, high = np.full(len(wanted), 2**63 - 1, I8), np.full(len(wanted), -2**63, I8)
        np.minimum.at(low, place, doc)
        np.maximum.at(high, place, doc)
        first = np.unique(place, return_index=True)[1]
        texts: list[bytes] = [b""] * len(wanted)
        order = first[np.argsort(r[first], kind="stable")]
        used = np.unique(r[order])
        cutters = dict(zip(used.tolist(), map(rule.cutter, texts_of(left["_t"].take(pa.array(at[used])))), strict=True))
        for x, i in _split(r, order):
            flat, start, stop = cutters[x].places(s[i], least)
            for j, f, z in zip(place[i].tolist(), start.tolist(), stop.tolist(), strict=True):
                texts[j] = flat[f:z]
        to = (mix(hashes) % U(n)).astype(np.int32)
        for g, i in _split(to, np.argsort(to, kind="stable")):
            cut = [texts[j] for j in i.tolist()]
            out.append(_sent(g, SHOWN, b, wanted[i].astype(U4), low[i], high[i], np.array([len(c) for c in cut], U4),
                             text=zstd.compress(b"".join(cut), 1)))
        return _table(out)

    def compared(key, table):
        """The smallest document of each window, for the buckets that have a larger one."""
        out, found = _passed(table, COPIES, COVERED, RUNS), _of(table, SHOWN)
        known: dict[bytes, int] = {}
        ids = []
        for m in found.select(["w", "text"]).to_pylist():
            text, end = zstd.decompress(m["text"]), np.cumsum(np.frombuffer(m["w"], U4).astype(I8))
            ids += [known.setdefault(text[a:z], len(known)) for a, z in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)]
        if ids:
            ids, b = np.array(ids, I8), _senders(found, "x", 4)
            low = np.full(len(known), 2**63 - 1, I8)
            np.minimum.at(low, ids, _joined(found, "y", I8))
            low, u = low[ids], _joined(found, "x", U4)
            pick = np.flatnonzero(low < _joined(found, "z", I8))
            out += [_sent(to, FIRST, 0, u[i], low[i]) for to, i in _split(b, pick[np.argsort(b[pick], kind="stable")])]
        return _table(out)

    def apply(key, left, right):
        ks, at = _firsts(left)
        number = np.searchsorted(ks, left["_k"].to_numpy())
        whole = set(_joined(_of(right, COPIES), "x", I8).tolist())
        sent, least_of = _of(right, COVERED), _of(right, FIRST)
        r, start, stop = (_joined(sent, c, U4).astype(I8) for c in "xyz")
        if len(least_of):
            u, low = _joined(least_of, "x", U4).astype(I8), _joined(least_of, "y", I8)
            order = np.argsort(u)
            u, low = u[order], low[order]
            row, s, v = _occurrences(right)
            place = np.minimum(np.searchsorted(u, v), len(u) - 1)
            hit = (u[place] == v) & (low[place] < left["_doc"].to_numpy()[at][row])
            r, start, stop = np.concatenate([r, row[hit]]), np.concatenate([start, s[hit]]), np.concatenate([stop, s[hit] + least])
        order = np.lexsort((start, r))
        r, start, stop = r[order], start[order], stop[order]
        low, high = np.searchsorted(r, number), np.searchsorted(r, number, side="right")
        columns = {c: [] for c in added}
        for t, k, a, z in zip(texts_of(left["_t"]), left["_k"].to_pylist(), low.tolist(), high.tolist(), strict=True):
            for c, v in zip(columns, finish(t, None if k in whole else (start[a:z], stop[a:z])), strict=True):
                columns[c].append(v)
        return pa.table({**{c: left[c] for c in own}, **{c: pa.array(v, added[c]) for c, v in columns.items()}})

    dealt = rows.groupBy("_b")
    sent = dealt.cogroup(copies.groupBy("b")).applyInArrow(trimmed(anchors), SENT).groupBy("g").applyInArrow(trimmed(shared), SENT)
    for in_rows, in_buckets in ((pieces, matched), (shown, compared)):
        sent = dealt.cogroup(sent.groupBy("g")).applyInArrow(trimmed(in_rows), SENT).groupBy("g").applyInArrow(
            trimmed(in_buckets), SENT)
    kinds = {pa.int64(): "bigint", pa.string(): "string"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema),
                        *(f"`{x}` {kinds[k]}" for x, k in added.items())])
    out = dealt.cogroup(sent.groupBy("g")).applyInArrow(trimmed(apply), schema)
    return out.select(*[F.col(o).alias(c) for c, o in zip(kept, own, strict=True)], *added)
