"""Exact set similarity join of word shingles by partitioning the universe.

Documents with equal sets are one class. The shingles' universe is hashed into segments, as many as
the largest set difference in a size band plus one: two similar sets then agree in a segment, by the
pigeonhole principle. A segment costs one signature, the hash of the set's part in it. Parts that
are empty would agree everywhere and are allotted nothing; a few wide segments make up for that:
they count twice, because they are indexed with their one-deletion neighbourhoods. A set with more
empty parts than they make up for indexes the empty ones as well, so that no link is lost.

A set is indexed in its own band and in that of the largest set it can link with. Signatures that
two or more classes share make candidates. Shingles that no other candidate has bound each pair's
overlap. Each candidate is first verified against its most frequent pivot. What the links leave
apart within a signature is paired by rare shingles: of two sets in different components, the first
common shingle, the rarest first, must come so early that enough can follow. All pairs that pass are
verified by intersecting the whole sets of 64-bit shingle hashes.

Words: A-Z lower-cased, runs between ASCII white space. A text of fewer than ``shingle`` words is one
shingle; null and empty texts have none and link with nothing. Repeated rows share a class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import U, chunks, let_go, mix, parts, ranges, slices, small_batches, texts_of, trimmed, unused, written
from .components import components
from .suffix_dedup import rolling

SHINGLE = 4
PERCENT = 85
CHUNK = 1 << 18  # bytes of text in hand at once: a task's arrays are about forty times as large
BUCKET_BYTES = 4 << 20  # of text a bucket of signatures or tokens; a task's arrays are about fifteen times as large
FAN = 512  # lots into which a task cuts the entries in hand
HELD = 1 << 19  # entries in hand, about: a thousand for each lot
SEEN = 100_000  # classes a task remembers, so as to deal copies once
LOW = np.uint64(2**48 - 1)
WIDE = 5  # half widths of a wide segment; a plain one has 2
I8, U8 = np.int64, np.uint64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    words = [t.translate(LOWER).split() for t in texts]
    n = np.array([len(w) for w in words], I8)
    held = [b" ".join(w) for w in words if w]
    if not held:
        return [np.zeros(0, U8)] * len(texts)
    data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
    stop = np.flatnonzero((data == 32) | (data == 10))
    start = np.concatenate([[0], stop[:-1] + 1])
    first = np.cumsum(n) - n
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    at = ranges(first, count)
    last = at + np.repeat(np.minimum(n, shingle), count) - 1
    h = rolling().spans(rolling().prefix(data), start[at], stop[last])
    ends = np.cumsum(count).tolist()
    return [np.unique(h[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def class_of(s: np.ndarray) -> int:
    """64-bit digest of a set (as a signed number)."""
    return int(mix((mix(s + U(0x5851F42D)).sum(dtype=U8) + U(len(s))).reshape(1)).view(I8)[0])


class Bands:
    """Size bands of a threshold: [low, high] with high about low / threshold."""

    def __init__(self, percent: int) -> None:
        self.percent, self.low = percent, [1]

    def of(self, size: np.ndarray) -> np.ndarray:
        while self.low[-1] <= size.max(initial=1):
            self.low.append(self.low[-1] * 100 // self.percent + 1)
        return np.searchsorted(np.array(self.low), size, side="right") - 1

    def largest_partner(self, size: np.ndarray) -> np.ndarray:
        return size * 100 // self.percent

    def plan(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments, wide ones among them, and the empty parts these make up for."""
        high = np.array([x * 100 // self.percent for x in self.low])[band]
        differ = 2 * high * (100 - self.percent) // (100 + self.percent)
        empty = (differ + 1) * np.exp(-high * self.percent / 100 / (differ + 1))
        slack = np.where(differ > 0, np.ceil(empty + 4 * np.sqrt(empty)), 0).astype(I8)
        slack = np.minimum(slack, differ + 1)
        return differ + 1, slack, slack


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set number); the lowest bit tells a one-deletion neighbour from a whole part."""
    size = np.array([len(s) for s in sets], I8)
    flat = np.concatenate(sets) if sets else np.zeros(0, U8)
    begin = np.cumsum(size) - size
    own = bands.of(size)
    far = bands.of(bands.largest_partner(size))
    sigs, which = [], []
    for band, ids in ((own, np.flatnonzero(size > 0)), (far, np.flatnonzero((size > 0) & (far > own)))):
        if not len(ids):
            continue
        b, n = band[ids], size[ids]
        segments, wide, slack = bands.plan(b)
        plain = segments - wide
        base = np.cumsum(segments) - segments
        doc = np.repeat(np.arange(len(ids)), n)
        token = flat[ranges(begin[ids], n)]
        width = (2 * plain + WIDE * wide)[doc]
        place = ((mix(token ^ mix(b.astype(U8) + U(77))[doc]) >> U(32)).astype(I8) * width) >> 32
        seg = np.where(place < 2 * plain[doc], place >> 1, plain[doc] + (place - 2 * plain[doc]) // WIDE)
        at = base[doc] + seg
        value, total = mix(token + U(0x2545F491)), np.zeros(int(segments.sum()), U8)
        np.add.at(total, at, value)
        count = np.bincount(at, minlength=len(total))
        owner = np.repeat(np.arange(len(ids)), segments)
        number = np.arange(len(total)) - base[owner]
        tag = mix((b[owner].astype(U8) << U(32)) + number.astype(U8))
        is_wide = number >= plain[owner]
        empty = (count == 0) & ~is_wide
        many = np.bincount(owner[empty], minlength=len(ids)) > slack
        keep = np.flatnonzero(~empty | many[owner])
        sigs.append(mix(total[keep] ^ tag[keep]) & ~U(1))
        which.append(ids[owner[keep]])
        drop = np.flatnonzero(is_wide[at])
        sigs.append(mix((total[at[drop]] - value[drop]) ^ tag[at[drop]]) | U(1))
        which.append(ids[doc[drop]])
    if not sigs:
        return np.zeros(0, U8), np.zeros(0, I8)
    return np.concatenate(sigs), np.concatenate(which)


def packed(sig: np.ndarray) -> bytes:
    """The low 48 bits of signatures: chance equals only add candidates, which are verified."""
    return np.ascontiguousarray(sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _summary(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t", CHUNK):
            n, c = [], []
            for _, group in chunks(texts_of(batch["_t"]), CHUNK):
                for s in shingle_sets(group, shingle):
                    n.append(len(s))
                    c.append(class_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["_k"], pa.array(n, pa.int64()), pa.array(c, pa.int64())],
                                             ["doc_id", "_k", "n_shingles", "cls"])
    return run


PACKED = "lot int, known binary, counts binary, held binary"


def dealt(to: np.ndarray, cls: np.ndarray, value: np.ndarray, lots: int) -> pa.Table:
    """Entries (cls, value) packed by lot, one row each: the classes in turn, how many values each has, the values."""
    order = np.argsort(to.astype(np.uint16 if lots <= 65536 else I8), kind="stable")
    to, cls, value = to[order], cls[order], value[order]
    edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else []
    rows = []
    for i, j in zip(edge, [*edge[1:], len(to)], strict=True):
        c = cls[i:j]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        counts = np.diff(np.concatenate([first, [j - i]]))
        rows.append((int(to[i]), c[first].tobytes(), counts.astype(np.uint32).tobytes(), packed(value[i:j])))
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.table(dict(zip(("lot", "known", "counts", "held"), (
        pa.array(c, k) for c, k in zip(columns, (pa.int32(), *[pa.binary()] * 3), strict=True)), strict=True)))


def entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(cls, value) of packed rows."""
    known, counts, held = (b"".join(table[c].to_pylist()) for c in ("known", "counts", "held"))
    return np.repeat(np.frombuffer(known, I8), np.frombuffer(counts, np.uint32)), unpacked(held)


class Deal:
    """Entries of equal key meet in one of ``buckets`` groups, of which none is large.

    Whoever deals cuts what it holds into at most ``fan`` lots, a row each. More buckets than that
    take another level: groups of about a bucket's size, some of a lot, are cut again. So the rows of
    each level grow with the entries, not with the entries times the buckets.
    """

    def __init__(self, buckets: int, by_class: bool = False, fan: int = FAN, held: int = HELD) -> None:
        self.fan, self.by_class, self.held = fan, by_class, held
        self.levels = 1
        while fan**self.levels < buckets:
            self.levels += 1
        self.buckets = buckets

    def place(self, cls: np.ndarray, value: np.ndarray) -> np.ndarray:
        key = mix(cls.view(U8)) if self.by_class else mix(value >> U(1))
        return (key % U(self.buckets)).astype(I8)

    def first(self, cls: np.ndarray, value: np.ndarray) -> pa.Table:
        return dealt(self.place(cls, value) % self.fan, cls, value, self.fan)

    def held_back(self, pieces: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Pieces of entries, dealt as soon as many are in hand."""
        cls, value, n = [], [], 0
        for c, v in pieces:
            cls.append(c)
            value.append(v)
            n += len(v)
            if n >= self.held:
                yield from self.first(np.concatenate(cls), np.concatenate(value)).to_batches()
                cls, value, n = [], [], 0
        if n:
            yield from self.first(np.concatenate(cls), np.concatenate(value)).to_batches()

    def met(self, rows: DataFrame) -> DataFrame:
        """The first level's rows, dealt on until a lot is a bucket."""
        for level in range(1, self.levels):
            lots = min(self.buckets, self.fan**level)
            pieces = -(-self.buckets // lots)
            rows = rows.withColumn("_p", F.pmod(F.xxhash64("known", "counts"), F.lit(pieces))).groupBy("lot", "_p").applyInArrow(
                trimmed(self.again(level)), PACKED)
        return rows

    def again(self, level: int) -> Callable:
        def run(key, table):
            cls, value = entries(table)
            low = self.fan**level
            lot, digit = key[0].as_py(), self.place(cls, value) // low % self.fan
            out = dealt(digit, cls, value, self.fan)
            return out.set_column(0, "lot", pa.array(out["lot"].to_numpy().astype(I8) * low + lot, pa.int32()))
        return run


def _index(shingle: int, percent: int, deal: Deal):
    bands = Bands(percent)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        seen: set[int] = set()
        for batch in slices(batches, "_t", CHUNK):
            for _, group in chunks(texts_of(batch["_t"]), CHUNK):
                fresh = {c: s for s in shingle_sets(group, shingle) if len(s) and (c := class_of(s)) not in seen}
                seen.update(fresh)
                sig, which = signatures(list(fresh.values()), bands)
                order = np.argsort(which, kind="stable")
                yield np.array(list(fresh), I8)[which[order]], sig[order] & LOW
                if len(seen) > SEEN:
                    seen.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from deal.held_back(pieces(batches))
    return run


def _shared(key, table):
    """Members (sig, cls) of the signatures that two or more classes share, one of them whole."""
    cls, sig = entries(table)
    order = np.argsort(sig)
    sig = sig[order]
    group = sig >> U(1)
    same = np.concatenate([[False], group[1:] == group[:-1], [False]])
    some = np.flatnonzero(same[1:] | same[:-1])  # rows that aren't alone
    sig, cls = sig[some], cls[order[some]]
    group = sig >> U(1)
    order = np.lexsort((sig, cls, group))
    group, cls, part = group[order], cls[order], (sig[order] & U(1)) == 1
    if len(group):
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (cls[1:] != cls[:-1])])  # whole parts sort first
        group, cls, part = group[new], cls[new], part[new]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        count = np.diff(np.concatenate([first, [len(group)]]))
        good = np.repeat((count > 1) & ~np.logical_and.reduceat(part, first), count)
        group, cls = group[good], cls[good]
    return pa.table({"sig": pa.array(group.view(I8)), "cls": pa.array(cls)})


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t", CHUNK):
            sets = [s for _, g in chunks(texts_of(batch["_t"]), CHUNK) for s in shingle_sets(g, shingle)]
            yield pa.RecordBatch.from_arrays([batch["cls"], pa.array([s.view(I8) for s in sets], pa.list_(pa.int64()))], ["cls", "tokens"])
    return run


def _tokens(deal: Deal):
    """Tokens of the candidates' sets, dealt by hash; chance equals of 48 bits only leave fewer alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from deal.held_back(
            (np.repeat(b["cls"].to_numpy(), pa.compute.list_value_length(b["tokens"]).to_numpy()), b["tokens"].flatten().to_numpy().view(U8) & LOW)
            for b in slices(batches, "tokens"))
    return run


def _alone(deal: Deal):
    """How many tokens of each class no other candidate has, in one bucket; dealt by class."""
    def run(key, table):
        cls, token = entries(table)
        order = np.argsort(token)
        t = token[order]
        same = np.concatenate([[False], t[1:] == t[:-1], [False]])
        known, n = np.unique(cls[order[~(same[1:] | same[:-1])]], return_counts=True)
        return deal.first(known, n.astype(U8))
    return run


def _summed(key, table):
    cls, n = entries(table)
    known, place = np.unique(cls, return_inverse=True)
    return pa.table({"cls": pa.array(known), "u": pa.array(np.bincount(place, n.astype(I8), len(known)).astype(I8))})


def _may_link(percent: int):
    """Whether sizes and lone tokens of a pair (a, b) leave room for a link."""
    room = F.least(F.col("na") - F.col("ua"), F.col("nb") - F.col("ub"))
    return room * (100 + percent) >= (F.col("na") + F.col("nb")) * percent


def _rare_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``sets`` (cls, tokens, n, label) with different labels that can still link.

    Only tokens found under two labels can be common; the others take the first places of a set, the
    rest follow from rare to frequent. The first common token of a pair needs room behind it.
    """
    tokens = sets.select("cls", "n", "label", F.explode("tokens").alias("t"))
    often = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("_l"), F.max("label").alias("_h"))
    common = tokens.join(often.where("_l < _h").select("t", "df"), "t")
    line = Window.partitionBy("cls").orderBy("df", "t")
    placed = common.withColumns({"_r": F.row_number().over(line), "_s": F.count(F.lit(1)).over(Window.partitionBy("cls"))})
    placed = placed.select("cls", "n", "label", "t", (F.col("n") - F.col("_s") + F.col("_r") - 1).alias("at"))
    early = written(placed.where((F.col("n") - F.col("at")) * 100 >= F.col("n") * percent))

    def side(x: str) -> DataFrame:
        return early.select("t", *[F.col(c).alias(d + x) for c, d in (("cls", ""), ("n", "n"), ("label", "l"), ("at", "p"))])

    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    fits = (F.col("la") < F.col("lb")) & (room * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    return side("a").join(side("b"), "t").where(fits).select("a", "b").distinct()


def link_classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bucket_bytes: int = BUCKET_BYTES,
                 fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(summary, links): ``summary`` has (doc_id, _k, n_shingles, cls) for every row, ``links`` has the
    verified pairs (a, b) of classes that connect all that is connected."""
    spark = docs.sparkSession
    rows = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("_t")).withColumn("_k", F.xxhash64("doc_id", "_t"))
    summary = materialize(rows.mapInArrow(_summary(shingle), "doc_id bigint, _k bigint, n_shingles bigint, cls bigint"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = int(max(parts(docs), -(-size // bucket_bytes)))
    deal, sums = Deal(buckets, fan=fan), Deal(buckets, True, fan)
    index = rows.select("_t").mapInArrow(_index(shingle, percent, deal), PACKED)
    members = written(deal.met(index).groupBy("lot").applyInArrow(trimmed(_shared), "sig bigint, cls bigint"))
    let_go(spark)
    # Whole sets of the candidates, from one row of each class.
    reps = members.select("cls").distinct().join(
        summary.groupBy("cls").agg(F.min_by("_k", F.struct("doc_id", "_k")).alias("_k")), "cls")
    texts = rows.select("_k", "_t").join(reps, "_k").dropDuplicates(["_k"])  # dealt by _k already
    sets = written(texts.select("cls", "_t").mapInArrow(_sets(shingle), "cls bigint, tokens array<bigint>"))
    let_go(spark)
    alone = deal.met(sets.mapInArrow(_tokens(deal), PACKED)).groupBy("lot").applyInArrow(trimmed(_alone(sums)), PACKED)
    alone = sums.met(alone).groupBy("lot").applyInArrow(trimmed(_summed), "cls bigint, u bigint")
    stats = sets.select("cls", F.size("tokens").cast("long").alias("n")).join(alone, "cls", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    # A class that shares too few tokens with all others has no link.
    stats = stats.where((F.col("n") - F.col("u")) * 100 >= F.col("n") * percent)
    members = written(members.join(stats, "cls"))
    let_go(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta"))
        right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb"))
        both = pairs.select("a", "b").join(left, "a").join(right, "b")
        common = F.size(F.array_intersect("ta", "tb"))
        return both.where(common * (100 + percent) >= (F.size("ta") + F.size("tb")) * percent).select("a", "b")

    # The pivot of a signature is the member with the smallest share of lone tokens.
    pivot = members.groupBy("sig").agg(F.min_by(F.struct("cls", "n", "u"), F.struct(F.col("u") / F.col("n"), "cls")).alias("p"))
    near = members.join(pivot, "sig").where("cls != p.cls").select(
        F.col("cls").alias("a"), F.col("n").alias("na"), F.col("u").alias("ua"),
        F.col("p.cls").alias("b"), F.col("p.n").alias("nb"), F.col("p.u").alias("ub"))
    best = near.where(_may_link(percent)).groupBy("a", "b").count().groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
    links = materialize(verified(best))
    let_go(spark)
    labels = components(links)
    placed = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    # Signatures whose members the links have not joined.
    apart = placed.groupBy("sig").agg(F.min("label").alias("_l"), F.max("label").alias("_h")).where("_l < _h").select("sig")
    apart = placed.join(apart, "sig").groupBy("cls").agg(F.min("n").alias("n"), F.min("label").alias("label"))
    more = verified(_rare_pairs(sets.join(written(apart), "cls"), percent))
    links = materialize(links.unionByName(more))
    let_go(spark)
    return summary, links


def _placed(docs: DataFrame, shingle: int, percent: int, **dealing: int) -> DataFrame:
    summary, links = link_classes(docs, shingle, percent, **dealing)
    labels = components(links)
    classes = summary.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("_d"))
    named = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = materialize(named)
    least = named.groupBy("label").agg(F.min("_d").alias("component_id"))
    of = named.join(least, "label").select("cls", "component_id")
    return summary.join(of, "cls", "left").select("doc_id", "_k", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def join_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, **dealing: int) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest id it reaches by links) of every row."""
    return _placed(docs, shingle, percent, **dealing).drop("_k")


def keep_firsts(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; all columns stay.

    Rows that share id and text are one document. A null id gives way to any other.
    """
    firsts = _placed(docs, shingle, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("_k").distinct()
    name = unused("_first", docs)
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")).cast("binary"))
    return docs.join(firsts.withColumnRenamed("_k", name), key == F.col(name), "left_semi")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS t FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id != b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, m), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)
"""
