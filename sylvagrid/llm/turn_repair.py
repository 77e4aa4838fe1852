"""Repair of conversations whose turns were lost, emptied, cut, repeated or given a wrong role.

A sound conversation's role initials follow the grammar ``(s?(ua)+)?``. Its cheapest repair is found by
Wagner-Fischer alignment of its turns with the grammar's string of each feasible length, nearest length
first. The cheapest cost so far bounds the lengths still worth trying and the band of cells around the
diagonal that can still matter (Ukkonen); of equally cheap alignments the backtraced audit that is least
in ASCII order wins.

One conversation may hold a third of all turns. Turns are therefore sorted into ranges, and what lies of a
conversation in one range is aligned in segments of ``SEGMENT`` turns: for each state of the grammar before
it, with the alternating string of each feasible length, giving the cheapest way to each state after it.
Segments leave insertions at their end to the next one, so that no audit of a segment begins another, and
the least audits of neighbours joined are the least audit of both. Their tables join into one as sums of
costs do, so only a table per range and conversation is brought together. The repaired text is one ordered
stream per conversation and is passed on, or hashed, turn by turn without being held.

Nulls stand for one space. Turns go by turn number (nulls first), then role, then text; identical rows are
adjacent and the later ones duplicates. Rows without a conversation form one of their own. Blank turns
must go, so texts of any length cost the aligner nothing. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts, small_batches, written

# Costs of the edits: keep, rerole, delete, insert, and keeping a turn that was cut.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
SEGMENT = 32
BLANKS = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
# States of the grammar: nothing yet, after s, after u, after a.
STATES = (0, 1, 2, 3)
NEXT = {"s": 1, "u": 2, "a": 3}
CLOSING = {0: "", 1: "II", 2: "I", 3: ""}  # insertions that end a conversation in a state
FAR = 1 << 60
Table = dict[tuple[int, int], tuple[int, str]]  # cheapest (cost, audit) by state before and after


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns as a faulty export leaves them; ``gone`` marks those that it drops."""
    whole = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.pmod(F.crc32(F.concat(whole["conv_id"], F.lit(":"), whole["turn"]).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), whole["role"].alias("role"),
                                whole["text"].alias("text"), fate.alias("fate"))
    return rows.select(
        "conv_id", "turn", (F.col("fate") == 0).alias("gone"),
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") <= 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _order(*first: Column) -> list[Column]:
    return [*first, F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def with_faults(rows: DataFrame) -> DataFrame:
    """``code`` (initial, and blank b, ends well e or cut c), ``same`` (digest) and ``earlier`` (an earlier turn says the same)."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    coded = rows.select("*", F.concat(
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o"),
        F.when(F.col("gone"), "-").when(end == "", "b").when(F.substring(end, -1, 1).isin(".", "!", "?"), "e").otherwise("c")).alias("code"),
        F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("same"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    # Blank turns fail as blank, whatever repeats; only what is said more than once needs its first place.
    first = coded.where("code not like '%-' and code not like '%b'").groupBy("conv_id", "same").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select(
        F.col("conv_id").alias("_conv"), F.col("same").alias("_same"), "first")
    return coded.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("same") == F.col("_same")), "left").select(
        "conv_id", "turn", "role", "text", "code", "same", F.coalesce(F.col("first") < place, F.lit(False)).alias("earlier"))


def target(state: int, length: int, system: bool) -> str:
    """The grammar's string of a length from a state on."""
    return (("s" if system else "") + ("au" if state == 2 else "ua") * (length // 2 + 1))[:length]


def step_cost(code: str, want: str) -> int:
    """Cost of keeping (or reroling) a turn as ``want``; x has to go, capitals are cut."""
    if code == "x":
        return FAR
    cost = CUT if code.isupper() else 0
    return cost + KEEP if code.lower() == want else cost + REROLE if want != "s" else FAR


def aligned(codes: str, goal: str, limit: int, closing: bool) -> tuple[int, str] | None:
    """Cheapest alignment with ``goal`` of at most ``limit`` and its least audit; without ``closing`` the last edit is a turn's own."""
    n, m = len(codes), len(goal)
    forced = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        forced[i] = forced[i + 1] + (codes[i] == "x")

    def least(turns: int, must: int, wants: int) -> int:
        spare = turns - must - wants
        return DELETE * must + (DELETE * spare if spare > 0 else -INSERT * spare)

    # Cost from a cell to the end, row by row from the last; cells no alignment within the limit can pass are left out.
    rows: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row, below = rows[i], rows[i + 1] if i < n else {}
        wide = (limit // INSERT) + 1
        for j in range(min(m, i + wide), max(0, i - forced[0] - wide) - 1, -1):
            if least(i, forced[0] - forced[i], j) + least(n - i, forced[i], m - j) > limit:
                continue
            best = FAR if i < n or j < m else 0
            if j < m and goal[j] != "s" and (i < n or closing):
                best = min(best, row.get(j + 1, FAR) + INSERT)
            if i < n:
                best = min(best, below.get(j, FAR) + DELETE)
                if j < m:
                    best = min(best, below.get(j + 1, FAR) + step_cost(codes[i], goal[j]))
            if best <= limit:
                row[j] = best
    if (total := rows[0].get(0, FAR)) > limit:
        return None
    audit, i, j, left = [], 0, 0, total
    while i < n or j < m:  # D < I < K < R, and each leads to a cell of its own
        if i < n and rows[i + 1].get(j, FAR) + DELETE == left:
            audit.append("D")
            i, left = i + 1, left - DELETE
        elif j < m and goal[j] != "s" and (i < n or closing) and rows[i].get(j + 1, FAR) + INSERT == left:
            audit.append("I")
            j, left = j + 1, left - INSERT
        else:
            audit.append("K" if codes[i].lower() == goal[j] else "R")
            left -= step_cost(codes[i], goal[j])
            i, j = i + 1, j + 1
    return total, "".join(audit)


def _lengths(codes: str, state: int, whole: bool) -> Iterator[tuple[int, int, str]]:
    """(least cost, state after, string) of every length, the cheapest bounds first."""
    free = len(codes) - codes.count("x")
    base = DELETE * (len(codes) - free)
    more, fewer = free, free - 1
    while True:
        if fewer >= 0 and DELETE * (free - fewer) <= INSERT * (more - free):
            length, fewer = fewer, fewer - 1
        else:
            length, more = more, more + 1
        bound = base + (INSERT * (length - free) if length > free else DELETE * (free - length))
        for system in (False, True) if state == 0 and length else (False,):
            goal = target(state, length, system)
            after = NEXT[goal[-1]] if goal else state
            if not whole or not CLOSING[after]:
                yield bound, after, goal


@lru_cache(50_000)
def whole_repair(codes: str) -> tuple[int, str]:
    """Cheapest edits of a whole conversation and their least audit."""
    best = (FAR, "")
    for bound, _, goal in _lengths(codes, 0, True):
        if bound > best[0]:
            return best
        # Dropping every turn is always possible, so the first limit holds for all.
        if (found := aligned(codes, goal, min(best[0], DELETE * len(codes)), True)) and found < best:
            best = found


@lru_cache(5_000)
def segment_table(codes: str) -> Table:
    """Cheapest edits of a segment between all states of the grammar."""
    out: Table = {}
    # Every turn can be dropped, and two insertions and a kept turn lead to any state that can be reached.
    most = DELETE * len(codes) + 2 * INSERT + REROLE + CUT
    for state in STATES:
        # No goal leaves the state as it is but the empty one, and none ends after s but s itself.
        for after, goal in ((state, ""), *([(1, "s")] if state == 0 else [])):
            if found := aligned(codes, goal, most, False):
                out[state, after] = found
        for bound, after, goal in _lengths(codes, state, False):
            if all(bound > out.get((state, q), (most, ""))[0] for q in (2, 3)):
                break
            best = out.get((state, after), (most, "~"))
            if bound <= best[0] and len(goal) > (goal == "s") and (found := aligned(codes, goal, best[0], False)) and found < best:
                out[state, after] = found
    return out


def joined(a: Table, b: Table) -> Table:
    """The table of two neighbouring stretches."""
    out: Table = {}
    for (p, q), (cost, audit) in a.items():
        for (q2, r), (more, rest) in b.items():
            if q == q2 and ((p, r) not in out or (cost + more, audit + rest) < out[p, r]):
                out[p, r] = (cost + more, audit + rest)
    return out


def closed(table: Table) -> tuple[int, str]:
    """Cheapest edits from the beginning to a sound end."""
    return min((cost + INSERT * len(CLOSING[q]), audit + CLOSING[q]) for (p, q), (cost, audit) in table.items() if p == 0)


IDENTITY: Table = {(q, q): (0, "") for q in STATES}


@dataclass
class Stretch:
    """Counts over consecutive turns of a conversation, and their edits."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0  # distinct turn numbers
    low: int | None = None
    high: int | None = None
    head: str = ""  # initials of the first and last turn
    tail: str = ""
    codes: list[str] = field(default_factory=list)  # not yet in the table
    table: Table | None = None

    def add(self, turn: int | None, code: str, repeated: bool) -> None:
        initial, end = code
        if end == "-":
            return
        fault = "blank" if end == "b" else "duplicate" if repeated else "truncated" if end == "c" else ""
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.illegal += bool(self.tail) and self.tail + initial not in ("su", "ua", "au")
        self.head, self.tail = self.head or initial, initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.codes.append("x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
        if len(self.codes) == SEGMENT:
            self.fold()

    def fold(self) -> None:
        """Bring the latest turns into the table."""
        if self.codes:
            self.table = joined(self.table or IDENTITY, segment_table("".join(self.codes)))
            self.codes = []

    def then(self, b: Stretch) -> Stretch:
        """This stretch and the one that follows it; both folded."""
        return Stretch(
            self.blank + b.blank, self.duplicate + b.duplicate, self.truncated + b.truncated,
            self.illegal + b.illegal + (bool(self.tail and b.head) and self.tail + b.head not in ("su", "ua", "au")),
            self.turns + b.turns - (self.high is not None and self.high == b.low), b.low if self.low is None else self.low,
            self.high if b.high is None else b.high, self.head or b.head, b.tail or self.tail, [],
            joined(self.table or IDENTITY, b.table or IDENTITY))

    def repaired(self) -> tuple[int, str]:
        if self.table is None:
            return whole_repair("".join(self.codes))
        self.fold()
        return closed(self.table)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PIECE = [T.StructField(c, T.LongType()) for c in (*COUNTS, "turns", "low", "high", "place")] + [
    T.StructField(c, T.StringType()) for c in ("audit", "head", "tail")] + [
    T.StructField("ways", T.ArrayType(T.StringType()))]


def _row(conv, s: Stretch, place: int | None) -> dict:
    """A finished conversation (no place), or a stretch that others may continue."""
    out = {"conv_id": conv, "blank": s.blank, "duplicate": s.duplicate, "truncated": s.truncated, "illegal": s.illegal}
    if place is None:
        cost, audit = s.repaired()
        return out | {"gaps": s.gaps(), "cost": cost, "audit": audit}
    s.fold()
    ways = [f"{p} {q} {cost} {audit}" for (p, q), (cost, audit) in (s.table or IDENTITY).items()]
    return out | {"turns": s.turns, "low": s.low, "high": s.high, "place": place, "head": s.head, "tail": s.tail, "ways": ways}


def _stretch(r: dict) -> Stretch:
    table = {(int(p), int(q)): (int(cost), audit) for p, q, cost, audit in (w.split(" ", 3) for w in r["ways"])}
    return Stretch(r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["turns"], r["low"], r["high"], r["head"], r["tail"], [], table)


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of damaged ``rows``: the counts of ``COUNTS`` and the audit."""
    id_field = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    schema = T.StructType([id_field, *PIECE])

    def packed(found: list[dict], like: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({f.name: [r.get(f.name) for r in found] for f in like}, schema=like)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like, place = None, TaskContext.get().partitionId()
        started, conv, now, before, first = False, None, Stretch(), None, True
        for batch in batches:
            like = like or pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), *(
                pa.field(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() if isinstance(f.dataType, T.StringType)
                         else pa.list_(pa.string())) for f in PIECE)])
            done = []
            for c, turn, code, same, earlier in zip(*(batch[x].to_pylist() for x in ("conv_id", "turn", "code", "same", "earlier")), strict=True):
                if not started or c != conv:
                    if started:
                        done.append(_row(conv, now, place if first else None))
                        first = False
                    started, conv, now, before = True, c, Stretch(), None
                now.add(turn, code, earlier or same == before)
                before = same
            yield packed(done, like)
        if started:  # the first and last conversation of a range may reach beyond it
            yield packed([_row(conv, now, place)], like)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # a row per range that holds a part of the conversation
        found = sorted(table.to_pylist(), key=lambda r: r["place"])
        whole = _stretch(found[0])
        for r in found[1:]:
            whole = whole.then(_stretch(r))
        yield packed([_row(found[0]["conv_id"], whole, None)], table.schema)

    flagged = with_faults(rows)
    n = parts(rows)
    ordered = flagged.repartitionByRange(n, F.col("conv_id"), *_order()).sortWithinPartitions(*_order(F.col("conv_id")))
    found = written(ordered.select("conv_id", "turn", "code", "same", "earlier").mapInArrow(run, schema))
    open_ones = found.where("place is not null")
    rest = open_ones.groupBy("conv_id").applyInArrow(join, schema)
    return found.where("place is null").unionByName(rest).select("conv_id", *COUNTS, "audit")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, str | None, str | None]]:
    """(conversation, role, text) of every repaired turn in order; a conversation begins with a row without role."""
    head: dict = {}
    at, state = 0, 0

    def inserted() -> Iterator[tuple[dict, str, str]]:
        nonlocal at, state
        while at < len(head["audit"]) and head["audit"][at] == "I":
            role = "a" if state == 2 else "u"
            at, state = at + 1, NEXT[role]
            yield head, ROLES[role], ""

    for batch in batches:
        names = batch.schema.names
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            r = dict(zip(names, r, strict=True))
            if r["kind"] == 0:
                if head:
                    yield from inserted()
                head, at, state = r, 0, 0
                yield head, None, None
                continue
            yield from inserted()
            edit = head["audit"][at]
            at += 1
            if edit == "D":
                continue
            role = r["role"][:1] if edit == "K" else "a" if state == 2 else "u"
            state = NEXT[role]
            yield head, r["role"] if edit == "K" else ROLES[role], r["text"]
    if head:
        yield from inserted()


def _side_by_side(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's counts and audit, followed by its turns in order, in one task's stream."""
    turns = rows.where(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    both = found.withColumn("kind", F.lit(0)).unionByName(turns, allowMissingColumns=True)
    return both.repartition(parts(rows), "conv_id").sortWithinPartitions(*_order(F.col("conv_id"), F.col("kind"))).select(
        "conv_id", "kind", *COUNTS, "audit", "role", "text")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations of damaged ``rows``: conv_id, position (from 0), role, text."""
    id_field = T.StructField("conv_id", rows.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"conv_id": [], "position": [], "role": [], "text": []}
        n, size = 0, 0
        for head, role, text in _streamed(batches):
            n = 0 if role is None else n
            if role is not None:
                for c, v in zip(out.values(), (head["conv_id"], n, role, text), strict=True):
                    c.append(v)
                n, size = n + 1, size + len(text) + 100
            if size > 1 << 20:
                yield pa.RecordBatch.from_pydict(out)
                out, size = {c: [] for c in out}, 0
        if out["text"]:
            yield pa.RecordBatch.from_pydict(out)

    schema = T.StructType([id_field, T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return small_batches(_side_by_side(rows, audits(rows))).mapInArrow(run, schema)


def digest(conversations: DataFrame) -> DataFrame:
    """Counts, audit and hash of the repaired text per original conversation, after ``damaged``."""
    rows = damaged(conversations.select("conv_id", "turn", "role", "text"))
    id_field = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, text_hash, empty = None, hashlib.sha256(), True

        def finished() -> tuple:
            return (*(now[c] for c in names[:-1]), text_hash.hexdigest())

        for head, role, text in _streamed(batches):
            if role is None:
                if now is not None:
                    done.append(finished())
                now, text_hash, empty = head, hashlib.sha256(), True
            else:
                text_hash.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
            if len(done) == 1000:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done, strict=True)), strict=True)))
                done = []
        if now is not None:
            done.append(finished())
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done, strict=True)), strict=True)))

    schema = T.StructType([id_field, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType()),
                           T.StructField("repaired_sha256", T.StringType())])
    return small_batches(_side_by_side(rows, audits(rows))).mapInArrow(run, schema)


SQL = r"""
WITH RECURSIVE
bits(b, c, k) AS (
  SELECT i, i, 0 FROM range(256) x(i) UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT b, c FROM bits WHERE k = 8),
keys AS (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
walk(s, i, c) AS (
  SELECT s, 1, 4294967295 FROM keys UNION ALL
  SELECT s, i + 1, xor(walk.c // 256, crcs.c) FROM walk JOIN crcs ON crcs.b = xor(walk.c % 256, ascii(substr(s, i, 1))) WHERE i <= length(s)),
fates AS (SELECT s, xor(c, 4294967295) % 20 AS fate FROM walk WHERE i = length(s) + 1),
input AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, fate FROM conversations
  JOIN fates ON s = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')),
faulty AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM input, range(2) x(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
         CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial FROM faulty),
coded AS (
  SELECT *, CASE WHEN said = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(said, 1) IN ('.', '!', '?') THEN 'e' ELSE 'c' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM numbered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 'c') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM coded GROUP BY conv_id),
-- Insertions before a turn: at most two ever pay.
ins(p, q, ops, cost, added) AS (VALUES
  (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
  (0, 2, 'I', 3, 'user:' || chr(10)), (1, 2, 'I', 3, 'user:' || chr(10)), (3, 2, 'I', 3, 'user:' || chr(10)), (2, 3, 'I', 3, 'assistant:' || chr(10)),
  (0, 3, 'II', 6, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 'II', 6, 'user:' || chr(10) || 'assistant:' || chr(10))),
edits(p, q, op, cost, initial, name) AS (VALUES
  (0, 0, 'D', 4, NULL, NULL), (1, 1, 'D', 4, NULL, NULL), (2, 2, 'D', 4, NULL, NULL), (3, 3, 'D', 4, NULL, NULL),
  (0, 1, 'K', 0, 's', NULL), (0, 2, 'K', 0, 'u', NULL), (1, 2, 'K', 0, 'u', NULL), (3, 2, 'K', 0, 'u', NULL), (2, 3, 'K', 0, 'a', NULL),
  (0, 2, 'R', 3, NULL, 'user'), (1, 2, 'R', 3, NULL, 'user'), (3, 2, 'R', 3, NULL, 'user'), (2, 3, 'R', 3, NULL, 'assistant')),
ways(conv_id, i, q, cost, audit, rep) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, 0, '', '' FROM counts UNION ALL
  SELECT conv_id, i, q, cost, audit, rep FROM (
    SELECT w.conv_id, c.i, e.q, w.cost + n.cost + e.cost + CASE WHEN e.op <> 'D' AND c.fault = 'c' THEN 3 ELSE 0 END AS cost,
           w.audit || n.ops || e.op AS audit,
           w.rep || n.added || CASE WHEN e.op = 'D' THEN '' ELSE coalesce(e.name, c.role) || ':' || c.text || chr(10) END AS rep
    FROM ways w JOIN coded c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i + 1
    JOIN ins n ON n.p = w.q JOIN edits e ON e.p = n.q
    WHERE (e.op = 'D' OR c.fault NOT IN ('b', 'd')) AND (e.initial IS NULL OR e.initial = c.initial))
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
ends AS (
  SELECT w.conv_id, w.cost + n.cost AS cost, w.audit || n.ops AS audit, w.rep || n.added AS rep
  FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN ins n ON n.p = w.q
  WHERE n.q = 3 OR (n.q = 0 AND w.q = 0)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + n.cost, w.audit || n.ops) = 1)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
       sha256(CASE WHEN coalesce(rep, '') = '' THEN '' ELSE left(rep, length(rep) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM d.conv_id
"""
