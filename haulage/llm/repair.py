"""Conversation repair: the cheapest edits that give a conversation the shape `(s?(ua)+)?`, by divide and conquer.

s, u and a are the initials of the roles of a turn. An automaton of four states (nothing yet, after s, after u, after a)
reads the repaired turns, so all that a stretch of rows can do is a vector of four costs. Two such vectors, from the front
and from the back, meet in the middle of a stretch; the crossing with the least sum is taken, of equal ones that with the
least audit, and both halves are solved in the same way. So only two vectors are held beside the rows.

Rows are dealt by ranges of (conversation, turn), in segments of at most SEGMENT rows. The vectors of whole segments,
for each of the four states before them, meet at the borders of segments in the same manner; then segments are solved apart,
however long their conversation is.

An audit up to a row ends in that row's edit and has one more edit for each row, so of two audits up to one row none starts
with the other: the order of two whole audits is decided where they first part, and four ranks beside the four costs say
which of them is least.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import cut, in_batches

#: Rows and characters of a segment.
SEGMENT, SEGMENT_CHARS = 4096, 1 << 20
#: What edits cost; what a truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
STATES, NEVER = range(4), 1 << 60
#: The state that an inserted turn leads to, from each state: there is but one.
NEXT = (2, 2, 3, 2)
_BLANK = re.compile(r"[^\x20\x09-\x0D]")
_STEPS: dict[int, list[list[tuple[int, str]]]] = {}


def code(initial: str, gone: bool, truncated: bool) -> int:
    """A row as the automaton sees it: its initial (s, u, a or other), whether it must go, and whether it is cut off."""
    return "sua-".index(initial if initial in ("s", "u", "a") else "-") * 4 + gone * 2 + truncated


def steps(row: int) -> list[list[tuple[int, str]]]:
    """For each state before and after a row the cheapest edits (ties: the least audit), with inserts before the row."""
    if row not in _STEPS:
        initial, gone, extra = row // 4, row // 2 % 2, TRUNCATED * (row % 2)
        kept = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}[initial]
        table = [[(NEVER, "")] * 4 for _ in STATES]
        for x in STATES:
            state = x
            for n in range(3):
                ways = [(DELETE, "D", state)]
                if not gone:
                    ways.append((REROLE + extra, "R", NEXT[state]))
                    if state in kept:
                        ways.append((extra, "K", kept[state]))
                for cost, edit, y in ways:
                    table[x][y] = min(table[x][y], (INSERT * n + cost, "I" * n + edit))
                state = NEXT[state]
        _STEPS[row] = table
    return _STEPS[row]


def tail(state: int) -> int:
    """Inserts that a conversation needs at its end."""
    return (0, 2, 1, 0)[state]


def _forward(rows: bytes, lo: int, hi: int, entry: int) -> list[tuple[int, int]]:
    """For each state after the rows its least cost from entry, and the rank of its audit among the four."""
    told = [(0, 0) if x == entry else (NEVER, 0) for x in STATES]
    for k in range(lo, hi):
        table = steps(rows[k])
        best = [min((told[x][0] + table[x][y][0], told[x][1], table[x][y][1]) for x in STATES if told[x][0] < NEVER) for y in STATES]
        order = sorted(STATES, key=lambda y: best[y][1:])
        told = [(min(best[y][0], NEVER), order.index(y)) for y in STATES]
    return told


def _backward(rows: bytes, lo: int, hi: int, costs: list[int]) -> list[int]:
    """For each state before the rows the least cost to what the costs say for the states after them."""
    for k in range(hi - 1, lo - 1, -1):
        table = steps(rows[k])
        costs = [min(table[x][y][0] + costs[y] for y in STATES) for x in STATES]
    return costs


def _meet(front: list[tuple[int, int]], back: list[int]) -> int:
    """The state with the least sum; of equal ones that with the least audit so far."""
    return min(STATES, key=lambda y: (front[y][0] + back[y], front[y][1]))


def solve(rows: bytes, entry: int, leave: int) -> list[str]:
    """The edits of each row (inserts before it first), from one state to another."""
    out, todo = [""] * len(rows), [(0, len(rows), entry, leave)]
    while todo:
        lo, hi, x, y = todo.pop()
        if hi - lo == 1:
            out[lo] = steps(rows[lo])[x][y][1]
        elif hi > lo:
            mid = (lo + hi) // 2
            at = _meet(_forward(rows, lo, mid, x), _backward(rows, mid, hi, [0 if s == y else NEVER for s in STATES]))
            todo += [(lo, mid, x, at), (mid, hi, at, y)]
    return out


def cross(segments: list[tuple[list[int], list[int]]]) -> tuple[int, list[int]]:
    """The least cost of a conversation and the states at its segments' borders, the start and the end included.

    A segment gives 16 costs and 16 ranks: for each state before it those of the four states after it.
    """
    backs = [[INSERT * tail(y) for y in STATES]]
    for costs, _ in reversed(segments):
        backs.append([min(costs[4 * x + y] + backs[-1][y] for y in STATES) for x in STATES])
    backs.reverse()
    front, states = [(0, 0), (NEVER, 0), (NEVER, 0), (NEVER, 0)], [0]
    for (costs, ranks), back in zip(segments, backs[1:]):
        best = [min((front[x][0] + costs[4 * x + y], front[x][1], ranks[4 * x + y]) for x in STATES if front[x][0] < NEVER) for y in STATES]
        order = sorted(STATES, key=lambda y: best[y][1:])
        front = [(min(best[y][0], NEVER), order.index(y)) for y in STATES]
        states.append(_meet(front, back))
    return backs[0][0], states


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, with faults by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2
    takes the `[.!?]` out, 3 repeats it, 4 makes its role user. Null roles and texts become one space, and so do the
    nulls of `conv_id:turn`."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _ordered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (equal rows) and fresh (no equal role and text at an earlier turn), equal rows as one."""
    rows = cut(turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", F.sha2("text", 256)))
    said = rows.where(F.regexp_extract("text", r"[^\x20\x09-\x0D]", 0) != "")
    at = F.struct("turn").alias("at")  # a struct, as nulls come first in it
    first = said.groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first != last")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    both = rows.join(first, rows["conv_id"].eqNullSafe(first["c"]) & (rows["role"] == first["r"]) & (rows["digest"] == first["d"]), "left")
    return cut(both.select("conv_id", "turn", "role", "text", "n", (F.col("first").isNull() | F.col("first").eqNullSafe(F.struct("turn"))).alias("fresh")), rows)


_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_FAULTS = ("blank", "duplicate", "truncated", "illegal")
_SEGMENT = "seg long, rows binary, turns array<struct<role:string,text:string>>, costs array<long>, ranks array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, distinct long"


class _Open:
    """A segment as its rows come in."""

    def __init__(self) -> None:
        self.rows, self.turns, self.chars, self.last = bytearray(), [], 0, None
        self.faults, self.first, self.low, self.high, self.distinct = dict.fromkeys(_FAULTS, 0), None, None, None, 0

    def add(self, turn: int | None, role: str, text: str, fresh: bool) -> None:
        said = _BLANK.search(text)
        ends = said and text.rstrip(" \t\n\v\f\r")[-1]
        fault = "blank" if not said else "duplicate" if not fresh else "truncated" if ends not in ".!?" else ""
        if fault:
            self.faults[fault] += 1
        gone = fault in ("blank", "duplicate")
        if self.first is None:
            self.first = role[:1]
        elif self.last + role[:1] not in ("su", "ua", "au"):
            self.faults["illegal"] += 1
        self.last = role[:1]
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        self.rows.append(code(role[:1], gone, fault == "truncated"))
        self.turns.append((None, None) if gone else (role, text))
        self.chars += 0 if gone else len(text)

    def full(self, most: int) -> bool:
        return len(self.rows) >= most or self.chars >= SEGMENT_CHARS

    def told(self) -> tuple:
        rows = bytes(self.rows)
        ways = [w for x in STATES for w in _forward(rows, 0, len(rows), x)]
        turns = [{"role": r, "text": t} for r, t in self.turns]
        return rows, turns, [c for c, _ in ways], [r for _, r in ways], *self.faults.values(), self.first, self.last, self.low, self.high, self.distinct


def _segments(rows: DataFrame, most: int) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *(f.split()[0] for f in _SEGMENT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, now, segment = TaskContext.get().partitionId(), 0, None, None
        ids = None

        def batch(found: list[tuple]) -> pa.RecordBatch:
            kinds = [ids, pa.int64(), pa.binary(), pa.list_(_TURN), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=names)

        found, chars = [], 0
        for got in batches:
            ids = got.schema.field(0).type
            for conv, turn, role, text, n, fresh in zip(*(c.to_pylist() for c in got.columns)):
                for k in range(n):
                    if segment is not None and (conv != now or segment.full(most)):
                        found.append((now, part << 33 | done, *segment.told()))
                        chars += segment.chars
                        done, segment = done + 1, None
                        if len(found) >= 256 or chars >= SEGMENT_CHARS:
                            yield batch(found)
                            found, chars = [], 0
                    if segment is None:
                        now, segment = conv, _Open()
                    segment.add(turn, role, text, fresh and k == 0)
        if segment is not None:
            found.append((now, part << 33 | done, *segment.told()))
            yield batch(found)

    order = ["conv_id", "turn", "role", "text"]
    spread = rows.select(*order, "n", "fresh").repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(in_batches(spread, run, f"conv_id {kind}, {_SEGMENT}"), rows)


def _crossings(segments: DataFrame) -> DataFrame:
    """Per conversation its counts, its cost and the states (seg, entry, leave) around its segments. One small row for
    each segment, that is one of up to 4096 turns, meets the others of its conversation."""
    own = ["seg", "costs", "ranks", *_FAULTS, "first", "last", "low", "high", "distinct"]
    met = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("segments"))
    kind = segments.schema["conv_id"].dataType.simpleString()
    names = ["gaps", *_FAULTS, "cost", "ways"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            told = []
            for segs in got.column(1).to_pylist():
                cost, states = cross([(s["costs"], s["ranks"]) for s in segs])
                sums = {f: sum(s[f] for s in segs) for f in _FAULTS}
                sums["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(segs, segs[1:]))
                timed = [s for s in segs if s["low"] is not None]
                distinct = sum(s["distinct"] for s in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
                gaps = timed[-1]["high"] - timed[0]["low"] + 1 - distinct if timed else 0
                ways = [{"seg": s["seg"], "entry": x, "leave": y, "more": 0} for s, x, y in zip(segs, states, states[1:])]
                ways[-1]["more"] = tail(states[-1])
                told.append((min(gaps, (1 << 63) - 1), *sums.values(), cost, ways))
            way = pa.list_(pa.struct([(c, pa.int64()) for c in ("seg", "entry", "leave", "more")]))
            yield pa.RecordBatch.from_arrays([got.column(0), *[pa.array([t[k] for t in told], pa.int64() if k < 6 else way) for k in range(7)]], names=["conv_id", *names])

    longs = ", ".join(f"{c} long" for c in names[:-1])
    return in_batches(met, run, f"conv_id {kind}, {longs}, ways array<struct<seg:long,entry:long,leave:long,more:long>>")


def repair_conversations(turns: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Counts per conversation, and its repaired turns in pieces: (conv_id, gaps, blank, duplicate, truncated, illegal,
    cost) and (conv_id, seg, audit, turns).

    turns: conv_id, turn, role, text; sorted by turn (nulls first), then role, then text. Of each row the first of these
    faults counts: blank (no sign but white space of ASCII), duplicate (an earlier row of the conversation has its
    role and text), truncated (the last sign that is no white space is none of `.!?`). illegal counts adjacent
    rows whose initials are not su, ua or au, gaps the numbers between the least and the greatest turn that no row has.
    Edits: K keeps a row, R gives it the role user or assistant (3), D deletes it (4; blank and duplicate ones must
    go), I inserts an empty turn of user or assistant (3); a truncated row that stays costs 3. The audit of a
    conversation is that of its pieces in the order of seg: of the cheapest repairs the least text. A row of an empty
    role can only be deleted or get another. Null roles and texts count as one space; a null conv_id is a conversation
    like any other; an empty table gives none; other columns are left out.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = _ordered(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text")))
    segments = _segments(rows, segment)
    crossed = cut(_crossings(segments))
    ways = crossed.select(F.explode("ways").alias("w")).select("w.*")
    kind = segments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            audits, repaired = [], []
            for row in got.select(["rows", "turns", "entry", "leave", "more"]).to_pylist():
                edits, out, state = solve(row["rows"], row["entry"], row["leave"]), [], row["entry"]
                turns = [(t["role"], t["text"]) for t in row["turns"]]
                for edit, (role, text), now in zip([*edits, "I" * row["more"]], [*turns, (None, None)], [*row["rows"], None]):
                    for e in edit:
                        if e == "D":
                            continue
                        state = NEXT[state] if e != "K" else (1, 2, 3)[now // 4]
                        name = ("user", "assistant")[state - 2] if e != "K" else role
                        out.append({"role": name, "text": "" if e == "I" else text})
                audits.append("".join(edits) + "I" * row["more"])
                repaired.append(out)
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), pa.array(audits, pa.string()), pa.array(repaired, pa.list_(_TURN))], names=["conv_id", "seg", "audit", "turns"])

    joined = segments.select("conv_id", "seg", "rows", "turns").join(ways, "seg").select("conv_id", "seg", "rows", "turns", "entry", "leave", "more")
    pieces = in_batches(joined, run, f"conv_id {kind}, seg long, audit string, turns array<struct<role:string,text:string>>")
    return crossed.drop("ways"), pieces


def _digests(pieces: DataFrame) -> DataFrame:
    """conv_id, audit and the digest of the repaired turns, piece by piece."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, h, any_turn, ids = None, None, None, False, None

        def closed(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], (ids, pa.string(), pa.string())[k]) for k in range(3)], names=["conv_id", "audit", "repaired_sha256"])

        for got in batches:
            ids, found = got.schema.field(0).type, []
            for conv, _, text, turns in zip(*(c.to_pylist() for c in got.columns)):
                if h is None or conv != now:
                    if h is not None:
                        found.append((now, "".join(audit), h.hexdigest()))
                    now, audit, h, any_turn = conv, [], hashlib.sha256(), False
                audit.append(text)
                for t in turns:
                    h.update(("\n" if any_turn else "").encode() + f"{t['role']}:{t['text']}".encode())
                    any_turn = True
            if found:
                yield closed(found)
        if h is not None:
            yield closed([(now, "".join(audit), h.hexdigest())])

    spread = pieces.select("conv_id", "seg", "audit", "turns").repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return in_batches(spread, run, f"conv_id {kind}, audit string, repaired_sha256 string")


def audit_conversations(turns: DataFrame, every: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """repair_conversations as one row per conversation of `every` (conv_id; turns by default): its counts, cost, audit and
    the digest of the repaired turns (`role:text`, joined by line feeds). Conversations without rows have zeros, the
    empty audit and the digest of the empty text. Only the audit of a conversation is put together in one value."""
    counts, pieces = repair_conversations(turns, segment)
    ids = (turns if every is None else every).select("conv_id").distinct()
    counts = counts.withColumnRenamed("conv_id", "c")
    told = _digests(pieces).withColumnRenamed("conv_id", "t")
    both = ids.join(counts, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(told, F.col("conv_id").eqNullSafe(F.col("t")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *_FAULTS, "cost")]
    return both.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
