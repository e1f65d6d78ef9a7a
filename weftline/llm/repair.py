"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``: four
states. Forward and backward vectors of least costs over the states meet in the
middle of a conversation; there the crossing whose edits are ASCII-least among
the cheapest is chosen, and both halves are solved likewise.

A state has one role that may be inserted or given to a row, so the edits'
initials alone say what the repaired conversation is:

    D delete the row (3), I insert an empty text (2), K keep the row (0),
    R give the row another role (2); rows at fault that stay cost 1 more.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_type

#: States: nothing yet, after system, after user, after assistant. The state after a turn that may follow, by its initial.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that may be inserted in each state.
ROLE = ("user", "user", "assistant", "user")
#: Insertions that end a conversation legally, by state.
TO_END = (0, 2, 1, 0)
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
NONE, BLANK, DUPLICATE, CUT = range(4)
INITIALS = "sua"
_FAR = 1 << 60
_CODES = 12


def code_of(fault: int, initial: str) -> int:
    """What matters of a row for its edits: whether it may stay, at what cost, and its role's initial."""
    kind = {NONE: 0, CUT: 1, BLANK: 2, DUPLICATE: 2}[fault]
    return 4 * kind + (INITIALS.find(initial) if initial else 3) % 4


def _inserted(state: int, times: int) -> int:
    for _ in range(times):
        state = NEXT[state][ROLE[state][0]]
    return state


def _steps(code: int) -> list[dict[int, tuple[int, str]]]:
    """By state before a row, by state after it: cost and edits, the cheapest, of these the ASCII-least. Two insertions reach every state that any number reaches."""
    kind, initial = code // 4, (*INITIALS, "")[code % 4]
    found = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}
        for times in range(3):
            at = _inserted(state, times)
            ways = [(at, DELETE, "D")]
            if kind < 2:
                ways.append((_inserted(at, 1), REROLE + kind * TRUNCATED, "R"))
                if initial in NEXT[at]:
                    ways.append((NEXT[at][initial], kind * TRUNCATED, "K"))
            for after, cost, edit in ways:
                way = times * INSERT + cost, "I" * times + edit
                best[after] = min(best.get(after, way), way)
        found.append(best)
    return found


STEPS = [_steps(code) for code in range(_CODES)]


@functools.lru_cache(maxsize=1 << 14)
def _forward_step(code: int, costs: tuple[int, ...], ranks: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """Least cost, costs above it and ranks after a row.

    ranks order the states by the edits that lead to them. Edits up to a row end with
    the row's own, so none is the beginning of another and what comes later does not
    change their order: edits from different states compare by these states' ranks,
    edits from one state by the step.
    """
    best: dict[int, tuple[int, int, str]] = {}
    for state, cost in enumerate(costs):
        if cost < _FAR:
            for after, (more, edits) in STEPS[code][state].items():
                way = cost + more, ranks[state], edits
                best[after] = min(best.get(after, way), way)
    order = sorted(best, key=lambda after: best[after][1:])
    least = min(way[0] for way in best.values())
    return least, tuple(best[s][0] - least if s in best else _FAR for s in range(4)), tuple(order.index(s) if s in best else 4 for s in range(4))


@functools.lru_cache(maxsize=1 << 14)
def _backward_step(code: int, costs: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """Least cost and costs above it before a row, from those after it."""
    best = [min((more + costs[after] for after, (more, _) in STEPS[code][state].items() if costs[after] < _FAR), default=_FAR) for state in range(4)]
    least = min(best)
    return least, tuple(x - least if x < _FAR else _FAR for x in best)


def _crossing(codes: bytes, lo: int, mid: int, hi: int, start: int, end: tuple[int, ...]) -> int:
    """State right after row mid - 1 on the cheapest way from start through rows lo to hi, the ASCII-least of several."""
    costs, ranks = tuple(0 if s == start else _FAR for s in range(4)), (0,) * 4
    for code in codes[lo:mid]:
        _, costs, ranks = _forward_step(code, costs, ranks)
    after = end
    for code in reversed(codes[mid:hi]):
        _, after = _backward_step(code, after)
    return min((s for s in range(4) if costs[s] < _FAR and after[s] < _FAR), key=lambda s: (costs[s] + after[s], ranks[s]))


def least_edits(codes: bytes) -> str:
    """The cheapest edits of a conversation of these codes, the ASCII-least of several: time n log n, memory n."""
    edits = []
    work = [(0, len(codes), 0, tuple(INSERT * n for n in TO_END))]
    state = 0
    while work:
        lo, hi, start, end = work.pop()
        if hi - lo > 1:
            mid = (lo + hi) // 2
            state = _crossing(codes, lo, mid, hi, start, end)
            work += [(mid, hi, state, end), (lo, mid, start, tuple(0 if s == state else _FAR for s in range(4)))]
        elif hi > lo:
            ways = [(cost + end[after], edit, after) for after, (cost, edit) in STEPS[codes[lo]][start].items() if end[after] < _FAR]
            _, edit, state = min(ways)
            edits.append(edit)
    return "".join(edits) + "I" * TO_END[state]


#: Most short conversations have one of few shapes.
_short_edits = functools.lru_cache(maxsize=1 << 16)(least_edits)


def edits_of(codes: bytes) -> str:
    return _short_edits(codes) if len(codes) <= 64 else least_edits(codes)


def cost_of(edits: str, codes: bytes) -> int:
    """Cost of edits of a conversation."""
    rows = iter(codes)
    cost = 0
    for edit in edits:
        stays = edit != "I" and edit != "D"
        cut = edit != "I" and next(rows) // 4 == 1
        cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[edit] + TRUNCATED * (stays and cut)
    return cost


class _Conversation:
    """Facts and codes of one conversation's rows, a byte a row."""

    def __init__(self):
        self.codes = bytearray()
        self.counts = [0] * 4
        self.low = self.high = None
        self.turns = self.illegal = 0
        self.initial = None
        self._edits = None

    def add(self, turn: int | None, fault: int, initial: str) -> None:
        self.codes.append(code_of(fault, initial))
        self.counts[fault] += 1
        if turn is not None:
            self.turns += self.high != turn
            self.low, self.high = turn if self.low is None else self.low, turn
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial

    @property
    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.turns

    @property
    def edits(self) -> str:
        if self._edits is None:
            self._edits = edits_of(bytes(self.codes))
        return self._edits


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of sorted rows, which bring each conversation twice, first without texts: (conv_id, conversation, edit, turn, role, text), and once after a conversation with edit None.

    A conversation takes a few bytes a row; texts pass by.
    """
    nobody = object()
    conv, now, edit, state, at = nobody, None, None, 0, 0

    def inserts(until: int) -> Iterator[tuple]:
        nonlocal state, at
        while at < until and now.edits[at] == "I":
            yield conv, now, "I", None, ROLE[state], ""
            state, at = _inserted(state, 1), at + 1

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != conv:
                if conv is not nobody:
                    yield from inserts(len(now.edits))
                    yield conv, now, None, None, None, None
                conv, now, state, at = row[0], _Conversation(), 0, 0
            _, again, _, present, turn, fault, initial, role, text = row
            if not present:
                continue
            if not again:
                now.add(turn, fault, initial)
                continue
            yield from inserts(len(now.edits))
            edit, at = now.edits[at], at + 1
            if edit == "R":
                role = ROLE[state]
            yield conv, now, edit, turn, role, text
            state = state if edit == "D" else _inserted(state, 1) if edit == "R" else NEXT[state][role[:1]]
    if conv is not nobody:
        yield from inserts(len(now.edits))
        yield conv, now, None, None, None, None


def faults(rows: DataFrame, present: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, present, place (in the conversation, from 1), turn, role, text, fault and initial of every row.

    Rows are ordered by turn (null first), equal turns by role and text. fault is
    that of the first that holds: BLANK (nothing but white space), DUPLICATE (an
    earlier row has the role and text), CUT (the last character that is no white
    space is none of .!?), NONE. Null roles and texts are one space. All rows of a
    null conv_id are one conversation. Rows that are not present only name their
    conversation. One shuffle, by conversation; Spark spills what does not fit.
    """
    seen = rows.select(
        F.col(conv_col).alias("conv_id"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    placed = seen.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("present", *order)))
    nth = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy("place"))
    last = F.regexp_extract("text", r"(?s)([^ \t-\r])[ \t-\r]*\z", 1)
    fault = F.when(last == "", BLANK).when(nth > 1, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(NONE)
    return placed.withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1))


def _twice(rows: DataFrame) -> DataFrame:
    """Rows of ``faults``, each twice: without role and text, and with them; sorted by conversation, then so."""
    none = F.lit(None).cast("string")
    both = F.explode(F.array(F.struct(F.lit(False).alias("again"), none.alias("role"), none.alias("text")), F.struct(F.lit(True).alias("again"), F.col("role"), F.col("text"))))
    lines = rows.select("conv_id", both.alias("line"), "place", "present", "turn", "fault", "initial")
    flat = lines.select("conv_id", "line.again", "place", "present", "turn", "fault", "initial", "line.role", "line.text")
    return flat.where("present or not again").sortWithinPartitions("conv_id", "again", "place")


_CHUNK = 1000


def _batches(rows: Iterator[tuple], types: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    held = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, (_, t) in enumerate(types)], [n for n, _ in types])

    for row in rows:
        held.append(row)
        if len(held) >= _CHUNK:
            yield batch()
            held = []
    if held:
        yield batch()


def repair(faulty: DataFrame) -> DataFrame:
    """Rows of ``faults`` repaired: conv_id, nth (from 0), edit, turn (null if inserted), role, text; deleted rows too, marked D."""
    types = [("conv_id", to_arrow_type(faulty.schema["conv_id"].dataType)), ("nth", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        nth = 0
        for conv, _, edit, turn, role, text in _repaired(batches):
            if edit is None:
                nth = 0
            else:
                yield conv, nth, edit, turn, role, text
                nth += 1

    return _twice(faulty).mapInArrow(lambda batches: _batches(rows(batches), types), f"conv_id {faulty.schema['conv_id'].dataType.simpleString()}, nth long, edit string, turn long, role string, text string")


def repair_report(faulty: DataFrame) -> DataFrame:
    """One row per conversation of ``faults``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of ``role:text`` lines).

    A conversation without present rows has zeros, an empty audit and the hash of an
    empty text. An empty table gives no rows. Columns beside those named are left out.
    """
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    types = [("conv_id", to_arrow_type(faulty.schema["conv_id"].dataType)), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        digest, first = hashlib.sha256(), True
        for conv, now, edit, _, role, text in _repaired(batches):
            if edit is None:
                yield conv, now.gaps, *(now.counts[f] for f in (BLANK, DUPLICATE, CUT)), now.illegal, cost_of(now.edits, bytes(now.codes)), now.edits, digest.hexdigest()
                digest, first = hashlib.sha256(), True
            elif edit != "D":
                digest.update(f"{'' if first else '\n'}{role}:{text}".encode())
                first = False

    return _twice(faulty).mapInArrow(lambda batches: _batches(rows(batches), types), f"conv_id {faulty.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """conversations with faults planted by crc32 of ``conv_id:turn``, modulo 20 (nulls are one space in it): 0 drops the row (present is false), 1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 sets its role to user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    changed = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("present"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )
    return changed.select(*changed.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copies", "copy")
