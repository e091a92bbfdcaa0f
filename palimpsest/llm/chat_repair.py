"""Conversations whose roles don't alternate, repaired by generalised LR parsing with weighted edits.

The role grammar is ``GRAMMAR``: nothing, or pairs of user and assistant, with one system row before them or not.
Its LR automaton reads the initials of a conversation's roles. A row may be kept, given another role or deleted, and a row
without text may be inserted anywhere; each edit has its price (``COSTS``). Where several edits are possible the stack
splits into a graph of stacks with common tails, and stacks that are equal are merged: the one with the smaller cost stays, of equal
costs the one whose edits' initials are less in ASCII. Of two edit lists with one cost over the same rows none begins the other
(the longer one would have paid for more insertions), so what is less now stays less whatever follows, and merging loses nothing.

Rows come sorted and are parsed as they stream by. What all stacks agree on is written out at once, so memory holds the
rows that are still undecided (of those that must go, not even the text). A front (the stacks with costs and edits relative to
what is decided) recurs, so steps from front to front are remembered, in a bounded table.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.llm.shared import Memo

#: S is a conversation, P its pairs: left-recursive, so no stack is deeper than three states, and after a pair all stacks are equal.
GRAMMAR = (("S", ""), ("S", "P"), ("P", "ua"), ("P", "sua"), ("P", "Pua"))
COSTS = {"D": 4, "I": 3, "R": 3, "truncated": 3}
#: What any stack pays at most to do as another one does from here on: to insert the turn that it lacks and to delete the system
#: row that the other one keeps, or to insert a pair where the other one ends. One that is dearer than the cheapest by more is out.
SLACK = max(COSTS["I"] + COSTS["D"], 2 * COSTS["I"])
ROLES = {"u": b"user", "a": b"assistant"}
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"
LEGAL = {b"su", b"ua", b"au"}
_FAULTS = ("blank", "duplicate", "truncated")


def _automaton() -> tuple[dict[tuple[int, str], int], list[list[tuple[str, int]]]]:
    """LR(0) states of the grammar: where each symbol leads, and what each state can reduce (left side, length)."""
    def closed(items: set) -> frozenset:
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            right = GRAMMAR[rule][1]
            for i, (left, _) in enumerate(GRAMMAR):
                if dot < len(right) and left == right[dot] and (i, 0) not in items:
                    items.add((i, 0))
                    todo.append((i, 0))
        return frozenset(items)

    states, goto = [closed({(i, 0) for i, (left, _) in enumerate(GRAMMAR) if left == "S"})], {}
    for at, items in enumerate(states):  # grows meanwhile
        for x in sorted({GRAMMAR[r][1][d] for r, d in items if d < len(GRAMMAR[r][1])}):
            to = closed({(r, d + 1) for r, d in items if GRAMMAR[r][1][d : d + 1] == x})
            if to not in states:
                states.append(to)
            goto[at, x] = states.index(to)
    done = [[(GRAMMAR[r][0], d) for r, d in sorted(items) if d == len(GRAMMAR[r][1])] for items in states]
    return goto, done


_GOTO, _DONE = _automaton()


def _shift(stack: tuple[int, ...], letter: str) -> tuple[int, ...] | None:
    """The stack after a letter, with its pairs reduced; None where the letter can't follow."""
    to = _GOTO.get((stack[-1], letter))
    if to is None:
        return None
    stack = (*stack, to)
    while pairs := [n for left, n in _DONE[stack[-1]] if left == "P"]:
        below = stack[: -pairs[0]]
        stack = (*below, _GOTO[below[-1], "P"])
    return stack


def _accepts(stack: tuple[int, ...]) -> bool:
    return any(left == "S" and n == len(stack) - 1 for left, n in _DONE[stack[-1]])


_shifts = Memo(lambda key: _shift(*key), 4096)
Front = tuple[tuple[tuple[int, ...], int, str], ...]
START: Front = (((0,), 0, ""),)


def _better(front: dict, stack: tuple | None, cost: int, edits: str) -> bool:
    if stack is None or stack in front and front[stack] <= (cost, edits):
        return False
    front[stack] = cost, edits
    return True


def _with_inserts(front: Front) -> dict:
    best = {stack: (cost, edits) for stack, cost, edits in front}
    todo = deque(best)
    while todo:
        stack = todo.popleft()
        cost, edits = best[stack]
        todo += [to for x in "ua" if _better(best, to := _shifts[stack, x], cost + COSTS["I"], edits + "I")]
    return best


def _decided(best: dict) -> tuple[Front, int, str]:
    """A front with its least cost and the edits that all stacks begin with taken out."""
    least = min(c for c, _ in best.values())
    best = {s: x for s, x in best.items() if x[0] <= least + SLACK}
    common = os.path.commonprefix([e for _, e in best.values()])
    return tuple(sorted((s, c - least, e[len(common) :]) for s, (c, e) in best.items())), least, common


def _step(key: tuple[Front, str, str]) -> tuple[Front, int, str]:
    front, letter, fault = key
    after: dict = {}
    for stack, (cost, edits) in _with_inserts(front).items():
        _better(after, stack, cost + COSTS["D"], edits + "D")
        if fault in ("", "truncated"):
            more = COSTS["truncated"] * (fault != "")
            _better(after, _shifts[stack, letter], cost + more, edits + "K")
            for x in "ua":
                _better(after, _shifts[stack, x], cost + more + COSTS["R"], edits + "R")
    return _decided(after)


def _end(front: Front) -> tuple[int, str]:
    return min(x for stack, x in _with_inserts(front).items() if _accepts(stack))


_steps = Memo(_step, 20_000)


class Repair:
    """The parse of one conversation, row after row."""

    def __init__(self) -> None:
        self.front, self.cost, self.waiting, self.last = START, 0, deque(), ""

    def add(self, role: bytes, text: bytes, fault: str) -> Iterator[tuple[str, bytes, bytes]]:
        """Take a row; (edit, role, text) of what is decided by it."""
        letter = role[:1].decode("latin-1")
        self.waiting.append((b"", b"") if fault in ("blank", "duplicate") else (role, text))
        key = self.front, letter if letter in "sua" else "", fault
        self.front, cost, edits = _steps[key] if sum(len(e) for _, _, e in self.front) < 200 else _step(key)
        self.cost += cost
        return self._apply(edits)

    def end(self) -> Iterator[tuple[str, bytes, bytes]]:
        """What is left."""
        cost, edits = _end(self.front)
        self.cost += cost
        return self._apply(edits)

    def _apply(self, edits: str) -> Iterator[tuple[str, bytes, bytes]]:
        for edit in edits:
            role, text = (b"", b"") if edit == "I" else self.waiting.popleft()
            if edit in "IR":
                role = ROLES["a" if self.last == "u" else "u"]
            if edit != "D":
                self.last = role[:1].decode("latin-1")
            yield edit, role, text


class _Report:
    """Counts and digests of a conversation."""

    def __init__(self) -> None:
        self.count, self.illegal, self.before, self.turns, self.edits = dict.fromkeys(_FAULTS, 0), 0, None, [None, None, 0], []
        self.digest, self.written = hashlib.sha256(), False

    def row(self, turn: int | None, initial: bytes, fault: str) -> None:
        if fault:
            self.count[fault] += 1
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]

    def repaired(self, made: Iterator[tuple[str, bytes, bytes]]) -> None:
        for edit, role, text in made:
            self.edits.append(edit)
            if edit != "D":
                self.digest.update(b"\n" * self.written + role + b":" + text)
                self.written = True

    def values(self, conv_id: int | None, cost: int) -> tuple:
        low, high, n = self.turns
        return conv_id, high - low + 1 - n if n else 0, *self.count.values(), self.illegal, cost, "".join(self.edits), self.digest.hexdigest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    of = {"long": pa.int64(), "string": pa.string()}
    text = lambda v: v.decode() if isinstance(v, bytes) else v
    return pa.RecordBatch.from_arrays([pa.array([text(r[i]) for r in rows], of[k]) for i, k in enumerate(kinds)], names=list(names))


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, none, now, parse, report = [], object(), None, None, None
    for conv_id, turn, is_row, role, initial, text, fault in _rows(batches):
        if parse is None or conv_id != now:
            if parse is not None:
                report.repaired(parse.end())
                out.append(report.values(now, parse.cost))
            if len(out) >= 5000:
                yield _table(out, REPORT)
                out = []
            now, parse, report = conv_id, Repair(), _Report()
        if is_row:
            report.row(turn, initial, fault)
            report.repaired(parse.add(role, text, fault))
    if parse is not None:
        report.repaired(parse.end())
        out.append(report.values(now, parse.cost))
    if out:
        yield _table(out, REPORT)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size, now, parse, place = [], 0, None, None, 0

    def add(made: Iterator[tuple[str, bytes, bytes]]) -> None:
        nonlocal place, size
        for edit, role, text in made:
            out.append((now, None if edit == "D" else place, edit, role, text))
            place, size = place + (edit != "D"), size + len(text) + 64

    for conv_id, _, is_row, role, _, text, fault in _rows(batches):
        if parse is None or conv_id != now:
            if parse is not None:
                add(parse.end())
            now, parse, place = conv_id, Repair(), 0
        if is_row:
            add(parse.add(role, text, fault))
        if size > 4 << 20:
            yield _table(out, TURNS)
            out, size = [], 0
    if parse is not None:
        add(parse.end())
    if out:
        yield _table(out, TURNS)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in, by the CRC-32 of ``conv_id:turn`` (nulls are one space) modulo 20.

    0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and question marks away, 3 repeats it, 4 makes its role user.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def fault_of(text: Column, nth: Column) -> Column:
    """The first fault of a row: blank, duplicate (``nth`` of its role and text in its conversation), truncated, or none."""
    white = r"\x20\x09-\x0D"
    return F.when(~text.rlike(f"[^{white}]"), "blank").when(nth > 1, "duplicate").when(~text.rlike(rf"[.!?][{white}]*\z"), "truncated").otherwise("")


def _dealt(rows: DataFrame, conversations: DataFrame | None) -> DataFrame:
    """Rows by conversation and turn, each with its fault; a conversation of ``conversations`` has a row at least (``is_row`` false)."""
    from pyspark.sql import Window as W

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    all_rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.lit(True).alias("is_row"), text("role"), text("text"))
    if conversations is not None:
        ids = conversations.select(F.col("conv_id").cast("long")).distinct()
        all_rows = all_rows.unionByName(ids.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(False).alias("is_row"), F.lit("").alias("role"), F.lit("").alias("text")))
    # one exchange: the window's keys hold that of the exchange. Both sorts spill, and no conversation is held as a value
    by = all_rows.repartition("conv_id")
    nth = F.row_number().over(W.partitionBy("conv_id", "is_row", "role", "text").orderBy(F.asc_nulls_first("turn")))
    out = by.select("conv_id", "turn", "is_row", "role", F.left("role", F.lit(1)).alias("initial"), "text", nth.alias("nth"))
    out = out.withColumn("fault", fault_of(F.col("text"), F.col("nth"))).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "nth")
    return out.select("conv_id", "turn", "is_row", F.encode("role", "UTF-8").alias("role"), F.encode("initial", "UTF-8").alias("initial"), F.encode("text", "UTF-8").alias("text"), "fault")


def repair_report(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, from rows (conv_id, turn, role, text).

    gaps counts the missing turns between the least and the greatest; illegal the neighbours whose roles' initials aren't su, ua or au;
    audit has the initials of the cheapest edits in order (Keep, Rerole, Delete, Insert), repaired_sha256 the digest of the repaired rows
    (``role:text``, joined by line feeds). ``conversations`` (conv_id) adds those without rows: zeros, an empty audit, the digest of nothing.

    A null role or text is one space, so the row has no legal role, or is blank. Null turns come first; rows of one turn are taken by role and text,
    and rows that repeat are duplicates. Rows with a null conv_id are one conversation. An empty table gives an empty one. Other columns aren't read.
    A conversation's rows pass one task, as its digest is one hash; that task holds the rows that are not yet decided.
    """
    return _dealt(rows, conversations).mapInArrow(_reports, REPORT)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired rows themselves: conv_id, place (null for deleted rows), edit, role, text. Odd rows as in ``repair_report``."""
    return _dealt(rows, None).mapInArrow(_turns, TURNS)
