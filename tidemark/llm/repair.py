"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and user/assistant pairs.

Rows are dealt out by conversation and sorted by turn, the last one first. One pass carries four costs across
Arrow batches: what the rest of the conversation costs from each state of ``(s?(ua)+)?``. For each row it notes, in a byte, the first
edit of the cheapest rest from each state; ties go to the least letter, which makes the whole audit the least. From the first row on
these bytes are then followed. What is noted of a conversation beyond a bound is spilled to an unnamed temporary file of the task.
Rows seen earlier are found by a window over (conversation, role, digest of the text), so a giant conversation is spread there.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a row can be charged with; the first that holds counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1  # costs
_D, _I, _K, _R = range(4)  # edits in the order of their initials
_START, _SYSTEM, _USER, _ASSISTANT = range(4)  # states, by what was emitted last
_NEXT, _ROLE = (_USER, _USER, _ASSISTANT, _USER), ("user", "user", "assistant", "user")  # what may always follow a state
_KEEP = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}
#: Characters of a conversation that a task holds before it spills.
HELD = 32 << 20


class Notes:
    """A stack of (byte, role, text), most of it on disk where it is long."""

    def __init__(self, held: int):
        self.limit, self.file, self.chunks = held, None, []
        self.rows, self.size = [], 0

    def push(self, note: int, role: str, text: str) -> None:
        self.rows.append((note, role, text))
        self.size += len(text) + 64
        if self.size > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            self.chunks.append(self.file.tell())
            pickle.dump(self.rows, self.file)
            self.rows, self.size = [], 0

    def drain(self) -> Iterator[tuple[int, str, str]]:
        """From the last one pushed to the first."""
        yield from reversed(self.rows)
        for at in reversed(self.chunks):
            self.file.seek(at)
            yield from reversed(pickle.load(self.file))
        if self.file:
            self.file.close()


class Conversation:
    """The state of one conversation, its rows pushed from the last to the first."""

    def __init__(self, key: str | None, held: int = HELD):
        self.key, self.notes = key, Notes(held)
        self.rest = (0, 2 * INSERT, INSERT, 0)  # cost of what is missing behind the last row, by state
        self.faults, self.illegal, self.later = [0, 0, 0, 0], 0, None
        self.first = self.last = None
        self.turns = 0

    def push(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            self.turns += turn != self.first
            self.first, self.last = turn, turn if self.last is None else self.last
        self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.later is not None and initial + self.later not in ("su", "ua", "au")
        self.later = initial
        must_go, extra, keep, rest = fault in (BLANK, DUPLICATE), UNFINISHED * (fault == TRUNCATED), _KEEP.get(initial, {}), self.rest
        best = []
        for state in range(4):
            cost, edit = DELETE + rest[state], _D
            if not must_go:
                if state in keep and extra + rest[keep[state]] < cost:
                    cost, edit = extra + rest[keep[state]], _K
                if REROLE + extra + rest[_NEXT[state]] < cost:
                    cost, edit = REROLE + extra + rest[_NEXT[state]], _R
            best.append((cost, edit))
        for state in (_USER, _ASSISTANT, _START, _SYSTEM):  # two inserts never lead back more cheaply, so these two first
            best[state] = min(best[state], (INSERT + best[_NEXT[state]][0], _I))
        self.rest = tuple(cost for cost, _ in best)
        self.notes.push(sum(edit << 2 * state for state, (_, edit) in enumerate(best)), role, text)

    def result(self) -> tuple:
        state, audit, digest, lines = _START, bytearray(), hashlib.sha256(), 0

        def emit(role: str, text: str) -> None:
            nonlocal lines
            digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
            lines += 1

        for note, role, text in self.notes.drain():
            while (edit := note >> 2 * state & 3) == _I:
                audit += b"I"
                emit(_ROLE[state], "")
                state = _NEXT[state]
            audit += b"DIKR"[edit : edit + 1]
            if edit == _K:
                emit(role, text)
                state = _KEEP[role[:1]][state]
            elif edit == _R:
                emit(_ROLE[state], text)
                state = _NEXT[state]
        while state in (_SYSTEM, _USER):
            audit += b"I"
            emit(_ROLE[state], "")
            state = _NEXT[state]
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.key, gaps, *self.faults[1:], self.illegal, self.rest[_START], audit.decode(), digest.hexdigest()


_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_OUT = ["key", *_NUMBERS, "audit", "repaired_sha256"]


def _repaired(held: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for frame in frames:
            done = []
            for key, known, turn, numbered, role, text, fault, gone in zip(*(frame[c].tolist() for c in ("key", "known", "turn", "numbered", "role", "text", "fault", "gone"))):
                key = key if known else None
                if now is None or now.key != key:
                    if now:
                        done.append(now.result())
                    now = Conversation(key, held)
                if not gone:
                    now.push(turn if numbered else None, role, text, fault)
            yield pd.DataFrame(done, columns=_OUT)
        if now:
            yield pd.DataFrame([now.result()], columns=_OUT)

    return run


def faults(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """``rows`` (conv, turn, role, text) with ``seen`` (an equal role and text came earlier) and ``fault``."""
    text = F.col("text")
    earlier = Window.partitionBy("conv", "role", F.sha2(text.cast("binary"), 256), *([gone] if gone else [])).orderBy(F.col("turn").asc_nulls_first())
    seen = rows.withColumn("seen", F.row_number().over(earlier) > 1)
    fault = (
        F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("seen"), DUPLICATE)
        .when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(SOUND)
    )
    return seen.withColumn("fault", fault)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: str | None = None, held: int = HELD) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Rows are taken by turn, null turns first, then by role and text. Null roles and texts count as one space; rows of a null
    conversation are one conversation. A role without a known initial can't be kept. ``gone`` names a flag of rows that
    are only there to name their conversation; one without other rows has zeros, an empty audit and the hash of nothing.
    An empty table has no rows; other columns are not read.
    """
    kind = dict(rows.dtypes)[conv_col]
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    flag = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    known = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), flag.alias("gone"))
    judged = faults(known, "gone")
    plain = judged.select(
        F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("key"), F.col("conv").isNotNull().alias("known"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), F.col("turn").isNotNull().alias("numbered"),
        "role", "text", "seen", "fault", "gone",
    )
    late = [F.col(c).desc() for c in ("numbered", "turn", "role", "text", "seen")]
    sorted_rows = plain.repartition("key", "known").sortWithinPartitions("key", "known", *late).drop("seen")
    schema = f"key string, {', '.join(c + ' long' for c in _NUMBERS)}, audit string, repaired_sha256 string"
    return sorted_rows.mapInPandas(_repaired(held), schema).select(F.col("key").cast(kind).alias(conv_col), *_OUT[1:])


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of (conversation, turn), for a test of :func:`repair`; ``_gone`` marks what is dropped.

    A null role or text becomes one space, a null id or turn is hashed as one.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    changed = rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("_gone"), copies.alias("_copy"))
    return changed.drop("_copy")
