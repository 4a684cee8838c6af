"""Repair of conversations: the cheapest edits that make the roles ``(s?(ua)+)?``.

The rows of a conversation arrive in turn order: a shuffle by conversation with a secondary sort by
turn. Python walks over them once and carries, from one Arrow batch to the next, the state of a
dynamic programme over the four states of the role pattern:

* per state the least cost, and the place of its edit string among the others'. All strings have
  used the same rows and end with a row's edit, so none is the head of another; hence the order of
  two strings never changes, and comparing (cost, place) finds the ASCII-least of the cheapest;
* per live state the running digest of the conversation as repaired so far;
* costs relative to the least one and places take few values, so a step is a look-up in a table of
  transitions that fills itself; its number is the row's backpointer.

Backpointers of a conversation longer than ``spill_rows`` are written out as rows of the walk's
result, a table in the shared folder, packed into six bits per state; a second job reads them from
the last to the first. A task holds at most ``spill_rows`` of them and never a text but the current
one, and a lost executor repeats its own tasks alone. Duplicates are marked before the walk by a
window that needs no further shuffle and spills its sort. The digest of a conversation is sequential
by its nature, so one conversation is one task's stream, however long.

Nulls: roles and texts count as one space, a null turn sorts first and has no part in the gaps, the
rows with a null conversation id form one conversation. Rows that repeat a turn are ordered by role,
then text, and repeated rows are duplicates. Empty tables give empty results; columns other than the
four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgrain.llm.common import SPACE, stored

# Backpointers a task holds of one conversation before it writes them out, 8 MB, and those of one row.
SPILL_ROWS, CHUNK_ROWS = 1 << 20, 1 << 12

# Fixed values of the task: what an edit costs, and the roles that insertions and changes give.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
USER, ASSISTANT = "user", "assistant"

# The pattern (s?(ua)+)? as states: nothing yet, after s, after u, after a.
EMPTY, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {
    (EMPTY, "s"): AFTER_S, (EMPTY, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U,
}
# The one role of user and assistant that may follow a state.
WANTED = {EMPTY: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}
ROLE = {"u": USER, "a": ASSISTANT}
ACCEPTED = (EMPTY, AFTER_A)

# A row for the programme: its role initial (or "-" for any other) and what is wrong with it.
GOOD, MUST_GO, CUT = range(3)
INITIALS = "sua-"


def _after_inserts(state: int, n: int) -> int:
    for _ in range(n):
        state = NEXT[state, WANTED[state]]
    return state


class Programme:
    """The transitions met so far. A configuration is a tuple of (cost above the least, place) per
    live state; ``step`` gives the number of a transition, ``moves[number]`` its parts."""

    def __init__(self) -> None:
        self.configs: list[tuple] = []
        self._known: dict[tuple, int] = {}
        self._steps: dict[tuple[int, int], int] = {}
        # per transition: next configuration, cost added, {state: (from, inserts, edit)}
        self.moves: list[tuple[int, int, dict[int, tuple[int, int, str]]]] = []
        self.start = self._config({EMPTY: (0, 0)})

    def _config(self, live: dict[int, tuple[int, int]]) -> int:
        key = tuple(sorted((s, c, p) for s, (c, p) in live.items()))
        if key not in self._known:
            self._known[key] = len(self.configs)
            self.configs.append(key)
        return self._known[key]

    def step(self, config: int, kind: int) -> int:
        number = self._steps.get((config, kind))
        if number is None:
            number = self._steps[config, kind] = self._make(config, kind)
        return number

    def _make(self, config: int, kind: int) -> int:
        initial, fault = INITIALS[kind // 3], kind % 3
        extra = TRUNCATED if fault == CUT else 0
        best: dict[int, tuple] = {}
        for state, cost, place in self.configs[config]:
            for inserts in range(3):
                here = _after_inserts(state, inserts)
                edits = [(DELETE, "D", here)]
                if fault != MUST_GO:
                    if (here, initial) in NEXT:
                        edits.append((KEEP + extra, "K", NEXT[here, initial]))
                    edits.append((REROLE + extra, "R", NEXT[here, WANTED[here]]))
                for price, edit, to in edits:
                    rank = (cost + INSERT * inserts + price, place, "I" * inserts + edit)
                    if to not in best or rank < best[to][0]:
                        best[to] = (rank, (state, inserts, edit))
        least = min(rank[0] for rank, _ in best.values())
        cost = {s: rank[0] - least for s, (rank, _) in best.items()}
        # a state goes when another one does what it can for less, whatever follows; a tie stays
        bound = {
            EMPTY: [(AFTER_A, DELETE), (AFTER_U, INSERT + DELETE)], AFTER_S: [(AFTER_A, 0), (AFTER_U, INSERT)],
            AFTER_U: [(AFTER_A, INSERT)], AFTER_A: [(AFTER_U, INSERT)],
        }
        live = [s for s in best if not any(o in cost and cost[s] > cost[o] + more for o, more in bound[s])]
        order = sorted(live, key=lambda s: best[s][0][1:])
        nxt = self._config({s: (cost[s], order.index(s)) for s in live})
        self.moves.append((nxt, least, {s: best[s][1] for s in live}))
        return len(self.moves) - 1

    def finish(self, config: int) -> tuple[int, int, int]:
        """(cost still to add, state, inserts) of the cheapest, ASCII-least end."""
        ends = []
        for state, cost, place in self.configs[config]:
            inserts = next(n for n in range(3) if _after_inserts(state, n) in ACCEPTED)
            ends.append((cost + INSERT * inserts, place, state, inserts))
        cost, _, state, inserts = min(ends)
        return cost, state, inserts

    def back(self, numbers: list[int], state: int) -> str:
        """The edits of a whole conversation that ends in ``state``."""
        out = []
        for n in reversed(numbers):
            state, inserts, edit = self.moves[n][2][state]
            out.append("I" * inserts + edit)
        return "".join(reversed(out))

    def packed(self, numbers: list[int]) -> bytes:
        """Backpointers that need no table: per state six bits (from, inserts, edit)."""
        codes = [sum((f | i << 2 | EDITS.index(e) << 4) << 6 * s for s, (f, i, e) in m.items()) for _, _, m in self.moves]
        return np.array(codes, "<u4")[numbers].tobytes()


EDITS = "DKR"


def unpacked(moves: bytes, state: int) -> tuple[str, int]:
    """The edits of a run of rows that ends in ``state``, and the state before it."""
    out = []
    for code in np.frombuffer(moves, "<u4")[::-1].tolist():
        code >>= 6 * state
        state = code & 3
        out.append("I" * (code >> 2 & 3) + EDITS[code >> 4 & 3])
    return "".join(reversed(out)), state


class Walk:
    """One conversation: the programme's state, the digests and what is counted."""

    def __init__(self, programme: Programme) -> None:
        self.programme, self.config, self.cost = programme, programme.start, 0
        self.digests = {EMPTY: hashlib.sha256()}
        self.faults = [0, 0, 0]
        self.illegal, self.initial = 0, None
        self.low = self.high = self.turn = None
        self.turns = self.chunks = 0
        self.numbers: list[int] = []

    def row(self, fault: int, role: str, text: str, has_turn: bool, turn: int) -> None:
        if has_turn:
            if self.turn is None or turn != self.turn:
                self.turns, self.turn = self.turns + 1, turn
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if fault:
            self.faults[fault - 1] += 1
        place = INITIALS.find(initial) if initial in ("s", "u", "a") else 3
        number = self.programme.step(self.config, 3 * place + (GOOD, MUST_GO, MUST_GO, CUT)[fault])
        self.numbers.append(number)
        self.config, added, moves = self.programme.moves[number]
        self.cost += added
        before, uses = self.digests, {}
        for source, _, _ in moves.values():
            uses[source] = uses.get(source, 0) + 1
        self.digests = {}
        for state, (source, inserts, edit) in moves.items():
            uses[source] -= 1
            digest = before[source].copy() if uses[source] else before[source]
            self.digests[state] = _write(digest, source, inserts, edit, role, text)

    def pieces(self) -> Iterator[tuple[int, bytes]]:
        """(number, backpointers) of all rows since the last call; they are forgotten."""
        for at in range(0, len(self.numbers), CHUNK_ROWS):
            yield self.chunks, self.programme.packed(self.numbers[at : at + CHUNK_ROWS])
            self.chunks += 1
        self.numbers = []

    def end(self) -> tuple[int, int, str]:
        """(state before the last inserts, their number, hex digest of the repaired text)."""
        added, state, inserts = self.programme.finish(self.config)
        self.cost += added
        return state, inserts, _write(self.digests[state], state, inserts, "D", "", "").hexdigest()


def _write(digest, state: int, inserts: int, edit: str, role: str, text: str):
    for _ in range(inserts):
        digest.update((("\n" if state != EMPTY else "") + ROLE[WANTED[state]] + ":").encode())
        state = NEXT[state, WANTED[state]]
    if edit != "D":
        name = role if edit == "K" else ROLE[WANTED[state]]
        digest.update((("\n" if state != EMPTY else "") + name + ":" + text).encode())
    return digest


# one row per conversation (chunk null) and, for a long one, rows of backpointers; an empty ``conv``
# is the null id, all others are marked by a first character
_WALKED = (
    "conv string, chunk int, moves binary, gaps long, blank long, duplicate long, truncated long, illegal long,"
    " cost long, state int, inserts int, audit string, repaired_sha256 string"
)
_COLUMNS = [c.split()[0] for c in _WALKED.split(",")]
_FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_INPUT = ["conv", "present", "fault", "role", "text", "has_turn", "turn"]


def _walk(spill_rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        programme, walk, conv, out = Programme(), None, None, []

        def spill() -> None:
            out.extend([conv, number, moves, *[None] * 10] for number, moves in walk.pieces())

        def close() -> None:
            state, inserts, digest = walk.end()
            audit = None
            if walk.chunks:
                spill()
            else:
                audit = programme.back(walk.numbers, state) + "I" * inserts
            gaps = 0 if walk.low is None else walk.high - walk.low + 1 - walk.turns
            out.append([conv, None, None, gaps, *walk.faults, walk.illegal, walk.cost, state, inserts, audit, digest])

        def frame() -> pd.DataFrame:
            done = pd.DataFrame(out, columns=_COLUMNS, dtype=object)
            out.clear()
            return done

        for pdf in batches:
            for name, present, fault, role, text, has_turn, turn in zip(*(pdf[c] for c in _INPUT), strict=True):
                if walk is None or name != conv:
                    if walk is not None:
                        close()
                    walk, conv = Walk(programme), name
                if present:
                    walk.row(fault, role, text, has_turn, turn)
                    if len(walk.numbers) >= spill_rows:
                        spill()
                        yield frame()
            if out:
                yield frame()
        if walk is not None:
            close()
            yield frame()

    return run


def _trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads a conversation's own row, then its backpointers from the last to the first."""
    conv, state, parts = None, None, []

    def done() -> pd.DataFrame:
        return pd.DataFrame({"conv": [conv], "audit": ["".join(reversed(parts))]})

    for pdf in batches:
        for name, chunk, moves, end, inserts in zip(*(pdf[c] for c in ("conv", "chunk", "moves", "state", "inserts")), strict=True):
            if pd.isna(chunk):
                if conv is not None:
                    yield done()
                conv, state, parts = name, int(end), ["I" * int(inserts)]
            else:
                text, state = unpacked(moves, state)
                parts.append(text)
    if conv is not None:
        yield done()


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): rows damaged by the CRC-32 of ``conv_id:turn``, modulo 20.

    0: dropped (the row stays with ``present`` false, so that its conversation is known), 1: text
    emptied, 2: without ``.!?``, 3: repeated, 4: role user; all others as they are. A null counts as
    one space.
    """
    space = F.lit(" ")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    rows = conversations.select(
        "conv_id", "turn", (F.crc32(name) % 20).alias("how"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")
    )
    how = F.col("how")
    return rows.select(
        "conv_id", "turn",
        F.when(how == 4, F.lit(USER)).otherwise(F.col("role")).alias("role"),
        F.when(how == 1, F.lit("")).when(how == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(how != 0, F.when(how == 3, 2).otherwise(1))).alias("present"),
    )


def _ordered(conversations: DataFrame) -> DataFrame:
    """The walk's input: rows by conversation and turn, with ``fault`` (1 blank, 2 seen before, 3 cut
    off, 0 none) and empty texts where a row was dropped.

    The window and both sorts use the one shuffle by conversation.
    """
    space = F.lit(" ")
    present = F.col("present") if "present" in conversations.columns else F.lit(True)
    text, order = F.col("text"), [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        F.col("turn").cast("long").alias("turn"), present.alias("present"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
    ).repartition("conv")
    # a row that was dropped is no earlier row
    nth = F.row_number().over(Window.partitionBy("conv", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    fault = (
        F.when(~text.rlike(rf"[^{SPACE}]"), 1).when(nth > 1, 2).when(~text.rlike(rf"[.!?][{SPACE}]*\z"), 3).otherwise(0)
    )
    marked = rows.withColumn("fault", fault).sortWithinPartitions("conv", *order)
    return marked.select(
        "conv", "present", "fault", "role", "text", F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn")
    )


def _id(conversations: DataFrame):
    kind = conversations.schema["conv_id"].dataType
    return F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(kind).alias("conv_id")


def repair(conversations: DataFrame, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    ``conversations`` has conv_id, turn, role, text and, if some rows only name their conversation,
    a boolean ``present``. A conversation without rows has zeros, no edits and the digest of nothing.
    """
    walked = stored(_ordered(conversations).mapInPandas(_walk(spill_rows), _WALKED), "walked")
    whole = walked.where("chunk IS NULL")
    columns = [_id(conversations), *_FACTS, "audit", "repaired_sha256"]
    if walked.where("chunk IS NOT NULL").isEmpty():
        return whole.select(*columns)
    long = walked.where("chunk IS NOT NULL OR audit IS NULL").select("conv", "chunk", "moves", "state", "inserts")
    traced = long.repartition("conv").sortWithinPartitions("conv", F.desc_nulls_first("chunk")).mapInPandas(_trace, "conv string, audit string")
    late = whole.where("audit IS NULL").drop("audit").join(traced, "conv")
    return whole.where("audit IS NOT NULL").select(*columns).union(late.select(*columns))


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A conversation's edits, then its rows; gives the repaired rows."""
    conv, edits, at, state, place = None, "", 0, EMPTY, 0

    def inserted(out: list) -> None:
        nonlocal at, state, place
        while edits[at : at + 1] == "I":
            out.append((conv, place, "insert", ROLE[WANTED[state]], ""))
            at, state, place = at + 1, NEXT[state, WANTED[state]], place + 1

    for pdf in batches:
        out: list = []
        for name, audit, role, text in zip(*(pdf[c] for c in ("conv", "audit", "role", "text")), strict=True):
            if role is None or pd.isna(role):
                inserted(out)  # those at the end of the conversation before
                conv, edits, at, state, place = name, audit, 0, EMPTY, 0
                continue
            inserted(out)
            edit, at = edits[at], at + 1
            if edit != "D":
                new = role if edit == "K" else ROLE[WANTED[state]]
                out.append((conv, place, "keep" if edit == "K" else "rerole", new, text))
                state, place = NEXT[state, role[:1] if edit == "K" else WANTED[state]], place + 1
        yield pd.DataFrame(out, columns=["conv", "position", "edit", "role", "text"])
    out = []
    inserted(out)
    yield pd.DataFrame(out, columns=["conv", "position", "edit", "role", "text"])


def repaired_turns(conversations: DataFrame, repaired: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the conversations after the edits of ``repair``.

    The edits of a conversation travel as its first row, so that one pass over the sorted rows
    applies them.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    none = F.lit(None).cast("string")
    first = repaired.select(key.alias("conv"), "audit", none.alias("role"), none.alias("text"), F.lit(None).cast("long").alias("turn"))
    present = F.col("present") if "present" in conversations.columns else F.lit(True)
    rows = conversations.where(present).select(
        key.alias("conv"), none.alias("audit"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.col("turn").cast("long").alias("turn"),
    )
    both = first.union(rows).withColumn("is_row", F.col("audit").isNull()).repartition("conv")
    ordered = both.sortWithinPartitions("conv", "is_row", F.col("turn").asc_nulls_first(), "role", "text")
    applied = ordered.mapInPandas(_apply, "conv string, position long, edit string, role string, text string")
    return applied.select(_id(conversations), "position", "edit", "role", "text")
