"""Chat formatting: role sequences repaired at least cost, then rendered.

Legal conversations are an optional system turn, then user and assistant turns in
alternation, the last one by the assistant. States of the automaton are the last turn's role;
``START`` is before the first turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pathloom.llm.common import saved
from pathloom.operators.numbering import number_rows, range_of

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
#: Role names that mean the same; any other, and null, is unknown.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
BLOCK = 512  # turns, or blocks of the level below, that are combined at once
CROWDED = 4  # rows a turn number, above which blocks are cut by rows
FAR = 10**12
NONE = -(1 << 63)  # stands for a null number inside; nothing is before it


@dataclass(frozen=True)
class Costs:
    """Whole numbers, so that sums have one value in any order."""

    merge: int = 2  # join a turn to the one before, which has the same role
    relabel: int = 3  # give a turn another role
    unknown: int = 1  # give a turn of unknown role a role
    insert: int = 4  # put an empty turn before a turn, or at the end


def number_of(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return NAMES.index(name) if name in NAMES else START  # START: unknown


def insertions(state: int, role: int) -> list[int] | None:
    """Roles of the empty turns that lead from ``state`` to where ``role`` is legal; the fewest."""
    frontier = [(state, [])]
    seen = {state}
    while frontier:
        at, path = frontier.pop(0)
        if role in NEXT[at]:
            return path
        for step in NEXT[at]:
            if step not in seen:
                seen.add(step)
                frontier.append((step, [*path, step]))
    return None


class Automaton:
    """Costs of each step: from a state, by a turn of some role, to the role that it is given."""

    def __init__(self, costs: Costs) -> None:
        self.merge = np.zeros((4, 4), bool)
        self.path: dict[tuple[int, int], list[int]] = {}
        move = np.full((4, 4), FAR, np.int64)
        for state in range(4):
            for role in (SYSTEM, USER, ASSISTANT):
                path = insertions(state, role)
                if path is not None:
                    move[state, role] = costs.insert * len(path)
                    self.path[state, role] = path
                if state == role and costs.merge <= move[state, role]:
                    move[state, role] = costs.merge
                    self.merge[state, role] = True
        label = np.full((4, 4), costs.relabel, np.int64)
        np.fill_diagonal(label, 0)
        label[START] = costs.unknown
        label[:, START] = FAR  # no turn becomes the start
        #: step[r][a, b]: cheapest way for a turn of role r (START: unknown) from state a to state b.
        self.step = np.minimum(move[None] + label[:, None, :], FAR)
        #: What it costs to end in a state: an empty conversation may end at once.
        self.end = np.array([0, 2 * costs.insert, costs.insert, 0], np.int64)
        self.tail = ([], [USER, ASSISTANT], [ASSISTANT], [])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-cost composition of two stretches of turns."""
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR)


IDENTITY = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)


def best_path(steps: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """States after each step of the cheapest way from ``entry`` to ``leave``; the smallest states on ties."""
    costs = [np.full(4, FAR, np.int64)]
    costs[0][entry] = 0
    for step in steps:
        costs.append(np.minimum((costs[-1][:, None] + step).min(axis=0), FAR))
    states = [leave]
    for step, before in zip(reversed(steps), reversed(costs[:-1])):
        states.append(int((before + step[:, states[-1]]).argmin()))
    return states[::-1][1:]


def rendered(role: int, text: str | None, joined: bool, closed: bool) -> str:
    """A turn's part of the conversation's text: header, text, end; a merged turn continues the text."""
    head = "\n" if joined else f"<|im_start|>{NAMES[role]}\n"
    return head + (text or "") + ("<|im_end|>\n" if closed else "")


OUT = "conv_id long, turn long, sub int, role string, was string, action string, text string, rendered string"


def repair(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The repaired turns of all conversations (conv_id, turn, role, text).

    Columns: conv_id, turn, sub, role, was, action, text, rendered. ``action`` is ``keep``,
    ``relabel``, ``merge``, ``merge+relabel`` or ``insert``. Inserted turns have an empty text
    and stand before the turn whose number they carry, by ``sub`` from 0; those that close a
    conversation follow its last turn. ``rendered`` parts, joined in order of (turn, sub), are
    the conversation's text: an end mark is written by the turn after which a new one begins.

    The costs of a stretch of turns are a small matrix, and stretches combine like one turn. A
    conversation is cut into blocks of ``BLOCK`` turn numbers, or of ``BLOCK`` rows where a block of numbers
    has more than ``CROWDED`` rows a number (numbers are null or repeat), blocks into blocks of blocks,
    until each conversation is one: then the cheapest way is handed down, level by level, so
    that each block knows the states it begins and ends in, and repairs itself. No task
    holds a conversation, only a block's steps.

    Roles are matched without case and outer blanks, with common aliases; a null or other
    role is unknown. A null text is empty. Turns without a number come first, equal numbers
    are in order of role and text, so repeated rows are turns that follow each other; rows
    without a conv_id are one conversation, with a null id. An empty table gives no rows. Other
    columns are ignored.
    """
    auto = Automaton(costs)
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NONE)).alias("key"),
        F.coalesce(F.col("turn").cast("long"), F.lit(NONE)).alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    # Blocks count from that of NONE, so all are 0 or more and meet in one block at last.
    by_turn = rows.withColumn("block", range_of("turn", BLOCK) - F.lit(NONE // BLOCK))
    if by_turn.groupBy("key", "block").count().where(F.col("count") > CROWDED * BLOCK).isEmpty():
        rows = by_turn
    else:
        # Many turns of one number, or none: blocks are cut by the place of a row in the order of all.
        placed = number_rows(rows.withColumn("tie", F.monotonically_increasing_id()), "key", ["turn", "role", "text", "tie"])
        rows = placed.withColumn("block", range_of("n", BLOCK)).drop("tie", "n")
    order = ["key", "block", "turn", "role", "text"]
    rows = rows.repartition("key", "block").sortWithinPartitions(*order)

    def stretches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The matrix of each block: constant memory, one product per turn."""
        open_key, matrix = None, IDENTITY
        for frame in frames:
            out = []
            for key, block, role in zip(frame["key"], frame["block"], frame["role"]):
                if (key, block) != open_key:
                    if open_key is not None:
                        out.append((*open_key, matrix.ravel().tolist()))
                    open_key, matrix = (key, block), IDENTITY
                matrix = product(matrix, auto.step[number_of(role)])
            yield pd.DataFrame(out, columns=["key", "block", "costs"])
        if open_key is not None:
            yield pd.DataFrame([(*open_key, matrix.ravel().tolist())], columns=["key", "block", "costs"])

    block_schema = "key long, block long, costs array<long>"
    levels = [saved(rows.select("key", "block", "turn", "role", "text").mapInPandas(stretches, block_schema), "chat-blocks")]

    def upper(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, matrix = None, IDENTITY
        for frame in frames:
            out = []
            for key, up, own in zip(frame["key"], frame["up"], frame["costs"]):
                if (key, up) != open_key:
                    if open_key is not None:
                        out.append((*open_key, matrix.ravel().tolist()))
                    open_key, matrix = (key, up), IDENTITY
                matrix = product(matrix, np.asarray(own, np.int64).reshape(4, 4))
            yield pd.DataFrame(out, columns=["key", "block", "costs"])
        if open_key is not None:
            yield pd.DataFrame([(*open_key, matrix.ravel().tolist())], columns=["key", "block", "costs"])

    up = range_of("block", BLOCK).alias("up")
    while levels[-1].groupBy("key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        below = levels[-1].select("key", "block", "costs", up).repartition("key", "up").sortWithinPartitions("key", "up", "block")
        levels.append(saved(below.select("key", "up", "block", "costs").mapInPandas(upper, block_schema), "chat-blocks"))

    @F.pandas_udf("int")
    def last_state(matrices: pd.Series) -> pd.Series:
        return pd.Series([int((np.asarray(m, np.int64).reshape(4, 4)[START] + auto.end).argmin()) for m in matrices]).astype("int32")

    # From the top down: the first and the last state of each block.
    known = levels[-1].select("key", "block", F.lit(START).alias("entry"), last_state("costs").alias("leave"))

    def lower(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solved(group: list[tuple]) -> list[tuple]:
            steps = [np.asarray(g[3], np.int64).reshape(4, 4) for g in group]
            path = best_path(steps, group[0][4], group[0][5])
            entries = [group[0][4], *path[:-1]]
            return [(g[0], g[2], a, b) for g, a, b in zip(group, entries, path)]

        group: list[tuple] = []
        for frame in frames:
            out = []
            for row in zip(frame["key"], frame["up"], frame["block"], frame["costs"], frame["entry"], frame["leave"]):
                if group and row[:2] != group[0][:2]:
                    out += solved(group)
                    group = []
                group.append(row)
            yield pd.DataFrame(out, columns=["key", "block", "entry", "leave"])
        if group:
            yield pd.DataFrame(solved(group), columns=["key", "block", "entry", "leave"])

    for level in reversed(levels[:-1]):
        both = level.select("key", "block", "costs", up).join(known.withColumnRenamed("block", "up"), ["key", "up"])
        both = both.repartition("key", "up").sortWithinPartitions("key", "up", "block")
        both = both.select("key", "up", "block", "costs", "entry", "leave")
        known = saved(both.mapInPandas(lower, "key long, block long, entry int, leave int"), "chat-states")

    ends = levels[0].groupBy("key").agg(F.max("block").alias("block")).withColumn("last", F.lit(True))
    known = known.join(ends, ["key", "block"], "left").select("key", "block", "entry", "leave", F.coalesce("last", F.lit(False)).alias("last"))
    both = rows.join(known, ["key", "block"]).repartition("key", "block").sortWithinPartitions(*order)

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solved(group: list[tuple]) -> list[tuple]:
            entry, leave, last = group[0][5:]
            path = best_path([auto.step[number_of(g[3])] for g in group], int(entry), int(leave))
            out, state = [], int(entry)
            plan = []  # (row, role, merged, inserted before)
            for row, role in zip(group, path):
                joined = bool(auto.merge[state, role])
                plan.append((row, role, joined, [] if joined else auto.path[state, role]))
                state = role
            for (_, _, turn, was, text, *_), role, joined, before in plan:
                sub = 0
                first = len(out) == 0 and entry != START
                closing = "" if joined or (len(out) == 0 and not first) else "<|im_end|>\n"
                for empty in before:
                    out.append((turn, sub, NAMES[empty], None, "insert", "", closing + rendered(empty, "", False, False)))
                    closing, sub = "<|im_end|>\n", sub + 1
                changed = number_of(was) != role
                action = ("merge+relabel" if changed else "merge") if joined else "relabel" if changed else "keep"
                out.append((turn, sub, NAMES[role], was, action, text or "", closing + rendered(role, text, joined, False)))
            turn, sub = out[-1][0], out[-1][1] + 1
            if last:
                closing = "<|im_end|>\n"
                for empty in auto.tail[state]:
                    out.append((turn, sub, NAMES[empty], None, "insert", "", closing + rendered(empty, "", False, False)))
                    sub += 1
                out[-1] = (*out[-1][:6], out[-1][6] + "<|im_end|>\n")
            return [(group[0][0], *row) for row in out]

        names = [c.split()[0] for c in OUT.split(", ")]

        def frame_of(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype({"sub": "int32"})

        group: list[tuple] = []
        for frame in frames:
            out = []
            for row in zip(*[frame[c] for c in columns]):
                if group and row[:2] != group[0][:2]:
                    out += solved(group)
                    group = []
                group.append(row)
            yield frame_of(out)
        if group:
            yield frame_of(solved(group))

    columns = ["key", "block", "turn", "role", "text", "entry", "leave", "last"]
    out = both.select(*columns).mapInPandas(emit, OUT)
    return out.withColumns({c: F.when(F.col(c) != NONE, F.col(c)) for c in ("conv_id", "turn")})
