"""Repair of conversations whose turns were lost, emptied, cut off, repeated or given the wrong role.

A conversation reads well if the initials of its roles are ``(s?(ua)+)?``. Each row is kept (0), given the role user or assistant
(2) or deleted (3; blank rows and repeats must be); turns with empty text can be put in anywhere (2); a row that ends without
``.``, ``!`` or ``?`` and stays adds 1. Of the cheapest lists of edits the one whose initials (K, R, D, I) are least by ASCII counts.

How it runs: rows are sorted by range of conversation and turn, so that a conversation of any length spreads over tasks, and cut
in segments of at most ``SEGMENT`` rows. Segments are bucketed by length and stacked time-major: arrays [row, state, segment]. A
sweep backward over the rows keeps the cost to go of all four states of all segments; a sweep forward reads the edits off it, one
row of all segments at a time. A segment of a conversation with several is first swept once for each state that it may end in,
which gives a 4 x 4 matrix; the matrices of a conversation are chained to give each segment the costs to go at its end, and
maps from entry to exit states are chained likewise. What leaves a segment is put together by a sorted stream that holds a hash, the edits
and counts, not the texts.

Defined results: a null role or text reads as one space, so it is no role and a blank text. A null conversation is one, apart
from others; null turns come first and count neither as gaps nor as turns. Rows of one turn are ordered by role and a hash of
their text, and equal ones are repeats of the first. A conversation without rows gives zeros, no edits and the hash of nothing. Only the first
character of a role tells its kind. Columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.memory import modest_batches, release
from inkstone.llm.scratch import Scratch

#: Rows of a segment at most, and segments that are swept at a time (their rows together, padding included).
SEGMENT = 4_096
CELLS = 1 << 18

# States: nothing yet, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a row leads to which takes the role that comes next, and that role.
NEXT = np.array([USER, USER, ASSISTANT, USER])
ROLES = np.array(["user", "user", "assistant", "user"], dtype=object)
FAR = 1 << 40
REROLE, DELETE, INSERT = 2, 3, 2
#: Costs to go when all rows are read: of a text that may end here, or lacks turns.
END = np.array([0, 4, 2, 0])

FINE, TRUNCATED, DUPLICATE, BLANK = range(4)


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv turn role text gone``: each fifth row or so is changed, by a hash of its conversation and turn. Rows that are dropped
    stay as ``gone``, so that no conversation is forgotten."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), shown(role).alias("role"), shown(text).alias("text"), F.pmod(F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")), F.lit(20)).alias("hash"))
    h = F.col("hash")
    rows = rows.withColumns({"text": F.when(h == 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")), "role": F.when(h == 4, "user").otherwise(F.col("role")), "gone": h == 0})
    return rows.withColumn("copy", F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("hash", "copy")


def faulty(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """With ``fault``, the first that holds, and ``tie``, which tells equal rows apart."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    own = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    same = F.sha2(F.concat_ws("\n", shown("conv"), F.char_length("role"), "role", "text"), 256)
    rows = scratch.keep(rows.withColumns({"own": own, "same": same, "tie": F.monotonically_increasing_id()}), "rows")
    place = F.struct(F.col("turn").isNotNull().alias("there"), "turn", "tie")
    # only texts that occur again are looked up; counts are summed before the shuffle, and the join's large keys can be split
    again = rows.where(~F.col("gone")).groupBy("same").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    rows = rows.join(again, "same", "left")
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.col("first").isNotNull() & (F.col("first") != place), DUPLICATE).otherwise(F.col("own"))
    return rows.select("conv", "turn", "role", "text", "gone", fault.cast("int").alias("fault"), "same", "tie")


SEGMENTS = "conv {conv}, at long, n int, roles array<string>, texts array<string>, faults array<int>, low long, high long, turns long, first_turn long, last_turn long"


def segments(rows: DataFrame) -> DataFrame:
    """Runs of rows of one conversation in order, those of a task numbered by ``at``."""
    conv_type = rows.schema["conv"].dataType
    kind = SEGMENTS.format(conv=conv_type.simpleString())

    def segment(conv, at: int, turns: list, roles: list, texts: list, faults: list) -> tuple:
        known = [t for t in turns if t is not None]
        return conv, at, len(turns), roles, texts, faults, min(known, default=None), max(known, default=None), len(set(known)), known[0] if known else None, known[-1] if known else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_, held = TaskContext.get().partitionId() << 32, None, ([], [], [], [])
        names = [part.strip().split(" ")[0] for part in kind.split(", ")]
        types = [None, pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.int64()] * 5]
        for batch in batches:
            types[0] = batch.schema.field("conv").type
            out = []
            for conv, turn, role, text, gone, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "gone", "fault")), strict=True):
                if open_ is None or open_[0] != conv or len(held[0]) == SEGMENT:
                    if open_ is not None:
                        out.append(segment(open_[0], at, *held))
                        at, held = at + 1, ([], [], [], [])
                    open_ = (conv,)
                if not gone:
                    for kept, value in zip(held, (turn, role, text, fault), strict=True):
                        kept.append(value)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if open_ is not None:
            out = [segment(open_[0], at, *held)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        release()

    order = ["conv", F.asc_nulls_first("turn"), "role", "same", "tie"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "gone", "fault").mapInArrow(run, kind)


class Stack:
    """Segments of similar length, time-major. Rows beyond a segment's end cost nothing and change nothing."""

    def __init__(self, roles: list[list[str]], faults: list[list[int]]):
        self.lengths = np.array([len(r) for r in roles])
        self.rows, self.n = int(self.lengths.max(initial=0)), len(roles)
        kinds, self.faults = np.full((self.rows, self.n), -1, dtype=np.int8), np.full((self.rows, self.n), -1, dtype=np.int8)
        code = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
        for i, (r, f) in enumerate(zip(roles, faults, strict=True)):
            kinds[: len(r), i] = [code.get(x[:1], START) for x in r]
            self.faults[: len(f), i] = f
        late = np.where(self.faults == TRUNCATED, 1, 0)
        must_go = self.faults >= DUPLICATE
        # costs [row, state, segment] of keeping the row and of giving it the role that is due
        self.keep = np.full((self.rows, 4, self.n), FAR, dtype=np.int64)
        for state, kept in ((START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
            self.keep[:, state] = np.where((kinds == kept) & ~must_go, late, self.keep[:, state])
        self.rerole = np.where(must_go, FAR, late + REROLE)[:, None, :].repeat(4, axis=1)
        self.kept_to = np.where((kinds == SYSTEM)[:, None, :] & (np.arange(4) == START)[None, :, None], SYSTEM, NEXT[None, :, None])
        self.beyond = self.faults < 0

    def backward(self, end: np.ndarray) -> np.ndarray:
        """Costs to go [row + 1, state, segment], given those at the end [state, segment]; what is put in before a row counts from it."""
        cost = np.empty((self.rows + 1, 4, self.n), dtype=np.int64)
        cost[self.rows] = end
        for t in range(self.rows - 1, -1, -1):
            after = cost[t + 1]
            here = np.minimum(self.keep[t] + np.take_along_axis(after, self.kept_to[t], axis=0), self.rerole[t] + after[NEXT])
            here = np.minimum(here, DELETE + after)
            for _ in range(2):  # two turns put in lead round
                here = np.minimum(here, INSERT + here[NEXT])
            cost[t] = np.where(self.beyond[t], after, here)
        return cost

    def forward(self, cost: np.ndarray, entry: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The edits of each step as arrays of letters and states before them, each with its row; and the states at the end."""
        state, who, steps = entry.copy(), np.arange(self.n), []
        for t in range(self.rows):
            waiting = ~self.beyond[t]
            for _ in range(4):
                if not waiting.any():
                    break
                here, after = cost[t][state, who], cost[t + 1]
                to = self.kept_to[t][state, who]
                drop = waiting & (DELETE + after[state, who] == here)
                put = waiting & ~drop & (INSERT + cost[t][NEXT[state], who] == here)
                keep = waiting & ~drop & ~put & (self.keep[t][state, who] + after[to, who] == here)
                rerole = waiting & ~drop & ~put & ~keep
                steps.append((t, np.where(drop, "D", np.where(put, "I", np.where(keep, "K", np.where(rerole, "R", "")))), state))
                state = np.where(put | rerole, NEXT[state], np.where(keep, to, state))
                waiting = put
        return steps, state


def stacks(table: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of a table of segments whose lengths are within a factor of two, of bounded size."""
    bucket = np.frexp(table["n"].to_numpy().astype(np.float64))[1]
    for b in np.unique(bucket):
        part = table[bucket == b]
        at_a_time = max(1, CELLS >> int(b))
        for i in range(0, len(part), at_a_time):
            yield part.iloc[i : i + at_a_time]


def _lists(part: pd.DataFrame) -> tuple[list, list]:
    return [list(r) for r in part["roles"]], [list(f) for f in part["faults"]]


def crossings(segs: DataFrame) -> DataFrame:
    """``conv at cost``: the cost from each state at a segment's start to each at its end, row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in stacks(batch):
                stack = Stack(*_lists(part))
                ends = [np.where(np.arange(4) == f, 0, FAR)[:, None].repeat(stack.n, axis=1) for f in range(4)]
                made = np.stack([stack.backward(end)[0] for end in ends], axis=1)  # [start, end, segment]
                yield pd.DataFrame({"conv": part["conv"].array, "at": part["at"].array, "cost": list(made.reshape(16, stack.n).T)})

    kind = segs.schema["conv"].dataType.simpleString()
    return segs.select("conv", "at", "n", "roles", "faults").mapInPandas(run, f"conv {kind}, at long, cost array<long>")


def put_in_first(cost: np.ndarray) -> np.ndarray:
    for _ in range(2):
        cost = np.minimum(cost, INSERT + cost[NEXT])
    return cost


def chained_back(crossed: DataFrame) -> DataFrame:
    """``conv at goal``: costs to go at the end of each segment. Sixteen numbers a segment meet, no texts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        goal, goals = END.astype(np.int64), []
        for cost in reversed(group["cost"].tolist()):
            goals.append(goal)
            goal = np.minimum(FAR, (np.asarray(cost).reshape(4, 4) + goal[None, :]).min(axis=1))
        return pd.DataFrame({"conv": group["conv"], "at": group["at"], "goal": goals[::-1]})

    return crossed.groupBy("conv").applyInPandas(run, f"conv {crossed.schema['conv'].dataType.simpleString()}, at long, goal array<long>")


def exits(segs: DataFrame) -> DataFrame:
    """``conv at leads``: the state that each state at a segment's start leads to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in stacks(batch):
                stack = Stack(*_lists(part))
                cost = stack.backward(np.stack(part["goal"].tolist(), axis=1))
                leads = np.stack([stack.forward(cost, np.full(stack.n, q))[1] for q in range(4)], axis=1)
                yield pd.DataFrame({"conv": part["conv"].array, "at": part["at"].array, "leads": list(leads)})

    kind = segs.schema["conv"].dataType.simpleString()
    return segs.select("conv", "at", "n", "roles", "faults", "goal").mapInPandas(run, f"conv {kind}, at long, leads array<int>")


def chained_forward(led: DataFrame) -> DataFrame:
    """``conv at entry``: the state at each segment's start."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        states = [START]
        for leads in group["leads"]:
            states.append(int(leads[states[-1]]))
        return pd.DataFrame({"conv": group["conv"], "at": group["at"], "entry": states[:-1]})

    return led.groupBy("conv").applyInPandas(run, f"conv {led.schema['conv'].dataType.simpleString()}, at long, entry int")


def _edited(stack: Stack, part: pd.DataFrame, last: np.ndarray) -> tuple[list[str], list[list[str]]]:
    """Edits and repaired lines of each segment; ``last``: whether the conversation ends with it."""
    entry = part["entry"].to_numpy()
    steps, state = stack.forward(stack.backward(np.stack(part["goal"].tolist(), axis=1)), entry)
    edits, lines = [[] for _ in range(stack.n)], [[] for _ in range(stack.n)]
    roles, texts = part["roles"].tolist(), part["texts"].tolist()
    for t, letters, before in steps:
        for i in np.flatnonzero(letters != ""):
            edit = letters[i]
            edits[i].append(edit)
            if edit == "I":
                lines[i].append(f"{ROLES[before[i]]}:")
            elif edit != "D":
                lines[i].append(f"{roles[i][t] if edit == 'K' else ROLES[before[i]]}:{texts[i][t]}")
    for i in np.flatnonzero(last):
        while state[i] in (SYSTEM, USER):
            edits[i].append("I")
            lines[i].append(f"{ROLES[state[i]]}:")
            state[i] = NEXT[state[i]]
    return ["".join(e) for e in edits], lines


def pieces(segs: DataFrame) -> DataFrame:
    """What each segment adds to its conversation: edits, lines, and what the counts ask for."""
    kind = segs.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in stacks(batch):
                stack = Stack(*_lists(part))
                edits, lines = _edited(stack, part, part["last"].to_numpy())
                shown = ["".join((r[:1] or " ") for r in roles) for roles in part["roles"]]
                out = part[["conv", "at", "n", "low", "high", "turns", "first_turn", "last_turn"]].assign(edits=edits, text=["\n".join(x) for x in lines], n_lines=[len(x) for x in lines])
                for name, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED)):
                    out[name] = [sum(1 for f in faults if f == fault) for faults in part["faults"]]
                out["late"] = [sum(1 for f, e in zip(faults, (x for x in edit if x != "I"), strict=True) if f == TRUNCATED and e != "D") for faults, edit in zip(part["faults"], edits, strict=True)]
                out["illegal"] = [sum(1 for i in range(1, len(s)) if s[i - 1 : i + 1] not in ("su", "ua", "au")) for s in shown]
                yield out.assign(first_role=[s[:1] for s in shown], last_role=[s[-1:] for s in shown])
        release()

    return segs.mapInPandas(run, f"conv {kind}, at long, n int, low long, high long, turns long, first_turn long, last_turn long, edits string, text string, n_lines long, blank long, duplicate long, truncated long, late long, illegal long, first_role string, last_role string")


REPORT = "conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def reported(made: DataFrame) -> DataFrame:
    """One row per conversation, from a stream of its pieces in order."""
    kind = made.schema["conv"].dataType.simpleString()
    prices = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}

    class Open:
        def __init__(self, conv):
            self.conv, self.hash, self.edits, self.lines = conv, hashlib.sha256(), [], 0
            self.low = self.high = self.last_turn = None
            self.turns, self.role = 0, ""
            self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "late", "illegal"), 0)

        def add(self, p) -> None:
            if p["n_lines"]:
                self.hash.update(("\n" * (self.lines > 0) + p["text"]).encode())
                self.lines += p["n_lines"]
            self.edits.append(p["edits"])
            for name in self.sums:
                self.sums[name] += p[name]
            if p["low"] is not None:
                self.low = p["low"] if self.low is None else min(self.low, p["low"])
                self.high = p["high"] if self.high is None else max(self.high, p["high"])
                self.turns += p["turns"] - (p["first_turn"] == self.last_turn)
                self.last_turn = p["last_turn"]
            if p["first_role"]:
                self.sums["illegal"] += bool(self.role) and self.role + p["first_role"] not in ("su", "ua", "au")
                self.role = p["last_role"]

        def row(self) -> tuple:
            audit = "".join(self.edits)
            cost = sum(price * audit.count(e) for e, price in prices.items()) + self.sums["late"]
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            return self.conv, gaps, *(self.sums[c] for c in ("blank", "duplicate", "truncated", "illegal")), cost, audit, self.hash.hexdigest()

    names = [part.split(" ")[0] for part in REPORT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            conv_type, done = batch.schema.field("conv").type, []
            for p in batch.to_pylist():
                if now is None or now.conv != p["conv"]:
                    if now is not None:
                        done.append(now.row())
                    now = Open(p["conv"])
                now.add(p)
            if done:
                yield batch_of(done)
        if now is not None:
            yield batch_of([now.row()])
        release()

    return made.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(run, REPORT.format(conv=kind))


def segmented(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Segments with the state that they are entered in, the costs to go at their end, and whether they are the last."""
    segs = scratch.keep(segments(rows), "segments")
    several = segs.groupBy("conv").agg(F.count("*").alias("parts"), F.max("at").alias("end")).where("parts > 1")
    multi = segs.join(several, segs["conv"].eqNullSafe(several["conv"]), "left_semi")
    goals = scratch.keep(chained_back(crossings(multi)), "goals").withColumnRenamed("at", "goal_at")
    # segment numbers are unique, so they alone are the key
    entries = chained_forward(exits(multi.join(goals.drop("conv"), F.col("at") == F.col("goal_at")).drop("goal_at")))
    ends = chained_ends(goals)
    known = goals.select("goal_at", "goal").join(scratch.keep(entries, "entries").select(F.col("at").alias("goal_at"), "entry"), "goal_at").join(ends, "goal_at")
    out = segs.join(known, segs["at"] == known["goal_at"], "left").drop("goal_at")
    whole = F.array(*[F.lit(int(v)).cast("long") for v in END])
    return out.withColumns({"goal": F.coalesce("goal", whole), "entry": F.coalesce("entry", F.lit(START)), "last": F.coalesce("last", F.lit(True))})


def chained_ends(goals: DataFrame) -> DataFrame:
    """Whether a segment is its conversation's last."""
    end = goals.groupBy("conv").agg(F.max("goal_at").alias("end"))
    return goals.select("conv", "goal_at").join(end.select(F.col("conv").alias("end_conv"), "end"), F.col("conv").eqNullSafe(F.col("end_conv"))).select("goal_at", (F.col("goal_at") == F.col("end")).alias("last"))


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = False) -> DataFrame:
    """One row per conversation: ``conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256``. ``damage`` spoils the
    rows first, as :func:`damaged` does, to try the repair on."""
    return reported(repaired(conversations, conv, turn, role, text, damage))


def repaired(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = False) -> DataFrame:
    """The pieces of each conversation: by ``conv`` and ``at``, ``text`` has the repaired lines and ``edits`` what was done."""
    spark = conversations.sparkSession
    modest_batches(spark)
    scratch = Scratch(spark, "repair")
    if damage:
        rows = damaged(conversations, conv, turn, role, text)
    else:
        shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), shown(role).alias("role"), shown(text).alias("text"), F.lit(False).alias("gone"))
    return pieces(segmented(faulty(rows, scratch), scratch))
