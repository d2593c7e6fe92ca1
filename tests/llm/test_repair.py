"""Repair against a search for the cheapest edits, one conversation at a time."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from inkstone.llm import repair
from tests.llm import common

WHITE = " \t\n\x0b\x0c\r"


def spoiled(rows):
    shown = lambda v: " " if v is None else v
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = "user" if h == 4 else shown(role), "" if h == 1 else re.sub("[.!?]", "", shown(text)) if h == 2 else shown(text)
        yield from [(conv, turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)


def order(row):
    conv, turn, role, text = row
    same = f"{'null' if conv is None else conv}\n{len(role)}\n{role}\n{text}"
    return turn is not None, turn or 0, role, hashlib.sha256(same.encode()).hexdigest()


def searched(rows):
    """Dijkstra over (cost, edits so far): the first end that is reached is the cheapest and the least."""
    rows = sorted(rows, key=order)
    faults, seen = [], set()
    for *_, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    starts = [r[2][:1] for r in rows]
    counts = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:])))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, edits, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return *counts, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()
        due = "assistant" if state == "u" else "user"
        heapq.heappush(heap, (cost + 2, edits + "I", i, due[0], (*lines, f"{due}:")))
        if i == len(rows):
            continue
        role, text = rows[i][2:]
        heapq.heappush(heap, (cost + 3, edits + "D", i + 1, state, lines))
        if faults[i] not in ("blank", "duplicate"):
            late = faults[i] == "truncated"
            heapq.heappush(heap, (cost + 2 + late, edits + "R", i + 1, due[0], (*lines, f"{due}:{text}")))
            if role[:1] == due[0] or (role[:1] == "s" and not state):
                heapq.heappush(heap, (cost + late, edits + "K", i + 1, role[0], (*lines, f"{role}:{text}")))


def brute(rows, damage=True):
    rows = list(rows)
    convs = {r[0]: [] for r in rows}
    for r in spoiled(rows) if damage else rows:
        convs[r[0]].append(r)
    return sorted([(c, *searched(r)) for c, r in convs.items()], key=str)


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_against_search(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = common.run(spark, "op13_repair", sf_dir)
    assert got.columns.tolist() == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(got.itertuples(index=False, name=None), key=str) == brute(map(tuple, rows))


SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost string, fault string, at string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *"abcd") for r in rows], SCHEMA)


@pytest.mark.parametrize("segment", [4096, 3, 1])
def test_any_rows(spark, monkeypatch, segment):
    """Nulls, unknown roles, ties, repeats; segments so short that all conversations have several."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    monkeypatch.setattr(repair, "CELLS", 64)
    draw = random.Random(segment)
    roles, texts = [None, "", "user", "user", "assistant", "assistant", "system", "tool", "u", "sys"], [None, "", " ", "a.", "b!", "c", "x y?  ", "...", "é.\n", "?"]
    rows = [(draw.choice([None, 1, 2, 3, *range(10, 30)]), draw.choice([None, *range(25)]), draw.choice(roles), draw.choice(texts)) for _ in range(250)]
    assert listed(repair.repair(table(spark, rows), damage=True)) == brute(rows)


def test_one_long_conversation(spark, monkeypatch):
    """It spreads over segments and tasks, and gives what one sweep would."""
    monkeypatch.setattr(repair, "SEGMENT", 50)
    draw = random.Random(1)
    rows = [(5, i, draw.choice(["user", "assistant", "system"]), f"{'x' * (2000 if i == 9 else i % 13)}{draw.choice(['.', ''])}") for i in range(700)]
    rows += [(6, 0, "user", "a.")]
    assert listed(repair.repair(table(spark, rows), damage=True)) == brute(rows)


def test_without_damage(spark):
    good = [(1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 2, "assistant", "a.")]
    lost = [(2, 0, "user", "q?"), (2, 2, "user", "q2?"), (2, 3, "assistant", "a.")]
    got = {r.conv_id: r for r in repair.repair(table(spark, good + lost)).collect()}
    assert (got[1].cost, got[1].audit) == (0, "KKK")
    assert (got[2].cost, got[2].audit, got[2].gaps, got[2].illegal) == (2, "KIKK", 1, 1)
    assert got[2].repaired_sha256 == hashlib.sha256(b"user:q?\nassistant:\nuser:q2?\nassistant:a.").hexdigest()
    assert repair.repair(table(spark, [])).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert listed(repair.repair(table(spark, [(gone, 0, "user", "a.")]), damage=True)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
