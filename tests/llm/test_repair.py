"""Conversation repair against a search over single edits, on awkward conversations."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from patchloom.llm import conversation_repair, oracle, queries

SCHEMA = "conv_id long, turn long, role string, text string, conv string, part int, mark string, first int"


def table(spark, turns):
    return spark.createDataFrame([(*t, "x", 1, "m", 2) for t in turns], SCHEMA)


def cheapest(turns):
    """(cost, audit, repaired turns): best-first search over (turn, last initial) by cost, then audit."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while True:
        cost, audit, at, last, out = heapq.heappop(heap)
        if at == len(turns) and last in ("", "a"):
            return cost, audit, list(out)
        if (at, last) in done:
            continue
        done.add((at, last))
        due = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", at, due[0], (*out, (due, ""))))
        if at == len(turns):
            continue
        fault, role, text = turns[at]
        heapq.heappush(heap, (cost + 3, audit + "D", at + 1, last, out))
        if fault in ("blank", "duplicate"):
            continue
        extra = fault == "truncated"
        initial = role[:1]
        if initial and last + initial in ("s", "u", "su", "ua", "au"):
            heapq.heappush(heap, (cost + extra, audit + "K", at + 1, initial, (*out, (role, text))))
        heapq.heappush(heap, (cost + 2 + extra, audit + "R", at + 1, due[0], (*out, (due, text))))


def place(conv, turn, role, text):
    name = "" if conv is None else f"={conv}"
    mark = ":".join([str(len(name)), name, str(len(role)), role, text])
    return turn is not None, turn or 0, hashlib.sha256(mark.encode()).digest()


def brute(turns):
    """conv_id → the contract's columns, from turns that are damaged already."""
    by_conv = defaultdict(list)
    for conv, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        by_conv[conv].append((place(conv, turn, role, text), turn, role, text))
    out = {}
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: r[0])
        seen, faults = set(), []
        for _, _, role, text in rows:
            bare = text.rstrip(" \t\n\v\f\r")
            if not bare:
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            else:
                faults.append("" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        numbers = {r[1] for r in rows if r[1] is not None}
        initials = [r[2][:1] for r in rows]
        cost, audit, repaired = cheapest([(f, r[2], r[3]) for f, r in zip(faults, rows)])
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
        )
    return out


def found(spark, turns):
    repair = conversation_repair.repair(table(spark, turns))
    rows = repair.conversations.join(conversation_repair.digests(repair.turns), "conv", "left").collect()
    empty = hashlib.sha256(b"").hexdigest()
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {r["conv"]: (*(r[c] for c in columns), r["repaired_sha256"] or empty) for r in rows}


def turns_of(seed, convs, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher", "Assistant"]
    texts = ["Yes.", "No", "", " \n\t", "Why? ", "É!", "a: b.", None, "long " * 300, " ", "tail.\n"]
    out = []
    for conv in [None, *range(convs)]:
        for k in range(rng.randint(1, most)):
            turn = rng.choice([k, k, k, 2 * k, 0, None, -3, 10**17])
            text = rng.choice(texts) if rng.random() < 0.6 else f"said {rng.randrange(30)}."
            row = (conv, turn, rng.choice(roles[: rng.choice((2, 5, 10))]), text)
            out += [row] * rng.choice((1, 1, 1, 2, 3))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "convs", "most"), [(1, 60, 12), (2, 2, 150)])
def test_repair(spark, seed, convs, most):
    turns = turns_of(seed, convs, most)
    want = {"" if k is None else f"={k}": v for k, v in brute(turns).items()}
    assert found(spark, turns) == want


def test_a_long_conversation_is_cut_and_chained(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "user", "assistant", "system"]
    turns = [(5, k, roles[k % 2] if rng.random() < 0.7 else rng.choice(roles), f"{k}{rng.choice('.!x')}") for k in range(700)]
    turns += [(5, k, "user", "again.") for k in range(300)] + [(6, 0, "user", "Hi.")]
    parts = conversation_repair._ordered(table(spark, turns)).where("conv = '=5'").select("part").distinct().count()
    assert parts > 1
    assert found(spark, turns) == {f"={k}": v for k, v in brute(turns).items()}


def test_repaired_turns_follow_the_pattern(spark):
    repair = conversation_repair.repair(table(spark, turns_of(4, 30, 9)))
    by_conv = defaultdict(list)
    for r in repair.turns.orderBy("conv", "part", "place").collect():
        by_conv[r["conv"]].append(r["role"][0])
    assert by_conv
    assert all(re.fullmatch("(s?(ua)+)?", "".join(roles)) for roles in by_conv.values())


def test_runs_by_powers_equal_single_steps():
    rng = random.Random(8)
    for _ in range(200):
        symbol = rng.choice([None, *[(i, t) for i in "suax" for t in (False, True)]])
        count = rng.randint(1, 40)
        costs = tuple(rng.randint(0, 9) for _ in range(4))
        one = costs
        for _ in range(count):
            one = conversation_repair.back(symbol, 1, one)
        assert conversation_repair.back(symbol, count, costs) == one


def test_empty_table(spark):
    repair = conversation_repair.repair(table(spark, []))
    assert repair.conversations.count() == repair.turns.count() == 0


def damage(turns):
    out = []
    for conv, turn, role, text in turns:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_query(spark, tmp_path):
    turns = turns_of(6, 150, 6)
    table(spark, turns).write.parquet(f"{tmp_path}/conversations.parquet")
    zero = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {t[0]: zero for t in turns} | brute(damage(turns))
    got = [tuple(r) for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()]
    assert {r[0]: r[1:] for r in got} == want
    assert len(got) == len(want)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(duck.sql(oracle.OP12).fetchall(), key=repr) == sorted(got, key=repr)


def test_query_on_the_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    turns = [tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_conversation_repair(spark, "/root/testdata/sf0.001").collect()
    want = brute(damage(turns))
    assert all(tuple(r)[1:] == want[r[0]] for r in got if r[0] in want)
    assert {r[0] for r in got} == {t[0] for t in turns}
