"""Conversation structure repair: the cheapest edits that make turns alternate.

A repaired conversation has the role initials ``(s?(ua)+)?``. Keep costs 0, rerole to user
or assistant 2, delete 3, insert an empty user or assistant turn 2; a truncated turn that
stays costs 1 more. Blank and duplicate turns must go. Of the cheapest edit lists the one
whose initials (D, I, K, R) are least in ASCII is taken.

Each turn is a symbol of role and fault. Equal symbols in a row are one run; a run's effect
on the four states (nothing yet, system, user, assistant) is the n-th power of its symbol's
min-plus matrix, put together from cached binary powers. Costs to the end of the
conversation follow from the last run to the first, and the choices are then read off
forwards, run by run.

No conversation has to fit one task. Turns are dealt by ranges of (conversation, turn), so
a long one is cut into several parts. Only their matrices and borders are chained, a few
numbers for each part: costs to the end backwards, then the state that each part starts in.
Copies of a turn are one row with a count, and texts stay out of all this; they are joined
to the edits at the end. Turns are told apart by SHA-256 of conversation, role and text.

Nulls: a null role or text is one space. Turns come first if null; equal turns are in the
order of that digest. A null conversation is one of its own. Repeated rows are duplicates.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import BLANKS, store

INF = 1 << 60
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted turn, or one that was given the role that is due.
NEXT = (USER, USER, ASSISTANT, USER)
#: States that a role initial is allowed in, and the state it leads to.
KEPT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Cost to the end when no turn is left: with the inserts that are still due.
END = (0, 2 * INSERT, INSERT, 0)
MOST_LONG = (1 << 63) - 1

Matrix = tuple[tuple[int, ...], ...]
#: A turn that must go, or (role initial, whether truncated).
Symbol = tuple[str, bool] | None


def _product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(INF, *(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def _applied(a: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(INF, *(a[i][k] + v[k] for k in range(4))) for i in range(4))


def _options(symbol: Symbol, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) for the turn itself, in the order of the initials."""
    found = [("D", DELETE, state)]
    if symbol is not None:
        initial, truncated = symbol
        stays = TRUNCATED * truncated
        if state in KEPT.get(initial, {}):
            found.append(("K", stays, KEPT[initial][state]))
        found.append(("R", REROLE + stays, NEXT[state]))
    return found


@lru_cache(maxsize=4096)
def power(symbol: Symbol, exponent: int) -> Matrix:
    """The matrix of ``2 ** exponent`` such turns in a row, inserts before each included."""
    if exponent:
        half = power(symbol, exponent - 1)
        return _product(half, half)
    lines = []
    for start in range(4):
        line = [INF] * 4
        state, spent = start, 0
        for _ in range(4):  # no more than three inserts lead anywhere new
            for _, cost, after in _options(symbol, state):
                line[after] = min(line[after], spent + cost)
            state, spent = NEXT[state], spent + INSERT
        lines.append(tuple(line))
    return tuple(lines)


def back(symbol: Symbol, count: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before ``count`` such turns, from those after them."""
    for exponent in range(count.bit_length()):
        if count >> exponent & 1:
            costs = _applied(power(symbol, exponent), costs)
    return costs


def total(runs: list[tuple[Symbol, int]]) -> Matrix:
    columns = []
    for k in range(4):
        costs = tuple(0 if i == k else INF for i in range(4))
        for symbol, count in reversed(runs):
            costs = back(symbol, count, costs)
        columns.append(costs)
    return tuple(zip(*columns))


def unroll(runs: list[tuple[Symbol, int]], state: int, after: tuple[int, ...], last: bool) -> tuple[str, int]:
    """The edits' initials of a part that is entered in ``state``, and the state it is left in."""
    borders = [after]
    for symbol, count in reversed(runs):
        borders.append(back(symbol, count, borders[-1]))
    borders.reverse()
    edits = []
    for k, (symbol, count) in enumerate(runs):
        if symbol is None:
            # Deleting first is least, and as cheap as deleting after inserts.
            edits.append("D" * count)
            continue
        inside = [borders[k + 1]]
        for _ in range(count - 1):
            inside.append(_applied(power(symbol, 0), inside[-1]))
        rest = borders[k][state]
        while inside:
            options = _options(symbol, state)
            options.insert(1, ("I", INSERT, NEXT[state]))
            for edit, cost, then in options:
                left = _applied(power(symbol, 0), inside[-1])[then] if edit == "I" else inside[-1][then]
                if cost + left == rest:
                    break
            edits.append(edit)
            state, rest = then, left
            if edit != "I":
                inside.pop()
    while last and state not in (NONE, ASSISTANT):
        edits.append("I")
        state = NEXT[state]
    return "".join(edits), state


def conversation(conv_id: Column) -> Column:
    """The name of a conversation in this module's tables; it is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _rows(turns: DataFrame) -> DataFrame:
    """Turns, and what of them decides on edits."""
    one = F.lit(" ")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumns({"role": F.coalesce("role", one), "text": F.coalesce("text", one)})
    conv = conversation(F.col("conv_id"))
    whole = F.concat_ws(":", F.length(conv), conv, F.length("role"), "role", "text")
    bare = F.rtrim("text", F.lit(BLANKS))
    return rows.withColumns(
        {
            "conv": conv,
            "mark": F.unhex(F.sha2(whole, 256)),
            "initial": F.left("role", F.lit(1)),
            "blank": bare == "",
            "truncated": ~F.right(bare, F.lit(1)).isin(".", "!", "?"),
        }
    )


def _ordered(turns: DataFrame) -> DataFrame:
    """One row per (conversation, turn, role, text) with its number of copies and whether it is
    the first of its role and text, in order; ``part`` numbers the ranges."""
    light = store(_rows(turns).drop("conv_id", "role", "text"))
    first = light.where(~F.col("blank")).groupBy("mark").agg(F.min(F.struct("turn")).alias("first"))
    both = light.withColumns({"copies": F.lit(1), "first": F.lit(False)}).unionByName(
        first.select("mark", F.col("first.turn").alias("turn"), F.lit(0).alias("copies"), F.lit(True).alias("first")),
        allowMissingColumns=True,
    )
    carried = [F.max(c).alias(c) for c in ("conv", "initial", "blank", "truncated", "first")]
    rows = both.groupBy("mark", "turn").agg(*carried, F.sum("copies").alias("copies"))
    number = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(number, "conv", "turn", "mark")
    return store(ranged.withColumn("part", F.spark_partition_id()))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each part of a conversation; the input is sorted by both."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, group in groupby(rows, lambda row: (row["conv"], row["part"])):
        yield list(group)


def _symbols(rows: list[dict]) -> Iterator[tuple[Symbol, int, dict]]:
    for row in rows:
        gone = row["copies"]
        if row["first"]:
            yield (row["initial"], row["truncated"]), 1, row
            gone -= 1
        if gone:
            yield None, gone, row


def _runs(rows: list[dict]) -> list[tuple[Symbol, int]]:
    runs: list[tuple[Symbol, int]] = []
    for symbol, count, _ in _symbols(rows):
        if runs and runs[-1][0] == symbol:
            runs[-1] = (symbol, runs[-1][1] + count)
        else:
            runs.append((symbol, count))
    return runs


LEGAL = {"su", "ua", "au"}
_PART = (
    "conv string, part int, matrix array<long>, blank long, duplicate long, truncated long, illegal long, "
    "head string, tail string, turns long, first_turn long, last_turn long"
)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part: its matrix, its counts, and what its borders look like."""
    out = []
    for rows in _groups(batches):
        illegal, before, numbers = 0, None, []
        for row in rows:
            own = row["initial"]
            illegal += (before is not None and before + own not in LEGAL) + row["copies"] - 1
            before = own
            if row["turn"] is not None and (not numbers or numbers[-1] != row["turn"]):
                numbers.append(row["turn"])
        out.append(
            {
                "conv": rows[0]["conv"],
                "part": rows[0]["part"],
                "matrix": [x for line in total(_runs(rows)) for x in line],
                "blank": sum(r["copies"] for r in rows if r["blank"]),
                "duplicate": sum(r["copies"] - r["first"] for r in rows if not r["blank"]),
                "truncated": sum(1 for r in rows if r["first"] and r["truncated"]),
                "illegal": illegal,
                "head": rows[0]["initial"],
                "tail": before,
                "turns": len(numbers),
                "first_turn": numbers[0] if numbers else None,
                "last_turn": numbers[-1] if numbers else None,
            }
        )
        if len(out) == 1000:
            yield _batch(out, _PART)
            out = []
    if out:
        yield _batch(out, _PART)


_TYPES = {
    "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()), "boolean": pa.bool_(), "binary": pa.binary(),
}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.record_batch({n: pa.array([r[n] for r in rows], _TYPES[t]) for n, t in fields})


_CONV = (
    "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "part int, after array<long>, last boolean, several boolean"
)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part: the costs to the conversation's end after it; and what the parts add up to."""
    for batch in batches:
        out = []
        for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            afters, costs = [], END
            for part in reversed(parts):
                afters.append(costs)
                costs = _applied(tuple(tuple(part["matrix"][i : i + 4]) for i in (0, 4, 8, 12)), costs)
            illegal = sum(p["illegal"] for p in parts)
            illegal += sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(parts, parts[1:]))
            known = [p for p in parts if p["turns"]]
            gaps = 0
            if known:
                distinct = sum(p["turns"] for p in known)
                distinct -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:]))
                gaps = min(known[-1]["last_turn"] - known[0]["first_turn"] + 1 - distinct, MOST_LONG)
            whole = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated")}
            whole |= {"conv": conv, "gaps": gaps, "illegal": illegal, "cost": costs[NONE], "several": len(parts) > 1}
            for k, (part, after) in enumerate(zip(parts, reversed(afters))):
                out.append(whole | {"part": part["part"], "after": list(after), "last": k + 1 == len(parts)})
        yield _batch(out, _CONV)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part: the state it is left in, for each state that it may be entered in."""
    schema = "conv string, part int, exits array<int>"
    for rows in _groups(batches):
        runs, own = _runs(rows), rows[0]
        exits = [unroll(runs, s, tuple(own["after"]), own["last"])[1] for s in range(4)]
        yield _batch([{"conv": own["conv"], "part": own["part"], "exits": exits}], schema)


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            state = NONE
            for part in parts:
                out.append({"conv": conv, "part": part["part"], "state": state})
                state = part["exits"][state]
        yield _batch(out, "conv string, part int, state int")


_EDIT = "conv string, part int, place long, edit string, mark binary, turn long, state int, audit string"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part in order: each turn that stays or is inserted, and one with the audit."""
    out = []
    for rows in _groups(batches):
        own = rows[0]
        state = own["state"] or NONE
        audit, _ = unroll(_runs(rows), state, tuple(own["after"]), own["last"])
        base = {"conv": own["conv"], "part": own["part"], "mark": None, "turn": None, "audit": None}
        out.append(base | {"place": -1, "edit": None, "state": None, "audit": audit})
        turns = ((symbol, row) for symbol, count, row in _symbols(rows) for _ in range(count))
        for place, edit in enumerate(audit):
            if edit == "I":
                state = NEXT[state]
                out.append(base | {"place": place, "edit": edit, "state": state})
                continue
            symbol, row = next(turns)
            if edit != "D":
                state = NEXT[state] if edit == "R" else KEPT[symbol[0]][state]
                out.append(base | {"place": place, "edit": edit, "mark": row["mark"], "turn": row["turn"], "state": state})
        if len(out) >= 1000:
            yield _batch(out, _EDIT)
            out = []
    if out:
        yield _batch(out, _EDIT)


@dataclass
class Repair:
    """``conversations``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit (one row
    each). ``turns``: the repaired turns (conv, part, place, edit, role, text), to be ordered
    by part and place."""

    conversations: DataFrame
    turns: DataFrame


def _in_parts(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` on whole parts of conversations, each with its rows in order."""
    dealt = rows.repartition("conv", "part").sortWithinPartitions("conv", "part", "turn", "mark")
    return dealt.mapInArrow(run, schema)


def _lists(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One list of parts per conversation: as many entries as there are ranges at most."""
    parts = F.sort_array(F.collect_list(F.struct("part", *[c for c in columns if c != "part"])))
    return rows.groupBy("conv").agg(parts.alias("parts"))


def repair(turns: DataFrame) -> Repair:
    """Repair ``turns`` (conv_id, turn, role, text)."""
    ordered = _ordered(turns)
    described = _in_parts(ordered, _described, _PART)
    fields = [f.split(" ")[0] for f in _PART.split(", ")[1:]]
    chained = store(_lists(described, fields).mapInArrow(_chained, _CONV))
    ends = chained.select("conv", "part", "after", "last", "several")
    with_ends = ordered.join(ends, ["conv", "part"])
    exits = _in_parts(with_ends.where("several"), _exits, "conv string, part int, exits array<int>")
    states = _lists(exits, ["exits"]).mapInArrow(_entered, "conv string, part int, state int")
    edits = store(_in_parts(with_ends.join(states, ["conv", "part"], "left"), _edits, _EDIT))

    audits = edits.where("place = -1").groupBy("conv").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit")
    )
    conversations = chained.where("last").drop("part", "after", "last", "several").join(audits, "conv")

    stays = edits.where("place >= 0").drop("audit")
    role_due = F.element_at(F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.col("state"))
    # Copies are one row before the shuffle; an edit meets one row, null turns included.
    given = _rows(turns).groupBy("mark", "turn").agg(F.max("role").alias("role"), F.max("text").alias("text"))
    kept = stays.where("mark is not null").alias("e").join(
        given.alias("g"), (F.col("e.mark") == F.col("g.mark")) & F.col("e.turn").eqNullSafe(F.col("g.turn"))
    )
    kept = kept.select(
        "conv", "part", "place", "edit",
        F.when(F.col("edit") == "K", F.col("role")).otherwise(role_due).alias("role"), "text",
    )
    new = stays.where("mark is null").select("conv", "part", "place", "edit", role_due.alias("role"), F.lit("").alias("text"))
    return Repair(conversations, kept.unionByName(new))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, digest, lines = None, hashlib.sha256(), 0
    out: dict[str, list] = {"conv": [], "repaired_sha256": []}

    def end() -> None:
        if lines:
            out["conv"].append(conv)
            out["repaired_sha256"].append(digest.hexdigest())

    for batch in batches:
        for own, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if own != conv or not lines:
                end()
                conv, digest, lines = own, hashlib.sha256(), 0
            digest.update(("\n" * bool(lines) + f"{role}:{text}").encode())
            lines += 1
        if out["conv"]:
            yield pa.record_batch({k: pa.array(v, pa.string()) for k, v in out.items()})
            out = {k: [] for k in out}
    end()
    if out["conv"]:
        yield pa.record_batch({k: pa.array(v, pa.string()) for k, v in out.items()})


def digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of repaired turns, joined as ``role:text`` lines.

    A digest takes its lines one after the other, so a conversation's turns pass through one
    task; they are read as a stream, sorted on disk if need be, and never gathered."""
    dealt = turns.repartition("conv").sortWithinPartitions("conv", "part", "place").select("conv", "role", "text")
    return dealt.mapInArrow(_digested, "conv string, repaired_sha256 string")
