"""Linking of tool calls with their results, in order of their dependencies.

Calls and results are hash-joined by conversation and identifier. A call depends on the
calls whose identifiers its arguments name under ``after``; its level is the longest way
to a call without dependencies, found by one join per level. Calls on a cycle have none.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.common import positions, store

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks and no escapes but the needed ones."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def problems(arguments: object, schema: dict | None) -> list[str]:
    """What a tool's schema (properties, required, additionalProperties) finds wrong."""
    if schema is None:
        return ["unknown tool"]
    if not isinstance(arguments, dict):
        return ["arguments are not an object"]
    known = schema.get("properties", {})
    out = [f"missing {k}" for k in sorted(schema.get("required", [])) if k not in arguments]
    for name, value in sorted(arguments.items()):
        if name not in known:
            if not schema.get("additionalProperties", True):
                out.append(f"unexpected {name}")
            continue
        kind = known[name].get("type")
        wrong_bool = isinstance(value, bool) and kind in ("integer", "number")
        if kind and (wrong_bool or not isinstance(value, _TYPES[kind])):
            out.append(f"{name} is not {kind}")
    return out


def _refused(name: str) -> object:
    raise ValueError(f"{name} is not JSON")


def _finite(digits: str) -> float:
    number = float(digits)
    return number if math.isfinite(number) else _refused(digits)


def parsed(text: str | None) -> tuple[object, str | None]:
    """The value of JSON arguments, or the text itself and what is wrong with it."""
    try:
        value = json.loads(text or "", parse_constant=_refused, parse_float=_finite)
        canonical(value).encode()
    except RecursionError:
        return text, "arguments are nested too deeply"
    except UnicodeEncodeError:
        return text, "arguments are not Unicode text"
    except ValueError:
        return text, "arguments are not JSON"
    return value, None


def _messages(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            messages, found = [], []
            columns = (batch.column(c).to_pylist() for c in ("call_id", "name", "arguments", "result", "state"))
            for call_id, name, arguments, result, state in zip(*columns):
                wrong = []
                if state not in ("unasked", "repeated_result"):
                    arguments, fault = parsed(arguments)
                    wrong = [fault] if fault else problems(arguments, schemas.get(name))
                parts = {"arguments": arguments, "call_id": call_id, "name": name, "result": result}
                messages.append(canonical({k: v for k, v in parts.items() if v is not None}))
                found.append(", ".join(wrong))
            kept = batch.drop_columns(["arguments", "result"])
            kept = kept.append_column("message", pa.array(messages, pa.string()))
            yield kept.append_column("problems", pa.array(found, pa.string()))

    return run


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): Kahn's algorithm, a join per level; cycles are left out."""
    ids = calls.select("conv_id", "call_id").distinct()
    named = F.from_json("arguments", "after array<string>")["after"]
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct(named)).alias("needs"))
    # Only calls of the same conversation count, and none needs itself.
    there = ids.withColumnRenamed("call_id", "needs")
    edges = store(edges.where("needs <> call_id").join(there, ["conv_id", "needs"]).distinct())
    open_ = edges.select("conv_id", "call_id").distinct()
    done = store(ids.join(open_, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)))
    level, left = 0, edges
    while not left.isEmpty():
        ready = done.where(F.col("level") == level).select("conv_id", F.col("call_id").alias("needs"))
        rest = store(left.join(ready, ["conv_id", "needs"], "left_anti"))
        freed = left.select("conv_id", "call_id").distinct()
        freed = freed.join(rest.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
        level += 1
        freed = store(freed.withColumn("level", F.lit(level)))
        if freed.isEmpty():
            break
        done, left = done.unionByName(freed), rest
    return done


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], with_repeated: bool = False) -> DataFrame:
    """A row for each call, and for each result that no call asked for.

    ``calls``: conv_id, call_id, seq, name, arguments (JSON); ``results``: conv_id,
    call_id, seq, content. Of a call or result that occurs several times the first by
    seq is taken; ``with_repeated`` gives each later one a row of its own too, which is
    linked with nothing. ``state``: answered, open (no result), unasked (no call),
    repeated_call or repeated_result. ``level`` is null on a cycle, for results without a
    call and for repeated ones. ``position`` numbers a
    conversation's rows by level, then seq. ``problems`` is what validation found, and
    ``message`` the canonical JSON. Arguments that are no JSON, nested too deeply to parse, hold
    a number that is not finite or half a surrogate pair are a problem of their row, which
    keeps their text. Rows with a null conversation or identifier are
    linked with nothing.
    """

    key = ["conv_id", "call_id", "turn_"]

    def ranked(df: DataFrame, *values: str) -> DataFrame:
        """With ``turn_``: 1 for what is taken, and 2 and so on for what repeats it."""
        lone = df.where("conv_id is null or call_id is null").select("conv_id", "call_id", F.lit(1).alias("turn_"), "seq", *values)
        full = df.where("conv_id is not null and call_id is not null")
        if with_repeated:
            turn = F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("seq", *values))
            full = full.select("conv_id", "call_id", turn.alias("turn_"), "seq", *values)
        else:
            full = full.groupBy("conv_id", "call_id").agg(F.min(F.struct("seq", *values)).alias("_v"))
            full = full.select("conv_id", "call_id", F.lit(1).alias("turn_"), "_v.*")
        return full.unionByName(lone)

    asked = store(ranked(calls, "name", "arguments"))
    # Repeated results have negative numbers, so that they meet no repeated call.
    turn = F.when(F.col("turn_") > 1, -F.col("turn_")).otherwise(F.col("turn_")).alias("turn_")
    given = ranked(results, "content").select(
        "conv_id", "call_id", turn, F.col("seq").alias("_seq"), F.col("content").alias("result"), F.lit(True).alias("_given")
    )
    both = asked.withColumn("_asked", F.lit(True)).join(given, key, "full")
    state = F.when(F.col("turn_") > 1, "repeated_call").when(F.col("turn_") < 0, "repeated_result")
    state = state.when(F.col("_asked").isNull(), "unasked").when(F.col("_given").isNull(), "open").otherwise("answered")
    both = both.withColumns({"state": state, "seq": F.coalesce("seq", "_seq")}).drop("_asked", "_given", "_seq")
    levels = _levels(asked.where("conv_id is not null and call_id is not null and turn_ = 1"))
    both = both.join(levels.withColumn("turn_", F.lit(1)), key, "left")
    schema = "conv_id string, call_id string, seq long, name string, state string, level int, message string, problems string"
    order = ["conv_id", "call_id", "seq", "name", "arguments", "result", "state", "level"]
    both = both.select(*order).withColumn("conv_id", F.col("conv_id").cast("string"))
    made = store(both.mapInArrow(_messages(schemas), schema))
    # Levels of a conversation and stretches of 1024 numbers are ranked by themselves.
    far = F.lit(1 << 20)
    stretch = F.least(F.greatest(F.coalesce(F.col("seq"), F.lit(0)), F.lit(0)) / 1024, far - 1).cast("long")
    bucket = F.coalesce(F.col("level"), far).cast("long") * far + stretch
    tie = ["level_", "seq", "call_id", "message"]
    made = made.withColumn("level_", F.coalesce("level", far))
    placed = positions(made, ["conv_id"], bucket, tie, "position").drop("position_total", "level_")
    return placed
