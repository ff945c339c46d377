"""Arguments that parsers choke on, empty tables and clashing names; the query against a restatement."""

import json
import random
from collections import defaultdict

import pytest

from patchloom.llm import chat, queries

CALLS = "conv_id string, call_id string, seq long, name string, arguments string, state string, level int, message string"
RESULTS = "conv_id string, call_id string, seq long, content string, position int, turn_ int"
TOOLS = {"ask": {"properties": {"n": {"type": "number"}}}}

BAD = {
    "[" * 200_000: "arguments are nested too deeply",
    '{"n":"\\ud800"}': "arguments are not Unicode text",
    '{"n":NaN}': "arguments are not JSON",
    '{"n":1e400}': "arguments are not JSON",
    '{"n":-Infinity}': "arguments are not JSON",
    "1" * 5_000: "arguments are not JSON",
    "": "arguments are not JSON",
    "[1]": "arguments are not an object",
    '{"n":"x"}': "n is not number",
    '{"n":1e308}': "",
}


def test_one_bad_row_costs_only_itself(spark):
    calls = [("c", str(k), k, "ask", text, "s", 1, "m") for k, text in enumerate(BAD)] + [("c", "none", 99, "ask", None, "s", 1, "m")]
    results = [("c", "0", 0, "r", 1, 2)]
    rows = chat.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), TOOLS).collect()
    found = {r.call_id: r for r in rows}
    assert {found[str(k)].problems for k in range(len(BAD))} == set(BAD.values())
    assert [found[str(k)].problems for k in range(len(BAD))] == list(BAD.values())
    assert found["none"].problems == "arguments are not JSON"
    for k, text in enumerate(BAD):
        message = json.loads(found[str(k)].message)
        if found[str(k)].problems.startswith("arguments are not JSON") and text:
            assert message["arguments"] == text
    assert json.loads(found["0"].message)["result"] == "r"


@pytest.mark.parametrize("with_repeated", [False, True])
def test_empty_tables(spark, with_repeated):
    calls, results = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    assert chat.link_calls(calls, results, TOOLS, with_repeated).count() == 0
    one = spark.createDataFrame([("c", "1", 0, "r", 1, 2)], RESULTS)
    assert [r.state for r in chat.link_calls(calls, one, TOOLS, with_repeated).collect()] == ["unasked"]


def restated(turns):
    """conv_id, call_id, seq → (state, level, problems, message) by a plain reading of the query."""
    calls, results = defaultdict(list), defaultdict(list)
    for conv, turn, role, text in turns:
        if role in ("user", "system"):
            after = [f"{conv}-0"] if role == "user" and turn > 0 else None
            fields = {k: v for k, v in (("text", text), ("turn", turn), ("after", after)) if v is not None}
            calls[str(conv), f"{conv}-{turn}"].append((turn, "ask" if role == "user" else "set_up", fields))
        if role == "assistant":
            results[str(conv), f"{conv}-{turn - 1}"].append((turn, text))
    out = {}
    for key in calls.keys() | results.keys():
        conv, call_id = key
        answer = results.get(key)
        if key not in calls:
            out[(*key, answer[0][0])] = ("unasked", None, "", {"call_id": call_id, "result": answer[0][1]})
            continue
        (turn, name, fields), = calls[key]
        level = 1 if "after" in fields and (conv, fields["after"][0]) in calls else 0
        missing = [f"missing {k}" for k in ("text", "turn") if k not in fields]
        message = {"arguments": fields, "call_id": call_id, "name": name}
        if answer and answer[0][1] is not None:
            message["result"] = answer[0][1]
        out[(*key, turn)] = ("answered" if answer else "open", level, ", ".join(missing), message)
    return out


def test_the_query_in_full(spark, tmp_path):
    rng = random.Random(4)
    turns = []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "user", "tool"])
            turns.append((conv, turn, role, rng.choice(['a "quoted"\n', "é", "", "long " * 50])))
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = queries.op5_chat_formatting(spark, str(tmp_path)).collect()
    got = {(r.conv_id, r.call_id, r.seq): (r.state, r.level, r.problems, json.loads(r.message)) for r in rows}
    assert got == restated(turns)
    assert all(r.message == chat.canonical(json.loads(r.message)) for r in rows)
    by_conv = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.position):
        by_conv[r.conv_id].append((r.position, 9 if r.level is None else r.level, r.seq))
    for places in by_conv.values():
        assert [p for p, _, _ in places] == list(range(len(places)))
        assert [x[1:] for x in places] == sorted(x[1:] for x in places)
