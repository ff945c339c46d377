"""Text and diff expressions against plain-Python restatements on generated strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from patchloom.functions import diff, outcome, prompts, text

ALPHABET = ["a", "é", "𝄞", " ", "\n", "\t", "\r", "\x1c", "　", "\x85", "-", "+"]
MARKERS = ["diff --git a/x b/x", "---", "+++", "\n---", "\n+++ b", "--- a", "-", "+", "\n"]


def random_texts(n, seed, pieces):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(n)]


def apply(spark, values, *expressions):
    """Each expression's results in input order."""
    df = spark.createDataFrame(list(enumerate(values)), "i long, t string").repartition(4)
    found = df.select("i", *[e.alias(f"e{k}") for k, e in enumerate(expressions)]).orderBy("i")
    collected = found.collect()
    return [[r[f"e{k}"] for r in collected] for k in range(len(expressions))]


def test_strip_is_pythons(spark):
    values = random_texts(400, 1, ALPHABET)
    (got,) = apply(spark, values, text.strip(F.col("t")))
    assert got == [v.strip() for v in values]


def patch_of(response):
    if (at := response.find("diff --git")) >= 0:
        return response[at:].strip()
    if "---" in response and "+++" in response:
        line_starts = [0] + [m.end() for m in re.finditer("\n", response)]
        starts = [s for s in line_starts if response.startswith("---", s)]
        return response[starts[0] :] if starts else ""
    return response.strip()


def test_extract_patch(spark):
    values = random_texts(600, 2, ALPHABET + MARKERS)
    (got,) = apply(spark, values, text.extract_patch(F.col("t")))
    assert got == [patch_of(v) for v in values]


@pytest.mark.parametrize(
    "response, patch",
    [
        ("  hi diff --git a/x b/x\n+1\n \n", "diff --git a/x b/x\n+1"),
        ("text\n--- a\n+++ b\n+x\n", "--- a\n+++ b\n+x\n"),
        ("a --- b +++ c", ""),
        ("  plain  ", "plain"),
    ],
)
def test_extract_patch_fixtures(spark, response, patch):
    assert apply(spark, [response], text.extract_patch(F.col("t"))) == [[patch]]


def test_strip_prompt_echo(spark):
    df = spark.createDataFrame(
        [("ask", "ask answer \n"), ("ask", "answer"), ("ask", "ask"), ("ask me", "ask")],
        "prompt string, generated string",
    )
    got = df.select(text.strip_prompt_echo(F.col("generated"), F.col("prompt"))).collect()
    assert [r[0] for r in got] == ["answer", "answer", "", "ask"]
    cut = text.strip_prompt_echo(F.col("generated"), F.col("prompt"), by_length=True)
    assert [r[0] for r in df.select(cut).collect()] == ["answer", "wer", "", ""]


def test_preview_and_tail_count_characters(spark):
    values = ["é" * 300, "é" * 301, "", "𝄞" * 5001]
    cut, tail = apply(
        spark, values, text.preview(F.col("t"), 300), text.log_tail(F.col("t"), 5000)
    )
    assert cut == ["é" * 300, "é" * 300 + "...", "", "𝄞" * 300 + "..."]
    assert tail == ["é" * 300, "é" * 301, "", "𝄞" * 5000]


def is_change(line):
    return line[:1] in ("+", "-") and line[:3] not in ("+++", "---")


def without_every_third(patch):
    lines = patch.split("\n")
    changes = [i for i, line in enumerate(lines) if is_change(line)]
    gone = set(changes[2::3])
    if len(lines) <= 10 or not gone:
        return None
    return "\n".join(line for i, line in enumerate(lines) if i not in gone)


def first_half(patch):
    lines = patch.split("\n")
    return "\n".join(lines[: len(lines) // 2]) if len(lines) > 5 else None


def swapped(patch):
    turn = {"+": "-", "-": "+"}
    return "\n".join(
        turn[line[0]] + line[1:] if is_change(line) else line for line in patch.split("\n")
    )


def test_corrupted_patches(spark):
    pieces = ["\n", "\n", "\n+", "\n-", "\n ", "\n+++", "\n---", "x", "é", "\r", "\\", "+"]
    values = random_texts(800, 3, pieces) + ["", "\n" * 5, "\n" * 4, "+\n" * 10, "+\n" * 11]
    half, dropped, turned = apply(
        spark,
        values,
        diff.truncated(F.col("t")),
        diff.every_nth_dropped(F.col("t")),
        diff.signs_swapped(F.col("t")),
    )
    assert half == [first_half(v) for v in values]
    assert dropped == [without_every_third(v) for v in values]
    assert turned == [swapped(v) for v in values]
    assert any(dropped) and not all(dropped)


def test_few_changed_lines_drop_nothing(spark):
    values = ["--- a\n+++ b\n+one\n-two\n" + "c\n" * 7]
    assert apply(spark, values, diff.every_nth_dropped(F.col("t"))) == [[None]]


def test_long_patch_stays_linear(spark):
    values = ["\n".join(f"+line {i}" for i in range(60_000))]
    (got,) = apply(spark, values, diff.every_nth_dropped(F.col("t")))
    assert got == [without_every_third(values[0])]


def test_line_kinds_and_counts(spark):
    patch = "--- a\n+++ b\n@@ -1 +1 @@\n+x\n-y\n z\n"
    df = spark.createDataFrame([(patch,)], "p string")
    counts = df.select(diff.changed_counts(F.col("p")).alias("c")).select("c.*").first()
    assert counts.asDict() == {"n_lines": 7, "n_added": 1, "n_removed": 1, "n_header": 2}


@pytest.mark.parametrize(
    "log, counts",
    [
        ("=== 1 failed, 3 passed in 0.12s ===", (3, 1, 0)),
        ("3 passed", (3, 0, 0)),
        ("=== 2 passed, 1 warning, 2 errors in 1s ===", (2, 0, 2)),
        ("ERROR collecting x\n1 error in 0.1s", (0, 0, 1)),
        ("no tests ran", (0, 0, 0)),
        ("1 passed\n2 passed, 1 failed", (2, 1, 0)),
        ("99999999999999999999 passed", (0, 0, 0)),
        ("", (0, 0, 0)),
    ],
)
def test_log_counts(spark, log, counts):
    df = spark.createDataFrame([(log,)], "log string")
    got = df.select(outcome.log_counts(F.col("log")).alias("c")).select("c.*").first()
    assert tuple(got) == counts


def test_verdict_and_reward(spark):
    df = spark.createDataFrame(
        [(1, 0, 0), (0, 0, 0), (1, 1, 0), (1, 0, 1)], "p int, f int, e int"
    )
    got = df.select(outcome.verdict(F.col("p"), F.col("f"), F.col("e"))).collect()
    assert [r[0] for r in got] == [True, False, False, False]
    outcomes = spark.createDataFrame([(True, True), (False, True), (False, False)], "p boolean, a boolean")
    got = outcomes.select(outcome.reward(F.col("p"), F.col("a"))).collect()
    assert [r[0] for r in got] == [1, 0, -1]


def test_error_bucket(spark):
    messages = [None, "", "Patch timeout", "Read Timeout", "DOCKER daemon timeout", "docker", "boom"]
    (got,) = apply(spark, messages, outcome.error_bucket(F.col("t")))
    assert got == [
        None, None, "patch_apply_failed", "timeout", "timeout", "docker_error", "other",
    ]


def test_repo_from_id(spark):
    ids = ["django__django-11099", "scikit-learn__scikit-learn-123", "test-1", "plain"]
    (got,) = apply(spark, ids, outcome.repo_from_id(F.col("t")))
    assert got == ["django/django", "scikit", "test", "plain"]


def test_image_reference(spark):
    image = outcome.image_reference(F.col("t"), F.lit("abc"), "host/images")
    (got,) = apply(spark, ["django/django", "a/b", "solo"], image)
    assert got == [
        "host/images:django.django-django__django-abc",
        "host/images:a.b-a__b-abc",
        "host/images:solo.solo-solo__solo-abc",
    ]


def test_template_values_are_not_templates(spark):
    df = spark.createDataFrame([("{patch}", "{repo}")], "repo string, patch string")
    got = df.select(prompts.render("<{repo}|{patch}> {{}}")).first()[0]
    assert got == "<{patch}|{repo}> {}"


def test_unknown_wording():
    with pytest.raises(ValueError, match="unknown wording"):
        prompts.negative_request("rude")
