import pytest
from conftest import rows
from pyspark.sql import functions as F

from patchloom import schemas
from patchloom.functions import prompts
from patchloom.operators import instances as inst

COLUMNS = "instance_id string, repo string, base_commit string, problem_statement string, patch string"

SAMPLE = (
    "acme__rocket-77",
    "acme/rocket",
    "9f1c2e",
    "Countdown skips 7 when the clock is in UTC+14",
    "diff --git a/launch/clock.py b/launch/clock.py\n--- a/launch/clock.py\n+++ b/launch/clock.py\n@@ -4 +4 @@\n-    n -= 2\n+    n -= 1",
    "--- a/launch/test_clock.py\n+++ b/launch/test_clock.py\n@@ -9 +9 @@\n-assert tick(8) == 6\n+assert tick(8) == 7",
    "tick() is also called by abort()",
    None,
    None,
)


@pytest.fixture
def sample(spark):
    return spark.createDataFrame([SAMPLE], schemas.INSTANCE)


def test_missing_optional_columns_get_defaults(spark):
    given = ("o__r-5", "o/r", "c0ffee", "It\ncrashes", "+fixed")
    raw = spark.createDataFrame([given], COLUMNS)
    got = inst.normalize(raw)
    assert got.columns == schemas.INSTANCE.names
    assert tuple(got.first()) == (*given, "", None, None, None)


def test_missing_required_columns_are_all_named(spark):
    with pytest.raises(ValueError, match="base_commit, problem_statement, patch"):
        inst.normalize(spark.createDataFrame([("a", "b")], "instance_id string, repo string"))


def test_prompt_with_and_without_hints(sample):
    plain, hinted = sample.select(prompts.sft_prompt(), prompts.sft_prompt(True)).first()
    assert f"Repository: {SAMPLE[1]}\n" in plain and SAMPLE[3] in plain
    # Hints are one section more, and nothing else changes.
    assert plain.endswith("\n### Patch:\n") and SAMPLE[6] not in plain
    assert hinted.replace(f"### Hints:\n{SAMPLE[6]}\n", "").split() == plain.split()
    assert f"### Hints:\n{SAMPLE[6]}\n" in hinted
    assert hinted.endswith("\n### Patch:\n")


@pytest.mark.parametrize("hints", [None, ""])
def test_empty_hints_leave_no_section(spark, hints):
    row = list(SAMPLE)
    row[6] = hints
    df = spark.createDataFrame([tuple(row)], schemas.INSTANCE)
    assert df.select(prompts.sft_prompt(True) == prompts.sft_prompt()).first()[0]
    assert "### Hints" not in df.select(prompts.inference_prompt()).first()[0]


def test_inference_prompt_asks_for_git_diff(sample):
    prompt = sample.select(prompts.inference_prompt()).first()[0]
    assert 'unified diff format, starting with "diff --git".\n' in prompt
    assert "### Hints:" in prompt


def test_sft_examples(sample):
    got = inst.sft_examples(sample)
    assert got.columns == ["instance_id", "prompt", "completion", "text"]
    row = got.first()
    assert row.text == row.prompt + row.completion and row.completion == SAMPLE[4]


def test_patch_length_limit_is_inclusive(spark):
    sizes = [10_000, 8_001, 8_000, 1]
    data = [(f"long-{n}", "o/r", "c", "p", "é" * n) for n in sizes]
    df = inst.normalize(spark.createDataFrame(data, COLUMNS))
    assert rows(inst.sft_examples(df).select("instance_id")) == [("long-1",), ("long-8000",)]


def test_first_with_remainder(spark):
    df = spark.createDataFrame([(f"o__r-{i}",) for i in range(10)], "instance_id string")
    assert rows(inst.first_with_remainder(df, 3)) == [(f"o__r-{i}", 7) for i in range(3)]
    assert {r.n_more for r in inst.first_with_remainder(df, 30).collect()} == {0}


def test_lookup(sample):
    assert inst.require_id(sample, SAMPLE[0]).count() == 1
    assert inst.by_id(sample, "other").count() == 0
    with pytest.raises(ValueError, match="instance not found: other"):
        inst.require_id(sample, "other")


def test_null_values_in_prompt_columns_do_not_hide_the_row(sample):
    hidden = sample.withColumn("hints_text", F.lit(None).cast("string"))
    assert hidden.select(prompts.sft_prompt(True)).first()[0] is not None
