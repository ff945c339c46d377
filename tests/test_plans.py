"""What the plans of the registered queries must and must not contain."""

import re

import pytest

from patchloom.plans import corpus
from patchloom.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
RANKING = {"train_test_split", "train_test_split_pairs", "train_test_split_by_pair"}  # over bounded tables
RANKING |= {"read_prediction_arrays", "read_result_bundle", "read_bundle_metrics"}  # a row for each split of a file
PLACING = {"matched_attempts", "pairs_pass_fail_all"}  # by key and part of a hot key
GENERATING = {"batch_generate_stub", "generation_summary"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_products_or_rankings(spark, no_broadcast, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    assert ("MapInPandas" in text) == (name in GENERATING)
    assert ("+- Window " in text) == (name in RANKING | PLACING)
    if name in PLACING:
        assert all("_bucket" in w or "sum(" in w for w in re.findall(r"\+- Window (.*)", text))
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_large_lookups_are_shuffled(spark, no_broadcast):
    assert "SortMergeJoin" in plan(QUERIES["pairs_eval_lenient"](spark, SF_DIR))
    assert "LeftSemi" in plan(QUERIES["instances_with_predictions"](spark, SF_DIR))
    assert "LeftAnti" in plan(QUERIES["cmp_new_resolved"](spark, SF_DIR))


def test_only_read_what_is_used(spark):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES["metrics_global"](spark, SF_DIR)))
    assert schemas and not any("text" in s for s in schemas)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES["sft_prompt"](spark, SF_DIR)))
    assert len(schemas) == 1


def test_stored_filters_reach_the_scan(spark):
    text = plan(corpus.table(spark, SF_DIR, "documents").where("n_chars <= 8000"))
    assert "LessThanOrEqual(n_chars,8000)" in text


@pytest.mark.parametrize("name", ["sft_format", "pairs_rule_based", "extract_patch", "train_test_split_hash", "neg_drop_every_third"])
def test_row_wise_queries_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF_DIR))
