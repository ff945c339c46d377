import pytest
from conftest import rows

from patchloom import schemas
from patchloom.operators import comparison, metrics

FIELDS = schemas.RESULT.names


def result(instance_id, passed, **given):
    row = dict.fromkeys(FIELDS)
    row.update(
        instance_id=instance_id, passed=passed, tests_passed=0, tests_failed=0, tests_error=0,
        patch_applied=True, execution_time=0.0, logs="",
    )
    row.update(given)
    return tuple(row[f] for f in FIELDS)


@pytest.fixture
def table(spark):
    return lambda *found: spark.createDataFrame(list(found), schemas.RESULT)


@pytest.fixture
def sample(table):
    """Four runs: one good, one that broke, one whose patch was refused, one cut off."""
    return table(
        result("acme__rocket-1", True, tests_passed=12, execution_time=0.5),
        result("acme__rocket-2", False, tests_passed=3, tests_failed=4, execution_time=1.25,
               error_message="2 assertions"),
        result("acme__sled-9", False, execution_time=0.25, patch_applied=False,
               error_message="cannot apply patch to sled.py"),
        result("solo-1", False, tests_error=1, execution_time=30.0, error_message="TIMEOUT after 30 s"),
    )


def test_global_metrics(sample):
    got = metrics.global_metrics(sample).first().asDict()
    assert got == {
        "total_instances": 4, "resolved": 1, "patches_applied": 3, "patches_failed": 1,
        "total_tests_passed": 15, "total_tests_failed": 4, "total_tests_error": 1,
        "resolve_rate": 0.25, "patch_apply_rate": 0.75,
        "avg_execution_time": 8.0, "total_execution_time": 32.0,
    }


@pytest.mark.parametrize("passed, rate", [(True, 1.0), (False, 0.0)])
def test_all_alike(table, passed, rate):
    got = metrics.global_metrics(table(result("a-1", passed), result("a-2", passed))).first()
    assert got.resolve_rate == rate and got.resolved == 2 * rate


def test_empty_input_is_all_zero(table):
    empty = table()
    assert set(metrics.global_metrics(empty).first()) == {0}
    assert metrics.gold_validation(empty).first().asDict() == {
        "passed": 0, "total": 0, "rate": 0.0, "all_passed": False,
    }
    assert metrics.per_repo(empty).count() == 0
    assert comparison.summary(empty, empty).first().resolved_improvement == 0


def test_error_types(sample):
    assert rows(metrics.error_types(sample)) == [("other", 1), ("patch_apply_failed", 1), ("timeout", 1)]


def test_per_repo_by_id_and_by_lookup(spark, table):
    found = table(
        result("scikit-learn__scikit-learn-1", True), result("a__b-1", True), result("a__b-2", False)
    )
    assert rows(metrics.per_repo(found)) == [("a/b", 2, 1, 0.5), ("scikit", 1, 1, 1.0)]
    known = spark.createDataFrame(
        [("scikit-learn__scikit-learn-1", "scikit-learn/scikit-learn"), ("a__b-1", "a/b"), ("a__b-2", "a/b")],
        "instance_id string, repo string",
    )
    assert rows(metrics.per_repo(found, known)) == [
        ("a/b", 2, 1, 0.5), ("scikit-learn/scikit-learn", 1, 1, 1.0),
    ]


def test_leaderboard_and_card(sample):
    from pyspark.sql import functions as F

    got = metrics.leaderboard(sample.withColumn("model", F.lit("m"))).first()
    assert got.asDict() == {
        "model": "m", "method": "Direct Generation", "resolved": 1, "total": 4,
        "resolve_rate": 25.0, "patch_apply_rate": 75.0,
    }
    card = metrics.card_metrics(sample.limit(1).select(F.lit(7).alias("resolved"))).first()
    assert card.asDict() == {"resolved": "7", "resolve_rate": "N/A", "patches_applied": "N/A"}


def test_secondary_rates(table):
    found = table(
        result("a-1", True, tests_passed=3),
        result("a-2", False, tests_passed=1, tests_failed=2, tests_error=1),
        result("a-3", False, patch_applied=False),
    )
    got = metrics.secondary_rates(found).first()
    assert (got.tests_passed_rate, got.mean_tests_passed_rate, got.resolved_of_applied_rate) == (
        4 / 7, 0.625, 0.5,
    )


def test_coverage(spark, sample):
    instances = spark.createDataFrame([(f"o__r-{i}",) for i in range(5)], "instance_id string")
    assert tuple(metrics.coverage(sample, instances).first()) == (4, 5, 0.8)


def test_comparison(table):
    base = table(result("a", True), result("b", True), result("c", False, patch_applied=False))
    tuned = table(result("a", True), result("b", False), result("c", True), result("d", True))
    assert rows(comparison.new_resolved(base, tuned)) == [("c",), ("d",)]
    assert rows(comparison.regressions(base, tuned)) == [("b",)]
    assert rows(comparison.both_resolved(base, tuned)) == [("a",)]
    got = comparison.summary(base, tuned).first().asDict()
    assert got.pop("resolve_rate_improvement") == pytest.approx(3 / 4 - 2 / 3)
    assert got == {
        "resolved_improvement": 1, "patch_apply_improvement": 2, "n_new_resolved": 2,
        "n_regressions": 1, "n_both_resolved": 1, "net_improvement": 1,
    }
    nested = comparison.document(base, tuned, "b.json", "t.json").first()
    assert nested.base_model.metrics.resolved == 2
    assert nested.finetuned_model.predictions_path == "t.json"
    assert nested.improvement.resolved_delta == 1
