"""Metrics over evaluation results (one row per evaluated instance)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions.outcome import error_bucket, repo_from_id
from patchloom.operators.joins import lookup_join

DEFAULT_METHOD = "Direct Generation"


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _total(column: str, zero: Column) -> Column:
    return F.coalesce(F.sum(column), zero)


def global_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, test totals, rates and times; one row, or one per ``by`` group.

    Without groups there is a row for empty input too, all zero.
    """
    rows = F.count(F.lit(1))
    resolved = F.count_if("passed")
    applied = F.count_if("patch_applied")
    seconds = _total("execution_time", F.lit(0.0))
    none = F.lit(0).cast("long")
    return results.groupBy(*(by or [])).agg(
        rows.alias("total_instances"),
        resolved.alias("resolved"),
        applied.alias("patches_applied"),
        (rows - applied).alias("patches_failed"),
        _total("tests_passed", none).alias("total_tests_passed"),
        _total("tests_failed", none).alias("total_tests_failed"),
        _total("tests_error", none).alias("total_tests_error"),
        _rate(resolved, rows).alias("resolve_rate"),
        _rate(applied, rows).alias("patch_apply_rate"),
        _rate(seconds, rows).alias("avg_execution_time"),
        seconds.alias("total_execution_time"),
    )


def combined(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The metrics of several sets of results together, from the :func:`global_metrics` of each."""
    counts = [
        "total_instances", "resolved", "patches_applied", "patches_failed",
        "total_tests_passed", "total_tests_failed", "total_tests_error",
    ]
    none = F.lit(0).cast("long")
    sums = {name: _total(name, none) for name in counts} | {"total_execution_time": _total("total_execution_time", F.lit(0.0))}
    rows = sums["total_instances"]
    rates = {
        "resolve_rate": _rate(sums["resolved"], rows),
        "patch_apply_rate": _rate(sums["patches_applied"], rows),
        "avg_execution_time": _rate(sums["total_execution_time"], rows),
    }
    names = [*counts, *rates, "total_execution_time"]
    return parts.groupBy(*(by or [])).agg(*((sums | rates)[name].alias(name) for name in names))


def coverage(results: DataFrame, instances: DataFrame) -> DataFrame:
    """Share of the instances that were evaluated at all; the rates leave out the rest."""
    evaluated = results.agg(F.count_distinct("instance_id").alias("evaluated"))
    total = instances.agg(F.count_distinct("instance_id")).scalar()
    return evaluated.select(
        "evaluated", total.alias("instances"), _rate(F.col("evaluated"), total).alias("coverage")
    )


def per_repo(results: DataFrame, instances: DataFrame | None = None) -> DataFrame:
    """Total, resolved and rate per repository, by name.

    The repository is read off the id unless ``instances`` are given to look it up
    in, which is right for owners and names with hyphens too. A result whose id no
    instance has counts under the repository read off its id.
    """
    if instances is None:
        keyed = results.select(repo_from_id(F.col("instance_id")).alias("repo"), "passed")
    else:
        keyed = lookup_join(
            results.select("instance_id", "passed"),
            instances.select("instance_id", "repo"),
            "instance_id",
            "left",
        )
        known = F.coalesce("repo", repo_from_id(F.col("instance_id")))
        keyed = keyed.withColumn("repo", known)
    total = F.count(F.lit(1))
    resolved = F.count_if("passed")
    return (
        keyed.groupBy("repo")
        .agg(
            total.alias("total"),
            resolved.alias("resolved"),
            _rate(resolved, total).alias("resolve_rate"),
        )
        .orderBy("repo")
    )


def error_types(results: DataFrame) -> DataFrame:
    """Number of results per error bucket, by name; results without a message left out."""
    return (
        results.select(error_bucket(F.col("error_message")).alias("error_type"))
        .where(F.col("error_type").isNotNull())
        .groupBy("error_type")
        .agg(F.count(F.lit(1)).alias("n_results"))
        .orderBy("error_type")
    )


def resolved_ids(results: DataFrame) -> DataFrame:
    return results.where("passed").select("instance_id")


def secondary_rates(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tests passed, over all tests and as the mean of the instances that ran any, and
    the share of applied patches that resolve their instance."""
    applied = F.count_if("patch_applied")
    run = F.col("tests_passed") + F.col("tests_failed") + F.col("tests_error")
    resolved = F.count_if(F.col("passed") & F.col("patch_applied"))
    return results.groupBy(*(by or [])).agg(
        _rate(F.sum("tests_passed"), F.sum(run)).alias("tests_passed_rate"),
        F.coalesce(F.avg(F.try_divide(F.col("tests_passed"), run)), F.lit(0.0)).alias(
            "mean_tests_passed_rate"
        ),
        _rate(resolved, applied).alias("resolved_of_applied_rate"),
    )


def gold_validation(results: DataFrame) -> DataFrame:
    """Whether results of gold patches all passed, as they should; false on empty input."""
    total = F.count(F.lit(1))
    passed = F.count_if("passed")
    return results.agg(
        passed.alias("passed"),
        total.alias("total"),
        _rate(passed, total).alias("rate"),
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("all_passed"),
    )


def leaderboard(runs: DataFrame, method: str = DEFAULT_METHOD) -> DataFrame:
    """One entry per (model, method); ``runs`` are results with a model column.

    A missing method column means ``method`` throughout. Rates are percentages with
    two decimals.
    """
    if "method" not in runs.columns:
        runs = runs.withColumn("method", F.lit(method))
    total = F.count(F.lit(1))
    resolved = F.count_if("passed")
    applied = F.count_if("patch_applied")
    return runs.groupBy("model", "method").agg(
        resolved.alias("resolved"),
        total.alias("total"),
        F.round(_rate(resolved, total) * 100, 2).alias("resolve_rate"),
        F.round(_rate(applied, total) * 100, 2).alias("patch_apply_rate"),
    )


def card_metrics(metrics: DataFrame) -> DataFrame:
    """The three metrics a model card shows, as text, ``N/A`` where unknown."""
    shown = {
        name: F.coalesce(F.col(name).cast("string"), F.lit("N/A"))
        if name in metrics.columns
        else F.lit("N/A")
        for name in ("resolved", "resolve_rate", "patches_applied")
    }
    return metrics.withColumns(shown)
