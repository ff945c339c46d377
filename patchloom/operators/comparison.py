"""Base run against tuned run: which instances were won, lost and kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.operators.joins import lookup_join
from patchloom.operators.metrics import global_metrics, resolved_ids


def _against(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    # distinct() combines copies before its shuffle, and the join reuses that shuffle.
    return lookup_join(resolved_ids(left), resolved_ids(right).distinct(), "instance_id", how)


def new_resolved(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Ids resolved by the tuned run and not by the base run."""
    return _against(tuned, base, "left_anti")


def regressions(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Ids resolved by the base run and not by the tuned run."""
    return _against(base, tuned, "left_anti")


def both_resolved(base: DataFrame, tuned: DataFrame) -> DataFrame:
    return _against(base, tuned, "left_semi")


def summary(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """One row of differences (tuned minus base) and counts of ids won, lost and kept.

    Both runs are brought to one row per id in a single shuffle, combined before
    it; the rest is a sum over those rows.
    """

    def tagged(results: DataFrame, run: str) -> DataFrame:
        other = "tuned" if run == "base" else "base"
        one = {
            "rows": F.lit(1),
            "resolved": F.col("passed").cast("int"),
            "applied": F.col("patch_applied").cast("int"),
        }
        return results.select(
            "instance_id",
            *[F.coalesce(value, F.lit(0)).alias(f"{run}_{name}") for name, value in one.items()],
            *[F.lit(0).alias(f"{other}_{name}") for name in one],
        )

    counted = ("rows", "resolved", "applied")
    names = [f"{run}_{name}" for run in ("base", "tuned") for name in counted]
    per_id = (
        tagged(base, "base")
        .unionByName(tagged(tuned, "tuned"))
        .groupBy("instance_id")
        .agg(*[F.sum(name).alias(name) for name in names])
    )

    def count_where(column: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0).cast("long"))

    in_base, in_tuned = F.col("base_resolved") > 0, F.col("tuned_resolved") > 0
    totals = per_id.agg(
        *[F.coalesce(F.sum(name), F.lit(0).cast("long")).alias(name) for name in names],
        count_where("tuned_resolved", in_tuned & ~in_base).alias("n_new_resolved"),
        count_where("base_resolved", in_base & ~in_tuned).alias("n_regressions"),
        count_where("base_resolved", in_base & in_tuned).alias("n_both_resolved"),
    )

    def rate(run: str) -> Column:
        return F.coalesce(
            F.try_divide(F.col(f"{run}_resolved"), F.col(f"{run}_rows")), F.lit(0.0)
        )

    return totals.select(
        (F.col("tuned_resolved") - F.col("base_resolved")).alias("resolved_improvement"),
        (rate("tuned") - rate("base")).alias("resolve_rate_improvement"),
        (F.col("tuned_applied") - F.col("base_applied")).alias("patch_apply_improvement"),
        "n_new_resolved",
        "n_regressions",
        "n_both_resolved",
        (F.col("n_new_resolved") - F.col("n_regressions")).alias("net_improvement"),
    )


def document(
    base: DataFrame,
    tuned: DataFrame,
    base_path: str,
    tuned_path: str,
) -> DataFrame:
    """One row, nested: both runs' metrics and the improvement between them.

    The two inputs are single metrics rows, so they are put side by side as
    scalar subqueries.
    """

    def packed(results: DataFrame, path: str) -> DataFrame:
        metrics = global_metrics(results)
        return metrics.select(
            F.struct(
                F.lit(path).alias("predictions_path"),
                F.struct(*metrics.columns).alias("metrics"),
            ).alias("model")
        )

    tuned_model = packed(tuned, tuned_path).scalar()
    sides = packed(base, base_path).select(
        F.col("model").alias("base_model"), tuned_model.alias("finetuned_model")
    )

    def delta(name: str) -> Column:
        return F.col(f"finetuned_model.metrics.{name}") - F.col(f"base_model.metrics.{name}")

    return sides.withColumn(
        "improvement",
        F.struct(
            delta("resolved").alias("resolved_delta"),
            delta("resolve_rate").alias("resolve_rate_delta"),
        ),
    )
