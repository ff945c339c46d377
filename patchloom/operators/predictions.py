"""Predictions: (instance_id, patch) rows and what is selected or written from them."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.functions.text import preview
from patchloom.operators.instances import first_with_remainder
from patchloom.operators.joins import lookup_join

# Fixed value: repositories the evaluation harness cannot run.
UNSUPPORTED_REPOS = ("NodeBB/NodeBB",)


def keep_last(df: DataFrame, key: str = "instance_id", order: str = "pos") -> DataFrame:
    """One row per key: the one that comes last in ``order``, which is dropped.

    Copies of a key are combined before the shuffle, so a key that fills a third of
    the table still sends one row per task.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("_last")
    return df.groupBy(key).agg(last).select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def unique(df: DataFrame, key: str = "instance_id", order: str = "pos") -> DataFrame:
    """:func:`keep_last` where the rows carry their position, else ``df``."""
    return keep_last(df, key, order) if order in df.columns else df


def nonempty(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.coalesce("patch", F.lit("")) != "")


def gold(instances: DataFrame) -> DataFrame:
    """The instances' own patches as predictions."""
    return instances.select("instance_id", "patch")


def with_predictions(instances: DataFrame, predictions: DataFrame) -> DataFrame:
    """Instances whose id has a prediction, an empty one included."""
    ids = predictions.select("instance_id").distinct()
    return lookup_join(instances, ids, "instance_id", "left_semi", fact_is_unique=True)


def worklist(instances: DataFrame, predictions: DataFrame) -> DataFrame:
    """What is to be evaluated: instances with their non-empty prediction."""
    patches = nonempty(unique(predictions)).select(
        "instance_id", F.col("patch").alias("model_patch")
    )
    return lookup_join(instances, patches, "instance_id", fact_is_unique=True)


def submission(instances: DataFrame, predictions: DataFrame, model_name: str) -> DataFrame:
    """Submission rows for the instances that have a prediction."""
    patches = unique(predictions).select("instance_id", F.col("patch").alias("model_patch"))
    ids = instances.select("instance_id")
    return lookup_join(ids, patches, "instance_id", fact_is_unique=True).select(
        "instance_id", "model_patch", F.lit(model_name).alias("model_name_or_path")
    )


def flag_unsupported(
    predictions: DataFrame, repos: Iterable[str] = UNSUPPORTED_REPOS
) -> DataFrame:
    """Add ``is_unsupported``: the id starts with one of the repos (``/`` as ``__``).

    ``repos`` is a short list given by the caller; it becomes constants in the
    filter, not a join.
    """
    starts = [
        F.startswith("instance_id", F.lit(repo.replace("/", "__"))) for repo in sorted(set(repos))
    ]
    flag = reduce(lambda a, b: a | b, starts, F.lit(False))
    return predictions.withColumn("is_unsupported", flag)


def drop_unsupported(
    predictions: DataFrame, repos: Iterable[str] = UNSUPPORTED_REPOS
) -> DataFrame:
    return (
        flag_unsupported(predictions, repos).where(~F.col("is_unsupported")).drop("is_unsupported")
    )


def unsupported_counts(
    predictions: DataFrame, repos: Iterable[str] = UNSUPPORTED_REPOS
) -> DataFrame:
    """Number of kept and of skipped predictions."""
    return (
        flag_unsupported(predictions, repos)
        .groupBy("is_unsupported")
        .agg(F.count(F.lit(1)).alias("n_predictions"))
    )


def prefixes(repos: DataFrame) -> DataFrame:
    """What the ids of the repositories in ``repos`` (repo) begin with: (prefix), each once."""
    prefix = F.replace("repo", F.lit("/"), F.lit("__")).alias("prefix")
    return repos.where("repo IS NOT NULL").select(prefix).distinct()


def ids_with_prefix(predictions: DataFrame, starts: DataFrame) -> DataFrame:
    """The distinct ids that begin with one of ``starts`` (prefix, any number of rows).

    Ids are cut to each length that prefixes have (a handful, whatever their number) and
    equi-joined, so no id is compared with every prefix. Prefixes that many ids begin with
    are spread over several tasks.
    """
    starts = starts.where("prefix IS NOT NULL").select("prefix").distinct()
    lengths = starts.agg(F.collect_set(F.length("prefix"))).scalar()
    ids = predictions.where("instance_id IS NOT NULL").select("instance_id").distinct()
    cut = ids.select("instance_id", F.explode(lengths).alias("_n"))
    cut = cut.select("instance_id", F.left("instance_id", F.col("_n")).alias("prefix"))
    return lookup_join(cut, starts, "prefix", "left_semi").select("instance_id").distinct()


def drop_unsupported_in(predictions: DataFrame, repos: DataFrame) -> DataFrame:
    """:func:`drop_unsupported` with the repositories in a table (repo). Null ids are dropped."""
    found = ids_with_prefix(predictions, prefixes(repos))
    return lookup_join(predictions.where("instance_id IS NOT NULL"), found, "instance_id", "left_anti")


def only_unsupported_in(predictions: DataFrame, repos: DataFrame) -> DataFrame:
    """What :func:`drop_unsupported_in` leaves out."""
    found = ids_with_prefix(predictions, prefixes(repos))
    return lookup_join(predictions, found, "instance_id", "left_semi")


def unsupported_samples(
    predictions: DataFrame, repos: Iterable[str] = UNSUPPORTED_REPOS, count: int = 5
) -> DataFrame:
    """The first ``count`` ids that are left out, by id, and how many more there are."""
    skipped = flag_unsupported(predictions, repos).where("is_unsupported").select("instance_id")
    return first_with_remainder(skipped, count)


def run_summary(submissions: DataFrame, dataset: str) -> DataFrame:
    """Number of predictions per model."""
    return (
        submissions.groupBy(F.col("model_name_or_path").alias("model"))
        .agg(F.count(F.lit(1)).alias("n_predictions"))
        .withColumn("dataset", F.lit(dataset))
    )


def run_samples(submissions: DataFrame, count: int = 3, chars: int = 300) -> DataFrame:
    """The first ``count`` predictions by id, cut to ``chars`` characters."""
    return (
        submissions.orderBy("instance_id")
        .limit(count)
        .select("instance_id", preview(F.col("model_patch"), chars).alias("sample"))
    )
