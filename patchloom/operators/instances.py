"""Instances: defaults, lookups, and supervised fine-tuning examples."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom import schemas
from patchloom.functions import prompts

MAX_PATCH_LENGTH = 8000


def normalize(raw: DataFrame) -> DataFrame:
    """The instance columns in order, missing optional ones filled in.

    ``test_patch`` becomes ``''`` where missing; hints, creation time and version
    stay NULL.
    """
    require_columns(raw, ["instance_id", "repo", "base_commit", "problem_statement", "patch"])
    defaults = {"test_patch": "''"}

    def expression(name: str) -> str:
        given = name if name in raw.columns else "NULL"
        return f"coalesce(cast({given} AS string), {defaults.get(name, 'NULL')}) AS {name}"

    return raw.selectExpr(*[expression(name) for name in schemas.INSTANCE.names])


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df``, or ValueError naming every column it lacks."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def first(df: DataFrame, n: int, order: str = "instance_id") -> DataFrame:
    """The first ``n`` rows by ``order``: a partial top-n per task, then a merge of those."""
    return df.orderBy(order).limit(n)


def first_with_remainder(df: DataFrame, n: int, order: str = "instance_id") -> DataFrame:
    """:func:`first`, with the number of rows that were left out as ``n_more``."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return first(df, n, order).withColumn("n_more", F.greatest(total - n, F.lit(0).cast("long")))


def by_id(instances: DataFrame, instance_id: str) -> DataFrame:
    """The rows of one id, lazily."""
    return instances.where(F.col("instance_id") == instance_id)


def require_id(instances: DataFrame, instance_id: str) -> DataFrame:
    """:func:`by_id`, or ValueError if there is none (runs a job)."""
    found = by_id(instances, instance_id)
    if found.isEmpty():
        raise ValueError(f"instance not found: {instance_id}")
    return found


def within_patch_length(
    instances: DataFrame, max_patch_length: int = MAX_PATCH_LENGTH
) -> DataFrame:
    """Instances whose patch has at most ``max_patch_length`` characters.

    A stored length (``n_chars``) is compared in the scan, without reading the patch."""
    length = F.col("n_chars") if "n_chars" in instances.columns else F.length("patch")
    return instances.where(length <= max_patch_length)


def sft_examples(
    instances: DataFrame,
    include_hints: bool = False,
    max_patch_length: int = MAX_PATCH_LENGTH,
) -> DataFrame:
    """(instance_id, prompt, completion, text), text being prompt and completion."""
    prompt = prompts.sft_prompt(include_hints)
    return within_patch_length(instances, max_patch_length).select(
        "instance_id",
        prompt.alias("prompt"),
        F.col("patch").alias("completion"),
        F.concat(prompt, F.col("patch")).alias("text"),
    )
