"""Expressions over test outcomes and their identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error bucket names and the words that select them, tried in this
# order on the lower-cased message.
ERROR_BUCKETS = [
    ("patch", "patch_apply_failed"),
    ("timeout", "timeout"),
    ("docker", "docker_error"),
]
OTHER_ERROR = "other"


def repo_from_id(instance_id: Column) -> Column:
    """``owner__name-123`` → ``owner/name``.

    Only what stands before the first hyphen is read, so an owner or name that
    contains one comes out short; join to the instances' own repo where that
    matters.
    """
    return F.replace(F.split_part(instance_id, F.lit("-"), F.lit(1)), F.lit("__"), F.lit("/"))


def error_bucket(message: Column) -> Column:
    """Bucket of an error message; NULL where there is no message."""
    lowered = F.lower(message)
    bucket = F.when(F.coalesce(message, F.lit("")) == "", F.lit(None).cast("string"))
    for word, name in ERROR_BUCKETS:
        bucket = bucket.when(F.contains(lowered, F.lit(word)), F.lit(name))
    return bucket.otherwise(F.lit(OTHER_ERROR))


def log_counts(log: Column) -> Column:
    """struct(passed, failed, errors): the last count of each kind a test log reports.

    The word may be followed by punctuation, so ``1 failed, 3 passed`` counts the
    failure too. A kind the log does not mention, or a number too long for an
    integer, counts as 0.
    """

    def last_count(pattern: str) -> Column:
        found = F.regexp_extract_all(log, F.lit(pattern), F.lit(1))
        return F.coalesce(
            F.try_element_at(found, F.lit(-1)).try_cast("int"), F.lit(0)
        )

    return F.struct(
        last_count(r"(\d+) passed\b").alias("passed"),
        last_count(r"(\d+) failed\b").alias("failed"),
        last_count(r"(\d+) errors?\b").alias("errors"),
    )


def verdict(passed: Column, failed: Column, errors: Column) -> Column:
    """True if some test passed and none failed or broke."""
    return (failed == 0) & (errors == 0) & (passed > 0)


def reward(passed: Column, patch_applied: Column) -> Column:
    """1 if all tests pass, 0 if the patch applied without that, -1 if it did not apply."""
    return F.when(passed, F.lit(1)).when(patch_applied, F.lit(0)).otherwise(F.lit(-1))


def image_reference(repo: Column, base_commit: Column, prefix: str) -> Column:
    """``prefix:owner.name-owner__name-commit``; a repo without ``/`` is both parts."""
    owner = F.split_part(repo, F.lit("/"), F.lit(1))
    has_name = F.contains(repo, F.lit("/"))
    name = F.when(has_name, F.split_part(repo, F.lit("/"), F.lit(2))).otherwise(owner)
    return F.concat(
        F.lit(prefix + ":"), owner, F.lit("."), name, F.lit("-"),
        owner, F.lit("__"), name, F.lit("-"), base_commit,
    )
