"""Explicit schemas: every reader is given one of these, nothing is inferred."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _strings(*names):
    return [StructField(name, StringType()) for name in names]


INSTANCE = StructType(
    _strings(
        "instance_id",
        "repo",
        "base_commit",
        "problem_statement",
        "patch",
        "test_patch",
        "hints_text",
        "created_at",
        "version",
    )
)

# What evaluation needs of an instance; readers select it so that Parquet only
# reads these columns.
EVAL_COLUMNS = ["instance_id", "repo", "base_commit", "test_patch", "patch"]

SFT_EXAMPLE = StructType(_strings("instance_id", "prompt", "completion", "text"))

PREFERENCE_PAIR = StructType(_strings("prompt", "chosen", "rejected", "instance_id"))

SUBMISSION = StructType(_strings("instance_id", "model_patch", "model_name_or_path"))

# Union of the prediction record shapes: evaluator rows use `patch`, submission
# rows `model_patch`, generation output may add `error`.
PREDICTION_RECORD = StructType(
    _strings("instance_id", "patch", "model_patch", "model_name_or_path", "error")
)

RESULT = StructType(
    [
        StructField("instance_id", StringType()),
        StructField("passed", BooleanType()),
        StructField("tests_passed", IntegerType()),
        StructField("tests_failed", IntegerType()),
        StructField("tests_error", IntegerType()),
        StructField("patch_applied", BooleanType()),
        StructField("error_message", StringType()),
        StructField("execution_time", DoubleType()),
        StructField("logs", StringType()),
    ]
)

# What a result that leaves a field out means by it; the others stay NULL.
RESULT_DEFAULTS = {
    "tests_passed": 0,
    "tests_failed": 0,
    "tests_error": 0,
    "patch_applied": True,
    "execution_time": 0.0,
    "logs": "",
}

METRICS = StructType(
    [
        StructField("total_instances", LongType()),
        StructField("resolved", LongType()),
        StructField("patches_applied", LongType()),
        StructField("patches_failed", LongType()),
        StructField("total_tests_passed", LongType()),
        StructField("total_tests_failed", LongType()),
        StructField("total_tests_error", LongType()),
        StructField("resolve_rate", DoubleType()),
        StructField("patch_apply_rate", DoubleType()),
        StructField("avg_execution_time", DoubleType()),
        StructField("total_execution_time", DoubleType()),
    ]
)

BUNDLE = StructType(
    [
        StructField("metrics", METRICS),
        StructField("results", ArrayType(RESULT)),
    ]
)
