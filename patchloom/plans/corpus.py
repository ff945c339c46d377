"""Domain tables derived from the given tables, row by row or by a key join.

The given tables hold no diffs or test runs, so prose becomes the text of a patch
and labels become outcomes. Everything is derived from whole tables and is the same
on any engine (see ``oracle.py`` for the other engine's SQL).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions import prompts
from patchloom.operators.instances import normalize
from patchloom.operators.joins import lookup_join
from patchloom.session import shared_folder

TABLE_SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, "
    "props string",
}

INSTANCE_ID = "concat(source, '__', lang, '-', doc_id) AS instance_id"
REPO = "concat(source, '/', lang) AS repo"
MODEL = "concat('m', doc_id % 2) AS model"

# Each line of the text as an added, removed or context line in turn.
PATCH = r"""concat('--- a/doc_', doc_id, '\n+++ b/doc_', doc_id, '\n@@ -1 +1 @@\n', array_join(
    transform(split(text, '\n', -1), (line, i) ->
        concat(CASE i % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END, line)), '\n'))"""

PASSED = "quality = 1 AND toxic = 0"


def scratch(spark: SparkSession) -> str:
    """A new folder for tables that a query writes and reads back: under the shared one, or
    for a session of this machine alone that names none, under a local one."""
    master = spark.sparkContext.master
    alone = master == "local" or master.startswith("local[")
    if alone and not spark.conf.get("spark.checkpoint.dir", None):
        return f"file:///tmp/checkpoints/scratch/{uuid4().hex}"
    return f"{shared_folder(spark)}/scratch/{uuid4().hex}"


@contextmanager
def shared(spark: SparkSession) -> Iterator[None]:
    """A session that names no shared folder has the local one meanwhile, as in :func:`scratch`."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        spark.conf.set("spark.checkpoint.dir", scratch(spark))
    try:
        yield
    finally:
        if not known:
            spark.conf.unset("spark.checkpoint.dir")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def raw_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances as a source would deliver them; every other one lacks its test patch."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        INSTANCE_ID,
        REPO,
        "md5(cast(doc_id AS string)) AS base_commit",
        "text AS problem_statement",
        f"{PATCH} AS patch",
        f"CASE WHEN doc_id % 2 = 1 THEN {PATCH} END AS test_patch",
        "CASE doc_id % 3 WHEN 1 THEN '' WHEN 2 THEN text END AS hints_text",
    )


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(raw_instances(spark, sf_dir))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have labels, with what outcomes are made from."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return lookup_join(documents, labels, "doc_id", fact_is_unique=True)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold patch, nothing, or the first half of the gold patch, by label."""
    half = r"substring_index(patch, '\n', (octet_length(patch) - "
    half += r"octet_length(replace(patch, '\n', '')) + 1) div 2)"
    return (
        _labelled(spark, sf_dir)
        .selectExpr("doc_id", INSTANCE_ID, MODEL, "quality", "toxic", f"{PATCH} AS patch")
        .selectExpr(
            "doc_id",
            "instance_id",
            f"""CASE WHEN {PASSED} THEN patch WHEN quality = 0 AND toxic = 1 THEN ''
                ELSE {half} END AS patch""",
            "model",
        )
    )


def untested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction for each instance without a label, hence without a result."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    rest = table(spark, sf_dir, "documents").join(labels, "doc_id", "left_anti")
    return rest.selectExpr(INSTANCE_ID, "concat('untested ', doc_id) AS patch")


def submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as read from files: an early wrong one, then the one that counts."""
    return predictions(spark, sf_dir).selectExpr(
        "instance_id",
        """inline(array(named_struct('patch', 'superseded', 'pos', doc_id * 2),
                        named_struct('patch', patch, 'pos', doc_id * 2 + 1)))""",
    )


def _result_rows(spark: SparkSession, sf_dir: str, passed: str) -> DataFrame:
    # Times are eighths: exact in binary, so sums do not depend on their order.
    return (
        _labelled(spark, sf_dir)
        .selectExpr("doc_id", INSTANCE_ID, REPO, MODEL, "n_chars", "toxic", f"{passed} AS passed")
        .selectExpr(
            "doc_id",
            "instance_id",
            "repo",
            "model",
            "passed",
            "int(n_chars % 7 + int(passed)) AS tests_passed",
            "int(CASE WHEN passed THEN 0 ELSE 1 + doc_id % 3 END) AS tests_failed",
            "toxic AS tests_error",
            "toxic = 0 AS patch_applied",
            """CASE WHEN NOT passed THEN CASE doc_id % 6 WHEN 1 THEN ''
                WHEN 2 THEN 'Failed to apply patch: x' WHEN 3 THEN 'Read Timeout'
                WHEN 4 THEN 'Docker daemon' WHEN 5 THEN 'boom' END END AS error_message""",
            "n_chars / 8D AS execution_time",
        )
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result_rows(spark, sf_dir, PASSED)


def results_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run, in which every fifth document came out the other way."""
    return _result_rows(spark, sf_dir, f"(doc_id % 5 = 0) <> ({PASSED})")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers in four shapes: a git diff, a plain diff, markers in prose, prose."""
    assistant = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return assistant.selectExpr(
        "conv_id",
        "turn",
        r"""CASE conv_id % 4
            WHEN 0 THEN concat('Sure. ', text, '\ndiff --git a/x b/x\n+', text, '\n \n')
            WHEN 1 THEN concat('So:\n--- a/x\n+++ b/x\n+', text, '\n')
            WHEN 2 THEN concat(text, ' --- or +++ ', text)
            ELSE concat('\u3000 \t', text, ' \u001c\n') END AS response""",
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test logs that end in a runner's summary line; parts that are zero are left out."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        r"""concat('collected\n7 passed so far\n=== ', concat_ws(', ',
                CASE WHEN event_id % 3 > 0 THEN concat(event_id % 3, ' failed') END,
                CASE WHEN user_id > 0 THEN concat(user_id, ' passed') END,
                CASE WHEN event_id % 4 > 0 THEN concat(event_id % 4, ' errors') END),
            ' in 0.12s ===') AS log""",
    )


def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long logs: whole documents."""
    return table(spark, sf_dir, "documents").selectExpr(INSTANCE_ID, "text AS logs")


def echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated texts that repeat their prompt, do not, or consist of it."""
    prompted = raw_instances(spark, sf_dir).withColumn("prompt", prompts.short_prompt())
    return prompted.selectExpr(
        "instance_id",
        "prompt",
        r"""CASE doc_id % 3 WHEN 0 THEN concat(prompt, ' \n', patch, '\n')
            WHEN 1 THEN patch ELSE prompt END AS generated""",
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts per prediction, of which every third one passes."""
    fanned = predictions(spark, sf_dir).select("*", F.expr("explode(sequence(0, 2)) AS attempt"))
    return fanned.selectExpr(
        "instance_id",
        "attempt",
        "concat(patch, attempt) AS patch",
        "(doc_id + attempt) % 3 = 0 AS passed",
    )


def candidate_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three answers per instance: the gold patch, a longer one, and one that may have failed."""
    fanned = raw_instances(spark, sf_dir).select("*", F.expr("explode(sequence(0, 2)) AS attempt"))
    return fanned.selectExpr(
        "instance_id",
        "attempt",
        r"""CASE WHEN attempt = 0 THEN patch
            WHEN attempt = 1 THEN concat(' \n', patch, '\n+extra\n')
            WHEN doc_id % 4 <> 0 THEN concat('diff ', patch) END AS response""",
    )


def many_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to seven attempts per prediction, of which none, some or all pass."""
    fanned = predictions(spark, sf_dir).select("*", F.expr("explode(sequence(0, int(doc_id % 7))) AS attempt"))
    return fanned.selectExpr(
        "instance_id",
        "attempt",
        "concat(patch, attempt) AS patch",
        "(doc_id + attempt * attempt) % 3 = 0 AS passed",
    )


def candidate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of three requests per instance."""
    return raw_instances(spark, sf_dir).selectExpr("instance_id", "explode(sequence(0, 2)) AS attempt")


def delivered_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to four attempts, of which three were asked for: some twice, some without a
    text, some not at all."""
    fanned = raw_instances(spark, sf_dir).selectExpr(
        "doc_id", "instance_id", "patch", "explode(sequence(0, 3)) AS attempt"
    )
    kept = fanned.where("(doc_id + attempt) % 4 <> 0").selectExpr(
        "*", "explode(sequence(0, int((doc_id + attempt) % 3 = 0))) AS pos"
    )
    return kept.selectExpr(
        "instance_id",
        "attempt",
        "CASE WHEN (doc_id + pos) % 5 > 0 THEN concat('answer ', attempt, ' ', pos, ' ', patch) WHEN doc_id % 2 = 0 THEN '' END AS response",
        "pos",
    )


def unsupported_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many repositories as every seventh instance names with its number, in a table."""
    return table(spark, sf_dir, "documents").where("doc_id % 7 = 3").selectExpr("concat(source, '/', lang, '-', doc_id) AS repo")


def results_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results, and one of an instance that is not there for every fourth of them."""
    found = results(spark, sf_dir).select("doc_id", "instance_id", "passed")
    gone = found.where("doc_id % 4 = 1").selectExpr("doc_id", "concat('gone__', doc_id % 3, '-', doc_id) AS instance_id", "passed")
    return found.unionByName(gone).drop("doc_id")
