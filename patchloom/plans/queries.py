"""One function per registered query: (spark, sf_dir) → DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom import schemas
from patchloom.functions import diff, outcome, prompts, text
from patchloom.operators import (
    comparison,
    generation,
    instances as inst,
    metrics,
    pairs,
    predictions as pred,
    splits,
)
from patchloom.operators.counts import StageCounts
from patchloom.plans import corpus
from patchloom.sources import readers, writers
from patchloom.streaming import running

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

IMAGE_PREFIX = "registry.example/patch-images"
MODEL_NAME = "example/model"
UNSUPPORTED = ("src1", "src7/de")
LOOKUP_ID = "src2__en-2"


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# ---- instances and prompts


@query
def instances_normalize(spark, sf):
    return inst.normalize(corpus.raw_instances(spark, sf))


@query
def filter_patch_length(spark, sf):
    kept = inst.within_patch_length(corpus.instances(spark, sf))
    return kept.select("instance_id", F.length("patch").cast("long").alias("patch_length"))


@query
def sft_prompt(spark, sf):
    prompt = prompts.sft_prompt().alias("prompt")
    return corpus.instances(spark, sf).select("instance_id", prompt)


@query
def sft_prompt_hints(spark, sf):
    prompt = prompts.sft_prompt(include_hints=True).alias("prompt")
    return corpus.instances(spark, sf).select("instance_id", prompt)


@query
def inference_prompt(spark, sf):
    prompt = prompts.inference_prompt().alias("prompt")
    return corpus.instances(spark, sf).select("instance_id", prompt)


@query
def sft_text_short(spark, sf):
    prompt = prompts.short_prompt()
    return corpus.instances(spark, sf).select(
        "instance_id", prompt.alias("prompt"), F.concat(prompt, "patch").alias("text")
    )


@query
def prompt_from_template(spark, sf):
    template = prompts.ISSUE_HEAD + prompts.SFT_TAIL + "{patch}\n"
    return corpus.instances(spark, sf).select(
        "instance_id",
        prompts.render(template).alias("prompt"),
        prompts.render(prompts.PROSE_TEMPLATE).alias("prose_prompt"),
    )


@query
def sft_format(spark, sf):
    return inst.sft_examples(corpus.instances(spark, sf))


@query
def first_n(spark, sf):
    return inst.first_with_remainder(corpus.instances(spark, sf).select("instance_id", "repo"), 20)


@query
def instance_lookup(spark, sf):
    return inst.by_id(corpus.instances(spark, sf), LOOKUP_ID)


@query
def image_manifest(spark, sf):
    image = outcome.image_reference(F.col("repo"), F.col("base_commit"), IMAGE_PREFIX)
    bare = outcome.image_reference(F.lit("solo"), F.col("base_commit"), IMAGE_PREFIX)
    return corpus.instances(spark, sf).select(
        "instance_id", image.alias("image"), bare.alias("image_of_bare_repo")
    )


# ---- text


@query
def extract_patch(spark, sf):
    return corpus.responses(spark, sf).select(
        "conv_id", "turn", text.extract_patch(F.col("response")).alias("patch")
    )


@query
def strip_text(spark, sf):
    return corpus.responses(spark, sf).select(
        "conv_id", "turn", text.strip(F.col("response")).alias("stripped")
    )


@query
def strip_prompt_echo(spark, sf):
    patch = text.strip_prompt_echo(F.col("generated"), F.col("prompt"))
    return corpus.echoes(spark, sf).select("instance_id", patch.alias("patch"))


@query
def prediction_preview(spark, sf):
    return corpus.predictions(spark, sf).select(
        "instance_id",
        text.preview(F.col("patch"), 500, "...(truncated)").alias("preview"),
        F.greatest(F.length("patch") - 500, F.lit(0)).cast("long").alias("more_chars"),
    )


@query
def log_tail(spark, sf):
    return corpus.run_logs(spark, sf).select(
        "instance_id",
        text.log_tail(F.col("logs")).alias("logs"),
        text.log_tail(F.col("logs"), 1000).alias("preview"),
    )


@query
def parse_test_log(spark, sf):
    counts = corpus.logs(spark, sf).select(
        "event_id", outcome.log_counts(F.col("log")).alias("counts")
    )
    return counts.select("event_id", "counts.*")


@query
def result_verdict(spark, sf):
    passed = outcome.verdict(F.col("passed"), F.col("failed"), F.col("errors"))
    return parse_test_log(spark, sf).select("event_id", passed.alias("resolved"))


@query
def repo_from_id(spark, sf):
    return corpus.results(spark, sf).select(
        "instance_id", outcome.repo_from_id(F.col("instance_id")).alias("repo")
    )


@query
def error_bucket(spark, sf):
    return corpus.results(spark, sf).select(
        "instance_id", outcome.error_bucket(F.col("error_message")).alias("error_type")
    )


@query
def reward(spark, sf):
    return corpus.results(spark, sf).select(
        "instance_id", outcome.reward(F.col("passed"), F.col("patch_applied")).alias("reward")
    )


@query
def json_roundtrip(spark, sf):
    rows = pred.submission(
        corpus.instances(spark, sf), corpus.predictions(spark, sf), MODEL_NAME
    )
    encoded = rows.select(F.to_json(F.struct(*schemas.SUBMISSION.names)).alias("line"))
    return encoded.select(F.from_json("line", schemas.SUBMISSION).alias("row")).select("row.*")


# ---- diffs and preference pairs


@query
def diff_lines(spark, sf):
    lines = corpus.instances(spark, sf).select(
        "instance_id", F.posexplode(diff.lines(F.col("patch"))).alias("pos", "line")
    )
    return lines.withColumn("kind", diff.line_kind(F.col("line")))


@query
def diff_line_counts(spark, sf):
    counts = diff.changed_counts(F.col("patch")).alias("counts")
    counted = corpus.instances(spark, sf).select("instance_id", counts)
    return counted.select("instance_id", "counts.*")


@query
def neg_truncate(spark, sf):
    negatives = corpus.instances(spark, sf).select(
        "instance_id", diff.truncated(F.col("patch")).alias("rejected")
    )
    return negatives.where("rejected is not null")


@query
def neg_drop_every_third(spark, sf):
    negatives = corpus.instances(spark, sf).select(
        "instance_id", diff.every_nth_dropped(F.col("patch")).alias("rejected")
    )
    return negatives.where("rejected is not null")


@query
def neg_swap_signs(spark, sf):
    return corpus.instances(spark, sf).select(
        "instance_id", diff.signs_swapped(F.col("patch")).alias("rejected")
    )


@query
def pairs_rule_based(spark, sf):
    return pairs.rule_based(corpus.instances(spark, sf))


def _outcome_pairs(spark, sf, missing_is_failure):
    # Instances without a label have no result, so that the two defaults differ.
    found = corpus.predictions(spark, sf).select("instance_id", "patch")
    found = found.unionByName(corpus.untested(spark, sf))
    return pairs.from_outcomes(
        corpus.instances(spark, sf), found, corpus.results(spark, sf), missing_is_failure
    )


@query
def pairs_eval_strict(spark, sf):
    return _outcome_pairs(spark, sf, missing_is_failure=False)


@query
def pairs_eval_lenient(spark, sf):
    return _outcome_pairs(spark, sf, missing_is_failure=True)


@query
def pairs_hybrid(spark, sf):
    return pairs.preference_pairs(
        corpus.instances(spark, sf),
        "hybrid",
        results=corpus.results(spark, sf),
        predictions=corpus.predictions(spark, sf),
    )


@query
def pair_counts_by_strategy(spark, sf):
    return pairs.counts_by_strategy(pairs_hybrid(spark, sf))


@query
def dpo_format(spark, sf):
    return pairs.dpo(pairs_eval_lenient(spark, sf))


@query
def pairs_from_candidates(spark, sf):
    return pairs.from_candidates(
        corpus.instances(spark, sf), corpus.candidate_responses(spark, sf)
    )


@query
def pairs_pass_fail(spark, sf):
    return pairs.pass_fail(corpus.instances(spark, sf), corpus.candidates(spark, sf))


@query
def matched_attempts(spark, sf):
    found = pairs.matched_attempts(corpus.many_candidates(spark, sf))
    return found.select("instance_id", "pair", "passing_attempt", "failing_attempt", "chosen", "rejected")


@query
def pairs_pass_fail_all(spark, sf):
    return pairs.pass_fail_all(corpus.instances(spark, sf), corpus.many_candidates(spark, sf))


@query
def reconcile_responses(spark, sf):
    return pairs.reconcile(corpus.candidate_requests(spark, sf), corpus.delivered_responses(spark, sf))


@query
def pairs_from_answered(spark, sf):
    return pairs.from_candidates(
        corpus.instances(spark, sf),
        corpus.delivered_responses(spark, sf),
        requests=corpus.candidate_requests(spark, sf),
    )


@query
def stage_counts(spark, sf):
    counts = StageCounts()
    made = pairs.preference_pairs(
        corpus.instances(spark, sf),
        "hybrid",
        results=corpus.results(spark, sf),
        predictions=corpus.predictions(spark, sf),
        counts=counts,
    )
    writers.write_preference_pairs(made, f"{corpus.scratch(spark)}.json")
    return counts.table(spark)


# ---- predictions


@query
def predictions_nonempty(spark, sf):
    return pred.nonempty(corpus.predictions(spark, sf)).select("instance_id", "patch")


@query
def predictions_dedup_last(spark, sf):
    return pred.keep_last(corpus.submitted(spark, sf))


@query
def instances_with_predictions(spark, sf):
    kept = pred.with_predictions(corpus.instances(spark, sf), corpus.predictions(spark, sf))
    return kept.select("instance_id", "repo", "patch")


@query
def eval_worklist(spark, sf):
    wanted = corpus.instances(spark, sf).select(*schemas.EVAL_COLUMNS)
    return pred.worklist(wanted, corpus.predictions(spark, sf).select("instance_id", "patch"))


@query
def gold_predictions(spark, sf):
    return pred.gold(corpus.instances(spark, sf))


@query
def submission_format(spark, sf):
    return pred.submission(
        corpus.instances(spark, sf), corpus.predictions(spark, sf), MODEL_NAME
    )


@query
def filter_unsupported(spark, sf):
    return pred.drop_unsupported(
        corpus.predictions(spark, sf).select("instance_id", "patch"), UNSUPPORTED
    )


@query
def filter_unsupported_counts(spark, sf):
    return pred.unsupported_counts(corpus.predictions(spark, sf), UNSUPPORTED)


@query
def filter_unsupported_in(spark, sf):
    found = corpus.predictions(spark, sf).select("instance_id", "patch")
    return pred.drop_unsupported_in(found, corpus.unsupported_repos(spark, sf))


@query
def only_unsupported_in(spark, sf):
    found = corpus.predictions(spark, sf).select("instance_id", "patch")
    return pred.only_unsupported_in(found, corpus.unsupported_repos(spark, sf))


@query
def unsupported_samples(spark, sf):
    return pred.unsupported_samples(corpus.predictions(spark, sf), UNSUPPORTED)


def _submissions_by_model(spark, sf):
    return corpus.predictions(spark, sf).select(
        "instance_id",
        F.col("patch").alias("model_patch"),
        F.col("model").alias("model_name_or_path"),
    )


@query
def run_summary(spark, sf):
    return pred.run_summary(_submissions_by_model(spark, sf), "lite")


@query
def run_samples(spark, sf):
    return pred.run_samples(_submissions_by_model(spark, sf))


# ---- files: written as other tools write them, and read back


@query
def read_prediction_arrays(spark, sf):
    path = corpus.scratch(spark)
    # An id's two records are in one file, in the order in which they count.
    rows = corpus.submitted(spark, sf).repartition("instance_id").sortWithinPartitions("instance_id", "pos")
    writers.write_arrays(rows.select("instance_id", F.col("patch").alias("model_patch")), path)
    found = pred.keep_last(readers.read_prediction_array(spark, path))
    return found.select("instance_id", "patch")


@query
def read_prediction_objects(spark, sf):
    path = corpus.scratch(spark)
    rows = corpus.submitted(spark, sf).repartition("instance_id").sortWithinPartitions("instance_id", "pos")
    writers.write_prediction_objects(rows, path)
    return pred.keep_last(readers.read_prediction_object(spark, path))


@query
def read_result_bundle(spark, sf):
    path = corpus.scratch(spark)
    results = corpus.results(spark, sf).withColumn("logs", F.concat(F.lit('"results": [{}], \\"'), "instance_id"))
    writers.write_bundle(results, path, {"workers": 4})
    return readers.read_results(spark, path)


@query
def read_bundle_metrics(spark, sf):
    path = corpus.scratch(spark)
    writers.write_bundle(corpus.results(spark, sf).withColumn("logs", F.lit("")), path)
    return readers.read_bundle_metrics(spark, path)


@query
def read_patch_diffs(spark, sf):
    path = corpus.scratch(spark)
    rows = corpus.submitted(spark, sf).withColumn("instance_id", F.concat("instance_id", F.lit("/a+b %20")))
    writers.write_patch_diffs(rows, path)
    return readers.read_patch_files(spark, path, encoded=True)


@query
def lookup_in_stored(spark, sf):
    path = corpus.scratch(spark)
    writers.write_instances(corpus.instances(spark, sf), path)
    return inst.by_id(readers.read_stored_instances(spark, path), LOOKUP_ID).drop("n_chars")


@query
def examples_of_stored(spark, sf):
    path = corpus.scratch(spark)
    writers.write_instances(corpus.instances(spark, sf), path)
    return inst.sft_examples(readers.read_stored_instances(spark, path))


@query
def metrics_of_a_stream(spark, sf):
    """Results that arrive in two deliveries, a third of them in both."""
    path, name = corpus.scratch(spark), uuid4().hex
    results = corpus.results(spark, sf).withColumn("logs", F.lit("")).select("doc_id", *schemas.RESULT.names)
    for part in ("doc_id % 3 < 2", "doc_id % 3 > 0"):
        results.where(part).drop("doc_id").write.mode("append").json(path)
    stream = running.each_once(running.result_stream(spark, path, 2, arrival=True))
    with corpus.shared(spark):
        seen = []
        running.start_once(stream, lambda df, _: seen.append(df), name).awaitTermination()
    return seen[-1]


@query
def read_written_examples(spark, sf):
    path = f"{corpus.scratch(spark)}.json"
    writers.write_dataset(sft_format(spark, sf), path)
    return readers.read_sft_examples(spark, path)


@query
def read_written_pairs(spark, sf):
    path = corpus.scratch(spark)
    writers.write_preference_pairs(pairs_hybrid(spark, sf), f"{path}.json")
    return readers.read_preference_pairs(spark, f"{path}.json")


# ---- metrics


@query
def metrics_global(spark, sf):
    return metrics.global_metrics(corpus.results(spark, sf))


@query
def metrics_empty(spark, sf):
    # No result took a negative time: the filter reads the table and keeps nothing.
    return metrics.global_metrics(corpus.results(spark, sf).where("execution_time < 0"))


@query
def metrics_per_repo(spark, sf):
    return metrics.per_repo(corpus.results(spark, sf))


@query
def metrics_per_repo_joined(spark, sf):
    return metrics.per_repo(corpus.results(spark, sf), corpus.instances(spark, sf))


@query
def metrics_per_repo_unmatched(spark, sf):
    return metrics.per_repo(corpus.results_elsewhere(spark, sf), corpus.instances(spark, sf))


@query
def metrics_error_types(spark, sf):
    return metrics.error_types(corpus.results(spark, sf))


@query
def metrics_secondary(spark, sf):
    rates = metrics.secondary_rates(corpus.results(spark, sf))
    # The mean is a sum of fractions, whose last digits depend on their order.
    return rates.withColumn("mean_tests_passed_rate", F.round("mean_tests_passed_rate", 9))


@query
def metrics_coverage(spark, sf):
    return metrics.coverage(corpus.results(spark, sf), corpus.instances(spark, sf))


@query
def resolved_ids(spark, sf):
    return metrics.resolved_ids(corpus.results(spark, sf))


@query
def resolved_top20(spark, sf):
    return inst.first_with_remainder(metrics.resolved_ids(corpus.results(spark, sf)), 20)


@query
def gold_validation(spark, sf):
    return metrics.gold_validation(corpus.results(spark, sf))


@query
def leaderboard(spark, sf):
    return metrics.leaderboard(corpus.results(spark, sf))


@query
def model_card_metrics(spark, sf):
    repos = corpus.instances(spark, sf).select("repo").distinct()
    known = metrics.global_metrics(corpus.results(spark, sf), ["repo"]).select(
        "repo", "resolved", F.round(F.col("resolve_rate") * 100, 2).alias("resolve_rate")
    )
    return metrics.card_metrics(repos.join(known, "repo", "left"))


# ---- comparison


@query
def cmp_new_resolved(spark, sf):
    return comparison.new_resolved(corpus.results_base(spark, sf), corpus.results(spark, sf))


@query
def cmp_regressions(spark, sf):
    return comparison.regressions(corpus.results_base(spark, sf), corpus.results(spark, sf))


@query
def cmp_both_resolved(spark, sf):
    return comparison.both_resolved(corpus.results_base(spark, sf), corpus.results(spark, sf))


@query
def cmp_summary(spark, sf):
    return comparison.summary(corpus.results_base(spark, sf), corpus.results(spark, sf))


@query
def cmp_document(spark, sf):
    nested = comparison.document(
        corpus.results_base(spark, sf), corpus.results(spark, sf), "base.json", "tuned.json"
    )
    return nested.select(
        F.col("base_model.predictions_path").alias("base_path"),
        F.col("base_model.metrics.resolved").alias("base_resolved"),
        F.col("finetuned_model.predictions_path").alias("tuned_path"),
        F.col("finetuned_model.metrics.resolved").alias("tuned_resolved"),
        "improvement.*",
    )


@query
def cmp_document_full(spark, sf):
    nested = comparison.document(
        corpus.results_base(spark, sf), corpus.results(spark, sf), "base.json", "tuned.json"
    )
    sides = [
        F.col(f"{model}.metrics.{name}").alias(f"{side}_{name}")
        for side, model in (("base", "base_model"), ("tuned", "finetuned_model"))
        for name in schemas.METRICS.names
    ]
    return nested.select(*sides, "improvement.*")


# ---- splits


@query
def train_test_split(spark, sf):
    rows = corpus.instances(spark, sf).select("instance_id", "repo")
    return splits.exact_split(rows, "instance_id", key_is_unique=True)


@query
def train_test_split_pairs(spark, sf):
    # Rows that may repeat: split by the hash of the whole row.
    lines = corpus.instances(spark, sf).select(F.explode(diff.lines(F.col("patch"))).alias("line"))
    return splits.exact_split(lines, min_rows=splits.DPO_MIN_ROWS).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query
def train_test_split_by_pair(spark, sf):
    # Split up to four times over: pairs are stored once.
    made = writers.store(pairs_hybrid(spark, sf), corpus.scratch(spark))
    made = made.withColumn("pair", F.concat_ws("|", "instance_id", "strategy"))
    found = splits.exact_split(made, "pair", min_rows=splits.DPO_MIN_ROWS)
    return found.select("instance_id", "strategy", "chosen", "rejected", "split")


@query
def train_test_split_hash(spark, sf):
    return splits.hash_split(corpus.instances(spark, sf).select("instance_id", "repo"))


# ---- generation


@query
def candidate_requests(spark, sf):
    return pairs.requests(corpus.instances(spark, sf), num_negatives=3).select(
        "instance_id", "attempt", "temperature", "request"
    )


def _generated(spark, sf):
    # Nested, so that it travels to the workers by value and they need no copy of
    # this module.
    def stub_generator():
        def call(prompts):
            if any(len(prompt) % 5 == 0 for prompt in prompts):
                raise ValueError("model gave up")
            return [f"diff --git a/x b/x\n+{len(prompt)}" for prompt in prompts]

        return call

    prompted = corpus.instances(spark, sf).select(
        "instance_id", prompts.inference_prompt().alias("prompt")
    )
    found = generation.generate(prompted, stub_generator, batch=16)
    return found.select("instance_id", "patch", "error")


@query
def batch_generate_stub(spark, sf):
    return _generated(spark, sf)


@query
def generation_summary(spark, sf):
    return generation.summary(_generated(spark, sf))
