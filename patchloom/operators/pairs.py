"""Preference pairs: (prompt, chosen, rejected, instance_id, strategy) rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions import diff, prompts
from patchloom.functions.text import strip
from patchloom.operators.counts import StageCounts, watched
from patchloom.operators.generation import generate
from patchloom.operators.joins import HOT_ROWS, lookup_join, lookup_joins
from patchloom.operators.predictions import unique
from patchloom.operators.ranks import ranked

METHODS = ("evaluation", "synthetic", "rule_based", "hybrid")


def _pairs(df: DataFrame, rejected: Column, strategy: Column, chosen: str = "patch") -> DataFrame:
    return df.select(
        prompts.sft_prompt().alias("prompt"),
        F.col(chosen).alias("chosen"),
        rejected.alias("rejected"),
        "instance_id",
        strategy.alias("strategy"),
    )


def from_outcomes(
    instances: DataFrame,
    predictions: DataFrame,
    results: DataFrame,
    missing_is_failure: bool = True,
    drop_equal: bool = False,
) -> DataFrame:
    """Gold patch over the failed prediction of the same instance.

    ``missing_is_failure`` says what a prediction without a result counts as. Each of
    the three tables is shuffled once, by instance.
    """
    known = [c for c in ("instance_id", "passed", "pos") if c in results.columns]
    candidates = unique(predictions).select("instance_id", F.col("patch").alias("rejected"))
    joined = lookup_joins(
        instances.select("instance_id", "repo", "problem_statement", "patch"),
        [(candidates, "inner"), (unique(results.select(*known)), "left")],
        "instance_id",
        fact_is_unique=True,
    ).where(~F.coalesce(F.col("passed"), F.lit(not missing_is_failure)))
    if drop_equal:
        joined = joined.where(F.col("rejected") != F.col("patch"))
    return _pairs(joined, F.col("rejected"), F.lit("evaluation"))


def rule_based(instances: DataFrame) -> DataFrame:
    """Gold patch over corrupted copies of itself: none, one or two pairs per instance."""
    patch = F.col("patch")
    corrupted = F.array(
        F.struct(F.lit("truncate").alias("strategy"), diff.truncated(patch).alias("rejected")),
        F.struct(
            F.lit("drop_lines").alias("strategy"), diff.every_nth_dropped(patch).alias("rejected")
        ),
    )
    negatives = instances.withColumn("_negative", F.explode(corrupted)).where(
        F.col("_negative.rejected").isNotNull()
    )
    return _pairs(negatives, F.col("_negative.rejected"), F.col("_negative.strategy"))


def requests(
    instances: DataFrame,
    num_negatives: int = 1,
    temperature: float = 0.7,
    wording: str | None = "flaw_list",
) -> DataFrame:
    """Fan out to ``num_negatives`` generation requests per instance.

    The temperature rises by 0.1 per attempt. ``wording`` names the request text;
    None asks with the plain training prompt, as one does of a weaker model.
    """
    if num_negatives < 1:
        raise ValueError("num_negatives must be at least 1")
    text = prompts.sft_prompt() if wording is None else prompts.negative_request(wording)
    attempt = F.explode(F.sequence(F.lit(0), F.lit(num_negatives - 1)))
    return instances.withColumn("attempt", attempt).withColumns(
        {
            "temperature": F.lit(float(temperature)) + F.col("attempt") * F.lit(0.1),
            "request": text,
        }
    )


#: What can become of a request or a response.
STATES = ("answered", "failed", "lost", "unasked", "repeated")


def reconcile(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses held against requests by instance and attempt: (instance_id, attempt, state,
    n_responses, response).

    A request is answered (its earliest response with a text counts), failed (only NULL or
    empty ones) or lost (none); a response without a request is unasked. A key with several
    responses has another row with the state repeated, whose count is that of the further
    ones. ``responses`` may have an order (pos); without one the least text counts. Each side
    is one row per key before the join, combined ahead of the shuffle, so no key is hot.
    """
    keys = ["instance_id", "attempt"]
    empty = F.coalesce("response", F.lit("")) == ""
    order = F.struct(empty, *(["pos"] if "pos" in responses.columns else []), "response")
    given = responses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("response"), order).alias("best")
    )
    asked = requests.select(*keys).distinct().withColumn("asked", F.lit(True))
    response = F.col("best.response")
    state = (
        F.when(F.col("asked").isNull(), "unasked")
        .when(F.col("n").isNull(), "lost")
        .when(F.coalesce(response, F.lit("")) == "", "failed")
        .otherwise("answered")
    )
    further = F.struct(F.lit("repeated").alias("state"), (F.col("n") - 1).alias("n_responses"), F.lit(None).cast("string").alias("response"))
    first = F.struct(state.alias("state"), F.when(F.col("n") >= 1, F.lit(1)).otherwise(0).cast("long").alias("n_responses"), response.alias("response"))
    both = F.when(F.col("n") > 1, F.array(first, further)).otherwise(F.array(first))
    return asked.join(given, keys, "full_outer").select(*keys, F.explode(both).alias("at")).select(*keys, "at.*")


def from_candidates(
    instances: DataFrame, responses: DataFrame, drop_equal: bool = True, requests: DataFrame | None = None
) -> DataFrame:
    """Gold patch over stored responses (instance_id, attempt, response).

    Responses are stripped; failed ones (NULL or empty) give no pair, nor, with
    ``drop_equal``, do those equal to the gold patch. Many responses may share an
    instance; an instance has one row. With ``requests`` (instance_id, attempt) only
    responses that were asked for count, and each attempt once, as :func:`reconcile` says.
    """
    if requests is not None:
        responses = reconcile(requests, responses).where("state = 'answered'")
    usable = responses.where(F.coalesce("response", F.lit("")) != "").select(
        "instance_id", strip(F.col("response")).alias("rejected")
    )
    lookup = instances.select("instance_id", "repo", "problem_statement", "patch")
    joined = lookup_join(usable, lookup, "instance_id")
    if drop_equal:
        joined = joined.where(F.col("rejected") != F.col("patch"))
    return _pairs(joined, F.col("rejected"), F.lit("synthetic"))


def synthetic(
    instances: DataFrame,
    make_generator: Callable[[], Callable[..., str]],
    num_negatives: int = 1,
    temperature: float = 0.7,
    wording: str | None = "flaw_list",
    drop_equal: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Ask a generator for flawed patches and pair them with the gold ones.

    The instance's own columns ride along through the Python worker, so requests
    and answers need no join. Every use of the result calls the generator again: pass it
    through ``writers.store`` first.
    """
    asked = requests(instances, num_negatives, temperature, wording).select(
        "instance_id", "repo", "problem_statement", "patch", "temperature", "request"
    )
    answered = generate(
        asked, make_generator, prompt="request", options=["temperature"],
        output="response", partitions=partitions,
    ).where("error IS NULL AND response IS NOT NULL")
    answered = answered.withColumn("rejected", strip(F.col("response")))
    if drop_equal:
        answered = answered.where(F.col("rejected") != F.col("patch"))
    return _pairs(answered, F.col("rejected"), F.lit("synthetic"))


def pass_fail(instances: DataFrame, candidates: DataFrame) -> DataFrame:
    """Passing over failing candidates (instance_id, attempt, patch, passed) of one instance.

    Every failing candidate gives one pair, with the instance's first passing
    attempt, so the result grows with the candidates and not with their square.
    """
    chosen = (
        candidates.where(F.col("passed"))
        .groupBy("instance_id")
        .agg(F.min_by("patch", F.struct("attempt", "patch")).alias("chosen"))
    )
    issues = instances.select("instance_id", "repo", "problem_statement")
    failing = candidates.where(~F.col("passed")).select(
        "instance_id", F.col("patch").alias("rejected")
    )
    joined = lookup_joins(failing, [(chosen, "inner"), (issues, "inner")], "instance_id")
    return _pairs(joined, F.col("rejected"), F.lit("pass_fail"), chosen="chosen")


def matched_attempts(candidates: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every passing and every failing attempt of an instance that has both, in as few pairs as
    that takes: (instance_id, pair, passing_attempt, failing_attempt, chosen, rejected).

    Both sides are placed by a digest of attempt and patch. The i-th row of the longer side
    goes with row i modulo the other side's length, so the shorter side's rows are used
    about equally often, and there are as many pairs as the longer side has rows. An instance
    may hold any share of the attempts: it is placed and joined in parts.
    """
    order = F.md5(F.concat_ws("|", F.col("attempt").cast("string"), "patch"))
    known = candidates.where("passed IS NOT NULL").select("instance_id", "attempt", "patch", "passed")
    sides = known.groupBy("instance_id").agg(F.count_if("passed").alias("p"), F.count_if(~F.col("passed")).alias("f"))
    sides = sides.where("p > 0 AND f > 0")
    placed = ranked(known, ["instance_id", "passed"], order, "place", hot_rows, sides)
    # How many pairs use a row of the shorter side follows from the counts: more than
    # ``hot_rows`` are dealt to several copies of it.
    least = F.least("p", "f")
    salts = F.ceil(F.ceil(F.greatest("p", "f") / least) / F.lit(hot_rows)).cast("long")
    longer = F.col("passed") == (F.col("p") > F.col("f"))
    many = placed.where(longer).withColumns(
        {"slot": F.col("place") % least, "salt": F.floor((F.col("place") - F.col("place") % least) / least).cast("long") % salts}
    )
    few = placed.where(~longer).select(
        "instance_id", F.col("place").alias("slot"), F.col("attempt").alias("other_attempt"), F.col("patch").alias("other"),
        F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"),
    )
    joined = many.join(few, ["instance_id", "slot", "salt"])

    def of(passing: bool, own: str, other: str, name: str) -> Column:
        return F.when(F.col("passed") == F.lit(passing), F.col(own)).otherwise(F.col(other)).alias(name)

    return joined.select(
        "instance_id",
        F.col("place").alias("pair"),
        of(True, "attempt", "other_attempt", "passing_attempt"),
        of(False, "attempt", "other_attempt", "failing_attempt"),
        of(True, "patch", "other", "chosen"),
        of(False, "patch", "other", "rejected"),
    )


def pass_fail_all(instances: DataFrame, candidates: DataFrame) -> DataFrame:
    """:func:`pass_fail` with all passing attempts: the pairs of :func:`matched_attempts`."""
    issues = instances.select("instance_id", "repo", "problem_statement")
    joined = lookup_join(matched_attempts(candidates), issues, "instance_id")
    return _pairs(joined, F.col("rejected"), F.lit("pass_fail"), chosen="chosen")


def dpo(pairs: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected) only."""
    return pairs.select("prompt", "chosen", "rejected")


def counts_by_strategy(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_pairs"))


def preference_pairs(
    instances: DataFrame,
    method: str = "evaluation",
    results: DataFrame | None = None,
    predictions: DataFrame | None = None,
    make_generator: Callable[[], Callable[..., str]] | None = None,
    counts: StageCounts | None = None,
    **options,
) -> DataFrame:
    """Pairs by ``method``; ``options`` go to the function of that method.

    hybrid is the evaluation pairs, where their inputs are given, and all
    rule-based ones, copies kept. ``counts`` has the rows of every input and of each kind of
    pair when the result has been written.
    """
    instances = watched(counts, instances, "instances")
    results = watched(counts, results, "results")
    predictions = watched(counts, predictions, "predictions")
    made = _by_method(instances, method, results, predictions, make_generator, counts, options)
    return watched(counts, made, "pairs")


def _by_method(instances, method, results, predictions, make_generator, counts, options) -> DataFrame:
    if method == "evaluation":
        if results is None or predictions is None:
            raise ValueError("method 'evaluation' needs results and predictions")
        return from_outcomes(instances, predictions, results, **options)
    if method == "synthetic":
        if make_generator is None:
            raise ValueError("method 'synthetic' needs make_generator")
        return synthetic(instances, make_generator, **options)
    if method == "rule_based":
        return rule_based(instances)
    if method == "hybrid":
        ruled = watched(counts, rule_based(instances), "rule_based pairs")
        if results is None or predictions is None:
            return ruled
        judged = from_outcomes(instances, predictions, results, **options)
        return watched(counts, judged, "evaluation pairs").unionByName(ruled)
    raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")
