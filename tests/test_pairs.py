import pytest
from conftest import rows

from patchloom import schemas
from patchloom.operators import generation, instances as inst, pairs

LONG = "--- a\n+++ b\n" + "".join(f"+line {i}\n" for i in range(12))


@pytest.fixture
def instances(spark):
    data = [
        (name, "o/r", "c", f"issue {name}", patch)
        for name, patch in [("i1", "gold1"), ("i2", "gold2"), ("i3", LONG), ("i4", "\n" * 5)]
    ]
    return inst.normalize(
        spark.createDataFrame(
            data,
            "instance_id string, repo string, base_commit string, problem_statement string, patch string",
        )
    )


@pytest.fixture
def predictions(spark):
    data = [("i1", "p1"), ("i2", "gold2"), ("i3", "p3"), ("gone", "p")]
    return spark.createDataFrame(data, "instance_id string, patch string")


@pytest.fixture
def results(spark):
    return spark.createDataFrame([("i1", False), ("i3", True)], "instance_id string, passed boolean")


def ids(df):
    return [r[0] for r in rows(df.select("instance_id"))]


def test_missing_outcome_either_way(instances, predictions, results):
    strict = pairs.from_outcomes(instances, predictions, results, missing_is_failure=False)
    lenient = pairs.from_outcomes(instances, predictions, results)
    assert ids(strict) == ["i1"] and ids(lenient) == ["i1", "i2"]
    assert ids(pairs.from_outcomes(instances, predictions, results, drop_equal=True)) == ["i1"]
    row = strict.first()
    assert (row.chosen, row.rejected) == ("gold1", "p1") and "issue i1" in row.prompt


def test_last_prediction_and_outcome_win(spark, instances):
    predictions = spark.createDataFrame(
        [("i1", "late", 2), ("i1", "early", 1), ("i2", "only", 1)],
        "instance_id string, patch string, pos long",
    )
    results = spark.createDataFrame(
        [("i1", True, 1), ("i1", False, 2), ("i2", True, 1)],
        "instance_id string, passed boolean, pos long",
    )
    got = pairs.from_outcomes(instances, predictions, results)
    assert rows(got.select("instance_id", "rejected")) == [("i1", "late")]


def test_rule_based(instances):
    got = pairs.rule_based(instances)
    assert rows(got.select("instance_id", "strategy")) == [
        ("i3", "drop_lines"), ("i3", "truncate"), ("i4", "truncate"),
    ]
    rejected = {(r.instance_id, r.strategy): r.rejected for r in got.collect()}
    assert rejected["i4", "truncate"] == "\n\n"
    assert "line 2\n" not in rejected["i3", "drop_lines"]


def test_methods(instances, predictions, results):
    hybrid = pairs.preference_pairs(instances, "hybrid", results, predictions)
    assert rows(pairs.counts_by_strategy(hybrid)) == [
        ("drop_lines", 1), ("evaluation", 2), ("truncate", 2),
    ]
    assert pairs.preference_pairs(instances, "hybrid").count() == 3
    assert pairs.preference_pairs(instances, "rule_based").count() == 3
    assert pairs.preference_pairs(instances, "evaluation", results, predictions).count() == 2
    with pytest.raises(ValueError, match="needs results and predictions"):
        pairs.preference_pairs(instances, "evaluation")
    with pytest.raises(ValueError, match="needs make_generator"):
        pairs.preference_pairs(instances, "synthetic")
    with pytest.raises(ValueError, match="unknown method"):
        pairs.preference_pairs(instances, "other")


def test_dpo_columns(spark):
    given = spark.createDataFrame(
        [("Steer the sled", "+steer(0)", "+steer(9)", "acme__sled-9")], schemas.PREFERENCE_PAIR
    )
    got = pairs.dpo(given)
    assert got.columns == ["prompt", "chosen", "rejected"]
    assert rows(got) == [("Steer the sled", "+steer(0)", "+steer(9)")]


def test_requests(instances):
    got = pairs.requests(instances, num_negatives=2, temperature=0.5)
    assert got.count() == 8
    assert {round(r.temperature, 9) for r in got.collect()} == {0.5, 0.6}
    for wording, mark in [("flaw_list", "one of these flaws"), ("subtle_bug", "Side effects"), ("plain", "Given this GitHub issue:\nissue")]:
        assert mark in pairs.requests(instances, wording=wording).first().request
    with pytest.raises(ValueError):
        pairs.requests(instances, num_negatives=0)


def test_from_candidates(spark, instances):
    responses = spark.createDataFrame(
        [("i1", 0, " gold1\n"), ("i1", 1, " other "), ("i2", 0, None), ("i2", 1, ""), ("gone", 0, "x")],
        "instance_id string, attempt int, response string",
    )
    got = pairs.from_candidates(instances, responses)
    assert rows(got.select("instance_id", "chosen", "rejected")) == [("i1", "gold1", "other")]
    assert pairs.from_candidates(instances, responses, drop_equal=False).count() == 2


def test_synthetic_skips_failures(instances):
    def make():
        def call(prompt, temperature):
            if "issue i2" in prompt:
                raise RuntimeError("refused")
            return f" bad at {temperature:.1f}\n"

        return call

    got = pairs.preference_pairs(
        instances, "synthetic", make_generator=make, num_negatives=2, temperature=0.7
    )
    assert rows(got.where("instance_id = 'i1'").select("chosen", "rejected")) == [
        ("gold1", "bad at 0.7"), ("gold1", "bad at 0.8"),
    ]
    assert "i2" not in ids(got) and got.count() == 6


def test_pass_fail_pairs_every_failure_once(spark, instances):
    candidates = spark.createDataFrame(
        [("i1", 0, "f0", False), ("i1", 1, "ok1", True), ("i1", 2, "ok2", True), ("i1", 3, "f3", False),
         ("i2", 0, "f", False), ("i3", 0, "ok", True)],
        "instance_id string, attempt int, patch string, passed boolean",
    )
    got = pairs.pass_fail(instances, candidates)
    assert rows(got.select("chosen", "rejected")) == [("ok1", "f0"), ("ok1", "f3")]


def test_generate_keeps_going_and_loads_once_per_task(spark):
    df = spark.range(20).selectExpr("concat('i', id) AS instance_id", "string(id) AS prompt")

    def make():
        import uuid

        loaded = uuid.uuid4().hex

        def call(prompt):
            if int(prompt) % 4 == 0:
                raise ValueError(f"no {prompt}")
            return loaded

        return call

    got = generation.generate(df, make, partitions=3).collect()
    assert {r.error for r in got if not r.patch} == {f"no {i}" for i in range(0, 20, 4)}
    assert all(r.error is None for r in got if r.patch)
    assert 1 <= len({r.patch for r in got if r.patch}) <= 3
    assert generation.summary(generation.generate(df, make)).first().asDict() == {
        "processed": 20, "successful": 15, "failed": 5,
    }


def test_answers_that_are_not_text_fail_their_row_only(spark):
    df = spark.range(4).selectExpr("concat('i', id) AS instance_id", "string(id) AS prompt")

    def make():
        return lambda prompt: {"0": 5, "1": "\ud800", "2": None}.get(prompt, "fine")

    got = {r.prompt: (r.patch, r.error) for r in generation.generate(df, make).collect()}
    assert got["0"] == ("", "generator returned int, not text")
    assert got["1"][0] == "" and "surrogates" in got["1"][1]
    assert got["2"] == (None, None) and got["3"] == ("fine", None)
    assert tuple(generation.summary(generation.generate(df, make)).first()) == (4, 1, 3)


def test_a_bad_row_costs_only_itself_in_a_batch(spark):
    df = spark.range(40).selectExpr("id", "repeat('x', int(id * 7 % 40)) AS prompt", "id % 2 AS kind").coalesce(1)

    def make():
        def call(prompts, kind):
            assert len(prompts) == len(kind) <= 8
            lengths = [len(p) for p in prompts]
            assert lengths == sorted(lengths)
            if 13 in lengths:
                raise ValueError("unlucky")
            if 20 in lengths and len(lengths) > 1:
                return ["too few"]
            return [5 if n == 30 else f"{n} {k} of {len(prompts)}" for n, k in zip(lengths, kind)]

        return call

    got = generation.generate(df, make, options=["kind"], batch=8).collect()
    assert [r.id for r in got] == list(range(40))
    by_length = {len(r.prompt): (r.patch, r.error, r.kind) for r in got}
    assert by_length[13][:2] == ("", "unlucky")
    assert by_length[30][:2] == ("", "generator returned int, not text")
    rest = {n: v for n, v in by_length.items() if n not in (13, 30)}
    assert all(e is None and p.startswith(f"{n} {k} of ") for n, (p, e, k) in rest.items())
    assert by_length[0][0].endswith("of 8") and by_length[20][0].endswith("of 1")
    with pytest.raises(ValueError):
        generation.generate(df, make, batch=0)


def test_batches_of_nulls_and_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "x")], "id string, prompt string").repartition(6)
    made = tmp_path / "made"
    made.mkdir()

    def make():
        import uuid

        (made / uuid.uuid4().hex).touch()
        return lambda prompts: [p.upper() for p in prompts]

    got = {r.id: (r.patch, r.error) for r in generation.generate(df, make, batch=4).collect()}
    assert got["b"] == ("X", None) and got["a"][0] == "" and "upper" in got["a"][1]
    assert 1 <= len(list(made.iterdir())) <= 2
    assert generation.generate(df.limit(0), make, batch=4).count() == 0


def test_every_attempt_is_in_a_pair(spark, instances):
    columns = "instance_id string, attempt int, patch string, passed boolean"
    sides = {"i1": (3, 7), "i2": (6, 2), "i3": (4, 4), "i4": (0, 3), "i5": (3, 0)}
    data = [(i, k, f"{i}{k}", k < p) for i, (p, f) in sides.items() for k in range(p + f)]
    data += [(None, 0, "x", True), (None, 1, "y", False), ("i1", 99, "z", None)]
    candidates = spark.createDataFrame(data, columns)
    for hot_rows in (100_000, 2):
        found = pairs.matched_attempts(candidates, hot_rows).collect()
        for i, (p, f) in sides.items():
            own = [r for r in found if r.instance_id == i]
            assert len(own) == (max(p, f) if p and f else 0)
            if own:
                assert sorted(r.pair for r in own) == list(range(len(own)))
                assert {r.passing_attempt for r in own} == set(range(p))
                assert {r.failing_attempt for r in own} == set(range(p, p + f))
                assert all((r.chosen, r.rejected) == (f"{i}{r.passing_attempt}", f"{i}{r.failing_attempt}") for r in own)
                uses = [sum(r.passing_attempt == k for r in own) for k in range(p)]
                assert max(uses) - min(uses) <= 1
        assert {r.instance_id for r in found} == {"i1", "i2", "i3"}
    assert pairs.matched_attempts(candidates.limit(0)).count() == 0


def test_reconcile(spark, instances):
    keys = "instance_id string, attempt int"
    requests = spark.createDataFrame([("i1", 0), ("i1", 1), ("i1", 2), ("i1", 2), ("i2", 0), (None, 0)], keys)
    given = [("i1", 0, None, 1), ("i1", 0, "b", 2), ("i1", 0, "a", 3), ("i1", 1, "", 1), ("gone", 0, "u", 1), (None, 0, "n", 1)]
    responses = spark.createDataFrame(given, keys + ", response string, pos int")
    got = rows(pairs.reconcile(requests, responses))
    assert got == sorted(
        [("i1", 0, "answered", 1, "b"), ("i1", 0, "repeated", 2, None), ("i1", 1, "failed", 1, ""), ("i1", 2, "lost", 0, None),
         ("i2", 0, "lost", 0, None), ("gone", 0, "unasked", 1, "u"), (None, 0, "lost", 0, None), (None, 0, "unasked", 1, "n")],
        key=repr,
    )
    assert {r[2] for r in got} == set(pairs.STATES)
    made = pairs.from_candidates(instances, responses, requests=requests)
    assert rows(made.select("instance_id", "rejected")) == [("i1", "b")]


def test_stage_counts_need_no_job_of_their_own(spark, instances, tmp_path):
    from patchloom.operators.counts import StageCounts

    counts = StageCounts()
    answers = spark.createDataFrame([("i1", "bad")], "instance_id string, patch string")
    results = spark.createDataFrame([("i1", False), ("i2", True)], "instance_id string, passed boolean")
    made = pairs.preference_pairs(instances, "hybrid", results=results, predictions=answers, counts=counts)
    made.write.parquet(str(tmp_path / "pairs"))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    found = counts.rows()
    assert len(tracker.getJobIdsForGroup(None)) == before
    assert found == {
        "instances": instances.count(), "results": 2, "predictions": 1,
        "rule_based pairs": pairs.rule_based(instances).count(), "evaluation pairs": 1,
        "pairs": spark.read.parquet(str(tmp_path / "pairs")).count(),
    }
    with pytest.raises(ValueError):
        counts.watch(made, "pairs")
