from conftest import rows

from patchloom.operators import predictions as pred


def table(spark, data, columns="instance_id string, patch string"):
    return spark.createDataFrame(data, columns)


def test_last_of_an_id_wins_even_if_null(spark):
    df = table(
        spark,
        [("a", "1", 1), ("a", "2", 3), ("a", "3", 2), ("b", "x", 1), ("b", None, 2)],
        "instance_id string, patch string, pos long",
    )
    assert rows(pred.keep_last(df)) == [("a", "2"), ("b", None)]


def test_selection(spark):
    instances = table(
        spark, [("a", "r", "g1"), ("b", "r", "g2"), ("c", "r", "g3")],
        "instance_id string, repo string, patch string",
    )
    predictions = table(spark, [("a", "p1"), ("b", ""), ("gone", "p"), ("c", None)])
    assert rows(pred.nonempty(predictions)) == [("a", "p1"), ("gone", "p")]
    kept = pred.with_predictions(instances, predictions)
    assert rows(kept.select("instance_id")) == [("a",), ("b",), ("c",)]
    assert rows(pred.worklist(instances, predictions)) == [("a", "r", "g1", "p1")]
    assert rows(pred.gold(instances)) == [("a", "g1"), ("b", "g2"), ("c", "g3")]
    assert rows(pred.submission(instances, predictions, "m")) == [
        ("a", "p1", "m"), ("b", "", "m"), ("c", None, "m"),
    ]


def test_with_predictions_does_not_repeat_instances(spark):
    instances = table(spark, [("a", "g")])
    predictions = table(spark, [("a", "1"), ("a", "2")])
    assert pred.with_predictions(instances, predictions).count() == 1


def test_unsupported_repos_match_by_prefix(spark):
    predictions = table(spark, [("NodeBB__NodeBB-1", "p"), ("nodebb__x-1", "p"), ("ab__c-2", "p")])
    assert rows(pred.drop_unsupported(predictions)) == [("ab__c-2", "p"), ("nodebb__x-1", "p")]
    assert rows(pred.unsupported_counts(predictions)) == [(False, 2), (True, 1)]
    assert pred.drop_unsupported(predictions, ["a"]).count() == 2
    assert pred.drop_unsupported(predictions, []).count() == 3


def test_summary_and_samples(spark):
    rows_in = [(f"i{k}", "x" * (299 + k), "m") for k in range(5)]
    subs = table(spark, rows_in, "instance_id string, model_patch string, model_name_or_path string")
    assert rows(pred.run_summary(subs, "lite")) == [("m", 5, "lite")]
    samples = rows(pred.run_samples(subs))
    assert [s[0] for s in samples] == ["i0", "i1", "i2"]
    assert [len(s[1]) for s in samples] == [299, 300, 303]


def test_unsupported_repos_in_a_table(spark, no_broadcast):
    data = [("a__b-1", "x"), ("a__b-1", "y"), ("a__bc-2", ""), ("ab-3", None), ("c", "z"), (None, "n")]
    found = table(spark, data)
    for listed, gone in [
        (["a/b", "zz/z"], {"a__b-1", "a__bc-2"}),
        (["a/b-1", None, "a/b-1"], {"a__b-1"}),
        (["a", "c", "cc"], {"a__b-1", "a__bc-2", "ab-3", "c"}),
        ([""], {"a__b-1", "a__bc-2", "ab-3", "c"}),
        ([], set()),
    ]:
        repos = spark.createDataFrame([(r,) for r in listed], "repo string")
        kept = pred.drop_unsupported_in(found, repos)
        assert rows(kept) == sorted([r for r in data if r[0] and r[0] not in gone], key=repr)
        assert rows(pred.only_unsupported_in(found, repos)) == sorted([r for r in data if r[0] in gone], key=repr)
        constants = pred.drop_unsupported(found, [r for r in listed if r is not None])
        assert rows(constants.where("instance_id IS NOT NULL")) == rows(kept)


def test_ten_thousand_prefixes_take_no_nested_loop(spark):
    repos = spark.range(10_000).selectExpr("concat('o', id, '/r') AS repo")
    found = spark.range(30_000).selectExpr("concat('o', id % 20000, '__r-', id) AS instance_id", "'p' AS patch")
    kept = pred.drop_unsupported_in(found, repos)
    assert "NestedLoop" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 10_000


def test_first_skipped_ids(spark):
    found = table(spark, [(f"a__b-{k}", "x") for k in range(9)] + [("c__d-1", "x")])
    got = rows(pred.unsupported_samples(found, ["a/b"]))
    assert got == [(f"a__b-{k}", 4) for k in range(5)]
    assert rows(pred.unsupported_samples(found, ["q/r"])) == []
