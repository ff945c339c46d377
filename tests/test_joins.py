"""Lookup joins in which one key holds a third of the rows."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from patchloom.operators import comparison, predictions as pred
from patchloom.operators.joins import fits_broadcast, hot_keys, lookup_join


@pytest.fixture
def skewed(spark):
    """3000 rows: 1000 exact copies of one row, 500 of key 'warm', the rest distinct."""
    key = """CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 6 = 1 THEN 'warm'
             ELSE concat('k', id) END"""
    return spark.range(0, 3000, 1, 12).selectExpr(
        f"{key} AS k", "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS v"
    )


@pytest.fixture
def lookup(spark):
    return spark.range(0, 3000, 2, 4).selectExpr("concat('k', id) AS k", "id AS w").unionByName(
        spark.createDataFrame([("hot", -1)], "k string, w long")
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows_as_a_plain_join(no_broadcast, skewed, lookup, how):
    got = lookup_join(skewed, lookup, "k", how, hot_rows=50)
    want = skewed.join(lookup, "k", how)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_copies_of_a_hot_key_are_spread(spark, no_broadcast, skewed, lookup):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_join(skewed, lookup, "k", hot_rows=50).where("k = 'hot'")
        parts = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) == 4 and sum(r["count"] for r in parts) == 1000


def test_hot_keys_and_their_salts(skewed):
    assert rows(hot_keys(skewed, ["k"], 100)) == [("hot", 10), ("warm", 5)]
    assert hot_keys(skewed, ["k"], 1000).count() == 0


def test_small_lookup_is_left_to_the_planner(spark, skewed, lookup, tmp_path):
    lookup.write.parquet(str(tmp_path / "small"))
    small = spark.read.schema(lookup.schema).parquet(str(tmp_path / "small"))
    assert fits_broadcast(small)
    joined = lookup_join(skewed, small, "k")
    assert "_salt" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert rows(joined) == rows(skewed.join(small, "k"))


def test_skewed_operators(spark, no_broadcast):
    results = spark.range(0, 900, 1, 6).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('i', id) END AS instance_id",
        "id % 2 = 0 OR id % 3 = 0 AS passed",
        "true AS patch_applied",
    )
    base = results.where("instance_id <> 'hot'")
    won = comparison.new_resolved(base, results)
    assert won.count() == 300 and won.distinct().count() == 1
    assert comparison.summary(base, results).first().n_new_resolved == 300
    copies = results.selectExpr("instance_id", "'p' AS patch", "monotonically_increasing_id() AS pos")
    assert pred.keep_last(copies).count() == 601


def test_pairs_with_a_hot_instance(spark, no_broadcast, monkeypatch):
    """One instance has a third of all candidates; compared with nested loops."""
    from patchloom.operators import joins, pairs

    monkeypatch.setattr(joins.lookup_join, "__defaults__", ("inner", 20))
    monkeypatch.setattr(joins.lookup_joins, "__defaults__", (20,))
    attempts = [
        ("hot" if n % 3 == 0 else f"i{n % 50}", n, f"p{n % 9}", n % 4 == 1) for n in range(600)
    ]
    issues = [(name, "o/r", f"issue {name}", f"gold {name}") for name in {a[0] for a in attempts}]
    candidates = spark.createDataFrame(
        attempts, "instance_id string, attempt int, patch string, passed boolean"
    ).repartition(6)
    instances = spark.createDataFrame(
        issues, "instance_id string, repo string, problem_statement string, patch string"
    )
    best = {}
    for name, n, patch, passed in attempts:
        if passed:
            best.setdefault(name, patch)
    want = sorted((best[a[0]], a[2], a[0]) for a in attempts if not a[3] and a[0] in best)
    got = pairs.pass_fail(instances, candidates)
    assert rows(got.select("chosen", "rejected", "instance_id")) == sorted(want, key=repr)

    responses = candidates.selectExpr("instance_id", "attempt", "patch AS response")
    got = pairs.from_candidates(instances, responses).select("chosen", "rejected", "instance_id")
    assert rows(got) == sorted(((f"gold {a[0]}", a[2], a[0]) for a in attempts), key=repr)
