import math

import pytest
from conftest import rows

from patchloom.operators.splits import exact_split, hash_split


def sizes(df):
    return {r.split: r["count"] for r in df.groupBy("split").count().collect()}


@pytest.mark.parametrize("n", [0, 1, 100, 101, 1000, 1237])
def test_exact_size(spark, n):
    df = spark.range(n).selectExpr("concat('i', id) AS instance_id", "id AS v")
    got = exact_split(df, "instance_id")
    want = math.ceil(n * 0.1) if n > 100 else 0
    found = sizes(got)
    assert found.get("test", 0) == want and found.get("train", 0) == n - want
    assert rows(got.select("instance_id", "v")) == rows(df)
    assert rows(exact_split(df, "instance_id", key_is_unique=True)) == rows(got)


def test_exact_size_with_copies_on_the_edge(spark):
    """Nine rows in ten are copies of one row, so the edge falls among them."""
    df = spark.range(2000).selectExpr("CASE WHEN id % 10 < 9 THEN 'copy' ELSE concat('i', id) END AS v")
    got = exact_split(df, fraction=0.5)
    assert sizes(got) == {"test": 1000, "train": 1000}
    assert rows(got.select("v")) == rows(df)


def test_rows_of_one_key_with_different_content(spark):
    df = spark.range(600).selectExpr("'same' AS instance_id", "id AS v")
    got = exact_split(df, "instance_id")
    assert sizes(got) == {"test": 60, "train": 540}
    assert rows(got.select("v")) == rows(df.select("v"))


def test_partitioning_does_not_matter(spark):
    df = spark.range(500).selectExpr("concat('i', id) AS instance_id")
    for split in (lambda d: exact_split(d, "instance_id"), hash_split):
        assert rows(split(df)) == rows(split(df.repartition(7).orderBy("instance_id")))


def test_seed_changes_members(spark):
    df = spark.range(500).selectExpr("concat('i', id) AS instance_id")
    assert rows(exact_split(df, "instance_id")) != rows(exact_split(df, "instance_id", seed=7))


def test_hash_split_share(spark):
    df = spark.range(5000).selectExpr("concat('i', id) AS instance_id")
    assert 400 < sizes(hash_split(df))["test"] < 600


def test_null_keys_and_near_copies(spark):
    df = spark.range(800).selectExpr(
        "CASE WHEN id % 2 = 0 THEN NULL ELSE concat('i', id) END AS instance_id",
        "timestamp_micros(id % 5) AS v",
    )
    for got in (exact_split(df, "instance_id"), exact_split(df)):
        assert sizes(got) == {"test": 80, "train": 720}
        assert rows(got.drop("split")) == rows(df)
    assert hash_split(df).count() == 800


def test_unique_needs_a_key(spark):
    with pytest.raises(ValueError):
        exact_split(spark.range(3), key_is_unique=True)
