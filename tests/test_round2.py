"""Cases that once gave silent wrong results."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from patchloom.operators import joins, metrics, splits
from patchloom.sources import readers
from patchloom.streaming import running


def test_hash_split_takes_all_or_nothing(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("instance_id"))
    for fraction, test in ((1.0, 500), (0.0, 0)):
        assert splits.hash_split(df, fraction=fraction).where("split = 'test'").count() == test
    with pytest.raises(ValueError):
        splits.hash_split(df, fraction=1.5)


def test_results_of_unknown_instances_are_counted(spark):
    results = spark.createDataFrame([("a__b-1", True), ("x__y-2", False)], "instance_id string, passed boolean")
    known = spark.createDataFrame([("a__b-1", "a/b")], "instance_id string, repo string")
    assert sum(r.total for r in metrics.per_repo(results, known).collect()) == 2


def test_columns_are_looked_for_in_all_records(spark, tmp_path):
    path = tmp_path / "pairs.json"
    lines = [{"prompt": "p", "chosen": "c", "rejected": None}, {"prompt": "p", "chosen": "c", "rejected": "r"}]
    path.write_text("\n".join(map(json.dumps, lines)))
    assert readers.read_training_pairs(spark, str(path)).count() == 2
    path.write_text(json.dumps(lines[0]))
    with pytest.raises(ValueError):
        readers.read_training_pairs(spark, str(path))


def test_last_result_of_a_bundle_wins(spark, tmp_path):
    path = tmp_path / "bundle.json"
    twice = [{"instance_id": "i", "passed": p} for p in (True, False)]
    path.write_text(json.dumps({"results": twice}))
    assert readers.read_results(spark, str(path)).count() == 2
    assert [r.passed for r in readers.read_results(spark, str(path), last_wins=True).collect()] == [False]


def test_a_damaged_line_ends_the_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.json").write_text('{"instance_id": "i", "passed": true}\n{"instance_id": ')
    stream = running.result_stream(spark, str(tmp_path / "in"))
    query = stream.writeStream.format("memory").queryName("damaged").option("checkpointLocation", str(tmp_path / "c"))
    with pytest.raises(PySparkException):
        started = query.trigger(availableNow=True).start()
        started.awaitTermination(60)


def test_clustered_and_null_keys_are_spread(spark, no_broadcast):
    rows = spark.range(2_000, numPartitions=1).select(
        F.when(F.col("id") < 1_000, F.lit("hot")).alias("k"), F.col("id").alias("v")
    )
    lookup = spark.createDataFrame([("hot", 1)], "k string, w int")
    joined = joins.lookup_join(rows, lookup, "k", "left", hot_rows=100)
    assert joined.count() == 2_000 and joined.where("w = 1").count() == 1_000
    assert joins.hot_keys(rows.where("k is not null"), ["k"], 100).collect()[0]["_salts"] == 10
    plain = joins.lookup_join(rows, lookup, "k", "left", fact_is_unique=True)
    assert plain.count() == 2_000
    assert "_salts" not in plain._jdf.queryExecution().toString()


