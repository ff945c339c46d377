import pytest
from conftest import rows

from patchloom import schemas
from patchloom.operators import metrics
from patchloom.streaming import running


def test_running_metrics_equal_the_batch(spark, tmp_path):
    arriving = tmp_path / "in"
    seen = []

    def deliver(first, last):
        spark.range(first, last).selectExpr(
            "concat('o__r-', id) AS instance_id", "id % 3 = 0 AS passed", "int(id) AS tests_passed",
            "0 AS tests_failed", "0 AS tests_error", "id % 2 = 0 AS patch_applied",
            "cast(null AS string) AS error_message", "id / 8D AS execution_time", "'' AS logs",
        ).write.mode("append").json(str(arriving))

    def run():
        stream = running.result_stream(spark, str(arriving), max_files_per_trigger=2)
        sink = lambda df, _: seen.append(rows(df))
        running.start(running.running_metrics(stream), sink, "test").awaitTermination(120)

    for first, last in [(0, 10), (10, 25)]:
        deliver(first, last)
        run()
        stored = spark.read.schema(schemas.RESULT).json(str(arriving))
        assert seen[-1] == rows(metrics.global_metrics(stored))
    assert seen[-1][0][0] == 25


def test_each_result_counts_once(spark, tmp_path):
    """Deliveries that repeat, within a file, between files and between runs."""
    arriving, name, seen = tmp_path / "in", "once", []
    columns = spark.range(60).selectExpr(
        "concat('o', id % 3, '__r-', id) AS instance_id", "id % 3 = 0 AS passed", "int(id) AS tests_passed",
        "0 AS tests_failed", "0 AS tests_error", "id % 2 = 0 AS patch_applied",
        "cast(null AS string) AS error_message", "id / 8D AS execution_time", "'' AS logs", "id",
    )
    columns.write.parquet(str(tmp_path / "all"))
    every = spark.read.parquet(str(tmp_path / "all"))

    def deliver(first, last, times=1):
        part = every.where(f"id >= {first} AND id < {last}").drop("id")
        for _ in range(times):
            part.unionByName(part.limit(3)).write.mode("append").json(str(arriving))

    def run(sink=lambda df, _: seen.append(rows(df))):
        stream = running.each_once(running.result_stream(spark, str(arriving), 1, arrival=True))
        query = running.start_once(stream, sink, name)
        query.awaitTermination(300)
        return query

    deliver(0, 20, times=2)
    run()
    want = lambda last: rows(metrics.global_metrics(every.where(f"id < {last}")))
    assert seen[-1] == want(20)
    deliver(10, 40)

    def lost(df, batch):
        raise RuntimeError("the driver goes after the batch was written")

    with pytest.raises(Exception, match="the driver goes"):
        run(lost)
    run()
    assert seen[-1] == want(40)
    deliver(0, 60)
    run()
    assert seen[-1] == want(60)
    assert metrics.combined(metrics.global_metrics(every.limit(0))).collect() == metrics.global_metrics(every.limit(0)).collect()
