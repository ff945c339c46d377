"""Metrics over result files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from patchloom import schemas
from patchloom.operators.metrics import combined, global_metrics
from patchloom.session import shared_folder


def result_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, arrival: bool = False
) -> DataFrame:
    """Results from JSON Lines files dropped into ``path``, each file read once, with
    defaults filled in. A damaged line ends the stream. ``arrival`` adds ``arrived``, when the
    file was written."""
    reader = spark.readStream.schema(schemas.RESULT).option("mode", "FAILFAST")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    results = reader.json(path)
    if arrival:
        results = results.select("*", F.col("_metadata.file_modification_time").alias("arrived"))
    return results.na.fill(schemas.RESULT_DEFAULTS)


def each_once(results: DataFrame, keys: list[str] | None = None, expiry: str = "7 days") -> DataFrame:
    """The first delivery of each result in a stream that has ``arrived``.

    The state is one row per key (the instance id unless ``keys`` says otherwise) that
    arrived within ``expiry`` of the latest file; a repetition later than that counts again.
    """
    marked = results.withWatermark("arrived", expiry)
    return marked.dropDuplicatesWithinWatermark(keys or ["instance_id"]).drop("arrived")


def running_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The batch metrics over what has arrived so far.

    The state is one row of sums per group. There is no event time and so no
    watermark: write in complete or update mode. A result that is delivered twice
    counts twice: :func:`each_once` and :func:`start_once` are for such streams.
    """
    return global_metrics(results, by)


def start(
    metrics: DataFrame, sink: Callable[[DataFrame, int], None], name: str = "running_metrics"
) -> StreamingQuery:
    """Process what is there and stop; ``sink(df, batch_id)`` receives the full metrics.

    Progress is kept under ``name`` in the shared folder; a restart with the same name
    goes on where the last run ended.
    """
    checkpoint = f"{shared_folder(metrics.sparkSession)}/streams/{name}"
    return (
        metrics.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )


def start_once(
    results: DataFrame,
    sink: Callable[[DataFrame, int], None],
    name: str = "running_totals",
    by: list[str] | None = None,
) -> StreamingQuery:
    """Process what is there and stop; ``sink(df, batch_id)`` receives the metrics so far.

    For streams whose rows come once (:func:`each_once`). A batch's metrics are added to the
    batch before it and stored under its number. A batch that is run again after a restart
    replaces what it stored, from the same batch before it, so it is never added twice. The
    cost of a batch is that of its own rows, and what is kept is one row per group for each.
    """
    spark = results.sparkSession
    folder = f"{shared_folder(spark)}/streams/{name}"

    def totals(batch_id: int) -> str:
        return f"{folder}/totals/batch={batch_id}"

    def add(rows: DataFrame, batch_id: int) -> None:
        own = rows.sparkSession
        metrics = global_metrics(rows, by)
        if batch_id:
            metrics = metrics.unionByName(own.read.schema(metrics.schema).parquet(totals(batch_id - 1)))
        combined(metrics, by).write.mode("overwrite").parquet(totals(batch_id))
        sink(own.read.parquet(totals(batch_id)), batch_id)

    return (
        results.writeStream.outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(add)
        .start()
    )
