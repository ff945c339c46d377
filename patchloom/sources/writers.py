"""Writers: datasets of part files, written by all tasks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from patchloom import schemas
from patchloom.operators.metrics import error_types, global_metrics, per_repo
from patchloom.operators.pairs import dpo
from patchloom.operators.predictions import unique
from patchloom.session import shared_folder
from patchloom.sources.patch_files import FORMAT, PatchFiles

#: A compressed file of lines is read by one task, so it ends after so many rows.
COMPRESSED_ROWS = 50_000


def write_dataset(
    df: DataFrame, path: str, format: str = "json", mode: str = "errorifexists", compression: str = "gzip"
) -> int:
    """Write JSON Lines or Parquet; returns the number of rows.

    The rows are counted while they are written, in the same job. ``compression`` is that of
    the lines: prompts and patches hold much the same text several times. A task writes as many
    compressed files as its rows take; with none, files are plain text and split when read.
    """
    if format not in ("json", "parquet"):
        raise ValueError(f"unknown format: {format}")
    written = Observation()
    writer = df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    if format == "json":
        if compression != "none":
            # The fastest level: the slower ones cost more than twice the job's time for a fourth less.
            writer.option("maxRecordsPerFile", COMPRESSED_ROWS).option("zlib.compress.level", "BEST_SPEED")
        writer.option("ignoreNullFields", False).option("compression", compression).json(path)
    else:
        writer.parquet(path)
    return written.get["rows"]


def _document(entries: DataFrame, path: str, head: str, tail: str, mode: str) -> None:
    """Each part file is ``head``, the JSON texts in ``entries`` with commas between, and ``tail``.

    Nulls are left out; a part without a row is an empty file."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"value": pa.array([head])})
        held = None  # a comma follows unless it is the last
        for batch in batches:
            texts = batch.column(0).drop_null().to_pylist()
            if texts:
                known = [held, *texts] if held is not None else texts
                held = known.pop()
                yield pa.record_batch({"value": pa.array([t + "," for t in known], pa.string())})
        yield pa.record_batch({"value": pa.array(([] if held is None else [held]) + [tail], pa.string())})

    entries.mapInArrow(lines, "value string").write.mode(mode).text(path)


def _json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("entry")


def write_arrays(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Part files that hold one JSON array of records each, rows in the order of ``df``'s parts."""
    _document(df.select(_json(df)), path, "[", "]", mode)


def write_prediction_objects(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Part files that hold one object ``{id: patch, ..}`` each; null ids are left out."""
    entry = F.to_json(F.create_map("instance_id", "patch"), {"ignoreNullFields": "false"})
    inner = F.regexp_extract(entry, r"(?s)\A\{(.*)\}\z", 1).alias("entry")
    _document(predictions.where("instance_id IS NOT NULL").select(inner), path, "{", "}", mode)


def write_bundle(results: DataFrame, path: str, config: dict[str, str] | None = None) -> None:
    """One file with a run's config, metrics and results, for tools that want a single record.

    The format is one document, so one task writes it; results pass through it row by row.
    Written from a stored table, so that the input is evaluated once. :func:`write_report`
    is the parallel form; :func:`readers.read_results` reads this one in parallel too.
    """
    stored = store(results.select(*schemas.RESULT.names))
    metrics = global_metrics(stored)
    summary = metrics.select(_json(metrics)).first()[0]
    settings = json.dumps({k: str(v) for k, v in (config or {}).items()})
    head = f'{{"config": {settings},\n"metrics": {summary},\n"results": ['
    entries = results.sparkSession.range(1).select(F.lit(None).cast("string").alias("entry"))
    _document(entries.union(stored.select(_json(stored))).coalesce(1), path, head, "]}", "errorifexists")


def write_preference_pairs(
    pairs: DataFrame, path: str, format: str = "json", mode: str = "errorifexists"
) -> int:
    """``json``: pairs with their instance id as gzipped JSON Lines; ``dataset``: Parquet without it."""
    if format == "json":
        return write_dataset(pairs.select(*schemas.PREFERENCE_PAIR.names), path, "json", mode)
    if format == "dataset":
        return write_dataset(dpo(pairs), path, "parquet", mode)
    raise ValueError(f"unknown format: {format}")


def write_predictions(predictions: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Plain JSON Lines, for tools that want files."""
    return write_dataset(predictions.select("instance_id", "patch"), path, "json", mode, "none")


def write_submission(submission: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Plain JSON Lines, as evaluators take them."""
    return write_dataset(submission.select(*schemas.SUBMISSION.names), path, "json", mode, "none")


def write_patch_diffs(predictions: DataFrame, path: str, mode: str = "append") -> None:
    """One ``patch_<id>.diff`` file per prediction, all in one folder, for tools that want files.

    Files appear when all tasks have succeeded; ``read_patch_files(.., encoded=True)`` reads
    them. ``append`` replaces files of the same ids, ``overwrite`` also removes the others.
    A null id has no file, a null patch an empty one (which Spark's readers pass over). Each id must be there once (with a
    ``pos`` column the last counts), else the write fails and leaves no file. As many files
    as instances, moved by the driver: meant for runs a person looks through.
    """
    spark = predictions.sparkSession
    spark.dataSource.register(PatchFiles)
    rows = unique(predictions).where("instance_id IS NOT NULL").select("instance_id", "patch")
    rows.write.format(FORMAT).mode(mode).option("path", path).save()


def write_patch_files(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One directory per instance with its patch as text, for tools that want files.

    As many files as instances: meant for runs a person looks through.
    """
    rows = predictions.select(F.col("patch").alias("value"), "instance_id")
    rows.write.mode(mode).partitionBy("instance_id").text(path)


def write_instances(
    instances: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None, row_group_bytes: int = 32 << 20
) -> int:
    """Instances as Parquet that lookups and length filters prune; returns the number of rows.

    Rows are dealt by ranges of the id and sorted by it, so an id is in one file and, by the
    row groups' bounds and Bloom filters, in one row group of it. ``n_chars`` has the length
    of the patch, so that :func:`instances.within_patch_length` is a pushed-down comparison
    and patches that are left out are not read.
    """
    rows = instances.select(*schemas.INSTANCE.names).withColumn("n_chars", F.length("patch").cast("long"))
    ranged = rows.repartitionByRange(files, "instance_id") if files else rows.repartitionByRange("instance_id")
    written = Observation()
    ranged = ranged.sortWithinPartitions("instance_id").observe(written, F.count(F.lit(1)).alias("rows"))
    writer = ranged.write.mode(mode).option("parquet.block.size", row_group_bytes)
    writer.option("parquet.bloom.filter.enabled#instance_id", "true").parquet(path)
    return written.get["rows"]


def store(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back from there.

    For tables that are costly to compute and used more than once, such as model
    output: what was written outlives the executors that computed it. Without a
    path it goes to a new folder under the shared one.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/stored/{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_report(
    results: DataFrame, path: str, run_ts: str, config: dict[str, str] | None = None
) -> None:
    """Results, metrics, and their breakdowns under ``path``, each partitioned by run.

    Results are written first and the rest is computed from what was written, so
    the input is evaluated once.
    """

    def part(name: str) -> str:
        return f"{path}/{name}/run_ts={run_ts}"

    stored = store(results.select(*schemas.RESULT.names), part("results"))
    settings = [F.lit(str(text)) for item in (config or {}).items() for text in item]
    config_map = F.create_map(*settings).cast("map<string,string>")
    global_metrics(stored).withColumn("config", config_map).write.json(part("metrics"))
    per_repo(stored).write.json(part("per_repo"))
    error_types(stored).write.json(part("error_types"))


def write_comparison(comparison: DataFrame, path: str, mode: str = "errorifexists") -> None:
    comparison.write.mode(mode).json(path)
