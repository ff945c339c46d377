"""Readers. All take explicit schemas; malformed records fail the read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from patchloom import schemas
from patchloom.operators.instances import first, normalize, require_columns
from patchloom.sources.json_ranges import read_records

DATASETS = ("pro", "lite")


def _json(spark: SparkSession, path: str, schema: StructType, array: bool) -> DataFrame:
    """JSON Lines, or with ``array`` files that hold one JSON array each."""
    if array:
        return read_records(spark, path, schema).drop("pos")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _position() -> Column:
    """Where a row stands in its input: file, offset of the file's block, row in it.

    Rows of a block are read in order by one task, so the running id orders them.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_instances(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    dataset: str | None = None,
    array: bool = False,
) -> DataFrame:
    """Instances with defaults filled in; ``dataset`` (pro or lite) adds a label column."""
    if dataset is not None and dataset not in DATASETS:
        raise ValueError(f"unknown dataset {dataset!r}, expected one of {DATASETS}")
    if format == "parquet":
        raw = spark.read.schema(schemas.INSTANCE).parquet(path)
    elif format == "json":
        raw = _json(spark, path, schemas.INSTANCE, array)
    else:
        raise ValueError(f"unknown format: {format}")
    instances = normalize(raw)
    return instances if dataset is None else instances.withColumn("dataset", F.lit(dataset))


def read_stored_instances(spark: SparkSession, path: str) -> DataFrame:
    """Instances as :func:`writers.write_instances` left them, with ``n_chars``."""
    return spark.read.schema(StructType([*schemas.INSTANCE, StructField("n_chars", LongType())])).parquet(path)


def read_eval_instances(
    spark: SparkSession, path: str, format: str = "parquet", max_instances: int | None = None
) -> DataFrame:
    """The columns evaluation needs; optionally the first instances by id."""
    instances = read_instances(spark, path, format).select(*schemas.EVAL_COLUMNS)
    return first(instances, max_instances) if max_instances else instances


def _predictions(records: DataFrame, pos: Column) -> DataFrame:
    return records.select(
        "instance_id",
        F.coalesce("patch", "model_patch").alias("patch"),
        F.col("model_name_or_path").alias("model"),
        "error",
        pos.alias("pos"),
    )


def read_prediction_array(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from JSON arrays of records (``patch`` or ``model_patch``).

    Like the other prediction readers this keeps all rows, with their position as
    ``pos``; ``predictions.keep_last`` makes the last one of an id win.
    """
    return _predictions(read_records(spark, path, schemas.PREDICTION_RECORD), F.col("pos"))


def read_prediction_lines(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from JSON Lines of records (``patch`` or ``model_patch``)."""
    return _predictions(_json(spark, path, schemas.PREDICTION_RECORD, array=False), _position())


def read_prediction_object(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from one JSON object ``{id: patch, ..}`` per file.

    JSON strings hold no raw line breaks, so an indented object has whole entries on
    each line and is read line by line, in as many tasks as it has blocks; an object
    on a single line is one row. Entries never become columns.
    """
    lines = spark.read.text(path).select("value", _position().alias("line"))
    entries = F.regexp_replace(F.regexp_replace("value", r"^[\s{]+", ""), r"[\s,}]+$", "")
    return (
        lines.withColumn("entries", entries)
        .where(F.col("entries") != "")
        .withColumn(
            "parsed",
            F.from_json(
                F.concat(F.lit("{"), "entries", F.lit("}")),
                "map<string,string>",
                {"mode": "FAILFAST"},
            ),
        )
        .select("line", F.posexplode(F.map_entries("parsed")).alias("at", "entry"))
        .select(
            F.col("entry.key").alias("instance_id"),
            F.col("entry.value").alias("patch"),
            F.struct("line", "at").alias("pos"),
        )
    )


def read_results(spark: SparkSession, path: str, last_wins: bool = False) -> DataFrame:
    """Results out of result bundles, defaults filled in; a bundle without any has none.

    With ``last_wins`` an id that occurs several times has its last result only, by file
    name and place in the bundle. A large bundle is read by many tasks.
    """
    found = read_records(spark, path, schemas.RESULT, key="results", elements=True)
    if not last_wins:
        return found.drop("pos").na.fill(schemas.RESULT_DEFAULTS)
    last = F.max_by(F.struct(*schemas.RESULT.names), "pos").alias("last")
    return found.groupBy("instance_id").agg(last).select("last.*").na.fill(schemas.RESULT_DEFAULTS)


def read_bundle_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics part of result bundles, one row each; nulls where a bundle has none."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("_metadata.file_path").alias("file"))
    found = read_records(spark, path, schemas.METRICS, key="metrics")
    found = found.withColumn("file", F.col("pos.file")).drop("pos")
    return files.join(found, "file", "left").drop("file")


def _by_extension(spark: SparkSession, path: str, schema: StructType, array: bool) -> DataFrame:
    if path.endswith((".json", ".jsonl")):
        return _json(spark, path, schema, array)
    if path.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"unknown file format: {path}")


def read_preference_pairs(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Pairs from ``.json`` (lines, or with ``array`` an array) or ``.parquet``."""
    return _by_extension(spark, path, schemas.PREFERENCE_PAIR, array)


def read_training_pairs(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Pairs for training: the columns prompt, chosen and rejected must be in the data.

    Parquet files are asked for their columns. JSON is read once for them: a column
    that no record has a value for is missing.
    """
    required = ["prompt", "chosen", "rejected"]
    if path.endswith(".parquet"):
        return require_columns(spark.read.parquet(path), required)
    pairs = read_preference_pairs(spark, path, array)
    counts = [F.count(n).alias(n) for n in required]
    seen = pairs.agg(F.count(F.lit(1)).alias("rows"), *counts).first()
    if seen["rows"]:
        require_columns(pairs.select(*[n for n in required if seen[n]]), required)
    return pairs


def read_sft_examples(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Training examples from ``.json``, else Parquet."""
    if path.endswith((".json", ".jsonl")):
        return _json(spark, path, schemas.SFT_EXAMPLE, array)
    return spark.read.schema(schemas.SFT_EXAMPLE).parquet(path)


def read_patch_files(spark: SparkSession, path: str, encoded: bool = False) -> DataFrame:
    """(instance_id, patch) from a directory of ``patch_<id>.diff`` files.

    ``encoded``: names have the percent-encoding that :func:`writers.write_patch_diffs` gives.
    Spark's file readers pass over empty files.
    """

    def decoded(name: Column) -> Column:
        # Plus signs are themselves here.
        return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))

    # Spark gives names percent-encoded.
    instance_id = F.regexp_extract(decoded(F.col("_metadata.file_name")), r"(?s)^(?:patch_)?(.*)\.diff$", 1)
    return spark.read.text(path, wholetext=True).select(
        (decoded(instance_id) if encoded else instance_id).alias("instance_id"), F.col("value").alias("patch")
    )


def read_patch_partitions(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, patch) from the layout that ``write_patch_files`` leaves behind."""
    text = spark.read.schema("value string, instance_id string").text(path, wholetext=True)
    return text.select("instance_id", F.regexp_replace("value", r"\n\z", "").alias("patch"))
