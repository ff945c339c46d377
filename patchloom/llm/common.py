"""Helpers the operators share: stored tables, ASCII case, exact positions without a global sort."""

from __future__ import annotations

import string
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the characters [\x20\x09-\x0D] that the contracts call white space.
BLANKS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one only for a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return "file:///tmp/checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new folder under the shared one and read it back.

    Cuts the lineage: a lost executor costs the tasks that read the files again, not
    the steps before. The folder is the caller's to remove when the result is written.
    """
    path = f"{shared_folder(df.sparkSession)}/stored/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the per-character way is taken for non-ASCII text alone."""
    plain = F.length(text) == F.octet_length(text)
    by_char = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(plain, F.lower(text)).otherwise(by_char)


def positions(
    df: DataFrame, group: list[str], bucket: Column, order: list[Column | str], name: str
) -> DataFrame:
    """Add ``name``, the 0-based place of each row within its group, and ``name_total``.

    ``bucket`` is an integer that never falls as ``order`` rises. Only rows of one group
    and bucket are sorted together; what came before is the running sum of bucket
    counts, so choose buckets fine enough for the largest group. ``df`` is evaluated
    twice and must give the same rows both times.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.sum("_n").over(by_group.orderBy("_bucket")) - F.col("_n")
    counts = counts.withColumns({"_before": before, f"{name}_total": F.sum("_n").over(by_group)})
    counts = counts.drop("_n")
    for key in [*group, "_bucket"]:
        counts = counts.withColumnRenamed(key, f"_c_{key}")
    same = F.lit(True)
    for key in [*group, "_bucket"]:
        same = same & F.col(key).eqNullSafe(F.col(f"_c_{key}"))
    joined = rows.join(counts, same)
    inside = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)) - 1
    placed = joined.withColumn(name, F.col("_before") + inside)
    return placed.drop("_bucket", "_before", *(f"_c_{key}" for key in [*group, "_bucket"]))
