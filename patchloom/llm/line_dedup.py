"""Repeated lines, found through levelled sorted runs of line hashes. Column expressions only.

Documents come in batches. A batch's long lines are hashed to 128 bits, counted and written
as a run: a table bucketed and sorted by hash. Once a level holds ``FANOUT`` runs they are
merged, bucket by bucket and without a shuffle, into one run of the next level. A new batch
reads as many runs as there are levels, and a hash is rewritten once per level. When all
batches are in, the hashes of all lines are read again and joined with those that occur
often enough: those lines go, except in the document that keeps them. No batch is joined
with the runs before, as counts are over all batches.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.common import BLANKS, ascii_lower, shared_folder, store

LEAST_LENGTH = 40
LEAST_DOCUMENTS = 5
BATCHES = 4
FANOUT = 2
_HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _long_hashes(text: Column, least_length: int) -> Column:
    """Distinct hashes of a text's long lines."""
    long_ = F.filter(_lines(text), lambda line: F.length(line) >= least_length)
    keys = F.filter(F.transform(long_, line_key), lambda key: F.length(key) >= least_length)
    return F.array_distinct(F.transform(keys, _hashed))


class LineRuns:
    """Runs of (h1, h2, documents, keeper), ``keeper`` being the largest id of a hash."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []
        self.database = f"runs_{uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        folder = f"{shared_folder(spark)}/{self.database}"
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{folder}'")

    def _write(self, run: DataFrame) -> str:
        name = f"{self.database}.run_{uuid4().hex}"
        run.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).format("parquet").saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).toDF("m1", "m2", "more", "later")
            both = out.join(more, (F.col("h1") == F.col("m1")) & (F.col("h2") == F.col("m2")), "full")
            out = both.select(
                F.coalesce("h1", "m1").alias("h1"),
                F.coalesce("h2", "m2").alias("h2"),
                (F.coalesce("documents", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("documents"),
                F.greatest("keeper", "later").alias("keeper"),
            )
        return out

    def add(self, hashes: DataFrame) -> None:
        """Add a batch of (doc_id, h1, h2), a row for each document and hash."""
        run = hashes.groupBy(*_HASH).agg(
            F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("keeper")
        )
        new, level = self._write(run), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            new = self._write(self._merged(full))
            for name in full:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def frequent(self, least_documents: int) -> DataFrame:
        names = [name for level in self.levels for name in level]
        return self._merged(names).where(F.col("documents") >= least_documents)

    def close(self) -> None:
        self.spark.sql(f"DROP DATABASE {self.database} CASCADE")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES,
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text`` added.

    A line's key is the line, stripped and with A-Z in lower case. Keys of at least
    ``least_length`` code points in at least ``least_documents`` rows lose their lines
    everywhere but in the rows with the largest id among them. A null or empty text is
    one empty line. A null id counts as smaller than any other; rows that share an id
    are counted each and treated alike. Columns of the added names are replaced, all others
    stay whatever they are called.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    hashes = keyed.select("doc_id", F.explode(_long_hashes(F.col("_text"), least_length)).alias("h")).select("doc_id", "h.*")
    # Batches of about the same size, whatever the ids.
    batch = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(batches))
    runs = LineRuns(spark)
    try:
        for b in range(batches):
            own = keyed.where(batch == b).select("doc_id", F.explode(_long_hashes(F.col("_text"), least_length)).alias("h"))
            runs.add(own.select("doc_id", "h.*"))
        frequent = store(runs.frequent(least_documents).select(*_HASH, "keeper"))
    finally:
        runs.close()

    hits = hashes.join(frequent, _HASH)
    hits = hits.where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = hits.groupBy("doc_id").agg(F.collect_set(F.struct(*_HASH)).alias("_gone"))
    # The row as a whole, so that no column of it can be taken for one of these.
    added = {"n_lines", "n_dropped", "kept_text"}
    given = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in added)).alias("_row")
    whole = docs.select(given, F.col(id_col).cast("long").alias("_id"), *([F.col(text_col).alias("_text")] if text_col in added else []))
    joined = whole.join(gone, F.col("_id").eqNullSafe(F.col("doc_id")), "left")
    # Split after the join: rows are moved with their text once.
    text = F.col("_text") if text_col in added else F.col("_row").getField(text_col)
    joined = joined.withColumn("_lines", _lines(text))
    stays = F.filter(
        "_lines",
        lambda line: (F.length(line) < least_length) | ~F.array_contains("_gone", _hashed(line_key(line))),
    )
    joined = joined.withColumn("_stays", F.when(F.col("_gone").isNotNull(), stays).otherwise(F.col("_lines")))
    return joined.select(
        "_row.*",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_stays")).cast("long").alias("n_dropped"),
        F.array_join("_stays", "\n").alias("kept_text"),
    )
