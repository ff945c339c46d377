"""From raw documents to packed training sequences, one operator a stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import line_dedup, ngram_join, packing, quality, secret_scan
from patchloom.llm.common import store
from patchloom.llm.queries import VOCABULARY

#: Quality and packing depend on a model and on tokens: there is no SQL for the rows.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(df: DataFrame, text) -> DataFrame:
    return df.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the model keep."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model, only_kept=True).select(*COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stay in another one."""
    found = line_dedup.dedup_lines(docs)
    return _with_text(found, F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")))


def _row() -> Column:
    return F.min(F.struct("lang", "source", "n_chars")).alias("row")


def _numbered(docs: DataFrame) -> DataFrame:
    """Add ``key``: the id, or for rows without one a number above all ids for each text."""
    docs = docs.select(*COLUMNS, F.col("doc_id").cast("long").alias("key"))
    lone = docs.where("doc_id is null")
    if lone.isEmpty():
        return docs
    top = docs.agg(F.coalesce(F.max("key"), F.lit(0))).first()[0]
    texts = lone.groupBy("doc_id", "text").agg(_row()).select("doc_id", "text", "row.*").select(*COLUMNS)
    # Stored, so that the numbers stay.
    texts = store(texts.withColumn("key", F.monotonically_increasing_id() + F.lit(top) + 1))
    return docs.where("doc_id is not null").unionByName(texts)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id.

    Rows that share an id are one document: of equal rows, also with another language or
    source, one stays (the least), and each of its different texts. Rows without an id
    are a document for each different text, after all that have one.
    """
    rows = _numbered(docs)
    found = ngram_join.similar_documents(rows, size=5, num=8, den=10, id_col="key")
    others = found.where("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct()
    kept = rows.join(others, "key", "left_anti").groupBy("key", "doc_id", "text").agg(_row())
    return kept.select("doc_id", "text", "row.*").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret replaced by a mark."""
    found = secret_scan.find_secrets(docs)
    return _with_text(found, secret_scan.redacted(F.col("text"), F.col("secrets")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard_join", near_copies),
    ("secret_scans", secrets),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
