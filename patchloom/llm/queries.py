"""The registered queries: each operator over its whole table, and the pipeline."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import (
    chat,
    conversation_repair,
    hard_negatives,
    line_dedup,
    near_dedup,
    ngram_join,
    packing,
    quality,
    secret_scan,
    sharding,
    token_output,
    toxicity,
)
from patchloom.llm.bpe import bpe

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("secrets")).alias("spans"),
    )


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records in training order, as the shards hold them."""
    return token_output.training_order(_table(spark, sf_dir, "documents"), VOCABULARY)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(_table(spark, sf_dir, "documents"), 8)


#: What the tools of :func:`op5_chat_formatting` accept.
TOOLS = {
    "ask": {
        "properties": {
            "text": {"type": "string"},
            "turn": {"type": "integer"},
            "after": {"type": "array"},
        },
        "required": ["text", "turn"],
        "additionalProperties": False,
    },
    "set_up": {"properties": {"text": {"type": "string"}}, "required": ["text", "turn"]},
}


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tool calls: a user or system turn asks, the assistant turn right
    after it answers. A user turn comes after the system turn at the start, if any."""
    turns = _table(spark, sf_dir, "conversations")

    def call_id(turn):
        return F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))

    asks = F.col("role").isin("user", "system")
    after = F.when((F.col("role") == "user") & (F.col("turn") > 0), F.array(call_id(F.lit(0))))
    fields = F.struct("text", F.col("turn").cast("long").alias("turn"), after.alias("after"))
    calls = turns.where(asks).select(
        "conv_id",
        call_id(F.col("turn")).alias("call_id"),
        F.col("turn").cast("long").alias("seq"),
        F.when(F.col("role") == "user", "ask").otherwise("set_up").alias("name"),
        F.to_json(fields).alias("arguments"),
    )
    results = turns.where(F.col("role") == "assistant").select(
        "conv_id",
        call_id(F.col("turn") - 1).alias("call_id"),
        F.col("turn").cast("long").alias("seq"),
        F.col("text").alias("content"),
    )
    return chat.link_calls(calls, results, TOOLS, with_repeated=True)


def _token_digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for ids in encoder.encode(batch.column(1).to_pylist()):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.record_batch(columns, names)

    return run


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(_token_digests(VOCABULARY), schema)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), VOCABULARY)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = F.sha2("kept_text", 256).alias("kept_sha256")
    return found.select("doc_id", "n_lines", "n_dropped", sha)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs, model, with_text=False)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as an anchor; the labels of every seventh are shifted by one."""
    rows = hard_negatives.participants(_table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", label)
    return hard_negatives.mine(rows, rows.where(F.col("vec_id") % 100 == 0))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults, by a checksum of conversation and turn: dropped, emptied, without
    sentence ends, repeated, or with the role user. Nulls are one space in texts and names."""
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", space))
    times = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    rows = turns.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy"))
    return rows.drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    repair = conversation_repair.repair(damaged(turns))
    ids = turns.select("conv_id", conversation_repair.conversation(F.col("conv_id")).alias("conv")).distinct()
    found = ids.join(repair.conversations, "conv", "left").join(conversation_repair.digests(repair.turns), "conv", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(
        "conv_id",
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_secret_scans,
        op3_token_output,
        op4_sharding,
        op5_chat_formatting,
        op6_bpe,
        op7_embedding_near_dedup,
        op8_best_fit_packing,
        op9_line_dedup,
        op10_quality_rules,
        op11_hard_negatives,
        op12_conversation_repair,
        op13_toxicity,
        pipeline,
    )
}
