"""Shards that all hold the sources in the same proportions.

Rows are shuffled within their source by a keyed hash and get a fractional rank there:
(rank + shift) / size, with a shift of 0 to 1 that depends on the source, so that small
sources do not all land in the same place. Ordered by it, every stretch of rows holds
each source in proportion; the order is cut into shards whose sizes differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import positions, store

SEED = 42
#: Parts of the two orders that are ranked by themselves.
BUCKETS = 4096


def stratified_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", seed: int = SEED,
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law`` = rows, ``shard``, ``slot``, ``grown_shard``.

    ``size`` is the UTF-8 length of the text plus one; a null text has none. A null
    source is a source of its own, a null id is kept; equal rows are interchangeable;
    other columns are ignored. The law is that shard sizes differ by at most one row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = F.col(source_col).cast("string")
    name = F.md5(F.concat(F.when(source.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(source, F.lit(""))))
    known = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        name.alias("_source"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_mixed"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    known = store(known)
    ties = ["_mixed", "doc_id", "size", "text_crc32"]

    def number(hexadecimal, digits: int):
        return F.conv(F.left(hexadecimal, F.lit(digits)), 16, 10).cast("long")

    ranked = positions(known, ["_source"], number(F.col("_mixed"), 3), ties, "_rank")
    shift = number(F.col("_source"), 8) / F.lit(float(1 << 32))
    ranked = store(ranked.withColumn("_at", (F.col("_rank") + shift) / F.col("_rank_total")))
    bucket = F.floor(F.col("_at") * BUCKETS)
    placed = positions(ranked, [], bucket, ["_at", "_source", *ties], "_place")
    place = F.col("_place")
    shard = F.expr(f"_place * {shards} div _place_total")
    first = F.expr(f"(({shards} - 1) + (_place * {shards} div _place_total) * _place_total) div {shards}")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (place - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
