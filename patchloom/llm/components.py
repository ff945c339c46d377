"""Connected components by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import store


def _state(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("u", "v")
    row = edges.agg(F.count(F.lit(1)), F.sum(hashed.cast("decimal(38,0)")), F.bit_xor(hashed))
    return tuple(row.first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    higher = both.where(F.col("v") > F.col("u")).join(least, "u")
    return higher.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").where(F.col("v") != F.col("m"))
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node it is linked with over any path.

    Holds nodes that have a link to another one. ``links`` may repeat and point either
    way. Every round is two joins on keys; nothing but a checksum reaches the driver.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = store(edges.where(F.col("u") != F.col("v")).distinct())
    before = None
    while (now := _state(edges)) != before:
        edges, before = store(_small_star(_large_star(edges))), now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(roots)
