"""Places of rows within their keys, where a key may hold any share of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.operators.joins import HOT_ROWS, hot_keys

#: A hot key's rows are sorted in 16^3 parts.
BUCKET_CHARS = 3


def ranked(
    rows: DataFrame, keys: list[str], order: Column, name: str,
    hot_rows: int = HOT_ROWS, extra: DataFrame | None = None,
) -> DataFrame:
    """Add ``name``, the 0-based place of each row within its keys by the hexadecimal text
    ``order``, and ``name_total``, the keys' number of rows.

    Keys with over ``hot_rows`` rows are sorted in parts, by the first characters of
    ``order``: a part's places begin after the rows of the parts before it, which are
    counted. ``order`` should be evenly spread (a digest) and tell rows of a key apart;
    rows that it does not are placed at will. Rows with a null key are left out. ``extra`` has
    columns to add by the first of ``keys`` (inner join); they take the way of the counts, so
    no key's rows meet in one task for them.
    """
    rows = rows.dropna(subset=keys)
    hot = F.broadcast(hot_keys(rows, keys, hot_rows))  # under 100 000 keys, see there
    cut = F.when(F.col("_salts").isNotNull(), F.left(F.col("_order"), F.lit(BUCKET_CHARS))).otherwise("")
    placed = rows.withColumn("_order", order).join(hot, keys, "left").withColumn("_bucket", cut).drop("_salts")
    by_key = Window.partitionBy(*keys)
    counts = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(by_key.orderBy("_bucket")) - F.col("_n")
    counts = counts.select(*keys, "_bucket", before.alias("_before"), F.sum("_n").over(by_key).alias(f"{name}_total"))
    if extra is not None:
        counts = counts.join(extra, keys[:1])
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_order"))
    joined = placed.join(counts, [*keys, "_bucket"])
    return joined.withColumn(name, F.col("_before") + inside - 1).drop("_order", "_bucket", "_before")
