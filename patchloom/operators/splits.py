"""Seeded train/test splits that do not depend on partitioning or row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SFT_MIN_ROWS = 100
DPO_MIN_ROWS = 50
SEED = 42

# 16^5 hash prefixes: the largest table that is ever ranked in one task, together
# with about a millionth of the distinct rows.
PREFIX_CHARS = 5
COPIES_PER_BLOCK = 100_000


def seeded_hash(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key, F.lit(""))))


def hash_split(
    df: DataFrame, key: str = "instance_id", fraction: float = 0.1, seed: int = SEED
) -> DataFrame:
    """Add ``split``: test for about ``fraction`` of the keys, by a hash threshold.

    Looks at one row at a time; copies of a key fall on the same side.
    """
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction must be from 0 to 1: {fraction}")
    # Nine digits, so that a fraction of 1 is above every hash.
    threshold = f"{int(fraction * 2**32):09x}"
    start = F.concat(F.lit("0"), F.left(seeded_hash(F.col(key), seed), F.lit(8)))
    low = start < threshold
    return df.withColumn("split", F.when(low, F.lit("test")).otherwise(F.lit("train")))


def _item_at(counts: DataFrame, order: str, k: Column) -> DataFrame:
    """Of a small table with the columns ``order`` and ``n``: the row in which the k-th
    item falls, one or none, and how many of its items are within the first k."""
    running = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("n").over(running)
    return (
        counts.withColumns({"_k": k, "_upto": upto})
        .where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("n") < F.col("_k")))
        .withColumn("taken", F.col("_k") - F.col("_upto") + F.col("n"))
    )


def exact_split(
    df: DataFrame,
    key: str | None = None,
    fraction: float = 0.1,
    seed: int = SEED,
    min_rows: int = SFT_MIN_ROWS,
    key_is_unique: bool = False,
) -> DataFrame:
    """Add ``split``: exactly ``ceil(fraction · rows)`` rows are test, the lowest by hash.

    Up to ``min_rows`` rows there is no test side. Rows are ordered by the hash of
    ``key`` (default: a fast one of the whole row), then by that of the whole row. No
    sort of the table is needed to find the boundary: a count per hash prefix names
    the prefix in which it lies, a count per full hash within that prefix the row.
    Exact copies of that row are interchangeable; they are counted, and written out
    again on both sides in the right numbers.

    With ``key_is_unique`` only the key is read to find the boundary and the table
    itself once; if the key repeats after all, the copies of one key may make the
    test side larger. ``df`` is scanned up to four times: store it first if it is
    costly.
    """
    if key_is_unique and not key:
        raise ValueError("key_is_unique needs a key")
    columns = df.columns
    fast_hash = F.lpad(F.hex(F.xxhash64(F.lit(seed), *columns)), 16, "0")
    first_hash = seeded_hash(F.col(key), seed) if key else fast_hash
    prefix = F.left(first_hash, F.lit(PREFIX_CHARS))
    full = first_hash
    if not key_is_unique:
        # JSON shortens timestamps, the fast hash may collide: both tell rows apart.
        full = F.concat(first_hash, fast_hash, seeded_hash(F.to_json(F.struct(*columns)), seed))

    total = F.sum("n").over(Window.partitionBy())
    k = F.when(total > min_rows, F.ceil(total * F.lit(fraction))).otherwise(F.lit(0))
    by_prefix = df.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    edge_prefix = _item_at(by_prefix, "prefix", k).select(F.struct("prefix", "taken")).scalar()

    by_hash = (
        df.withColumn("_at", edge_prefix)
        .where(prefix == F.col("_at.prefix"))
        .groupBy(full.alias("full"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("_at.taken").alias("k"))
    )
    edge = _item_at(by_hash, "full", F.col("k")).select(F.struct("full", "taken")).scalar()

    # NULL at the edge (there is no test side) makes every comparison fall through.
    placed = df.withColumn("_edge", edge)
    edge_hash = F.col("_edge.full")
    if key_is_unique:
        low = F.coalesce(full <= edge_hash, F.lit(False))
        split = F.when(low, F.lit("test")).otherwise(F.lit("train"))
        return placed.select(*columns, split.alias("split"))
    same_prefix = prefix == F.left(edge_hash, F.lit(PREFIX_CHARS))
    place = (
        F.when(prefix < F.left(edge_hash, F.lit(PREFIX_CHARS)), F.lit("test"))
        .when(same_prefix & (full < edge_hash), F.lit("test"))
        .when(same_prefix & (full == edge_hash), F.lit("edge"))
        .otherwise(F.lit("train"))
    )
    placed = placed.withColumn("split", place)
    apart = placed.where(F.col("split") != "edge").select(*columns, "split")

    taken = F.max("_edge.taken").alias("_taken")
    copies = (
        placed.where(F.col("split") == "edge")
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("_n"), taken)
    )
    sides = F.array(
        F.struct(F.lit("test").alias("split"), F.col("_taken").alias("rows")),
        F.struct(F.lit("train").alias("split"), (F.col("_n") - F.col("_taken")).alias("rows")),
    )
    edge_rows = _repeat(copies.withColumn("_side", F.explode(sides)), F.col("_side.rows"))
    return apart.unionByName(edge_rows.select(*columns, F.col("_side.split").alias("split")))


def _repeat(df: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times, in blocks that are spread over the tasks first.

    The number of tasks is given, since few rows become many only after the shuffle.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(times / F.lit(COPIES_PER_BLOCK)).cast("int")
    in_block = F.least(times - F.col("_block") * COPIES_PER_BLOCK, F.lit(COPIES_PER_BLOCK))
    return (
        df.where(times > 0)
        .withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .repartition(tasks, "_block")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), in_block.cast("int"))))
        .drop("_block", "_copy")
    )
