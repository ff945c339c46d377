"""Joins of a large table with a one-row-per-key lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 100_000
MAX_HOT_KEYS = 100_000
NULL_SALTS = 4_096


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Catalyst's size estimate is under the session's broadcast limit.

    The estimate is the one the planner itself goes by, so a yes means that it is
    going to broadcast ``df`` and that no shuffle, hence no hot partition, arises.
    """
    if not hasattr(df, "_jdf"):  # a Connect session has no local plan to ask
        return False
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= int(limit)


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, and a number of salts for each.

    Small enough to broadcast whatever the size of ``df``: a key must also hold more
    than 1/``MAX_HOT_KEYS`` of all rows, so there are fewer than ``MAX_HOT_KEYS``. The
    rule looks at counts alone and names the same keys each time. Counting reads the
    key columns only and is combined before the shuffle.
    """
    share = df.agg(F.count(F.lit(1)) / MAX_HOT_KEYS).scalar()
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") > hot_rows) & (F.col("_n") > share))
        .select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    )


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    *,
    fact_is_unique: bool = False,
) -> DataFrame:
    """:func:`lookup_joins` with one lookup."""
    return lookup_joins(fact, [(lookup, how)], on, hot_rows, fact_is_unique=fact_is_unique)


def lookup_joins(
    fact: DataFrame,
    lookups: list[tuple[DataFrame, str]],
    on: str | list[str],
    hot_rows: int = HOT_ROWS,
    *,
    fact_is_unique: bool = False,
) -> DataFrame:
    """Join ``fact`` with lookups, each of which has at most one row per key.

    ``lookups`` are pairs of a table and inner, left, left_semi or left_anti. All
    joins use the same shuffle of ``fact``. A key with more than ``hot_rows`` rows of
    ``fact`` is spread over several tasks: its rows get a salt and its single lookup
    row is repeated once per salt. Together these repeats are at most two for every
    ``hot_rows`` rows of ``fact``. The salt comes from the number of the task that read
    the row and from the row itself: that splits copies that several tasks read and
    different rows that one task read, and a task that is run again gives its rows the
    same salt. Rows with a NULL key match nothing and are spread at random. Other keys
    are shuffled as they are, and no row is left out. With ``fact_is_unique`` no key of
    ``fact`` repeats, so nothing is counted and the joins are plain ones.
    ``fact`` is scanned once more for the counts, so store it first if it is costly
    (model output).
    """
    keys = [on] if isinstance(on, str) else list(on)
    small = [fits_broadcast(lookup) for lookup, _ in lookups]
    if all(small) or fact_is_unique:
        for lookup, how in lookups:
            fact = fact.join(lookup, keys, how)
        return fact
    hot = F.broadcast(hot_keys(fact, keys, hot_rows))
    plain = [f.name for f in fact.schema if "map<" not in f.dataType.simpleString()]
    spread = F.spark_partition_id() + F.xxhash64(*(fact[c] for c in plain))
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    salt = (
        F.when(F.col("_salts").isNotNull(), F.pmod(spread, F.col("_salts")).cast("int"))
        .when(no_key, F.pmod(spread, F.lit(NULL_SALTS)).cast("int"))
        .otherwise(F.lit(0))
    )
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    joined = fact.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    for (lookup, how), is_small in zip(lookups, small):
        if is_small:
            joined = joined.join(lookup, keys, how)
        else:
            repeated = lookup.join(hot, keys, "left").withColumn("_salt", copies)
            joined = joined.join(repeated.drop("_salts"), [*keys, "_salt"], how)
    return joined.drop("_salt")
