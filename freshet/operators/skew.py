"""Joins and rankings that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.session import cut, shuffle_width

# At most this many groups can each hold more than 1/HOT_GROUPS of the rows, so a list of the
# HOT_GROUPS largest groups is a broadcast of proven size and leaves no larger group unsalted.
HOT_GROUPS = 1000
HOT_ROWS = 10_000  # a smaller group does no harm in one task
MAX_SALTS = 512


def salted_join(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    size_col: str,
    spread: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Equi-join `rows` to `groups` (one row per key, `size_col` = rows in the group).

    The largest groups are spread over many partitions by a hash of `spread`, and their single
    `groups` row is replicated once per salt. Every other group uses salt 0.
    """
    keys = list(keys)
    salts = min(shuffle_width(rows.sparkSession), MAX_SALTS)
    hot = F.broadcast(
        groups.filter(F.col(size_col) >= HOT_ROWS).orderBy(F.desc(size_col), *keys).limit(HOT_GROUPS).select(*keys, F.lit(True).alias("_hot"))
    )
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    all_salts = F.array(*[F.lit(i) for i in range(salts)])
    left = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    right = (
        groups.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), all_salts).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str) -> DataFrame:
    """0-based position of every row in a total order, without a single-task window.

    Range-partition and sort, number rows inside each partition, then add the row counts of the
    partitions before it. `order` must end in a unique column.
    """
    spark = df.sparkSession
    numbered = cut(
        df.repartitionByRange(shuffle_width(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    counts = {r["_part"]: r["n"] for r in numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()}
    offsets, before = [], 0
    for index in sorted(counts):  # one entry per shuffle partition
        offsets.append((index, before))
        before += counts[index]
    offset_df = F.broadcast(spark.createDataFrame(offsets, "_part long, _before long"))
    return (
        numbered.withColumn("_part", part)
        .join(offset_df, "_part")
        .withColumn(rank_col, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_before", "_at")
    )


def grouped_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank_col: str, spread: Sequence[str]) -> DataFrame:
    """1-based position inside each group; a group may be larger than one task can sort."""
    keys = list(keys)
    ranked = global_rank(df, [*[F.col(k) for k in keys], *order], "_rank")
    starts = ranked.groupBy(*keys).agg(F.min("_rank").alias("_start"), F.count("*").alias("_size"))
    return (
        salted_join(ranked, starts, keys, "_size", spread)
        .withColumn(rank_col, F.col("_rank") - F.col("_start") + 1)
        .drop("_rank", "_start", "_size")
    )
