"""Splits, exact samples, shuffles and positions that need no single task per group.

A *position* is the exact rank of a row in its group. Rows are first put into order-preserving
buckets; each bucket is ranked on its own and shifted by the number of rows in the buckets
before it. A group of any size is thus spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.sources.scratch import materialize

HASH_DIGITS = 4  # 65,536 hash buckets


def row_hash(*keys: str, seed: int = 0) -> Column:
    """Hex digest of the key columns and the seed; the same in every run and engine."""
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))))


def unit_hash(*keys: str, seed: int = 0) -> Column:
    """The first eight digits of the hash as a number in [0, 1)."""
    head = F.conv(F.substring(row_hash(*keys, seed=seed), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)


def split_part(weights: Sequence[float], keys: Sequence[str], seed: int = 0) -> Column:
    """Number of the part a row falls into, by key hash; weights are normalised."""
    total = float(sum(weights))
    u = unit_hash(*keys, seed=seed)
    part = F.lit(len(weights) - 1)
    for i in range(len(weights) - 2, -1, -1):
        part = F.when(u < sum(weights[: i + 1]) / total, i).otherwise(part)
    return part


def hash_split(
    df: DataFrame, weights: Sequence[float], keys: Sequence[str], seed: int = 0
) -> list[DataFrame]:
    """Random split by key hash.

    A row lands in the same part however often, and on whatever partitions, the input is
    evaluated again, so train and test cannot overlap after a lost executor.
    """
    part = split_part(weights, keys, seed)
    return [df.where(part == i) for i in range(len(weights))]


def random_split(df: DataFrame, weights: Sequence[float], seed: int) -> list[DataFrame]:
    """Row-wise random split; repeatable only while the input partitions are."""
    return df.randomSplit(list(weights), seed)


def bucket_offsets(rows: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """Rows per (key, bucket) and the number of rows of the key in earlier buckets."""
    counts = rows.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("bucket_n"))
    w = Window.partitionBy(*keys).orderBy(bucket)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("bucket_n").over(before), F.lit(0)))


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column | None = None,
    name: str = "position",
) -> DataFrame:
    """Exact 1-based rank per key.

    ``bucket`` must rise with ``order``. Rows are shuffled once, on (keys, bucket), and the
    offsets are joined on the same columns. Without a bucket the rows are range-partitioned by
    (keys, order), which cuts a key of any size into ranges of equal size; they are written once,
    so that counting and ranking see the same ranges.
    """
    if bucket is None:
        ranged = df.repartitionByRange(*(F.col(k) for k in keys), *order)
        rows = materialize(ranged.withColumn("_bucket", F.spark_partition_id()), "ranges")
    else:
        rows = df.withColumn("_bucket", bucket)
    offsets = bucket_offsets(rows, keys, "_bucket")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("before") + F.col("_rank"))
        .drop("_bucket", "_rank", "before", "bucket_n")
    )


def shuffled(df: DataFrame, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """All rows in random order; ``shuffle_pos`` is the place of each row."""
    rows = df.withColumn("_hash", row_hash(*keys, seed=seed))
    placed = with_position(
        rows,
        [],
        [F.col("_hash"), *(F.col(k) for k in keys)],
        F.substring("_hash", 1, HASH_DIGITS),
        "shuffle_pos",
    )
    return placed.drop("_hash")


def exact_sample(
    df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 0
) -> DataFrame:
    """Adds ``in_sample``: true for exactly floor(fraction * n) rows, drawn by hash order.

    ``keys`` identify a row. The rows are counted per hash bucket (at most 16 ** HASH_DIGITS of
    them); in the one bucket where the quota runs out the rows are ranked to find the last row
    drawn. Every row is then decided by comparing its hash with that of the last row: the rows
    themselves are not shuffled.
    """
    rows = df.withColumn("_hash", row_hash(*keys, seed=seed)).withColumn(
        "_bucket", F.substring("_hash", 1, HASH_DIGITS)
    )
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("bucket_n"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    quota = F.floor(F.lit(fraction) * F.sum("bucket_n").over(Window.partitionBy()))
    room = quota - F.sum("bucket_n").over(upto) + F.col("bucket_n")
    cut = (
        counts.withColumn("room", room)
        .where((F.col("room") > 0) & (F.col("room") <= F.col("bucket_n")))
        .select(F.struct("_bucket", "room"))
        .scalar()
    )
    place = F.struct("_hash", *keys)
    inside = Window.partitionBy("_bucket").orderBy("_hash", *keys)
    last = (
        rows.where(F.col("_bucket") == cut["_bucket"])
        .withColumn("_rank", F.row_number().over(inside))
        .where(F.col("_rank") == cut["room"])
        .select(place)
        .scalar()
    )
    # No last row: the quota is 0.
    drawn = F.coalesce(place <= last, F.lit(False))
    return rows.withColumn("in_sample", drawn).drop("_hash", "_bucket")
