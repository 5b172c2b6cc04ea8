"""Cutting series into blocks, so that a series of any length is worked on by many tasks.

A series is a set of rows (keys..., t, x) with positions t = 1, 2, 3, ... without holes. A block
is a run of ``length`` positions. An operator that looks ``before`` rows back and ``after`` rows
ahead gets copies of the neighbouring rows (the halo) in its block, works inside
(keys, block), and drops the copies afterwards. Every block has at most
``length + before + after`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 16384

# A recursion whose influence shrinks by 0.99 per step or faster has forgotten its start after
# this many steps (0.99 ** 4200 is below 1e-18, under the resolution of a double).
WARM_UP = 4200


def with_halo(
    df: DataFrame, before: int = 0, after: int = 0, length: int = BLOCK, t: str = "t"
) -> DataFrame:
    """Adds ``_block`` and ``_own``; a row appears in every block that has to see it."""
    if before >= length or after >= length:
        raise ValueError("the reach of an operator must be shorter than a block")
    pos = F.col(t).cast("bigint") - 1
    own = F.floor(pos / length)
    first = F.greatest(F.floor((pos - after) / length), F.lit(0))
    last = F.floor((pos + before) / length)
    return df.withColumns(
        {"_home": own, "_block": F.explode(F.sequence(first, last))}
    ).withColumn("_own", F.col("_home") == F.col("_block")).drop("_home")


def block_window(keys: Sequence[str], t: str = "t") -> WindowSpec:
    return Window.partitionBy(*keys, "_block").orderBy(t)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_block")


#: Blocks whose lists are added up in one step.
TOGETHER = 64


def added_lists(
    df: DataFrame, keys: Sequence[str], sums: Sequence[str], last: Sequence[str], counts: Sequence[str]
) -> DataFrame:
    """(keys, sums, last, counts): one row per series from one per (keys, block).

    Lists in ``sums`` are added element by element, those in ``last`` are taken from the last
    block, numbers in ``counts`` are added. One row per block is shuffled, however long the lists;
    blocks are added in groups first, so no row has to hold more than a few thousand lists.
    """
    names = [*sums, *last, *counts]

    def combined(group: Sequence[str], rows: DataFrame) -> DataFrame:
        together = F.sort_array(F.collect_list(F.struct("_block", *names)))
        packed = rows.groupBy(*group).agg(together.alias("_all"))
        first, rest = F.get("_all", F.lit(0)), F.slice("_all", F.lit(2), F.size("_all"))

        def add(a: Column, b: Column) -> Column:
            fields = {c: F.zip_with(a[c], b[c], lambda x, y: x + y) for c in sums}
            fields |= {c: b[c] for c in last} | {c: a[c] + b[c] for c in counts}
            return F.struct(b["_block"].alias("_block"), *(fields[c].alias(c) for c in names))

        whole = F.when(F.size("_all") == 1, first).otherwise(F.aggregate(rest, first, add))
        return packed.select(*keys, whole.alias("_w")).select(*keys, "_w.*")

    some = df.select(*keys, "_block", *names).withColumn("_some", F.floor(F.col("_block") / TOGETHER))
    return combined(keys, combined([*keys, "_some"], some)).drop("_block")


def block_arrays(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], warm_up: int, length: int = BLOCK
) -> DataFrame:
    """One row per (keys, block): the ordered values with ``warm_up`` rows in front.

    ``own_from`` is the number of warm-up rows; ``_block`` 0 has none.
    """
    rows = with_halo(df, before=warm_up, length=length)
    packed = rows.groupBy(*keys, "_block").agg(
        F.sort_array(F.collect_list(F.struct("t", *cols))).alias("_rows"),
        F.sum(F.when(F.col("_own"), 0).otherwise(1)).cast("int").alias("own_from"),
        F.max(F.when(F.col("_own"), F.col("t"))).alias("last_t"),
    )
    return packed.where(F.col("last_t").isNotNull()).select(
        *keys,
        "_block",
        "own_from",
        "last_t",
        F.col("_rows.t").alias("t"),
        *(F.col(f"_rows.{c}").alias(c) for c in cols),
    )
