"""Exact quantiles without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmark.sources.scratch import materialize

ACCURACY = 10000


def _clip(p: float) -> float:
    return min(1.0, max(0.0, p))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    probs: Sequence[float],
    names: Sequence[str],
    accuracy: int = ACCURACY,
    margin: float | None = None,
) -> DataFrame:
    """(keys, n, names...): quantiles with linear interpolation between neighbours.

    1. A mergeable sketch per group gives two fences around each quantile.
    2. One more pass counts the rows: per value between the two fences of a quantile, and in one
       lump per stretch everywhere else. What is shuffled is about 4 / accuracy of a group.
    3. In order, the values and lumps give every value its exact ranks.

    If a rank should fall inside a lump, the sketch was off: the fences are then set twice as far
    apart, at last around everything. The fences are written to the scratch folder, so that all
    tasks of the second pass, repeated ones too, see the same.
    """
    by = list(keys)
    spread = 2.0 / accuracy if margin is None else margin
    fence_probs = [_clip(p + side * spread) for p in probs for side in (-1, 1)]
    data = df.where(F.col(x).isNotNull())
    fences = materialize(
        data.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx(F.col(x).cast("double"), fence_probs, accuracy).alias("_fence"),
        ),
        "fences",
    )
    value, stretch, kept = F.col("_x"), F.lit(0), F.lit(False)
    for i in range(0, len(fence_probs), 2):
        low, high = F.col("_fence")[i], F.col("_fence")[i + 1]
        kept = kept | value.between(low, high)
        stretch = stretch + F.when(value > low, 1).otherwise(0)
        stretch = stretch + F.when(value > high, 1).otherwise(0)
    values = data.select(*by, F.col(x).cast("double").alias("_x"))
    items = (
        join_on(values, fences, by)
        .select(*by, "n", "_x", stretch.alias("_stretch"), F.when(kept, value).alias("_kept"))
        .groupBy(*by, "_stretch", "_kept")
        .agg(
            F.count(F.lit(1)).alias("_c"),
            F.min("_x").alias("_at"),
            F.max("_x").alias("_top"),
            F.max("n").alias("n"),
        )
    )
    upto = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ranked = items.withColumn("_last", F.sum("_c").over(upto)).withColumn(
        "_first", F.col("_last") - F.col("_c") + 1
    )
    picks, parts = [F.max("n").alias("n")], []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(float(p))
        lower = F.floor(h) + 1
        parts.append(h - F.floor(h))
        for side, rank in (("l", lower), ("h", F.least(lower + 1, F.col("n")))):
            # Of a lump the ends are known: a neighbour just outside the fences is one of them.
            value_there = (
                F.when(rank == F.col("_first"), F.col("_at"))
                .when(rank == F.col("_last"), F.col("_top"))
                .when((F.col("_first") < rank) & (rank < F.col("_last")), F.col("_kept"))
            )
            picks.append(F.max(value_there).alias(f"_{side}{i}"))
    picked = materialize(ranked.groupBy(*by).agg(*picks).where("n > 0"), "quantiles")
    found = [F.col(f"_{side}{i}") for i in range(len(parts)) for side in "lh"]
    lost = F.lit(False)
    for c in found:
        lost = lost | c.isNull()
    if spread < 1.0 and not picked.where(lost).isEmpty():
        return exact_quantiles(df, keys, x, probs, names, accuracy, 2 * spread)
    return picked.select(
        *keys,
        "n",
        *(
            (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * part).alias(name)
            for i, (part, name) in enumerate(zip(parts, names, strict=True))
        ),
    )


def box_stats(
    df: DataFrame, keys: Sequence[str], x: str, reach: float = 1.5
) -> DataFrame:
    """Five-number summary, whiskers and number of outside points per group."""
    quarts = exact_quantiles(df, keys, x, (0.25, 0.5, 0.75), ("q1", "med", "q3"))
    fence = reach * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - fence, F.col("q3") + fence
    value = F.col(x)
    inside = value.between(low, high)
    joined = join_on(df.where(value.isNotNull()), quarts, keys)
    return joined.groupBy(*keys, "n", "q1", "med", "q3").agg(
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.min(F.when(inside, value)).alias("whisker_low"),
        F.max(F.when(inside, value)).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).alias("n_outside"),
    )


def outside_points(
    df: DataFrame, keys: Sequence[str], x: str, reach: float = 1.5
) -> DataFrame:
    """Rows beyond ``reach`` quartile distances from the box of their group."""
    quarts = exact_quantiles(df, keys, x, (0.25, 0.75), ("_q1", "_q3")).drop("n")
    fence = reach * (F.col("_q3") - F.col("_q1"))
    beyond = (F.col(x) < F.col("_q1") - fence) | (F.col(x) > F.col("_q3") + fence)
    return join_on(df, quarts, keys).where(beyond).drop("_q1", "_q3")


def join_on(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach per-group figures; without keys there is one row of them, read as a scalar."""
    if keys:
        return df.join(stats, list(keys))
    one = stats.select(F.struct(*stats.columns)).scalar()
    return df.select(*df.columns, *(one[c].alias(c) for c in stats.columns))
