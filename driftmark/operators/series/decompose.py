"""Trend, seasonal and remainder components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.operators.series.blocks import BLOCK, block_window, own_rows, with_halo
from driftmark.sources.scratch import materialize


def centred_average(x: Column, keys: Sequence[str], frequency: int) -> Column:
    """Moving average over one cycle; for an even cycle the two end points count half.

    Null where the window does not fit.
    """
    half = frequency // 2
    w = block_window(keys)
    full = w.rowsBetween(-half, half)
    total = F.sum(x).over(full)
    if frequency % 2 == 0:
        total = total - (F.lag(x, half).over(w) + F.lead(x, half).over(w)) / 2.0
    return F.when(F.count(x).over(full) == 2 * half + 1, total / float(frequency))


def cycle_means(df: DataFrame, keys: Sequence[str], detrended: Column) -> DataFrame:
    """(keys, cycle, seasonal): mean per place in the cycle, shifted to sum to zero."""
    means = df.groupBy(*keys, "cycle").agg(F.avg(detrended).alias("_m"))
    # One row per place in the cycle.
    shift = F.avg("_m").over(Window.partitionBy(*keys))
    return means.select(*keys, "cycle", (F.col("_m") - shift).alias("seasonal"))


def local_linear(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    half: int,
    name: str,
    length: int = BLOCK,
) -> DataFrame:
    """Adds the tricube-weighted straight line through the rows within ``half`` positions,
    evaluated at the row itself."""
    w = block_window(keys)
    rows = with_halo(df, before=half, after=half, length=length)
    zero = F.lit(0.0)
    s0 = s1 = s2 = t0 = t1 = zero
    for d in range(-half, half + 1):
        weight = (1 - (abs(d) / (half + 1)) ** 3) ** 3
        value = F.col(x) if d == 0 else F.col(f"_x{d}")
        here = F.when(value.isNotNull(), weight).otherwise(0.0)
        v = F.coalesce(value, zero)
        s0, s1, s2 = s0 + here, s1 + here * float(d), s2 + here * float(d * d)
        t0, t1 = t0 + here * v, t1 + here * v * float(d)
    shifted = rows.withColumns(
        {
            f"_x{d}": F.lag(x, -d).over(w) if d < 0 else F.lead(x, d).over(w)
            for d in range(-half, half + 1)
            if d != 0
        }
    )
    fitted = (s2 * t0 - s1 * t1) / F.nullif(s0 * s2 - s1 * s1, F.lit(0.0))
    out = shifted.withColumn(name, fitted)
    return own_rows(out).drop(*(f"_x{d}" for d in range(-half, half + 1) if d != 0))


def decompose_additive(
    df: DataFrame, keys: Sequence[str], frequency: int, length: int = BLOCK
) -> DataFrame:
    """Adds trend, seasonal, remainder; null for series shorter than two cycles."""
    half = frequency // 2
    rows = with_halo(df, before=half, after=half, length=length)
    trended = own_rows(rows.withColumn("trend", centred_average(F.col("x"), keys, frequency)))
    season = cycle_means(trended, keys, F.col("x") - F.col("trend"))
    size = df.groupBy(*keys).agg((F.max("t") >= 2 * frequency).alias("_enough"))
    season = season.join(size, list(keys))
    return (
        trended.join(season, [*keys, "cycle"])
        .withColumns(
            {
                "trend": F.when(F.col("_enough"), F.col("trend")),
                "seasonal": F.when(F.col("_enough"), F.col("seasonal")),
            }
        )
        .withColumn("remainder", F.col("x") - F.col("trend") - F.col("seasonal"))
        .drop("_enough")
    )


def season_trend(
    df: DataFrame,
    keys: Sequence[str],
    half: int,
    passes: int = 2,
    length: int = BLOCK,
) -> DataFrame:
    """Periodic season and local-linear trend, refined in a fixed number of passes. A pass reads the
    one before twice, so that is stored."""
    cols = df.columns
    out = df.withColumn("trend", F.lit(0.0))
    for i in range(passes):
        if i:
            out = materialize(out, "season-trend")
        season = cycle_means(out, keys, F.col("x") - F.col("trend"))
        seasoned = out.drop("trend", "seasonal").join(season, [*keys, "cycle"])
        seasoned = seasoned.withColumn("_adjusted", F.col("x") - F.col("seasonal"))
        out = local_linear(seasoned, keys, "_adjusted", half, "trend", length).drop("_adjusted")
    return out.select(
        *cols,
        "trend",
        "seasonal",
        (F.col("x") - F.col("trend") - F.col("seasonal")).alias("remainder"),
    )
