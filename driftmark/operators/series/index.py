"""Making series: positions, calendar periods, cycles, gap filling, head and tail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.operators.sampling import with_position

STEPS = {"month": "interval 1 month", "day": "interval 1 day"}


def regular_series(
    df: DataFrame,
    keys: Sequence[str],
    period: str,
    value: str,
    step: str = "month",
    frequency: int = 12,
    fill: float | None = 0.0,
) -> DataFrame:
    """(keys, t, cycle, period, value) on every period between the first and last of the key.

    The grid of a key is generated from its own first and last period, so its length is set by
    the calendar, not by the rows; the values are joined on (keys, period).
    """
    start = F.trunc(F.col(period), "month") if step == "month" else F.col(period)
    known = df.withColumn("_p", start).select(*keys, "_p", value)
    span = known.groupBy(*keys).agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
    grid = span.select(
        *keys,
        F.posexplode(F.sequence("_lo", "_hi", F.expr(STEPS[step]))).alias("_pos", "_p"),
    )
    shown = F.last_day("_p") if step == "month" else F.col("_p")
    x = F.col(value).cast("double")
    return grid.join(known, [*keys, "_p"], "left").select(
        *keys,
        (F.col("_pos") + 1).alias("t"),
        (F.col("_pos") % frequency).alias("cycle"),
        shown.alias("period"),
        (x if fill is None else F.coalesce(x, F.lit(fill))).alias("x"),
    )


def ordered_series(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column | None = None
) -> DataFrame:
    """Undated series: t is the exact rank in the key, found bucket by bucket."""
    return with_position(df, keys, order, bucket, "t")


def head_tail(df: DataFrame, keys: Sequence[str], tail: int) -> tuple[DataFrame, DataFrame]:
    """All rows but the last ``tail`` of each series, and those last rows."""
    sized = df.join(df.groupBy(*keys).agg(F.max("t").alias("_n")), list(keys))
    cut = F.col("t") <= F.col("_n") - tail
    return sized.where(cut).drop("_n"), sized.where(~cut).drop("_n")


def split_at(df: DataFrame, position: int) -> tuple[DataFrame, DataFrame]:
    """Rows up to a position, and the rows after it: a plain filter each."""
    return df.where(F.col("t") <= position), df.where(F.col("t") > position)
