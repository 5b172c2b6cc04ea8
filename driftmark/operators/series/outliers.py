"""Outliers of a series and their replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmark.operators.quantiles import exact_quantiles
from driftmark.operators.series.blocks import BLOCK, block_window, own_rows, with_halo
from driftmark.sources.scratch import materialize

REACH = 3.0


def rolling_median(
    df: DataFrame, keys: Sequence[str], x: str, half: int, name: str, length: int = BLOCK
) -> DataFrame:
    frame = block_window(keys).rowsBetween(-half, half)
    rows = with_halo(df, before=half, after=half, length=length)
    return own_rows(rows.withColumn(name, F.percentile(F.col(x), F.lit(0.5)).over(frame)))


def flag_outliers(
    df: DataFrame,
    keys: Sequence[str],
    x: str = "x",
    half: int = 3,
    reach: float = REACH,
    length: int = BLOCK,
) -> DataFrame:
    """Adds smooth, residual and is_outlier.

    The residual from a centred rolling median lies outside the quartiles of all residuals of
    the series by more than ``reach`` quartile distances.
    """
    smoothed = rolling_median(df, keys, x, half, "smooth", length).withColumn(
        "residual", F.col(x) - F.col("smooth")
    )
    # Read three times below: twice for the quartiles, once for the flags.
    smoothed = materialize(smoothed, "rolling-median")
    quarts = exact_quantiles(smoothed, keys, "residual", (0.25, 0.75), ("_q1", "_q3")).drop("n")
    fence = reach * (F.col("_q3") - F.col("_q1"))
    beyond = (F.col("residual") < F.col("_q1") - fence) | (
        F.col("residual") > F.col("_q3") + fence
    )
    return (
        smoothed.join(quarts, list(keys), "left")
        .withColumn("is_outlier", F.coalesce(beyond, F.lit(False)))
        .drop("_q1", "_q3")
    )


def outliers(df: DataFrame, keys: Sequence[str], x: str = "x", **options) -> DataFrame:
    """(keys, t, x, replacement) of the outlying rows; the smooth value is the replacement."""
    found = flag_outliers(df, keys, x, **options).where("is_outlier")
    return found.select(*keys, "t", x, F.col("smooth").alias("replacement"))


def interpolate(
    df: DataFrame, keys: Sequence[str], x: str, name: str, length: int = BLOCK
) -> DataFrame:
    """Fill nulls on the straight line between the nearest known rows; ends repeat the nearest.

    Inside a block the nearest known rows come from one window. Across blocks each block is
    represented by its first and last known row, so a gap of any length is bridged by a window
    over one row per block.
    """
    rows = df.withColumn("_block", F.floor((F.col("t").cast("bigint") - 1) / length))
    point = F.when(F.col(x).isNotNull(), F.struct(F.col("t").alias("t"), F.col(x).alias("x")))
    ends = rows.groupBy(*keys, "_block").agg(
        F.min_by(point, F.when(point.isNotNull(), F.col("t"))).alias("_first"),
        F.max_by(point, F.when(point.isNotNull(), F.col("t"))).alias("_last"),
    )
    # ``last`` over what precedes is a running value; a frame that ends with the partition would be
    # gone through again for every row. So what follows is looked for in descending order.
    order = Window.partitionBy(*keys).orderBy("_block")
    backward = Window.partitionBy(*keys).orderBy(F.desc("_block"))
    carried = ends.select(
        *keys,
        "_block",
        F.last("_last", ignorenulls=True)
        .over(order.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_from"),
        F.last("_first", ignorenulls=True)
        .over(backward.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_to"),
    )
    inside = block_window(keys)
    before = F.last(point, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    mirrored = Window.partitionBy(*keys, "_block").orderBy(F.desc("t"))
    after = F.last(point, ignorenulls=True).over(
        mirrored.rowsBetween(Window.unboundedPreceding, 0)
    )
    near = (
        rows.withColumns({"_before": before, "_after": after})
        .join(carried, [*keys, "_block"])
        .withColumns(
            {
                "_l": F.coalesce("_before", "_from"),
                "_r": F.coalesce("_after", "_to"),
            }
        )
    )
    share = (F.col("t") - F.col("_l.t")) / F.nullif(F.col("_r.t") - F.col("_l.t"), F.lit(0))
    line = F.col("_l.x") + (F.col("_r.x") - F.col("_l.x")) * share
    filled = F.coalesce(F.col(x), line, F.col("_l.x"), F.col("_r.x"))
    return near.withColumn(name, filled).drop(
        "_block", "_before", "_after", "_from", "_to", "_l", "_r"
    )


def clean(df: DataFrame, keys: Sequence[str], x: str = "x", **options) -> DataFrame:
    """Outliers and gaps replaced by linear interpolation: adds ``cleaned``."""
    flagged = flag_outliers(df, keys, x, **options)
    kept = flagged.withColumn("_kept", F.when(~F.col("is_outlier"), F.col(x)))
    length = options.get("length", BLOCK)
    return interpolate(kept, keys, "_kept", "cleaned", length).drop("_kept", "smooth", "residual")
