"""Descriptive profiles of a table."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.operators.quantiles import join_on


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null, n) for every column, from one aggregate."""
    names = list(cols or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("n"), *(F.count(c).alias(f"_{i}") for i, c in enumerate(names))
    )
    rows = F.array(
        *(
            F.struct(F.lit(c).alias("column"), (F.col("n") - F.col(f"_{i}")).alias("n_null"))
            for i, c in enumerate(names)
        )
    )
    return counted.select(F.inline(rows), "n")


def null_total(df: DataFrame) -> DataFrame:
    """(is_null, cells): cells of the whole table by being null."""
    per_column = null_counts(df)
    sides = F.array(
        F.struct(F.lit(True).alias("is_null"), F.col("n_null").alias("c")),
        F.struct(F.lit(False).alias("is_null"), (F.col("n") - F.col("n_null")).alias("c")),
    )
    return per_column.select(F.inline(sides)).groupBy("is_null").agg(F.sum("c").alias("cells"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def equality_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """(equal, n): rows by the two columns being equal."""
    return df.groupBy((F.col(a) == F.col(b)).alias("equal")).agg(F.count(F.lit(1)).alias("n"))


def table_dims(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns))
    )


def first_k(df: DataFrame, order: Sequence[str | Column], k: int) -> DataFrame:
    """The first k rows in the given order: each task keeps k rows, so nothing is fully sorted."""
    return df.orderBy(*order).limit(k)


def means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*(F.avg(c).alias(c) for c in cols))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x, y, corr) for all ordered couples of columns, from one aggregate."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*(F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))

    def cell(a: str, b: str, value: Column) -> Column:
        return F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), value.alias("corr"))

    cells = [cell(c, c, F.lit(1.0)) for c in cols]
    for i, (a, b) in enumerate(pairs):
        cells += [cell(a, b, F.col(f"_{i}")), cell(b, a, F.col(f"_{i}"))]
    return row.select(F.inline(F.array(*cells)))


def _bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin from 1 to ``bins``; the maximum belongs to the last bin."""
    spot = F.floor((x - low) / F.nullif(high - low, F.lit(0.0)) * bins) + 1
    return F.when(high == low, 1).otherwise(F.least(spot, F.lit(bins))).cast("int")


def histogram(df: DataFrame, x: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of the non-empty equal-width bins."""
    data = df.select(F.col(x).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    ends = data.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    counted = (
        join_on(data, ends, ())
        .groupBy(_bin(F.col("_x"), lo, hi, bins).alias("bin"), "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (hi - lo) / bins
    return counted.select(
        "bin",
        (lo + (F.col("bin") - 1) * width).alias("low"),
        (lo + F.col("bin") * width).alias("high"),
        "n",
    )


def scatter(df: DataFrame, x: str, y: str, group: Column) -> DataFrame:
    return df.select(F.col(x).alias("x"), F.col(y).alias("y"), group.alias("group"))


def scatter_density(
    df: DataFrame, x: str, y: str, group: str, bins: int = 20
) -> DataFrame:
    """(group, x_bin, y_bin, n): what a scatter plot of a large table shows."""
    data = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = data.agg(
        F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1")
    )
    x_bin = _bin(F.col(x), F.col("_x0"), F.col("_x1"), bins)
    y_bin = _bin(F.col(y), F.col("_y0"), F.col("_y1"), bins)
    return (
        join_on(data, ends, ())
        .groupBy(group, x_bin.alias("x_bin"), y_bin.alias("y_bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
