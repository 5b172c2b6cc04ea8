"""Straight-line trend per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ols_fit(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """(keys, n, slope, intercept, r2, corr): one aggregate."""
    yc, xc = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(*keys).agg(
        F.regr_count(yc, xc).alias("n"),
        F.regr_slope(yc, xc).alias("slope"),
        F.regr_intercept(yc, xc).alias("intercept"),
        F.regr_r2(yc, xc).alias("r2"),
        F.corr(yc, xc).alias("corr"),
    )


def ols_predict(
    df: DataFrame, fit: DataFrame, keys: Sequence[str], x: str, name: str = "predicted"
) -> DataFrame:
    line = fit.select(*keys, "slope", "intercept")
    return (
        df.join(line, list(keys))
        .withColumn(name, F.col("intercept") + F.col("slope") * F.col(x))
        .drop("slope", "intercept")
    )
