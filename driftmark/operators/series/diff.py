"""Differences and logarithms."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from driftmark.operators.series.blocks import BLOCK, block_window, own_rows, with_halo


def differenced(x: Column, w: WindowSpec, lag: int = 1, times: int = 1) -> Column:
    """Repeated lag difference written out with binomial weights: one window pass."""
    out = x
    for j in range(1, times + 1):
        out = out + F.lag(x, j * lag).over(w) * float((-1) ** j * comb(times, j))
    return out


def diff(
    df: DataFrame,
    keys: Sequence[str],
    x: str = "x",
    lag: int = 1,
    times: int = 1,
    name: str = "d",
    length: int = BLOCK,
) -> DataFrame:
    """Adds the difference; rows too close to the start of the series are dropped."""
    rows = with_halo(df, before=lag * times, length=length)
    out = rows.withColumn(name, differenced(F.col(x), block_window(keys), lag, times))
    return own_rows(out).where(F.col("t") > lag * times)


def logged(df: DataFrame, x: str, base10: bool = False) -> DataFrame:
    """Logarithm of a column; null where it is not positive."""
    f = F.log10 if base10 else F.ln
    return df.withColumn(x, F.when(F.col(x) > 0, f(F.col(x))))
