"""Double exponential smoothing.

Level and slope start at x_2 and x_2 - x_1; the first error is that of row 3. The smoothing
weights are picked from a grid by the sum of squared one-step errors. With the grid below the
recursion shrinks by 0.99 per step or faster, so blocks of a long series run side by side with a
warm-up and their sums add up.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.operators.series.blocks import BLOCK, WARM_UP, added_lists, block_arrays

ALPHAS = tuple(i / 20 for i in range(1, 21))
BETAS = (0.01, *(i / 20 for i in range(1, 20)))
GRID = tuple((a, b) for a in ALPHAS for b in BETAS)


_STATE = ("sse", "level", "slope")


def _block_smooth():
    """UDF: sum of squared errors after the warm-up, and the last level and slope, per grid
    point. A closure, so that workers do not need this package."""
    alpha = np.array([a for a, _ in GRID])
    gain = alpha * np.array([b for _, b in GRID])

    def run(x: pd.Series, block: pd.Series, skip: pd.Series) -> pd.DataFrame:
        # All blocks of a batch take a step together, the longest ones first.
        n = x.map(len).to_numpy()
        order = np.argsort(-n, kind="stable")
        sizes, skips, first = n[order], skip.to_numpy()[order], (block.to_numpy() == 0)[order]
        data = np.zeros((sizes[0] if len(sizes) else 0, len(order)))
        for at, (i, size) in enumerate(zip(order, sizes, strict=True)):
            data[:size, at] = x.iloc[i]
        # Rows 1 and 2 of a series only set the state.
        start = np.where(first, np.minimum(2, sizes), 0)
        begin = data[np.maximum(start - 1, 0), np.arange(len(order))] if len(data) else sizes
        state = np.zeros((3, len(order), len(alpha)))
        sse, level, slope = state
        level += begin[:, None]
        slope += np.where(first, begin - (data[0] if len(data) else 0), 0.0)[:, None]
        for i in range(len(data)):
            k = int(np.searchsorted(-sizes, -i, side="left"))
            on = (i >= start[:k])[:, None]
            ahead = level[:k] + slope[:k]
            error = data[i, :k, None] - ahead
            level[:k] = np.where(on, ahead + alpha * error, level[:k])
            slope[:k] = np.where(on, slope[:k] + gain * error, slope[:k])
            sse[:k] += np.where(on & (i >= skips[:k])[:, None], error * error, 0.0)
        back = np.argsort(order, kind="stable")
        names = ("sse", "level", "slope")
        return pd.DataFrame({c: list(v) for c, v in zip(names, state[:, back], strict=True)})

    kind = T.ArrayType(T.DoubleType())
    return F.pandas_udf(run, T.StructType([T.StructField(c, kind) for c in _STATE]))


def fit(df: DataFrame, keys: Sequence[str], x: str = "x", length: int = BLOCK) -> DataFrame:
    """(keys, n, alpha, beta, sse, level, slope): best grid point and final state."""
    blocks = block_arrays(df, keys, [x], WARM_UP, length)
    sums = blocks.select(
        *keys, "_block", "last_t", _block_smooth()(x, "_block", "own_from").alias("s")
    ).select(*keys, "_block", F.array("last_t").alias("last_t"), "s.*")
    whole = added_lists(sums, keys, ["sse"], ["level", "slope", "last_t"], [])
    alpha = F.array(*(F.lit(a) for a, _ in GRID))
    beta = F.array(*(F.lit(b) for _, b in GRID))
    point = F.transform(
        "sse",
        lambda sse, i: F.struct(
            sse.alias("sse"),
            F.get(alpha, i).alias("alpha"),
            F.get(beta, i).alias("beta"),
            F.get("level", i).alias("level"),
            F.get("slope", i).alias("slope"),
        ),
    )
    best = F.array_min(point).alias("b")
    names = ("alpha", "beta", "sse", "level", "slope")
    return whole.select(*keys, F.get("last_t", F.lit(0)).alias("n"), best).select(
        *keys, "n", *(f"b.{c}" for c in names)
    )


def forecast(fits: DataFrame, keys: Sequence[str], steps: int) -> DataFrame:
    """(keys, t, h, forecast): level + h * slope."""
    return fits.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select(
        *keys,
        (F.col("n") + F.col("h")).alias("t"),
        "h",
        (F.col("level") + F.col("h") * F.col("slope")).alias("forecast"),
    )


def intervals(fits: DataFrame, keys: Sequence[str], steps: int) -> DataFrame:
    """(keys, t, h, forecast, se, low80, high80, low95, high95).

    A shock raises the forecast j steps later by alpha (1 + beta j); its variance is the mean
    squared error of the rows after the two that only set the state.
    """
    ahead = forecast(fits, keys, steps).join(fits.select(*keys, "n", "alpha", "beta", "sse"), list(keys))
    j = F.sequence(F.lit(0), F.col("h") - 1)
    gain = F.transform(
        j, lambda i: F.when(i == 0, F.lit(1.0)).otherwise(F.col("alpha") * (1 + F.col("beta") * i))
    )
    total = F.aggregate(gain, F.lit(0.0), lambda a, g: a + g * g)
    se = F.sqrt(F.col("sse") / F.nullif(F.col("n") - 2, F.lit(0)) * total)
    bands = [
        (F.col("forecast") + sign * z * F.col("se")).alias(f"{name}{level}")
        for level, z in ((80, 1.2815515655446004), (95, 1.959963984540054))
        for name, sign in (("low", -1), ("high", 1))
    ]
    return ahead.withColumn("se", se).select(*keys, "t", "h", "forecast", "se", *bands)
