"""Nearest-centre assignment with given centres."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_distance(cols: Sequence[str], centre: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for c, v in zip(cols, centre, strict=True):
        total = total + (F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v)))
    return total


def lloyd(
    df: DataFrame,
    cols: Sequence[str],
    centres: Sequence[Sequence[float]],
    rounds: int,
    weight: str,
) -> tuple[list[tuple[float, ...]], list[tuple[float, float]]]:
    """Centres after that many rounds from given ones, and per cluster the weight and the weighted
    squared distance of its rows.

    A round is one aggregate; a row per centre reaches the driver. A centre without rows stays.
    """
    w = F.col(weight)
    means = [(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in cols]
    now = [tuple(map(float, c)) for c in centres]

    def clusters():
        sums = [F.sum(w).alias("_w"), F.sum(w * F.col("distance2")).alias("_d")]
        rows = nearest_centre(df, cols, now).groupBy("cluster").agg(*means, *sums).collect()
        return {r.cluster: r for r in rows}

    for _ in range(rounds):
        found = clusters()
        now = [
            tuple(found[i][c] for c in cols) if i in found else centre for i, centre in enumerate(now)
        ]
    last = clusters()
    return now, [(last[i]["_w"], last[i]["_d"]) if i in last else (0.0, 0.0) for i in range(len(now))]


def nearest_centre(
    df: DataFrame, cols: Sequence[str], centres: Sequence[Sequence[float]]
) -> DataFrame:
    """Adds ``cluster`` and ``distance2``; on a tie the lowest cluster id wins.

    The centres are constants in the projection, so no row is multiplied and nothing shuffles.
    """
    options = [
        F.struct(squared_distance(cols, c).alias("distance2"), F.lit(i).alias("cluster"))
        for i, c in enumerate(centres)
    ]
    best = options[0] if len(options) == 1 else F.least(*options)
    return (
        df.withColumn("_best", best)
        .withColumns(
            {"cluster": F.col("_best.cluster"), "distance2": F.col("_best.distance2")}
        )
        .drop("_best")
    )
