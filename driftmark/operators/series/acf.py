"""Autocorrelation and partial autocorrelation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.operators.series.blocks import BLOCK, block_window, with_halo

# Fixed value: half-width of the 95% band in standard errors.
BAND_Z = 1.96


def acf(
    df: DataFrame, keys: Sequence[str], x: str = "x", max_lag: int = 12, length: int = BLOCK
) -> DataFrame:
    """(keys, lag, r, band): deviations from the series mean, multiplied with their lags.

    All lags come from one window pass per block and one aggregate per series.
    """
    stats = df.groupBy(*keys).agg(F.avg(x).alias("_mean"))
    centred = df.join(stats, list(keys)).select(*keys, "t", (F.col(x) - F.col("_mean")).alias("_d"))
    w = block_window(keys)
    rows = with_halo(centred, before=max_lag, length=length)
    d = F.col("_d")
    products = rows.select(
        *keys,
        "_own",
        (d * d).alias("_p0"),
        *((d * F.lag(d, k).over(w)).alias(f"_p{k}") for k in range(1, max_lag + 1)),
    ).where("_own")
    sums = products.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(f"_p{k}").alias(f"_p{k}") for k in range(max_lag + 1)),
    )
    lags = F.array(
        *(
            F.struct(F.lit(k).alias("lag"), F.col(f"_p{k}").alias("s"))
            for k in range(1, max_lag + 1)
        )
    )
    return (
        sums.select(*keys, "n", "_p0", F.inline(lags))
        .where(F.col("lag") < F.col("n"))
        .select(
            *keys,
            "lag",
            (F.coalesce(F.col("s"), F.lit(0.0)) / F.nullif(F.col("_p0"), F.lit(0.0))).alias("r"),
            (BAND_Z / F.sqrt("n")).alias("band"),
        )
    )


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def pacf(acf_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, lag, r, partial) by the Durbin-Levinson recursion over the lags of each series.

    The arrays hold one number per lag, whatever the length of the series.
    """
    per_key = acf_table.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("lag", "r"))).alias("_lags")
    )
    r = F.col("_lags.r")

    def step(state, k):
        phi = state["phi"]
        seen = F.slice(r, 1, F.size(phi))
        num = F.element_at(r, k) - _dot(phi, F.reverse(seen))
        den = 1.0 - _dot(phi, seen)
        partial = num / F.nullif(den, F.lit(0.0))
        shrunk = F.zip_with(phi, F.reverse(phi), lambda p, q: p - partial * q)
        return F.struct(
            F.concat(shrunk, F.array(partial)).alias("phi"),
            F.concat(state["out"], F.array(partial)).alias("out"),
        )

    empty = F.expr("cast(array() as array<double>)")
    folded = F.aggregate(
        F.sequence(F.lit(1), F.size("_lags")),
        F.struct(empty.alias("phi"), empty.alias("out")),
        step,
        lambda s: s["out"],
    )
    return per_key.select(
        *keys, F.inline(F.arrays_zip(F.col("_lags"), folded.alias("partial")))
    ).select(*keys, F.col("_lags.lag").alias("lag"), F.col("_lags.r").alias("r"), "partial")
