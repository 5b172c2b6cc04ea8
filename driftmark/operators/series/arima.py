"""ARIMA(p, d, q) with p, q in {0, 1} by conditional least squares.

With w the d-times differenced series, e_t = w_t - phi w_(t-1) - theta e_(t-1) and e = 0 before
the first usable row. For a fixed theta the residual is linear in phi: e = a - phi b, where a
and b are w and its lag run through the same filter. So one pass over the data with a grid of
thetas yields the sums of aa, ab and bb from which the best phi of each theta follows in closed
form, and all four (p, q) for the same d come out of the same sums.

|theta| <= 0.99 makes the filter forget: blocks of a long series run side by side with a
warm-up, and their sums add up.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.functions.scalars import two_sided_p
from driftmark.operators.series.blocks import (
    BLOCK,
    WARM_UP,
    added_lists,
    block_arrays,
    block_window,
    own_rows,
    with_halo,
)
from driftmark.operators.series.diff import differenced

THETAS = tuple(i / 100 for i in range(-99, 100))
LIMIT = 0.99


_ARRAY = T.ArrayType(T.DoubleType())
_SUMS = ("aa", "ab", "bb", "a", "b")


# The functions that run in Python workers are closures: they travel by value, so a worker needs
# numpy and pandas but not this package.
def _padding():
    """Lists as columns of a matrix, in the given order, zeros after their end."""

    def padded(lists: pd.Series, order: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros((sizes[0] if len(sizes) else 0, len(order)))
        for at, (i, size) in enumerate(zip(order, sizes, strict=True)):
            out[:size, at] = lists.iloc[i]
        return out

    return padded


def _block_sums():
    """UDF: sums of aa, ab, bb over the rows after the warm-up, and the last a and b, per theta.

    All blocks of a batch take a step together, the longest ones first, so that those that have
    ended fall off the end."""
    theta, padded = np.array(THETAS), _padding()

    def sums(w: pd.Series, lagged: pd.Series, skip: pd.Series) -> pd.DataFrame:
        n = w.map(len).to_numpy()
        order = np.argsort(-n, kind="stable")
        skips, sizes = skip.to_numpy()[order], n[order]
        xs, ys = padded(w, order, sizes), padded(lagged, order, sizes)
        state = np.zeros((5, len(n), len(theta)))
        a, b, aa, ab, bb = state
        for i in range(sizes[0] if len(sizes) else 0):
            k = int(np.searchsorted(-sizes, -i, side="left"))
            a[:k] = xs[i, :k, None] - theta * a[:k]
            b[:k] = ys[i, :k, None] - theta * b[:k]
            on = (i >= skips[:k])[:, None]
            aa[:k] += np.where(on, a[:k] * a[:k], 0.0)
            ab[:k] += np.where(on, a[:k] * b[:k], 0.0)
            bb[:k] += np.where(on, b[:k] * b[:k], 0.0)
        back = np.argsort(order, kind="stable")
        columns = dict(zip(("a", "b", "aa", "ab", "bb"), state[:, back], strict=True))
        return pd.DataFrame({c: list(columns[c]) for c in ("aa", "ab", "bb", "a", "b")})

    return F.pandas_udf(sums, T.StructType([T.StructField(c, _ARRAY) for c in _SUMS]))


def _block_residuals():
    """UDF: the residuals of a block, warm-up included; all blocks of a batch step together."""
    padded = _padding()

    def recurse(w: pd.Series, lagged: pd.Series, phi: pd.Series, theta: pd.Series) -> pd.Series:
        n = w.map(len).to_numpy()
        order = np.argsort(-n, kind="stable")
        sizes, p, q = n[order], phi.to_numpy()[order], theta.to_numpy()[order]
        u = padded(w, order, sizes) - p * padded(lagged, order, sizes)
        for i in range(1, len(u)):
            k = int(np.searchsorted(-sizes, -i, side="left"))
            u[i, :k] -= q[:k] * u[i - 1, :k]
        back = np.argsort(order, kind="stable")
        return pd.Series([u[: n[i], at] for i, at in enumerate(back)])

    return F.pandas_udf(recurse, _ARRAY)


def change_rows(
    df: DataFrame, keys: Sequence[str], x: str, d: int, start: int, length: int = BLOCK
) -> DataFrame:
    """(keys, t, w, w1): differences and their lag from position ``start`` on, t shifted to
    begin at 1."""
    win = block_window(keys)
    rows = with_halo(df, before=d + 1, length=length)
    w = differenced(F.col(x), win, 1, d)
    rows = rows.withColumn("w", w).withColumn("w1", F.coalesce(F.lag("w").over(win), F.lit(0.0)))
    return (
        own_rows(rows)
        .where((F.col("t") >= start) & F.col("w").isNotNull())
        .select(*keys, (F.col("t") - (start - 1)).alias("t"), "w", "w1")
    )


def css_profile(changes: DataFrame, keys: Sequence[str], length: int = BLOCK) -> DataFrame:
    """(keys, n, aa, ab, bb, a, b): lists of sums per theta of ``THETAS`` over the whole series.

    ``a`` and ``b`` are the filtered values at the last row.
    """
    blocks = block_arrays(changes, keys, ["w", "w1"], WARM_UP, length)
    sums = blocks.select(
        *keys,
        "_block",
        (F.size("w") - F.col("own_from")).cast("long").alias("n"),
        _block_sums()("w", "w1", "own_from").alias("s"),
    ).select(*keys, "_block", "n", "s.*")
    return added_lists(sums, keys, ["aa", "ab", "bb"], ["a", "b"], ["n"])


def _phi(p: int, ab: Column, bb: Column) -> Column:
    if p == 0:
        return F.lit(0.0)
    best = F.coalesce(ab / F.nullif(bb, F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), best))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _points(p: int, thetas: Sequence[float], places: Sequence[int]) -> Column:
    """The grid points of a series, best first by (sse, theta): a list of (sse, theta, phi, bb,
    e_last, place)."""
    theta = F.array(*(F.lit(v) for v in thetas))

    def point(i: Column) -> Column:
        aa, ab, bb, a, b = (F.get(c, i) for c in ("aa", "ab", "bb", "a", "b"))
        return _let(
            _phi(p, ab, bb),
            lambda phi: F.struct(
                (aa - 2 * phi * ab + phi * phi * bb).alias("sse"),
                F.get(theta, i).alias("theta"),
                phi.alias("phi"),
                bb.alias("bb"),
                (a - phi * b).alias("e_last"),
                i.alias("place"),
            ),
        )

    return F.transform(F.array(*(F.lit(i) for i in places)), point)


def best_fit(
    profile: DataFrame, keys: Sequence[str], p: int, q: int, thetas: Sequence[float] = THETAS
) -> DataFrame:
    """(keys, p, q, n, phi, theta, sse, sigma2, se_phi, se_theta, e_last).

    The standard error of theta comes from the curvature of the profiled sum of squares between
    the neighbouring grid points; it is null at the edge of the grid.
    """
    places = range(len(thetas)) if q else [thetas.index(0.0)]
    step = 0.01

    def picked(curve: Column) -> Column:
        def with_sides(best: Column) -> Column:
            at = best["place"] - places[0]
            sides = (F.get(curve, at + side)["sse"] for side in (1, -1))
            return F.struct(best.alias("best"), sum(sides, F.lit(0.0)).alias("sides"))

        return _let(F.array_min(curve), with_sides)

    # One expression, so that the grid is worked out once.
    found = profile.select(*keys, "n", _let(_points(p, thetas, list(places)), picked).alias("_f")).select(
        *keys, "n", F.col("_f.best").alias("best"), F.col("_f.sides").alias("sides")
    )
    bend = (F.col("sides") - 2 * F.col("best.sse")) / F.lit(step * step)
    sigma2 = F.col("best.sse") / F.col("n")
    unknown = F.lit(None).cast("double")
    se_phi = F.sqrt(sigma2 / F.nullif(F.col("best.bb"), F.lit(0.0))) if p else unknown
    se_theta = F.sqrt(2 * sigma2 / F.when(bend > 0, bend)) if q else unknown
    return found.select(
        *keys,
        F.lit(p).alias("p"),
        F.lit(q).alias("q"),
        "n",
        F.col("best.phi").alias("phi"),
        F.col("best.theta").alias("theta"),
        F.col("best.sse").alias("sse"),
        sigma2.alias("sigma2"),
        se_phi.alias("se_phi"),
        se_theta.alias("se_theta"),
        F.col("best.e_last").alias("e_last"),
    )


def fit(
    df: DataFrame,
    keys: Sequence[str],
    x: str = "x",
    order: tuple[int, int, int] = (1, 1, 1),
    length: int = BLOCK,
) -> DataFrame:
    """Coefficients by conditional least squares; the first usable row is d + p + 1.

    One row per series: a series too short to have a usable row gets null coefficients. Rows of
    null x are left out and their neighbours taken as consecutive; fill them first
    (``outliers.interpolate``) where that is not meant.
    """
    p, d, q = order
    changes = change_rows(df, keys, x, d, d + p + 1, length)
    if q == 0 and p == 1:
        found = ar_fit(changes, keys)
    else:
        found = best_fit(css_profile(changes, keys, length), keys, p, q)
    series = df.select(*keys).distinct()
    return (
        series.join(found, list(keys), "left")
        .withColumns({"p": F.lit(p), "q": F.lit(q)})
        .select(found.columns)
    )


def ar_fit(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The p = 1, q = 0 case needs no filter: three plain sums."""
    w, w1 = F.col("w"), F.col("w1")
    sums = changes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(F.sum(w * w)).alias("aa"),
        F.array(F.sum(w * w1)).alias("ab"),
        F.array(F.sum(w1 * w1)).alias("bb"),
        F.array(F.max_by(w, F.col("t"))).alias("a"),
        F.array(F.max_by(w1, F.col("t"))).alias("b"),
    )
    return best_fit(sums, keys, 1, 0, (0.0,))


def z_test(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, term, estimate, std_error, z, p_value) of the fitted coefficients."""
    terms = F.array(
        *(
            F.struct(
                F.lit(name).alias("term"),
                F.col(coef).alias("estimate"),
                F.col(se).alias("std_error"),
                F.col(used).alias("used"),
            )
            for name, coef, se, used in (
                ("ar1", "phi", "se_phi", "p"),
                ("ma1", "theta", "se_theta", "q"),
            )
        )
    )
    z = F.col("estimate") / F.nullif(F.col("std_error"), F.lit(0.0))
    return (
        fits.select(*keys, F.inline(terms))
        .where("used = 1")
        .select(
            *keys, "term", "estimate", "std_error", z.alias("z"), two_sided_p(z).alias("p_value")
        )
    )


def residuals(
    df: DataFrame,
    fits: DataFrame,
    keys: Sequence[str],
    x: str = "x",
    order: tuple[int, int, int] = (1, 1, 1),
    length: int = BLOCK,
) -> DataFrame:
    """(keys, t, x): the residuals as a series of their own."""
    p, d, _ = order
    changes = change_rows(df, keys, x, d, d + p + 1, length)
    blocks = block_arrays(changes, keys, ["w", "w1"], WARM_UP, length).join(
        fits.select(*keys, "phi", "theta"), list(keys)
    )
    rows = blocks.select(
        *keys,
        "own_from",
        "t",
        _block_residuals()("w", "w1", "phi", "theta").alias("x"),
    )
    return (
        rows.select(*keys, "own_from", F.posexplode(F.arrays_zip("t", "x")).alias("pos", "r"))
        .where(F.col("pos") >= F.col("own_from"))
        .select(*keys, F.col("r.t").alias("t"), F.col("r.x").alias("x"))
    )


def forecast(
    df: DataFrame, fits: DataFrame, keys: Sequence[str], x: str, steps: int
) -> DataFrame:
    """(keys, h, forecast) for d = 1: w goes on as phi^(h-1) (phi w_n + theta e_n)."""
    tail = df.groupBy(*keys).agg(F.max_by(F.col(x), F.col("t")).alias("_x"))
    last = last_change(df, keys, x).join(tail, list(keys))
    phi = F.col("phi")
    first = phi * F.col("w_last") + F.col("theta") * F.col("e_last")
    h = F.col("h")
    total = F.when(phi == 1.0, h.cast("double")).otherwise((1 - F.pow(phi, h)) / (1 - phi))
    return (
        fits.join(last, list(keys))
        .withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(steps))))
        .select(*keys, "h", (F.col("_x") + first * total).alias("forecast"))
    )


def error_bands(
    fits: DataFrame, keys: Sequence[str], steps: int, d: int = 1, z: float = 1.959963984540054
) -> DataFrame:
    """(keys, h, se, half_width): standard error of the forecast h steps ahead, and z times it.

    The error is the sum of the coming shocks, weighted by the response to a unit shock: for
    the changes 1, phi + theta, phi (phi + theta), ..., summed up once per difference.
    """
    phi, theta = F.col("phi"), F.col("theta")
    response = F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        lambda j: F.when(j == 0, F.lit(1.0)).otherwise(F.pow(phi, j - 1) * (phi + theta)),
    )

    def running(values: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.lit(steps)),
            lambda i: F.aggregate(F.slice(values, 1, i), F.lit(0.0), lambda a, b: a + b),
        )

    for _ in range(d):
        response = running(response)
    variance = running(F.transform(response, lambda r: r * r))
    se = F.sqrt(F.col("sigma2") * F.col("v"))
    return fits.select(*keys, "sigma2", F.posexplode(variance).alias("at", "v")).select(
        *keys, (F.col("at") + 1).alias("h"), se.alias("se"), (se * z).alias("half_width")
    )


def last_change(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """(keys, w_last): the last first difference of each series."""
    size = df.groupBy(*keys).agg(F.max("t").alias("_n"))
    ends = df.join(size, list(keys)).where(F.col("t") >= F.col("_n") - 1)
    signed = F.when(F.col("t") == F.col("_n"), F.col(x)).otherwise(-F.col(x))
    return ends.groupBy(*keys).agg(F.sum(signed).alias("w_last"))


DIFFERENCES = (0, 1, 2)


def select_order(
    df: DataFrame, keys: Sequence[str], x: str = "x", length: int = BLOCK
) -> DataFrame:
    """(keys, p, d, q, phi, theta, sigma2, aicc): the order with the least AICc.

    All candidates are judged on the same rows, from position 4 on; with d = 0 the series mean
    is taken out first. The three differenced series go through one filter pass, and all (p, q)
    of a d are read off the same profile.
    """
    first = 4
    mean = df.groupBy(*keys).agg(F.avg(x).alias("_mean"))
    centred = df.join(mean, list(keys)).withColumn(x, F.col(x) - F.col("_mean")).drop("_mean")
    changes = None
    for d in DIFFERENCES:
        rows = change_rows(centred, keys, x, d, first, length).withColumn("d", F.lit(d))
        changes = rows if changes is None else changes.unionByName(rows)
    profile = css_profile(changes, [*keys, "d"], length)

    zero = THETAS.index(0.0)
    candidates = F.array(
        *(
            F.struct(
                F.lit(p).alias("p"),
                F.lit(q).alias("q"),
                F.array_min(_points(p, THETAS, range(len(THETAS)) if q else [zero])).alias("fit"),
            )
            for p in (0, 1)
            for q in (0, 1)
        )
    )
    k = F.col("p") + F.col("q") + 1
    n = F.col("n")
    sigma2 = F.col("fit.sse") / n
    aicc = n * F.ln(sigma2) + 2 * k + 2 * k * (k + 1) / F.nullif(n - k - 1, F.lit(0))
    best = F.struct("p", "d", "q", "phi", "theta", "sigma2", "aicc")
    return (
        profile.select(*keys, "d", "n", F.inline(candidates))
        .withColumns({"sigma2": sigma2, "aicc": aicc})
        .select(*keys, "p", "d", "q", "fit.phi", "fit.theta", "sigma2", "aicc")
        .groupBy(*keys)
        .agg(F.min_by(best, F.struct("aicc", "d", "p", "q")).alias("b"))
        .select(*keys, "b.*")
    )
