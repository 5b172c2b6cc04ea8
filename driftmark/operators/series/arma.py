"""ARIMA of any order, with gaps: order search, fit and forecast.

Positions t may be missing. A change (d-th difference) exists where all values it needs do. One
filter serves every order: the companion form of ARMA(p, q), whose state is carried over missing
positions while its variance grows. Without gaps its innovations are the residuals of conditional
least squares with zeros before the start.

Starting values come in closed form (Hannan and Rissanen): autocorrelations give a long
autoregression, its residuals stand in for the shocks, and products of lagged changes and shocks,
summed up once per series, give the coefficients of every (p, q). The filter then judges all
candidates in one pass; Gauss-Newton rounds (``refine``) lead to least squares.

Series are cut into blocks with a warm-up in front (``blocks``), so sums per block add up. What a
block sends to its series is one row of sums, whatever the number of candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.operators.series.blocks import BLOCK, WARM_UP, block_arrays, block_window, own_rows, with_halo
from driftmark.sources.scratch import materialize

MAX_P, MAX_D, MAX_Q = 2, 2, 2
LONG_ORDER = 8
#: Roots of either polynomial stay this far inside; the warm-up is made for it.
LIMIT = 0.99

_DOUBLES = T.ArrayType(T.DoubleType())
_TABLE = T.ArrayType(_DOUBLES)


def _at(x: Column, win, back: int) -> Column:
    """The value ``back`` positions earlier, null if that position is missing.

    It is among the ``back`` rows before, as there is at most one row per position."""
    found = [
        F.when(F.lag("t", i).over(win) == F.col("t") - back, F.lag(x, i).over(win))
        for i in range(1, back + 1)
    ]
    return F.coalesce(*found)


def change_table(
    df: DataFrame, keys: Sequence[str], x: str, differences: Sequence[int], length: int = BLOCK
) -> DataFrame:
    """(keys, d, t, w, full): the changes of every d asked for; d = 0 is the value less the series'
    mean. ``full`` is 1.0 where the change of the largest d is there too, else 0.0.

    Null values are missing positions. t counts from 1 = the first change there could be.
    """
    rows = df.where(F.col(x).isNotNull()).select(*keys, "t", F.col(x).cast("double").alias("_x"))
    mean = rows.groupBy(*keys).agg(F.avg("_x").alias("_mean"))
    rows = rows.join(mean, list(keys))
    most = max(differences)
    win = block_window(keys)
    named = with_halo(rows, before=most + 1, length=length) if most else rows
    steps = {"_w0": F.col("_x") - F.col("_mean")}
    binomial = [1.0]
    for d in range(1, most + 1):
        binomial = [a - b for a, b in zip([*binomial, 0.0], [0.0, *binomial], strict=True)]
        terms = [F.col("_x"), *(_at(F.col("_x"), win, j) for j in range(1, d + 1))]
        steps[f"_w{d}"] = sum((c * b for c, b in zip(terms[1:], binomial[1:], strict=True)), terms[0])
    named = named.withColumns(steps)
    named = own_rows(named) if most else named
    versions = F.array(
        *(
            F.struct(
                F.lit(d).alias("d"),
                (F.col("t") - d).cast("int").alias("t"),
                F.col(f"_w{d}").alias("w"),
                F.col(f"_w{most}").isNotNull().cast("double").alias("full"),
            )
            for d in differences
        )
    )
    return named.select(*keys, F.inline(versions)).where("w IS NOT NULL")


def packed_changes(changes: DataFrame, keys: Sequence[str], length: int = BLOCK) -> DataFrame:
    """(keys, d, start, own, t, w, full): blocks of changes. ``own`` is the first position that is the
    block's own, ``start`` where its warm-up begins."""
    blocks = block_arrays(changes, [*keys, "d"], ["w", "full"], WARM_UP, length)
    own = (F.col("_block") * length + 1).cast("int")
    start = F.greatest(own - WARM_UP, F.lit(1)).cast("int")
    return blocks.select(*keys, "d", "_block", "last_t", start.alias("start"), own.alias("own"), "t", "w", "full")


# The functions that run in Python workers are closures: they travel by value, so a worker needs
# numpy and pandas but not this package.
def _grids():
    """Blocks as rows of one matrix by position, NaN where there is none."""

    def grid(t: pd.Series, w: pd.Series, start: pd.Series) -> np.ndarray:
        sizes = [int(a[-1]) - s + 1 for a, s in zip(t, start, strict=True)]
        out = np.full((len(t), max(sizes, default=0)), np.nan)
        for row, (a, b, s) in enumerate(zip(t, w, start, strict=True)):
            out[row, np.asarray(a, int) - s] = b
        return out

    return grid


def _lag_sums(long: int):
    """UDF: sums and numbers of products w_t w_(t-k), k = 0, ..., long, over own positions."""
    grid = _grids()

    def run(t: pd.Series, w: pd.Series, start: pd.Series, own: pd.Series) -> pd.Series:
        x = grid(t, w, start)
        mine = np.arange(x.shape[1]) >= (own - start).to_numpy()[:, None]
        out = np.zeros((len(x), 2 * long + 2))
        for k in range(long + 1):
            product = x[:, k:] * x[:, : x.shape[1] - k]
            used = mine[:, k:] & ~np.isnan(product)
            out[:, k] = np.where(used, product, 0.0).sum(1)
            out[:, long + 1 + k] = used.sum(1)
        return pd.Series(list(out))

    return F.pandas_udf(run, _DOUBLES)


def _long_autoregression(sums: np.ndarray, last: int, long: int) -> np.ndarray:
    """Yule-Walker coefficients by the recursion of Durbin and Levinson, fewer on few rows."""
    total, pairs = sums[: long + 1], sums[long + 1 :]
    phi = np.zeros(0)
    if total[0] > 0:
        usual = np.arange(last, last - long - 1, -1) / last
        r = np.where(pairs > 0, total / np.maximum(pairs, 1), 0.0) * usual / (total[0] / pairs[0])
        for i in range(1, min(long, int(pairs[0]) // 4) + 1):
            below = 1 - phi @ r[1:i]
            if below <= 1e-9:
                break
            step = (r[i] - phi @ r[i - 1 : 0 : -1]) / below
            phi = np.append(phi - step * phi[::-1], step)
    return np.pad(phi, (0, long - len(phi)))


def _autoregressions(long: int):
    durbin = _long_autoregression

    def run(sums: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([durbin(np.asarray(s), int(n), long) for s, n in zip(sums, last, strict=True)])

    return F.pandas_udf(run, _DOUBLES)


def _design_sums(max_p: int, max_q: int):
    """UDF: sums of the products of (w_t, w_(t-1), ..., e_(t-1), ...), the upper triangle by rows.

    e are the residuals of the long autoregression, a missing term being 0; a row counts where
    w_t and all of its lags are there."""
    grid, width = _grids(), 1 + max_p + max_q
    upper = np.triu_indices(width)

    def run(t: pd.Series, w: pd.Series, start: pd.Series, own: pd.Series, phi: pd.Series) -> pd.Series:
        x = grid(t, w, start)
        there, value = ~np.isnan(x), np.nan_to_num(x)
        n = x.shape[1]
        coefficients = np.array(phi.tolist()).reshape(len(x), -1)

        def back(a, k):
            out = np.zeros_like(a)
            out[:, k:] = a[:, : max(n - k, 0)]
            return out

        e = value.copy()
        for k in range(1, coefficients.shape[1] + 1):
            e -= coefficients[:, k - 1 : k] * back(value, k)
        e *= there
        used = there & (np.arange(n) >= (own - start).to_numpy()[:, None])
        for k in range(1, max_p + 1):
            used &= back(there, k)
        parts = [back(value, k) for k in range(max_p + 1)] + [back(e, k) for k in range(1, max_q + 1)]
        z = np.stack(parts) * used
        return pd.Series(list((z[upper[0]] * z[upper[1]]).sum(2).T))

    return F.pandas_udf(run, _DOUBLES)


def _inside(coefficients: np.ndarray, limit: float) -> bool:
    """Whether 1 - c1 z - c2 z^2 ... has all roots outside the circle of radius 1 / limit."""
    c = np.asarray(coefficients, float) / limit ** np.arange(1, len(coefficients) + 1)
    while len(c):
        last = c[-1]
        if not abs(last) < 1:
            return False
        c = (c[:-1] + last * c[-2::-1]) / (1 - last * last) if len(c) > 1 else c[:0]
    return True


def _candidates(max_p: int, max_q: int, orders: Sequence[tuple[int, int]], limit: float = LIMIT):
    """UDF: per order phi and theta, padded with zeros; NaN where there is no solution or one that
    is not stationary and invertible."""
    inside, width = _inside, 1 + max_p + max_q
    upper = np.triu_indices(width)

    def solved(sums: np.ndarray) -> list[list[float]]:
        m = np.zeros((width, width))
        m[upper] = sums
        m += np.triu(m, 1).T
        out = []
        for p, q in orders:
            use = [*range(1, 1 + p), *range(1 + max_p, 1 + max_p + q)]
            row = np.zeros(max_p + max_q)
            if use:
                a, b = m[np.ix_(use, use)], m[use, 0]
                scale = np.sqrt(np.maximum(a.diagonal(), 1e-300))
                singular = np.linalg.svd(a / np.outer(scale, scale), compute_uv=False)
                c = np.linalg.solve(a, b) if singular[-1] > 1e-10 else np.full(len(use), np.nan)
                row[:p], row[max_p : max_p + q] = c[:p], c[p:]
                if not (np.isfinite(c).all() and inside(c[:p], limit) and inside(-c[p:], limit)):
                    row[:] = np.nan
            out.append(row.tolist())
        return out

    def run(sums: pd.Series) -> pd.Series:
        return pd.Series([solved(np.asarray(s)) for s in sums])

    return F.pandas_udf(run, _TABLE)


def _companion():
    """The filter: blocks and parameter sets step together, position by position."""

    def run(x, phi, theta, visit):
        """x: (blocks, positions); phi, theta: (blocks, sets, any number). ``visit`` gets every
        position with the innovations (NaN where missing) and their variances, in units of that
        of the shocks. Returns the state predicted for the position after the last."""
        blocks, sets = phi.shape[:2]
        size = max(phi.shape[2], theta.shape[2] + 1)
        ar, load = np.zeros((blocks, sets, size)), np.zeros((blocks, sets, size))
        ar[:, :, : phi.shape[2]], load[:, :, 0] = phi, 1.0
        load[:, :, 1 : theta.shape[2] + 1] = theta
        noise = load[..., :, None] * load[..., None, :]
        state, spread = np.zeros((blocks, sets, size)), None
        for i in range(x.shape[1]):
            seen = ~np.isnan(x[:, i])
            error = np.where(seen, x[:, i], np.nan)[:, None] - state[..., 0]
            if spread is None and seen.all():
                # Nothing is unknown but the shock itself.
                visit(i, error, None)
                state = state + load * error[..., None]
            else:
                ahead = noise if spread is None else spread
                variance = ahead[..., 0, 0]
                visit(i, error, variance)
                gain = np.where(seen[:, None, None], ahead[..., :, 0] / variance[..., None], 0.0)
                state = state + gain * np.nan_to_num(error)[..., None]
                left = ahead - gain[..., :, None] * ahead[..., None, 0, :]
                # One step on: T P T' + R R', T = (ar | shifted identity).
                moved = ar[..., :, None] * left[..., None, 0, :]
                moved[..., :-1, :] += left[..., 1:, :]
                turned = moved[..., :, 0][..., None] * ar[..., None, :]
                turned[..., :, :-1] += moved[..., :, 1:]
                spread = turned + noise
                if np.abs(turned).max() < 1e-18:
                    spread = None
            following = ar * state[..., :1]
            following[..., :-1] += state[..., 1:]
            state = following
        return state

    return run


def _judged(max_p: int, first: int):
    """UDF: per parameter set (n, sum of squares, sum of log variances, state after the end).

    Own positions from ``first`` - d on count, if ``full``: with gaps, too, every d is judged by the
    same rows. All blocks of a batch run to the longest one's end;
    the state is taken at each one's own end."""
    grid, companion = _grids(), _companion()

    def run(
        t: pd.Series, w: pd.Series, full: pd.Series, start: pd.Series, own: pd.Series, d: pd.Series, sets: pd.Series
    ) -> pd.Series:
        out = [None] * len(t)
        # Blocks of like length run together.
        sizes = np.array([int(a[-1]) - s + 1 for a, s in zip(t, start, strict=True)])
        order = np.argsort(sizes, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            if not len(part):
                continue
            x = grid(t.iloc[part], w.iloc[part], start.iloc[part])
            counts = grid(t.iloc[part], full.iloc[part], start.iloc[part]) > 0
            parameters = np.array([np.stack(s) for s in sets.iloc[part]], float)
            since = np.maximum(own.iloc[part], first - d.iloc[part]).to_numpy() - start.iloc[part].to_numpy()
            n, squares, logs = np.zeros((3, *parameters.shape[:2]))

            def visit(i, error, variance):
                used = (counts[:, i] & (i >= since))[:, None]
                square = error * error if variance is None else error * error / variance
                n[:] += used
                squares[:] += np.where(used, square, 0.0)
                if variance is not None:
                    logs[:] += np.where(used, np.log(variance), 0.0)

            with np.errstate(invalid="ignore"):
                state = companion(x, parameters[..., :max_p], parameters[..., max_p:], visit)
            table = np.concatenate((n[..., None], squares[..., None], logs[..., None], state), axis=2)
            for place, rows in zip(part, table, strict=True):
                out[place] = rows.tolist()
        return pd.Series(out)

    return F.pandas_udf(run, _TABLE)


def _summed(df: DataFrame, by: Sequence[str], name: str, size: int, *more: Column) -> DataFrame:
    """Lists of ``size`` numbers added up element by element: one row per block is shuffled."""
    sums = [F.sum(F.get(name, F.lit(i))).alias(f"_s{i}") for i in range(size)]
    out = df.groupBy(*by).agg(*sums, *more)
    kept = [c for c in out.columns if not c.startswith("_s")]
    return out.select(*kept, F.array(*(F.col(f"_s{i}") for i in range(size))).alias(name))


def starting_values(
    blocks: DataFrame,
    keys: Sequence[str],
    orders: Sequence[tuple[int, int]],
    max_p: int,
    max_q: int,
    long: int = LONG_ORDER,
) -> DataFrame:
    """(keys, d, sets): per order the coefficients (phi..., theta...) by two regressions."""
    by = [*keys, "d"]
    products = blocks.select(*by, "last_t", _lag_sums(long)("t", "w", "start", "own").alias("s"))
    whole = _summed(products, by, "s", 2 * long + 2, F.max("last_t").alias("last"))
    first = whole.select(*by, _autoregressions(long)("s", "last").alias("long"))
    width = 1 + max_p + max_q
    designs = blocks.join(first, by).select(
        *by, _design_sums(max_p, max_q)("t", "w", "start", "own", "long").alias("s")
    )
    whole = _summed(designs, by, "s", width * (width + 1) // 2)
    return whole.select(*by, _candidates(max_p, max_q, orders)("s").alias("sets"))


def judge(
    blocks: DataFrame, sets: DataFrame, keys: Sequence[str], n_sets: int, max_p: int, max_q: int, first: int
) -> DataFrame:
    """(keys, d, place, parameters, n, sse, logs, state): what the filter says of every set."""
    by, size = [*keys, "d"], max(max_p, max_q + 1)
    told = blocks.join(sets, by).select(
        *by, "_block", "sets", _judged(max_p, first)("t", "w", "full", "start", "own", "d", "sets").alias("r")
    )
    flat = [F.sum(F.get(F.get("r", F.lit(i)), F.lit(j))).alias(f"_{i}_{j}") for i in range(n_sets) for j in range(3)]
    whole = told.groupBy(*by).agg(*flat, F.max_by("r", "_block").alias("_end"), F.first("sets").alias("_sets"))
    rows = F.array(
        *(
            F.struct(
                F.lit(i).alias("place"),
                F.get("_sets", F.lit(i)).alias("parameters"),
                F.col(f"_{i}_0").cast("long").alias("n"),
                F.col(f"_{i}_1").alias("sse"),
                F.col(f"_{i}_2").alias("logs"),
                F.slice(F.get("_end", F.lit(i)), 4, size).alias("state"),
            )
            for i in range(n_sets)
        )
    )
    return whole.select(*by, F.inline(rows))


def _criteria() -> dict[str, Column]:
    n, k = F.col("n"), F.col("p") + F.col("q") + 1
    sigma2 = F.col("sse") / F.nullif(n, F.lit(0))
    enough = n > k + 1
    fit = F.when(enough & (sigma2 > 0), n * (F.ln(2 * F.lit(np.pi) * sigma2) + 1) + F.col("logs")).when(
        enough & (sigma2 == 0), F.lit(float("-inf"))
    )
    return {
        "sigma2": sigma2,
        "loglik": -fit / 2,
        "aic": fit + 2 * k,
        "aicc": fit + 2 * k + 2 * k * (k + 1) / F.when(enough, n - k - 1),
        "bic": fit + k * F.ln(n.cast("double")),
    }


FIT_COLUMNS = ("p", "d", "q", "n", "phi", "theta", "sigma2", "loglik", "aic", "aicc", "bic", "state", "mean")


def candidates(
    df: DataFrame,
    keys: Sequence[str],
    x: str = "x",
    max_p: int = MAX_P,
    differences: Sequence[int] = tuple(range(MAX_D + 1)),
    max_q: int = MAX_Q,
    long: int = LONG_ORDER,
    length: int = BLOCK,
) -> DataFrame:
    """(keys, p, d, q, n, phi, theta, sigma2, loglik, aic, aicc, bic, state): all orders up to the
    limits that have a stationary and invertible solution.

    All are judged on the positions from max(p) + max(d) + 1 on that have a change of the largest d (with
    gaps, the other d have more). The criteria are null where a series has
    no more than p + q + 2 of them; where an order describes it without error they are -infinity.
    """
    orders = [(p, q) for p in range(max_p + 1) for q in range(max_q + 1)]
    changes = change_table(df, keys, x, differences, length)
    blocks = materialize(packed_changes(changes, keys, length), "change-blocks")
    sets = starting_values(blocks, keys, orders, max_p, max_q, long)
    first = max_p + max(differences) + 1
    judged = judge(blocks, sets, keys, len(orders), max_p, max_q, first)
    order = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in orders))
    rows = judged.withColumn("_o", F.get(order, F.col("place"))).select(
        *keys,
        "_o.p",
        "d",
        "_o.q",
        "n",
        F.slice("parameters", F.lit(1), F.col("_o.p")).alias("phi"),
        F.slice("parameters", F.lit(max_p + 1), F.col("_o.q")).alias("theta"),
        "sse",
        "logs",
        "state",
    )
    # Arrow may hand a NaN over as a null.
    rows = rows.where(F.col("sse").isNotNull() & ~F.isnan("sse")).withColumns(_criteria())
    return rows.select(*keys, *(c for c in FIT_COLUMNS if c != "mean"))


def select_order(
    df: DataFrame, keys: Sequence[str], x: str = "x", criterion: str = "aicc", **limits
) -> DataFrame:
    """One row per series of ``df``: the candidate with the least criterion per counted row, ties to
    the smaller d, then p, then q. ``limits``: see ``candidates``.

    A series too short for any gets order (0, 0, 0) with null criteria. ``mean`` is the mean of
    the series, which d = 0 takes out.
    """
    found = candidates(df, keys, x, **limits).where(F.col(criterion).isNotNull())
    columns = [c for c in FIT_COLUMNS if c != "mean"]
    worth = F.struct((F.col(criterion) / F.col("n")).alias("c"), "d", "p", "q")
    best = found.groupBy(*keys).agg(F.min_by(F.struct(*columns), worth).alias("b"))
    series = df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.count(x).alias("_n"))
    none = F.array().cast("array<double>")
    return (
        series.join(best, list(keys), "left")
        .select(*keys, "mean", "_n", "b.*")
        .withColumns(
            {c: F.coalesce(c, F.lit(0)) for c in ("p", "d", "q")}
            | {"n": F.coalesce("n", F.lit(0).cast("long"))}
            | {c: F.coalesce(c, none) for c in ("phi", "theta", "state")}
        )
        .select(*keys, *FIT_COLUMNS)
    )


def _slopes(max_p: int, max_q: int, first: int, width: float = 1e-5):
    """UDF: (n, squares, log variances), the slopes of the last two, the curvature of the squares,
    and the state after the end, one after the other. Slopes are differences at parameters a little
    to either side."""
    grid, companion, k = _grids(), _companion(), max_p + max_q

    def run(
        t: pd.Series, w: pd.Series, full: pd.Series, start: pd.Series, own: pd.Series, d: pd.Series, at: pd.Series
    ) -> pd.Series:
        out = [None] * len(t)
        sizes = np.array([int(a[-1]) - s + 1 for a, s in zip(t, start, strict=True)])
        order = np.argsort(sizes, kind="stable")
        steps = width * np.vstack([np.zeros(k), np.eye(k), -np.eye(k)])
        for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            if not len(part):
                continue
            x = grid(t.iloc[part], w.iloc[part], start.iloc[part])
            counts = grid(t.iloc[part], full.iloc[part], start.iloc[part]) > 0
            centre = np.array([np.asarray(a, float) for a in at.iloc[part]]).reshape(len(part), k)
            sets = centre[:, None] + steps
            since = np.maximum(own.iloc[part], first - d.iloc[part]).to_numpy() - start.iloc[part].to_numpy()
            sums, gradient = np.zeros((len(part), 3)), np.zeros((len(part), 2 * k))
            curvature = np.zeros((len(part), k, k))

            def visit(i, error, variance):
                used = counts[:, i] & (i >= since)
                if not used.any():
                    return
                v = error[used] if variance is None else error[used] / np.sqrt(variance[used])
                slope = (v[:, 1 : k + 1] - v[:, k + 1 :]) / (2 * width)
                sums[used, 0] += 1
                sums[used, 1] += v[:, 0] ** 2
                gradient[used, :k] += slope * v[:, :1]
                if variance is not None:
                    logs = np.log(variance[used])
                    sums[used, 2] += logs[:, 0]
                    gradient[used, k:] += (logs[:, 1 : k + 1] - logs[:, k + 1 :]) / (2 * width)
                curvature[used] += slope[:, :, None] * slope[:, None]

            state = companion(x, sets[..., :max_p], sets[..., max_p:], visit)
            table = np.hstack([sums, gradient, curvature.reshape(len(part), -1), state[:, 0]])
            for place, row in zip(part, table, strict=True):
                out[place] = row
        return pd.Series(out)

    return F.pandas_udf(run, _DOUBLES)


def _stepped(max_p: int, max_q: int, limit: float = LIMIT):
    """UDF: one decision of the search. Takes the best parameters, their worth, the direction and
    the length tried, and the sums at the parameters tried; gives the same again, with the parameters to
    try next and, for the best ones, (n, sse, logs, standard errors, state)."""
    inside, k = _inside, max_p + max_q

    def decide(best, worth, direction, share, tried, sums, used, told):
        n, sse, logs = sums[:3]
        value = n * np.log(sse / n) + logs if n and sse > 0 else (-np.inf if n else np.inf)
        if not worth <= value:
            curvature = sums[3 + 2 * k : 3 + 2 * k + k * k].reshape(k, k)[np.ix_(used, used)]
            direction, errors = np.zeros(k), np.full(k, np.nan)
            if used.any() and np.isfinite(curvature).all() and sse > 0:
                scale = np.sqrt(np.maximum(curvature.diagonal(), 1e-300))
                inverse = np.linalg.pinv(curvature / np.outer(scale, scale)) / np.outer(scale, scale)
                # The slope of n ln(sse) + logs, in units of the squares.
                slope = sums[3 : 3 + k] + sse / (2 * n) * sums[3 + k : 3 + 2 * k]
                direction[used] = -inverse @ slope[used]
                errors[used] = np.sqrt(np.maximum(inverse.diagonal(), 0.0) * sse / n)
            told = np.concatenate((sums[:3], errors, sums[3 + 2 * k + k * k :]))
            best, worth, share = tried, value, 1.0
        else:
            share /= 4
        following = best + share * direction
        for _ in range(30):
            if inside(following[:max_p], limit) and inside(-following[max_p:], limit):
                break
            share /= 2
            following = best + share * direction
        else:
            following = best
        return best, worth, direction, share, following, told

    def run(state: pd.DataFrame, sums: pd.Series, p: pd.Series, q: pd.Series) -> pd.DataFrame:
        rows = []
        places = np.arange(k)
        for i, (s, a, b) in enumerate(zip(sums, p, q, strict=True)):
            used = np.where(places < max_p, places < a, places - max_p < b)
            one = state.iloc[i]
            lists = [np.asarray(one[c], float) for c in ("best", "direction", "tried", "told")]
            best, direction, tried, told = lists
            rows.append(decide(best, one["worth"], direction, one["share"], tried, np.asarray(s), used, told))
        return pd.DataFrame(rows, columns=["best", "worth", "direction", "share", "tried", "told"])

    number = {"worth", "share"}
    names = ("best", "worth", "direction", "share", "tried", "told")
    kind = T.StructType([T.StructField(c, T.DoubleType() if c in number else _DOUBLES) for c in names])
    return F.pandas_udf(run, kind)


def refine(
    df: DataFrame,
    fits: DataFrame,
    keys: Sequence[str],
    x: str = "x",
    rounds: int = 8,
    length: int = BLOCK,
) -> DataFrame:
    """The fits after Gauss-Newton rounds towards least squares (greatest likelihood, with gaps), and
    ``se``: the standard errors of phi, then theta.

    A round is one pass over the series and one row of sums per block; a step that makes the fit
    worse is tried again at a quarter of its length. Rows count from p + d + 1 of the largest order
    on. A series without changes keeps its row as it is.
    """
    most = fits.agg(F.max("p"), F.max("q"), F.max("d"), F.collect_set("d")).first()
    max_p, max_q, max_d = (v or 0 for v in most[:3])
    k, size = max_p + max_q, max(max_p, max_q + 1)
    by, first = [*keys, "d"], max_p + max_d + 1
    changes = change_table(df, keys, x, sorted(most[3]) or [0], length)
    blocks = materialize(packed_changes(changes, keys, length).join(fits.select(*by), by), "change-blocks")

    def padded(c: str, n: int) -> Column:
        return F.slice(F.concat(c, F.array_repeat(F.lit(0.0), n)), 1, n)

    tried = F.concat(padded("phi", max_p), padded("theta", max_q))
    none, zeros = F.array().cast("array<double>"), F.array_repeat(F.lit(0.0), k)
    state = fits.select(
        *by,
        "p",
        "q",
        F.struct(
            tried.alias("best"),
            F.lit(float("inf")).alias("worth"),
            zeros.alias("direction"),
            F.lit(1.0).alias("share"),
            tried.alias("tried"),
            none.alias("told"),
        ).alias("s"),
    )
    for _ in range(rounds + 1):
        rows = blocks.join(state.select(*by, F.col("s.tried").alias("_at")), by)
        told = rows.select(*by, "_block", _slopes(max_p, max_q, first)("t", "w", "full", "start", "own", "d", "_at").alias("r"))
        width = 3 + 2 * k + k * k
        sums = _summed(told, by, "r", width, F.max_by("r", "_block").alias("_end")).select(
            *by, F.concat("r", F.slice("_end", F.lit(width + 1), F.lit(size))).alias("_sums")
        )
        state = materialize(
            state.join(sums, by).select(*by, "p", "q", _stepped(max_p, max_q)("s", "_sums", "p", "q").alias("s")),
            "arma-search",
        )
    told = F.col("s.told")
    found = state.where(F.size(told) > 0).select(
        *by,
        F.struct(
            F.get(told, F.lit(0)).cast("long").alias("n"),
            F.slice("s.best", F.lit(1), F.col("p")).alias("phi"),
            F.slice("s.best", F.lit(max_p + 1), F.col("q")).alias("theta"),
            F.get(told, F.lit(1)).alias("sse"),
            F.get(told, F.lit(2)).alias("logs"),
            F.concat(
                F.slice(told, F.lit(4), F.col("p")), F.slice(told, F.lit(4 + max_p), F.col("q"))
            ).alias("se"),
            F.slice(told, F.lit(4 + k), F.lit(size)).alias("state"),
        ).alias("_f"),
    )
    kept = fits.join(found, by, "left")
    new = kept.where("_f IS NOT NULL").select(*by, "p", "q", "mean", "_f.*").withColumns(_criteria())
    old = kept.where("_f IS NULL").withColumn("se", none)
    columns = [*keys, *FIT_COLUMNS, "se"]
    return new.select(*columns).unionByName(old.select(*columns))


def _tail(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """(keys, x_last, slope): the last value, and the mean change per position since the one before.

    Ranks up to 2 are cut off before the shuffle, so two rows per series and task travel."""
    late = Window.partitionBy(*keys).orderBy(F.col("t").desc())
    two = (
        df.where(F.col(x).isNotNull())
        .select(*keys, "t", F.col(x).cast("double").alias("_x"))
        .withColumn("_i", F.row_number().over(late))
        .where("_i <= 2")
    )
    last, before = (F.max(F.when(F.col("_i") == i, F.struct("t", "_x"))) for i in (1, 2))
    ends = two.groupBy(*keys).agg(last.alias("_a"), before.alias("_b"))
    slope = (F.col("_a._x") - F.col("_b._x")) / (F.col("_a.t") - F.col("_b.t"))
    return ends.select(*keys, F.col("_a._x").alias("x_last"), slope.alias("slope"))


def forecast(
    df: DataFrame,
    fits: DataFrame,
    keys: Sequence[str],
    x: str = "x",
    steps: int = 6,
    z: float = 1.959963984540054,
) -> DataFrame:
    """(keys, h, forecast, se, low, high) from the fits of ``select_order`` or ``refine``, each of its
    own order.

    Changes go on by the companion form and are added up once per difference, from the last value
    (and the last slope, for d = 2; d is 2 at most). The error is that of the coming shocks, weighted by
    the response to a unit shock, which is added up as often.
    """
    phi, theta, d = F.col("phi"), F.col("theta"), F.col("d")
    zero = F.lit(0.0)

    def advanced(state: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size("state") - 1, F.lit(0)))
        return F.transform(
            places,
            lambda i: F.coalesce(F.get(phi, i), zero) * F.coalesce(F.get(state, F.lit(0)), zero)
            + F.coalesce(F.get(state, i + 1), zero),
        )

    def run(state: Column) -> Column:
        empty = F.array().cast("array<double>")
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)),
            F.struct(state.alias("a"), empty.alias("w")),
            lambda s, _: F.struct(
                advanced(s["a"]).alias("a"),
                F.array_append(s["w"], F.coalesce(F.get(s["a"], F.lit(0)), zero)).alias("w"),
            ),
            lambda s: s["w"],
        )

    def added(values: Column, start: Column) -> Column:
        return F.aggregate(
            values,
            F.array().cast("array<double>"),
            lambda s, v: F.array_append(s, v + F.when(F.size(s) > 0, F.element_at(s, -1)).otherwise(start)),
        )

    # A unit shock: state (1, theta...) at its own position.
    places = F.sequence(F.lit(0), F.greatest(F.size("state") - 1, F.lit(0)))
    shock = F.transform(
        places, lambda i: F.when(i == 0, F.lit(1.0)).otherwise(F.coalesce(F.get(theta, i - 1), zero))
    )
    rows = fits.join(_tail(df, keys, x), list(keys), "left").withColumns(
        {"_w": run(F.col("state")), "_r": run(shock)}
    )
    once = added(F.col("_w"), F.when(d == 2, F.coalesce("slope", zero)).otherwise(F.col("x_last")))
    level = (
        F.when(d == 0, F.transform("_w", lambda w: w + F.col("mean")))
        .when(d == 1, once)
        .otherwise(added(once, F.col("x_last")))
    )
    response = (
        F.when(d == 0, F.col("_r"))
        .when(d == 1, added(F.col("_r"), zero))
        .otherwise(added(added(F.col("_r"), zero), zero))
    )
    variance = added(F.transform("_psi", lambda r: r * r), zero)
    lists = rows.withColumns({"_level": level, "_psi": response}).select(
        *keys, "sigma2", F.posexplode(F.arrays_zip("_level", variance.alias("v"))).alias("at", "row")
    )
    se = F.sqrt(F.col("sigma2") * F.col("row.v"))
    ahead = F.col("row._level")
    return lists.select(
        *keys,
        (F.col("at") + 1).alias("h"),
        ahead.alias("forecast"),
        se.alias("se"),
        (ahead - z * se).alias("low"),
        (ahead + z * se).alias("high"),
    )
