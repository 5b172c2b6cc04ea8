"""Series operators: against plain Python, across block borders, and as identities."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.operators.series import acf as A
from driftmark.operators.series import arima, holt, index, outliers, trend
from driftmark.operators.series import decompose as D
from driftmark.operators.series import diff as X
from driftmark.operators.series.blocks import WARM_UP, with_halo

KEY = ["k"]
SHORT = 40  # block length that cuts the fixtures into many blocks


def _walk(n, seed, base=50.0):
    rng = random.Random(seed)
    x, out = base, []
    for t in range(n):
        x += rng.gauss(0.1, 1.0)
        out.append(x + 3.0 * math.sin(2 * math.pi * t / 12))
    return out


@pytest.fixture(scope="module")
def values():
    # One series is far longer than the others.
    return {"long": _walk(600, 1), "mid": _walk(90, 2), "tiny": _walk(10, 3)}


@pytest.fixture(scope="module")
def series(spark, values):
    rows = [(k, t, (t - 1) % 12, x) for k, v in values.items() for t, x in enumerate(v, 1)]
    return spark.createDataFrame(rows, "k string, t int, cycle int, x double").cache()


def _by_key(df, col):
    out = {}
    for r in df.collect():
        out.setdefault(r.k, {})[r.t] = r[col]
    return out


def test_halo_covers_every_window(spark):
    df = spark.range(1, 101).select(F.lit("k").alias("k"), F.col("id").cast("int").alias("t"))
    rows = with_halo(df, before=3, after=2, length=10).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r._block, set()).add(r.t)
    for r in rows:
        if r._own:
            need = set(range(max(1, r.t - 3), min(100, r.t + 2) + 1))
            assert need <= seen[r._block]
    assert sorted(r.t for r in rows if r._own) == list(range(1, 101))
    with pytest.raises(ValueError):
        with_halo(df, before=10, length=10)


@pytest.mark.parametrize(("lag", "times"), [(1, 1), (1, 2), (3, 1), (3, 2)])
def test_diff(series, values, lag, times):
    got = _by_key(X.diff(series, KEY, lag=lag, times=times, length=SHORT), "d")
    for k, v in values.items():
        want = np.array(v)
        for _ in range(times):
            want = want[lag:] - want[:-lag]
        have = [got[k][t] for t in sorted(got[k])]
        assert have == pytest.approx(list(want), abs=1e-9)


def test_diff_then_cumulative_sum_restores_the_series(series, values):
    got = _by_key(X.diff(series, KEY, length=SHORT), "d")
    for k, v in values.items():
        x = v[0]
        for t in range(2, len(v) + 1):
            x += got[k][t]
            assert x == pytest.approx(v[t - 1])


def _acf(v, k):
    a = np.array(v) - np.mean(v)
    return float((a[k:] * a[:-k]).sum() / (a * a).sum())


def test_acf_and_pacf(series, values):
    table = A.acf(series, KEY, max_lag=12, length=SHORT)
    got = {(r.k, r.lag): r for r in table.collect()}
    assert {k for k, _ in got if k == "tiny"} and ("tiny", 10) not in got
    for (k, lag), r in got.items():
        assert r.r == pytest.approx(_acf(values[k], lag))
        assert r.band == pytest.approx(1.96 / math.sqrt(len(values[k])))
    partial = {(r.k, r.lag): r.partial for r in A.pacf(table, KEY).collect()}
    for k in ("long", "mid"):
        for lag in range(1, 13):
            # Last coefficient of the Yule-Walker system of that size.
            r = [1.0] + [_acf(values[k], i) for i in range(1, lag + 1)]
            toeplitz = np.array([[r[abs(i - j)] for j in range(lag)] for i in range(lag)])
            want = np.linalg.solve(toeplitz, np.array(r[1:]))[-1]
            assert partial[k, lag] == pytest.approx(want, abs=1e-9)


def test_constant_series_has_no_autocorrelation(spark):
    df = spark.range(1, 20).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.lit(2.0).alias("x"))
    assert {r.r for r in A.acf(df, KEY, max_lag=3).collect()} == {None}


@pytest.mark.parametrize("frequency", [12, 7])
def test_decomposition_adds_up_and_ignores_block_borders(series, values, frequency):
    df = series.withColumn("cycle", (F.col("t") - 1) % frequency)
    cut = D.decompose_additive(df, KEY, frequency, length=SHORT)
    whole = D.decompose_additive(df, KEY, frequency)
    for col in ("trend", "seasonal", "remainder"):
        a, b = _by_key(cut, col), _by_key(whole, col)
        for k in a:
            for t in a[k]:
                assert (a[k][t] is None) == (b[k][t] is None)
                assert a[k][t] is None or a[k][t] == pytest.approx(b[k][t], abs=1e-9)
    rows = whole.collect()
    half = frequency // 2
    for r in rows:
        n = len(values[r.k])
        inner = half < r.t <= n - half and n >= 2 * frequency
        assert (r.trend is not None) == inner
        if inner:
            assert r.trend + r.seasonal + r.remainder == pytest.approx(r.x)
    season = {r.cycle: r.seasonal for r in rows if r.k == "long"}
    assert sum(season.values()) == pytest.approx(0.0, abs=1e-9)


def test_local_line_keeps_straight_lines(spark):
    df = spark.range(1, 200).select(
        F.lit("k").alias("k"), F.col("id").cast("int").alias("t"), (F.col("id") * 2.0 + 1).alias("x")
    )
    got = D.local_linear(df, KEY, "x", 5, "fit", length=SHORT).collect()
    assert len(got) == 199
    assert all(r.fit == pytest.approx(r.x) for r in got)


def test_season_trend_finds_the_season(spark):
    rows = [("k", t, (t - 1) % 4, 10.0 + 0.5 * t + [3, -1, -4, 2][(t - 1) % 4]) for t in range(1, 81)]
    df = spark.createDataFrame(rows, "k string, t int, cycle int, x double")
    got = D.season_trend(df, KEY, 6, passes=3, length=SHORT).collect()
    assert all(r.trend + r.seasonal + r.remainder == pytest.approx(r.x) for r in got)
    season = {r.cycle: r.seasonal for r in got}
    assert [season[i] for i in range(4)] == pytest.approx([3, -1, -4, 2], abs=0.2)


def test_trend_line(series, values):
    fit = trend.ols_fit(series, KEY, "x", "t")
    for r in fit.collect():
        v = values[r.k]
        slope, intercept = np.polyfit(range(1, len(v) + 1), v, 1)
        assert (r.slope, r.intercept) == pytest.approx((slope, intercept))
    predicted = trend.ols_predict(series, fit, KEY, "t").where("k = 'mid' and t = 1").first()
    assert predicted.predicted == pytest.approx(
        np.polyval(np.polyfit(range(1, 91), values["mid"], 1), 1)
    )


def _css(v, p, d, q, start, theta, phi):
    w = np.array(v)
    for _ in range(d):
        w = np.diff(w)
    w = dict(enumerate(w, d + 1))
    e, out = 0.0, []
    for t in range(start, len(v) + 1):
        e = w[t] - (phi * w[t - 1] if p else 0.0) - theta * e
        out.append(e)
    return out


@pytest.mark.parametrize("order", [(1, 1, 0), (0, 1, 1), (1, 1, 1), (1, 2, 1)])
def test_arima_fit_is_the_best_of_the_grid(series, values, order):
    p, d, q = order
    got = {r.k: r for r in arima.fit(series, KEY, order=order).collect()}
    for k in ("mid", "tiny"):
        r = got[k]
        errors = _css(values[k], p, d, q, d + p + 1, r.theta, r.phi)
        assert r.n == len(errors)
        assert r.sse == pytest.approx(sum(e * e for e in errors))
        assert r.e_last == pytest.approx(errors[-1])
        for theta in np.arange(-99, 100, 11) / 100 if q else [0.0]:
            for phi in np.arange(-9, 10) / 10 if p else [0.0]:
                other = _css(values[k], p, d, q, d + p + 1, theta, phi)
                assert sum(e * e for e in other) >= r.sse - 1e-9


def test_fits_do_not_depend_on_blocks(spark):
    rng = random.Random(5)
    x, rows = 100.0, []
    for t in range(1, 12001):
        x += rng.gauss(0, 1)
        rows.append(("k", t, x + rng.gauss(0, 0.5)))
    df = spark.createDataFrame(rows, "k string, t int, x double").cache()
    length = WARM_UP + 800
    for order in ((0, 1, 1), (1, 1, 1)):
        cut = arima.fit(df, KEY, order=order, length=length).first()
        whole = arima.fit(df, KEY, order=order).first()
        assert (cut.n, cut.phi, cut.theta) == pytest.approx((whole.n, whole.phi, whole.theta))
        assert (cut.sse, cut.e_last) == pytest.approx((whole.sse, whole.e_last), rel=1e-9)
    fits = arima.fit(df, KEY, order=(0, 1, 1))
    a = _by_key(arima.residuals(df, fits, KEY, order=(0, 1, 1), length=length), "x")["k"]
    b = _by_key(arima.residuals(df, fits, KEY, order=(0, 1, 1)), "x")["k"]
    assert a.keys() == b.keys()
    assert [a[t] for t in sorted(a)] == pytest.approx([b[t] for t in sorted(b)], abs=1e-9)
    cut, whole = holt.fit(df, KEY, length=length).first(), holt.fit(df, KEY).first()
    assert (cut.alpha, cut.beta) == (whole.alpha, whole.beta)
    assert (cut.sse, cut.level, cut.slope) == pytest.approx(
        (whole.sse, whole.level, whole.slope), rel=1e-9
    )


def test_residuals_and_forecast(series, values):
    order = (1, 1, 1)
    fits = arima.fit(series, KEY, order=order).cache()
    left = _by_key(arima.residuals(series, fits, KEY, order=order), "x")
    ahead = {(r.k, r.h): r.forecast for r in arima.forecast(series, fits, KEY, "x", 4).collect()}
    for r in fits.collect():
        v = values[r.k]
        want = _css(v, 1, 1, 1, 3, r.theta, r.phi)
        assert [left[r.k][t] for t in sorted(left[r.k])] == pytest.approx(want)
        w, e, x = v[-1] - v[-2], want[-1], v[-1]
        for h in range(1, 5):
            w, e = r.phi * w + r.theta * e, 0.0
            x += w
            assert ahead[r.k, h] == pytest.approx(x)


def test_z_test_uses_the_normal_distribution(series):
    rows = arima.z_test(arima.fit(series, KEY, order=(1, 1, 1)), KEY).collect()
    assert {r.term for r in rows} == {"ar1", "ma1"}
    for r in rows:
        if r.z is not None:
            assert r.z == pytest.approx(r.estimate / r.std_error)
            assert r.p_value == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), abs=2e-7)


def test_order_selection_prefers_the_true_difference(spark):
    rng = random.Random(9)
    walk, noise = 0.0, []
    rows = []
    for t in range(1, 301):
        walk += rng.gauss(0, 1)
        noise.append(rng.gauss(0, 1))
        rows += [("walk", t, walk), ("noise", t, noise[-1])]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    got = {r.k: r for r in arima.select_order(df, KEY).collect()}
    assert got["noise"].d == 0
    assert got["walk"].d == 1 or got["walk"].phi > 0.9


def _holt(v, alpha, beta):
    level, slope, sse = v[1], v[1] - v[0], 0.0
    for x in v[2:]:
        error = x - level - slope
        sse += error * error
        new = alpha * x + (1 - alpha) * (level + slope)
        slope = beta * (new - level) + (1 - beta) * slope
        level = new
    return sse, level, slope


def test_holt(series, values):
    for r in holt.fit(series, KEY).collect():
        sse, level, slope = _holt(values[r.k], r.alpha, r.beta)
        assert (r.sse, r.level, r.slope) == pytest.approx((sse, level, slope))
        assert all(_holt(values[r.k], a, b)[0] >= r.sse - 1e-9 for a, b in holt.GRID[::7])
    ahead = holt.forecast(holt.fit(series, KEY), KEY, 3).where("k = 'mid'").collect()
    assert sorted(r.t for r in ahead) == [91, 92, 93]


def test_cleaning_removes_spikes_and_fills_gaps(spark):
    rows = []
    for t in range(1, 201):
        x = 10.0 + 0.1 * t + (0.5 if t % 2 else -0.5)
        if t in (57, 120):
            x += 500
        rows.append(("k", t, None if 90 <= t <= 95 or t in (1, 2, 200) else x))
    df = spark.createDataFrame(rows, "k string, t int, x double")
    for length in (SHORT, 10, 16384):
        found = outliers.outliers(df, KEY, half=3, length=length).collect()
        assert {r.t for r in found} == {57, 120}
        got = _by_key(outliers.clean(df, KEY, half=3, length=length), "cleaned")["k"]
        assert len(got) == 200
        for t in range(3, 200):
            assert got[t] == pytest.approx(10.0 + 0.1 * t, abs=0.6)
        assert got[1] == got[2] == got[3]
        assert got[200] == got[199]


def test_interpolation_bridges_whole_empty_blocks(spark):
    rows = [("k", t, float(t) if t in (5, 95) else None) for t in range(1, 101)]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    got = _by_key(outliers.interpolate(df, KEY, "x", "y", length=10), "y")["k"]
    for t in range(1, 101):
        assert got[t] == pytest.approx(min(95, max(5, t)))


def test_regular_series_fills_the_calendar(spark):
    df = spark.createDataFrame(
        [("a", "2014-11-30", 5), ("a", "2015-02-28", 7), ("b", "2015-01-31", 1)],
        "k string, day string, n int",
    ).withColumn("day", F.col("day").cast("date"))
    rows = index.regular_series(df, KEY, "day", "n").orderBy("k", "t").collect()
    got = [(r.k, r.t, r.cycle, str(r.period), r.x) for r in rows]
    assert got == [
        ("a", 1, 0, "2014-11-30", 5.0),
        ("a", 2, 1, "2014-12-31", 0.0),
        ("a", 3, 2, "2015-01-31", 0.0),
        ("a", 4, 3, "2015-02-28", 7.0),
        ("b", 1, 0, "2015-01-31", 1.0),
    ]


def test_head_tail(series, values):
    head, tail = index.head_tail(series, KEY, 5)
    assert head.count() + tail.count() == sum(map(len, values.values()))
    assert {r.k: r.n for r in tail.groupBy("k").agg(F.count("*").alias("n")).collect()} == {
        k: 5 for k in values
    }


def test_logs_of_non_positive_values_are_null(spark):
    df = spark.createDataFrame([(100.0,), (0.0,), (-1.0,)], "x double")
    assert [r.x for r in X.logged(df, "x", base10=True).collect()] == [2.0, None, None]


def test_short_series_keep_their_row(spark):
    rows = [("long", t, float(t * t % 7)) for t in range(1, 30)] + [("short", 1, 1.0), ("short", 2, 2.0)]
    df = spark.createDataFrame(rows, "k string, t long, x double")
    for order in ((1, 1, 0), (1, 1, 1), (0, 1, 1)):
        got = {r.k: r for r in arima.fit(df, KEY, order=order).collect()}
        assert set(got) == {"long", "short"} and got["long"].sse is not None
        assert got["short"].p == order[0] and (order[0] == 0 or got["short"].phi is None)


def test_interpolation_on_every_row(spark):
    rows = [("k", t, None if t % 4 else float(3 * t)) for t in range(1, 200)]
    df = spark.createDataFrame(rows, "k string, t long, x double")
    for length in (7, 50, 1000):
        got = _by_key(outliers.interpolate(df, KEY, "x", "y", length=length), "y")["k"]
        want = {t: min(max(t, 4), 196) * 3.0 for t in range(1, 200)}
        assert got == pytest.approx(want)
