"""General ARIMA: order search, gaps, refinement and forecasts, against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.operators.series import arima, arma
from driftmark.operators.series.blocks import WARM_UP

KEY = ["k"]


def simulated(n, phi, theta, d, seed):
    e = np.random.default_rng(seed).standard_normal(n + 200)
    w = np.zeros(n + 200)
    for t in range(2, n + 200):
        w[t] = e[t] + sum(c * w[t - 1 - i] for i, c in enumerate(phi)) + sum(c * e[t - 1 - j] for j, c in enumerate(theta))
    w = w[200:]
    for _ in range(d):
        w = np.cumsum(w)
    return w


KNOWN = {
    "arma21": ((1.1, -0.5), (0.4,), 0),
    "ima11": ((), (0.6,), 1),
    "ari12": ((0.6,), (), 2),
    "white": ((), (), 0),
}


@pytest.fixture(scope="module")
def values():
    out = {}
    for i, (name, (phi, theta, d)) in enumerate(KNOWN.items()):
        x = simulated(1500, phi, theta, d, i)
        out[name] = dict(enumerate(x, 1))
        keep = np.random.default_rng(90 + i).random(len(x)) > 0.15
        out[f"{name} gaps"] = {t: v for t, v in out[name].items() if keep[t - 1]}
    out["constant"] = dict.fromkeys(range(1, 40), 5.0)
    out["three"] = {1: 1.0, 2: 4.0, 3: 2.0}
    out["one"] = {7: 3.0}
    return out


@pytest.fixture(scope="module")
def series(spark, values):
    rows = [(k, t, float(x)) for k, v in values.items() for t, x in v.items()] + [("null", 1, None)]
    return spark.createDataFrame(rows, "k string, t int, x double").cache()


@pytest.fixture(scope="module")
def fits(series):
    # Unlike AICc, this criterion finds the true order for certain as series grow.
    return arma.select_order(series, KEY, criterion="bic").cache()


def innovations(values, d, phi, theta):
    """[(t, innovation, variance)] by the textbook filter, one position at a time."""
    mean = np.mean(list(values.values()))
    w = {}
    for t in values:
        need = [values.get(t - j) for j in range(d + 1)]
        if None not in need:
            binomial = [(-1) ** j * math.comb(d, j) for j in range(d + 1)]
            w[t - d] = sum(b * x for b, x in zip(binomial, need, strict=True)) - (mean if d == 0 else 0)
    r = max(len(phi), len(theta) + 1)
    step = np.zeros((r, r))
    step[: len(phi), 0] = phi
    step[:-1, 1:] += np.eye(r - 1)
    load = np.zeros(r)
    load[0], load[1 : len(theta) + 1] = 1, theta
    a, p, out = np.zeros(r), np.outer(load, load), []
    for t in range(1, max(w) + 1):
        if t in w:
            v, f = w[t] - a[0], p[0, 0]
            out.append((t, v, f))
            gain = p[:, 0] / f
            a, p = a + gain * v, p - np.outer(gain, p[0])
        a, p = step @ a, step @ p @ step.T + np.outer(load, load)
    return out, a


def full(values, t, d):
    return all(t - j in values for j in range(d + 1))


def test_known_orders_are_found(fits):
    got = {r.k: r for r in fits.collect()}
    for name, (phi, theta, d) in KNOWN.items():
        r = got[name]
        assert (r.p, r.d, r.q) == (len(phi), d, len(theta))
        assert np.allclose(r.phi, phi, atol=0.12) and np.allclose(r.theta, theta, atol=0.12)
        assert r.sigma2 == pytest.approx(1.0, abs=0.1)
        assert got[f"{name} gaps"].d == d


def test_every_series_keeps_a_row(fits, values):
    got = {r.k: r for r in fits.collect()}
    assert got.keys() == values.keys() | {"null"}
    for name in ("three", "one", "null"):
        assert (got[name].p, got[name].d, got[name].q, got[name].n, got[name].sigma2) == (0, 0, 0, 0, None)
    constant = got["constant"]
    assert (constant.p, constant.d, constant.q, constant.sigma2, constant.bic) == (0, 0, 0, 0.0, float("-inf"))


def test_filter_and_criteria_against_plain_python(series, values):
    rows = arma.candidates(series.where("k IN ('arma21 gaps', 'ima11', 'ari12 gaps')"), KEY).collect()
    assert len(rows) > 40
    for r in rows:
        steps, state = innovations(values[r.k], r.d, r.phi, r.theta)
        used = [(v, f) for t, v, f in steps if t >= 5 - r.d and full(values[r.k], t + r.d, 2)]
        sse, logs = sum(v * v / f for v, f in used), sum(math.log(f) for _, f in used)
        assert r.n == len(used)
        assert r.sigma2 == pytest.approx(sse / r.n, rel=1e-9)
        twice = r.n * (math.log(2 * math.pi * sse / r.n) + 1) + logs
        k = r.p + r.q + 1
        assert r.loglik == pytest.approx(-twice / 2, rel=1e-9)
        assert r.aic == pytest.approx(twice + 2 * k, rel=1e-9)
        assert r.aicc == pytest.approx(twice + 2 * k + 2 * k * (k + 1) / (r.n - k - 1), rel=1e-9)
        assert r.bic == pytest.approx(twice + k * math.log(r.n), rel=1e-9)
        assert np.allclose(r.state[: len(state)], state, atol=1e-8)


def test_limits_are_parameters(series):
    rows = arma.candidates(series.where("k = 'arma21'"), KEY, max_p=3, differences=(0, 1), max_q=1).collect()
    assert {(r.p, r.d, r.q) for r in rows} <= {(p, d, q) for p in range(4) for d in (0, 1) for q in (0, 1)}
    assert max(r.p for r in rows) == 3
    plain = arma.select_order(series.where("k = 'white'"), KEY, max_p=0, differences=(0,), max_q=0).first()
    assert (plain.p, plain.q, list(plain.phi)) == (0, 0, [])


def test_results_do_not_depend_on_blocks(spark):
    x = simulated(3 * WARM_UP, (0.5,), (0.4,), 1, 77)
    keep = np.random.default_rng(3).random(len(x)) > 0.05
    keep[6000:11500] = False  # longer than a warm-up
    rows = [("k", t, float(v)) for t, v in enumerate(x, 1) if keep[t - 1]]
    df = spark.createDataFrame(rows, "k string, t int, x double").cache()
    limits = {"max_p": 1, "differences": (1,), "max_q": 1}
    whole, cut = (
        {(r.p, r.q): r for r in arma.candidates(df, KEY, length=n, **limits).collect()} for n in (1 << 20, WARM_UP + 50)
    )
    assert whole.keys() == cut.keys()
    for order, r in whole.items():
        s = cut[order]
        assert r.n == s.n and r.sigma2 == pytest.approx(s.sigma2, rel=1e-9)
        assert np.allclose([*r.phi, *r.theta, *r.state], [*s.phi, *s.theta, *s.state], atol=1e-9)


def test_refined_fits_are_optima(series, fits, values):
    names = ("arma21", "arma21 gaps", "ima11", "white", "three", "constant")
    chosen = fits.where(F.col("k").isin(*names)).cache()
    got = {r.k: r for r in arma.refine(series, chosen, KEY).collect()}
    assert got.keys() == set(names)
    before = {r.k: r for r in chosen.collect()}
    assert got["three"].n == 0 and list(got["white"].phi) == []

    def worth(name, r, phi, theta):
        first = max(x.p for x in got.values()) + max(x.d for x in got.values()) + 1
        steps, _ = innovations(values[name], r.d, phi, theta)
        most = max(x.d for x in got.values())
        used = [(v, f) for t, v, f in steps if t >= first - r.d and full(values[name], t + r.d, most)]
        sse, logs = sum(v * v / f for v, f in used), sum(math.log(f) for _, f in used)
        return len(used) * math.log(sse / len(used)) + logs

    for name in ("arma21", "arma21 gaps", "ima11"):
        r, old = got[name], before[name]
        best = worth(name, r, r.phi, r.theta)
        assert best <= worth(name, r, old.phi, old.theta) + 1e-9
        at = np.array([*r.phi, *r.theta])
        for i in range(len(at)):
            for side in (-1, 1):
                moved = at + side * 5e-3 * np.eye(len(at))[i]
                assert worth(name, r, moved[: r.p], moved[r.p :]) > best
        assert len(r.se) == len(at) and all(0 < s < 0.1 for s in r.se)
    phi, theta, _ = KNOWN["arma21"]
    r = got["arma21"]
    assert all(abs(c - w) < 4 * s for c, w, s in zip([*r.phi, *r.theta], [*phi, *theta], r.se, strict=True))


def test_refined_agrees_with_the_grid(series, fits):
    one = series.where("k = 'ima11'")
    grid = arima.fit(one, KEY, order=(0, 1, 1)).first()
    fine = arma.refine(one, fits.where("k = 'ima11'"), KEY).first()
    assert fine.theta[0] == pytest.approx(grid.theta, abs=0.01)
    assert fine.se[0] == pytest.approx(grid.se_theta, rel=0.05)


def test_forecasts_of_any_order(series, fits, values):
    got = {}
    for r in arma.forecast(series, fits, KEY, steps=5).collect():
        got.setdefault(r.k, {})[r.h] = r
    for fit in fits.where("sigma2 > 0").collect():
        x = values[fit.k]
        _, state = innovations(x, fit.d, fit.phi, fit.theta)
        state = np.pad(state, (0, 3))
        last, before = sorted(x)[-1], sorted(x)[-2]
        slope = (x[last] - x[before]) / (last - before)
        level, psi_sum, variance = x[last], [0.0, 0.0], 0.0
        psi = []
        for h in range(1, 6):
            w = state[0]
            state = np.append(state[1:], 0.0)
            state[: len(fit.phi)] += np.array(fit.phi) * w
            slope = slope + w
            level = level + w if fit.d == 1 else level + slope
            psi.append(
                1.0
                if h == 1
                else (fit.theta[h - 2] if h - 2 < len(fit.theta) else 0.0)
                + sum(c * psi[h - 2 - i] for i, c in enumerate(fit.phi) if h - 2 - i >= 0)
            )
            psi_sum[0] += psi[-1]
            psi_sum[1] += psi_sum[0]
            variance += [psi[-1], *psi_sum][fit.d] ** 2
            r = got[fit.k][h]
            assert r.forecast == pytest.approx(fit.mean + w if fit.d == 0 else level, rel=1e-9, abs=1e-9)
            assert r.se == pytest.approx(math.sqrt(fit.sigma2 * variance), rel=1e-9)
            assert r.high - r.forecast == pytest.approx(1.959963984540054 * r.se)
    assert [got["constant"][h].forecast for h in (1, 5)] == [5.0, 5.0]
    assert got["three"][1].forecast == pytest.approx(7 / 3) and got["three"][1].se is None
    assert got["null"][1].forecast is None


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, t int, x double")
    fits = arma.select_order(df, KEY)
    assert fits.count() == 0
    assert arma.forecast(df, fits, KEY).count() == 0
    assert arma.refine(df, fits, KEY).count() == 0
