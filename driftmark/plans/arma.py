"""Queries of the general ARIMA operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.functions.scalars import rounded
from driftmark.operators.series import arma
from driftmark.operators.series.diff import logged
from driftmark.plans.series import _SEG
from driftmark.sources.scratch import materialize
from driftmark.sources.series_fixture import SEGMENT, segment_series
from driftmark.sources.tables import read_table

STEPS = 6


def _rounded(df, **digits):
    return df.withColumns({c: rounded(F.col(c), d) for c, d in digits.items()})


def _log_months(spark, sf_dir):
    series = segment_series(spark, sf_dir).withColumn("x", F.col("x") + 1)
    return materialize(logged(series, "x", base10=True).select(*SEGMENT, "t", "x"), "series")


def daily_prices(spark, sf_dir):
    """(mktsegment, t, x): log10 of the mean order price of a day; days without orders are missing.

    Summed up per customer first, so a customer with many orders joins once a day."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("double").alias("price")
    )
    per_customer = orders.groupBy("o_custkey", "day").agg(F.sum("price").alias("s"), F.count("price").alias("n"))
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("mktsegment"))
    days = (
        per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("mktsegment", "day")
        .agg(F.log10(F.sum("s") / F.sum("n")).alias("x"))
    )
    days = materialize(days, "daily-prices")
    begin = days.groupBy(*SEGMENT).agg(F.min("day").alias("begin"))
    return days.join(begin, SEGMENT).select(*SEGMENT, (F.date_diff("day", "begin") + 1).alias("t"), "x")


def _coefficients(df):
    named = {f"{c}{i + 1}": F.get(c, F.lit(i)) for c in ("phi", "theta") for i in range(2)}
    df = df.withColumns(named)
    digits = dict.fromkeys(named, 6) | {"sigma2": 8, "loglik": 4, "aic": 4, "aicc": 4, "bic": 4}
    return _rounded(df, **digits).select(*SEGMENT, "p", "d", "q", "n", *digits)


def arima_orders(spark, sf_dir):
    """Every order up to (2, 2, 2) of the monthly series, with its criteria."""
    return _coefficients(arma.candidates(_log_months(spark, sf_dir), SEGMENT))


def arima_select_forecast(spark, sf_dir):
    """The best of these orders per series, and six months from it."""
    series = _log_months(spark, sf_dir)
    fits = materialize(arma.select_order(series, SEGMENT), "fits")
    ahead = arma.forecast(series, fits, SEGMENT, steps=STEPS)
    out = ahead.join(fits.select(*SEGMENT, "p", "d", "q"), SEGMENT)
    return _rounded(out, forecast=6, se=6, low=5, high=5).select(
        *SEGMENT, "p", "d", "q", "h", "forecast", "se", "low", "high"
    )


def arima_gaps(spark, sf_dir):
    """Orders up to (1, 0, 1) of daily prices with missing days."""
    series = materialize(daily_prices(spark, sf_dir), "series")
    return _coefficients(arma.candidates(series, SEGMENT, max_p=1, differences=(0,), max_q=1))


def arima_refined(spark, sf_dir):
    """Greatest likelihood for daily prices with missing days, from the order chosen."""
    series = materialize(daily_prices(spark, sf_dir), "series")
    fits = materialize(arma.select_order(series, SEGMENT, max_p=1, differences=(0,), max_q=1), "fits")
    return _coefficients(arma.refine(series, fits, SEGMENT))


QUERIES = {f.__name__: f for f in (arima_orders, arima_select_forecast, arima_gaps, arima_refined)}

# ---- SQL twins -------------------------------------------------------------------------


def _search(max_p: int, max_q: int, long: int = arma.LONG_ORDER) -> str:
    """From l(k, d, n, w): w by position, null where missing. Two regressions by elimination."""
    width = 1 + max_p + max_q
    lags = " AND ".join(f"i > {j} AND w[greatest(i - {j}, 1)] IS NOT NULL" for j in range(1, max_p + 1))
    z = ", ".join(
        ["w[i]", *(f"w[i - {j}]" for j in range(1, max_p + 1))]
        + [f"CASE WHEN i > {j} THEN coalesce(e[greatest(i - {j}, 1)], 0) ELSE 0 END" for j in range(1, max_q + 1)]
    )

    def inside(c: str, sign: str) -> str:
        one, two = f"({sign}coalesce({c}[1], 0) / 0.99::DOUBLE)", f"({sign}coalesce({c}[2], 0) / 0.9801::DOUBLE)"
        return f"abs({two}) < 1 AND abs({one} / (1 - {two})) < 1"

    return f"""sums AS (SELECT *, list_transform(range(0, {long + 1}), lambda g: list_sum(list_transform(range(g + 1, n + 1), lambda i: w[i] * w[i - g]))) AS c,
  list_transform(range(0, {long + 1}), lambda g: list_sum(list_transform(range(g + 1, n + 1), lambda i: CASE WHEN w[i] * w[i - g] IS NULL THEN 0 ELSE 1 END))) AS m FROM l),
rs AS (SELECT *, list_transform(range(1, {long + 1}), lambda g: CASE WHEN m[g + 1] > 0 THEN c[g + 1] / m[g + 1] ELSE 0 END * (n - g) / n / (c[1] / m[1])) AS r,
  least({long}, m[1] // 4) AS most FROM sums),
dl(k, d, r, most, i, phi) AS (
  SELECT k, d, r, most, 0, CAST([] AS DOUBLE[]) FROM rs
  UNION ALL
  SELECT k, d, r, most, i + 1, list_append(list_transform(range(1, i + 1), lambda j: phi[j] - pk * phi[i + 1 - j]), pk)
  FROM (SELECT *, (r[i + 1] - coalesce(list_sum(list_transform(range(1, i + 1), lambda j: phi[j] * r[i + 1 - j])), 0))
    / (1 - coalesce(list_sum(list_transform(range(1, i + 1), lambda j: phi[j] * r[j])), 0)) AS pk FROM dl WHERE i < most)),
ar AS (SELECT k, d, arg_max(phi, i) AS phi FROM dl GROUP BY k, d),
es AS (SELECT l.*, list_transform(range(1, n + 1), lambda i: w[i] - coalesce(list_sum(list_transform(range(1, least(i, len(phi) + 1)),
  lambda j: phi[j] * coalesce(w[i - j], 0))), 0)) AS e FROM l JOIN ar USING (k, d)),
zs AS (SELECT k, d, list_transform(list_filter(range(1, n + 1), lambda i: w[i] IS NOT NULL AND {lags}), lambda i: [{z}]) AS z FROM es),
g AS (SELECT k, d, list_transform(range(1, {width + 1}), lambda a: list_transform(range(1, {width + 1}),
  lambda b: coalesce(list_sum(list_transform(z, lambda r: r[a] * r[b])), 0))) AS g FROM zs),
cand AS (SELECT k, d, p, q, g, list_concat(range(2, 2 + p), range({2 + max_p}, {2 + max_p} + q)) AS v
  FROM g, range(0, {max_p + 1}) a(p), range(0, {max_q + 1}) b(q)),
el(k, d, p, q, i, m) AS (
  SELECT k, d, p, q, 0, list_transform(v, lambda a: list_append(list_transform(v, lambda b: g[a][b]), g[a][1])) FROM cand
  UNION ALL
  SELECT k, d, p, q, i + 1, list_transform(range(1, len(m) + 1), lambda a: list_transform(range(1, len(m) + 2), lambda b:
    CASE WHEN a = i + 1 THEN m[a][b] / m[a][i + 1] ELSE m[a][b] - m[a][i + 1] / m[i + 1][i + 1] * m[i + 1][b] END))
  FROM el WHERE i < len(m)),
sol AS (SELECT k, d, p, q, list_transform(m, lambda a: a[len(m) + 1]) AS c FROM el WHERE i = len(m)),
par AS (SELECT k, d, p, q, c[1:p] AS phi, c[p + 1:p + q] AS theta FROM sol),
good AS (SELECT * FROM par WHERE {inside('phi', '')} AND {inside('theta', '-')})"""


_CRITERIA = """scored AS (SELECT *, fit + 2 * kk AS aic, fit + 2 * kk + 2.0::DOUBLE * kk * (kk + 1) / (n - kk - 1) AS aicc, fit + kk * ln(n) AS bic, -fit / 2 AS loglik
  FROM (SELECT *, sse / n AS sigma2, p + q + 1 AS kk, n * (ln(2 * pi() * sse / n) + 1) + logs AS fit FROM judged))"""

_SHOWN = ", ".join(
    ["k AS mktsegment", "CAST(p AS INTEGER) AS p", "d", "CAST(q AS INTEGER) AS q", "CAST(n AS BIGINT) AS n"]
    + [f"round({c}[{i}], 6) + 0.0 AS {c}{i}" for c in ("phi", "theta") for i in (1, 2)]
    + [f"round({c}, {d}) + 0.0 AS {c}" for c, d in (("sigma2", 8), ("loglik", 4), ("aic", 4), ("aicc", 4), ("bic", 4))]
)

# Without gaps the filter is a plain recursion over changes and shocks.
_MONTHS = f"""WITH RECURSIVE {_SEG},
x0 AS (SELECT k, t, log10(x + 1) AS x, avg(log10(x + 1)) OVER (PARTITION BY k) AS mean FROM s),
c AS (SELECT k, t, x - mean AS w0, x - lag(x) OVER o AS w1, x - 2 * lag(x) OVER o + lag(x, 2) OVER o AS w2
  FROM x0 WINDOW o AS (PARTITION BY k ORDER BY t)),
l AS (SELECT k, d, count(w) AS n, list(w ORDER BY t) AS w FROM (
  SELECT k, 0 AS d, t, w0 AS w FROM c UNION ALL SELECT k, 1, t, w1 FROM c UNION ALL SELECT k, 2, t, w2 FROM c)
  WHERE w IS NOT NULL GROUP BY k, d),
{_search(2, 2)},
run(k, d, p, q, t, w1, w2, e1, e2, n, sse) AS (
  SELECT k, d, p, q, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0, 0.0::DOUBLE FROM good
  UNION ALL
  SELECT k, d, p, q, t, w, w1, e, e1, n + CASE WHEN t >= 5 - d THEN 1 ELSE 0 END, sse + CASE WHEN t >= 5 - d THEN e * e ELSE 0 END FROM (
    SELECT r.k, r.d, r.p, r.q, r.t + 1 AS t, l.w[r.t + 1] AS w, r.w1, r.e1, r.n, r.sse,
      l.w[r.t + 1] - coalesce(phi[1], 0) * r.w1 - coalesce(phi[2], 0) * r.w2 - coalesce(theta[1], 0) * r.e1 - coalesce(theta[2], 0) * r.e2 AS e
    FROM run r JOIN l ON l.k = r.k AND l.d = r.d AND r.t < l.n JOIN good g ON g.k = r.k AND g.d = r.d AND g.p = r.p AND g.q = r.q)),
judged AS (SELECT good.*, r.n, r.sse, 0.0::DOUBLE AS logs, w1, w2, e1, e2 FROM good JOIN run r USING (k, d, p, q) JOIN l ON l.k = r.k AND l.d = r.d AND l.n = r.t),
{_CRITERIA}"""

_FORECAST = f"""{_MONTHS},
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY k ORDER BY aicc / n, d, p, q) = 1),
ends AS (SELECT k, arg_max(x, t) AS x_last, arg_max(x, t) - arg_max(prev, t) AS slope, any_value(mean) AS mean
  FROM (SELECT *, lag(x) OVER (PARTITION BY k ORDER BY t) AS prev FROM x0) GROUP BY k),
b AS (SELECT best.*, x_last, slope, mean, coalesce(phi[1], 0) AS f1, coalesce(phi[2], 0) AS f2, coalesce(theta[1], 0) AS t1, coalesce(theta[2], 0) AS t2
  FROM best JOIN ends USING (k)),
ahead(k, h, w1, w2, e1, e2, psi1, psi2, s1, s2, r1, r2, level, v) AS (
  SELECT k, 0, w1, w2, e1, e2, 0.0::DOUBLE, 0.0::DOUBLE, CASE WHEN d = 2 THEN slope ELSE x_last END, x_last, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM b
  UNION ALL
  SELECT k, h + 1, w, w1, 0.0, e1, psi, psi1, s1 + w, s2 + s1 + w, r1 + psi, r2 + r1 + psi,
    CASE d WHEN 0 THEN w + mean WHEN 1 THEN s1 + w ELSE s2 + s1 + w END,
    v + CASE d WHEN 0 THEN psi ELSE CASE d WHEN 1 THEN r1 + psi ELSE r2 + r1 + psi END END ** 2
  FROM (SELECT a.*, b.d, b.mean, f1 * a.w1 + f2 * a.w2 + t1 * a.e1 + t2 * a.e2 AS w,
      CASE h WHEN 0 THEN 1.0 WHEN 1 THEN f1 + t1 WHEN 2 THEN f1 * psi1 + f2 * psi2 + t2 ELSE f1 * psi1 + f2 * psi2 END AS psi
    FROM ahead a JOIN b USING (k) WHERE h < {STEPS}))
SELECT k AS mktsegment, CAST(p AS INTEGER) AS p, d, CAST(q AS INTEGER) AS q, h, round(level, 6) + 0.0 AS forecast, round(se, 6) + 0.0 AS se,
  round(level - 1.959963984540054::DOUBLE * se, 5) + 0.0 AS low, round(level + 1.959963984540054::DOUBLE * se, 5) + 0.0 AS high
FROM (SELECT *, sqrt(sigma2 * v) AS se FROM ahead JOIN (SELECT k, p, d, q, sigma2 FROM b) USING (k) WHERE h > 0)"""

# With gaps: state and covariance of the two-part companion form, day by day.
_GAPS = f"""WITH RECURSIVE days AS (SELECT c_mktsegment AS k, CAST(o_orderdate AS DATE) AS day, log10(sum(o_totalprice::DOUBLE) / count(o_totalprice)) AS x
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IS NOT NULL GROUP BY 1, 2),
span AS (SELECT k, min(day) AS lo, max(day) AS hi, avg(x) AS mean FROM days GROUP BY k),
l AS (SELECT span.k, 0 AS d, date_diff('day', any_value(lo), any_value(hi)) + 1 AS n, list(x - mean ORDER BY g.day) AS w
  FROM span, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) g(day) LEFT JOIN days ON days.k = span.k AND days.day = CAST(g.day AS DATE) GROUP BY span.k),
{_search(1, 1)},
run(k, p, q, t, a1, a2, p11, p12, p22, n, sse, logs) AS (
  SELECT k, p, q, 0, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, coalesce(theta[1], 0.0), coalesce(theta[1], 0.0) ** 2, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM good
  UNION ALL
  SELECT k, p, q, t, f * u1 + u2, 0.0, f * f * v11 + 2 * f * v12 + v22 + 1, th, th * th, n, sse, logs FROM (
    SELECT k, p, q, t, f, th, a1 + coalesce(w - a1, 0) AS u1, a2 + coalesce(p12 / p11 * (w - a1), 0) AS u2,
      CASE WHEN w IS NULL THEN p11 ELSE 0 END AS v11, CASE WHEN w IS NULL THEN p12 ELSE 0 END AS v12,
      CASE WHEN w IS NULL THEN p22 ELSE p22 - p12 * p12 / p11 END AS v22,
      n + CASE WHEN w IS NOT NULL AND t >= 2 THEN 1 ELSE 0 END AS n,
      sse + CASE WHEN w IS NOT NULL AND t >= 2 THEN (w - a1) ** 2 / p11 ELSE 0 END AS sse,
      logs + CASE WHEN w IS NOT NULL AND t >= 2 THEN ln(p11) ELSE 0 END AS logs
    FROM (SELECT r.* EXCLUDE (t), r.t + 1 AS t, l.w[r.t + 1] AS w, coalesce(phi[1], 0) AS f, coalesce(theta[1], 0) AS th
      FROM run r JOIN l ON l.k = r.k AND r.t < l.n JOIN good g ON g.k = r.k AND g.p = r.p AND g.q = r.q))),
judged AS (SELECT good.*, r.n, r.sse, r.logs FROM good JOIN run r USING (k, p, q) JOIN l ON l.k = r.k AND l.n = r.t),
{_CRITERIA}"""

ORACLE = {
    "arima_orders": f"{_MONTHS} SELECT {_SHOWN} FROM scored",
    "arima_select_forecast": _FORECAST,
    "arima_gaps": f"{_GAPS} SELECT {_SHOWN} FROM scored",
}
