"""Series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.functions.scalars import rounded
from driftmark.operators import sampling
from driftmark.operators.evaluate import regression_metrics
from driftmark.operators.series import acf as A
from driftmark.operators.series import arima, holt, index, outliers, trend
from driftmark.operators.series import decompose as D
from driftmark.operators.series import diff as X
from driftmark.plans.views import ACCOUNTS
from driftmark.sources.scratch import materialize
from driftmark.sources.tables import read_table
from driftmark.sources.series_fixture import EVENT, SEGMENT, event_series, segment_series

MAX_LAG = 12
TAIL = 5
SMOOTH_HALF = 6


def _stored(df):
    """Operators of many passes, or of several jobs, read a stored copy of the series."""
    return materialize(df, "series")


def _rounded(df, **digits):
    return df.withColumns({c: rounded(F.col(c), d) for c, d in digits.items()})


def series_index(spark, sf_dir):
    return segment_series(spark, sf_dir)


def series_index_events(spark, sf_dir):
    return event_series(spark, sf_dir)


def series_position(spark, sf_dir):
    """Undated series: events of a type numbered by time."""
    events = read_table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    order = [F.col("ts"), F.col("event_id")]
    return index.ordered_series(events, EVENT, order).drop("ts")


def series_head_tail(spark, sf_dir):
    head, tail = index.head_tail(segment_series(spark, sf_dir), SEGMENT, TAIL)
    cols = ["mktsegment", "t", "x"]
    return head.select(*cols, F.lit("head").alias("part")).unionAll(
        tail.select(*cols, F.lit("tail").alias("part"))
    )


def series_split_at(spark, sf_dir):
    """Fifteen months to learn from, the months after them to judge by."""
    series = segment_series(spark, sf_dir).select("mktsegment", "t", "x")
    head, rest = index.split_at(series, 15)
    return head.withColumn("part", F.lit("head")).unionAll(rest.withColumn("part", F.lit("rest")))


def _diff(spark, sf_dir, **options):
    out = X.diff(segment_series(spark, sf_dir), SEGMENT, **options)
    return out.select("mktsegment", "t", "d")


def diff_1(spark, sf_dir):
    return _diff(spark, sf_dir)


def diff_2(spark, sf_dir):
    return _diff(spark, sf_dir, times=2)


def diff_lag3(spark, sf_dir):
    return _diff(spark, sf_dir, lag=3)


def log_diff3(spark, sf_dir):
    logs = X.logged(segment_series(spark, sf_dir), "x")
    out = X.diff(logs, SEGMENT, lag=3)
    return _rounded(out.select("mktsegment", "t", "d"), d=9)


def log10_frame(spark, sf_dir):
    out = X.logged(segment_series(spark, sf_dir), "x", base10=True)
    return _rounded(out.select("mktsegment", "t", "x"), x=9)


def acf_12(spark, sf_dir):
    return _rounded(A.acf(segment_series(spark, sf_dir), SEGMENT, max_lag=MAX_LAG), r=9, band=9)


def acf_diff2(spark, sf_dir):
    twice = X.diff(segment_series(spark, sf_dir), SEGMENT, times=2)
    return _rounded(A.acf(twice, SEGMENT, "d", MAX_LAG), r=9, band=9)


def pacf_12(spark, sf_dir):
    out = A.pacf(A.acf(segment_series(spark, sf_dir), SEGMENT, max_lag=MAX_LAG), SEGMENT)
    return _rounded(out, r=9, partial=9)


def ols_trend(spark, sf_dir):
    out = trend.ols_fit(segment_series(spark, sf_dir), SEGMENT, "x", "t")
    return _rounded(out, slope=9, intercept=6, r2=9, corr=9)


def ols_predict(spark, sf_dir):
    """Fit on an exact 80% sample of the months, predict the others."""
    drawn = sampling.exact_sample(
        _stored(segment_series(spark, sf_dir).select("mktsegment", "t", "x")),
        0.8,
        ["mktsegment", "t"],
        seed=123,
    )
    line = trend.ols_fit(drawn.where("in_sample"), SEGMENT, "x", "t")
    out = trend.ols_predict(drawn.where("not in_sample"), line, SEGMENT, "t")
    return _rounded(out.drop("in_sample"), predicted=6)


def decompose_additive(spark, sf_dir):
    out = D.decompose_additive(segment_series(spark, sf_dir), SEGMENT, 12)
    cols = ("trend", "seasonal", "remainder")
    return _rounded(out.select("mktsegment", "t", "x", *cols), trend=6, seasonal=6, remainder=6)


def decompose_weekly(spark, sf_dir):
    out = D.decompose_additive(event_series(spark, sf_dir), EVENT, 7)
    cols = ("trend", "seasonal", "remainder")
    return _rounded(out.select("event_type", "t", "x", *cols), trend=6, seasonal=6, remainder=6)


def smooth_local(spark, sf_dir):
    out = D.local_linear(segment_series(spark, sf_dir), SEGMENT, "x", SMOOTH_HALF, "smooth")
    return _rounded(out.select("mktsegment", "t", "x", "smooth"), smooth=6)


def season_trend(spark, sf_dir):
    out = D.season_trend(_stored(segment_series(spark, sf_dir)), SEGMENT, SMOOTH_HALF)
    cols = ("trend", "seasonal", "remainder")
    return _rounded(out.select("mktsegment", "t", "x", *cols), trend=6, seasonal=6, remainder=6)


def series_residual_check(spark, sf_dir):
    """Largest distance between x and the sum of its components."""
    out = D.decompose_additive(segment_series(spark, sf_dir), SEGMENT, 12)
    gap = F.abs(F.col("x") - F.col("trend") - F.col("seasonal") - F.col("remainder"))
    return out.groupBy("mktsegment").agg(
        F.count("remainder").alias("n"), rounded(F.max(gap), 6).alias("gap")
    )


_FIT_DIGITS = dict(phi=6, theta=6, sse=4, sigma2=4, se_phi=6, se_theta=6, e_last=5)


def _fit(spark, sf_dir, order):
    series = _stored(segment_series(spark, sf_dir))
    return series, arima.fit(series, SEGMENT, order=order)


def arima110_fit(spark, sf_dir):
    return _rounded(_fit(spark, sf_dir, (1, 1, 0))[1], **_FIT_DIGITS)


def arima111_fit(spark, sf_dir):
    return _rounded(_fit(spark, sf_dir, (1, 1, 1))[1], **_FIT_DIGITS)


def arima011_fit(spark, sf_dir):
    return _rounded(_fit(spark, sf_dir, (0, 1, 1))[1], **_FIT_DIGITS)


def _ztest(spark, sf_dir, order):
    out = arima.z_test(_fit(spark, sf_dir, order)[1], SEGMENT)
    return _rounded(out, estimate=6, std_error=6, z=5, p_value=6)


def arima110_ztest(spark, sf_dir):
    return _ztest(spark, sf_dir, (1, 1, 0))


def arima111_ztest(spark, sf_dir):
    return _ztest(spark, sf_dir, (1, 1, 1))


def arima011_ztest(spark, sf_dir):
    return _ztest(spark, sf_dir, (0, 1, 1))


def _forecast(spark, sf_dir, order):
    series, fits = _fit(spark, sf_dir, order)
    return _rounded(arima.forecast(series, fits, SEGMENT, "x", 6), forecast=5)


def arima110_forecast(spark, sf_dir):
    return _forecast(spark, sf_dir, (1, 1, 0))


def arima111_forecast(spark, sf_dir):
    return _forecast(spark, sf_dir, (1, 1, 1))


def arima011_forecast(spark, sf_dir):
    return _forecast(spark, sf_dir, (0, 1, 1))


def _forecast_se(spark, sf_dir, order):
    series, fits = _fit(spark, sf_dir, order)
    fits = _stored(fits)
    ahead = arima.forecast(series, fits, SEGMENT, "x", 6)
    out = ahead.join(arima.error_bands(fits, SEGMENT, 6), [*SEGMENT, "h"])
    low, high = F.col("forecast") - F.col("half_width"), F.col("forecast") + F.col("half_width")
    out = out.withColumns({"low95": low, "high95": high}).drop("half_width")
    return _rounded(out, forecast=5, se=5, low95=4, high95=4)


def arima110_forecast_se(spark, sf_dir):
    return _forecast_se(spark, sf_dir, (1, 1, 0))


def arima111_forecast_se(spark, sf_dir):
    return _forecast_se(spark, sf_dir, (1, 1, 1))


def holt_intervals(spark, sf_dir):
    series = _stored(segment_series(spark, sf_dir).select("mktsegment", "t", "x"))
    out = holt.intervals(holt.fit(series, SEGMENT), SEGMENT, 5)
    return _rounded(out, forecast=5, se=5, low80=4, high80=4, low95=4, high95=4)


def outliers_default_reach(spark, sf_dir):
    """The documented rule: three quartile distances."""
    out = outliers.outliers(_stored(event_series(spark, sf_dir)), EVENT)
    return _rounded(out, replacement=6)


def arima_residual_acf(spark, sf_dir):
    order = (1, 1, 1)
    series, fits = _fit(spark, sf_dir, order)
    left = arima.residuals(series, _stored(fits), SEGMENT, order=order)
    return _rounded(A.acf(left, SEGMENT, max_lag=MAX_LAG), r=6, band=6)


def arima_residual_pacf(spark, sf_dir):
    order = (0, 1, 1)
    series, fits = _fit(spark, sf_dir, order)
    left = arima.residuals(series, _stored(fits), SEGMENT, order=order)
    out = A.pacf(A.acf(left, SEGMENT, max_lag=MAX_LAG), SEGMENT)
    return _rounded(out, r=6, partial=6)


def arima_select(spark, sf_dir):
    series = segment_series(spark, sf_dir).withColumn("x", F.col("x") + 1)
    logs = X.logged(series, "x", base10=True)
    out = arima.select_order(_stored(logs), SEGMENT)
    return _rounded(out, phi=6, theta=6, sigma2=8, aicc=4)


def holt_fit(spark, sf_dir):
    out = holt.fit(_stored(segment_series(spark, sf_dir)), SEGMENT)
    return _rounded(out, sse=4, level=5, slope=5)


def _holt_held_out(spark, sf_dir):
    series = _stored(segment_series(spark, sf_dir).select("mktsegment", "t", "x"))
    head, tail = index.head_tail(series, SEGMENT, TAIL)
    ahead = holt.forecast(holt.fit(head, SEGMENT), SEGMENT, TAIL)
    return ahead.join(tail, ["mktsegment", "t"])


def holt_forecast(spark, sf_dir):
    out = _holt_held_out(spark, sf_dir).select("mktsegment", "t", "h", "x", "forecast")
    return _rounded(out, forecast=5)


def forecast_accuracy(spark, sf_dir):
    out = regression_metrics(_holt_held_out(spark, sf_dir), "x", "forecast", "mktsegment")
    return _rounded(out.select("mktsegment", "n", "rmse", "corr"), rmse=5, corr=6)


def series_outliers(spark, sf_dir):
    out = outliers.outliers(_stored(event_series(spark, sf_dir)), EVENT, reach=1.5)
    return _rounded(out, replacement=6)


def series_clean(spark, sf_dir):
    series = _stored(segment_series(spark, sf_dir, fill=None))
    out = outliers.clean(series, SEGMENT, reach=1.0)
    return _rounded(out.select("mktsegment", "t", "x", "is_outlier", "cleaned"), cleaned=6)


QUERIES = {
    f.__name__: f
    for f in (
        series_index,
        series_index_events,
        series_position,
        series_head_tail,
        series_split_at,
        diff_1,
        diff_2,
        diff_lag3,
        log_diff3,
        log10_frame,
        acf_12,
        acf_diff2,
        pacf_12,
        ols_trend,
        ols_predict,
        decompose_additive,
        decompose_weekly,
        smooth_local,
        season_trend,
        series_residual_check,
        arima110_fit,
        arima111_fit,
        arima011_fit,
        arima110_ztest,
        arima111_ztest,
        arima011_ztest,
        arima110_forecast,
        arima111_forecast,
        arima110_forecast_se,
        arima111_forecast_se,
        holt_intervals,
        outliers_default_reach,
        arima011_forecast,
        arima_residual_acf,
        arima_residual_pacf,
        arima_select,
        holt_fit,
        holt_forecast,
        forecast_accuracy,
        series_outliers,
        series_clean,
    )
}

# ---- SQL twins -------------------------------------------------------------------------


def _series(raw: str, key: str, step: str, freq: int, shown: str, fill: str) -> str:
    return f"""{raw},
span AS (SELECT k, min(p) AS lo, max(p) AS hi FROM raw GROUP BY k),
grid AS (SELECT k, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
  INTERVAL {step})) AS p FROM span),
s AS (SELECT g.k, CAST(row_number() OVER (PARTITION BY g.k ORDER BY g.p) AS INTEGER) AS t,
  CAST((row_number() OVER (PARTITION BY g.k ORDER BY g.p) - 1) % {freq} AS INTEGER) AS cycle,
  {shown} AS period, {fill} AS x
  FROM grid g LEFT JOIN raw r ON r.k = g.k AND CAST(r.p AS TIMESTAMP) = g.p)"""


_RAW_SEG = (
    ACCOUNTS
    + """,
raw AS (SELECT mktsegment AS k, CAST(date_trunc('month', asofdate) AS DATE) AS p,
  CAST(count(*) AS DOUBLE) AS x FROM accountlevel WHERE mktsegment IS NOT NULL GROUP BY 1, 2)"""
)
_SEG_GAPS = _series(_RAW_SEG, "mktsegment", "1 MONTH", 12, "last_day(g.p)", "r.x")
_SEG = _series(_RAW_SEG, "mktsegment", "1 MONTH", 12, "last_day(g.p)", "coalesce(r.x, 0.0)")
_RAW_EVENT = """raw AS (SELECT event_type AS k, CAST(ts AS DATE) AS p, max(value) AS x
  FROM events GROUP BY 1, 2)"""
_EVENT = _series(_RAW_EVENT, "event_type", "1 DAY", 7, "CAST(g.p AS DATE)", "coalesce(r.x, 0.0)")


def _r(expr: str, name: str, digits: int) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def _acf(src: str, name: str = "acf") -> str:
    """Self-joins on t - k."""
    return f"""{name}_m AS (SELECT k, avg(x) AS m, count(*) AS n FROM {src} GROUP BY k),
{name}_v AS (SELECT s.k, sum((x - m) ** 2) AS v FROM {src} s JOIN {name}_m USING (k) GROUP BY s.k),
{name} AS (SELECT a.k, CAST(l.lag AS INTEGER) AS lag,
    sum((a.x - m) * (b.x - m)) / any_value(v) AS r, 1.96::DOUBLE / sqrt(any_value(n)) AS band
  FROM {src} a JOIN {name}_m ON {name}_m.k = a.k JOIN {name}_v ON {name}_v.k = a.k
  CROSS JOIN (SELECT unnest(range(1, {MAX_LAG + 1})) AS lag) l
  JOIN {src} b ON b.k = a.k AND b.t = a.t - l.lag
  GROUP BY a.k, l.lag)"""


def _pacf(src: str) -> str:
    return f"""lists AS (SELECT k, list(r ORDER BY lag) AS rs FROM {src} GROUP BY k),
dl(k, rs, i, phi, partial) AS (
  SELECT k, rs, 1, [rs[1]], rs[1] FROM lists
  UNION ALL
  SELECT k, rs, i + 1, list_concat(
      list_transform(generate_series(1, i), lambda j: phi[j] - pk * phi[i + 1 - j]), [pk]), pk
  FROM (SELECT *, (rs[i + 1]
      - list_sum(list_transform(generate_series(1, i), lambda j: phi[j] * rs[i + 1 - j])))
      / (1 - list_sum(list_transform(generate_series(1, i), lambda j: phi[j] * rs[j]))) AS pk
    FROM dl WHERE i < len(rs)))"""


def _decompose(freq: int) -> str:
    half = freq // 2
    ends = (
        f"""- (lag(x, {half}) OVER w + lead(x, {half}) OVER w) / 2"""
        if freq % 2 == 0
        else ""
    )
    return f"""tr AS (SELECT *, CASE WHEN t > {half} AND t <= max(t) OVER (PARTITION BY k) - {half}
    THEN (sum(x) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)
      {ends}) / {freq} END AS trend FROM s WINDOW w AS (PARTITION BY k ORDER BY t)),
cm AS (SELECT k, cycle, avg(x - trend) AS m FROM tr GROUP BY k, cycle),
se AS (SELECT k, cycle, m - avg(m) OVER (PARTITION BY k) AS seasonal FROM cm),
parts AS (SELECT tr.k, t, x, trend, seasonal, x - trend - seasonal AS remainder
  FROM tr JOIN se USING (k, cycle))"""


_PARTS = ", ".join(_r(c, c, 6) for c in ("trend", "seasonal", "remainder"))
_W = f"(1 - (abs(b.t - a.t) / {SMOOTH_HALF + 1}.0::DOUBLE) ** 3) ** 3"


def _loess(src: str, col: str, name: str) -> str:
    """Range self-join and weighted least squares from five sums."""
    return f"""{name}_s AS (SELECT a.k, a.t, sum({_W}) AS s0, sum({_W} * (b.t - a.t)) AS s1,
    sum({_W} * (b.t - a.t) ** 2) AS s2, sum({_W} * b.{col}) AS t0,
    sum({_W} * (b.t - a.t) * b.{col}) AS t1
  FROM {src} a JOIN {src} b ON a.k = b.k AND b.t BETWEEN a.t - {SMOOTH_HALF} AND a.t + {SMOOTH_HALF}
  GROUP BY a.k, a.t),
{name} AS (SELECT k, t, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS fit FROM {name}_s)"""


def _season_pass(i: int, src: str) -> str:
    return f"""m{i} AS (SELECT k, cycle, avg(x - trend) AS m FROM {src} GROUP BY k, cycle),
se{i} AS (SELECT k, cycle, m - avg(m) OVER (PARTITION BY k) AS seasonal FROM m{i}),
ad{i} AS (SELECT p.k, p.t, p.cycle, p.x, se{i}.seasonal, p.x - se{i}.seasonal AS adj
  FROM {src} p JOIN se{i} ON p.k = se{i}.k AND p.cycle = se{i}.cycle),
{_loess(f'ad{i}', 'adj', f'lo{i}')},
p{i} AS (SELECT ad{i}.*, lo{i}.fit AS trend FROM ad{i}
  JOIN lo{i} ON lo{i}.k = ad{i}.k AND lo{i}.t = ad{i}.t)"""


def _changes(src: str, d: int, start: int, name: str = "ch") -> str:
    """Nested differences, then rows from position ``start`` on."""
    out = f"{name}_0 AS (SELECT k, t, x AS w0 FROM {src})"
    for i in range(1, d + 1):
        out += f""",
{name}_{i} AS (SELECT k, t, w{i-1} - lag(w{i-1}) OVER (PARTITION BY k ORDER BY t) AS w{i}
  FROM {name}_{i-1})"""
    return (
        out
        + f""",
{name}_l AS (SELECT k, t, w{d} AS w, coalesce(lag(w{d}) OVER (PARTITION BY k ORDER BY t), 0.0) AS w1
  FROM {name}_{d}),
{name} AS (SELECT k, t - {start - 1} AS t, w, w1 FROM {name}_l WHERE t >= {start} AND w IS NOT NULL)"""
    )


def _css(p: int, q: int, src: str = "ch", name: str = "css") -> str:
    """Residual filter as a recursion over t for every theta, profile and best point."""
    thetas = (
        "SELECT CAST(i AS DOUBLE) / 100 AS theta FROM range(-99, 100) g(i)"
        if q
        else "SELECT 0.0::DOUBLE AS theta"
    )
    phi = (
        "greatest(-0.99::DOUBLE, least(0.99::DOUBLE, coalesce(ab / nullif(bb, 0), 0)))"
        if p
        else "0.0::DOUBLE"
    )
    return f"""{name}_r(k, theta, t, a, b, aa, ab, bb) AS (
  SELECT k, theta, t, w, w1, w * w, w * w1, w1 * w1 FROM {src} CROSS JOIN ({thetas}) WHERE t = 1
  UNION ALL
  SELECT k, theta, t, a, b, aa + a * a, ab + a * b, bb + b * b FROM (
    SELECT r.k, r.theta, c.t, c.w - r.theta * r.a AS a, c.w1 - r.theta * r.b AS b, aa, ab, bb
    FROM {name}_r r JOIN {src} c ON c.k = r.k AND c.t = r.t + 1)),
{name}_e AS (SELECT k, max(t) AS n FROM {src} GROUP BY k),
{name}_p AS (SELECT r.*, e.n, {phi} AS phi FROM {name}_r r JOIN {name}_e e ON e.k = r.k AND e.n = r.t),
{name}_q AS (SELECT *, aa - 2 * phi * ab + phi * phi * bb AS sse, a - phi * b AS e_last FROM {name}_p),
{name}_b AS (SELECT * FROM {name}_q
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY sse, theta) = 1),
{name} AS (SELECT b.k, CAST(b.n AS BIGINT) AS n, b.phi, b.theta, b.sse, b.sse / b.n AS sigma2,
    b.e_last, {'sqrt(b.sse / b.n / nullif(b.bb, 0))' if p else 'NULL::DOUBLE'} AS se_phi,
    {'''sqrt(2 * (b.sse / b.n) / CASE WHEN hi.sse + lo.sse - 2 * b.sse > 0
        THEN (hi.sse + lo.sse - 2 * b.sse) / (0.01::DOUBLE * 0.01::DOUBLE) END)''' if q else 'NULL::DOUBLE'} AS se_theta
  FROM {name}_b b
  LEFT JOIN {name}_q hi ON hi.k = b.k AND round(hi.theta * 100) = round(b.theta * 100) + 1
  LEFT JOIN {name}_q lo ON lo.k = b.k AND round(lo.theta * 100) = round(b.theta * 100) - 1)"""


def _arima(order: tuple[int, int, int], src: str = "s") -> str:
    p, d, q = order
    return f"{_changes(src, d, d + p + 1)},\n{_css(p, q)}"


def _fit_sql(order):
    p, _, q = order
    cols = ", ".join(_r(c, c, n) for c, n in _FIT_DIGITS.items())
    return f"""WITH RECURSIVE {_SEG},
{_arima(order)}
SELECT k AS mktsegment, CAST({p} AS INTEGER) AS p, CAST({q} AS INTEGER) AS q, n, {cols} FROM css"""


_CDF = (
    "(exp(-z * z / 2) * 0.3989422804014327::DOUBLE * u * (0.319381530::DOUBLE + u * "
    "(-0.356563782::DOUBLE + u * (1.781477937::DOUBLE + u * (-1.821255978::DOUBLE + u * "
    "1.330274429::DOUBLE)))))"
)


def _ztest_sql(order):
    p, _, q = order
    terms = []
    if p:
        terms.append("SELECT k, 'ar1' AS term, phi AS estimate, se_phi AS std_error FROM css")
    if q:
        terms.append("SELECT k, 'ma1' AS term, theta AS estimate, se_theta AS std_error FROM css")
    return f"""WITH RECURSIVE {_SEG},
{_arima(order)},
terms AS ({' UNION ALL '.join(terms)}),
zs AS (SELECT *, estimate / nullif(std_error, 0) AS zz, abs(estimate / nullif(std_error, 0)) AS z,
  1 / (1 + 0.2316419::DOUBLE * abs(estimate / nullif(std_error, 0))) AS u FROM terms)
SELECT k AS mktsegment, term, {_r('estimate', 'estimate', 6)}, {_r('std_error', 'std_error', 6)},
  {_r('zz', 'z', 5)}, {_r(f'2 * {_CDF}', 'p_value', 6)} FROM zs"""


def _ahead_sql(order):
    return f"""WITH RECURSIVE {_SEG},
{_arima(order)},
ends AS (SELECT k, arg_max(x, t) AS x_last, arg_max(x, t) - arg_max(prev, t) AS w_last
  FROM (SELECT k, t, x, lag(x) OVER (PARTITION BY k ORDER BY t) AS prev FROM s) GROUP BY k),
ahead(k, phi, h, w, f) AS (
  SELECT k, phi, 1, phi * w_last + theta * e_last, x_last + phi * w_last + theta * e_last
  FROM css JOIN ends USING (k)
  UNION ALL SELECT k, phi, h + 1, phi * w, f + phi * w FROM ahead WHERE h < 6)"""


def _forecast_sql(order):
    return f"""{_ahead_sql(order)}
SELECT k AS mktsegment, h, {_r('f', 'forecast', 5)} FROM ahead"""


def _forecast_se_sql(order):
    # The summed response in closed form.
    response = "pow(1 + (css.phi + theta) * (1 - pow(css.phi, j)) / (1 - css.phi), 2)"
    return f"""{_ahead_sql(order)},
bands AS (SELECT k, h, f, sqrt(sigma2 * list_sum(list_transform(range(0, h), lambda j: {response}))) AS se
  FROM ahead JOIN css USING (k))
SELECT k AS mktsegment, h, {_r('f', 'forecast', 5)}, {_r('se', 'se', 5)},
  {_r('f - 1.959963984540054::DOUBLE * se', 'low95', 4)},
  {_r('f + 1.959963984540054::DOUBLE * se', 'high95', 4)} FROM bands"""


def _residuals_sql(order):
    return f"""{_arima(order)},
res(k, t, phi, theta, x) AS (
  SELECT ch.k, ch.t, phi, theta, w - phi * w1 FROM ch JOIN css USING (k) WHERE ch.t = 1
  UNION ALL
  SELECT c.k, c.t, phi, theta, c.w - phi * c.w1 - theta * r.x
  FROM res r JOIN ch c ON c.k = r.k AND c.t = r.t + 1)"""


def _select_sql():
    parts, picks = [], []
    for d in (0, 1, 2):
        src = "s0" if d == 0 else "s1"
        parts.append(_changes(src, d, 4, f"ch{d}"))
        for p in (0, 1):
            for q in (0, 1):
                parts.append(_css(p, q, f"ch{d}", f"f{p}{d}{q}"))
                picks.append(
                    f"SELECT k, {p} AS p, {d} AS d, {q} AS q, n, phi, theta, sigma2 FROM f{p}{d}{q}"
                )
    body = ",\n".join(parts)
    return f"""WITH RECURSIVE {_SEG},
s1 AS (SELECT k, t, log10(x + 1) AS x FROM s),
s0 AS (SELECT k, t, x - avg(x) OVER (PARTITION BY k) AS x FROM s1),
{body},
allfits AS ({' UNION ALL '.join(picks)}),
scored AS (SELECT *, n * ln(sigma2) + 2 * (p + q + 1)
  + 2.0::DOUBLE * (p + q + 1) * (p + q + 2) / (n - (p + q + 1) - 1) AS aicc FROM allfits)
SELECT k AS mktsegment, p, d, q, {_r('phi', 'phi', 6)}, {_r('theta', 'theta', 6)},
  {_r('sigma2', 'sigma2', 8)}, {_r('aicc', 'aicc', 4)}
FROM scored QUALIFY row_number() OVER (PARTITION BY k ORDER BY aicc, d, p, q) = 1"""


def _holt(src: str) -> str:
    return f"""weights AS (SELECT a.i / 20.0::DOUBLE AS alpha,
    CASE WHEN b.i = 0 THEN 0.01::DOUBLE ELSE b.i / 20.0::DOUBLE END AS beta
  FROM range(1, 21) a(i) CROSS JOIN range(0, 20) b(i)),
starts AS (SELECT k, max(x) FILTER (t = 2) AS l, max(x) FILTER (t = 2) - max(x) FILTER (t = 1) AS b
  FROM {src} GROUP BY k),
hw(k, alpha, beta, t, l, b, sse) AS (
  SELECT k, alpha, beta, 2, l, b, 0.0::DOUBLE FROM starts CROSS JOIN weights
  UNION ALL
  SELECT h.k, h.alpha, h.beta, c.t, h.alpha * c.x + (1 - h.alpha) * (h.l + h.b),
    h.beta * ((h.alpha * c.x + (1 - h.alpha) * (h.l + h.b)) - h.l) + (1 - h.beta) * h.b,
    h.sse + (c.x - h.l - h.b) ** 2
  FROM hw h JOIN {src} c ON c.k = h.k AND c.t = h.t + 1),
hn AS (SELECT k, max(t) AS n FROM {src} GROUP BY k),
hb AS (SELECT hw.*, hn.n FROM hw JOIN hn ON hn.k = hw.k AND hn.n = hw.t
  QUALIFY row_number() OVER (PARTITION BY hw.k ORDER BY sse, alpha, beta) = 1)"""


_HELD_OUT = f"""WITH RECURSIVE {_SEG},
size AS (SELECT k, max(t) AS total FROM s GROUP BY k),
head AS (SELECT s.* FROM s JOIN size USING (k) WHERE t <= total - {TAIL}),
{_holt('head')},
ahead AS (SELECT s.k, s.t, CAST(s.t - hb.n AS INTEGER) AS h, s.x, hb.l + (s.t - hb.n) * hb.b AS f
  FROM s JOIN hb ON hb.k = s.k AND s.t > hb.n)"""

_DIFF = "SELECT k AS mktsegment, t, d FROM dd WHERE d IS NOT NULL"
_OUT = """sm AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY k ORDER BY t
    ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS smooth FROM s),
qs AS (SELECT k, quantile_cont(x - smooth, 0.25) AS q1, quantile_cont(x - smooth, 0.75) AS q3
  FROM sm GROUP BY k),
fl AS (SELECT sm.k, t, x, smooth, coalesce(x - smooth < q1 - {r} * (q3 - q1)
  OR x - smooth > q3 + {r} * (q3 - q1), FALSE) AS is_outlier FROM sm JOIN qs USING (k))"""

_ACF_COLS = f"{_r('r', 'r', 9)}, {_r('band', 'band', 9)}"
_HASH = "md5(k || '|' || CAST(t AS VARCHAR) || '|123')"

ORACLE = {
    "series_index": f"WITH {_SEG} SELECT k AS mktsegment, t, cycle, period, x FROM s",
    "series_index_events": f"WITH {_EVENT} SELECT k AS event_type, t, cycle, period, x FROM s",
    "series_position": """SELECT event_type, event_id,
        row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS t FROM events""",
    "series_head_tail": f"""WITH {_SEG} SELECT k AS mktsegment, t, x,
        CASE WHEN t <= max(t) OVER (PARTITION BY k) - {TAIL} THEN 'head' ELSE 'tail' END AS part
        FROM s""",
    "series_split_at": f"""WITH {_SEG} SELECT k AS mktsegment, t, x,
        CASE WHEN t <= 15 THEN 'head' ELSE 'rest' END AS part FROM s""",
    "diff_1": f"""WITH {_SEG}, dd AS (SELECT k, t, x - lag(x) OVER (PARTITION BY k ORDER BY t) AS d
        FROM s) {_DIFF}""",
    "diff_2": f"""WITH {_SEG}, d1 AS (
        SELECT k, t, x - lag(x) OVER (PARTITION BY k ORDER BY t) AS d FROM s),
        dd AS (SELECT k, t, d - lag(d) OVER (PARTITION BY k ORDER BY t) AS d FROM d1) {_DIFF}""",
    "diff_lag3": f"""WITH {_SEG}, dd AS (
        SELECT k, t, x - lag(x, 3) OVER (PARTITION BY k ORDER BY t) AS d FROM s) {_DIFF}""",
    "log_diff3": f"""WITH {_SEG}, l AS (SELECT k, t, CASE WHEN x > 0 THEN ln(x) END AS x FROM s),
        dd AS (SELECT k, t, round(x - lag(x, 3) OVER (PARTITION BY k ORDER BY t), 9) + 0.0 AS d
          FROM l) SELECT k AS mktsegment, t, d FROM dd WHERE t > 3""",
    "log10_frame": f"""WITH {_SEG} SELECT k AS mktsegment, t,
        CASE WHEN x > 0 THEN round(log10(x), 9) + 0.0 END AS x FROM s""",
    "acf_12": f"WITH {_SEG}, {_acf('s')} SELECT k AS mktsegment, lag, {_ACF_COLS} FROM acf",
    "acf_diff2": f"""WITH {_SEG}, d1 AS (
        SELECT k, t, x - lag(x) OVER (PARTITION BY k ORDER BY t) AS d FROM s),
        d2 AS (SELECT k, t, d - lag(d) OVER (PARTITION BY k ORDER BY t) AS x FROM d1),
        dd AS (SELECT * FROM d2 WHERE x IS NOT NULL), {_acf('dd')}
        SELECT k AS mktsegment, lag, {_ACF_COLS} FROM acf""",
    "pacf_12": f"""WITH RECURSIVE {_SEG}, {_acf('s')}, {_pacf('acf')}
        SELECT k AS mktsegment, i AS lag, {_r('rs[i]', 'r', 9)}, {_r('partial', 'partial', 9)}
        FROM dl""",
    "ols_trend": f"""WITH {_SEG} SELECT k AS mktsegment, CAST(regr_count(x, t) AS BIGINT) AS n,
        {_r('regr_slope(x, t)', 'slope', 9)}, {_r('regr_intercept(x, t)', 'intercept', 6)},
        {_r('regr_r2(x, t)', 'r2', 9)}, {_r('corr(x, t)', 'corr', 9)} FROM s GROUP BY k""",
    "ols_predict": f"""WITH {_SEG}, drawn AS (SELECT k, t, x,
          row_number() OVER (ORDER BY {_HASH}, k, t) <= floor(0.8 * count(*) OVER ()) AS ins FROM s),
        line AS (SELECT k, regr_slope(x, t) AS b, regr_intercept(x, t) AS a
          FROM drawn WHERE ins GROUP BY k)
        SELECT k AS mktsegment, t, x, {_r('a + b * t', 'predicted', 6)}
        FROM drawn JOIN line USING (k) WHERE NOT ins""",
    "decompose_additive": f"WITH {_SEG}, {_decompose(12)} SELECT k AS mktsegment, t, x, {_PARTS} FROM parts",
    "decompose_weekly": f"WITH {_EVENT}, {_decompose(7)} SELECT k AS event_type, t, x, {_PARTS} FROM parts",
    "smooth_local": f"""WITH {_SEG}, {_loess('s', 'x', 'lo')}
        SELECT s.k AS mktsegment, s.t, s.x, {_r('fit', 'smooth', 6)}
        FROM s JOIN lo ON lo.k = s.k AND lo.t = s.t""",
    "season_trend": f"""WITH {_SEG}, p0 AS (SELECT k, t, cycle, x, 0.0::DOUBLE AS trend FROM s),
{_season_pass(1, 'p0')},
{_season_pass(2, 'p1')},
parts AS (SELECT *, x - trend - seasonal AS remainder FROM p2)
SELECT k AS mktsegment, t, x, {_PARTS} FROM parts""",
    "series_residual_check": f"""WITH {_SEG}, {_decompose(12)} SELECT k AS mktsegment,
        count(remainder) AS n, {_r('max(abs(x - trend - seasonal - remainder))', 'gap', 6)}
        FROM parts GROUP BY k""",
    "arima110_fit": _fit_sql((1, 1, 0)),
    "arima111_fit": _fit_sql((1, 1, 1)),
    "arima011_fit": _fit_sql((0, 1, 1)),
    "arima110_ztest": _ztest_sql((1, 1, 0)),
    "arima111_ztest": _ztest_sql((1, 1, 1)),
    "arima011_ztest": _ztest_sql((0, 1, 1)),
    "arima110_forecast": _forecast_sql((1, 1, 0)),
    "arima110_forecast_se": _forecast_se_sql((1, 1, 0)),
    "arima111_forecast_se": _forecast_se_sql((1, 1, 1)),
    "holt_intervals": f"""WITH RECURSIVE {_SEG}, {_holt('s')}, e AS (
        SELECT k, n, l, b, unnest(range(1, 6)) AS h, alpha, beta, sse FROM hb), g AS (
        SELECT k, CAST(n + h AS INTEGER) AS t, h, l + h * b AS f, sqrt(sse / (n - 2) * (1 + alpha * alpha * ((h - 1)
          + beta * (h - 1) * h + beta * beta * (h - 1) * h * (2 * h - 1) / 6))) AS se FROM e)
        SELECT k AS mktsegment, t, CAST(h AS INTEGER) AS h, {_r('f', 'forecast', 5)}, {_r('se', 'se', 5)},
          {_r('f - 1.2815515655446004::DOUBLE * se', 'low80', 4)},
          {_r('f + 1.2815515655446004::DOUBLE * se', 'high80', 4)},
          {_r('f - 1.959963984540054::DOUBLE * se', 'low95', 4)},
          {_r('f + 1.959963984540054::DOUBLE * se', 'high95', 4)} FROM g""",
    "outliers_default_reach": f"""WITH {_EVENT}, {_OUT.format(r='3.0')} SELECT k AS event_type, t, x,
        {_r('smooth', 'replacement', 6)} FROM fl WHERE is_outlier""",
    "arima111_forecast": _forecast_sql((1, 1, 1)),
    "arima011_forecast": _forecast_sql((0, 1, 1)),
    "arima_residual_acf": f"""WITH RECURSIVE {_SEG}, {_residuals_sql((1, 1, 1))}, {_acf('res')}
        SELECT k AS mktsegment, lag, {_r('r', 'r', 6)}, {_r('band', 'band', 6)} FROM acf""",
    "arima_residual_pacf": f"""WITH RECURSIVE {_SEG}, {_residuals_sql((0, 1, 1))}, {_acf('res')},
        {_pacf('acf')} SELECT k AS mktsegment, i AS lag, {_r('rs[i]', 'r', 6)},
        {_r('partial', 'partial', 6)} FROM dl""",
    "arima_select": _select_sql(),
    "holt_fit": f"""WITH RECURSIVE {_SEG}, {_holt('s')} SELECT k AS mktsegment, n, alpha, beta,
        {_r('sse', 'sse', 4)}, {_r('l', 'level', 5)}, {_r('b', 'slope', 5)} FROM hb""",
    "holt_forecast": f"""{_HELD_OUT} SELECT k AS mktsegment, t, h, x, {_r('f', 'forecast', 5)}
        FROM ahead""",
    "forecast_accuracy": f"""{_HELD_OUT} SELECT k AS mktsegment, count(*) AS n,
        {_r('sqrt(avg((x - f) ** 2))', 'rmse', 5)}, {_r('corr(x, f)', 'corr', 6)}
        FROM ahead GROUP BY k""",
    "series_outliers": f"""WITH {_EVENT}, {_OUT.format(r='1.5')} SELECT k AS event_type, t, x,
        {_r('smooth', 'replacement', 6)} FROM fl WHERE is_outlier""",
    "series_clean": f"""WITH {_SEG_GAPS}, {_OUT.format(r='1.0')},
        kept AS (SELECT *, CASE WHEN NOT is_outlier THEN x END AS v,
          CASE WHEN NOT is_outlier AND x IS NOT NULL THEN t END AS known_t FROM fl),
        near AS (SELECT *,
          last_value(v IGNORE NULLS) OVER b AS lv, last_value(known_t IGNORE NULLS) OVER b AS lt,
          first_value(v IGNORE NULLS) OVER f AS rv, first_value(known_t IGNORE NULLS) OVER f AS rt
          FROM kept WINDOW b AS (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND
            CURRENT ROW), f AS (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND
            UNBOUNDED FOLLOWING))
        SELECT k AS mktsegment, t, x, is_outlier,
          {_r('coalesce(v, lv + (rv - lv) * (t - lt) / (rt - lt), lv, rv)', 'cleaned', 6)}
        FROM near""",
}
