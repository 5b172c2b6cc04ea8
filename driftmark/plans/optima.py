"""Fits with a single optimum, or a fixed start, checked number by number.

Elastic net and logistic regression are convex: fitted to the end, their coefficients can be found
another way. Their twins use coordinate descent and Newton steps. Lloyd's rounds from given centres
are determined too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.functions.scalars import rounded
from driftmark.operators import models
from driftmark.operators.nearest import lloyd
from driftmark.plans.models import CALENDAR, CUSTOMER_FEATURES, INDEX, _customer_table, _monthly
from driftmark.plans.models import ORACLE as MODEL_ORACLE
from driftmark.plans.views import ROLLUP

MEASURES = ("Count", "LedgerSum", "IntAcruSum", "IntReserveSum")
REG, L1_RATIO = 0.3, 0.8
CLUSTERS, ROUNDS = 6, 20


def _standard(df, cols, weight):
    """Weighted means and population standard deviations, one row."""
    w = F.col(weight)
    out = df.agg(
        *(
            f.alias(f"{kind}_{c}")
            for c in cols
            for kind, f in (
                ("m", F.sum(w * F.col(c)) / F.sum(w)),
                ("q", F.sum(w * F.col(c) * F.col(c)) / F.sum(w)),
            )
        )
    ).first()
    means = {c: out[f"m_{c}"] for c in cols}
    return means, {c: max(out[f"q_{c}"] - means[c] ** 2, 0.0) ** 0.5 for c in cols}


def lr_elastic_net(spark, sf_dir):
    """Coefficients of the four monthly regressions, in standard deviations of the measure per standard
    deviation of the feature."""
    train = _monthly(spark, sf_dir).where("is_train")
    spread = train.agg(*(F.stddev_pop(c).alias(c) for c in (*CALENDAR, *MEASURES))).first()
    rows = []
    for measure in MEASURES:
        model = models.fit_linear(train, measure, "predicted", 2000, REG, L1_RATIO, tol=1e-14)
        rows += [
            (measure, name, float(c) * spread[name] / spread[measure])
            for name, c in zip(CALENDAR, model.coefficients, strict=True)
        ]
    out = spark.createDataFrame(rows, "measure string, feature string, coefficient double")
    return out.withColumn("coefficient", rounded(F.col("coefficient"), 5))


def _cells(spark, sf_dir):
    return _customer_table(spark, sf_dir).where("is_train")


def ovr_coefficients(spark, sf_dir):
    """One logistic curve per segment: its log odds at the mean customer, and what one standard
    deviation of either feature adds."""
    cells = _cells(spark, sf_dir)
    means, spread = _standard(cells, CUSTOMER_FEATURES, models.WEIGHT)
    fitted = models.fit_one_vs_rest(cells, INDEX, iterations=1000, tol=1e-15)
    rows = []
    for i, m in enumerate(fitted.models):
        own = dict(zip(CUSTOMER_FEATURES, map(float, m.coefficients), strict=True))
        middle = float(m.intercept) + sum(own[c] * means[c] for c in CUSTOMER_FEATURES)
        rows.append((float(i), middle, *(own[c] * spread[c] for c in CUSTOMER_FEATURES)))
    names = ("at_mean", *CUSTOMER_FEATURES)
    out = spark.createDataFrame(rows, f"{INDEX} double, " + ", ".join(f"{n} double" for n in names))
    return out.withColumns({n: rounded(F.col(n), 3) for n in names})


def kmeans_lloyd(spark, sf_dir):
    """Twenty rounds from centres spread evenly over the scores, at no delay."""
    cells = _cells(spark, sf_dir).groupBy(*CUSTOMER_FEATURES).agg(F.sum(models.WEIGHT).alias("n"))
    ends = cells.agg(F.min("fico_score").alias("a"), F.max("fico_score").alias("b")).first()
    step = (ends.b - ends.a) / CLUSTERS
    start = [(ends.a + step * (i + 0.5), 0.0) for i in range(CLUSTERS)]
    centres, cost = lloyd(cells, CUSTOMER_FEATURES, start, ROUNDS, "n")
    rows = [(i, *map(float, c), n, d) for i, (c, (n, d)) in enumerate(zip(centres, cost, strict=True))]
    names = ", ".join(f"{c} double" for c in CUSTOMER_FEATURES)
    out = spark.createDataFrame(rows, f"cluster int, {names}, n double, cost double")
    return out.withColumns({c: rounded(F.col(c), 6) for c in CUSTOMER_FEATURES} | {"cost": rounded(F.col("cost"), 2)})


QUERIES = {f.__name__: f for f in (lr_elastic_net, ovr_coefficients, kmeans_lloyd)}

# ---- SQL twins -------------------------------------------------------------------------

_CELLS = f"""cells AS (SELECT fico_score AS x, delinquency AS y, label_index AS ix, n FROM (
  {MODEL_ORACLE["customer_training_table"]}) WHERE is_train)"""

_UNIT = "CAST('0x' || substr(md5(CAST(y AS DOUBLE) || '|' || CAST(m AS DOUBLE) || '|' || CAST(d AS DOUBLE) || '|3'), 1, 8) AS BIGINT) / 4294967296.0"

# Coordinate descent on correlations; the penalties are in standard deviations of the measure.
_NET = f"""WITH RECURSIVE {ROLLUP},
frame AS (SELECT CAST(y AS DOUBLE) AS a, CAST(m AS DOUBLE) AS b, CAST(d AS DOUBLE) AS c, unnest([
    {{'measure': 'Count', 'v': CAST(cnt AS DOUBLE)}}, {{'measure': 'LedgerSum', 'v': CAST(acc_ldgr_sum AS DOUBLE)}},
    {{'measure': 'IntAcruSum', 'v': CAST(int_acru_sum AS DOUBLE)}}, {{'measure': 'IntReserveSum', 'v': CAST(intreservebal_sum AS DOUBLE)}}]) AS z
  FROM rollup WHERE {_UNIT} < 0.8),
r AS (SELECT z.measure, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc, corr(a, z.v) AS av, corr(b, z.v) AS bv, corr(c, z.v) AS cv,
  {REG}::DOUBLE * {L1_RATIO}::DOUBLE / stddev_pop(z.v) AS l1, {REG}::DOUBLE * (1 - {L1_RATIO}::DOUBLE) / stddev_pop(z.v) AS l2 FROM frame GROUP BY z.measure),
cd(measure, i, p, q, s) AS (
  SELECT measure, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM r
  UNION ALL
  SELECT measure, i, p, q, sign(cv - ac * p - bc * q) * greatest(abs(cv - ac * p - bc * q) - l1, 0) / (1 + l2) FROM (
    SELECT *, sign(bv - ab * p - bc * s) * greatest(abs(bv - ab * p - bc * s) - l1, 0) / (1 + l2) AS q FROM (
      SELECT r.*, cd.i + 1 AS i, cd.s, sign(av - ab * cd.q - ac * cd.s) * greatest(abs(av - ab * cd.q - ac * cd.s) - l1, 0) / (1 + l2) AS p
      FROM cd JOIN r USING (measure) WHERE cd.i < 300)))
SELECT measure, unnest(['Year', 'Month', 'Day']) AS feature, round(unnest([p, q, s]), 5) + 0.0 AS coefficient FROM cd WHERE i = 300"""

# Newton steps; the inverse of the 3 x 3 matrix by its cofactors.
_LOGIT = f"""WITH RECURSIVE {_CELLS},
st AS (SELECT sum(n * x) / sum(n) AS mx, sum(n * y) / sum(n) AS my, sqrt(sum(n * x * x) / sum(n) - (sum(n * x) / sum(n)) ** 2) AS sx,
  sqrt(sum(n * y * y) / sum(n) - (sum(n * y) / sum(n)) ** 2) AS sy FROM cells),
z AS (SELECT (x - mx) / sx AS x, (y - my) / sy AS y, ix, n FROM cells, st),
nt(c, i, b0, b1, b2) AS (
  SELECT DISTINCT ix, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM cells
  UNION ALL
  SELECT c, i, b0 + ((h11 * h22 - h12 * h12) * g0 + (h02 * h12 - h01 * h22) * g1 + (h01 * h12 - h02 * h11) * g2) / det,
    b1 + ((h02 * h12 - h01 * h22) * g0 + (h00 * h22 - h02 * h02) * g1 + (h01 * h02 - h00 * h12) * g2) / det,
    b2 + ((h01 * h12 - h02 * h11) * g0 + (h01 * h02 - h00 * h12) * g1 + (h00 * h11 - h01 * h01) * g2) / det
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h02 * h12) + h02 * (h01 * h12 - h02 * h11) AS det FROM (
    SELECT c, i + 1 AS i, b0, b1, b2, sum(n * (t - p)) AS g0, sum(n * (t - p) * x) AS g1, sum(n * (t - p) * y) AS g2,
      sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * x) AS h01, sum(n * p * (1 - p) * y) AS h02, sum(n * p * (1 - p) * x * x) AS h11,
      sum(n * p * (1 - p) * x * y) AS h12, sum(n * p * (1 - p) * y * y) AS h22
    FROM (SELECT nt.*, z.*, CASE WHEN ix = c THEN 1 ELSE 0 END AS t, 1 / (1 + exp(-(b0 + b1 * x + b2 * y))) AS p FROM nt, z WHERE i < 40)
    GROUP BY c, i, b0, b1, b2)))
SELECT c AS label_index, round(b0, 3) + 0.0 AS at_mean, round(b1, 3) + 0.0 AS fico_score, round(b2, 3) + 0.0 AS delinquency FROM nt WHERE i = 40"""

_LLOYD = f"""WITH RECURSIVE {_CELLS},
w AS (SELECT x, y, sum(n) AS n FROM cells GROUP BY x, y),
near(i, k, cx, cy, n, cost) AS (
  SELECT 0, k, lo + (hi - lo) / {CLUSTERS} * (k + 0.5::DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  FROM (SELECT min(x) AS lo, max(x) AS hi FROM w), range({CLUSTERS}) t(k)
  UNION ALL
  SELECT l.i + 1, l.k, CASE WHEN l.i < {ROUNDS} THEN coalesce(m.mx, l.cx) ELSE l.cx END, CASE WHEN l.i < {ROUNDS} THEN coalesce(m.my, l.cy) ELSE l.cy END,
    coalesce(m.n, 0), coalesce(m.cost, 0) FROM near l LEFT JOIN (
    SELECT k, sum(n * x) / sum(n) AS mx, sum(n * y) / sum(n) AS my, sum(n) AS n, sum(n * d) AS cost FROM (
      SELECT x, y, n, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
        SELECT x, y, w.n, b.k, (x - b.cx) * (x - b.cx) + (y - b.cy) * (y - b.cy) AS d FROM w, near b) GROUP BY x, y, n)
    GROUP BY k) m ON m.k = l.k WHERE l.i < {ROUNDS + 1})
SELECT CAST(k AS INTEGER) AS cluster, round(cx, 6) + 0.0 AS fico_score, round(cy, 6) + 0.0 AS delinquency, n, round(cost, 2) + 0.0 AS cost
FROM near WHERE i = {ROUNDS + 1}"""

ORACLE = {"lr_elastic_net": _NET, "ovr_coefficients": _LOGIT, "kmeans_lloyd": _LLOYD}
