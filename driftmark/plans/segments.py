"""Customer segment, split, metric and nearest-centre queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.functions.scalars import rounded
from driftmark.functions.segments import NO_SEGMENT, SEGMENTS, as_feature, customer_segment
from driftmark.operators import evaluate as E
from driftmark.operators import features, nearest, sampling
from driftmark.plans.views import ACCOUNTS, BALANCES, SEGMENTED
from driftmark.sources.tables import account_balances, accountlevel, read_table, score_counts

SCORE, DELINQUENCY = "acc_cb_raw_scr_no", "acc_pdue_pplint_qt"

# Centres for the deterministic nearest-centre query.
CENTRES = ((250.0, -1.0), (350.0, 1.0), (450.0, 0.0), (550.0, 2.0), (650.0, -2.0), (750.0, 1.0))

SPLIT_SEED = 11
LABELS = (*SEGMENTS, NO_SEGMENT)


def _segment():
    return customer_segment(F.col(SCORE), F.col(DELINQUENCY))


def _confusion(spark, sf_dir):
    """Segments against a misplaced copy of the rule, from pre-aggregated counts."""
    guess = customer_segment(F.col(SCORE) + 25, F.col(DELINQUENCY) - 1)
    scored = score_counts(spark, sf_dir).select(
        _segment().alias("actual"), guess.alias("predicted"), "n"
    )
    return E.confusion(scored, weight="n")


def customer_segments(spark, sf_dir):
    return accountlevel(spark, sf_dir).select(
        "loannum",
        as_feature(F.col(SCORE)).alias("fico_score"),
        as_feature(F.col(DELINQUENCY)).alias("delinquency"),
        _segment().alias("customer_type"),
    )


def segment_distinct(spark, sf_dir):
    return score_counts(spark, sf_dir).select(_segment().alias("customer_type")).distinct()


def segment_counts(spark, sf_dir):
    return (
        score_counts(spark, sf_dir)
        .groupBy(_segment().alias("customer_type"))
        .agg(F.sum("n").alias("n"))
    )


def segment_index(spark, sf_dir):
    labelled = score_counts(spark, sf_dir).withColumn("customer_type", _segment())
    return features.label_index(labelled, "customer_type", weight="n")


def segment_onehot(spark, sf_dir):
    return features.one_hot(segment_index(spark, sf_dir), len(LABELS)).drop("n")


def split_counts_hash(spark, sf_dir):
    part = sampling.split_part([0.7, 0.2], ["loannum"], SPLIT_SEED)
    named = F.when(part == 0, "train").otherwise("test").alias("part")
    return account_balances(spark, sf_dir).groupBy(named).agg(F.count(F.lit(1)).alias("n"))


def sample_exact_80(spark, sf_dir):
    return sampling.exact_sample(
        account_balances(spark, sf_dir).select("loannum", "acc_pdue_pplint_qt"),
        0.8,
        ["loannum"],
        seed=123,
    )


def shuffle_rows(spark, sf_dir):
    return sampling.shuffled(account_balances(spark, sf_dir).select("loannum"), ["loannum"], 123)


def confusion(spark, sf_dir):
    return _confusion(spark, sf_dir)


def confusion_wide(spark, sf_dir):
    return E.confusion_wide(_confusion(spark, sf_dir), list(LABELS))


def label_list(spark, sf_dir):
    return E.label_list(_confusion(spark, sf_dir))


def _rounded(df, cols, digits=9):
    return df.withColumns({c: rounded(F.col(c), digits) for c in cols})


def class_metrics(spark, sf_dir):
    return _rounded(
        E.class_metrics(_confusion(spark, sf_dir)), ["precision", "recall", "fpr", "f1"]
    )


def weighted_metrics(spark, sf_dir):
    out = E.weighted_metrics(_confusion(spark, sf_dir))
    return _rounded(out, out.columns)


def accuracy(spark, sf_dir):
    return _rounded(E.accuracy(_confusion(spark, sf_dir)), ["accuracy", "accuracy_pct"])


def class_table_extended(spark, sf_dir):
    out = E.class_table(_confusion(spark, sf_dir))
    return _rounded(out, out.columns[1:])


def overall_table(spark, sf_dir):
    out = E.overall_table(_confusion(spark, sf_dir))
    return _rounded(out, out.columns)


def right_rows(spark, sf_dir):
    """Rows whose guess equals the label, kept by a column-to-column predicate."""
    guess = customer_segment(F.col(SCORE) + 25, F.col(DELINQUENCY) - 1)
    scored = accountlevel(spark, sf_dir).select(
        "loannum", _segment().alias("act"), guess.alias("cluster")
    )
    return scored.where(F.col("act") == F.col("cluster"))


def nearest_center(spark, sf_dir):
    rows = accountlevel(spark, sf_dir).select(
        "loannum",
        as_feature(F.col(SCORE)).alias("fico_score"),
        as_feature(F.col(DELINQUENCY)).alias("delinquency"),
    )
    return nearest.nearest_centre(rows, ["fico_score", "delinquency"], CENTRES)


def _priced(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"),
        F.col("l_extendedprice").alias("actual"),
        (F.col("l_quantity") * 2000.0 + 100.0).alias("predicted"),
    )


def regression_metrics(spark, sf_dir):
    out = E.regression_metrics(_priced(spark, sf_dir), "actual", "predicted", "flag")
    return out.select(
        "flag",
        "n",
        rounded(F.col("mse") / 1e6, 4).alias("mse_millions"),
        rounded(F.col("rmse"), 4).alias("rmse"),
        rounded(F.col("r2"), 9).alias("r2"),
        rounded(F.col("corr"), 9).alias("corr"),
    )


def actual_pred_corr(spark, sf_dir):
    return _priced(spark, sf_dir).agg(rounded(F.corr("actual", "predicted"), 9).alias("corr"))


def regression_residuals(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("actual"),
        (F.col("l_quantity") * 2000.0 + 100.0).alias("predicted"),
    )
    out = E.residuals(rows, "actual", "predicted")
    return out.withColumn("residual", rounded(F.col("residual"), 4))


QUERIES = {
    f.__name__: f
    for f in (
        customer_segments,
        segment_distinct,
        segment_counts,
        segment_index,
        segment_onehot,
        split_counts_hash,
        sample_exact_80,
        shuffle_rows,
        confusion,
        confusion_wide,
        label_list,
        class_metrics,
        weighted_metrics,
        accuracy,
        class_table_extended,
        overall_table,
        right_rows,
        nearest_center,
        regression_metrics,
        actual_pred_corr,
        regression_residuals,
    )
}

_CONF = (
    SEGMENTED
    + """,
conf AS (SELECT customer_type AS actual, guess AS predicted, count(*) AS n
         FROM segmented GROUP BY ALL),
labels_seen AS (SELECT actual AS label FROM conf UNION SELECT predicted FROM conf),
per_label AS (
  SELECT label,
         CAST(coalesce((SELECT sum(n) FROM conf WHERE actual = label), 0) AS BIGINT) AS actual_n,
         CAST(coalesce((SELECT sum(n) FROM conf WHERE predicted = label), 0) AS BIGINT)
           AS predicted_n,
         CAST(coalesce((SELECT sum(n) FROM conf WHERE actual = label AND predicted = label), 0)
           AS BIGINT) AS tp,
         CAST((SELECT sum(n) FROM conf) AS BIGINT) AS total
  FROM labels_seen),
rates AS (
  SELECT *,
    CASE WHEN predicted_n = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / predicted_n END AS prec,
    CASE WHEN actual_n = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / actual_n END AS rec,
    CASE WHEN total = actual_n THEN 0.0::DOUBLE
         ELSE (predicted_n - tp)::DOUBLE / (total - actual_n) END AS fpr
  FROM per_label),
f_rates AS (
  SELECT *, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END AS f1
  FROM rates)"""
)


def _r(expr: str, name: str, digits: int = 9) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


_HASH = "md5(CAST(loannum AS VARCHAR) || '|{seed}')"
_UNIT = "CAST('0x' || substr(" + _HASH + ", 1, 8) AS BIGINT) / 4294967296.0"
_TN = "(total - actual_n - predicted_n + tp)"
_SENS = "tp / nullif(actual_n, 0)::DOUBLE"
_SPEC = f"{_TN} / nullif(total - actual_n, 0)::DOUBLE"
_DIST = [
    f"(coalesce(acc_cb_raw_scr_no, 0) - {a}) ** 2 + (acc_pdue_pplint_qt - ({b})) ** 2"
    for a, b in CENTRES
]
_PRICED = """priced AS (SELECT l_returnflag AS flag, l_extendedprice AS actual,
  l_quantity * 2000.0::DOUBLE + 100.0::DOUBLE AS predicted FROM lineitem)"""

ORACLE = {
    "customer_segments": f"""WITH {SEGMENTED} SELECT loannum,
        coalesce(CAST(acc_cb_raw_scr_no AS DOUBLE), 0.0) AS fico_score,
        coalesce(CAST(acc_pdue_pplint_qt AS DOUBLE), 0.0) AS delinquency, customer_type
        FROM segmented""",
    "segment_distinct": f"WITH {SEGMENTED} SELECT DISTINCT customer_type FROM segmented",
    "segment_counts": f"""WITH {SEGMENTED} SELECT customer_type, count(*) AS n
        FROM segmented GROUP BY customer_type""",
    "segment_index": f"""WITH {SEGMENTED}, c AS (
          SELECT customer_type, count(*) AS n FROM segmented GROUP BY customer_type)
        SELECT customer_type, n,
          CAST(row_number() OVER (ORDER BY n DESC, customer_type) - 1 AS DOUBLE) AS label_index
        FROM c""",
    "segment_onehot": f"""WITH {SEGMENTED}, c AS (
          SELECT customer_type, count(*) AS n FROM segmented GROUP BY customer_type),
        i AS (SELECT customer_type,
          CAST(row_number() OVER (ORDER BY n DESC, customer_type) - 1 AS DOUBLE) AS label_index
          FROM c)
        SELECT customer_type, label_index, """
    + ", ".join(
        f"CAST(label_index = {i} AS DOUBLE) AS is_{i}" for i in range(len(LABELS) - 1)
    )
    + " FROM i",
    "split_counts_hash": f"""WITH {BALANCES}, u AS (
          SELECT {_UNIT.format(seed=SPLIT_SEED)} AS u FROM balances)
        SELECT CASE WHEN u < {0.7 / (0.7 + 0.2)} THEN 'train' ELSE 'test' END AS part,
          count(*) AS n FROM u GROUP BY 1""",
    "sample_exact_80": f"""WITH {BALANCES} SELECT loannum, acc_pdue_pplint_qt,
          row_number() OVER (ORDER BY {_HASH.format(seed=123)}, loannum)
            <= floor(0.8 * count(*) OVER ()) AS in_sample FROM balances""",
    "shuffle_rows": f"""WITH {BALANCES} SELECT loannum,
          row_number() OVER (ORDER BY {_HASH.format(seed=123)}, loannum) AS shuffle_pos
        FROM balances""",
    "confusion": f"WITH {_CONF} SELECT actual, predicted, n FROM conf",
    "confusion_wide": f"WITH {_CONF} SELECT actual, "
    + ", ".join(
        f"CAST(coalesce(sum(n) FILTER (predicted = '{s}'), 0) AS BIGINT) AS \"{s}\""
        for s in LABELS
    )
    + " FROM conf GROUP BY actual",
    "label_list": f"WITH {_CONF} SELECT label FROM labels_seen",
    "class_metrics": f"""WITH {_CONF} SELECT label, actual_n, predicted_n, tp, total,
        {_r('prec', 'precision')}, {_r('rec', 'recall')}, {_r('fpr', 'fpr')}, {_r('f1', 'f1')}
        FROM f_rates""",
    "weighted_metrics": f"WITH {_CONF} SELECT "
    + ", ".join(
        _r(f"sum({c} * actual_n / total)", f"weighted_{n}")
        for c, n in (("prec", "precision"), ("rec", "recall"), ("f1", "f1"), ("fpr", "fpr"))
    )
    + " FROM f_rates",
    "accuracy": f"""WITH {SEGMENTED} SELECT count(*) AS n,
        count(*) FILTER (customer_type = guess) AS n_right,
        count(*) FILTER (customer_type <> guess) AS n_wrong,
        {_r('avg(CAST(customer_type = guess AS INTEGER))', 'accuracy')},
        {_r('avg(CAST(customer_type = guess AS INTEGER)) * 100', 'accuracy_pct')}
        FROM segmented""",
    "class_table_extended": f"""WITH {_CONF} SELECT label, {_r(_SENS, 'sensitivity')},
        {_r(_SPEC, 'specificity')},
        {_r('tp / nullif(predicted_n, 0)::DOUBLE', 'pos_pred_value')},
        {_r(f'{_TN} / nullif(total - predicted_n, 0)::DOUBLE', 'neg_pred_value')},
        {_r('actual_n / total::DOUBLE', 'prevalence')},
        {_r('tp / total::DOUBLE', 'detection_rate')},
        {_r('predicted_n / total::DOUBLE', 'detection_prevalence')},
        {_r(f'({_SENS} + {_SPEC}) / 2', 'balanced_accuracy')} FROM per_label""",
    "overall_table": f"""WITH {_CONF}, s AS (
          SELECT max(total)::DOUBLE AS n, sum(tp)::DOUBLE / max(total) AS p,
                 max(actual_n)::DOUBLE / max(total) AS nir,
                 sum(actual_n::DOUBLE * predicted_n) / (max(total)::DOUBLE ** 2) AS pe
          FROM per_label),
        k AS (SELECT *, 1.959963984540054::DOUBLE AS z FROM s)
        SELECT {_r('p', 'accuracy')},
          {_r('((p + z*z/(2*n)) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)',
              'accuracy_low')},
          {_r('((p + z*z/(2*n)) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)',
              'accuracy_high')},
          {_r('nir', 'no_information_rate')}, {_r('(p - pe) / (1 - pe)', 'kappa')} FROM k""",
    "right_rows": f"""WITH {SEGMENTED} SELECT loannum, customer_type AS act, guess AS cluster
        FROM segmented WHERE customer_type = guess""",
    "nearest_center": f"""WITH {ACCOUNTS}, d AS (
          SELECT loannum, coalesce(CAST(acc_cb_raw_scr_no AS DOUBLE), 0.0) AS fico_score,
                 CAST(acc_pdue_pplint_qt AS DOUBLE) AS delinquency,
                 CAST([{', '.join(_DIST)}] AS DOUBLE[]) AS ds FROM accountlevel)
        SELECT loannum, fico_score, delinquency, list_min(ds) AS distance2,
          CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS cluster FROM d""",
    "regression_metrics": f"""WITH {_PRICED} SELECT flag, count(*) AS n,
        {_r('avg((actual - predicted) ** 2) / 1e6', 'mse_millions', 4)},
        {_r('sqrt(avg((actual - predicted) ** 2))', 'rmse', 4)},
        {_r('1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*))', 'r2')},
        {_r('corr(actual, predicted)', 'corr')} FROM priced GROUP BY flag""",
    "actual_pred_corr": f"WITH {_PRICED} SELECT {_r('corr(actual, predicted)', 'corr')} FROM priced",
    "regression_residuals": f"""SELECT l_orderkey, l_linenumber, l_extendedprice AS actual,
        l_quantity * 2000.0::DOUBLE + 100.0::DOUBLE AS predicted,
        {_r('l_extendedprice - (l_quantity * 2000.0::DOUBLE + 100.0::DOUBLE)', 'residual', 4)}
        FROM lineitem""",
}
