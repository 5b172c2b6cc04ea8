"""Classifier and regression metrics.

Everything starts from one confusion table (actual, predicted, n), which is a single partial
plus final aggregate over the scored rows. All later steps work on that table: its size is the
square of the number of classes, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmark.functions.scalars import ratio, ratio_or_null


def confusion(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted", weight: str | None = None
) -> DataFrame:
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        n.alias("n")
    )


def confusion_wide(conf: DataFrame, labels: list) -> DataFrame:
    wide = conf.groupBy("actual").pivot("predicted", labels).agg(F.sum("n"))
    return wide.na.fill(0)


def label_list(conf: DataFrame) -> DataFrame:
    """Every label that occurs as actual or predicted."""
    return conf.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()


def class_counts(conf: DataFrame) -> DataFrame:
    """Per label: rows with it as actual, as predicted, as both; and the grand total."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = conf.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("actual").alias("label"),
                    F.col("n").alias("actual_n"),
                    F.lit(0).cast("bigint").alias("predicted_n"),
                    hit.cast("bigint").alias("tp"),
                ),
                F.struct(
                    F.col("predicted").alias("label"),
                    F.lit(0).cast("bigint").alias("actual_n"),
                    F.col("n").alias("predicted_n"),
                    F.lit(0).cast("bigint").alias("tp"),
                ),
            )
        )
    )
    per_label = sides.groupBy("label").agg(
        F.sum("actual_n").alias("actual_n"),
        F.sum("predicted_n").alias("predicted_n"),
        F.sum("tp").alias("tp"),
    )
    # One row per class, so an unpartitioned window is at most a few rows.
    return per_label.withColumn("total", F.sum("actual_n").over(Window.partitionBy()))


def class_metrics(conf: DataFrame) -> DataFrame:
    """Precision, recall, false positive rate and F1 per label; 0 for an empty denominator."""
    tp, act, pred, total = (F.col(c) for c in ("tp", "actual_n", "predicted_n", "total"))
    return class_counts(conf).select(
        "label",
        "actual_n",
        "predicted_n",
        "tp",
        "total",
        ratio(tp, pred).alias("precision"),
        ratio(tp, act).alias("recall"),
        ratio(pred - tp, total - act).alias("fpr"),
        ratio(2 * tp, act + pred).alias("f1"),
    )


def weighted_metrics(conf: DataFrame) -> DataFrame:
    """Per-label metrics averaged by the share of actual rows."""
    share = F.col("actual_n") / F.col("total")
    return class_metrics(conf).agg(
        *(
            F.sum(F.col(m) * share).alias(f"weighted_{m}")
            for m in ("precision", "recall", "f1", "fpr")
        )
    )


def accuracy(conf: DataFrame) -> DataFrame:
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    total = F.sum("n")
    return conf.agg(
        total.alias("n"),
        hit.alias("n_right"),
        (total - hit).alias("n_wrong"),
        ratio(hit, total).alias("accuracy"),
        (ratio(hit, total) * 100).alias("accuracy_pct"),
    )


def class_table(conf: DataFrame) -> DataFrame:
    """Diagnostic table per label; null where a rate has no rows below the line."""
    tp, act, pred, total = (F.col(c) for c in ("tp", "actual_n", "predicted_n", "total"))
    tn = total - act - pred + tp
    sens = ratio_or_null(tp, act)
    spec = ratio_or_null(tn, total - act)
    return class_counts(conf).select(
        "label",
        sens.alias("sensitivity"),
        spec.alias("specificity"),
        ratio_or_null(tp, pred).alias("pos_pred_value"),
        ratio_or_null(tn, total - pred).alias("neg_pred_value"),
        ratio_or_null(act, total).alias("prevalence"),
        ratio_or_null(tp, total).alias("detection_rate"),
        ratio_or_null(pred, total).alias("detection_prevalence"),
        ((sens + spec) / 2).alias("balanced_accuracy"),
    )


def overall_table(conf: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Accuracy with its Wilson interval, no-information rate and kappa."""
    summed = class_counts(conf).agg(
        F.sum("tp").cast("double").alias("hits"),
        F.max("total").cast("double").alias("n"),
        F.max("actual_n").cast("double").alias("largest"),
        F.sum(F.col("actual_n").cast("double") * F.col("predicted_n")).alias("chance"),
    )
    n = F.col("n")
    p = F.col("hits") / n
    expected = F.col("chance") / (n * n)
    z2 = z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    spread = z / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return summed.select(
        p.alias("accuracy"),
        (centre - spread).alias("accuracy_low"),
        (centre + spread).alias("accuracy_high"),
        (F.col("largest") / n).alias("no_information_rate"),
        ((p - expected) / F.nullif(1 - expected, F.lit(0.0))).alias("kappa"),
    )


def align_clusters(conf: DataFrame) -> DataFrame:
    """Relabel clusters by the majority actual label among their rows (ties: smallest label)."""
    w = Window.partitionBy("predicted").orderBy(F.desc("n"), "actual")
    named = conf.withColumn("_name", F.first("actual").over(w))
    return named.groupBy("actual", F.col("_name").alias("predicted")).agg(F.sum("n").alias("n"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, *keys: str) -> DataFrame:
    """Row count, MSE, RMSE, r2 (1 - SSE/SST) and correlation, one pass."""
    y = F.col(actual).cast("double")
    e = y - F.col(predicted)
    sse = F.sum(e * e)
    sst = F.var_pop(y) * F.count(e)
    return df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - sse / F.nullif(sst, F.lit(0.0))).alias("r2"),
        F.corr(y, F.col(predicted)).alias("corr"),
    )


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted))
