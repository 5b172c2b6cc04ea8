"""Metrics: published confusion matrices, the library's own evaluator, and properties."""

from __future__ import annotations

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from driftmark.operators import evaluate as E

# Published matrices, rows taken as actual and columns as predicted.
MATRICES = {
    "perceptron test": (
        [
            [3029115, 0, 16059, 0, 0, 0],
            [0, 1423705, 0, 0, 0, 0],
            [10, 109, 414359, 0, 0, 123],
            [0, 223049, 1358, 260, 0, 0],
            [0, 153887, 0, 0, 0, 0],
            [140671, 0, 281, 0, 0, 0],
        ],
        (0.8621002325416675, 0.9008794396283832, 0.8572922077058692, 0.058868608743444184),
    ),
    "one-vs-rest train": (
        [
            [10654018, 0, 0, 0, 0, 0],
            [2187002, 2793195, 0, 86, 0, 0],
            [599, 0, 1449101, 0, 0, 805],
            [0, 0, 222302, 564640, 0, 0],
            [50433, 486306, 0, 1990, 0, 182],
            [482345, 55, 0, 0, 0, 11810],
        ],
        (0.8054225329685216, 0.818453912587281, 0.7851012579005626, 0.1959954088546616),
    ),
    "forest train": (
        [
            [57118876, 0, 0, 0, 0, 0],
            [0, 27456565, 0, 0, 0, 0],
            [0, 0, 7810327, 0, 0, 0],
            [0, 0, 0, 4341585, 977, 0],
            [0, 628610, 0, 0, 2965057, 0],
            [613484, 0, 5864, 0, 0, 2664176],
        ],
        (0.9881420554012593, 0.9879452852710426, 0.9873934826319446, 0.009468267410103502),
    ),
    "forest test": (
        [
            [24467600, 0, 0, 0, 0, 0],
            [0, 11762358, 0, 0, 0, 0],
            [0, 0, 3349093, 0, 0, 0],
            [0, 0, 0, 1861096, 405, 0],
            [0, 268644, 0, 0, 1271888, 0],
            [261928, 0, 2571, 0, 0, 1140606],
        ],
        (0.9881751841059351, 0.9879794140470135, 0.9874307068430429, 0.009436038557205005),
    ),
    "clusters train": (
        [
            [57423811, 16893720, 7811756, 1380528, 1339491, 2658282],
            [0, 169, 0, 493409, 26, 0],
            [0, 5232872, 0, 789471, 714073, 0],
            [305614, 0, 3285, 0, 0, 5320],
            [0, 2926373, 0, 456929, 550461, 0],
            [0, 3031040, 0, 1222475, 364212, 0],
        ],
        (0.8472107715367829, 0.5595809350389814, 0.673964619597576, 0.024828844233274725),
    ),
    "flag clusters train": (
        [
            [4018, 0, 0, 0, 0, 0, 0],
            [0, 4089, 0, 0, 0, 0, 0],
            [0, 0, 0, 1563, 0, 0, 0],
            [0, 0, 0, 0, 1552, 0, 0],
            [0, 0, 4062, 2, 16, 267, 8],
            [0, 0, 0, 0, 0, 438, 0],
            [0, 0, 0, 192, 0, 0, 0],
        ],
        (0.5197481288607624, 0.5282285432220645, 0.5223800614934812, 0.07388244402937477),
    ),
}


def _table(spark, matrix):
    cells = [
        (float(i), float(j), n) for i, row in enumerate(matrix) for j, n in enumerate(row) if n
    ]
    return spark.createDataFrame(cells, "actual double, predicted double, n bigint")


@pytest.mark.parametrize("name", MATRICES)
def test_published_weighted_metrics(spark, name):
    matrix, (precision, recall, f1, fpr) = MATRICES[name]
    row = E.weighted_metrics(_table(spark, matrix)).first()
    # The large matrices are printed with eight significant digits.
    assert row.weighted_precision == pytest.approx(precision, rel=1e-6)
    assert row.weighted_recall == pytest.approx(recall, rel=1e-6)
    assert row.weighted_f1 == pytest.approx(f1, rel=1e-6)
    assert row.weighted_fpr == pytest.approx(fpr, rel=1e-5)


def test_published_per_class_metrics(spark):
    rows = {r.label: r for r in E.class_metrics(_table(spark, MATRICES["perceptron test"][0])).collect()}
    assert rows[3.0].precision == 1.0
    assert rows[3.0].recall == pytest.approx(0.0011572683126582898)
    assert rows[0.0].fpr == pytest.approx(0.05966591059847011)
    assert rows[2.0].f1 == pytest.approx(0.9788108067247933)
    assert rows[4.0].precision == rows[4.0].f1 == 0.0


def test_published_tree_table(spark):
    names = ["concatenate", "datederived", "datereformat", "derived", "masking",
             "numeric reformat", "sm", "stringreformat"]
    hits = [1122, 124, 500, 0, 1152, 479, 1129, 0]
    cells = [(n, n, h) for n, h in zip(names, hits, strict=True) if h]
    cells += [("datederived", "sm", 2), ("derived", "sm", 73), ("numeric reformat", "sm", 3),
              ("stringreformat", "sm", 2)]
    conf = spark.createDataFrame(cells, "actual string, predicted string, n bigint")
    row = E.overall_table(conf).first()
    assert row.accuracy == pytest.approx(0.9826, abs=5e-5)
    assert row.kappa == pytest.approx(0.9779, abs=5e-5)
    assert row.no_information_rate == pytest.approx(0.2512, abs=5e-5)
    assert (row.accuracy_low, row.accuracy_high) == pytest.approx((0.9783, 0.9861), abs=3e-4)
    per = {r.label: r for r in E.class_table(conf).collect()}
    assert per["datederived"].sensitivity == pytest.approx(0.98413, abs=5e-6)
    assert per["sm"].pos_pred_value == pytest.approx(0.9338, abs=5e-5)
    assert per["sm"].specificity == pytest.approx(0.9769, abs=5e-5)
    assert per["derived"].pos_pred_value is None
    assert per["derived"].neg_pred_value == pytest.approx(0.98408, abs=5e-6)
    assert per["stringreformat"].balanced_accuracy == 0.5


@pytest.mark.parametrize(
    ("ours", "theirs"),
    [
        ("weighted_precision", "weightedPrecision"),
        ("weighted_recall", "weightedRecall"),
        ("weighted_f1", "f1"),
        ("weighted_fpr", "weightedFalsePositiveRate"),
    ],
)
def test_against_library_evaluator(spark, ours, theirs):
    df = spark.range(500).select(
        (F.col("id") % 4).cast("double").alias("actual"),
        (F.pmod(F.hash("id"), F.lit(4))).cast("double").alias("prediction"),
    )
    judge = MulticlassClassificationEvaluator(
        labelCol="actual", predictionCol="prediction", metricName=theirs
    )
    got = E.weighted_metrics(E.confusion(df, "actual", "prediction")).first()[ours]
    assert got == pytest.approx(judge.evaluate(df))


def test_cluster_alignment_takes_the_majority(spark):
    conf = spark.createDataFrame(
        [("a", 7, 10), ("b", 7, 3), ("b", 8, 5), ("a", 8, 5)],
        "actual string, predicted int, n bigint",
    )
    got = {(r.actual, r.predicted): r.n for r in E.align_clusters(conf).collect()}
    assert got == {("a", "a"): 15, ("b", "a"): 8}


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 1.5), (4.0, 5.0), (None, 3.0)], "y double, p double")
    row = E.regression_metrics(df, "y", "p").first()
    assert row.n == 3
    assert row.mse == pytest.approx(0.5)
    assert row.r2 == pytest.approx(1 - 1.5 / (14 / 3))
