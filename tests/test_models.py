"""Models: shape, determinism under a seed, better than guessing, same after a round trip."""

from __future__ import annotations

import pytest
from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from driftmark.functions.segments import customer_segment
from driftmark.operators import evaluate as E
from driftmark.operators import features, models
from driftmark.sources.files import load_model, save_model


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(4000).select(
        (200 + F.pmod(F.hash("id"), F.lit(651))).cast("double").alias("score"),
        (F.pmod(F.hash("id", F.lit(7)), F.lit(5)) - 2).cast("double").alias("late"),
    )
    return df.withColumn("label", customer_segment(F.col("score"), F.col("late"))).cache()


@pytest.fixture(scope="module")
def table(rows):
    counted = models.compress(rows, ["score", "late", "label"])
    index = features.label_index(counted, "label", weight="n").select("label", "label_index")
    return features.assemble(counted.join(index, "label"), ["score", "late"]).cache()


def _accuracy(scored):
    return E.accuracy(E.confusion(scored, "label_index", "prediction", "n")).first().accuracy


def test_compressed_rows_keep_the_total(rows, table):
    assert table.agg(F.sum("n")).first()[0] == 4000
    assert table.count() < 4000


def test_weighted_cluster_fit_equals_the_fit_on_rows(rows, table):
    """Same start, same centres: a row with weight n counts as n rows."""
    by_weight = models.fit_kmeans(table, 3, iterations=50)
    by_row = models.fit_kmeans(features.assemble(rows, ["score", "late"]), 3, 50, weight=None)
    a = sorted(tuple(c) for c in by_weight.clusterCenters())
    b = sorted(tuple(c) for c in by_row.clusterCenters())
    for p, q in zip(a, b, strict=True):
        assert p == pytest.approx(q, abs=25)


def test_forest(table):
    a, b = models.fit_forest(table, "label_index"), models.fit_forest(table, "label_index")
    assert _accuracy(a.transform(table)) > 0.9
    assert a.toDebugString.split("\n")[1:] == b.toDebugString.split("\n")[1:]
    assert a.getNumTrees == 20
    assert len({t.toDebugString.split("\n", 1)[1] for t in a.trees}) > 1


def test_one_vs_rest(table):
    model = models.fit_one_vs_rest(table, "label_index")
    assert len(model.models) == 6
    assert _accuracy(model.transform(table)) > 0.6


def test_perceptron(rows):
    fitted = features.index_and_encode(rows, "label")
    data = features.assemble(fitted.transform(rows), ["score", "late"])
    model = models.fit_perceptron(data, "label_index", iterations=20)
    scored = model.transform(data)
    assert scored.select("prediction").distinct().count() <= 6
    assert model.getLayers() == [2, 6, 6]


def test_tree_with_complexity_importances_and_text(spark, table):
    model = models.fit_tree(table, "label_index", depth=5)
    assert _accuracy(model.transform(table)) > 0.95
    parts = {r.feature: r.importance for r in models.tree_importances(spark, model, ["score", "late"]).collect()}
    assert sum(parts.values()) == pytest.approx(1.0)
    assert models.tree_text(spark, model).count() > model.numNodes
    folds = table.withColumn("fold", F.pmod(F.hash("score", "late"), F.lit(3)))
    cv = {r.max_depth: r.cv_error for r in models.tree_complexity(folds, "label_index", (1, 5), "fold", 3).collect()}
    assert cv[5] < cv[1]


def test_least_squares_equals_the_closed_form(spark):
    df = spark.range(50).select(
        F.col("id").cast("double").alias("x"), (F.col("id") * 3.0 + F.pmod(F.hash("id"), F.lit(9))).alias("y")
    )
    model = models.fit_linear(features.assemble(df, ["x"]), "y", "p", 100, 0.0, 0.0)
    line = df.agg(F.regr_slope("y", "x"), F.regr_intercept("y", "x")).first()
    assert (model.coefficients[0], model.intercept) == pytest.approx(tuple(line))
    summary = {(r["item"], r.position): r.value for r in models.linear_summary(spark, model, ["x"]).collect()}
    assert summary["coefficient x", 0] == pytest.approx(line[0])
    assert 0 <= summary["r2", 0] <= 1


def test_saved_models_score_alike(spark, table, tmp_path):
    for name, model, kind in (
        ("kmeans", models.fit_kmeans(table, 4), KMeansModel),
        ("tree", models.fit_tree(table, "label_index"), DecisionTreeClassificationModel),
        ("line", models.fit_linear(table, "label_index", "prediction"), LinearRegressionModel),
    ):
        path = str(tmp_path / name)
        save_model(model, path)
        again = load_model(kind, path)
        before = model.transform(table).select("score", "late", "prediction")
        after = again.transform(table).select("score", "late", "prediction")
        assert before.exceptAll(after).count() == 0


def test_centres_as_rows(spark, table):
    got = models.centres(spark, models.fit_kmeans(table, 4), ["score", "late"])
    assert got.columns == ["cluster", "score", "late"] and got.count() == 4
