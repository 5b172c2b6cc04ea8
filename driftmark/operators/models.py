"""Fitting and scoring.

Fits iterate over their input, so the input is first collapsed to its distinct rows with a
weight wherever the estimator takes one: two whole-number features or 39 flags have a bounded
number of combinations, and the fit then no longer depends on the number of rows. Estimators
without weights (the perceptron) get the rows, persisted for the fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    LogisticRegression,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

WEIGHT = "n"


@contextmanager
def persisted(df: DataFrame) -> Iterator[DataFrame]:
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def compress(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct rows of ``cols`` with their number as weight: partial counts before the shuffle."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT))


def fit_kmeans(
    df: DataFrame, k: int, iterations: int = 20, seed: int = 11, weight: str | None = WEIGHT
) -> KMeansModel:
    kmeans = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="features")
    if weight:
        kmeans = kmeans.setWeightCol(weight)
    with persisted(df) as data:
        return kmeans.fit(data)


def centres(spark: SparkSession, model: KMeansModel, names: Sequence[str]) -> DataFrame:
    """(cluster, names...): one row per cluster."""
    rows = [(i, *map(float, c)) for i, c in enumerate(model.clusterCenters())]
    schema = "cluster int, " + ", ".join(f"`{n}` double" for n in names)
    return spark.createDataFrame(rows, schema)


def fit_forest(
    df: DataFrame,
    label: str,
    seed: int = 5043,
    trees: int = 20,
    depth: int = 4,
    bins: int = 32,
    weight: str | None = WEIGHT,
) -> RandomForestClassificationModel:
    """Every tree sees its own bootstrap: Poisson counts of the rows, which with weights are the
    distinct rows, each drawn with all its copies. ``weight=None`` draws single rows."""
    forest = RandomForestClassifier(
        labelCol=label,
        featuresCol="features",
        numTrees=trees,
        maxDepth=depth,
        maxBins=bins,
        impurity="gini",
        featureSubsetStrategy="auto",
        seed=seed,
        bootstrap=True,
    )
    if weight:
        forest = forest.setWeightCol(weight)
    with persisted(df) as data:
        return forest.fit(data)


def fit_perceptron(
    df: DataFrame,
    label: str,
    layers: Sequence[int] = (2, 6, 6),
    seed: int = 1234,
    iterations: int = 100,
    block: int = 128,
) -> MultilayerPerceptronClassificationModel:
    net = MultilayerPerceptronClassifier(
        labelCol=label,
        featuresCol="features",
        layers=list(layers),
        blockSize=block,
        seed=seed,
        maxIter=iterations,
    )
    with persisted(df) as data:
        return net.fit(data)


def fit_one_vs_rest(
    df: DataFrame, label: str, iterations: int = 10, tol: float = 1e-6, weight: str | None = WEIGHT
) -> OneVsRestModel:
    base = LogisticRegression(maxIter=iterations, tol=tol, fitIntercept=True)
    # The binary fits are independent of each other.
    ovr = OneVsRest(classifier=base, labelCol=label, featuresCol="features", parallelism=4)
    if weight:
        ovr = ovr.setWeightCol(weight)
    with persisted(df) as data:
        return ovr.fit(data)


def fit_tree(
    df: DataFrame, label: str, depth: int = 10, seed: int = 123, weight: str | None = WEIGHT
) -> DecisionTreeClassificationModel:
    tree = DecisionTreeClassifier(
        labelCol=label, featuresCol="features", maxDepth=depth, impurity="gini", seed=seed
    )
    if weight:
        tree = tree.setWeightCol(weight)
    with persisted(df) as data:
        return tree.fit(data)


def tree_complexity(
    df: DataFrame,
    label: str,
    depths: Sequence[int],
    fold: str,
    folds: int,
    seed: int = 123,
    weight: str = WEIGHT,
) -> DataFrame:
    """(max_depth, cv_error, cv_error_std): cross-validated error per size of tree.

    ``fold`` numbers the folds; it is set before equal rows are collapsed, so a fold holds rows,
    not groups of equal rows.
    """
    tree = DecisionTreeClassifier(
        labelCol=label, featuresCol="features", impurity="gini", seed=seed, weightCol=weight
    )
    grid = ParamGridBuilder().addGrid(tree.maxDepth, list(depths)).build()
    judge = MulticlassClassificationEvaluator(
        labelCol=label, predictionCol="prediction", metricName="accuracy", weightCol=weight
    )
    search = CrossValidator(
        estimator=tree,
        estimatorParamMaps=grid,
        evaluator=judge,
        numFolds=folds,
        foldCol=fold,
        seed=seed,
        parallelism=min(4, len(grid)),
    )
    with persisted(df) as data:
        found = search.fit(data)
    rows = [
        (int(d), 1.0 - float(m), float(s))
        for d, m, s in zip(depths, found.avgMetrics, found.stdMetrics, strict=True)
    ]
    return df.sparkSession.createDataFrame(
        rows, "max_depth int, cv_error double, cv_error_std double"
    )


def tree_importances(
    spark: SparkSession, model: DecisionTreeClassificationModel, names: Sequence[str]
) -> DataFrame:
    rows = list(zip(names, map(float, model.featureImportances.toArray()), strict=True))
    return spark.createDataFrame(rows, "feature string, importance double")


def tree_text(spark: SparkSession, model: DecisionTreeClassificationModel) -> DataFrame:
    lines = model.toDebugString.rstrip().splitlines()
    return spark.createDataFrame(list(enumerate(lines, 1)), "line int, text string")


def fit_linear(
    df: DataFrame,
    label: str,
    prediction: str,
    iterations: int = 10,
    reg: float = 0.3,
    l1_ratio: float = 0.8,
    tol: float = 1e-6,
) -> LinearRegressionModel:
    line = LinearRegression(
        featuresCol="features",
        labelCol=label,
        predictionCol=prediction,
        maxIter=iterations,
        regParam=reg,
        elasticNetParam=l1_ratio,
        tol=tol,
    )
    with persisted(df) as data:
        return line.fit(data)


def linear_summary(
    spark: SparkSession, model: LinearRegressionModel, names: Sequence[str]
) -> DataFrame:
    """(item, position, value): coefficients, intercept, fit quality and objective per step."""
    s = model.summary
    weights = zip(names, model.coefficients, strict=True)
    rows = [(f"coefficient {n}", 0, float(c)) for n, c in weights]
    rows += [
        ("intercept", 0, float(model.intercept)),
        ("iterations", 0, float(s.totalIterations)),
        ("rmse", 0, float(s.rootMeanSquaredError)),
        ("r2", 0, float(s.r2)),
    ]
    rows += [("objective", i, float(v)) for i, v in enumerate(s.objectiveHistory)]
    return spark.createDataFrame(rows, "item string, position int, value double")
