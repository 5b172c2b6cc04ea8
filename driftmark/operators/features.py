"""Label indexing, one-hot columns and vector assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_index(df: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """(label, n, label_index): 0.0 for the most frequent label, ties in label order."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(label).agg(n.alias("n"))
    # One row per label.
    by_frequency = Window.partitionBy().orderBy(F.desc("n"), label)
    rank = F.row_number().over(by_frequency) - 1
    return counts.withColumn("label_index", rank.cast("double"))


def one_hot(index: DataFrame, size: int) -> DataFrame:
    """One 0/1 column per index value but the last of ``size`` values, which is all zero."""
    return index.withColumns(
        {
            f"is_{i}": F.when(F.col("label_index") == i, 1.0).otherwise(0.0)
            for i in range(size - 1)
        }
    )


def assemble(df: DataFrame, inputs: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(inputs), outputCol=output).transform(df)


def index_and_encode(df: DataFrame, label: str) -> PipelineModel:
    """Fitted string index (most frequent first) followed by one-hot with the last dropped."""
    index = StringIndexer(
        inputCol=label, outputCol=f"{label}_index", stringOrderType="frequencyDesc"
    )
    code = OneHotEncoder(inputCol=f"{label}_index", outputCol=f"{label}_vec", dropLast=True)
    return Pipeline(stages=[index, code]).fit(df)
