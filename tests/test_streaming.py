"""Row-wise operators on a streaming DataFrame give what they give on a static one."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.functions.segments import customer_segment
from driftmark.operators.classify import FLAGS, classify_pairs
from driftmark.operators.nearest import nearest_centre
from driftmark.sources.scratch import scratch_path


def _run(df, spark):
    out = scratch_path(spark, "stream-out")
    query = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start(out)
    )
    assert query.awaitTermination(120)
    return spark.read.parquet(out)


def test_pairs(spark):
    rows = [("007", "", "7"), ("abc", "", "XXabc"), ("2016-01-05", "", "2016/01/05"), ("a", "b", "ab")]
    static = spark.createDataFrame(rows, "i1 string, i2 string, o string")
    path = scratch_path(spark, "stream-in")
    static.write.parquet(path)
    stream = spark.readStream.schema(static.schema).parquet(path)
    cols = ["i1", "PredClassify", *FLAGS]
    got = _run(classify_pairs(stream, "i1", "i2", "o").select(*cols), spark)
    want = classify_pairs(static, "i1", "i2", "o").select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_segments_and_centres(spark):
    static = spark.range(100).select(
        (F.col("id") * 9).alias("score"), (F.col("id") % 5 - 2).alias("late")
    )
    path = scratch_path(spark, "stream-in")
    static.write.parquet(path)

    def label(df):
        out = df.withColumn("label", customer_segment(F.col("score"), F.col("late")))
        return nearest_centre(out, ["score", "late"], [[100.0, 0.0], [700.0, 0.0]])

    got = _run(label(spark.readStream.schema(static.schema).parquet(path)), spark)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, label(static).collect()))
