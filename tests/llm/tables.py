"""Small tables with the awkward cases every operator must handle."""

from __future__ import annotations

from pyspark.sql import functions as F

CLASHES = ("row", "rid", "slice", "size", "source_key", "score", "base", "carried", "rest", "n")


def documents(spark, rows, clash=True):
    """rows: (doc_id, text[, lang[, source]]); with further columns that operators use inside."""
    full = [(*r, *("en", "s")[len(r) - 2 :]) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHES)) if clash else df


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
