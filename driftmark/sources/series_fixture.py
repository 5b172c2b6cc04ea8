"""Series derived from the warehouse tables.

A roll-up is small next to the tables it comes from and is read several times (first for the
calendar of each series, then for the values), so it is written once: the tables are scanned and
joined a single time whatever is done with the series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.operators.series.index import regular_series
from driftmark.sources.scratch import materialize
from driftmark.sources.tables import account_balances, customer_scores, read_table

SEGMENT = ["mktsegment"]
EVENT = ["event_type"]


def segment_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mktsegment, asofdate, accounts): counted per customer before the join."""
    per_customer = (
        account_balances(spark, sf_dir)
        .groupBy("custkey", "asofdate")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    names = customer_scores(spark, sf_dir).select("custkey", "mktsegment")
    return (
        per_customer.join(names, "custkey")
        .groupBy("mktsegment", "asofdate")
        .agg(F.sum("n").alias("accounts"))
    )


def segment_series(spark: SparkSession, sf_dir: str, fill: float | None = 0.0) -> DataFrame:
    """Accounts per market segment and month."""
    months = materialize(segment_months(spark, sf_dir), "segment-months")
    return regular_series(months, SEGMENT, "asofdate", "accounts", "month", 12, fill)


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest value per event type and day."""
    daily = (
        read_table(spark, sf_dir, "events")
        .groupBy("event_type", F.col("ts").cast("date").alias("day"))
        .agg(F.max("value").alias("peak"))
    )
    daily = materialize(daily, "event-days")
    return regular_series(daily, EVENT, "day", "peak", "day", 7)
