"""As-of-date roll-up of an account-level table."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmark.functions.scalars import half_down_double


def asof_rollup(accounts: DataFrame) -> DataFrame:
    """Count and balance sums per as-of date: one partial and one final aggregate."""
    return (
        accounts.groupBy("asofdate")
        .agg(
            F.count(F.lit(1)).alias("cnt"),
            F.sum("acc_ldgr_bl").alias("acc_ldgr_sum"),
            F.sum("int_acru_am").alias("int_acru_sum"),
            F.sum("intreservebal").alias("intreservebal_sum"),
        )
        .withColumns(
            {
                "year": F.year("asofdate"),
                "month": F.month("asofdate"),
                "day": F.dayofmonth("asofdate"),
            }
        )
    )


def ordered(rollup: DataFrame) -> DataFrame:
    return rollup.orderBy("year", "month", "day")


def ordered_within_partitions(rollup: DataFrame) -> DataFrame:
    return rollup.sortWithinPartitions("year", "month", "day")


def drop_first_date(rollup: DataFrame) -> DataFrame:
    """Remove the earliest group, which text-based pipelines mistake for a header line.

    A roll-up has one row per date, so the window over all of it is short, and the accounts are
    read once.
    """
    first = F.min("asofdate").over(Window.partitionBy())
    return (
        rollup.withColumn("_first", first).where(F.col("asofdate") > F.col("_first")).drop("_first")
    )


def regression_frame(rollup: DataFrame) -> DataFrame:
    """All-double frame for the regressions; sums rescaled half-down to ten digits."""
    return rollup.select(
        F.col("cnt").cast("double").alias("Count"),
        half_down_double(F.col("acc_ldgr_sum")).alias("LedgerSum"),
        half_down_double(F.col("int_acru_sum")).alias("IntAcruSum"),
        half_down_double(F.col("intreservebal_sum")).alias("IntReserveSum"),
        F.col("year").cast("double").alias("Year"),
        F.col("month").cast("double").alias("Month"),
        F.col("day").cast("double").alias("Day"),
    )


def asof_in(
    accounts: DataFrame, dates: Sequence[dt.date], booked_at: str | None = None
) -> DataFrame:
    """Keep the given month-ends.

    Where the as-of date is derived from ``booked_at``, the covering range on that raw column
    is added, because only a predicate on a stored column reaches the scan.
    """
    out = accounts.where(F.col("asofdate").isin(list(dates)))
    if booked_at is not None:
        first = min(dates).replace(day=1)
        last = max(dates)
        last = last.replace(day=calendar.monthrange(last.year, last.month)[1])
        stop = last + dt.timedelta(days=1)
        kind = accounts.schema[booked_at].dataType.simpleString()
        out = out.where(
            (F.col(booked_at) >= F.lit(str(first)).cast(kind))
            & (F.col(booked_at) < F.lit(str(stop)).cast(kind))
        )
    return out
