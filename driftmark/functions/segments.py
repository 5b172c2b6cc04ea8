"""Customer segment rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score limits and labels.
HIGH_SCORE = 600
LOW_SCORE = 300
SEGMENTS = ("good", "bad", "ClassC", "ClassD", "ClassE", "ClassF")
NO_SEGMENT = "NA"


def customer_segment(score: Column, delinquency: Column) -> Column:
    """Six-way label by score band and overdue state; ``NA`` when either is null."""
    overdue = delinquency > 0
    by_band = (
        F.when(score > HIGH_SCORE, F.when(overdue, "ClassC").otherwise("good"))
        .when(score < LOW_SCORE, F.when(overdue, "bad").otherwise("ClassD"))
        .otherwise(F.when(overdue, "ClassF").otherwise("ClassE"))
    )
    known = score.isNotNull() & delinquency.isNotNull()
    return F.when(known, by_band).otherwise(NO_SEGMENT)


def as_feature(c: Column) -> Column:
    """Whole number to double with null as 0.0."""
    return F.coalesce(c.cast("double"), F.lit(0.0))
