"""Numeric strings: same value in another spelling, or another value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftmark.functions.scalars import safe_float, safe_int

# A whole number, or a number with decimals (the whole part may be missing).
NUMBER = r"\A[+-]?(?:[0-9]+|[0-9]*\.[0-9]+)\z"

REFORMAT, SAME, DERIVED = "numeric reformat", "sm", "derived"


def are_numbers(a: Column, b: Column) -> Column:
    return a.rlike(NUMBER) & b.rlike(NUMBER)


def _whole_length(s: Column) -> Column:
    return F.length(F.ltrim(F.substring_index(s, ".", 1), F.lit("+-")))


def _decimal_length(s: Column) -> Column:
    dot = F.instr(s, ".")
    return F.when(dot == 0, 0).otherwise(F.length(s) - dot)


def compare_numbers(a: Column, b: Column) -> Column:
    """struct(label, del_beg, ins_beg, del_end, ins_end); null unless both are numbers.

    Two whole numbers are compared as 32-bit integers, with an overflow read as 0, and by total
    text length, sign included; any other couple as 32-bit floats, digits before and after the
    point counted apart.
    """
    ints = (F.instr(a, ".") == 0) & (F.instr(b, ".") == 0)
    equal = F.when(ints, safe_int(a) == safe_int(b)).otherwise(safe_float(a) == safe_float(b))
    longer = F.when(ints, F.length(a) - F.length(b)).otherwise(
        _whole_length(a) - _whole_length(b)
    )
    finer = _decimal_length(a) - _decimal_length(b)
    return F.when(
        are_numbers(a, b),
        F.struct(
            F.when(~equal, DERIVED).when(a == b, SAME).otherwise(REFORMAT).alias("label"),
            (longer > 0).alias("del_beg"),
            (longer < 0).alias("ins_beg"),
            (finer > 0).alias("del_end"),
            (finer < 0).alias("ins_end"),
        ),
    )
