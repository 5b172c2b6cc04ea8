"""Scalar column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int) -> Column:
    """Round and turn -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 when the denominator is 0."""
    d = den.cast("double")
    return F.when(d == 0, F.lit(0.0)).otherwise(num.cast("double") / F.nullif(d, F.lit(0.0)))


def ratio_or_null(num: Column, den: Column) -> Column:
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def safe_float(s: Column) -> Column:
    return F.coalesce(s.try_cast("float"), F.lit(0).cast("float"))


def safe_int(s: Column) -> Column:
    """Text to 32-bit integer; null, non-numbers and overflow give 0."""
    return F.coalesce(s.try_cast("int"), F.lit(0))


# Characters up to U+0020, and white space.
CONTROLS = "".join(map(chr, range(0x21)))
WHITE_SPACE = " \t\n\x0b\f\r"


def trim_controls(s: Column) -> Column:
    """Strip every character up to U+0020 from both ends."""
    return F.btrim(s, F.lit(CONTROLS))


def leading_blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.ltrim(s, F.lit(WHITE_SPACE)))


def trailing_blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.rtrim(s, F.lit(WHITE_SPACE)))


def last_two(s: Column) -> Column:
    return F.right(s, F.lit(2))


def half_down(x: Column, digits: int) -> Column:
    """Decimal rounded to ``digits`` places, ties towards zero."""
    size = F.abs(x)
    kept = F.floor(size, F.lit(digits))
    unit = "0." + "0" * (digits - 1) + "1"
    half = "0." + "0" * digits + "5"
    up = F.when(size - kept > F.expr(f"{half}BD"), F.expr(f"{unit}BD")).otherwise(
        F.expr(f"0.{'0' * digits}BD")
    )
    out = (kept + up).cast(f"decimal(38,{digits})")
    return F.when(x < 0, -out).otherwise(out)


def half_down_double(x: Column) -> Column:
    return half_down(x, 10).cast("double")


def half_down_text(x: Column) -> Column:
    """Plain text with 20 decimals."""
    return half_down(x, 20).cast("string")


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function for z >= 0 (absolute error below 7.5e-8)."""
    # Published polynomial 26.2.17 of Abramowitz and Stegun.
    p = 0.2316419
    b1, b2, b3, b4, b5 = 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429
    t = 1.0 / (1.0 + p * z)
    density = F.exp(-z * z / 2.0) * 0.3989422804014327
    poly = t * (b1 + t * (b2 + t * (b3 + t * (b4 + t * b5))))
    return 1.0 - density * poly


def two_sided_p(z: Column) -> Column:
    return 2.0 * (1.0 - normal_cdf(F.abs(z)))
