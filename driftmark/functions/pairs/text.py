"""Plain strings: outer blanks, and masking by a repeated letter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftmark.functions.scalars import leading_blanks, trailing_blanks, trim_controls

# Letters that count as a mask.
MASK_LETTERS = ("X", "Y", "Z")


def blank_change(a: Column, b: Column) -> Column:
    """struct of insert/delete flags for outer blanks; null if the trimmed texts differ."""
    lead_a, lead_b = leading_blanks(a), leading_blanks(b)
    trail_a, trail_b = trailing_blanks(a), trailing_blanks(b)
    return F.when(
        trim_controls(a) == trim_controls(b),
        F.struct(
            (lead_a < lead_b).alias("ins_beg"),
            (lead_a > lead_b).alias("del_beg"),
            (trail_a < trail_b).alias("ins_end"),
            (trail_a > trail_b).alias("del_end"),
        ),
    )


def count_char(s: Column, char: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, char, F.lit("")))


def added_char_kinds(a: Column, b: Column) -> Column:
    """How many different characters occur more often in ``b`` than in ``a``."""
    kinds = F.array_distinct(F.split(b, ""))
    return F.size(F.filter(kinds, lambda c: (c != "") & (count_char(b, c) > count_char(a, c))))


def is_masked(a: Column, b: Column) -> Column:
    """True if the characters ``b`` adds to those of ``a`` are one mask letter, at least twice.

    The letters are counted first, so the other characters are looked at only for candidates.
    """
    enough = F.lit(False)
    for letter in MASK_LETTERS:
        c = F.lit(letter)
        enough = enough | (count_char(b, c) - count_char(a, c) >= 2)
    return F.when(enough, added_char_kinds(a, b) == 1).otherwise(False)
