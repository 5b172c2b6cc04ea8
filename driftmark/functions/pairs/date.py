"""Date and time strings: component extraction and comparison.

A text is rewritten into its components by the pattern of the first layout that fits.
Impossible days are kept out by look-aheads, which leaves one group per component. Numbers are
compared as text without leading zeros: no cast can fail, and absent equals zero, as it should.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pieces of the date grammar.
CENTURY = "1[6-9]|[2-9][0-9]"
YEAR = f"(?:((?:{CENTURY})[0-9][0-9])|([0-9][0-9]))"
MONTH = "(0?[1-9]|1[0-2])"
DAY = "(0?[1-9]|[12][0-9]|3[01])"
SEPARATOR = "([-./])"
NO_SUCH_MONTH_DAY = "(?!0?2.3[01]|(?:0?[469]|11).31)"
NO_SUCH_DAY_MONTH = "(?!3[01].0?2[-./]|31.(?:0?[469]|11)[-./])"
# The year comes first here, so the month ends the date.
NO_SUCH_DAY_MONTH_END = r"(?!3[01].0?2(?: |\z)|31.(?:0?[469]|11)(?: |\z))"
FOURTH_YEAR = "(?:[02468][048]|[13579][26])"
LEAP_YEAR = f"(?:(?:{CENTURY})?(?!00){FOURTH_YEAR}|(?={CENTURY}){FOURTH_YEAR}00)"
LEAP_DAY_ONLY = rf"(?!29.0?2.(?!{LEAP_YEAR}(?: |\z)))"
SIXTY = "(0?[0-5]?[0-9])"
CLOCK = (
    r"(?!(?:1[3-9]|2[0-9]):\S* [APap])"
    f"([01]?[0-9]|2[0-3]):{SIXTY}(?::{SIXTY})?(?: (?:[AP]M|[ap]m))?"
)
AFTER_DATE = rf"(?: {CLOCK})?\z"
LONGEST_DATE = 27
DATE_START = r"\A(?:[0-9]{1,4}[-./:][0-9]|\z)"

PARTS = ("yyyy", "yy", "mm", "dd", "hh", "mi", "ss", "delim")

_MARK = "\u0001"


def _layout(pattern: str, **groups: int) -> tuple[str, str]:
    """Pattern and replacement that lists the components in PARTS order."""
    text = _MARK.join(f"${groups[p]}" if p in groups else "" for p in PARTS)
    return pattern, text + _MARK


# Tried in this order. Only day-month-year checks 29 February for a leap year.
LAYOUTS = {
    "ymd": _layout(
        rf"\A{YEAR}{SEPARATOR}{NO_SUCH_MONTH_DAY}{MONTH}\3{DAY}{AFTER_DATE}",
        yyyy=1, yy=2, delim=3, mm=4, dd=5, hh=6, mi=7, ss=8,
    ),
    "mdy": _layout(
        rf"\A{NO_SUCH_MONTH_DAY}{MONTH}{SEPARATOR}{DAY}\2{YEAR}{AFTER_DATE}",
        mm=1, delim=2, dd=3, yyyy=4, yy=5, hh=6, mi=7, ss=8,
    ),
    "dmy": _layout(
        rf"\A{NO_SUCH_DAY_MONTH}{LEAP_DAY_ONLY}{DAY}{SEPARATOR}{MONTH}\2{YEAR}{AFTER_DATE}",
        dd=1, delim=2, mm=3, yyyy=4, yy=5, hh=6, mi=7, ss=8,
    ),
    "ydm": _layout(
        rf"\A{YEAR}{SEPARATOR}{NO_SUCH_DAY_MONTH_END}{DAY}\3{MONTH}{AFTER_DATE}",
        yyyy=1, yy=2, delim=3, dd=4, mm=5, hh=6, mi=7, ss=8,
    ),
    # A time alone, and even the empty text, counts as a date without a date part.
    "time": _layout(rf"\A(?:{CLOCK})?\z", hh=1, mi=2, ss=3),
}

REFORMAT, DERIVED = "datereformat", "derived"
CHANGES = ("YYYYChngFlag", "YYChngFlag", "MMChngFlag", "DDChngFlag", "HrChngFlag", "MinChngFlag", "SecChngFlag")


def _may_be_date(s: Column) -> Column:
    return (F.length(s) <= LONGEST_DATE) & s.rlike(DATE_START)


def rewrite_date(s: Column, layout: bool = False) -> Column:
    """The components, marked off, if ``s`` is a date; otherwise null. With ``layout`` its name
    follows as one more component."""
    out = F.when(~_may_be_date(s), F.lit(None))
    for name, (pattern, text) in LAYOUTS.items():
        out = out.when(
            s.rlike(pattern), F.regexp_replace(s, pattern, text + name if layout else text)
        )
    return out


def date_parts(rewritten: Column) -> Column:
    """Array of the components in PARTS order, '' where absent."""
    return F.split(rewritten, _MARK)


def date_layout(s: Column) -> Column:
    out = F.when(~_may_be_date(s), F.lit(None))
    for name, (pattern, _) in LAYOUTS.items():
        out = out.when(s.rlike(pattern), name)
    return out


def part_layout(parts: Column) -> Column:
    """The name of the layout, if the date was rewritten with it."""
    return parts[len(PARTS)]


def part(parts: Column, name: str) -> Column:
    return parts[PARTS.index(name)]


def _hour(parts: Column) -> Column:
    hh = part(parts, "hh")
    return F.when(hh != "", hh.cast("int"))


def date_flags(p: Column, q: Column) -> dict[str, Column]:
    """The sixteen change flags by name, for two dates.

    A flag whose components are absent may be null, which reads as not raised.
    """

    # Most components are equal as text, so that is asked first and ends most comparisons.
    def differ(name):
        return part(p, name) != part(q, name)

    def same_number(name):
        zero = F.lit("0")
        return F.ltrim(part(p, name), zero) == F.ltrim(part(q, name), zero)

    def changed(name):
        both = (part(p, name) != "") & (part(q, name) != "")
        return differ(name) & both & ~same_number(name)

    def respelled(name):
        return differ(name) & same_number(name)

    p_long, q_long = part(p, "yyyy"), part(q, "yyyy")
    p_short, q_short = part(p, "yy"), part(q, "yy")
    p_year, q_year = F.concat(p_long, p_short), F.concat(q_long, q_short)
    any_year = differ("yyyy") | differ("yy")
    one_has_year = any_year & ((p_year == "") != (q_year == ""))
    long_year, short_year = F.concat(p_long, q_long), F.concat(p_short, q_short)
    mixed = any_year & (p_year != "") & (q_year != "") & (F.length(p_year) != F.length(q_year))
    same_end = F.right(p_year, F.lit(2)) == F.right(q_year, F.lit(2))
    half_day = differ("hh") & (F.abs(_hour(p) - _hour(q)) == 12)
    return {
        "YYYYChngFlag": changed("yyyy")
        | (one_has_year & (long_year != ""))
        | (mixed & (p_long != "") & ~same_end),
        "YYChngFlag": changed("yy")
        | (one_has_year & ~short_year.isin("", "00"))
        | (mixed & (p_short != "") & ~same_end),
        "MMChngFlag": changed("mm"),
        "DDChngFlag": changed("dd"),
        "HrChngFlag": changed("hh") & ~half_day,
        "MinChngFlag": changed("mi"),
        "SecChngFlag": changed("ss"),
        "YYYYFrmtChngFlag": mixed & (p_long != "") & same_end,
        "YYFrmtChngFlag": (one_has_year & (short_year == "00"))
        | (mixed & (p_short != "") & same_end),
        "MMFrmtChngFlag": respelled("mm"),
        "DDFrmtChngFlag": respelled("dd"),
        "DelimFrmtChngFlag": part(p, "delim") != part(q, "delim"),
        "HrFrmtChngFlag": respelled("hh") | half_day,
        "MinFrmtChngFlag": respelled("mi"),
        "SecFrmtChngFlag": respelled("ss"),
        "DateFrmtChngFlag": p == q,
    }
