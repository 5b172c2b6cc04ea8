"""Classification of (input1, input2, output) triples into kinds of change.

The work is cut into a few projections. A struct built in one projection is read many times in
the next, and the optimizer keeps such projections apart, so every token is cut out only once
per row. All steps are narrow: nothing shuffles.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions.pairs import date, numeric, text

# The 39 change flags in feature order.
FLAGS = (
    "DelSpBegFlag", "DelSpBetFlag", "DelSpEndFlag", "DelzBegFlag", "DelzBetFlag", "DelzEndFlag",
    "DelBegFlag", "DelBetFlag", "DelEndFlag", "InsSpBegFlag", "InsSpBetFlag", "InsSpEndFlag",
    "InsFlag", "InsSameFlag", "InszBegFlag", "InsDecEndFlag", "DelDecEndFlag", "MovFlag",
    "ConcatFlag", "YYYYChngFlag", "YYChngFlag", "MMChngFlag", "DDChngFlag", "TSChngFlag",
    "HrChngFlag", "MinChngFlag", "SecChngFlag", "TZChngFlag", "YYYYFrmtChngFlag",
    "YYFrmtChngFlag", "MMFrmtChngFlag", "DDFrmtChngFlag", "DelimFrmtChngFlag", "TSFrmtChngFlag",
    "HrFrmtChngFlag", "MinFrmtChngFlag", "SecFrmtChngFlag", "TZFrmtChngFlag", "DateFrmtChngFlag",
)

# Final labels.
LABELS = (
    "sm", "concatenate", "derivedconcat", "numeric reformat", "datereformat", "stringreformat",
    "masking", "derived",
)

_OPEN = "not sm"


_BIT = {flag: 1 << i for i, flag in enumerate(FLAGS)}
_CHANGED = sum(_BIT[name] for name in date.CHANGES)


def _no_bits() -> Column:
    return F.lit(0).cast("bigint")


def _bits(flags: dict[str, Column]) -> Column:
    """The raised flags as one whole number; a null flag is not raised."""
    total = _no_bits()
    for name, cond in flags.items():
        total = total + F.when(cond, F.lit(_BIT[name]).cast("bigint")).otherwise(_no_bits())
    return total


def _or_zero(bits: Column) -> Column:
    return F.coalesce(bits, _no_bits())


def start_label(a: Column, b: Column, out: Column) -> Column:
    """Same move, concatenation or neither; a missed concatenation even overrules same move."""
    all_set = (a != "") & (b != "") & (out != "")
    joined = F.concat(a, b) == out
    return (
        F.when(all_set, F.when(joined, "concatenate").otherwise("derivedconcat"))
        .when(a == out, "sm")
        .otherwise(_OPEN)
    )


def compare_dates(
    df: DataFrame, a: str, b: str, label: str = "date_label", bits: str = "date_bits"
) -> DataFrame:
    """Adds the date verdict on two text columns and its flags.

    ``derived`` if a component changed or only one side is a date, ``datereformat`` if only the
    spelling did, null if there is nothing to say or the texts are equal. The flags are null
    unless both sides are dates.
    """
    own = df.columns
    x, y = F.col(a), F.col(b)
    staged = df.withColumns(
        {
            "_date_a": F.when(x != y, date.rewrite_date(x)),
            "_date_b": F.when(x != y, date.rewrite_date(y)),
        }
    )
    da, db = F.col("_date_a"), F.col("_date_b")
    both = da.isNotNull() & db.isNotNull()
    staged = staged.withColumns(
        {
            "_part_a": F.when(both, date.date_parts(da)),
            "_part_b": F.when(both, date.date_parts(db)),
        }
    )
    p, q = F.col("_part_a"), F.col("_part_b")
    staged = staged.withColumn(bits, F.when(p.isNotNull(), _bits(date.date_flags(p, q))))
    one_sided = da.isNull() != db.isNull()
    changed = F.col(bits).bitwiseAND(F.lit(_CHANGED).cast("bigint")) != 0
    verdict = F.when(one_sided | changed, date.DERIVED).when(F.col(bits) != 0, date.REFORMAT)
    return staged.select(*own, verdict.alias(label), bits)


def classify_bits(
    df: DataFrame,
    input1: str,
    input2: str,
    output: str,
    label: str = "PredClassify",
    bits: str = "flag_bits",
) -> DataFrame:
    """Adds the label and the 39 flags as the bits of one whole number, lowest bit first.

    Null inputs are read as empty text.
    """
    own = df.columns
    a, b, out = (F.coalesce(F.col(c), F.lit("")) for c in (input1, input2, output))
    staged = df.withColumns({"_a": a, "_b": b, "_o": out})
    a, b, out = F.col("_a"), F.col("_b"), F.col("_o")

    staged = staged.withColumns(
        {
            "_start": start_label(a, b, out),
            "_num": numeric.compare_numbers(a, out),
        }
    )
    staged = compare_dates(staged, "_a", "_o", "_dlabel", "_dbits")
    # A numeric verdict overrules everything before it; a date verdict only an open label.
    numbered = F.coalesce(F.col("_num.label"), F.col("_start"))
    staged = staged.withColumn(
        "_dated",
        F.when(numbered == _OPEN, F.coalesce(F.col("_dlabel"), F.lit(_OPEN))).otherwise(numbered),
    )
    still_open = F.col("_dated") == _OPEN
    staged = staged.withColumn("_blank", F.when(still_open, text.blank_change(a, out)))
    unlike = still_open & F.col("_blank").isNull()
    staged = staged.withColumn("_mask", F.when(unlike, text.is_masked(a, out)).otherwise(False))

    final = (
        F.when(F.col("_mask"), "masking")
        .when(F.col("_blank").isNotNull(), "stringreformat")
        .when(still_open, "derived")
        .otherwise(F.col("_dated"))
    )
    number_bits = F.when(
        F.col("_num.label") == numeric.REFORMAT,
        _bits(
            {
                "DelzBegFlag": F.col("_num.del_beg"),
                "InszBegFlag": F.col("_num.ins_beg"),
                "DelDecEndFlag": F.col("_num.del_end"),
                "InsDecEndFlag": F.col("_num.ins_end"),
            }
        ),
    )
    blank_bits = F.when(
        F.col("_blank").isNotNull(),
        _bits(
            {
                "InsSpBegFlag": F.col("_blank.ins_beg"),
                "DelSpBegFlag": F.col("_blank.del_beg"),
                "InsSpEndFlag": F.col("_blank.ins_end"),
                "DelSpEndFlag": F.col("_blank.del_end"),
            }
        ),
    )
    other_bits = _bits({"ConcatFlag": F.col("_start") == "concatenate", "InsSameFlag": F.col("_mask")})
    # The four groups of flags have no flag in common, so adding them is setting their bits.
    raised = (
        _or_zero(F.col("_dbits")) + _or_zero(number_bits) + _or_zero(blank_bits) + other_bits
    )
    return staged.select(*own, final.alias(label), raised.alias(bits))


def expand_flags(df: DataFrame, bits: str = "flag_bits") -> DataFrame:
    """The 39 flag columns of a flag number, 0.0 or 1.0."""
    rest = [c for c in df.columns if c != bits]
    return df.select(
        *rest,
        *(F.getbit(F.col(bits), F.lit(i)).cast("double").alias(f) for i, f in enumerate(FLAGS)),
    )


def flag_text(bits: Column) -> Column:
    """The flags as 39 zeros and ones, first flag first."""
    return F.reverse(F.lpad(F.bin(bits), len(FLAGS), "0"))


def classify_pairs(
    df: DataFrame, input1: str, input2: str, output: str, label: str = "PredClassify"
) -> DataFrame:
    """Adds the label and the 39 flag columns. Null inputs are read as empty text."""
    found = classify_bits(df, input1, input2, output, label, "_flag_bits")
    return expand_flags(found, "_flag_bits")


def classify_counts(
    df: DataFrame,
    by: list[str],
    input1: str,
    input2: str,
    output: str,
    label: str = "PredClassify",
    bits: str = "flag_bits",
    n: str = "n",
) -> DataFrame:
    """(by..., label, bits, n): rows per label and flags. Equal triples are counted before they are
    classified, so each distinct one is parsed once, however often it occurs."""
    texts = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in (input1, input2, output))
    own = df.select(*by, *texts)
    distinct = own.groupBy(*by, input1, input2, output).agg(F.count(F.lit(1)).alias(n))
    found = classify_bits(distinct, input1, input2, output, label, bits)
    return found.groupBy(*by, label, bits).agg(F.sum(n).alias(n))


def change_table(
    df: DataFrame, input1: str, input2: str, output: str, actual: str
) -> DataFrame:
    """The full change table: four inputs, the label found, three text columns kept for the
    changed parts (never filled), and the 39 flags."""
    named = df.select(
        F.col(input1).alias("InputString1"),
        F.col(input2).alias("InputString2"),
        F.col(output).alias("OutputString"),
        F.col(actual).alias("ActClassify"),
    )
    found = classify_pairs(named, "InputString1", "InputString2", "OutputString")
    empty = F.lit(None).cast("string")
    return found.select(
        *named.columns,
        "PredClassify",
        *(empty.alias(c) for c in ("DeleteString", "InsertString", "MoveString")),
        *FLAGS,
    )


def feature_table(classified: DataFrame, label: str = "PredClassify") -> DataFrame:
    """Label and the 39 flags assembled into one vector."""
    return (
        VectorAssembler(inputCols=list(FLAGS), outputCol="features")
        .transform(classified)
        .select(label, *FLAGS, "features")
    )
