"""Pair classifier: truth table, date grammar and properties."""

from __future__ import annotations

import itertools
import re

import pytest
from pyspark.sql import functions as F

from driftmark.functions.pairs import date, numeric, text
from driftmark.operators.classify import (
    FLAGS,
    LABELS,
    classify_bits,
    classify_counts,
    classify_pairs,
    feature_table,
)
from driftmark.plans import all_queries
from driftmark.sources.pair_fixture import pairs
from driftmark.sources.tables import spread

# (input1, input2, output, label, raised flags)
TRUTH = [
    ("abc", "", "abc", "sm", ""),
    ("abc", "def", "abcdef", "concatenate", "Concat"),
    ("abc", "def", "abc", "derivedconcat", ""),
    ("abc", "def", "zzz", "derivedconcat", ""),
    ("12", "34", "1234", "derived", "Concat"),
    ("007", "", "7", "numeric reformat", "DelzBeg"),
    ("7", "", "007", "numeric reformat", "InszBeg"),
    ("+5", "", "5", "numeric reformat", "DelzBeg"),
    ("5", "", "6", "derived", ""),
    ("1.50", "", "1.5", "numeric reformat", "DelDecEnd"),
    ("0.5", "", ".5", "numeric reformat", "DelzBeg"),
    ("5", "", "5.0", "numeric reformat", "InsDecEnd"),
    ("5.0", "", "5", "numeric reformat", "DelDecEnd"),
    ("5.1", "", "5", "derived", ""),
    ("1.5", "", "2.5", "derived", ""),
    ("16777217.0", "", "16777216.0", "numeric reformat", ""),
    ("99999999999", "", "88888888888", "numeric reformat", ""),
    ("5.", "", "5", "derived", ""),
    ("2016-01-31", "", "01/31/2016", "datereformat", "DelimFrmtChng"),
    ("2016-01-31", "", "01-31-2016", "datereformat", "DateFrmtChng"),
    ("2016-01-31", "", "16-01-31", "datereformat", "YYYYFrmtChng"),
    ("16-01-31", "", "2016-01-31", "datereformat", "YYFrmtChng"),
    ("2016-01-31", "", "2015-01-31", "derived", "YYYYChng"),
    ("2016-01-05", "", "2016-1-5", "datereformat", "MMFrmtChng DDFrmtChng"),
    ("2016-01-05 10:30:00", "", "2016-01-05 22:30:00", "datereformat", "HrFrmtChng"),
    ("2016-01-05 10:30:00", "", "2016-01-05 11:30:00", "derived", "HrChng"),
    ("2016-01-05 10:30 AM", "", "2016-01-05 10:30 PM", "datereformat", "DateFrmtChng"),
    ("2016-01-05", "", "2016-01-05 10:30:00", "datereformat", "SecFrmtChng"),
    ("2016-01-05", "", "2016-01-05 00:00:00", "datereformat", "HrFrmtChng MinFrmtChng SecFrmtChng"),
    ("2016-01-05", "", "2016-01-05 10:30:15", "derived", ""),
    ("2016-01-05", "", "hello", "derived", ""),
    ("abc", "", "", "derived", ""),
    ("2016-01-05", "", "", "derived", "YYYYChng DelimFrmtChng"),
    ("10:30", "", "2016-01-05", "derived", "YYYYChng DelimFrmtChng"),
    (" abc", "", "abc", "stringreformat", "DelSpBeg"),
    ("abc", "", "abc  ", "stringreformat", "InsSpEnd"),
    ("  abc", "", "abc  ", "stringreformat", "DelSpBeg InsSpEnd"),
    ("John Smith", "", "XXXX Smith", "masking", "InsSame"),
    ("4111-1111", "", "XXXX-1111", "masking", "InsSame"),
    ("abc", "", "abX", "derived", ""),
    ("abc", "", "XY", "derived", ""),
    ("abc", "", "***", "derived", ""),
    ("Xabc", "", "XXXc", "masking", "InsSame"),
    ("01-02-03", "", "02-01-03", "derived", "YYChng MMChng"),
    ("31/12/2016", "", "12/31/2016", "datereformat", "DateFrmtChng"),
    ("2016-13-01", "", "2016-01-13", "datereformat", "DateFrmtChng"),
    ("", "", "abc", "derived", ""),
    ("", "x", "x", "derived", ""),
    ("2016-02-30", "", "2016-02-28", "derived", ""),
    ("00-01-02", "", "2000-01-02", "datereformat", "YYFrmtChng"),
    # Beyond the table: nulls read as empty, tabs as blanks, a new line is not a date's end.
    (None, None, None, "sm", ""),
    ("\tabc", "", "abc", "stringreformat", "DelSpBeg"),
    ("2016-01-05\n", "", "2016-01-06", "derived", ""),
    ("10:30", "", "10:31", "derived", "MinChng"),
    ("9:30", "", "09:30", "datereformat", "HrFrmtChng"),
    ("16-01-05", "", "10:30", "derived", "YYChng DelimFrmtChng"),
    ("00-01-05", "", "00:00", "datereformat", "YYFrmtChng DelimFrmtChng HrFrmtChng MinFrmtChng"),
]


def _classified(spark, rows):
    df = spark.createDataFrame(
        [(i, *r[:3]) for i, r in enumerate(rows)], "id int, i1 string, i2 string, o string"
    )
    return {r.id: r for r in classify_pairs(df, "i1", "i2", "o").collect()}


def test_truth_table(spark):
    got = _classified(spark, TRUTH)
    for i, (a, b, out, label, flags) in enumerate(TRUTH):
        raised = {f[:-4] for f in FLAGS if got[i][f] == 1.0}
        assert (got[i].PredClassify, raised) == (label, set(flags.split())), (a, b, out)


def test_flags_are_39_zero_or_one_columns(spark):
    got = _classified(spark, TRUTH)
    assert len(FLAGS) == 39 == len(set(FLAGS))
    assert {got[i][f] for i in got for f in FLAGS} == {0.0, 1.0}
    assert {got[i].PredClassify for i in got} <= set(LABELS)


def test_feature_table_has_one_vector(spark):
    df = spark.createDataFrame([("abc", "", "abc")], "i1 string, i2 string, o string")
    row = feature_table(classify_pairs(df, "i1", "i2", "o")).first()
    assert row.features.size == 39


def _model_layout(s: str) -> str | None:
    """Independent reading of the date grammar."""
    m = re.fullmatch(r"(?:(\d+)([-./])(\d+)([-./])(\d+))?( ?)(\d+:.*)?", s)
    if not m:
        return None
    a, s1, b, s2, c, blank, clock = m.groups()
    if clock is not None:
        t = re.fullmatch(r"(\d{1,2}):(\d{1,3})(?::(\d{1,3}))?( (?:AM|PM|am|pm))?", clock)
        if not t or int(t[1]) > (12 if t[4] else 23):
            return None
        if int(t[2]) > 59 or int(t[3] or 0) > 59:
            return None
    if a is None:
        return None if blank else "time"
    if (blank == " ") != (clock is not None) or s1 != s2:
        return None

    def year(x):
        return len(x) == 2 or (len(x) == 4 and int(x[:2]) >= 16)

    def day(d, m):
        if len(d) > 2 or len(m) > 2 or not 1 <= int(m) <= 12:
            return False
        longest = {2: 29, 4: 30, 6: 30, 9: 30, 11: 30}.get(int(m), 31)
        return 1 <= int(d) <= longest

    def leap(y):
        if len(y) == 2:
            return y != "00" and int(y) % 4 == 0
        return int(y) % 4 == 0 and (int(y) % 100 != 0 or int(y) % 400 == 0)

    if year(a) and day(c, b):
        return "ymd"
    if year(c) and day(b, a):
        return "mdy"
    if year(c) and day(a, b) and (int(a) != 29 or int(b) != 2 or leap(c)):
        return "dmy"
    if year(a) and day(b, c):
        return "ydm"
    return None


def test_date_grammar_against_model(spark):
    small = ["0", "1", "2", "02", "04", "4", "00", "11", "12", "13", "28", "29", "30", "31", "32"]
    years = ["00", "15", "16", "2016", "2015", "1900", "2000", "1599", "999"]
    dates = ["-".join(p) for p in itertools.product(small, small, small + years)]
    dates += ["-".join(p) for p in itertools.product(years, small, small)]
    clocks = [
        "", " ", "10:30", " 10:30", " 1:5", " 13:00 PM", " 12:00 pm", " 23:59:59", " 24:00",
        " 10:60", " 10:059", " 10:060", " 10:30:5 AM", " 10:30  AM", " 010:30", " 10:30:60", ":30",
    ]
    heads = ["", "2016-01-05", "29/02/2016", "29/02/2015", "1.2.16", "2016-1/5", "31-4-16", "x"]
    texts = sorted(set(dates) | {h + c for h in heads for c in clocks})
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = df.select(
        "s",
        date.date_layout(F.col("s")).alias("layout"),
        date.rewrite_date(F.col("s")).isNotNull().alias("is_date"),
    ).collect()
    wrong = [(r.s, r.layout, _model_layout(r.s)) for r in got if r.layout != _model_layout(r.s)]
    assert not wrong, wrong[:10]
    assert all(r.is_date == (r.layout is not None) for r in got)


def test_number_grammar(spark):
    yes = ["5", "+5", "-5", "007", ".5", "0.5", "-0.50", "123456789012345678901234567890"]
    no = ["", "+", ".", "5.", "1e5", "1,5", " 5", "5 ", "--5", "5.5.5", "٣", "5\n"]
    df = spark.createDataFrame([(t,) for t in yes + no], "s string")
    got = {r.s: r.ok for r in df.select("s", F.col("s").rlike(numeric.NUMBER).alias("ok")).collect()}
    assert [t for t in yes if not got[t]] == []
    assert [t for t in no if got[t]] == []


@pytest.mark.parametrize(
    ("a", "b", "masked"),
    [
        ("abc", "XXabc", True),
        ("abc", "XXX", True),
        ("abc", "YYc", True),
        ("abc", "xxc", False),
        ("XX", "XXX", False),
        ("XX", "XXXX", True),
        ("abc", "XXd", False),
        ("añb", "XXñ", True),
        ("abc", "XXYY", False),
        ("", "ZZ", True),
    ],
)
def test_masking(spark, a, b, masked):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(text.is_masked(F.col("a"), F.col("b"))).first()[0] is masked


def test_long_texts_are_read_whole(spark):
    long = "word " * 20000
    rows = [(long, "", "  " + long), (long, "", "XXXX" + long), (long, "", long + "!")]
    got = _classified(spark, rows)
    assert [got[i].PredClassify for i in range(3)] == ["stringreformat", "masking", "derived"]


def test_equal_triples_are_counted_before_they_are_classified(spark):
    rows = [(t % 2, i1, i2, o) for t in range(6) for i1, i2, o, _, _ in TRUTH]
    rows += [(0, None, "", "x"), (0, "", None, "x"), (0, "2016-01-05", "", "2016-1-5")]
    df = spark.createDataFrame(rows, "t int, i1 string, i2 string, o string")
    got = classify_counts(df, ["t"], "i1", "i2", "o")
    want = classify_bits(df, "i1", "i2", "o").groupBy("t", "PredClassify", "flag_bits").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [c for c, _ in got.dtypes] == ["t", "PredClassify", "flag_bits", "n"]


def test_a_scan_of_one_split_is_dealt_out_by_its_rows(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(0, 1000, 1, 1).selectExpr("id", "0 AS hot").write.parquet(path)
    out = spread(spark.read.parquet(path), rows_per_task=20)
    assert out.columns == ["id", "hot"] and out.rdd.getNumPartitions() == 50
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 60
    assert sorted(r.id for r in out.collect()) == list(range(1000))


def test_triples_are_made_once(spark):
    """No filter in front of the exchange makes them too."""
    plan = pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("date_order") == 1 and "Filter" not in plan


def test_dates_are_matched_once_a_side(spark):
    """The filter on the parts and the layouts shown do not match the texts again."""
    df = all_queries()["pair_date"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2 * len(date.LAYOUTS)


def test_layout_follows_the_parts(spark):
    texts = ["2016-01-31", "01/31/2016", "31.01.2016", "2016-31-01", "10:30", "", "no date", "1-2" + "\x01" * 8]
    df = spark.createDataFrame([(s,) for s in texts], "s string")
    parts = date.date_parts(date.rewrite_date(F.col("s"), layout=True))
    plain = date.date_parts(date.rewrite_date(F.col("s")))
    named = F.slice(parts, 1, len(date.PARTS)) == F.slice(plain, 1, len(date.PARTS))
    got = df.select(date.part_layout(parts), date.date_layout(F.col("s")), named).collect()
    assert [r[0] for r in got] == ["ymd", "mdy", "dmy", "ydm", "time", "time", None, None]
    assert all(r[0] == r[1] and r[2] in (True, None) for r in got)
