"""Roll-up, decimals, segments, features, nearest centre."""

from __future__ import annotations

import datetime as dt
from decimal import ROUND_HALF_DOWN, Decimal

import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from driftmark.functions import scalars as S
from driftmark.functions.segments import as_feature, customer_segment
from driftmark.operators import features, nearest, rollup


@pytest.mark.parametrize(
    ("score", "late", "label"),
    [
        (601, 0, "good"),
        (601, -9999, "good"),
        (299, 1, "bad"),
        (601, 1, "ClassC"),
        (299, 0, "ClassD"),
        (300, 0, "ClassE"),
        (600, 0, "ClassE"),
        (300, 1, "ClassF"),
        (600, 5, "ClassF"),
        (None, 0, "NA"),
        (700, None, "NA"),
        (None, None, "NA"),
    ],
)
def test_segment_rule(spark, score, late, label):
    df = spark.createDataFrame([(score, late)], "s bigint, d bigint")
    assert df.select(customer_segment(F.col("s"), F.col("d"))).first()[0] == label


def test_null_feature_is_zero(spark):
    df = spark.createDataFrame([(None,), (5,)], "s bigint")
    assert [r[0] for r in df.select(as_feature(F.col("s"))).collect()] == [0.0, 5.0]


@pytest.mark.parametrize(
    "text",
    ["1.25", "1.35", "-1.25", "0.00000000005", "-0.00000000005", "0.000000000050001",
     "2.00000000015", "123456789012345.12345678905", "0", "9.99999999995"],
)
def test_half_down(spark, text):
    df = spark.createDataFrame([(Decimal(text),)], "x decimal(38,18)")
    for digits in (1, 10):
        got = df.select(S.half_down(F.col("x"), digits)).first()[0]
        want = Decimal(text).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_DOWN)
        assert got == want
    plain = df.select(S.half_down_text(F.col("x").cast("decimal(38,18)"))).first()[0]
    assert Decimal(plain) == Decimal(text) and len(plain.split(".")[1]) == 20


def test_safe_parses(spark):
    rows = [("5",), ("+5",), ("99999999999",), ("x",), ("",), (None,), ("1.5",)]
    df = spark.createDataFrame(rows, "s string")
    ints = [r[0] for r in df.select(S.safe_int(F.col("s"))).collect()]
    assert ints[:6] == [5, 5, 0, 0, 0, 0]
    floats = [r[0] for r in df.select(S.safe_float(F.col("s"))).collect()]
    assert floats[3:] == [0.0, 0.0, 0.0, 1.5]


def test_blanks(spark):
    df = spark.createDataFrame([(" \t a b \n",)], "s string")
    s = F.col("s")
    row = df.select(S.trim_controls(s), S.leading_blanks(s), S.trailing_blanks(s), S.last_two(s)).first()
    assert tuple(row) == ("a b", 3, 2, " \n")


@pytest.fixture(scope="module")
def accounts(spark):
    rows = [
        ("2016-03-31", 1, "10.00", "0.10", "-0.05"),
        ("2016-03-31", 2, "20.50", "0.20", "-0.05"),
        ("2016-04-30", 1, "11.00", "0.10", "-0.05"),
        ("2014-12-31", 1, "9.00", "0.10", "-0.05"),
    ]
    raw = spark.createDataFrame(
        rows, "asofdate string, loannum int, acc_ldgr_bl string, int_acru_am string, intreservebal string"
    )
    money = ("acc_ldgr_bl", "int_acru_am", "intreservebal")
    return raw.withColumns(
        {"asofdate": F.col("asofdate").cast("date"), **{c: F.col(c).cast("decimal(18,2)") for c in money}}
    )


def test_rollup(accounts):
    rows = rollup.ordered(rollup.asof_rollup(accounts)).collect()
    assert [(r.year, r.month, r.day, r.cnt) for r in rows] == [
        (2014, 12, 31, 1), (2016, 3, 31, 2), (2016, 4, 30, 1)
    ]
    assert rows[1].acc_ldgr_sum == Decimal("30.50")
    kept = rollup.drop_first_date(rollup.asof_rollup(accounts)).collect()
    assert {str(r.asofdate) for r in kept} == {"2016-03-31", "2016-04-30"}
    frame = rollup.regression_frame(rollup.asof_rollup(accounts))
    assert {t for _, t in frame.dtypes} == {"double"}


def test_asof_filter_reaches_the_scan(spark, accounts, tmp_path):
    path = str(tmp_path / "accounts")
    accounts.write.parquet(path)
    dates = [dt.date(2016, 3, 31), dt.date(2016, 4, 30)]
    kept = rollup.asof_in(spark.read.parquet(path), dates)
    assert kept.count() == 3
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(asofdate" in plan


def test_label_index_and_one_hot_match_the_encoders(spark):
    labels = ["b"] * 3 + ["a"] * 3 + ["c"] * 5 + ["d"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    ours = {
        r.label: (r.label_index, r.is_0, r.is_1, r.is_2)
        for r in features.one_hot(features.label_index(df, "label"), 4).collect()
    }
    coded = features.index_and_encode(df, "label").transform(df).distinct().collect()
    assert len(coded) == 4
    for r in coded:
        assert ours[r.label] == (r.label_index, *r.label_vec.toArray())
    assert ours["c"][0] == 0.0 and ours["a"][0] == 1.0


def test_nearest_centre_agrees_with_the_cluster_model(spark):
    df = spark.range(400).select(
        "id",
        (F.pmod(F.hash("id"), F.lit(1000)) / 10.0).alias("x"),
        (F.pmod(F.hash("id", F.lit(1)), F.lit(1000)) / 10.0).alias("y"),
    )
    data = features.assemble(df, ["x", "y"])
    model = KMeans(k=5, seed=3).fit(data)
    scored = nearest.nearest_centre(model.transform(data), ["x", "y"], model.clusterCenters())
    assert scored.where("cluster != prediction").count() == 0
    assert "Exchange" not in nearest.nearest_centre(
        df, ["x", "y"], model.clusterCenters()
    )._jdf.queryExecution().executedPlan().toString()


def test_nearest_centre_tie_takes_the_lowest_id(spark):
    df = spark.createDataFrame([(0.0,)], "x double")
    assert nearest.nearest_centre(df, ["x"], [[1.0], [-1.0]]).first().cluster == 0
