"""Samples, positions and quantiles, with one key that holds most rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.operators import profile, quantiles, sampling


@pytest.fixture(scope="module")
def skewed(spark):
    """30,000 rows of key 'hot', 300 of others; many equal values."""
    return spark.range(30300).select(
        "id",
        F.when(F.col("id") < 30000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 3)).alias("k"),
        (F.pmod(F.hash("id"), F.lit(5000)) / 7.0).alias("x"),
    ).cache()


@pytest.mark.parametrize("fraction", [0.0, 0.25, 0.8, 0.801, 1.0])
def test_exact_sample_size(skewed, fraction):
    drawn = sampling.exact_sample(skewed, fraction, ["id"], seed=7)
    assert drawn.count() == 30300
    assert drawn.where("in_sample").count() == int(fraction * 30300)


def test_sample_changes_with_the_seed_only(skewed):
    def ids(seed):
        return {r.id for r in sampling.exact_sample(skewed, 0.1, ["id"], seed).where("in_sample").collect()}

    assert ids(1) == ids(1)
    assert ids(1) != ids(2)


def test_hash_split_normalises_weights_and_covers_all(skewed):
    a, b = sampling.hash_split(skewed, [0.7, 0.2], ["id"], 11)
    assert a.count() + b.count() == 30300
    assert a.join(b, "id").count() == 0
    assert a.count() / 30300 == pytest.approx(0.7 / 0.9, abs=0.01)


def test_hash_split_does_not_depend_on_partitions(skewed):
    a = sampling.hash_split(skewed, [0.5, 0.5], ["id"], 3)[0]
    b = sampling.hash_split(skewed.repartition(13), [0.5, 0.5], ["id"], 3)[0]
    assert {r.id for r in a.collect()} == {r.id for r in b.collect()}


def test_random_split_covers_all(skewed):
    parts = sampling.random_split(skewed, [0.7, 0.2], 11)
    assert sum(p.count() for p in parts) == 30300


def test_shuffle_is_a_permutation(skewed):
    got = [r.shuffle_pos for r in sampling.shuffled(skewed, ["id"], 5).orderBy("id").collect()]
    assert sorted(got) == list(range(1, 30301))
    assert got != sorted(got)


@pytest.mark.parametrize("ranged", [True, False])
def test_positions_with_a_hot_key(skewed, ranged):
    bucket = None if ranged else F.floor(F.col("x") / 50)
    got = sampling.with_position(skewed, ["k"], [F.col("x"), F.col("id")], bucket).collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r.k, []).append((r.x, r.id, r.position))
    assert sum(map(len, by_key.values())) == 30300
    for rows in by_key.values():
        assert [p for *_, p in sorted(rows)] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("accuracy", [10000, 50])
def test_quantiles_are_exact_even_with_a_poor_sketch(skewed, accuracy):
    probs, names = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0), tuple("abcdefg")
    got = {r.k: r for r in quantiles.exact_quantiles(skewed, ["k"], "x", probs, names, accuracy).collect()}
    data = skewed.toPandas()
    for k, group in data.groupby("k"):
        want = np.quantile(group.x, probs)
        assert got[k].n == len(group)
        assert [got[k][n] for n in names] == pytest.approx(list(want))
    whole = quantiles.exact_quantiles(skewed, [], "x", (0.5,), ("m",), accuracy).first()
    assert whole.m == pytest.approx(np.quantile(data.x, 0.5))


def test_quantiles_widen_their_fences_until_found(skewed):
    """Fences far closer than the error of the sketch miss at first."""
    got = quantiles.exact_quantiles(skewed, ["k"], "x", (0.3, 0.6), ("a", "b"), 20, margin=1e-3)
    data = skewed.toPandas()
    for r in got.collect():
        assert (r.a, r.b) == pytest.approx(tuple(np.quantile(data[data.k == r.k].x, (0.3, 0.6))))


def test_quantiles_of_equal_and_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0)] * 50 + [("a", None), ("b", None), ("c", 4.0)], "k string, x double")
    rows = quantiles.exact_quantiles(df, ["k"], "x", (0.25, 0.5), ("q", "m")).collect()
    assert {(r.k, r.n, r.q, r.m) for r in rows} == {("a", 50, 1.0, 1.0), ("c", 1, 4.0, 4.0)}


def test_box_figures(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 12), 100]], "x double")
    row = quantiles.box_stats(df, [], "x").first()
    assert (row.q1, row.med, row.q3) == pytest.approx((3.75, 6.5, 9.25))
    assert (row.low, row.high, row.whisker_low, row.whisker_high, row.n_outside) == (1, 100, 1, 11, 1)
    assert [r.x for r in quantiles.outside_points(df, [], "x").collect()] == [100.0]


def test_histogram_counts_every_row(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)], "x double")
    rows = profile.histogram(df, "x", 10).orderBy("bin").collect()
    assert [r.n for r in rows] == [10] * 9 + [11]
    assert (rows[0].low, rows[-1].high) == (0.0, 100.0)
    flat = spark.createDataFrame([(5.0,)] * 4, "x double")
    assert [(r.bin, r.n) for r in profile.histogram(flat, "x").collect()] == [(1, 4)]


def test_null_figures(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert {(r.column, r.n_null) for r in profile.null_counts(df).collect()} == {("a", 1), ("b", 2)}
    assert {(r.is_null, r.cells) for r in profile.null_total(df).collect()} == {(True, 3), (False, 3)}
