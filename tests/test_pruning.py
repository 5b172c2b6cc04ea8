"""Cost-complexity pruning against all subtrees of small trees."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from driftmark.operators import features, models, pruning


def random_tree(rng, first=0, depth=0):
    if depth == 4 or (depth > 1 and rng.random() < 0.3):
        return pruning.Node(first, first + 1)
    left = random_tree(rng, first, depth + 1)
    right = random_tree(rng, left.last, depth + 1)
    return pruning.Node(first, right.last, [left, right])


def all_subtrees(node):
    """Sets of leaves of every pruning."""
    alone = [((node.first, node.last),)]
    if not node.below:
        return alone
    left, right = (all_subtrees(x) for x in node.below)
    return alone + [a + b for a in left for b in right]


def error_of(leaves, counts):
    wrong = 0.0
    for first, last in leaves:
        weights = pruning._label_weights(pruning.Node(first, last), counts)
        wrong += sum(weights.values()) - max(weights.values(), default=0.0)
    return wrong


@pytest.mark.parametrize("seed", range(12))
def test_every_subtree_of_the_sequence_is_the_best(seed):
    rng = random.Random(seed)
    root = random_tree(rng)
    counts = {
        i: {float(c): float(rng.randrange(0, 12)) for c in range(3) if rng.random() < 0.8} for i in range(root.last)
    }
    found = pruning.pruning_sequence(root, counts)
    every = all_subtrees(root)
    assert found[-1].leaves == ((0, root.last),)
    ranges = zip(found, [s.complexity for s in found[1:]] + [found[-1].complexity + 5], strict=True)
    for subtree, following in ranges:
        assert subtree.error == pytest.approx(error_of(subtree.leaves, counts))
        for complexity in (subtree.complexity, (subtree.complexity + following) / 2):
            costs = {x: error_of(x, counts) + complexity * len(x) for x in every}
            least = min(costs.values())
            assert costs[subtree.leaves] == pytest.approx(least)
            # Of equally good ones it is the smallest.
            assert len(subtree.leaves) == min(len(x) for x, c in costs.items() if c <= least + 1e-9)
    for small, large in zip(found[1:], found[:-1], strict=True):
        assert small.complexity > large.complexity
        assert all(any(a <= x and y <= b for a, b in small.leaves) for x, y in large.leaves)


@pytest.fixture(scope="module")
def table(spark):
    """Four labels by two thresholds, a third feature of noise, and a tenth of labels at random."""
    u = F.pmod(F.hash("id", F.lit(1)), F.lit(100))
    v = F.pmod(F.hash("id", F.lit(2)), F.lit(100))
    odd = F.pmod(F.hash("id", F.lit(3)), F.lit(10)) == 0
    label = F.when(odd, F.pmod(F.hash("id", F.lit(4)), F.lit(4))).otherwise(
        (u > 40).cast("int") * 2 + (v > 70).cast("int")
    )
    rows = spark.range(6000).select(
        u.cast("double").alias("u"), v.cast("double").alias("v"), label.cast("double").alias("y"),
        F.pmod(F.hash("id", F.lit(5)), F.lit(7)).cast("double").alias("noise"), F.lit(1.0).alias("n"),
        F.pmod(F.hash("id", F.lit(6)), F.lit(5)).cast("int").alias("fold"),
    )
    return features.assemble(rows, ["u", "v", "noise"]).cache()


def test_shape_and_counts_follow_the_model(table):
    model = models.fit_tree(table, "y", depth=6)
    root = pruning.tree_shape(model)
    counts = pruning.leaf_counts(model, table, "y")
    assert root.last == (model.numNodes + 1) // 2
    assert set(counts) <= set(range(root.last))
    assert sum(w for c in counts.values() for w in c.values()) == 6000
    scored = model.transform(table)
    wrong = scored.where("prediction <> y").count()
    whole = pruning.Subtree(0.0, tuple((i, i + 1) for i in range(root.last)), 0.0)
    assert pruning.held_out_error(whole, counts, counts) == pytest.approx(wrong)


def test_complexity_table(table):
    rows = pruning.complexity_table(table, "y", "fold", 5, depth=7).collect()
    first, last = rows[0], rows[-1]
    assert (first.n_splits, first.rel_error, first.cv_error) == (0, 1.0, pytest.approx(1.0, abs=0.05))
    assert [r.n_splits for r in rows] == sorted({r.n_splits for r in rows})
    assert [r.complexity for r in rows] == sorted((r.complexity for r in rows), reverse=True)
    assert [r.rel_error for r in rows] == sorted((r.rel_error for r in rows), reverse=True)
    assert last.complexity == 0.0
    # Three splits are the truth; more of them only fit the noise.
    best = min(rows, key=lambda r: r.cv_error)
    true = next(r for r in rows if r.n_splits == 3)
    assert true.cv_error <= best.cv_error + best.cv_std
    assert last.cv_error > true.cv_error and all(r.cv_std < 0.05 for r in rows)


def test_one_label_and_no_rows(table):
    one = table.where("y = 0")
    assert [tuple(r) for r in pruning.complexity_table(one, "y", "fold", 3).collect()] == [(0.0, 0, 0.0, 0.0, 0.0)]
    none = table.where("y > 9")
    assert [tuple(r) for r in pruning.complexity_table(none, "y", "fold", 3).collect()] == [(0.0, 0, 0.0, 0.0, 0.0)]
