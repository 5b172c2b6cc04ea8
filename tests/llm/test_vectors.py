from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from driftmark.llm import neighbours, topk
from tests.llm.tables import sorted_rows

KIND = "vec_id long, embedding array<float>, query_key string, ids string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], KIND)


def sample(n=600, d=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[100:180] = x[100]
    return x


def awkward(d):
    nan, inf = float("nan"), float("inf")
    return [
        (5000, None), (5001, [nan] * d), (5002, [inf] + [0.0] * (d - 1)), (5003, [None] + [1.0] * (d - 1)),
        (5004, [1.0]), (5005, []), (None, [0.5] * d), (3, None),
    ]


def is_query(step=20):
    return F.col("vec_id") % step == 0


def test_exact_products(spark):
    x = sample()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())]
    q = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    want = []
    for i in range(0, 600, 20):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(600), -s)) if j != i][:10]
        want += [(i, r + 1, j, int(s[j])) for r, j in enumerate(order)]
    for block, chunk in ((2048, 8192), (7, 50)):
        got = topk.top_products(
            table(spark, rows + awkward(12)), is_query(), query_block=block, row_chunk=chunk
        )
        assert sorted_rows(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_bounds_never_lose_a_row():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(500, 30)) * 100)
    ids = rng.permutation(500)
    for q in x[:40]:
        levels = [
            (topk.segment_statistics(q[None], n)[0], topk.segment_statistics(x, n)) for n in topk.LEVELS
        ]
        for a, b in levels:
            assert (b @ a >= x @ q - 1e-6).all()
        at, scores = topk.best_rows(q, x, ids, levels, 10)
        order = np.lexsort((ids, -(x @ q)))[:10]
        assert list(at) == list(order) and (scores == (x @ q)[order]).all()


def test_few_or_no_rows(spark):
    three = table(spark, [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, [3.0, 1.0])])
    got = sorted_rows(topk.top_products(three, is_query()), "query_id", "rank", "vec_id")
    assert got == [(0, 1, 2), (0, 2, 1)]
    got = sorted_rows(neighbours.nearest(three, is_query()), "query_id", "rank", "vec_id")
    assert got == [(0, 1, 2)]
    for rows in ([], awkward(3), [(1, [1.0])]):
        assert topk.top_products(table(spark, rows), is_query()).count() == 0
        assert neighbours.nearest(table(spark, rows), is_query()).count() == 0


def test_neighbours(spark):
    x = sample(1500)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (9000, [0.0] * 12)]
    for options in ({}, {"sample_rows": 300}):
        got = neighbours.nearest(table(spark, rows + awkward(12)), is_query(), **options).collect()
        found, hits = {}, 0
        for r in got:
            found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        assert sorted(found) == list(range(0, 1500, 20))
        for i, ranked in found.items():
            exact = np.sqrt(((x.astype(np.float64) - x[i].astype(np.float64)) ** 2).sum(1))
            order = [j for j in np.lexsort((np.arange(1500), exact)) if j != i][:10]
            assert sorted(ranked) == list(range(1, 11))
            listed = [ranked[k] for k in range(1, 11)]
            assert [(s, v) for v, s in listed] == sorted((s, v) for v, s in listed)
            assert all(abs(exact[v] - s) < 1e-12 for v, s in listed)
            hits += len(set(order) & {v for v, _ in listed})
        assert hits / (10 * len(found)) > 0.9
    # Rows 100 to 179 are equal: ties go to the smallest ids.
    assert [found[120][k][0] for k in range(1, 11)] == list(range(100, 110))


def test_queue_pops_the_nearest_leaves():
    x = sample(400)
    forest = neighbours.fit_forest(x.astype(float), 4, 3)
    leaves = neighbours.leaves_of(x.astype(float), forest)
    for i in range(20):
        popped = neighbours.nearest_leaves(x[i].astype(float), forest, 48)
        assert len(set(popped)) == 48
        # A point on a cut lies in both leaves.
        assert {(t, leaves[t, i]) for t in range(3)} <= set(popped[:6])


def brute(rows, score, best_first, nearest=False):
    """Every distinct row of an id divisible by 20 against all rows of its length and another id."""
    kept = sorted({(i, tuple(v)) for i, v in rows if not nearest or any(v)})
    out = []
    for i, q in kept:
        if i % 20:
            continue
        found = sorted((best_first * score(q, v), j) for j, v in kept if j != i and len(v) == len(q))
        out += [(i, r + 1, j, best_first * s) for r, (s, j) in enumerate(found[:10])]
    return sorted(out)


def mixed_table(seed=2):
    """Ids that several vectors share, queries among them, and vectors of two lengths."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(260, 8)).astype(np.float32)
    rows = [(i % 90, v.tolist()) for i, v in enumerate(x)]
    rows += [(i, v[:3]) for i, v in rows[:70]] + [rows[0], (500, rows[0][1]), (40, rows[0][1])]
    return rows


def test_products_with_repeated_ids_and_two_lengths(spark):
    rows = mixed_table()

    def product(a, b):
        whole = [np.floor(1024 * np.float64(np.float32(v))) for v in (a, b)]
        return int(whole[0] @ whole[1])

    want = brute(rows, lambda a, b: product(np.array(a), np.array(b)), -1)
    got = topk.top_products(table(spark, rows), is_query())
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == want


def test_neighbours_with_repeated_ids_and_two_lengths(spark):
    rows = mixed_table()

    def distance(a, b):
        return float(np.sqrt(((np.float64(np.float32(a)) - np.float64(np.float32(b))) ** 2).sum()))

    want = brute(rows, lambda a, b: distance(np.array(a), np.array(b)), 1, nearest=True)
    got = neighbours.nearest(table(spark, rows), is_query(), share=100.0)
    got = sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()))
    # Two vectors of one id may stand at the same rank of the two.
    assert [(q, r, v) for q, r, v, _ in got] == [(q, r, v) for q, r, v, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want], atol=1e-12)
