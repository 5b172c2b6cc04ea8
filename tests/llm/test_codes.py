from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.llm import codes, dualtree

SCHEMA = "vec_id long, embedding array<double>, label int, length string, x string, code string, error string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def cut(vector, parts):
    out, at = [], 0
    for p in range(parts):
        width = len(vector) // parts + (p < len(vector) % parts)
        out.append(tuple(vector[at : at + width]))
        at += width
    return out


def brute(rows, parts, entries, rounds):
    """Rows of one length: codebooks and [(id, label, code, error)], one distance at a time."""
    kept = [
        (i, [math.floor(256 * x) for x in v], l)
        for i, v, l in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    split = [cut(v, parts) for _, v, _ in kept]
    books = [[s[p] for s in split[:entries]] for p in range(parts)]

    def nearest(piece, book):
        away = [sum((a - b) ** 2 for a, b in zip(piece, e, strict=True)) for e in book]
        return min(range(len(book)), key=lambda k: (away[k], k)), min(away)

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(s[p], books[p])[0] for s in split]
            for k in range(len(books[p])):
                own = [s[p] for s, at in zip(split, of, strict=True) if at == k]
                if own:
                    books[p][k] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    out = []
    for (i, _, label), s in zip(kept, split, strict=True):
        found = [nearest(s[p], books[p]) for p in range(parts)]
        out.append((i, label, [k for k, _ in found], sum(d for _, d in found)))
    return books, out


def rows_of(rng, n, width, spread=1.0, ids=None):
    return [
        (i if ids is None else rng.choice(ids), [rng.gauss(0, spread) for _ in range(width)], rng.choice([1, 2, None]))
        for i in range(n)
    ]


def found(spark, rows, **options):
    coded, books = codes.compress(table(spark, rows), F.col("label"), **options)
    lists = books.select(
        "length", codes.part_major(F.col("length"), F.col("m"), F.col("entries"), options["parts"]).alias("c")
    )
    return (
        sorted(((r.vec_id, r.label, list(r.code), r.error) for r in coded.collect()), key=repr),
        {r.length: list(r.c) for r in lists.collect()},
    )


def wanted(rows, **options):
    books, out = brute(rows, options["parts"], options["entries"], options["rounds"])
    return sorted(out, key=repr), [c for book in books for entry in book for c in entry]


@pytest.mark.parametrize("width", [8, 10, 3])
def test_against_brute_force(spark, width):
    rng = random.Random(width)
    rows = rows_of(rng, 300, width, 0.05)
    # Repeated rows and ids, ties, null ids, and what takes no part.
    rows += rows[:40] + [(7, [0.5] * width, 1), (7, [-0.5] * width, 1), (None, [0.25] * width, None)]
    bad = [(-1, None, 1), (-2, [math.nan] + [0.0] * (width - 1), 1), (-3, [None] * width, 1), (-4, [math.inf] * width, 1)]
    options = {"parts": 4, "entries": 9, "rounds": 2}
    got, books = found(spark, rows + bad, components=width * 64, **options)
    want, numbers = wanted(rows, **options)
    assert got == want
    assert books == {width: numbers}


def test_lengths_are_coded_apart(spark):
    rng = random.Random(5)
    by_length = {n: rows_of(rng, 60, n, ids=range(50)) for n in (4, 8)}
    options = {"parts": 2, "entries": 5, "rounds": 1}
    got, books = found(spark, [*by_length[4], *by_length[8], (1, [], 3)], **options)
    both = [wanted(by_length[n], **options) for n in (4, 8)]
    assert got == sorted([*both[0][0], *both[1][0], (1, 3, [0, 0], 0)], key=repr)
    assert books == {0: [], 4: both[0][1], 8: both[1][1]}


def test_few_rows_and_none(spark):
    options = {"parts": 2, "entries": 64, "rounds": 2}
    rows = [(3, [0.1, 0.2], 1), (2, [0.1, 0.2], 1), (2, [-0.1, 0.7], 2)]
    got, books = found(spark, rows, **options)
    want, numbers = wanted(rows, **options)
    assert (got, books) == (want, {2: numbers})
    assert found(spark, [], **options) == ([], {})


def test_one_vector_for_a_third_of_all(spark):
    rng = random.Random(9)
    rows = rows_of(rng, 400, 8) + [(i, [0.3] * 8, 1) for i in range(400, 600)]
    options = {"parts": 4, "entries": 16, "rounds": 2}
    got, books = found(spark, rows, components=8 * 100, **options)
    assert (got, books[8]) == wanted(rows, **options)


def test_errors_by_label(spark):
    rows = [(1, "a", 3), (2, "a", 4), (3, None, 5), (4, None, 6), (5, "b", 0)]
    df = spark.createDataFrame(rows, "vec_id long, label string, error long")
    got = {r.vec_id: r.label_error for r in codes.errors_by_label(df).collect()}
    assert got == {1: 7, 2: 7, 3: 11, 4: 11, 5: 0}


def test_too_large_numbers_are_refused(spark):
    with pytest.raises(Exception, match="below"):
        codes.compress(table(spark, [(1, [1e12], 1)]))[0].collect()


@pytest.mark.parametrize("n, width, entries, spread", [(1, 4, 1, 5), (700, 4, 64, 90), (700, 4, 60, 2), (90, 0, 3, 1), (3000, 1, 7, 40)])
def test_dual_tree_equals_all_distances(n, width, entries, spread):
    rng = np.random.default_rng(n + width)
    points = rng.integers(-spread, spread + 1, (n, width))
    book = points[rng.integers(0, n, entries)] + rng.integers(-1, 2, (entries, width))
    depth = dualtree.depth_of(n, dualtree.LEAF)
    tree = dualtree.Tree(points, dualtree.halved(points, depth), depth)
    labels, sums, counts, tried = dualtree.assign(tree, book)
    nearest = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert (labels == nearest).all()
    assert (counts == np.bincount(nearest, minlength=entries)).all()
    assert all((sums[k] == points[nearest == k].sum(0)).all() for k in range(entries))
    assert tried <= n * max(entries, 1 << (entries - 1).bit_length())


def test_clustered_points_are_assigned_in_whole_nodes():
    rng = np.random.default_rng(2)
    centres = rng.integers(-(10**6), 10**6, (32, 4))
    points = centres[rng.integers(0, 32, 8192)] + rng.integers(-50, 51, (8192, 4))
    depth = dualtree.depth_of(len(points), dualtree.LEAF)
    tree = dualtree.Tree(points, dualtree.halved(points, depth), depth)
    labels, *_, tried = dualtree.assign(tree, centres)
    assert (labels == ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)).all()
    assert tried < 0.02 * points.shape[0] * len(centres)
