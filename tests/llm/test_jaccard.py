from __future__ import annotations

import collections
import random
import re

import pytest

from driftmark.llm import components, jaccard
from tests.llm.tables import documents, sorted_rows


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (
        frozenset([tuple(w)]) if w else frozenset()
    )


def brute(rows):
    sets = {}
    for d, t in rows:
        sets.setdefault(shingles(t), []).append(d)
    listed, up = list(sets), list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    where = collections.defaultdict(list)
    for i, s in enumerate(listed):
        for j, c in collections.Counter(j for x in s for j in where[x]).items():
            if 100 * c >= 80 * (len(s) + len(listed[j]) - c):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for x in s:
            where[x].append(i)
    least = {}
    for i, s in enumerate(listed):
        least[root(i)] = min([least.get(root(i), 1 << 60), *(d for d in sets[s] if d is not None)])
    out = []
    for i, s in enumerate(listed):
        out += [(d, len(s), least[root(i)] if s else d) for d in sets[s]]
    return sorted(out, key=repr)


def sample_rows(n=250):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a b c"), (5, "A  b\tC"), (6, "a b"), (7, "x" * 50_000), (8, "x" * 50_000), (8, "x" * 50_000)]
    for i in range(n):
        w = list(base) if i % 3 else [f"z{i}_{k}" for k in range(60)]
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(60)] = f"e{rng.randrange(200)}"
        rows.append((10 + i, " ".join(w)))
    return [*rows, (None, " ".join(base)), (900, "É é A É é"), (901, "é é a é é")]


@pytest.mark.parametrize("block", [jaccard.BLOCK_TOKENS, 2000])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", block)
    rows = sample_rows()
    got = jaccard.near_duplicates(documents(spark, rows))
    assert sorted_rows(got, "doc_id", "n_shingles", "component_id") == brute(rows)


def test_many_buckets_and_slices(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_TOKENS", 1000)
    monkeypatch.setattr(jaccard, "SLICE_BYTES", 2000)
    rows = sample_rows(120)
    got = jaccard.near_duplicates(documents(spark, rows).repartition(3))
    assert sorted_rows(got, "doc_id", "n_shingles", "component_id") == brute(rows)


def test_threshold_is_exact(spark):
    """8 of 10 shingles link, 7 of 9 do not."""
    words = [f"v{i}" for i in range(13)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:12])), (3, " ".join([*words[:12], "other"]))]
    assert len(shingles(rows[0][1])) == 9 and len(shingles(rows[1][1])) == 8
    got = jaccard.near_duplicates(documents(spark, rows))
    assert sorted_rows(got, "doc_id", "n_shingles", "component_id") == brute(rows)


def test_one_document_of_each_component_stays(spark):
    rows = sample_rows()
    docs = documents(spark, rows)
    kept = jaccard.one_per_component(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in kept.collect())
    want = {d for d, n, c in brute(rows) if d == c}
    assert sorted(d for d, _ in got) == sorted(want)
    assert set(got) <= set(rows)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_empty(spark):
    assert jaccard.near_duplicates(documents(spark, [])).count() == 0
    assert jaccard.one_per_component(documents(spark, [])).count() == 0
    assert jaccard.near_duplicates(documents(spark, [(1, None), (2, "")])).count() == 2
