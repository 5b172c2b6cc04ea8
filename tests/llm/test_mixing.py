from __future__ import annotations

import random

from pyspark.sql import functions as F

from driftmark.llm import mixing
from tests.llm.tables import documents, sorted_rows


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        level = rest / open_ if open_ else 0.0
        new = {s for s in names if s not in full and weight[s] * level > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= new


def sample_rows():
    rng = random.Random(5)
    rows = []
    for s, (n, words) in enumerate([(400, 30), (30, 10), (5, 200), (60, 5), (1, 3)]):
        for i in range(n):
            text = " ".join(["w"] * rng.randrange(0, words))
            rows.append((1000 * s + i, text, "en", None if s == 3 else f"s{s}"))
    return [*rows, (7, None, "en", "s1"), (None, "a b", "en", "s1"), *[(8, "q r s", "en", "s0")] * 20]


def test_targets_limits_and_reruns(spark):
    docs = documents(spark, sample_rows())
    first = sorted_rows(mixing.mix(docs), "doc_id", "size", "source_size", "target", "taken")
    again = mixing.mix(docs.repartition(3))
    assert first == sorted_rows(again, "doc_id", "size", "source_size", "target", "taken")
    sizes, of = {}, {}
    for _, text, _, source in sample_rows():
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    targets = brute_targets(sizes)
    taken = {}
    for _, size, source_size, target, t in first:
        assert 0 <= t <= 3 * size
        source = next(s for s in sizes if sizes[s] == source_size)
        assert abs(target - targets[source]) < 1e-6
        taken[source] = taken.get(source, 0) + t
        of[source] = target
    for source, target in of.items():
        assert abs(taken[source] - target) <= 2 * mixing.BLOCK_WORDS


def test_quotas_are_the_highest_quotients(spark):
    """Seats from the narrow window of quotients equal those from all quotients."""
    docs = documents(spark, sample_rows(), clash=False)
    sizes = docs.select(
        mixing.source_key(F.col("source")).alias("source_key"),
        "doc_id",
        mixing.word_count(F.col("text")).alias("size"),
    )
    targets, total, open_weight = mixing.source_targets(mixing._grouped(sizes))
    got = {
        r.source_key: r.seats
        for r in mixing.source_seats(targets, total, open_weight, 16, 3).collect()
    }
    offers = [
        (-r.weight / (2 * s + 1), r.source_key)
        for r in targets.collect()
        for s in range(3 * r.source_size // 16)
    ]
    want = dict.fromkeys(got, 0)
    for _, key in sorted(offers)[: total // 16]:
        want[key] += 1
    assert got == want


def test_many_shards_and_mixed_texts(spark):
    docs = documents(spark, sample_rows())
    lines = mixing.mix(docs, shard_rows=50)
    out = mixing.mixed_documents(docs, shard_rows=50)
    assert out.columns == docs.columns
    words = out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == lines.agg(F.sum("taken")).first()[0]
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0


def test_empty(spark):
    docs = documents(spark, [])
    assert mixing.mix(docs).count() == 0
    assert mixing.mixed_documents(docs).count() == 0
    assert mixing.mix(documents(spark, [(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0
