from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.llm import repeats
from driftmark.llm.suffixes import common_prefixes, suffix_array
from tests.llm.tables import documents, sorted_rows


def test_suffix_arrays():
    rng = random.Random(0)
    for k in range(200):
        n, letters = rng.randrange(1, 300), rng.choice([b"a", b"ab", b"abcd", b"\x00\xff"])
        text = bytes(rng.choice(letters) for _ in range(n))
        if k % 3 == 0:
            text = (text[: rng.randrange(1, 30)] * 20)[:n].strip(b"\x00") or b"x"
        text = text.rstrip(b"\x00") + b"z"
        data = np.frombuffer(text, np.uint8)
        order = suffix_array(data)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert list(order) == want
        shared = common_prefixes(data, order)
        for r in range(1, len(text)):
            x, y = text[want[r - 1] :], text[want[r] :]
            same = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
            assert shared[r] == same


def brute(rows):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
        kept = hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
        out.append((d, len(b), int(gone.sum()), len(edges) // 2, kept))
    return sorted(out, key=repr)


def sample_rows():
    rng = random.Random(3)
    passages = [
        "".join(rng.choice("abcd é") for _ in range(rng.randrange(80, 400))) for _ in range(12)
    ]
    rows = [
        (None, passages[0]), (1, None), (2, ""), (3, "x" * 99), (4, "x" * 1000), (5, "x" * 100),
        (6, "Und " * 300), (7, "nd U" * 200), (8, "only periodic 123 " * 9), (9, passages[1] * 2),
    ]
    for i in range(150):
        parts = [
            rng.choice(passages)[rng.randrange(0, 30) :]
            if rng.random() < 0.5
            else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 300)))
            for _ in range(rng.randrange(0, 6))
        ]
        rows.append((-i if i % 2 else 1000 + i, " ".join(parts)))
    return rows


# The last case cuts anchors into many shards, so that digests are merged across them.
@pytest.mark.parametrize("slice_bytes,shard,bucket", [(2 << 20, 16_000, 2_000_000), (3000, 3, 100)])
def test_removed_bytes(spark, monkeypatch, slice_bytes, shard, bucket):
    monkeypatch.setattr(repeats, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(repeats, "SHARD_RUNS", shard)
    monkeypatch.setattr(repeats, "BUCKET_RUNS", bucket)
    found = repeats.remove_repeats(documents(spark, sample_rows()).repartition(4))
    digests = found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("gone"),
        F.size("spans").alias("n_spans"), F.sha2("kept", 256).alias("sha"),
    )
    assert sorted_rows(digests, "*") == brute(sample_rows())


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT_BYTES", 1000)
    rng = random.Random(9)
    text = "".join(rng.choice("abcdef") for _ in range(5000))
    rows = [(1, text), (2, text[700:4200]), (3, text[:150] + "!" + text[4000:])]
    found = repeats.remove_repeats(documents(spark, rows))
    got = sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in found.collect())
    assert got == [(1, []), (2, [(0, 3500)]), (3, [(0, 150), (151, 1151)])]


def test_repeated_rows(spark):
    text = "y" + "abcdefghij" * 3 + "0123456789" * 9
    found = repeats.remove_repeats(documents(spark, [(5, text)] * 40))
    assert sorted(r.n_bytes - len(r.kept) for r in found.collect()) == [0] + [len(text)] * 39


def test_empty(spark):
    assert repeats.remove_repeats(documents(spark, [])).count() == 0
    assert repeats.remove_repeats(documents(spark, [(1, None), (2, "")])).count() == 2
