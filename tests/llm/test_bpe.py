from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import tiktoken

from driftmark.llm import bpe, queries
from tests.llm.tables import documents

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


TEXTS = [
    None, "", "a", " ", "a" * 3000, "   x \n\n y\u0085z  ", "it's  we'll 12345٣ 😀😀 ﬁ <|endoftext|>\x00\x01",
    "ab" * 70 + " " * 300 + "x", "Ünïcödé" * 40, "-" * 500 + "=" * 77, "\t\t\t   \r\n", "x\x1c\x1d \x1f y\x0b\x0c z\x7f",
    "café\x1c \x1c  z", "the cat sat on the mat. " * 500,
]


@pytest.mark.parametrize("most", [0, 5, 1 << 20])
def test_same_ids_as_the_library(spark, ranks, encoding, most):
    docs = documents(spark, [(i // 2, t) for i, t in enumerate(TEXTS)] + [(None, "null id")])
    rows = bpe.encode(spark, docs, ranks, public_tokenizers.PATTERN, most).collect()
    got = sorted((repr(r.doc_id), list(r.ids)) for r in rows)
    want = [(repr(i // 2), encoding.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)]
    assert got == sorted([*want, ("None", encoding.encode_ordinary("null id"))])


def test_round_trip(spark):
    docs = documents(spark, list(enumerate(TEXTS)))
    for r in queries.encoded_digests(spark, docs, PATH).collect():
        text = (TEXTS[r.doc_id] or "").encode()
        assert r.decoded_sha256 == hashlib.sha256(text).hexdigest()


def test_long_words_merge_alike(ranks, encoding):
    for word in (b"a" * 999, b"abcabd" * 77, "é".encode() * 200, b"q"):
        ids = bpe.heap_merges(word, ranks)
        assert b"".join(encoding.decode_single_token_bytes(i) for i in ids) == word
        assert ids == encoding._encode_single_piece(word)


def test_empty(spark, ranks):
    assert bpe.encode(spark, documents(spark, []), ranks).count() == 0


def test_words_merge_alike_in_step(ranks, encoding):
    words = [b"", b"a", b"the", b" ofonouhewh", "é😀ñ".encode() * 9, b"ab" * 64, b"a" * 129, bytes(range(256))]
    words += [bytes(97 + i * j % 7 for j in range(i % 40)) for i in range(500)]
    n, ids = bpe.merged_words(words, ranks, bpe.PairTable.of(ranks))
    cuts = [0, *n.cumsum()]
    for word, a, b in zip(words, cuts[:-1], cuts[1:], strict=True):
        assert ids[a:b].tolist() == (encoding._encode_single_piece(word) if word else [])
    assert b == len(ids)


def test_equal_and_overlapping_pairs_merge_from_the_left():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"ab": 257, b"aab": 258, b"abab": 259}
    words = [b"aaab", b"aaaaa", b"ababab", b"baab", b"abaab"]
    n, ids = bpe.merged_words(words, ranks, bpe.PairTable.of(ranks))
    assert ids.tolist() == [i for w in words for i in bpe.heap_merges(w, ranks)]
    assert n.tolist() == [len(bpe.heap_merges(w, ranks)) for w in words]


def test_no_rare_word_is_left_to_the_interpreted_fold(spark, ranks):
    docs = documents(spark, [(i, f"qzxv{i} jkwq{i}") for i in range(20)])
    plan = bpe.encode(spark, docs, ranks, most=0)._jdf.queryExecution().toString()
    assert "aggregate(" not in plan and "lambda" not in plan


def test_what_is_broadcast_is_plain(spark, ranks, monkeypatch):
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(x) or send(x))
    bpe.encode(spark, documents(spark, [(1, "x")]), ranks)
    values = [y for x in sent for y in x]
    assert values and not any(type(y).__module__.startswith("driftmark") for y in values)
