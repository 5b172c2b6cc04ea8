"""The pipeline's stages, each against a plain version over its own input."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import regex
import tiktoken

import corpus_pipeline
from driftmark.llm import bpe, secrets
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_secrets import brute_base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """What each stage gets, and at last the result, as rows by stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(10_001, None), (10_002, "12 34"), (10_003, "a " * 9 + "token=abcdefghijklmn")],
        "doc_id long, text string",
    ).selectExpr("doc_id", "text", "'en' lang", "cast(null as string) source", "length(text) n_chars")
    out = [docs.unionByName(extra)]
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, out[-1], SF).collect()
        out.append(spark.createDataFrame(rows, out[-1].schema) if len(out) < 5 else rows)
    return [x if isinstance(x, list) else x.collect() for x in out]


def test_order_and_columns(tables):
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == [
        "language", "n-gram", "secret", "mixing", "byte-level",
    ]
    for rows in tables[:5]:
        assert rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_drops_texts_without_letters(tables):
    kept = {r.doc_id for r in tables[1]}
    assert kept == {r.doc_id for r in tables[0] if regex.search(r"\p{L}", r.text or "")}


def test_one_of_each_component(tables):
    want = {d for d, _, c in brute_components([(r.doc_id, r.text) for r in tables[1]]) if d == c}
    assert sorted(r.doc_id for r in tables[2]) == sorted(want)


def test_secrets_are_masked(tables):
    before = {r.doc_id: r for r in tables[2]}
    assert sorted(before) == sorted(r.doc_id for r in tables[3])
    for r in tables[3]:
        assert not brute_base(r.text) and r.n_chars == len(r.text)
        if not brute_base(before[r.doc_id].text):
            assert r.text == before[r.doc_id].text
    assert any("[SECRET]" in r.text for r in tables[3])


def test_mixed_words_come_near_the_targets(tables):
    from tests.llm.test_mixing import brute_targets

    sizes, taken = {}, {}
    for rows, count in ((tables[3], sizes), (tables[4], taken)):
        for r in rows:
            count[r.source] = count.get(r.source, 0) + len(regex.findall(r"[^\x20\x09-\x0D]+", r.text))
    texts = {r.doc_id: r.text for r in tables[3]}
    assert all(texts[r.doc_id].startswith(r.text) for r in tables[4])
    for source, target in brute_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 32


def test_encoding(tables):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    want = []
    for r in tables[4]:
        ids = library.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in tables[5]) == sorted(want)


def test_columns_with_dots(spark):
    docs = spark.createDataFrame(
        [(i, f"{w} " * 200 + "token=abcdefghijklmn", "en", "s", 1, 4 + i) for i, w in ((1, "cat"), (2, "dog"))],
        "doc_id long, text string, lang string, source string, n_chars long, `a.b` int",
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {r["a.b"] for r in out.collect()} == {5, 6}


def test_mask_is_no_secret():
    assert not brute_base("[SECRET]") and secrets.KINDS[0] == "assign"
