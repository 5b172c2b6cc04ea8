"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> rows for the next stage."""

from __future__ import annotations

import public_tokenizers

from driftmark.llm import jaccard, langid, mixing, queries, secrets
from driftmark.llm.batches import small_batches


def identified(spark, docs, sf_dir):
    """Documents in a language that the labelled ones teach; noise and texts without a letter go."""
    small_batches(spark)
    return langid.with_language(docs, langid.fit(docs, ~queries.held_out(2, 4)))


def deduplicated(spark, docs, sf_dir):
    """One document, that of the smallest id, of every component of near duplicates."""
    small_batches(spark)
    return jaccard.one_per_component(docs)


def masked(spark, docs, sf_dir):
    """Documents with what the secret scan reports masked."""
    return secrets.masked_documents(docs)


def mixed(spark, docs, sf_dir):
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encoded(spark, docs, sf_dir):
    """Token counts and digests of every document."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return queries.encoded_digests(spark, docs, path)
