from __future__ import annotations

import os
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from driftmark.llm import langid, quality, queries
from tests.llm.tables import documents, sorted_rows

SF = "/root/testdata/sf0.01"


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    k, n = 3, 4
    e, t = rng.normal(size=(2, n, k)), rng.normal(size=(k, k))
    lengths = np.array([4, 2])
    p, pairs = langid.forward_backward(e, lengths, t)
    total = np.zeros((k, k))
    for c, length in enumerate(lengths):
        weight, marginal, joint = 0.0, np.zeros((length, k)), np.zeros((k, k))
        for labels in np.ndindex(*[k] * length):
            s = sum(e[c, i, y] for i, y in enumerate(labels))
            s = np.exp(s + sum(t[a, b] for a, b in zip(labels, labels[1:], strict=False)))
            weight += s
            for i, y in enumerate(labels):
                marginal[i, y] += s
            for a, b in zip(labels, labels[1:], strict=False):
                joint[a, b] += s
        assert np.allclose(p[c, :length], marginal / weight)
        total += joint / weight
    assert np.allclose(pairs, total)


def test_code_switched_words():
    rng = random.Random(1)
    words = {"xx": ["alpha", "albo", "alma", "alto"], "yy": ["zeki", "zuki", "zaki", "zoki"]}
    sample = [(lang, " ".join(rng.choices(words[lang], k=60))) for lang in words for _ in range(20)]
    label = langid.Labeller(langid.train(sample))
    p = label(["alpha albo alma alto " * 5, "zeki zuki " * 9, "alma alto alma zeki", "12 !", ""])
    assert p[0, 0] > 0.9 and p[1, 1] > 0.9 and 0.5 < p[2, 0] < 0.95
    assert not p[3:].any()


def test_language_accuracy_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_crf_language(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_edge_cases(spark):
    docs = documents(
        spark, [(1, None), (2, "12 345"), (3, "hello there"), (3, "hello there"), (None, "x" * 50_000)]
    )
    model = langid.fit(docs, F.lit(True))
    got = sorted_rows(langid.predict(docs, model), "doc_id", "lang_pred")
    assert got == [(1, "und"), (2, "und"), (3, "en"), (3, "en"), (None, "en")]
    kept = langid.with_language(docs, model)
    assert kept.columns == docs.columns and kept.count() == 3
    nothing = langid.fit(documents(spark, []), F.lit(True))
    assert sorted_rows(langid.predict(docs, nothing), "lang_pred") == [("und",)] * 5
    assert langid.predict(documents(spark, []), model).count() == 0


def test_every_language_is_learnt(spark):
    rng = random.Random(5)
    rows = []
    for i in range(80):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)]
        for _ in range(4 if i % 2 else 3):
            rows.append((len(rows), " ".join(rng.choices(words, k=60)), f"l{i:02}"))
    # Documents of one language are all long, and begin with more than a sample's text of digits.
    long = "7 " * 30_000 + "ŋandi ŋurra wanti ŋulu " * 2_000
    rows += [(None, long, "long"), (None, long, "long"), (5000, long + "ŋa", "long"), (5001, "12", "none")]
    docs = documents(spark, rows)
    model = langid.fit(docs, F.lit(True))
    assert model.languages == sorted({r[2] for r in rows} - {"none"})
    got = langid.predict(docs.select("text", F.col("lang").alias("doc_id")), model).collect()
    assert np.mean([r.doc_id == r.lang_pred for r in got if r.doc_id != "none"]) > 0.97
    assert {r.lang_pred for r in got if r.doc_id == "long"} == {"long"}


def test_language_gate(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learnt = docs.where(F.col("lang") != "es")
    model = langid.fit(learnt, ~queries.held_out(2, 4))
    assert 1 / 3 < model.least < 1
    held = learnt.where(queries.held_out(2, 4) & F.col("text").rlike("[a-z]"))
    assert langid.with_language(held, model).count() >= 0.99 * held.count()
    rng = random.Random(1)
    letters = "абвгдежзийклмнопрст"
    noise = [(i, " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(80))) for i in range(50)]
    assert langid.with_language(documents(spark, noise), model).count() == 0
    nothing = langid.fit(documents(spark, []), F.lit(True))
    rows = documents(spark, [*noise, (90, None), (91, "12"), (92, "ok")])
    assert langid.with_language(rows, nothing).count() == 51


def test_quality_on_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op3_compression_quality(spark, SF).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    good = np.array([r.score for r in held if labels[r.doc_id] == 1])
    bad = np.array([r.score for r in held if labels[r.doc_id] == 0])
    assert (good[:, None] > bad[None]).mean() > 0.9
    assert (good >= 0.3).mean() > 0.95


def test_quality_edge_cases(spark):
    rng = random.Random(3)
    prose = [" ".join(rng.choices(["the", "cat", "sat", "on", "mats"], k=60)) for _ in range(60)]
    junk = [" ".join(rng.choices(["$$$", "%%%", "!!!", "###"], k=60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(prose + junk)] + [(900, None), (901, ""), (None, "z" * 90_000)]
    labels = spark.createDataFrame(
        [(i, int(i < 60)) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, quality int"
    )
    model = quality.fit(documents(spark, rows), labels, F.lit(True))
    got = {r.doc_id: r.score for r in quality.score(documents(spark, rows), model).collect()}
    assert len(got) == 123 and all(0 <= s <= 1 for s in got.values())
    assert min(got[i] for i in range(60)) > max(got[i] for i in range(60, 120))
    assert got[900] == got[901]
    unlabelled = quality.fit(documents(spark, rows), labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(documents(spark, rows), unlabelled).collect()} == {0.5}
    assert quality.score(documents(spark, []), model).count() == 0


def test_the_driver_does_not_train(spark, monkeypatch):
    driver, train = os.getpid(), langid.train

    def elsewhere(sample):
        assert os.getpid() != driver
        return train(sample)

    docs = documents(spark, [(i, t, lang) for i, (t, lang) in enumerate([("good morning", "en"), ("guten tag", "de")] * 9)])
    monkeypatch.setattr(langid, "train", elsewhere)
    model = langid.fit(docs, F.lit(True))
    assert model.languages == ["de", "en"] and model.weights.any() and 0 < model.least < 1
