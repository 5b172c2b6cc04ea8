"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A text is cut into
pieces; each piece is compressed with either dictionary. The difference of the two sizes over their
sum says which one describes the text better; how far they shrink it says how much it repeats
itself. A logistic curve over the two, fitted on labelled rows that neither dictionary has seen,
turns them into a score.

The fit sees a bounded sample: at most ``SAMPLE_ROWS`` rows of either label, of texts up to
``SAMPLE_TEXT`` bytes. Every whole text is scored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.batches import slices

SAMPLE_ROWS = 2000
SAMPLE_TEXT = 1 << 16
DICTIONARY_BYTES = 1 << 16
PIECE_BYTES = 1 << 10
LEVEL = 3
SLICE_BYTES = 8 << 20
#: Bounds of the logarithm of compressed over plain size.
MOST_SHRUNK, LEAST_SHRUNK = -5.0, -0.5


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slopes: tuple[float, float]
    offset: float
    piece: int = PIECE_BYTES


def pieces_of(text: bytes, piece: int) -> list[bytes]:
    return [text[i : i + piece] for i in range(0, len(text), piece)]


def size_difference(text: bytes, good, bad, piece: int) -> tuple[float, float]:
    """(bad size - good size) / (bad size + good size), above 0 for text like the good one, and the
    logarithm of the mean size over the length, between the bounds below; 0 and the upper bound
    for an empty text."""
    if not text:
        return 0.0, LEAST_SHRUNK
    parts = pieces_of(text, piece)
    g = sum(len(good.compress(p)) for p in parts)
    b = sum(len(bad.compress(p)) for p in parts)
    shrunk = math.log((g + b) / (2 * len(text)))
    return (b - g) / (b + g), min(max(shrunk, MOST_SHRUNK), LEAST_SHRUNK)


def compressor(dictionary: bytes):
    """Without a dictionary (no text of that label) it compresses plainly."""
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    if not dictionary:
        return zstandard.ZstdCompressor(compression_params=params)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


def build_dictionary(texts: list[bytes], size: int, piece: int) -> bytes:
    """A trained dictionary; of few samples, which cannot be trained on, the samples themselves."""
    import zstandard

    parts = [p for t in texts for p in pieces_of(t, piece)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and offset by Newton steps, with a small penalty on the slopes."""
    if not len(x):
        return (0.0, 0.0), 0.0
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.column_stack([x / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-2] * x.shape[1] + [1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge @ w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w[:-1] / scale)), float(w[-1])


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column, rows: int) -> DataFrame:
    """(quality, text, place) of at most about ``rows`` rows of either label, by hash of the id."""
    known = labels.where(F.col("quality").isin(0, 1) & usable).select("doc_id", "quality")
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("quality") == label, F.lit(min(1.0, 1.1 * rows / n))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))
    drawn = known.withColumn("place", place).where(F.col("place") < share * (1 << 30))
    # About 2.2 * rows ids: a size that does not grow with the tables.
    texts = docs.select(F.col("doc_id").alias("id"), "text").where(
        (F.octet_length("text") > 0) & (F.octet_length("text") <= SAMPLE_TEXT)
    )
    joined = texts.join(F.broadcast(drawn), F.col("id") == F.col("doc_id"))
    return joined.select("quality", "text", "place")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> Model:
    """Dictionaries from one half of the sample, the curve from the other.

    docs: doc_id and text; labels: doc_id and quality (0, 1; others are left out). ``usable`` says
    which labels may be learnt from. Without labels every score is 0.5.
    """
    table = training_sample(docs, labels, usable, rows).toArrow().to_pylist()
    table.sort(key=lambda r: (r["place"], r["text"]))
    by_label = {
        q: [r["text"].encode() for r in table if r["quality"] == q][:rows] for q in (0, 1)
    }
    good = build_dictionary(by_label[1][::2], DICTIONARY_BYTES, PIECE_BYTES)
    bad = build_dictionary(by_label[0][::2], DICTIONARY_BYTES, PIECE_BYTES)
    a, b = compressor(good), compressor(bad)
    x, y = [], []
    for q in (0, 1):
        for text in by_label[q][1::2]:
            x.append(size_difference(text, a, b, PIECE_BYTES))
            y.append(q)
    slopes, offset = fit_logistic(np.array(x), np.array(y, float))
    return Model(good, bad, slopes, offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text; null counts as empty, whose difference is 0.

    docs: doc_id and text; other columns are ignored. Null and repeated ids are rows like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.good, model.bad, model.slopes, model.offset, model.piece)
    )

    def compress(batches):
        m = Model(*shared.value)
        good, bad = compressor(m.good), compressor(m.bad)
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = batch.column("text").to_pylist()
            x = [size_difference((t or "").encode(), good, bad, m.piece) for t in texts]
            z = np.array(x) @ np.array(m.slopes) + m.offset
            scores = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64())}
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(compress, f"doc_id {kind}, score double")
