"""Whitening of vectors: blockwise QR, then the singular vectors of one triangle.

Vectors become whole numbers, floor(scale * x). Every distinct one counts once (the fit list).
Sums are exact. Blocks of centred rows are reduced to their triangle R by QR; triangles are stacked
and reduced again, in rounds of a fixed fan-in, until one is left, whose singular values and
vectors ``bidiagonal`` finds. The covariance is never formed, so small values keep their digits.

Vectors of different lengths have no common components; those of each length are whitened among
themselves. Models stay in a table, one row per length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.bidiagonal import EPS, principal_directions
from driftmark.llm.vectors import chunk_rows, numbers, of_one_length, one_list, whole_vectors
from driftmark.sources.scratch import materialize

SCALE = 256.0
COMPONENTS = 4
CHUNK_COMPONENTS = 1 << 19
#: Numbers of the triangles that are stacked in one task, and the most triangles.
STACK, FAN_IN = 1 << 24, 32


def packed(vectors: DataFrame, components: int = CHUNK_COMPONENTS) -> DataFrame:
    """(length, vec_id, points): lists of about ``components`` numbers, vectors of one length each."""

    def pack(batches):
        for length, table in of_one_length(batches, "x", components):
            points = numbers(table, "x", length)
            yield pa.record_batch(
                {
                    "length": pa.array([length], pa.int32()),
                    "vec_id": one_list(table["vec_id"]),
                    "points": one_list(pa.array(points.ravel())),
                }
            )

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(
        pack, "length int, vec_id array<bigint>, points array<bigint>"
    )


def _points(row: dict) -> np.ndarray:
    return np.asarray(row["points"], np.int64).reshape(len(row["vec_id"]), row["length"])


def _added_up(lists: DataFrame, kind: str) -> DataFrame:
    """(length, totals): lists of equal length added up place by place."""
    return (
        lists.select("length", F.posexplode("totals").alias("at", "total"))
        .groupBy("length", "at")
        .agg(F.sum("total").alias("total"))
        .groupBy("length")
        .agg(F.sort_array(F.collect_list(F.struct("at", "total")))["total"].cast(kind).alias("totals"))
    )


def sums(fit_list: DataFrame) -> DataFrame:
    """(length, n, sums): number of vectors, and their sums per dimension."""

    def add_up(batches):
        for row in chunk_rows(batches):
            points = _points(row)
            totals = np.concatenate(([len(points)], points.sum(0)))
            yield pa.record_batch(
                {"length": pa.array([row["length"]], pa.int32()), "totals": one_list(pa.array(totals))}
            )

    total = _added_up(fit_list.mapInArrow(add_up, "length int, totals array<bigint>"), "array<bigint>")
    return total.select(
        "length",
        F.get("totals", F.lit(0)).alias("n"),
        F.slice("totals", F.lit(2), F.size("totals")).alias("sums"),
    )


def _centred(points: np.ndarray, n: int, totals: np.ndarray) -> np.ndarray:
    """x - S / n, from the whole numbers n x - S where these fit 64 bits."""
    most = n * max(int(np.abs(points).max(initial=0)), 1) + int(np.abs(totals).max(initial=0))
    if most < 1 << 63:
        return (n * points - totals) / n
    return points - totals / n


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows, with rows of zeros up to a square."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def _triangle_row(length: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        {"length": pa.array([length], pa.int32()), "r": one_list(pa.array(r.ravel()))}
    )


def triangles(fit_list: DataFrame, totals: DataFrame) -> DataFrame:
    """(length, r): R of the centred rows, one row per length (none for length 0)."""

    def reduce_blocks(batches):
        length = r = None
        for row in chunk_rows(batches):
            if row["length"] != length:
                if r is not None:
                    yield _triangle_row(length, r)
                length, r = row["length"], np.zeros((0, row["length"]))
            block = _centred(_points(row), row["n"], np.asarray(row["sums"], np.int64))
            r = _triangle(np.vstack([r, block]))
        if r is not None:
            yield _triangle_row(length, r)

    def stack(key, table):
        length, held = int(key[0].as_py()), []
        size = max(2, min(FAN_IN, STACK // max(length * length, 1)))
        for row in chunk_rows(table.to_batches()):
            held.append(np.asarray(row["r"], float).reshape(length, length))
            if len(held) == size:
                held = [_triangle(np.vstack(held))]
        return pa.Table.from_batches([_triangle_row(length, _triangle(np.vstack(held)))])

    kind = "length int, r array<double>"
    met = fit_list.where("length > 0").join(totals, "length")
    found = materialize(met.mapInArrow(reduce_blocks, kind), "triangles")
    while True:
        size = found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if size <= 1:
            return found
        # Numbered at random by an even hash of their contents: about ``FAN_IN`` meet in a group.
        buckets = -(-size // FAN_IN)
        bucket = F.pmod(F.xxhash64("r"), F.lit(buckets)).alias("bucket")
        groups = found.select("length", "r", bucket).groupBy("length", "bucket")
        found = materialize(groups.applyInArrow(stack, kind), "triangles")


def fit(fit_list: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """(length, n, sums, trace, values, directions): per length the trace of the covariance, its
    first k eigenvalues, falling, and their unit eigenvectors, one after the other.

    Eigenvalues that rounding cannot tell from 0 are 0.
    """

    def solve(batches):
        for row in chunk_rows(batches):
            length, n = row["length"], row["n"]
            r = np.asarray(row["r"], float).reshape(length, length)
            squares, directions = principal_directions(r, k)
            squares = np.where(squares > (length * EPS) ** 2 * squares[0], squares, 0.0)
            yield pa.record_batch(
                {
                    "length": pa.array([length], pa.int32()),
                    "trace": pa.array([squares.sum() / n]),
                    "values": one_list(pa.array(squares[:k] / n)),
                    "directions": one_list(pa.array(directions.T.ravel())),
                }
            )

    totals = materialize(sums(fit_list), "sums")
    found = triangles(fit_list, totals).join(totals.select("length", "n"), "length")
    models = found.mapInArrow(
        solve, "length int, trace double, values array<double>, directions array<double>"
    )
    return materialize(totals.join(models, "length"), "whitening-models")


def _projected(row: dict) -> np.ndarray:
    """Components of the rows of a chunk, of unit variance; null where there is no variance."""
    points, values = _points(row), np.asarray(row["values"], float)
    directions = np.asarray(row["directions"], float).reshape(len(values), row["length"])
    centred = _centred(points, row["n"], np.asarray(row["sums"], np.int64))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = centred @ directions.T / np.sqrt(values)
    return np.where(values > 0, out, np.nan)


def with_identity_error(models: DataFrame, fit_list: DataFrame) -> DataFrame:
    """Models with identity_error: the largest entry, without sign, of the covariance of the whitened
    fit list minus the identity; over the components that have a variance."""

    def products(batches):
        for row in chunk_rows(batches):
            w = np.nan_to_num(_projected(row))
            totals = np.concatenate((w.sum(0), (w.T @ w).ravel()))
            yield pa.record_batch(
                {"length": pa.array([row["length"]], pa.int32()), "totals": one_list(pa.array(totals))}
            )

    met = fit_list.join(models, "length")
    added = _added_up(met.mapInArrow(products, "length int, totals array<double>"), "array<double>")
    k = F.size("values")

    def entry(i, j):
        mean = F.get("totals", i) * F.get("totals", j) / F.col("n")
        covariance = (F.get("totals", k + i * k + j) - mean) / F.col("n")
        wanted = F.when(i == j, F.lit(1.0)).otherwise(F.lit(0.0))
        there = (F.get("values", i) > 0) & (F.get("values", j) > 0)
        return F.when(there, F.abs(covariance - wanted)).otherwise(F.lit(0.0))

    numbers_ = F.slice(F.sequence(F.lit(0), k), 1, k)
    errors = F.flatten(F.transform(numbers_, lambda i: F.transform(numbers_, lambda j: entry(i, j))))
    return models.join(added, "length").withColumn("identity_error", F.array_max(errors)).drop("totals")


def _deviations(points: np.ndarray, n: int, totals: np.ndarray) -> pa.Array:
    """Sum of (n x - S)^2, exact; null where it is beyond a long."""
    rough = ((float(n) * points - totals.astype(float)) ** 2).sum(1)
    # Below 1.5 * 2^63 every term fits, and the sum fits without a sign.
    fits = rough < 1.5 * 2.0**63
    terms = np.abs(np.where(fits[:, None], n * points - totals, 0)).astype(np.uint64)
    exact = (terms * terms).sum(1, dtype=np.uint64)
    fits &= exact < np.uint64(1 << 63)
    return pa.array(np.where(fits, exact, 0).astype(np.int64), mask=~fits)


def whitened(chunks: DataFrame, models: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per vector and
    component; ``chunks`` as ``packed`` gives them."""

    def project(batches):
        for row in chunk_rows(batches):
            rows, k = len(row["vec_id"]), len(row["values"])
            values = np.asarray(row["values"], float)
            out = _projected(row).ravel()
            deviation = _deviations(_points(row), row["n"], np.asarray(row["sums"], np.int64))
            explained = values / row["trace"] if row["trace"] > 0 else np.zeros(k)
            at = pa.array(np.repeat(np.arange(rows), k))
            yield pa.record_batch(
                {
                    "vec_id": row["vec_id"].take(at),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    "n": pa.array(np.full(rows * k, row["n"], np.int64)),
                    "deviation": deviation.take(at),
                    "whitened": pa.array(out, mask=np.isnan(out)),
                    "explained": pa.array(np.tile(explained, rows)),
                    "identity_error": pa.array(np.full(rows * k, row["identity_error"])),
                }
            )

    return chunks.join(models, "length").mapInArrow(
        project,
        "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
        "explained double, identity_error double",
    )


def whiten(
    rows: DataFrame,
    k: int = COMPONENTS,
    scale: float = SCALE,
    components: int = CHUNK_COMPONENTS,
) -> DataFrame:
    """Every vector on the first k principal components, of unit variance; see ``whitened``.

    rows: vec_id and embedding; other columns are ignored. Rows whose vector is null or holds null or
    non-finite components take no part, nor do vectors without components; repeated and null ids
    are rows like any other. A component without variance has a null ``whitened``. Shorter vectors
    have as many components as dimensions. An empty table gives an empty result.
    """
    vectors = whole_vectors(rows.select("vec_id", "embedding"), scale)
    once = vectors.select(F.lit(None).cast("long").alias("vec_id"), "x").dropDuplicates(["x"])
    fit_list = materialize(packed(once, components), "fit-list")
    models = materialize(with_identity_error(fit(fit_list, k), fit_list), "whitening-models")
    return whitened(packed(vectors, components), models)
