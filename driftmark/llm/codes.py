"""Vector codes: product quantisation fitted by dual-tree Lloyd.

Vectors become whole numbers, floor(scale * x), and are cut into equal consecutive parts; every part
position has a codebook. Rows are packed once into chunks, each with a tree over its points for
every part position, and stored. A round then meets each chunk with the codebooks: ``dualtree``
assigns whole nodes by their cached sums and decides uncertain leaves on whole numbers. A task adds
up the sums of its chunks, so what is shuffled is one codebook's worth of sums per task.

Vectors of different lengths have no common parts; those of each length are coded among themselves,
with codebooks of their own. A length that the number of parts does not divide makes the first parts
one component longer. Codebooks stay in tables, one row per length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.llm.dualtree import LEAF, Tree, assign, depth_of, halved
from driftmark.llm.vectors import chunk_rows, numbers, of_one_length, one_list, whole_vectors
from driftmark.sources.scratch import materialize

SCALE = 256.0
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components of a chunk: 16,384 vectors of 64. Larger chunks have finer trees.
CHUNK_COMPONENTS = 1 << 20
#: Components have to be below this after scaling, so that distances of parts are exact.
LARGEST = 1 << 24

CODEBOOK = "length int, m int, entries array<bigint>"


def part_cuts(length: int, parts: int) -> np.ndarray:
    """Where the parts of a vector begin and end; the first ones are longer if parts are unequal."""
    sizes = np.full(parts, length // parts)
    sizes[: length % parts] += 1
    return np.concatenate(([0], np.cumsum(sizes)))


def chunks(vectors: DataFrame, parts: int = PARTS, components: int = CHUNK_COMPONENTS) -> DataFrame:
    """(length, vec_id, label, points, orders): lists of about ``components`` numbers, vectors of one
    length each, with the order of the points in the tree of every part.

    vectors: vec_id, label and x. A number of ``LARGEST`` or more raises an error.
    """
    kind = vectors.schema["label"].dataType.simpleString()

    def pack(batches):
        for length, table in of_one_length(batches, "x", components):
            n, points = table.num_rows, numbers(table, "x", length)
            if points.size and max(int(points.max()), -int(points.min())) >= LARGEST:
                raise ValueError(f"scaled components must be below {LARGEST}")
            cuts, depth = part_cuts(length, parts), depth_of(n, LEAF)
            orders = [halved(points[:, a:b], depth) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            # A chunk is one row: its columns as lists.
            lists = {
                "vec_id": table["vec_id"],
                "label": table["label"],
                "points": pa.array(points.ravel().astype(np.int32)),
                "orders": pa.array(np.concatenate(orders).astype(np.int32)),
            }
            yield pa.record_batch(
                {"length": pa.array([length], pa.int32())}
                | {name: one_list(values) for name, values in lists.items()}
            )

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "x").mapInArrow(
        pack,
        f"length int, vec_id array<bigint>, label array<{kind}>, points array<int>, orders array<int>",
    )


def first_entries(vectors: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """The codebooks to begin with, a row per length: the vectors of the smallest ids, ascending;
    null ids come last, equal ids by their vectors."""
    length = F.size("x")
    order = Window.partitionBy("length").orderBy(F.col("vec_id").asc_nulls_last(), "x")
    ranked = (
        vectors.select(length.alias("length"), "vec_id", "x")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= entries)
    )
    lists = F.sort_array(F.collect_list(F.struct("place", "x")))
    return ranked.groupBy("length").agg(
        F.count(F.lit(1)).cast("int").alias("m"), F.flatten(lists["x"]).alias("entries")
    )


def _trees(row: dict, parts: int):
    """Points of a chunk, and per part the tree over its columns and where these are."""
    n, length = len(row["vec_id"]), row["length"]
    points = np.asarray(row["points"], np.int64).reshape(n, length)
    orders = np.asarray(row["orders"], np.int64).reshape(parts, n)
    cuts, depth = part_cuts(length, parts), depth_of(n, LEAF)
    for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        yield part, a, b, Tree(points[:, a:b], orders[part], depth)


def next_codebooks(packed: DataFrame, codebooks: DataFrame, parts: int = PARTS) -> DataFrame:
    """Codebooks after one round: every entry is the floor of the mean of its points, an entry
    without points stays."""

    def add_up(batches):
        length, sums, counts = None, None, None

        def told():
            values = np.concatenate((sums.ravel(), counts.ravel()))
            return pa.record_batch(
                {
                    "length": pa.array([length], pa.int32()),
                    "totals": pa.array([values], pa.list_(pa.int64())),
                }
            )

        for row in chunk_rows(batches):
            m = row["m"]
            if row["length"] != length:
                if length is not None:
                    yield told()
                length = row["length"]
                sums, counts = np.zeros((m, length), np.int64), np.zeros((m, parts), np.int64)
            entries = np.asarray(row["entries"], np.int64).reshape(m, length)
            for part, a, b, tree in _trees(row, parts):
                _, part_sums, part_counts, _ = assign(tree, entries[:, a:b])
                sums[:, a:b] += part_sums
                counts[:, part] += part_counts
        if length is not None:
            yield told()

    def renew(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                m, length = row["m"], row["length"]
                totals = np.asarray(row["totals"], np.int64)
                sums, counts = totals[: m * length].reshape(m, length), totals[m * length :]
                per_column = np.repeat(counts.reshape(m, parts), np.diff(part_cuts(length, parts)), axis=1)
                old = np.asarray(row["entries"], np.int64).reshape(m, length)
                out.append(np.where(per_column > 0, sums // np.maximum(per_column, 1), old).ravel())
            yield pa.record_batch(
                {
                    "length": batch.column("length"),
                    "m": batch.column("m"),
                    "entries": pa.array(out, pa.list_(pa.int64())),
                }
            )

    met = packed.select("length", "vec_id", "points", "orders").join(codebooks, "length")
    totals = (
        met.mapInArrow(add_up, "length int, totals array<bigint>")
        .select("length", F.posexplode("totals").alias("at", "total"))
        .groupBy("length", "at")
        .agg(F.sum("total").alias("total"))
        .groupBy("length")
        .agg(F.sort_array(F.collect_list(F.struct("at", "total")))["total"].alias("totals"))
    )
    return codebooks.join(totals, "length").mapInArrow(renew, CODEBOOK)


def coded(packed: DataFrame, codebooks: DataFrame, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, length, code, error): per vector the index of the nearest entry of every part
    and the squared distances summed up."""
    kind = packed.schema["label"].dataType.simpleString()[len("array<") : -1]

    def encode(batches):
        for row in chunk_rows(batches):
            m, length, n = row["m"], row["length"], len(row["vec_id"])
            entries = np.asarray(row["entries"], np.int64).reshape(m, length)
            points = np.asarray(row["points"], np.int64).reshape(n, length)
            codes, error = np.empty((n, parts), np.int32), np.zeros(n, np.int64)
            for part, a, b, tree in _trees(row, parts):
                codes[:, part], *_ = assign(tree, entries[:, a:b])
                away = points[:, a:b] - entries[codes[:, part], a:b]
                error += (away * away).sum(1)
            at = pa.array(np.arange(n + 1, dtype=np.int32) * parts)
            yield pa.record_batch(
                {
                    "vec_id": row["vec_id"],
                    "label": row["label"],
                    "length": pa.array(np.full(n, length, np.int32)),
                    "code": pa.ListArray.from_arrays(at, pa.array(codes.ravel())),
                    "error": pa.array(error),
                }
            )

    return packed.join(codebooks, "length").mapInArrow(
        encode, f"vec_id bigint, label {kind}, length int, code array<int>, error bigint"
    )


def fit(vectors: DataFrame, packed: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> DataFrame:
    """(length, m, entries): the codebooks after ``rounds`` rounds; entry k of part p is its part of
    the k-th vector of ``entries``."""
    books = materialize(first_entries(vectors, entries), "codebooks")
    for _ in range(rounds):
        books = materialize(next_codebooks(packed, books, parts), "codebooks")
    return books


def compress(
    rows: DataFrame,
    label: Column | None = None,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    parts: int = PARTS,
    scale: float = SCALE,
    components: int = CHUNK_COMPONENTS,
) -> tuple[DataFrame, DataFrame]:
    """(codes, codebooks): see ``coded`` and ``fit``.

    rows: vec_id and embedding; other columns are ignored, but for ``label``, which goes along.
    Rows whose vector is null or holds null or non-finite components take no part; repeated and null
    ids are rows like any other. An empty table gives empty results.
    """
    named = rows.select("vec_id", "embedding", (F.lit(None).cast("string") if label is None else label).alias("label"))
    vectors = whole_vectors(named, scale)
    packed = materialize(chunks(vectors, parts, components), "vector-chunks")
    books = fit(vectors, packed, entries, rounds, parts)
    return coded(packed, books, parts), books


def errors_by_label(codes: DataFrame) -> DataFrame:
    """Codes with label_error: the error summed over the rows of the same label, nulls together.

    A label is one row of sums before it is joined, so one that most rows have costs no more.
    """
    sums = codes.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("same")), "left").drop("same")


def part_major(length: Column, m: Column, entries: Column, parts: int = PARTS) -> Column:
    """Codebook numbers by part, entry and place in the part."""
    size = F.floor(length / parts).cast("int")
    longer = F.pmod(length, F.lit(parts))
    numbers = F.sequence(F.lit(0), F.lit(parts - 1))

    def of_part(p: Column) -> Column:
        start = p * size + F.least(p, longer)
        width = size + F.when(p < longer, 1).otherwise(0)
        places = F.slice(F.sequence(F.lit(0), m), 1, m)
        return F.flatten(F.transform(places, lambda k: F.slice(entries, k * length + start + 1, width)))

    return F.flatten(F.transform(numbers, of_part))
