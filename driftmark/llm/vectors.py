"""What the two vector searches share: valid vectors, and Arrow lists as numpy rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor a non-finite component."""
    limit = F.lit(float("inf"))
    good = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit),
    )
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False))


def usable_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles): valid vectors, equal rows once.

    Rows without an id take no part; other columns are ignored. No measure is defined between
    vectors of different lengths: each length is searched among its own rows.
    """
    valid = rows.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    return valid.select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding")
    ).dropDuplicates()


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as rows."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def whole_vectors(rows: DataFrame, scale: float) -> DataFrame:
    """The rows whose vector is there and holds only finite components, with ``x``: floor(scale *
    component) as whole numbers. The vector without components is one of them."""
    vector = F.col("embedding")
    kept = rows.where(finite(vector) | (vector.isNotNull() & (F.size(vector) == 0)))
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * scale))
    empty = F.array().cast("array<bigint>")
    return kept.withColumn("x", F.when(F.size(vector) > 0, whole).otherwise(empty))


def of_one_length(
    batches: Iterator[pa.RecordBatch], column: str, components: int
) -> Iterator[tuple[int, pa.Table]]:
    """(length, rows): the rows of the batches in tables of at most ``components`` numbers (a row
    at least), lists of one length in each."""

    def flush(held):
        table = pa.Table.from_batches(held)
        lengths = table[column].combine_chunks().value_lengths().to_numpy()
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            step = max(1, components // max(int(length), 1))
            for at in range(0, len(rows), step):
                yield int(length), table.take(pa.array(rows[at : at + step]))

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(column).flatten()) + batch.num_rows
        if size >= components:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def numbers(table: pa.Table, column: str, length: int) -> np.ndarray:
    """Lists of that length as rows of whole numbers."""
    flat = table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, length).astype(np.int64, copy=False)


def one_list(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    """All values as a single list."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches: lists as Arrow arrays, other values as they are."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {
                name: column[i].values if pa.types.is_list(column.type) else column[i].as_py()
                for name, column in zip(batch.schema.names, batch.columns, strict=True)
            }
