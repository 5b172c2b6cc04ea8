"""Arrow batches cut to a size that numpy work can hold in memory."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


#: Documents in an Arrow batch, where the session leaves it open: text is large, so the usual ten
#: thousand would take much memory on either side.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def quoted(names: list[str]) -> list[Column]:
    """Columns by names that may hold dots or quotes."""
    return [F.col("`" + name.replace("`", "``") + "`").alias(name) for name in names]


def release_memory() -> None:
    """Free pages back to the system: a Python worker goes on to other stages with what it has."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(
    batches: Iterator[pa.RecordBatch], column: str, size: int
) -> Iterator[pa.RecordBatch]:
    """Parts of the batches in which the text or binary column holds about ``size`` bytes; a
    longer value is a part of its own."""
    release_memory()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        before = np.cumsum(sizes, dtype=np.int64) - sizes
        cuts = np.flatnonzero(np.diff(before // size, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
    release_memory()


def joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one, until together they hold ``size`` bytes."""
    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes >= size:
            yield pa.concat_batches(held)
            held, held_bytes = [], 0
    if held:
        yield pa.concat_batches(held)
