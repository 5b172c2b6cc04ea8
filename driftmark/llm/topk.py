"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments; of each the mean and the deviation are kept. By the
inequality of Cauchy and Schwarz, the inner product of two segments of n components is at most
n (mean mean' + deviation deviation'), which is the same as a lower bound of their distance. Rows
whose bound cannot reach the k-th best score so far are left out, coarse statistics first; the
survivors get their exact score.

The queries, in blocks, meet all rows, in chunks; a task holds one block and one chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmark.llm.vectors import matrix, usable_vectors
from driftmark.sources.scratch import materialize

LEVELS = (1, 4, 16)
SCALE = 1024.0
QUERY_BLOCK = 2048
ROW_CHUNK = 8192
#: Relative slack for the rounding of the bounds.
SLACK = 1e-9


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """(rows, 2 segments): per segment sqrt(n) times the mean, then sqrt(n) times the deviation."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    means = [p.mean(1) * np.sqrt(p.shape[1]) for p in parts]
    deviations = [p.std(1) * np.sqrt(p.shape[1]) for p in parts]
    return np.column_stack(means + deviations)


def best_rows(
    query: np.ndarray,
    rows: np.ndarray,
    ids: np.ndarray,
    bounds_of: list[tuple[np.ndarray, np.ndarray]],
    k: int,
    own: int | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k highest inner products, ties to the smaller id, rows of the id
    ``own`` left out. ``bounds_of``: per level the statistics of the query and of the rows."""
    mine = np.flatnonzero(ids == own) if own is not None else np.empty(0, np.int64)
    n = len(rows) - len(mine)

    def bounds(level: int, at) -> np.ndarray:
        of_query, of_rows = bounds_of[level]
        return of_rows[at] @ of_query

    def all_bounds(level: int) -> np.ndarray:
        out = bounds(level, slice(None))
        out[mine] = -np.inf
        return out

    slack = SLACK * (1 + np.linalg.norm(query) * np.linalg.norm(rows, axis=1).max())
    coarse = all_bounds(0)
    finest = all_bounds(len(bounds_of) - 1) if len(rows) > 4 * k else coarse
    least = (rows[np.argpartition(-finest, k - 1)[:k]] @ query).min() if n > k else -np.inf
    alive = np.flatnonzero(coarse >= least - slack)
    alive = np.setdiff1d(alive, mine, assume_unique=True) if len(mine) else alive
    for level in range(1, len(bounds_of)):
        alive = alive[bounds(level, alive) >= least - slack]
    scores = rows[alive] @ query
    order = np.lexsort((ids[alive], -scores))[:k]
    return alive[order], scores[order]


def top_products(
    rows: DataFrame,
    is_query,
    k: int = 10,
    scale: float = SCALE,
    query_block: int = QUERY_BLOCK,
    row_chunk: int = ROW_CHUNK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): per query the k rows of highest inner product, its own id
    left out, of the components floor(scale * x), ties to the smaller id.

    rows: vec_id and embedding, see ``usable_vectors`` for what takes part; a query meets the vectors
    of its length. Fewer than k rows give all of them, no query an empty result. Different vectors of
    one id are different queries and different rows, but a row of the query's own id is none of its
    answers. Scores are exact as long as they fit a double's 53 bits.
    """
    whole = F.transform("embedding", lambda x: F.floor(x * scale).cast("double"))
    vectors = materialize(
        usable_vectors(rows).select("vec_id", whole.alias("embedding")), "topk-vectors"
    )
    queries = vectors.where(is_query)
    n_rows, n_queries = vectors.count(), queries.count()
    n_chunks, n_blocks = -(-n_rows // row_chunk) or 1, -(-n_queries // query_block) or 1
    place = F.xxhash64("vec_id", "embedding")
    length = F.size("embedding").alias("length")
    left = queries.select(
        "vec_id",
        "embedding",
        length,
        F.pmod(place, F.lit(n_blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"),
    )
    right = vectors.select(
        "vec_id",
        "embedding",
        length,
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
        F.pmod(place, F.lit(n_chunks)).cast("int").alias("chunk"),
    )

    def search(left, right):
        out = {"query_id": [], "query_key": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            asked, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            q, x = matrix(left["embedding"]), matrix(right["embedding"])
            of_rows = [segment_statistics(x, n) for n in LEVELS]
            of_queries = [segment_statistics(q, n) for n in LEVELS]
            keys = left["query_key"].to_numpy()
            for i in range(len(q)):
                levels = [(a[i], b) for a, b in zip(of_queries, of_rows, strict=True)]
                at, scores = best_rows(q[i], x, ids, levels, k, asked[i])
                out["query_id"] += [asked[i]] * len(at)
                out["query_key"] += [keys[i]] * len(at)
                out["vec_id"] += ids[at].tolist()
                out["score"] += scores.tolist()
        return pa.table(
            {
                "query_id": pa.array(out["query_id"], pa.int64()),
                "query_key": pa.array(out["query_key"], pa.int64()),
                "vec_id": pa.array(out["vec_id"], pa.int64()),
                "score": pa.array(np.array(out["score"], float).astype(np.int64)),
            }
        )

    found = (
        left.withColumn("query_key", place)
        .withColumn("vec_id", F.col("vec_id").cast("long"))
        .groupBy("length", "block", "chunk")
        .cogroup(
            right.withColumn("vec_id", F.col("vec_id").cast("long")).groupBy("length", "block", "chunk")
        )
        .applyInArrow(search, "query_id long, query_key long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
