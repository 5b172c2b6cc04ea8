"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves the rows again and again by their projection on a random direction (one per tree
and level, cut at the median of a node). The forest is fitted on a bounded sample, every row is
indexed. A query walks all trees with one shared priority queue, the leaf with the smallest sum of
squared margins first, until it has opened a given share of a tree's leaves; the rows of these
leaves are ranked by their exact distance.

Equal vectors are indexed once, with their smallest ids, so that a vector that a third of all rows
share is one row of its leaf. Vectors are told apart by a number of their own, not by ids, which may
repeat. Each length has a forest of its own.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmark.llm.vectors import matrix, usable_vectors
from driftmark.sources.scratch import materialize

TREES = 8
LEAF_ROWS = 200
SAMPLE_ROWS = 1 << 15
LEAST_SAMPLE = 4
SHARE = 0.85
LEAST_PER_TREE = 4
GROUP_ROWS = 1 << 14


@dataclass(frozen=True)
class Forest:
    directions: np.ndarray  # (trees, depth, dimensions)
    cuts: list[list[np.ndarray]]  # per tree and level, one per node

    @property
    def depth(self) -> int:
        return self.directions.shape[1]


def fit_forest(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 0) -> Forest:
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(trees, depth, sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    cuts = []
    for t in range(trees):
        leaf, levels = np.zeros(len(sample), np.int64), []
        for level in range(depth):
            along = sample @ directions[t, level]
            cut = np.array(
                [np.median(along[leaf == n]) if (leaf == n).any() else 0.0 for n in range(2**level)]
            )
            leaf = 2 * leaf + (along > cut[leaf])
            levels.append(cut)
        cuts.append(levels)
    return Forest(directions, cuts)


def leaves_of(x: np.ndarray, forest: Forest) -> np.ndarray:
    """(trees, rows)"""
    out = np.zeros((len(forest.cuts), len(x)), np.int64)
    for t, levels in enumerate(forest.cuts):
        for level, cut in enumerate(levels):
            out[t] = 2 * out[t] + (x @ forest.directions[t, level] > cut[out[t]])
    return out


def nearest_leaves(query: np.ndarray, forest: Forest, n: int) -> list[tuple[int, int]]:
    """The n leaves (tree, leaf) of all trees that a shared queue pops first."""
    along = forest.directions @ query
    queue = [(0.0, t, 0, 0) for t in range(len(forest.cuts))]
    found = []
    while queue and len(found) < n:
        cost, t, level, node = heapq.heappop(queue)
        if level == forest.depth:
            found.append((t, node))
            continue
        margin = along[t, level] - forest.cuts[t][level][node]
        near = 2 * node + int(margin > 0)
        heapq.heappush(queue, (cost, t, level + 1, near))
        heapq.heappush(queue, (cost + margin * margin, t, level + 1, near ^ 1))
    return found


def distinct_vectors(vectors: DataFrame, ids: int) -> DataFrame:
    """(number, embedding, ids): each vector once, with its ``ids`` smallest ids in order. Numbers
    hold once the table is stored."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    first = vectors.withColumn("n", F.row_number().over(order)).where(F.col("n") <= ids)
    return first.groupBy("embedding").agg(
        F.sort_array(F.collect_list(F.col("vec_id").cast("long"))).alias("ids")
    ).withColumn("number", F.monotonically_increasing_id())


def nearest(
    rows: DataFrame,
    is_query,
    k: int = 10,
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    share: float = SHARE,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): per query the k nearest rows found, its own id left out, by
    Euclidean distance, ties to the smaller id.

    rows: vec_id and embedding, see ``usable_vectors``; zero vectors take no part either. The
    forest sees at most about ``sample_rows`` distinct vectors. A query opens as many leaves
    as ``share`` of one tree's, at least four per tree. No query, or no row, gives an empty result.
    Different vectors of one id are different queries and different rows, but a row of the query's
    own id is none of its answers. One search is planned per length that occurs.
    """
    nonzero = F.exists("embedding", lambda x: x != 0)
    every = materialize(usable_vectors(rows).where(nonzero), "nn-vectors")
    lengths = [r[0] for r in every.select(F.size("embedding")).distinct().collect()]
    options = (k, trees, leaf_rows, share, sample_rows)
    parts = [
        _of_one_length(every.where(F.size("embedding") == n), is_query, *options)
        for n in sorted(lengths) or [0]
    ]
    return reduce(DataFrame.unionByName, parts)


def _of_one_length(
    vectors: DataFrame, is_query, k: int, trees: int, leaf_rows: int, share: float, sample_rows: int
) -> DataFrame:
    distinct = materialize(distinct_vectors(vectors, k + 1), "nn-distinct")
    n = distinct.count()
    mark = F.pmod(F.xxhash64("embedding", F.lit("forest")), F.lit(1 << 30))
    drawn = distinct.where(mark < F.lit(min(1.0, sample_rows / max(n, 1)) * (1 << 30)))
    sample = matrix(drawn.select("embedding").orderBy("embedding").toArrow()["embedding"])
    depth = 0
    while n >> depth > leaf_rows and len(sample) >> depth > LEAST_SAMPLE:
        depth += 1
    forest = fit_forest(sample, depth, trees) if n and len(sample) else None
    if forest is None:
        forest = Forest(np.zeros((trees, 0, 0)), [[] for _ in range(trees)])
    opened = max(LEAST_PER_TREE * trees, round(share * 2**forest.depth))
    # A group is some leaves, or a part of a leaf that has outgrown the sample's depth.
    salts = -(-(n >> forest.depth) // GROUP_ROWS) or 1
    groups = -(-trees * n // (GROUP_ROWS * salts)) or 1
    shared = vectors.sparkSession.sparkContext.broadcast((forest.directions, forest.cuts))

    def index(batches):
        forest = Forest(*shared.value)
        for batch in batches:
            where = leaves_of(matrix(batch.column("embedding")), forest)
            for t, leaf in enumerate(where):
                code = np.full(len(leaf), t, np.int64) << 32 | leaf
                yield pa.record_batch(
                    {
                        "leaf": pa.array(code),
                        "number": batch.column("number"),
                        "embedding": batch.column("embedding"),
                        "ids": batch.column("ids"),
                    }
                )

    def probe(batches):
        forest = Forest(*shared.value)
        for batch in batches:
            found = [
                [t << 32 | leaf for t, leaf in nearest_leaves(q, forest, opened)]
                for q in matrix(batch.column("embedding"))
            ]
            yield pa.record_batch(
                {
                    "embedding": batch.column("embedding"),
                    "leaves": pa.array(found, pa.list_(pa.int64())),
                }
            )

    def rank(asked, held):
        """Per query and group its k + 1 nearest vectors. A vector that only the id of the query has
        is none of them, where a single id asks."""
        out = {"query_key": [], "number": [], "ids": [], "score": []}
        if asked.num_rows and held.num_rows:
            leaf, x = held["leaf"].to_numpy(), matrix(held["embedding"])
            order = np.argsort(leaf, kind="stable")
            leaf, x, ids = leaf[order], x[order], held["ids"].take(pa.array(order))
            ids = ids.combine_chunks()
            number = held["number"].to_numpy()[order]
            sizes = np.diff(ids.offsets.to_numpy())
            first_id = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
            keys, queries = asked["query_key"].to_pylist(), matrix(asked["embedding"])
            only = asked["only_id"].to_pylist()
            for key, own, q, leaves in zip(keys, only, queries, asked["leaves"].to_pylist(), strict=True):
                starts, ends = np.searchsorted(leaf, leaves), np.searchsorted(leaf, leaves, "right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)])
                if own is not None:
                    at = at[(sizes[at] > 1) | (first_id[at] != own)]
                if not len(at):
                    continue
                # A vector in leaves of several trees counts once.
                at = at[np.unique(number[at], return_index=True)[1]]
                distance = np.sqrt(((x[at] - q) ** 2).sum(1))
                best = np.lexsort((first_id[at], distance))[: k + 1]
                out["query_key"] += [key] * len(best)
                out["number"] += number[at[best]].tolist()
                out["ids"] += ids.take(pa.array(at[best])).to_pylist()
                out["score"] += distance[best].tolist()
        return pa.table(
            {
                "query_key": pa.array(out["query_key"], pa.int64()),
                "number": pa.array(out["number"], pa.int64()),
                "ids": pa.array(out["ids"], pa.list_(pa.int64())),
                "score": pa.array(out["score"], pa.float64()),
            }
        )

    group = F.pmod(F.xxhash64("leaf"), F.lit(groups)).cast("int")
    held = (
        distinct.mapInArrow(index, "leaf long, number long, embedding array<double>, ids array<long>")
        .withColumn("group", group)
        .withColumn("salt", F.pmod(F.xxhash64("embedding"), F.lit(salts)).cast("int"))
    )
    # Queries of equal vectors are searched once.
    queries = vectors.where(is_query).select(F.col("vec_id").cast("long").alias("query_id"), "embedding")
    asking = queries.groupBy("embedding").agg(
        F.when(F.min("query_id") == F.max("query_id"), F.min("query_id")).alias("only_id")
    )
    keyed = materialize(
        asking.join(distinct.select("embedding", F.col("number").alias("query_key")), "embedding"),
        "nn-queries",
    )
    asked = (
        keyed.select("embedding").mapInArrow(probe, "embedding array<double>, leaves array<long>")
        .withColumn("leaf", F.explode("leaves"))
        .groupBy("embedding", group.alias("group"))
        .agg(F.collect_list("leaf").alias("leaves"))
        .join(keyed, "embedding")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    found = (
        asked.groupBy("group", "salt")
        .cogroup(held.groupBy("group", "salt"))
        .applyInArrow(rank, "query_key long, number long, ids array<long>, score double")
        .dropDuplicates(["query_key", "number"])
    )
    by_vector = Window.partitionBy("query_key").orderBy("score", F.get("ids", 0))
    nearest_vectors = found.withColumn("n", F.row_number().over(by_vector)).where(
        F.col("n") <= k + 1
    )
    lists = nearest_vectors.groupBy("query_key").agg(
        F.collect_list(F.struct("score", "ids")).alias("found")
    )
    # (score, vec_id) in order; k + 1 vectors of at most k + 1 ids each.
    flat = F.flatten(
        F.transform(
            "found",
            lambda f: F.transform(
                f["ids"], lambda i: F.struct(f["score"].alias("score"), i.alias("vec_id"))
            ),
        )
    )
    answered = (
        queries.join(keyed.drop("only_id"), "embedding")
        .join(lists.select("query_key", F.sort_array(flat).alias("flat")), "query_key")
        .select("query_id", F.filter("flat", lambda f: f["vec_id"] != F.col("query_id")).alias("flat"))
        .select("query_id", F.posexplode(F.slice("flat", 1, k)).alias("at", "hit"))
    )
    return answered.select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id"), F.col("hit.score")
    )
