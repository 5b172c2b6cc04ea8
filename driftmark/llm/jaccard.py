"""Exact n-gram Jaccard self-join with token-group matrices.

Documents are sets of hashed word shingles. Two facts prune the join without losing a link:

* A document more than a fifth of whose shingles (for a threshold of 0.8) occur nowhere else cannot
  link with another one. Shingles are counted over the whole table, combined per slice of
  documents first, so a shingle that a third of all documents hold is one entry per slice.
* With a document's shingles from rare to frequent, two linked documents share one among the first
  n - ceil(0.8 n) + 1 of either. Documents that share such a shingle are put into one family, by
  connected components over (first document of the shingle, document).

A family is joined by token-group matrix: its documents are partitioned into groups of similar ones,
each group's token union is stored, a query's overlap with the union bounds its overlap with every
member, and only groups that reach the bound are opened. Families too large for a task are cut
into blocks that meet pairwise. Equal sets are one set from the start, and a group already connected
to the query is not opened, so copies are never expanded into pairs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.llm.batches import quoted, slices
from driftmark.llm.components import components
from driftmark.llm.hashing import BASES, Rolling, mixed
from driftmark.sources.scratch import materialize, scratch_path

SHINGLE = 5
PERCENT = 80
SLICE_BYTES = 2 << 20
BUCKET_TOKENS = 2_000_000
BLOCK_TOKENS = 2_000_000
GROUP = 64
MOST_CLASSES = 250

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Shingler:
    """Distinct shingle hashes of texts, sorted, as one array and the number of each text."""

    size: int = SHINGLE

    def __post_init__(self):
        self.rolling = Rolling(BASES[0], 1)
        self.factors = np.random.default_rng(2).integers(1, 1 << 63, self.size, np.uint64) | np.uint64(1)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        gap = SPACE[data]
        edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        words = self.rolling.of(self.rolling.sums(data), starts, ends)
        text_ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, np.int64)
        last = np.searchsorted(starts, text_ends)
        first = np.concatenate([[0], last[:-1]]) if len(texts) else last
        n = max(len(words) - self.size + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for j in range(self.size):
            rolled += words[j : j + n] * self.factors[j]
        rolled = mixed(rolled)
        sets = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= self.size:
                own = rolled[a : b - self.size + 1].copy()
                own.sort()
                keep = np.ones(len(own), bool)
                keep[1:] = own[1:] != own[:-1]
                sets.append(own[keep])
            elif b > a:
                whole = (words[a:b] * self.factors[: b - a]).sum(dtype=np.uint64)
                sets.append(mixed(np.array([whole + np.uint64(b - a)])))
            else:
                sets.append(np.empty(0, np.uint64))
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), sizes


def _lists(flat: np.ndarray, sizes: np.ndarray, kind) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def slice_documents(docs: DataFrame) -> DataFrame:
    """(slice, rid, rest, n, digest, present, lengths, packed): a few hundred documents a row, their
    texts packed.

    rid numbers the rows of ``docs``, rest has their other columns; n and digest are size and hash
    of the set of shingles.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct("doc_id", *quoted(others))

    def pack(batches):
        import zstandard

        shingle, packer = Shingler(), zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            flat, sizes = shingle(texts)
            sets = np.split(flat, np.cumsum(sizes)[:-1])
            digests = [
                hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                for s in sets
            ]
            body = b"".join(texts)
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            one = np.array([batch.num_rows])
            present = batch.column("text").is_valid().to_numpy(zero_copy_only=False)
            rid = batch.column("rid").to_numpy()
            yield pa.record_batch(
                {
                    "slice": pa.array(rid[:1]),
                    "rid": _lists(rid, one, pa.int64()),
                    "rest": pa.ListArray.from_arrays(
                        pa.array([0, batch.num_rows], pa.int32()), batch.column("rest")
                    ),
                    "n": _lists(sizes, one, pa.int64()),
                    "digest": pa.array([digests], pa.list_(pa.binary())),
                    "present": _lists(present, one, pa.bool_()),
                    "lengths": _lists(lengths, one, pa.int64()),
                    "packed": pa.array([packer.compress(body)], pa.binary()),
                }
            )

    spark = docs.sparkSession
    path = scratch_path(spark, "jaccard-slices")
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), rest.alias("rest"), "text")
    kinds = {
        "rid": T.LongType(),
        "rest": numbered.schema["rest"].dataType,
        "n": T.LongType(),
        "digest": T.BinaryType(),
        "present": T.BooleanType(),
        "lengths": T.LongType(),
    }
    told = T.StructType().add("slice", "long")
    for name, kind in kinds.items():
        told.add(name, T.ArrayType(kind))
    packed = numbered.mapInArrow(pack, told.add("packed", "binary"))
    # Small row groups: a reader holds one of them, and rows are large.
    packed.write.option("parquet.block.size", 8 << 20).parquet(path)
    return spark.read.schema(packed.schema).parquet(path)


def unpack(packed: bytes, lengths: list[int]) -> list[bytes]:
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(sum(lengths), 1))
    ends = np.cumsum(lengths).tolist()
    return [body[e - n : e] for e, n in zip(ends, lengths, strict=True)]


def _short(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and the 32 bits by which shingles are counted; two that share them count as one, which
    can only keep a document in the join."""
    bucket = ((tokens >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    return bucket, tokens.astype(np.uint32)


def count_shared(sliced: DataFrame, buckets: int) -> DataFrame:
    """(slice, bucket, shared, classes): per slice and bucket the shingles that more than one
    document holds, and how often (the logarithm, so that one byte holds it)."""

    def emit(batches):
        shingle = Shingler()
        for batch in batches:
            for s, packed, lengths in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                flat, _ = shingle(unpack(packed, lengths))
                bucket, token = _short(flat, buckets)
                code, n = np.unique(bucket.astype(np.uint64) << np.uint64(32) | token, return_counts=True)
                own = (code >> np.uint64(32)).astype(np.int32)
                sizes = np.bincount(own, minlength=buckets)
                yield pa.record_batch(
                    {
                        "slice": pa.array(np.full(buckets, s)),
                        "bucket": pa.array(np.arange(buckets, dtype=np.int32)),
                        "tokens": _lists(code.astype(np.uint32).view(np.int32), sizes, pa.int32()),
                        "counts": _lists(np.minimum(n, 127).astype(np.int8), sizes, pa.int8()),
                    }
                )

    def count(table):
        tokens, counts = table["tokens"].combine_chunks(), table["counts"].combine_chunks()
        flat = tokens.flatten().to_numpy().view(np.uint32)
        n = counts.flatten().to_numpy().astype(np.int64)
        sizes = np.diff(tokens.offsets.to_numpy())
        order = np.argsort(flat, kind="stable")
        group = np.cumsum(np.diff(flat[order], prepend=flat[order[:1]]) != 0)
        total = np.empty(len(flat), np.int64)
        total[order] = np.bincount(group, weights=n[order]).astype(np.int64)[group] if len(flat) else 0
        shared = total > 1
        # Finer than whole powers of two, so that frequent and less frequent ones keep apart.
        classes = np.minimum(np.log2(total[shared]) * 8, MOST_CLASSES).astype(np.uint8)
        owner = np.repeat(np.arange(len(sizes)), sizes)[shared]
        kept = np.bincount(owner, minlength=len(sizes))
        return pa.table(
            {
                "slice": table["slice"],
                "bucket": table["bucket"],
                "shared": _lists(flat[shared].view(np.int32), kept, pa.int32()),
                "classes": _lists(classes.view(np.int8), kept, pa.int8()),
            }
        )

    return (
        sliced.select("slice", "packed", "lengths")
        .mapInArrow(emit, "slice long, bucket int, tokens array<int>, counts array<tinyint>")
        .groupBy("bucket")
        .applyInArrow(count, "slice long, bucket int, shared array<int>, classes array<tinyint>")
    )


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def find_candidates(sliced: DataFrame, shared: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(rid, digest, tokens, prefix): documents that may link, with all their shingles, and the
    rarest shared ones, one of which any linked document has too."""

    def judge(left, right):
        shingle = Shingler()
        out = {"rid": [], "digest": [], "tokens": [], "prefix": []}
        known, classes = [np.empty(0, np.uint64)], [np.empty(0, np.uint8)]
        for bucket, tokens, kinds in zip(
            right["bucket"].to_pylist(), right["shared"].combine_chunks() if right.num_rows else [],
            right["classes"].combine_chunks() if right.num_rows else [], strict=True
        ):
            own = tokens.values.to_numpy().view(np.uint32).astype(np.uint64)
            known.append(np.uint64(bucket) << np.uint64(32) | own)
            classes.append(kinds.values.to_numpy().view(np.uint8))
        known, classes = np.concatenate(known), np.concatenate(classes)
        order = np.argsort(known)
        known, classes = known[order], classes[order]
        seen = set()
        for row in left.select(["rid", "digest", "lengths", "packed"]).to_pylist():
            flat, sizes = shingle(unpack(row["packed"], row["lengths"]))
            bucket, token = _short(flat, buckets)
            code = bucket.astype(np.uint64) << np.uint64(32) | token
            at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            is_shared = known[at] == code if len(known) else np.zeros(len(code), bool)
            ends = np.cumsum(sizes)
            n_shared = np.add.reduceat(np.append(is_shared, False), ends - sizes) * (sizes > 0)
            for i in np.flatnonzero(sizes):
                n = int(sizes[i])
                own = slice(int(ends[i]) - n, int(ends[i]))
                first = prefix_length(n, percent) - (n - int(n_shared[i]))
                if first <= 0 or row["digest"][i] in seen:
                    continue
                seen.add(row["digest"][i])
                both = is_shared[own]
                codes = code[own][both]
                rare = np.lexsort((codes, classes[at[own][both]]))[:first]
                out["rid"].append(row["rid"][i])
                out["digest"].append(row["digest"][i])
                out["tokens"].append(flat[own].view(np.int64))
                out["prefix"].append(codes[rare].view(np.int64))
        return pa.table(
            {
                "rid": pa.array(out["rid"], pa.int64()),
                "digest": pa.array(out["digest"], pa.binary()),
                "tokens": pa.array(out["tokens"], pa.list_(pa.int64())),
                "prefix": pa.array(out["prefix"], pa.list_(pa.int64())),
            }
        )

    return (
        sliced.select("slice", "rid", "digest", "lengths", "packed")
        .groupBy("slice")
        .cogroup(shared.groupBy("slice"))
        .applyInArrow(judge, "rid long, digest binary, tokens array<long>, prefix array<long>")
    )


class Forest:
    """Disjoint sets of 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def link_sets(
    sets: list[np.ndarray], percent: int, left: np.ndarray | None = None, group: int = GROUP
) -> list[int]:
    """Per sorted set the smallest index it is linked with, over any number of links. With
    ``left``, only pairs of a set inside it and one outside count."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    flat = np.concatenate(sets)
    vocabulary, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = count[place] > 1
    # Similar sets often agree in the smallest of the tokens that most of them hold.
    commonest = np.full(n, len(vocabulary))
    np.minimum.at(commonest, owner[shared], place[shared])
    side = np.zeros(n, bool) if left is None else left
    order = np.lexsort((sizes, commonest, side))
    tokens = np.split(place[shared], np.cumsum(np.bincount(owner[shared], minlength=n))[:-1])
    forest = Forest(n)
    groups = []
    for part in (order[~side[order]], order[side[order]]):
        groups += [part[i : i + group] for i in range(0, len(part), group)]
    turn = np.empty(n, np.int64)
    for g, members in enumerate(groups):
        turn[members] = g
    for g, members in enumerate(groups):
        if left is not None and left[members[0]]:
            continue
        union, where = np.unique(np.concatenate([tokens[m] for m in members]), return_inverse=True)
        matrix = np.zeros((len(members), len(union)), np.int32)
        matrix[np.repeat(np.arange(len(members)), [len(tokens[m]) for m in members]), where] = 1
        own = sizes[members]
        queries = order[side[order]] if left is not None else order[turn[order] >= g]
        for q in queries.tolist():
            root = forest.root(q)
            roots = [forest.root(m) for m in members.tolist()]
            if all(r == root for r in roots):
                continue
            at = np.minimum(np.searchsorted(union, tokens[q]), len(union) - 1)
            columns = at[union[at] == tokens[q]] if len(union) else at
            # The union's overlap bounds every member's: too small, and the group stays closed.
            if 100 * len(columns) < percent * sizes[q]:
                continue
            overlap = matrix[:, columns].sum(1)
            linked = 100 * overlap >= percent * (own + sizes[q] - overlap)
            for m in members[linked].tolist():
                forest.join(q, m)
    return [forest.root(i) for i in range(n)]


def join_families(candidates: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect what the join connects, not all pairs."""
    sized = candidates.join(families.withColumnRenamed("node", "rid"), "rid").select(
        "rid", F.col("root").alias("family"), "tokens", F.size("tokens").alias("n")
    )
    blocks = sized.groupBy("family").agg(
        F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"),
        F.count(F.lit(1)).alias("members"),
    )
    placed = sized.join(blocks.where(F.col("members") > 1), "family").withColumn(
        "block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = placed.withColumn("other", other).select(
        "family",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "block",
        "rid",
        "tokens",
    )

    def link(table):
        rid = table["rid"].to_numpy()
        sets = [np.sort(t.values.to_numpy().view(np.uint64)) for t in table["tokens"].combine_chunks()]
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        left = None if low == high else table["block"].to_numpy() == low
        if len(sets) < 2 or left is not None and left.all() | (~left).all():
            roots = np.arange(len(sets))
        else:
            roots = np.array(link_sets(sets, percent, left))
        linked = roots != np.arange(len(sets))
        return pa.table({"a": rid[roots[linked]], "b": rid[linked]})

    return met.groupBy("family", "low", "high").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document.

    docs: doc_id and text; other columns are ignored. A document without words, or of null text, has
    no shingle and is a component of its own. Repeated rows and ids are documents like any other
    (equal texts are linked); a null id counts last in a component.
    """
    found = find_components(slice_documents(docs.select("doc_id", "text")), percent)
    return found.select("doc_id", "n_shingles", "component_id")


def one_per_component(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those linked with a document of smaller id (of rows with that id,
    the first stays); all that have no words stay."""
    sliced = slice_documents(docs)
    found = find_components(sliced, percent)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid", "slice")).alias("first")
    kept = (
        found.where(F.col("root").isNotNull())
        .groupBy("root")
        .agg(first)
        .select("first.slice", "first.rid")
        .unionByName(found.where(F.col("root").isNull()).select("slice", "rid"))
        .groupBy("slice")
        .agg(F.collect_list("rid").alias("kept"))
    )
    columns = docs.columns

    def choose(left, right):
        parts = []
        for i in range(left.num_rows if right.num_rows else 0):
            row = left.slice(i, 1)
            numbers = row["rid"].combine_chunks().flatten().to_numpy()
            at = np.flatnonzero(np.isin(numbers, right["kept"].combine_chunks().flatten().to_numpy()))
            texts = unpack(row["packed"][0].as_py(), row["lengths"][0].as_py())
            known = row["present"].combine_chunks().flatten().to_pylist()
            rest = row["rest"].combine_chunks().flatten().take(pa.array(at))
            own = {c: rest.field(c) for c in columns if c != "text"}
            own["text"] = pa.array([texts[j].decode() if known[j] else None for j in at], pa.string())
            parts.append(pa.table({c: own[c] for c in columns}))
        return pa.concat_tables(parts) if parts else empty.slice(0, 0)

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(docs.schema).empty_table()
    return (
        sliced.select("slice", "rid", "rest", "present", "lengths", "packed")
        .groupBy("slice")
        .cogroup(kept.groupBy("slice"))
        .applyInArrow(choose, docs.schema)
    )


def find_components(sliced: DataFrame, percent: int) -> DataFrame:
    """(slice, rid, doc_id, n_shingles, root, component_id) per document; documents of one component
    share a root, those without words have none."""
    rows = F.arrays_zip("rid", F.col("rest.doc_id").alias("doc_id"), "n", "digest")
    each = sliced.select("slice", F.inline(rows)).withColumnRenamed("n", "n_shingles")
    tokens = each.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first().n
    buckets = int(-(-tokens // BUCKET_TOKENS)) or 1
    shared = count_shared(sliced, buckets)
    candidates = materialize(
        find_candidates(sliced, shared, buckets, percent).dropDuplicates(["digest"]), "jaccard-sets"
    )
    prefixes = candidates.select("rid", F.explode("prefix").alias("token"))
    stars = (
        prefixes.groupBy("token")
        .agg(F.min("rid").alias("a"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )
    edges = prefixes.join(stars, "token").select("a", F.col("rid").alias("b")).distinct()
    families = components(edges)
    links = materialize(join_families(candidates, families, percent), "jaccard-links")
    linked = components(links).withColumnRenamed("node", "rid")
    labels = candidates.select("rid", "digest").join(linked, "rid").select("digest", "root")
    sets = each.where(F.col("digest").isNotNull())
    smallest = sets.groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.min("rid").alias("own")
    )
    # A set that no link joins is its own root; rids of such sets and of linked ones differ.
    by_set = smallest.join(labels, "digest", "left").withColumn(
        "root", F.coalesce("root", F.col("own"))
    )
    roots = by_set.groupBy("root").agg(F.min("least").alias("component_id"))
    merged = by_set.join(roots, "root").select("digest", "root", "component_id")
    columns = ["slice", "rid", "doc_id", "n_shingles", "root", "component_id"]
    without = each.where(F.col("digest").isNull()).select(
        "*", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id")
    )
    return sets.join(merged, "digest").select(columns).unionByName(without.select(columns))
