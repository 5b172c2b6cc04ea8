"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it starts earlier too. Every window of that
many bytes belongs to the least hash of its ``GRAM``-byte strings, its anchor, so equal windows have
equal anchors; neighbouring windows of one anchor form a run.

1. Slices of documents emit their distinct runs (anchor, hash of the run's bytes).
2. Runs are matched by anchor. A run whose bytes occur earlier repeats as a whole; a run whose
   anchor occurs nowhere else, and once in itself, cannot repeat. What is left, the first of each of
   several different runs of an anchor and periodic runs, may repeat in part.
3. These runs go to shards by anchor. Each shard's suffix array is built by Larsson-Sadakane
   refinement, Kasai's common prefixes cut it into classes of equal windows, and all but the first
   window of a class repeat. An anchor with too many runs is cut into several shards in document
   order; the sorted digests of their windows are merged by binary search.
4. The slices get their repeated windows back and drop the bytes under them.

Copies meet in their slice before they are sent, so a text that a third of the documents hold is one
entry per slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.batches import slices
from driftmark.llm.hashing import BASES, Rolling
from driftmark.llm.suffixes import common_prefixes, suffix_array
from driftmark.sources.scratch import materialize, scratch_path

LENGTH = 100
GRAM = 40
MOST_STARTS = 64
SLICE_BYTES = 1 << 20
SEGMENT_BYTES = 2 << 20
BUCKET_RUNS = 1_000_000
SHARD_RUNS = 16_000
MERGE_WINDOWS = 2_000_000
NO_ID = np.iinfo(np.int64).max


class Runs:
    """Runs of windows in a body of texts that lie end to end."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.anchor_hash, self.run_hash = Rolling(BASES[0], 3), Rolling(BASES[1], 4)

    def __call__(self, body: np.ndarray, ends: np.ndarray):
        """(first start, last start, anchor, hash of the bytes) of the runs, by position."""
        parts = [
            self._segment(body, ends, a) for a in range(0, max(len(body), 1), SEGMENT_BYTES)
        ]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def periodic(self, body: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether the least hash of a run occurs more than once in it."""
        out = np.zeros(len(first), bool)
        for a in range(0, len(body), SEGMENT_BYTES):
            i, j = np.searchsorted(first, [a, a + SEGMENT_BYTES])
            if i == j:
                continue
            data = body[a : a + SEGMENT_BYTES + MOST_STARTS + self.length]
            at = np.arange(max(len(data) - self.gram + 1, 0))
            grams = self.anchor_hash.of(self.anchor_hash.sums(data), at, at + self.gram)
            counts = last[i:j] - first[i:j] + self.length - self.gram + 1
            heads = np.cumsum(counts) - counts
            inside = grams[np.repeat(first[i:j] - a - heads, counts) + np.arange(counts.sum())]
            least = np.minimum.reduceat(inside, heads)
            out[i:j] = np.add.reduceat(inside == np.repeat(least, counts), heads) > 1
        return out

    def _segment(self, body, ends, offset):
        data = body[offset : offset + SEGMENT_BYTES + self.length - 1]
        n = len(data) - self.length + 1
        if n <= 0:
            nothing = np.empty(0, np.int64)
            return nothing, nothing, nothing.astype(np.uint64), nothing.astype(np.uint64)
        sums = self.anchor_hash.sums(data)
        at = np.arange(len(data) - self.gram + 1)
        least = self.anchor_hash.of(sums, at, at + self.gram)
        width, span = 1, self.length - self.gram + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = span - width
        anchor = np.minimum(least[: len(least) - rest], least[rest:])[:n]
        start = np.arange(n) + offset
        owner = np.searchsorted(ends, start, side="right")
        valid = start + self.length <= ends[owner]
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(new)
        new |= (np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))) % MOST_STARTS == 0
        first = np.flatnonzero(new & valid)
        # A run ends where the next one, or the invalid end of its text, begins.
        stop = np.append(np.flatnonzero(new | ~valid), n)
        last = stop[np.searchsorted(stop, first, side="right")] - 1
        sums = self.run_hash.sums(data)
        return (
            first + offset,
            last + offset,
            anchor[first],
            self.run_hash.of(sums, first, last + self.length),
        )


def document_order(doc_ids: list) -> np.ndarray:
    """Ids as numbers, null last."""
    return np.array([NO_ID if i is None else i for i in doc_ids], np.int64)


def distinct_runs(found, ends: np.ndarray, ids: np.ndarray):
    """Groups the runs of a slice: (index of the earliest run per group, group of every run)."""
    first, _, anchor, code = found
    owner = np.searchsorted(ends, first, side="right")
    turn = np.empty(len(ids), np.int64)
    turn[np.lexsort((np.arange(len(ids)), ids))] = np.arange(len(ids))
    order = np.lexsort((first, turn[owner], code, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (code[order][1:] != code[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def _lists(flat: np.ndarray, sizes: np.ndarray, kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def slice_documents(docs: DataFrame) -> DataFrame:
    """(slice, doc_ids, lengths, packed): a few hundred documents a row, texts end to end and packed.
    ``slice`` is the number of its first row; rows of a slice are numbered on."""

    def pack(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            one = np.array([len(texts)])
            yield pa.record_batch(
                {
                    "slice": batch.column("rid").slice(0, 1),
                    "doc_ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "lengths": _lists(np.fromiter(map(len, texts), np.int64, len(texts)), one, pa.int64()),
                    "packed": pa.array([packer.compress(b"".join(texts))], pa.binary()),
                }
            )

    spark = docs.sparkSession
    path = scratch_path(spark, "repeat-slices")
    numbered = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "text"
    )
    packed = numbered.mapInArrow(
        pack, "slice long, doc_ids array<long>, lengths array<long>, packed binary"
    )
    # Small row groups: a reader holds one of them, and rows are large.
    packed.write.option("parquet.block.size", 8 << 20).parquet(path)
    return spark.read.schema(packed.schema).parquet(path)


def _open(row: dict):
    """(body, ends of the texts, ids in order) of a slice."""
    import zstandard

    ends = np.cumsum(np.array(row["lengths"], np.int64))
    size = int(ends[-1])
    body = zstandard.ZstdDecompressor().decompress(row["packed"], max_output_size=max(size, 1))
    return np.frombuffer(body, np.uint8), ends, document_order(row["doc_ids"])


def match_runs(sliced: DataFrame, buckets: int) -> DataFrame:
    """(slice, bucket, whole, part, shard): first starts of runs that repeat as a whole, of runs that
    may repeat in part, and which of their anchor's shards the latter belong to."""

    def emit(batches):
        runs = Runs()
        for batch in batches:
            for row in batch.to_pylist():
                body, ends, ids = _open(row)
                found = runs(body, ends)
                earliest, _ = distinct_runs(found, ends, ids)
                earliest = np.sort(earliest)
                first, last, anchor, code = (x[earliest] for x in found)
                twice = runs.periodic(body, first, last)
                own = (anchor >> np.uint64(8)) % np.uint64(buckets)
                order = np.argsort(own, kind="stable")
                sizes = np.bincount(own.astype(np.int64), minlength=buckets)
                owner = np.searchsorted(ends, first, side="right")
                yield pa.record_batch(
                    {
                        "slice": pa.array(np.full(buckets, row["slice"])),
                        "bucket": pa.array(np.arange(buckets, dtype=np.int32)),
                        "anchor": _lists(anchor[order].view(np.int64), sizes, pa.int64()),
                        "code": _lists(code[order].view(np.int64), sizes, pa.int64()),
                        "start": _lists(first[order].astype(np.int32), sizes, pa.int32()),
                        "owner": _lists(owner[order].astype(np.int32), sizes, pa.int32()),
                        "twice": _lists(twice[order].astype(np.int8), sizes, pa.int8()),
                        "ids": pa.array([ids.tolist()] * buckets, pa.list_(pa.int64())),
                    }
                )

    def match(table):
        anchor, code = (
            table[c].combine_chunks().flatten().to_numpy() for c in ("anchor", "code")
        )
        starts = table["start"].combine_chunks()
        start, sizes = starts.flatten().to_numpy(), np.diff(starts.offsets.to_numpy())
        owner = table["owner"].combine_chunks().flatten().to_numpy()
        twice = table["twice"].combine_chunks().flatten().to_numpy() > 0
        row = np.repeat(np.arange(len(sizes)), sizes)
        whole, part, shard = (np.zeros(len(anchor), bool) for _ in range(3))
        shard = np.zeros(len(anchor), np.int32)
        order = np.argsort(anchor, kind="stable")
        alike = anchor[order][1:] == anchor[order][:-1]
        several = twice.copy()
        several[order[1:]] |= alike
        several[order[:-1]] |= alike
        at = np.flatnonzero(several)
        if len(at):
            ids = table["ids"].combine_chunks()
            flat_ids, id_starts = ids.flatten().to_numpy(), ids.offsets.to_numpy()[:-1]
            id_starts = id_starts - ids.offsets[0].as_py()
            doc = flat_ids[id_starts[row[at]] + owner[at]]
            rid = table["slice"].to_numpy()[row[at]] + owner[at]
            by_run = at[np.lexsort((start[at], rid, doc, code[at], anchor[at]))]
            repeat = np.zeros(len(by_run), bool)
            repeat[1:] = (anchor[by_run][1:] == anchor[by_run][:-1]) & (
                code[by_run][1:] == code[by_run][:-1]
            )
            whole[by_run[repeat]] = True
            kept = np.isin(at, by_run[~repeat], assume_unique=True)
            firsts = at[kept][np.lexsort((start[at][kept], rid[kept], doc[kept], anchor[at][kept]))]
            new = np.ones(len(firsts), bool)
            new[1:] = anchor[firsts][1:] != anchor[firsts][:-1]
            heads = np.flatnonzero(new)
            counts = np.diff(np.append(heads, len(firsts)))
            place = np.arange(len(firsts)) - np.repeat(heads, counts)
            shard[firsts] = place // SHARD_RUNS
            # Bit 30: the anchor has more than one shard.
            shard[firsts] |= np.repeat((counts > SHARD_RUNS).astype(np.int32) << 30, counts)
            part[firsts] = np.repeat(counts > 1, counts) | twice[firsts]

        def listed(mask, values):
            return _lists(
                values[mask], np.bincount(row[mask], minlength=len(sizes)), pa.int32()
            )

        return pa.table(
            {
                "slice": table["slice"],
                "whole": listed(whole, start),
                "part": listed(part, start),
                "shard": listed(part, shard),
            }
        )

    return (
        sliced.mapInArrow(
            emit,
            "slice long, bucket int, anchor array<long>, code array<long>, start array<int>,"
            " owner array<int>, twice array<tinyint>, ids array<long>",
        )
        .groupBy("bucket")
        .applyInArrow(match, "slice long, whole array<int>, part array<int>, shard array<int>")
    )


def _flat(table: pa.Table, column: str) -> np.ndarray:
    return (
        table[column].combine_chunks().flatten().to_numpy().astype(np.int64)
        if table.num_rows
        else np.empty(0, np.int64)
    )


def cut_runs(sliced: DataFrame, matched: DataFrame, parts: int) -> DataFrame:
    """(group, shard, many, anchor, doc, rid, slice, start, bytes) of runs that may repeat in part."""

    runs = Runs()

    def cut(left, right):
        out = {k: [] for k in ("group", "shard", "many", "anchor", "doc", "rid", "slice", "start", "bytes")}
        starts, shards = _flat(right, "part"), _flat(right, "shard")
        if len(starts):
            for row in left.to_pylist():
                body, ends, ids = _open(row)
                first, last, anchor, _ = runs(body, ends)
                at = np.searchsorted(first, starts)
                owner = np.searchsorted(ends, starts, side="right")
                out["group"] += (anchor[at] % np.uint64(parts)).astype(np.int64).tolist()
                out["shard"] += (shards & (1 << 30) - 1).tolist()
                out["many"] += (shards >> 30 > 0).tolist()
                out["anchor"] += anchor[at].view(np.int64).tolist()
                out["doc"] += ids[owner].tolist()
                out["rid"] += (row["slice"] + owner).tolist()
                out["slice"] += [row["slice"]] * len(starts)
                out["start"] += starts.tolist()
                out["bytes"] += [
                    body[a:b].tobytes()
                    for a, b in zip(starts.tolist(), (last[at] + LENGTH).tolist(), strict=True)
                ]
        kinds = {"many": pa.bool_(), "bytes": pa.binary()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return (
        sliced.groupBy("slice")
        .cogroup(matched.select("slice", "part", "shard").groupBy("slice"))
        .applyInArrow(
            cut,
            "group long, shard long, many boolean, anchor long, doc long, rid long, slice long,"
            " start long, bytes binary",
        )
    )


def repeated_windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the texts, in order: (position in the joined texts, text, whether the same bytes
    start earlier), from the suffix array of the shard."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    position = np.arange(counts.sum()) + np.repeat(
        np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts
    )
    order = suffix_array(data)
    shared = common_prefixes(data, order)
    # Equal windows are neighbours in the array, and every common prefix between them is as long.
    number = np.empty(len(data), np.int64)
    number[order] = np.cumsum(shared < length)
    own = number[position]
    earliest = np.full(len(data) + 1, len(data))
    np.minimum.at(earliest, own, position)
    return position, owner, earliest[own] != position


def search_shards(cut: DataFrame) -> DataFrame:
    """(slice, first, last, d1, d2, shard, start): runs of repeated windows per slice; and the digests
    of the first windows of anchors that have several shards."""

    def search(table):
        table = table.sort_by([("doc", "ascending"), ("rid", "ascending"), ("start", "ascending")])
        texts, many = table["bytes"].to_pylist(), table["many"].to_numpy()
        slice_, start = table["slice"].to_numpy(), table["start"].to_numpy()
        out = {k: [] for k in ("slice", "first", "last", "d1", "d2", "shard", "start")}

        def add(**columns):
            n = len(columns["slice"])
            for k, v in out.items():
                v.append(columns.get(k, np.full(n, -1)).astype(np.int64))

        position, owner, repeated = repeated_windows(texts, LENGTH)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        heads = np.cumsum(sizes) - sizes
        place = start[owner] + position - heads[owner]
        at = np.flatnonzero(repeated)
        # Neighbouring windows of one run leave as one row.
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (owner[at][1:] != owner[at][:-1])
        close = np.append(new[1:], True) if len(at) else new
        add(slice=slice_[owner[at[new]]], first=place[at[new]], last=place[at[close]])
        wide = np.flatnonzero(~repeated & many[owner])
        if len(wide):
            data = np.frombuffer(b"".join(texts), np.uint8)
            digests = []
            for base, seed in zip(BASES, (5, 6), strict=True):
                rolling = Rolling(base, seed)
                codes = rolling.of(rolling.sums(data), position[wide], position[wide] + LENGTH)
                digests.append(codes.view(np.int64))
            add(
                slice=slice_[owner[wide]],
                d1=digests[0],
                d2=digests[1],
                shard=table["shard"].to_numpy()[owner[wide]],
                start=place[wide],
            )
        return pa.table({k: np.concatenate(v) for k, v in out.items()})

    return cut.groupBy("group", "shard").applyInArrow(
        search, "slice long, first long, last long, d1 long, d2 long, shard long, start long"
    )


def merge_shards(found: DataFrame, parts: int) -> DataFrame:
    """(slice, first, last): windows that an earlier shard of their anchor holds too."""

    def merge(table):
        d = np.rec.fromarrays([table["d1"].to_numpy(), table["d2"].to_numpy()])
        shard = table["shard"].to_numpy()
        known, hit = d[:0], np.zeros(len(d), bool)
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            if len(known):
                place = np.minimum(np.searchsorted(known, d[at]), len(known) - 1)
                hit[at] = known[place] == d[at]
            known = np.unique(np.concatenate([known, d[at[~hit[at]]]]))
        starts = table["start"].to_numpy()[hit]
        return pa.table({"slice": table["slice"].to_numpy()[hit], "first": starts, "last": starts})

    wide = found.where(F.col("start") >= 0)
    return (
        wide.withColumn("part", F.pmod("d1", F.lit(parts)))
        .groupBy("part")
        .applyInArrow(merge, "slice long, first long, last long")
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) per document: removed spans [start, end) in bytes, and the bytes
    that stay.

    docs: doc_id and text; other columns are ignored. Null text counts as empty, texts below
    ``LENGTH`` bytes stay whole. Documents come in the order of their ids, null last; rows that share
    an id count as different documents, in the order they were read. Judged on the input: a removed
    string still removes its later copies.
    """
    sliced = slice_documents(docs)
    sizes = sliced.select(F.explode("lengths").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    density = 2 / (LENGTH - GRAM + 2)
    buckets = int(total * density // BUCKET_RUNS) + 1
    matched = materialize(match_runs(sliced, buckets), "repeat-matches")
    several = matched.agg(F.coalesce(F.sum(F.size("part")), F.lit(0)).alias("n")).first().n
    cut = cut_runs(sliced, matched, several // SHARD_RUNS + 1)
    found = materialize(search_shards(cut), "repeat-windows")
    wide = found.where(F.col("start") >= 0).count()
    ranges = found.where(F.col("first") >= 0).select("slice", "first", "last")
    if wide:
        ranges = ranges.unionByName(merge_shards(found, wide // MERGE_WINDOWS + 1))
    marks = matched.select(
        "slice", "whole", F.array().cast("array<long>").alias("first"), F.array().cast("array<long>").alias("last")
    ).unionByName(
        ranges.groupBy("slice")
        .agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
        .withColumn("whole", F.array().cast("array<int>"))
    )

    runs = Runs()

    def drop(left, right):
        out = {"doc_id": [], "n_bytes": [], "spans": [], "kept": []}
        whole, firsts, lasts = (_flat(right, c) for c in ("whole", "first", "last"))
        for row in left.to_pylist():
            body, ends, ids = _open(row)
            found = runs(body, ends)
            first, last = found[0], found[1]
            earliest, group = distinct_runs(found, ends, ids)
            repeated = np.ones(len(first), bool)
            repeated[earliest] = np.isin(first[earliest], whole)
            repeated |= np.isin(group, group[repeated & np.isin(first, whole)])
            cover = np.zeros(len(body) + 1, np.int64)
            np.add.at(cover, np.concatenate([first[repeated], firsts]), 1)
            np.add.at(cover, np.concatenate([last[repeated], lasts]) + LENGTH, -1)
            gone = np.cumsum(cover[:-1]) > 0
            begin = 0
            for doc_id, end in zip(row["doc_ids"], ends.tolist(), strict=True):
                mine = gone[begin:end]
                edges = np.flatnonzero(np.diff(mine, prepend=False, append=False)).tolist()
                out["doc_id"].append(doc_id)
                out["n_bytes"].append(end - begin)
                out["spans"].append(
                    [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                )
                out["kept"].append(body[begin:end][~mine].tobytes())
                begin = end
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.table(
            {
                "doc_id": pa.array(out["doc_id"], pa.int64()),
                "n_bytes": pa.array(out["n_bytes"], pa.int64()),
                "spans": pa.array(out["spans"], pa.list_(span)),
                "kept": pa.array(out["kept"], pa.binary()),
            }
        )

    return (
        sliced.groupBy("slice")
        .cogroup(marks.groupBy("slice"))
        .applyInArrow(
            drop,
            "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary",
        )
    )
