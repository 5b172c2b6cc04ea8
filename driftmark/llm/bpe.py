"""Byte-level BPE encoding and decoding.

Merges are folded by Spark's higher-order functions over the bytes of distinct words, with the
ranks as a literal. The bytes of a word are a string of the code points 0 to 255, so that pieces
are joined and looked up as strings. The rank literal is an array of small maps, addressed by the
piece's hash: a lookup in one large map would compare key by key.

Texts are split once, into slices that hold their distinct words and the words of each document as
places among these. Words are counted over all slices; those used most, up to a fixed number, are
folded once and their ids handed to every task. That list is small, so that neither the driver nor
a worker holds much of it. The remaining words, most of them used once in the whole corpus, are
merged where they occur, all of a slice in step, as numpy arrays of piece numbers. Words of more than
``LONG_WORD`` bytes would take quadratic time either way; they are merged with a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm.batches import joined, release_memory, slices
from driftmark.llm.hashing import BASES, Rolling
from driftmark.llm.vectors import one_list
from driftmark.sources.scratch import scratch_path

BUCKETS = 1 << 14
FREQUENT = 1 << 18
LONG_WORD = 128
SLICE_BYTES = 4 << 20
HASH_BYTES = 1 << 20
OUTPUT_ROWS = 256
#: More than any array of pieces is long.
REST = 1 << 30
#: More than there are numbers of pieces.
PIECES = 1 << 31

# The pattern that goes with the rank file, and what it means for ASCII text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|"""
    r"""[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by byte string; one base64 text and one number a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def rank_buckets(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: an array of maps, indexed by the crc32 of the piece."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        maps[zlib.crc32(piece.decode("latin-1").encode()) % BUCKETS][piece.decode("latin-1")] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def piece_table(ranks: dict[bytes, int]) -> Column:
    """The pieces as a literal array, indexed by id."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    return F.from_json(F.lit(json.dumps(pieces)), "array<string>")


def rank_of(piece: Column, buckets: Column) -> Column:
    """The rank of a piece, null if it is none."""
    place = F.pmod(F.crc32(piece), F.lit(BUCKETS)).cast("int")
    return F.try_element_at(F.get(buckets, place), piece)


def fold_merges(word: Column, buckets: Column) -> Column:
    """Ids of one word: again and again the leftmost neighbours of the lowest rank become one."""
    # As the argument of a function the literal is held once, however often it is looked up.
    return _let(buckets, lambda b: _folded(word, b))


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _folded(word: Column, buckets: Column) -> Column:
    """The state is the places where the word is still cut and the rank of each pair of neighbours:
    a merge takes one cut away and changes the two ranks beside it."""
    n = F.length(word)

    def rank_between(start, end):
        return rank_of(F.substring(word, start, end - start), buckets)

    # ``at``: number of the lowest pair, 0 when nothing is left to merge. Values used more than
    # once are bound to a name, as a lambda evaluates an expression each time it is written.
    def state(cuts, ranks):
        return _let(
            ranks,
            lambda r: F.struct(
                cuts.alias("cuts"),
                r.alias("ranks"),
                F.coalesce(F.array_position(r, F.array_min(r)), F.lit(0)).cast("int").alias("at"),
            ),
        )

    def merge(now):
        cuts, ranks, at = now["cuts"], now["ranks"], now["at"]
        # Pair i lies between cuts i and i + 2 (from 1), and merging it takes cut i + 1 away.
        left = F.when(at > 1, F.array(rank_between(F.get(cuts, at - 2), F.get(cuts, at + 1))))
        right = F.when(
            at < F.size(ranks), F.array(rank_between(F.get(cuts, at - 1), F.get(cuts, at + 2)))
        )
        return state(
            F.array_remove(cuts, F.get(cuts, at)),
            F.concat(
                F.slice(ranks, 1, F.greatest(at - 2, F.lit(0))),
                F.coalesce(left, none),
                F.coalesce(right, none),
                F.slice(ranks, at + 2, REST),
            ),
        )

    none = F.array().cast("array<int>")
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank_between(i, i + 2))
    folded = F.aggregate(
        F.sequence(F.lit(1), n - 1),
        state(F.sequence(F.lit(1), n + 1), pairs),
        lambda now, _: F.when(now["at"] == 0, now).otherwise(merge(now)),
        lambda now: F.transform(
            F.slice(now["cuts"], 2, REST),
            lambda end, i: rank_between(F.get(now["cuts"], i), end),
        ),
    )
    whole = rank_of(word, buckets)
    return F.when(whole.isNotNull(), F.array(whole)).when(n > 1, folded).otherwise(none)


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for very long words, in n log n steps over a linked list."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    piece = [word[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        rank, i, size = heapq.heappop(queue)
        j = after[i]
        if not piece[i] or j >= n or len(piece[i]) + len(piece[j]) != size:
            continue
        piece[i], piece[j] = piece[i] + piece[j], b""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n:
                pair = piece[left] + piece[after[left]]
                if (r := ranks.get(pair)) is not None:
                    heapq.heappush(queue, (r, left, len(pair)))
    return [ranks[p] for p in piece if p]


@dataclass(frozen=True)
class PairTable:
    """Which two pieces make a third, by their numbers: ``keys`` in order, and the ``ranks`` of the
    results. The number of a piece is its rank; bytes without one are numbered from ``top``, and
    ``first`` has the numbers of the bytes."""

    top: int
    first: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> PairTable:
        top = max(ranks.values(), default=-1) + 1
        alone = {bytes([i]): top + i for i in range(256)}
        number, pairs = alone | ranks, {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                left, right = number.get(piece[:i]), number.get(piece[i:])
                if left is not None and right is not None:
                    pairs[left * PIECES + right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        found = np.fromiter(pairs.values(), np.int32, len(pairs))
        order = np.argsort(keys)
        return cls(top, np.array([number[b] for b in alone], np.int32), keys[order], found[order])

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``REST`` where it makes no piece."""
        if not len(self.keys):
            return np.full(len(left), REST, np.int32)
        key = left.astype(np.int64) * PIECES + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(REST))


def merge_in_step(data: np.ndarray, sizes: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ids): the same for many words at a time, their bytes in a row in ``data``. A step merges
    the leftmost pair of the lowest rank in every word; words without one are done."""
    out_sizes, parts = np.zeros(len(sizes), np.int64), []
    at = np.flatnonzero(sizes)
    piece, sizes = pairs.first[data], sizes[at]
    last = np.cumsum(sizes) - 1
    rank = np.full(len(piece), REST, np.int32)
    inner = np.ones(len(piece), bool)
    inner[last] = False
    i = np.flatnonzero(inner)
    rank[i] = pairs(piece[i], piece[i + 1])
    while len(at):
        start = np.cumsum(sizes) - sizes
        low = np.minimum.reduceat(rank, start)
        done = low == REST
        if done.any():
            over = np.repeat(done, sizes)
            out_sizes[at[done]] = sizes[done]
            parts.append((at[done], piece[over]))
            piece, rank = piece[~over], rank[~over]
            at, sizes, low = at[~done], sizes[~done], low[~done]
            if not len(at):
                break
            start = np.cumsum(sizes) - sizes
        lowest = np.flatnonzero(rank == np.repeat(low, sizes))
        here = lowest[np.searchsorted(lowest, start)]
        piece[here] = low
        keep = np.ones(len(piece), bool)
        keep[here + 1] = False
        piece, rank = piece[keep], rank[keep]
        here = here - np.arange(len(here))
        sizes = sizes - 1
        start = np.cumsum(sizes) - sizes
        after = here < start + sizes - 1
        rank[here] = REST
        rank[here[after]] = pairs(piece[here[after]], piece[here[after] + 1])
        before = here[here > start] - 1
        rank[before] = pairs(piece[before], piece[before + 1])
    ids = np.empty(int(out_sizes.sum()), np.int32)
    starts = np.cumsum(out_sizes) - out_sizes
    for words, found in parts:
        n = out_sizes[words]
        ids[np.repeat(starts[words] - (np.cumsum(n) - n), n) + np.arange(len(found))] = found
    if len(ids) and ids.max() >= pairs.top:
        raise KeyError("a byte of the text has no rank")
    return out_sizes, ids


def merged_words(words: list[bytes], ranks: dict[bytes, int], pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of ids, ids in a row) of words of any length."""
    short = [b"" if len(w) > LONG_WORD or w in ranks else w for w in words]
    n = np.fromiter(map(len, short), np.int64, len(short))
    n, ids = merge_in_step(np.frombuffer(b"".join(short), np.uint8), n, pairs)
    other = {i: heap_merges(w, ranks) for i, (w, s) in enumerate(zip(words, short, strict=True)) if w and not s}
    if other:
        cuts = np.cumsum(n)
        where = np.repeat([cuts[i] for i in other], [len(x) for x in other.values()])
        ids = np.insert(ids, where, [k for x in other.values() for k in x]).astype(np.int32)
        n[list(other)] = [len(x) for x in other.values()]
    return n, ids


def splitter(pattern: str):
    """The matches of the pattern in a text. Over ASCII text, the public pattern needs no Unicode
    classes, and the plain engine splits alike and faster."""
    import regex

    find = regex.compile(pattern).findall
    if pattern != PATTERN:
        return find
    plain = re.compile(ASCII_PATTERN).findall
    return lambda text: plain(text) if text.isascii() else find(text)


def split_texts(docs: DataFrame, pattern: str = PATTERN, size: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, counts, words, used, codes): slices of about ``size`` bytes of text, a row each. The
    distinct words of the slice and how often each is used; of its documents the ids and numbers of
    words; and the words of all in a row as places in the list, packed."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def split(batches):
        find = splitter(pattern)
        for batch in joined(slices(batches, "text", size), size):
            own, counts, codes = Numbered(), [], []
            number = own.__getitem__
            for text in batch.column("text"):
                found = find(text.as_py() or "")
                counts.append(len(found))
                codes.append(np.fromiter(map(number, found), np.int64, len(found)))
            codes = np.concatenate(codes)
            used = np.bincount(codes, minlength=len(own))
            # Small numbers for common words pack better.
            order = np.argsort(-used, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            yield pa.record_batch(
                {
                    "doc_id": one_list(batch.column("doc_id")),
                    "counts": one_list(pa.array(counts, pa.int32())),
                    "words": one_list(pa.array(list(own), pa.string()).take(pa.array(order))),
                    "used": one_list(pa.array(used[order].astype(np.int32))),
                    "codes": pa.array([packed_codes(place[codes])], pa.binary()),
                }
            )
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(
        split, f"doc_id array<{kind}>, counts array<int>, words array<string>, used array<int>, codes binary"
    )


class Numbered(dict):
    """Numbers keys in the order they come."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def packed_codes(codes: np.ndarray) -> bytes:
    """Byte by byte: the high ones hardly differ from one another."""
    import zstandard

    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked_codes(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def count_words(split: DataFrame) -> DataFrame:
    """(word, n) over all slices, for words up to ``LONG_WORD`` bytes."""
    words = split.select(F.inline(F.arrays_zip("words", "used")).alias("word", "used"))
    short = words.where(F.octet_length("word") <= LONG_WORD)
    return short.groupBy("word").agg(F.sum("used").alias("n"))


def _bytes_as_text(word: Column) -> Column:
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


class WordHash:
    """128 bits of words in a buffer of UTF-8 bytes, as two numbers."""

    def __init__(self):
        self.rollings = [Rolling(base, 7 + i) for i, base in enumerate(BASES)]

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Chunk by chunk; of words too long to be known only as much as tells them apart."""
        out = [np.empty(len(starts), np.uint64) for _ in self.rollings]
        ends = np.minimum(ends, starts + LONG_WORD + 1)
        for a in range(0, len(data), HASH_BYTES):
            i, j = np.searchsorted(starts, [a, a + HASH_BYTES])
            chunk = data[a : a + HASH_BYTES + LONG_WORD + 1]
            for codes, r in zip(out, self.rollings, strict=True):
                codes[i:j] = r.of(r.sums(chunk), starts[i:j] - a, ends[i:j] - a)
        return out


class WordPlaces:
    """Places of known words by their hashes: an open-addressing table in numpy arrays, a fraction
    of the size of a dictionary of texts."""

    def __init__(self, codes: np.ndarray, checks: np.ndarray, slots: np.ndarray | None = None):
        self.codes, self.checks, self.slots = codes, checks, slots
        bits = max(int(2 * len(codes)).bit_length(), 4)
        self.mask = np.uint64((1 << bits) - 1)
        if slots is None:
            self._fill(bits)

    def _fill(self, bits: int) -> None:
        codes = self.codes
        self.slots = np.full(1 << bits, -1, np.int32)
        rest = np.arange(len(codes), dtype=np.int32)
        at = codes & self.mask
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]
            missed = self.slots[at] != rest
            rest, at = rest[missed], (at[missed] + np.uint64(1)) & self.mask

    def __call__(self, codes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Place of each word, or -1."""
        out = np.full(len(codes), -1, np.int32)
        if not len(self.codes):
            return out
        open_, at = np.arange(len(codes)), codes & self.mask
        while len(open_):
            found = self.slots[at]
            same = (found >= 0) & (self.codes[found] == codes[open_])
            same &= self.checks[found] == checks[open_]
            out[open_[same]] = found[same]
            more = (found >= 0) & ~same
            open_, at = open_[more], (at[more] + np.uint64(1)) & self.mask
        return out


def frequent_words(
    split: DataFrame, buckets: Column, most: int = FREQUENT
) -> tuple[WordPlaces, np.ndarray, np.ndarray]:
    """The words used most, the numbers of their ids, and the ids in a row; at most ``most`` words
    of at most ``LONG_WORD`` bytes reach the driver."""
    top = count_words(split).orderBy(F.col("n").desc(), "word").limit(most)
    parts = split.sparkSession.sparkContext.defaultParallelism * 4
    folded = top.repartition(parts, "word").select(
        F.encode("word", "UTF-8").alias("word"),
        fold_merges(_bytes_as_text(F.col("word")), buckets).alias("ids"),
    )
    hashes, codes, lengths, ids = WordHash(), [], [], []
    for batch in folded.toArrow().to_batches(max_chunksize=1 << 16):
        sizes = pc.binary_length(batch["word"]).to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(batch["word"].to_pylist()), np.uint8)
        ends = np.cumsum(sizes)
        codes.append(np.stack(hashes(data, ends - sizes, ends)))
        lengths.append(pc.list_value_length(batch["ids"]).to_numpy().astype(np.uint8))
        ids.append(batch["ids"].flatten().to_numpy().astype(np.int32))
    both = np.concatenate([np.empty((2, 0), np.uint64), *codes], axis=1)
    nothing = np.empty(0, np.int32)
    return (
        WordPlaces(both[0].copy(), both[1].copy()),
        np.concatenate([nothing.astype(np.uint8), *lengths]),
        np.concatenate([nothing, *ids]),
    )


def encode(
    spark: SparkSession,
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str = PATTERN,
    most: int = FREQUENT,
    digest: bool = False,
) -> DataFrame:
    """(doc_id, ids) per document; ids is an array of int. With ``digest`` also ids_sha256, of the
    decimal ids joined by one space.

    docs: doc_id and text; other columns are ignored. Null and empty texts have no ids; null and
    repeated ids are rows like any other.
    """
    buckets = rank_buckets(ranks)
    path, split = scratch_path(spark, "word-slices"), split_texts(docs, pattern)
    split.write.option("compression", "zstd").parquet(path)
    split = spark.read.schema(split.schema).parquet(path)
    places, known_lengths, known_ids = frequent_words(split, buckets, most)
    shared_places = spark.sparkContext.broadcast((places.codes, places.checks, places.slots))
    shared_ids = spark.sparkContext.broadcast((known_lengths, known_ids))
    table = PairTable.of(ranks)
    all_ranks = spark.sparkContext.broadcast((ranks, table.top, table.first, table.keys, table.ranks))
    del places, known_lengths, known_ids, table
    release_memory()

    def fill_in(batches):
        hashes, places = WordHash(), WordPlaces(*shared_places.value)
        lengths, flat = shared_ids.value
        own_ranks, *fields = all_ranks.value
        pairs = PairTable(*fields)
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        digests = DecimalDigests(max(own_ranks.values(), default=0)) if digest else None
        for row in single_rows(batches):
            words = row["words"][0].values.cast(pa.binary())
            sizes = pc.binary_length(words).to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            data = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
            at = places(*hashes(data, ends - sizes, ends))
            # The ids of the slice's own words follow those of the shared list.
            new = at < 0
            own_n, own_flat = merged_words(
                words.take(pa.array(np.flatnonzero(new))).to_pylist(), own_ranks, pairs
            )
            n, first = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            n[~new], first[~new] = lengths[at[~new]], starts[at[~new]]
            n[new], first[new] = own_n, np.cumsum(own_n) - own_n
            codes = unpacked_codes(row["codes"][0].as_py())
            ends = np.cumsum(row["counts"][0].values.to_numpy(), dtype=np.int64)
            ids_of = row["doc_id"][0].values
            for i in range(0, len(ends), OUTPUT_ROWS):
                last = ends[i : i + OUTPUT_ROWS]
                begin = ends[i - 1] if i else 0
                part = codes[begin : last[-1]]
                size = n[part]
                after = np.cumsum(size)
                place = np.repeat(first[part] - (after - size), size) + np.arange(size.sum())
                mine, out = np.repeat(new[part], size), np.empty(len(place), np.int32)
                out[~mine], out[mine] = flat[place[~mine]], own_flat[place[mine]]
                cuts = np.concatenate([[0], after])[np.concatenate([[0], last - begin])]
                told = {
                    "doc_id": ids_of.slice(i, OUTPUT_ROWS),
                    "ids": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(out)),
                }
                if digests:
                    told["ids_sha256"] = pa.array(digests(out, cuts), pa.string())
                yield pa.record_batch(told)
        release_memory()

    kind = docs.schema["doc_id"].dataType.simpleString()
    told = f"doc_id {kind}, ids array<int>" + (", ids_sha256 string" if digest else "")
    return split.select("doc_id", "counts", "words", "codes").mapInArrow(fill_in, told)


class DecimalDigests:
    """SHA-256 of decimal numbers joined by a space, for many rows at a time."""

    def __init__(self, largest: int):
        texts = [b"%d " % i for i in range(largest + 1)]
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        width = int(self.sizes.max())
        self.table = np.frombuffer(b"".join(t.ljust(width) for t in texts), np.uint8).reshape(-1, width)
        self.inside = np.arange(width) < self.sizes[:, None]

    def __call__(self, numbers: np.ndarray, cuts: np.ndarray) -> list[str]:
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            row = numbers[a:b]
            text = self.table[row][self.inside[row]].tobytes()[:-1]
            out.append(hashlib.sha256(text).hexdigest())
        return out


def single_rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def decode(ids: Column, pieces: Column) -> Column:
    """The bytes of an array of ids: the binary pieces, one after the other."""
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""), "ISO-8859-1")
