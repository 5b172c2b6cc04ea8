"""Suffix arrays of one shard in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np

WORD = 8


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number that sorts like them, zeros past the end."""
    padded = np.concatenate([data, np.zeros(WORD, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for j in range(WORD):
        out = out << np.uint64(8) | padded[j : j + len(data)]
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions in the order of the suffixes that start there.

    Positions start out sorted by eight bytes; each round sorts the groups that are still equal by
    the rank of what follows, which doubles the sorted length. Groups of one are left alone.
    """
    n = len(data)
    words = _words(data)
    order = np.argsort(words, kind="stable")
    new = np.diff(words[order], prepend=words[order[:1]]) != 0
    # The rank of a group is the place of its last member; beyond the end lies rank 0.
    rank = np.zeros(n + 1, np.int64)
    rank[order] = _group_ends(new) + 1
    length = WORD
    places = np.arange(n)
    while length < n:
        ends = rank[order[places]] - 1
        size = np.bincount(ends, minlength=n)[ends] if len(ends) else ends
        places = places[size > 1]
        if not len(places):
            break
        members = order[places]
        follow = np.minimum(members + length, n)
        group = np.cumsum(np.diff(rank[members], prepend=rank[members[:1]]) != 0)
        key = group.astype(np.uint64) * np.uint64(n + 1) + rank[follow].astype(np.uint64)
        by_key = np.argsort(key, kind="stable")
        order[places] = members[by_key]
        key = key[by_key]
        # A group's members lie side by side, so its last place is that of its last member.
        last = np.append(key[1:] != key[:-1], True)
        at = np.flatnonzero(last)
        rank[order[places]] = places[at[np.searchsorted(at, np.arange(len(places)))]] + 1
        length *= 2
    return order


def _group_ends(new: np.ndarray) -> np.ndarray:
    """Per place the last place of its group; ``new`` marks the first ones."""
    starts = np.flatnonzero(new)
    starts = np.concatenate([[0], starts]) if not len(starts) or starts[0] else starts
    ends = np.append(starts[1:], len(new)) - 1
    return np.repeat(ends, np.diff(np.append(starts, len(new))))


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Per place of the suffix array the length shared with the place before.

    Kasai's rule, that the suffix one position later shares at most one byte less, in its permuted
    form: only positions preceded by different bytes are compared, the others follow from them.
    """
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    position = np.arange(n)
    previous = np.where(position > 0, data[position - 1], 0).astype(np.int64)
    previous_other = np.where(before > 0, data[before - 1], 256)
    compare = (before >= 0) & ((position == 0) | (before <= 0) | (previous != previous_other))
    words = np.concatenate([_words(data), np.zeros(1, np.uint64)])
    at = np.flatnonzero(compare)
    other = before[at]
    shared = np.zeros(len(at), np.int64)
    alive, step = np.arange(len(at)), 0
    while len(alive):
        a, b = np.minimum(at[alive] + step, n), np.minimum(other[alive] + step, n)
        x = words[a] ^ words[b]
        same = x == 0
        # Equal leading bytes of the first word that differs.
        shared[alive[~same]] = step + _equal_bytes(x[~same])
        shared[alive[same]] = step + WORD
        step += WORD
        alive = alive[same & (np.maximum(a, b) < n)]
    shared = np.minimum(shared, n - np.maximum(at, other))
    reach = np.zeros(n, np.int64)
    reach[at] = shared + at
    lengths = np.maximum(np.maximum.accumulate(reach) - position, 0)
    lengths[before < 0] = 0
    return lengths[order]


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for j in range(1, WORD):
        out += x < np.uint64(1) << np.uint64(64 - 8 * j)
    return out
