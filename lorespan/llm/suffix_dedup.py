"""Exact substring dedup over bytes: threshold-bounded interval expansion on a BWT.

Equal strings of ``k`` bytes meet in a bucket (see ``superkmers``).  There the packed
strings form one text, whose Burrows-Wheeler transform is expanded breadth first:
the interval of a string is extended backward by every byte before it, and the right
end of a new interval gets the common-prefix length of its level.  Levels give the
lengths in increasing order, so expansion stops at ``k`` - 1: suffixes whose borders
are then still open share ``k`` bytes or more with their neighbour.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm.superkmers import ByteTokens, remove_repeats

LENGTH = 100
#: Bytes of a minimiser.
MINIMISER = 32


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by prefix doubling; every 0 is a separator of its own, below all others."""
    n = len(symbols)
    stops = np.flatnonzero(symbols == 0)
    after = np.searchsorted(stops, np.arange(n))  # the separator that ends each suffix's string
    width = 7
    key = np.zeros(n, np.uint64)
    open_ = np.ones(n, bool)
    padded = np.append(symbols, np.zeros(width, symbols.dtype)).astype(np.uint64)
    for j in range(width):
        now = padded[j:j + n]
        open_ &= now > 0
        key = key << np.uint64(9) | np.where(open_, now, 0).astype(np.uint64)
    # Strings that end within the first symbols differ by their separators.
    tie = np.where(open_, 0, after + 1).astype(np.uint64)
    order = np.lexsort((tie, key))
    key, tie = key[order], tie[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (tie[1:] != tie[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(fresh) - 1
    while rank.max() < n - 1:
        second = np.zeros(n, np.int64)
        second[:-width] = rank[width:] + 1
        pair = rank * (n + 1) + second
        order = np.argsort(pair, kind="quicksort")
        pair = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(True, pair[1:] != pair[:-1])) - 1
        width *= 2
        if width >= n:
            break
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, rank


def open_borders(symbols: np.ndarray, order: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Whether the suffix at each place of the order shares ``k`` symbols with the one before."""
    n = len(symbols)
    n_stops = int(np.count_nonzero(symbols == 0))
    before = np.append(symbols, 0)[order - 1] if n else symbols
    before = np.where(order == 0, 0, before)  # the transform
    back = rank[order - 1]
    front = symbols[order]
    forth = rank[(order + 1) % n]
    low, high = np.maximum(back - 1, 0), np.minimum(back + 1, n - 1)
    left = np.where((back > 0) & (front[low] == before), forth[low], -1).astype(np.int32)
    right = np.where((back < n - 1) & (front[high] == before), forth[high], n).astype(np.int32)
    back = back.astype(np.int32)
    closed = np.zeros(n + 1, bool)
    closed[0] = closed[n] = True
    begin, end = np.array([0]), np.array([n])
    for level in range(k):
        size = end - begin
        owner = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(owner)) + np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size)
        real = before[place] > 0
        place, owner = place[real], owner[real]
        firsts = place[left[place] < begin[owner]]
        lasts = place[right[place] >= end[owner]]
        begin = np.sort(back[firsts]).astype(np.int64)
        end = np.sort(back[lasts]).astype(np.int64) + 1
        if level == 0:
            stops = np.arange(n_stops)
            begin, end = np.append(stops, begin), np.append(stops + 1, end)
        fresh = ~closed[end]
        begin, end = begin[fresh], end[fresh]
        closed[end] = True
        if not len(begin):
            break
    return ~closed[:n]


def repeated_starts(strings: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each string in their concatenation, and where a ``k``-byte string starts that occurred before."""
    lengths = np.array([len(s) + 1 for s in strings], np.int64)
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    symbols = text.astype(np.uint16) + 1
    symbols[np.cumsum(lengths) - 1] = 0
    order, rank = suffix_order(symbols)
    shared = open_borders(symbols, order, rank, k)
    groups = np.flatnonzero(~shared)
    least = np.repeat(np.minimum.reduceat(order, groups), np.diff(np.append(groups, len(order))))
    repeated = np.zeros(len(symbols), bool)
    repeated[order[order != least]] = True
    return np.append(0, np.cumsum(lengths)[:-1]), repeated


def _find(k: int):
    def find(strings, keys):
        if not strings:
            return []
        begins, repeated = repeated_starts(strings, k)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], repeated.view(np.int8), [0]])))
        out = [[] for _ in strings]
        first, last = edges[::2], edges[1::2]
        owner = np.searchsorted(begins, first, "right") - 1
        for a, b, i in zip(first.tolist(), last.tolist(), owner.tolist()):
            out[i].append((a - int(begins[i]), b - a))
        return out
    return find


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, with_kept: bool = False) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that starts earlier in the corpus.

    Earlier is a smaller ``doc_id`` or the same document and an earlier start; null ids
    come first, and rows with one id are ordered by text.  Strings are judged on the
    input.  ``kept`` has the remaining bytes, which may cut a character.  Null text is
    empty; texts shorter than ``length`` stay whole; other columns are ignored; an
    empty table gives no row.
    """
    m = min(MINIMISER, max(1, length // 2))
    out = remove_repeats(docs, F.col("text"), ByteTokens, _find(length), length, m, with_kept)
    return out.withColumnRenamed("size", "n_bytes")
