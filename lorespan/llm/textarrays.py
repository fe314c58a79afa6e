"""Arrow string columns as numpy arrays: bytes, words, hashes and sliding minima."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


BYTE_HASH = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * BASE)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, most: int):
    """Consecutive row ranges of about ``most`` bytes, or one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1))
        yield a, b
        a = b


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word in a column whose words are parted by one
    space (no space at either end), and the offset of each row in words."""
    n = len(offsets) - 1
    filled = np.flatnonzero(np.diff(offsets) > 0)
    spaces = np.flatnonzero(data == 32)
    starts = np.sort(np.concatenate([offsets[filled], spaces + 1]))
    ends = np.sort(np.concatenate([offsets[filled + 1], spaces]))
    counts = np.zeros(n, np.int64)
    if len(starts):
        counts[filled] = np.diff(np.append(np.searchsorted(starts, offsets[filled]), len(starts)))
    return starts, ends, np.concatenate([[0], np.cumsum(counts)])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    out = np.empty(len(starts), np.uint64)
    step = 1 << 16
    for a in range(0, len(starts), step):
        s, e, size = starts[a:a + step], ends[a:a + step], lengths[a:a + step]
        low = s[0]
        place = np.arange(e[-1] - low) - np.repeat(s - low, np.diff(np.append(s, e[-1])))
        power = np.cumprod(np.full(max(1, int(place.max(initial=0)) + 1), BASE))
        terms = BYTE_HASH[data[low:e[-1]]] * power[place]
        # The space after a word does not count.
        gaps = (e[:-1] - low)[s[1:] > e[:-1]]
        terms[gaps] = 0
        out[a:a + step] = np.add.reduceat(terms, s - low) + size.astype(np.uint64)
    return mix(out)


def gram_hashes(tokens: np.ndarray, m: int) -> np.ndarray:
    """A hash of every m consecutive token hashes."""
    if len(tokens) < m:
        return np.zeros(0, np.uint64)
    power, done, out = tokens, 1, None
    grown, factor, covered = None, None, 0
    # Doubling: the hash of 2^j tokens from two of 2^(j-1).
    base = BASE
    while done <= m:
        if m & done:
            if grown is None:
                grown, covered = power, done
            else:
                n = len(tokens) - covered - done + 1
                shift = np.uint64(pow(int(BASE), done, 1 << 64))
                grown = grown[:n] * shift + power[covered:covered + n]
                covered += done
        n = len(tokens) - 2 * done + 1
        if n <= 0:
            break
        if done * 2 <= m:
            power = power[:n] * base + power[done:done + n]
        base = np.uint64(pow(int(base), 2, 1 << 64))
        done *= 2
    return mix(grown[:len(tokens) - m + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


#: Low bits of a minimiser's rank that hold its place; so many grams are handled at a time.
PLACE_BITS = 20


def super_kmers(grams: np.ndarray, offsets: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of ``k`` tokens that have their minimiser in one place.

    ``grams`` are the hashes of ``m`` tokens, ``offsets`` the rows in tokens.
    Gives the first window, the window after the last, and the minimiser's hash of
    each run; a run never leaves its row.  The minimiser is the gram of the least
    rank, the leftmost of equals, so equal windows are never in one run.
    """
    if len(grams) >> PLACE_BITS:
        raise ValueError("too many tokens at a time")
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_min(grams & ~place | np.arange(len(grams), dtype=np.uint64), k - m + 1)
    n = len(least)
    valid = np.zeros(n + 1, bool)
    first, last = offsets[:-1], offsets[1:] - k + 1
    filled = last > first
    edge = np.zeros(n + 2, np.int8)
    edge[first[filled]] += 1
    edge[last[filled]] -= 1
    valid[:n] = np.cumsum(edge[:n], dtype=np.int8) > 0
    change = np.ones(n, bool)
    if n > 1:
        change[1:] = (least[1:] != least[:-1]) | ~valid[:n - 1]
    starts = np.flatnonzero(valid[:n] & change)
    ends = np.flatnonzero(valid[:n] & (np.append(change[1:], True) | ~valid[1:])) + 1
    return starts, ends, grams[(least[starts] & place).astype(np.int64)]
