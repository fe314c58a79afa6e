"""Repeated word windows by super-k-mer partitioning.

Consecutive windows with one minimiser travel as one packed string to the bucket of the
minimiser (see ``superkmers``); in the bucket, sorting counts the windows exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm.superkmers import WordTokens, remove_repeats

WINDOW = 50
#: Words of a minimiser.
MINIMISER = 8
BLANKS = r"[\x20\x09-\x0D]+"


def window_ranks(words: np.ndarray, k: int) -> np.ndarray:
    """Equal numbers for equal windows of ``k`` numbers: windows are sorted by halves, so no hash decides."""
    rank, width, out, covered = words.astype(np.int64), 1, None, 0
    bits = k
    while bits:
        if bits & 1:
            if out is None:
                out, covered = rank, width
            else:
                n = len(words) - covered - width + 1
                out = _renumber(out[:n], rank[covered:covered + n])
                covered += width
        bits >>= 1
        if bits:
            n = len(rank) - width
            rank = _renumber(rank[:n], rank[width:])
            width *= 2
    return out


def _renumber(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pair = a * (int(b.max(initial=0)) + 1) + b
    order = np.argsort(pair, kind="quicksort")
    pair = pair[order]
    out = np.empty(len(pair), np.int64)
    out[order] = np.cumsum(np.append(True, pair[1:] != pair[:-1])[:len(pair)]) - 1
    return out


def _find(k: int):
    def find(strings, keys):
        """The windows of each string that also start in a document with a smaller key."""
        if not strings:
            return []
        known: dict[bytes, int] = {}
        words, lengths = [], []
        for s in strings:
            row = [known.setdefault(w, len(known)) for w in s.split(b" ")]
            words += row
            lengths.append(len(row))
        lengths = np.array(lengths, np.int64)
        begins = np.append(0, np.cumsum(lengths)[:-1])
        rank = window_ranks(np.array(words, np.int64), k)
        owner = np.repeat(np.arange(len(strings)), lengths)[:len(rank)]
        within = np.arange(len(rank)) - begins[owner]
        valid = np.flatnonzero(within <= lengths[owner] - k)
        rank, owner, within = rank[valid], owner[valid], within[valid]
        order = np.argsort(rank, kind="stable")
        groups = np.flatnonzero(np.append(True, np.diff(rank[order]) > 0))
        least = np.minimum.reduceat(keys[owner[order]], groups)
        repeated = np.zeros(len(rank), bool)
        repeated[order] = np.repeat(least, np.diff(np.append(groups, len(order)))) < keys[owner[order]]
        out = [[] for _ in strings]
        at = np.flatnonzero(repeated)
        if len(at):
            breaks = np.append(True, (np.diff(at) > 1) | (np.diff(owner[at]) > 0))
            cuts = np.append(np.flatnonzero(breaks), len(at))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                out[owner[at[a]]].append((int(within[at[a]]), b - a))
        return out
    return find


def remove_repeated_windows(docs: DataFrame, words: int = WINDOW, with_kept: bool = False) -> DataFrame:
    """Remove every word covered by a window of ``words`` words that also starts in a document with a smaller id.

    Windows are judged on the input; repeats within one document, or within rows with
    one id, stay.  ``kept`` has the kept words with one space between.  Null ids come
    first; null or wordless text has no words; shorter texts stay whole; other columns
    are ignored; an empty table gives no row.
    """
    spaced = F.trim(F.regexp_replace("text", BLANKS, " "))
    m = min(MINIMISER, max(1, words // 2))
    out = remove_repeats(docs, spaced, WordTokens, _find(words), words, m, with_kept)
    return out.withColumnRenamed("size", "n_words")
