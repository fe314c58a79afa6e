"""Repeated windows of tokens across a corpus, found in bounded buckets.

Windows of ``k`` tokens that are equal have the same minimiser, so windows meet where
their minimisers do.  Consecutive windows that share one travel together as a
super-k-mer: the packed string that covers them.  Three steps keep the data small:

1. Documents are dealt to blocks by a hash.  Each block tells which minimisers it has;
   only those that occur twice in the corpus go on.
2. Each block packs the super-k-mers of those minimisers, merges equal ones, and sends
   the first of each to the bucket of its minimiser.
3. Each bucket merges equal super-k-mers of different blocks, searches those that meet
   another one of their minimiser, and the blocks gather the answers.

A block or bucket holds a bounded share of the text, since their number follows the
size of the table.  A passage that stands in a third of all documents comes from each
block once.  The documents are shuffled once; Spark reuses that exchange in each step.

At the edges of such a passage each super-k-mer holds the text around it, so they all
differ and would fill one bucket.  A minimiser with more text than a bucket should hold
is hot: its windows travel one by one, keyed by the hash of the whole window, and only
those whose hash occurs twice.  Buckets compare them as strings like all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.llm.textarrays import BYTE_HASH, gram_hashes, mix, super_kmers, utf8, word_hashes, words_of
from lorespan.operators.ordering import number_rows

BLOCK_BYTES = 2 * 1024 * 1024
#: Tokens hashed at a time.
SEGMENT = 1 << 18
#: Of the wanted hashes of a block: minimisers, whole windows, hot minimisers.
PLAIN, WINDOW, HOT = 0, 1, 2
NULL_KEY = -(1 << 63)
RUNS = "kind byte, hash long, block long, key long, row int, start long, n long, packed binary, more binary"
SPANS = "block long, key long, row int, start long, n long"


class ByteTokens:
    """A text column as bytes."""

    same_document = True
    width = 1

    def __init__(self, column):
        self.data, self.offsets = utf8(column)
        self.byte_offsets = self.offsets

    def hashes(self, a: int, b: int) -> np.ndarray:
        return BYTE_HASH[self.data[a:b]]

    def packed(self, a: int, b: int) -> bytes:
        return self.data[a:b].tobytes()

    def without(self, row: int, covered: np.ndarray) -> bytes:
        return self.data[self.offsets[row]:self.offsets[row + 1]][~covered].tobytes()


class WordTokens:
    """A column of words parted by one space."""

    same_document = False
    #: About as many bytes has a token.
    width = 8

    def __init__(self, column):
        self.data, self.byte_offsets = utf8(column)
        self.starts, self.ends, self.offsets = words_of(self.data, self.byte_offsets)
        self._hashes = word_hashes(self.data, self.starts, self.ends)

    def hashes(self, a: int, b: int) -> np.ndarray:
        return self._hashes[a:b]

    def packed(self, a: int, b: int) -> bytes:
        return self.data[self.starts[a]:self.ends[b - 1]].tobytes()

    def without(self, row: int, covered: np.ndarray) -> bytes:
        words = self.data[self.byte_offsets[row]:self.byte_offsets[row + 1]].tobytes().split(b" ")
        return b" ".join([w for w, gone in zip(words, covered.tolist()) if not gone])


def runs_of(tokens, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, window after the last, minimiser, and a mark of both ends of each super-k-mer of a block."""
    total = int(tokens.offsets[-1])
    out = []
    for a in range(0, total, SEGMENT):
        b = min(total, a + SEGMENT + k - 1)
        inside = tokens.offsets[np.searchsorted(tokens.offsets, a, "right") - 1:np.searchsorted(tokens.offsets, b, "left") + 1]
        edges = np.clip(inside - a, 0, b - a)
        grams = gram_hashes(tokens.hashes(a, b), m)
        starts, ends, least = super_kmers(grams, edges, k, m)
        marks = mix(grams[starts]) ^ grams[ends - 1 + k - m] if len(starts) else np.zeros(0, np.uint64)
        out.append((starts + a, ends + a, least, marks))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def windows_of(tokens, starts: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every single window of some super-k-mers."""
    n = ends - starts
    places = np.arange(n.sum()) + np.repeat(starts - np.append(0, np.cumsum(n)[:-1])[:len(n)], n)
    hashes, total = np.zeros(len(places), np.uint64), int(tokens.offsets[-1])
    for a in range(0, total, SEGMENT):
        here = np.flatnonzero((places >= a) & (places < a + SEGMENT))
        if len(here):
            hashes[here] = gram_hashes(tokens.hashes(a, min(total, a + SEGMENT + k - 1)), k)[places[here] - a]
    return places, hashes


def _among(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the hashes are wanted ones."""
    if not len(wanted):
        return np.zeros(0, np.int64)
    wanted = np.sort(wanted)
    return np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes)


def _counts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the hashes, the first place of each in it, and how many there are."""
    order = np.argsort(hashes, kind="stable")
    least = hashes[order]
    fresh = np.flatnonzero(np.append(True, least[1:] != least[:-1])) if len(least) else np.zeros(0, np.int64)
    return order, fresh, np.diff(np.append(fresh, len(least)))


def _ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The documents of a block in order, with their keys and the number of each among equal keys."""
    keys = table.column("key").to_numpy()
    order = np.argsort(keys, kind="stable")
    if len(np.unique(keys)) < len(keys):
        texts = table.column("text").to_pylist()
        order = np.array(sorted(range(len(keys)), key=lambda i: (keys[i], texts[i] or "")))
    keys = keys[order]
    fresh = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    place = np.arange(len(keys))
    return table.take(pa.array(order)), keys, place - np.maximum.accumulate(np.where(fresh, place, 0))


def _local_step(make, k: int, m: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in range(9)]
        if left.num_rows and right.num_rows:
            block = left.column("block")[0].as_py()
            table, keys, rows = _ordered(left)
            tokens = make(table.column("text"))
            starts, ends, least, _ = runs_of(tokens, k, m)
            wanted, sort = right.column("hash").to_numpy().view(np.uint64), right.column("sort").to_numpy()
            chosen, hot = _among(least, wanted[sort == PLAIN]), _among(least, wanted[sort == HOT])
            single, whole = windows_of(tokens, starts[hot], ends[hot], k)
            again = _among(whole, wanted[sort == WINDOW])
            starts, ends = np.append(starts[chosen], single[again]), np.append(ends[chosen], single[again] + 1)
            minimiser = np.append(least[chosen], whole[again])
            order = np.argsort(starts, kind="stable")
            starts, ends, minimiser = starts[order], ends[order], minimiser[order]
            row = np.searchsorted(tokens.offsets, starts, "right") - 1
            first: dict[bytes, int] = {}
            packed, kind = [], np.zeros(len(starts), np.int8)
            key_of, begin = keys[row], starts - tokens.offsets[row]
            more: dict[int, list[int]] = {}
            for i, (a, b) in enumerate(zip(starts.tolist(), (ends + k - 1).tolist())):
                s = tokens.packed(a, b)
                j = first.setdefault(s, i)
                if j != i:
                    s = None
                    if tokens.same_document or key_of[j] < key_of[i]:
                        kind[i] = 1
                    else:  # once more under the same id: goes along with the first; no id is smaller than none
                        kind[i] = 2
                        if key_of[i] != NULL_KEY:
                            more.setdefault(j, []).extend((int(rows[row[i]]), int(begin[i])))
                packed.append(s)
            # What is decided already needs no meeting place: runs that go on in the next one
            # become one row, and a block's rows go to one bucket.
            done = np.flatnonzero(kind == 1)
            on = np.append(False, (done[1:] == done[:-1] + 1) & (row[done[1:]] == row[done[:-1]])
                           & (starts[done[1:]] == ends[done[:-1]]))[:len(done)]
            heads = np.flatnonzero(~on)
            lasts = np.append(heads[1:], len(done))[:len(heads)] - 1
            ends[done[heads]] = ends[done[lasts]]
            kind[done[on]] = 2
            minimiser[done] = mix(np.array([block], np.uint64))[0]
            sent = np.flatnonzero(kind < 2)
            also = [np.array(more[i], np.int64).tobytes() if i in more else None for i in sent.tolist()]
            out = [kind[sent], minimiser[sent].view(np.int64), np.full(len(sent), block), key_of[sent], rows[row][sent].astype(np.int32),
                   begin[sent], (ends - starts)[sent], pa.array([packed[i] for i in sent.tolist()], pa.binary()), also]
        return pa.table([pa.array(x, t) if isinstance(x, list) else pa.array(x) for x, t in zip(out, (
            pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
            names=["kind", "hash", "block", "key", "row", "start", "n", "packed", "more"])
    return run


def _bucket_step(find: Callable, same_document: bool):
    """``find(strings, keys)`` gives, for each distinct string, its repeated windows as ``(first, n)``."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("row", "ascending"), ("start", "ascending")])
        kind, key, start, n = (table.column(c).to_numpy() for c in ("kind", "key", "start", "n"))
        packed, more = table.column("packed").to_pylist(), table.column("more").to_pylist()
        number = table.column("row").to_numpy()
        places_of = [[(r, a), *map(tuple, np.frombuffer(b, np.int64).reshape(-1, 2).tolist())] if b else [(r, a)]
                     for r, a, b in zip(number.tolist(), start.tolist(), more)]
        first: dict[bytes, int] = {}
        taken, owner, begin, count = [], [], [], []
        followers: dict[int, list[int]] = {}
        for i, s in enumerate(packed):
            if kind[i]:
                repeat = True
            else:
                j = first.setdefault(s, i)
                repeat = j != i and (same_document or key[j] < key[i])
                if j != i and not repeat:
                    followers.setdefault(j, []).append(i)
            if repeat:
                for r, at in places_of[i]:
                    taken.append(i), owner.append(r), begin.append(at), count.append(int(n[i]))
        # Only strings that meet another one of their minimiser can share a window with it.
        places = np.array(list(first.values()), np.int64)
        minimiser = table.column("hash").to_numpy()[places]
        _, group, size = np.unique(minimiser, return_inverse=True, return_counts=True)
        places = places[size[group] > 1].tolist()
        strings = [packed[i] for i in places]
        for i, spans in zip(places, find(strings, key[places] if places else key[:0])):
            for a, c in spans:
                for j in (i, *followers.get(i, ())):
                    for r, at in places_of[j]:
                        taken.append(j), owner.append(r), begin.append(at + a), count.append(c)
        rows = table.select(["block", "key"]).take(pa.array(taken, pa.int64()))
        for name, values, kind in (("row", owner, pa.int32()), ("start", begin, pa.int64()), ("n", count, pa.int64())):
            rows = rows.append_column(name, pa.array(values, kind))
        return rows
    return run


def _gather_step(make, k: int, with_kept: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        table, keys, rows = _ordered(left)
        tokens = make(table.column("text"))
        n = len(keys)
        sizes = np.diff(tokens.offsets)
        removed, spans = np.zeros(n, np.int64), np.zeros(n, np.int64)
        kept: dict[int, bytes] = {}
        if right.num_rows:
            number = {(a, b): i for i, (a, b) in enumerate(zip(keys.tolist(), rows.tolist()))}
            owner = np.array([number[a, b] for a, b in zip(right.column("key").to_pylist(), right.column("row").to_pylist())])
            start, count = right.column("start").to_numpy(), right.column("n").to_numpy()
            order = np.argsort(owner, kind="stable")
            owner, start, stop = owner[order], start[order], (start + count + k - 1)[order]
            cuts = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(owner))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                i = int(owner[a])
                edge = np.zeros(sizes[i] + 1, np.int32)
                np.add.at(edge, start[a:b], 1)
                np.add.at(edge, stop[a:b], -1)
                covered = np.cumsum(edge[:-1]) > 0
                removed[i] = covered.sum()
                spans[i] = covered[0] + np.sum(covered[1:] & ~covered[:-1])
                kept[i] = tokens.without(i, covered)
        buffer, edges = tokens.data.tobytes(), tokens.byte_offsets.tolist()
        texts = [kept[i] if i in kept else buffer[edges[i]:edges[i + 1]] for i in range(n)]
        columns = [table.column("doc_id"), pa.array(sizes), pa.array(removed), pa.array(spans),
                   pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
        names = ["doc_id", "size", "n_removed", "n_spans", "kept_sha256"]
        if with_kept:
            columns.append(pa.array(texts, pa.binary()))
            names.append("kept")
        return pa.table(columns, names=names)
    return run


def remove_repeats(docs: DataFrame, text: Column, make, find: Callable, k: int, m: int,
                   with_kept: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, size, n_removed, n_spans, kept_sha256`` (and ``kept``) of each document."""
    size, nameless = docs.agg(F.sum(F.octet_length("text")), F.count_if(F.col("doc_id").cast("long").isNull())).first()
    parts = (size or 0) // block_bytes + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    base = rows.select("doc_id", F.coalesce("doc_id", F.lit(NULL_KEY)).alias("key"), "text", F.col("doc_id").alias("_deal"))
    if nameless:
        # Rows without an id are dealt by their number in the order of the texts, which for bytes is their order too.
        named = number_rows(rows.where("doc_id is null").withColumn("_tie", F.monotonically_increasing_id()), "_n", ["text", "_tie"])
        key = F.lit(NULL_KEY) + (F.col("_n") if make.same_document else F.lit(0))
        base = base.where("doc_id is not null").unionByName(named.select("doc_id", key.cast("long").alias("key"), "text", F.col("_n").alias("_deal")))
    base = base.withColumn("block", F.pmod(F.xxhash64("_deal"), F.lit(parts))).drop("_deal")

    def tell(table: pa.Table) -> pa.Table:
        _, _, least, marks = runs_of(make(table.column("text")), k, m)
        order, fresh, count = _counts(least)
        block = table.column("block")[0].as_py()
        # Block and mark (of 16 bits) in one, so that both readers need the same columns and share one exchange.
        place = block << 16 | (marks[order][fresh] >> np.uint64(48)).astype(np.int64)
        return pa.table([pa.array(least[order][fresh].view(np.int64)), pa.array(place), pa.array(count.astype(np.int64))],
                        names=["hash", "place", "n"])

    def tell_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        whole = np.zeros(0, np.uint64)
        if left.num_rows and right.num_rows:
            tokens = make(left.column("text"))
            starts, ends, least, _ = runs_of(tokens, k, m)
            hot = _among(least, right.column("hash").to_numpy().view(np.uint64))
            whole = windows_of(tokens, starts[hot], ends[hot], k)[1]
        order, fresh, count = _counts(whole)
        block = left.column("block")[0].as_py() if left.num_rows else 0
        return pa.table([pa.array(whole[order][fresh].view(np.int64)), pa.array(np.full(len(fresh), block)),
                         pa.array(np.minimum(count, 2).astype(np.int8))], names=["hash", "block", "n"])

    # A minimiser is hot when its strings exceed two blocks; of each block one is marked, to tell how many are equal.
    most = 2 * block_bytes / (2 * k * make.width)
    told = base.groupBy("block").applyInArrow(tell, "hash long, place long, n long").where("hash is not null")
    told = told.selectExpr("hash", "place", "sum(n) over (partition by hash) as total").where("total > 1")
    hot = (told.where(F.col("total") > most).groupBy("hash").agg(
        (F.max("total") * F.count_distinct(F.expr("place & 65535")) / F.count("place")).alias("strings")).where(F.col("strings") > most).select("hash", F.lit(HOT).alias("sort")))
    twice = told.join(hot, "hash", "left").select("hash", F.shiftright("place", 16).alias("block"), F.coalesce("sort", F.lit(PLAIN)).cast("byte").alias("sort"))
    single = base.groupBy("block").cogroup(twice.where(F.col("sort") == HOT).groupBy("block")).applyInArrow(tell_windows, "hash long, block long, n byte")
    single = single.selectExpr("hash", "block", "sum(n) over (partition by hash) as total").where("total > 1").select(
        "hash", "block", F.lit(WINDOW).cast("byte").alias("sort"))
    runs = base.groupBy("block").cogroup(twice.unionByName(single).groupBy("block")).applyInArrow(_local_step(make, k, m), RUNS)
    spans = runs.groupBy(F.pmod("hash", F.lit(parts))).applyInArrow(_bucket_step(find, make.same_document), SPANS)
    schema = "doc_id long, size long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return base.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_gather_step(make, k, with_kept), schema)
