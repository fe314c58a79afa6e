"""Nearest neighbours by weighted inverted lists: exact, for vectors with few entries that count.

Every vector is scaled to length one and its entries are put in one order for all,
rarest coordinate first.  An entry goes to the list of its coordinate together with
the length of what follows it.  Two vectors whose first common coordinate is ``c``
have at most the product of their entries at ``c`` plus the product of the lengths
of what follows, so a list brings together only rows for which this reaches what the
query still needs, and for which a bound of the whole product allows it too: that of
the ``ALONE`` commonest coordinates as they are and of the lengths of ``PARTS`` parts of
the others, as part by part a product of vectors is at most that of their lengths.  What
a query needs is the threshold, or the ``k``-th best score it has found so far.  Lists are made in a task, of the rows it holds: few queries
travel to the items, of many each fragment meets each fragment of the items.  Pairs
are scored where they meet and only the best of each query leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespan.fixed_values import TOP_K
from lorespan.operators.ordering import keep_first
from lorespan.operators.similarity import (CELL_BYTES, SCORE_DIGITS, _Best, _cells, _emit,
                                           _lowest_copies, _same_direction, _top, _unit_rows, _usable, _whole,
                                           exact_scores, vector_width)
from lorespan.session import cut_lineage

#: More than scores lose by rounding.
SLACK = 2 * 10.0 ** -SCORE_DIGITS
#: Commonest coordinates that stand in a bound as they are, parts of the others whose
#: lengths do, and more than such a bound loses by rounding to single precision.
ALONE, PARTS, BOUND_SLACK = 32, 32, 2e-5
#: Queries of up to this size travel to the items.
SHARED_BYTES = 4 * 1024 * 1024
#: Queries and items put in lists together, items whose bounds are made together, and pairs of entries that are
#: looked at together.
_BLOCK_QUERIES, _BLOCK_ITEMS, _BOUND_ITEMS, _ENTRY_PAIRS = 256, 4096, 1024, 1 << 20
_MARK = ["_h1", "_h2"]


def _list_lengths(items: DataFrame, width: int) -> list[int]:
    """Entries of each coordinate's list; one row of ``width`` numbers leaves a task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            rows = _unit_rows(_usable(batch).column("vec"))
            total[:rows.shape[1]] += np.count_nonzero(rows, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["place", "n"])

    counted = items.select("vec").mapInArrow(count, "place long, n long")
    lengths = dict(counted.groupBy("place").agg(F.sum("n")).collect())
    return [lengths.get(place, 0) for place in range(width)]


def _ordered(vectors: pa.Array, order: np.ndarray, signed: bool) -> np.ndarray:
    """Rows of length one with their entries in the order of the lists."""
    unit = _unit_rows(vectors, len(order))
    if unit.shape[1] > len(order):
        raise ValueError(f"vectors longer than width={len(order)}")
    if not signed and (unit < 0).any():
        raise ValueError("the best k of vectors with negative entries need knn")
    return unit[:, order]


class Lists:
    """Inverted lists of some rows: entries by place, with the length from each on and after it.

    Entries from which on less than ``floor`` is left are in no list.
    """

    def __init__(self, unit: np.ndarray, floor: float):
        self.unit = unit
        width = unit.shape[1]
        first = max(0, width - ALONE)
        ends = np.unique(np.arange(PARTS) * first // PARTS)
        self.parts = np.empty((len(unit), len(ends) * (first > 0) + width - first), np.float32)
        found = []
        for a in range(0, len(unit), _BLOCK_ITEMS):
            rows = unit[a:a + _BLOCK_ITEMS]
            squares = rows * rows
            reach = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])
            row, place = np.nonzero((rows != 0) & (reach >= floor - SLACK))
            found.append((row + a, place, reach[row, place]))
            bounds = self.parts[a:a + len(rows)]
            bounds[:, :width - first] = rows[:, first:]
            if first:
                # Lengths, rounded up.
                bounds[:, width - first:] = np.sqrt(np.add.reduceat(squares[:, :first], ends, axis=1)) * (1 + 1e-6)
        #: A bound that is not above this one is of a product of 0 or less.
        self.nothing = -BOUND_SLACK if (unit < 0).any() else 0.0
        self.row, place, reach = (np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip(
            (np.int64, np.int64, float), zip(*found) if found else [()] * 3))
        by_place = np.argsort(place, kind="stable")
        self.row, self.place, self.reach = self.row[by_place], place[by_place], reach[by_place]
        self.starts = np.searchsorted(self.place, np.arange(width + 1))
        self.weight = unit[self.row, self.place]
        self.rest = np.sqrt(np.maximum(self.reach ** 2 - self.weight ** 2, 0.0)) * (1 + 1e-6)

    def __len__(self):
        return len(self.unit)


def meet(wanted: Lists, items: Lists, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``(query row, item row)`` that meet in a list and may reach the query's ``need``.

    Where the lists hold about as many entries as there are pairs, the bounds of all
    pairs are made at once instead of entry by entry.
    """
    nothing = min(wanted.nothing, items.nothing)
    held = np.diff(items.starts)[wanted.place]
    live = (wanted.reach >= need[wanted.row] - SLACK) & (held > 0)
    if held[live].sum() > len(wanted) * len(items) / 4:
        for a in range(0, len(wanted), _BLOCK_QUERIES):
            least = (need[a:a + _BLOCK_QUERIES] - SLACK - BOUND_SLACK).astype(np.float32)
            for b in range(0, len(items), _BOUND_ITEMS):
                bound = wanted.parts[a:a + _BLOCK_QUERIES] @ items.parts[b:b + _BOUND_ITEMS].T
                some = np.flatnonzero(bound.max(axis=1) >= least)
                if len(some):
                    bound = bound[some]
                    row, col = np.divmod(np.flatnonzero((bound >= least[some, None]) & (bound > nothing)), bound.shape[1])
                    yield some[row] + a, col + b
        return
    at = np.flatnonzero(live)
    at = at[np.argsort(wanted.row[at], kind="stable")]
    ends = np.cumsum(held[at])
    start = 0
    while start < len(at):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + _ENTRY_PAIRS, side="right")))
        mine, n = at[start:stop], held[at[start:stop]]
        q = np.repeat(mine, n)
        i = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(items.starts[wanted.place[mine]], n)
        least = need[wanted.row[q]] - SLACK
        good = wanted.weight[q] * items.weight[i] + wanted.rest[q] * items.rest[i] >= least
        row, col, least = wanted.row[q[good]], items.row[i[good]], least[good]
        good = np.einsum("ij,ij->i", wanted.parts[row], items.parts[col]) >= least - BOUND_SLACK
        yield np.divmod(np.unique(row[good] * len(items) + col[good]), len(items))
        start = stop


def _search(best: _Best, wanted: Lists, items: Lists, ids: np.ndarray, threshold: float) -> None:
    """Score what meets; with no threshold the k-th best score so far is what a query needs."""
    for a in range(0, len(items), _BLOCK_ITEMS):
        block = items if len(items) <= _BLOCK_ITEMS else Lists(items.unit[a:a + _BLOCK_ITEMS], threshold)
        need = np.maximum(best.floor, threshold)
        for row, col in meet(wanted, block, need):
            score = exact_scores(wanted.unit, block.unit, row, col)
            good = (score >= need[row] - SLACK) & (score >= threshold) & (score > 0)
            if good.any():
                best.add(row[good], score[good], ids[a + col[good]])
        best.settle()


def _by_shared(items: DataFrame, asked: DataFrame, k: int, schema: T.StructType, order: np.ndarray,
               threshold: float, signed: bool) -> DataFrame:
    """Few queries travel to the items, which are put in lists where they are read."""
    table = _usable(asked.select(*_MARK, "vec").toArrow())
    shared = items.sparkSession.sparkContext.broadcast((table.select(_MARK), _ordered(table.column("vec"), order, signed)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        keys, unit = shared.value
        wanted, best, id_type = Lists(unit, threshold), _Best(k, len(unit)), None
        for batch in batches:
            batch = _usable(batch)
            if batch.num_rows:
                id_type = batch.column(0).type
                _search(best, wanted, Lists(_ordered(batch.column(1), order, signed), threshold),
                        batch.column(0).to_numpy(zero_copy_only=False), threshold)
        if id_type is not None:
            yield from _emit(best, keys, id_type, to_arrow_schema(schema)).to_batches()

    return items.select("item_id", "vec").mapInArrow(scan, schema)


def _scored(pairs: DataFrame, floor: float) -> DataFrame:
    """Of the scored pairs that leave the tasks those above 0 and not below the floor."""
    return pairs.where(F.col("score") >= floor).where("score > 0")


def _by_fragments(items: DataFrame, asked: DataFrame, k: int, schema: T.StructType, order: np.ndarray,
                  threshold: float, signed: bool, most: int) -> DataFrame:
    """Fragments of both sides meet in groups of bounded size, and only the best of a group leave it."""
    # Queries are put in lists whole, which with a threshold are short; items block by block.
    left, right = _cells(*_whole(items, asked, 2 * most, most * (2 if threshold > 0 else 1), most), _MARK)
    kind = items.schema["item_id"].dataType
    none = {c: F.lit(None).cast("long") for c in _MARK}
    both = left.withColumns(none).select("i", "q", "item_id", *_MARK, "vec", F.lit(True).alias("_item")).unionByName(
        right.select("i", "q", F.lit(None).cast(kind).alias("item_id"), *_MARK, "vec", F.lit(False).alias("_item")))

    def cell(rows: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, rows = to_arrow_schema(schema), _usable(rows)
        side = rows.column("_item").to_numpy()
        mine, keys = rows.filter(pa.array(side)), rows.filter(pa.array(~side))
        if not mine.num_rows or not keys.num_rows:
            return arrow.empty_table()
        wanted = Lists(_ordered(keys.column("vec"), order, signed), threshold)
        best, ids = _Best(k, len(wanted)), mine.column("item_id")
        found, vectors = ids.to_numpy(), mine.column("vec")
        for a in range(0, len(found), _BLOCK_ITEMS):
            unit = _ordered(vectors.slice(a, _BLOCK_ITEMS), order, signed)
            _search(best, wanted, Lists(unit, threshold), found[a:a + _BLOCK_ITEMS], threshold)
        return _emit(best, keys.select(_MARK), ids.type, arrow)

    return both.groupBy("i", "q").applyInArrow(cell, schema)


def list_search(items: DataFrame, queries: DataFrame, k: int = TOP_K, *, query_keys: Sequence[str] = ("query_id",),
                threshold: float | None = None, width: int | None = None) -> DataFrame:
    """``(keys…, item_id, score, rank)``: the best ``k`` of ``items(item_id, vec)`` for each of ``queries(keys…, vec)``.

    The result is that of ``similarity.knn``, without a product of the two sides.
    With ``threshold`` (above 0) only items at or above it are found and entries may
    have any sign; without it entries must not be negative.  Vectors that are null
    or have an element that is not finite find nothing and are not found; a vector
    of zeros scores 0; ties go to the lower id; an equal vector is searched once.
    Extra columns are left out.  ``width`` is the vector length where it is known.
    """
    if threshold is not None and threshold <= 0:
        raise ValueError("the threshold must be above 0")
    query_keys = list(query_keys)
    items = items.select("item_id", "vec")
    width = width or vector_width(items, queries.select("vec"))
    items = cut_lineage(_lowest_copies(items, k))
    length = F.coalesce(F.size("vec"), F.lit(-1))
    marked = cut_lineage(queries.select(*query_keys, "vec").withColumns(
        {"_h1": F.xxhash64(length, "vec"), "_h2": F.xxhash64(F.lit(7), length, "vec")}))
    asked = cut_lineage(marked.groupBy(*_MARK).agg(F.any_value("vec").alias("vec")))

    # Rarest first; coordinates without any item first of all, so that they shorten what follows.
    order = np.argsort(np.array(_list_lengths(items, width)), kind="stable")
    signed, floor = threshold is not None, threshold or 0.0
    schema = T.StructType([T.StructField(c, T.LongType()) for c in _MARK]
                          + [items.schema["item_id"], T.StructField("score", T.DoubleType())])
    done = None
    if k == 1 and signed and floor <= 1:
        # Nothing scores above 1, so a query with an item in its own direction meets no list.
        done = cut_lineage(_top(_same_direction(items, asked, _MARK, schema, width), _MARK, 1).drop("rank"))
        asked = cut_lineage(asked.join(done, _MARK, "left_anti"))
    if 8 * width * asked.count() <= SHARED_BYTES:
        found = _by_shared(items, asked, k, schema, order, floor, signed)
    else:
        found = _by_fragments(items, asked, k, schema, order, floor, signed, max(1, CELL_BYTES // (16 * width)))
    found = _scored(found, floor)
    if done is not None:
        found = found.unionByName(done)
    if not signed:
        found = cut_lineage(_top(found, _MARK, k).drop("rank"))
        found = found.unionByName(_zero_scores(found, items, asked, k))
    best = _top(found, _MARK, k)
    return marked.select(*query_keys, *_MARK).join(best, _MARK).drop(*_MARK)


def _zero_scores(found: DataFrame, items: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Items without a common coordinate for queries that share one with fewer than ``k``: the lowest ids.

    Such a query has found fewer than ``k``, so the ``2 k`` lowest ids hold all it may get.
    """
    usable = F.col("vec").isNotNull() & ~F.exists(
        "vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ids = [r[0] for r in items.where(usable).orderBy("item_id").limit(2 * k).select("item_id").collect()]
    full = found.groupBy(*_MARK).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = asked.where(usable).select(*_MARK).join(full, _MARK, "left_anti")
    kind = items.schema["item_id"].dataType
    given = F.array(*[F.lit(i).cast(kind) for i in ids]) if ids else F.array().cast(T.ArrayType(kind))
    rows = short.withColumn("item_id", F.explode(given))
    return rows.join(found, [*_MARK, "item_id"], "left_anti").withColumn("score", F.lit(0.0))
