"""Nearest neighbours by cosine: exact and approximate.

Four ways, one result shape ``(query keys…, item_id, score, rank)``:

* ``items`` - the item matrix is small (checked) and travels to the queries; each
  query is finished where it is read, without a shuffle.
* ``queries`` - the query matrix travels to the items, in parts that are small
  (measured); every task keeps only its best ``k`` per query.
* ``grid`` - both sides are large.  Items and queries are cut into fragments and
  every fragment pair meets once in a bounded cell (fragment-and-replicate), so
  no task sees more than one cell and only ``k`` rows per query leave it.
* ``lsh`` - as ``grid``, but rows meet only where random-hyperplane codes agree.
  A query also reads the codes beside its own in which its least certain bits are
  turned, and one that finds too few items reads them all.
  A code shared by a large part of the rows is cut into fragments just the same.

In the last two, rows with equal vectors are scored once for all of them.

Scores are computed in double precision, ties go to the lower item id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lorespan.fixed_values import TOP_K
from lorespan.operators.ordering import keep_first
from lorespan.session import cut_lineage, run_once, spread

SCORE_DIGITS = 9
BROADCAST_BYTES = 32 * 1024 * 1024
CELL_BYTES = 64 * 1024 * 1024
CODES_BROADCAST = 1 << 20
#: Fragments of a side up to which the caller's cell sizes hold; beyond, cells grow to CELL_BYTES first.
FRAGMENTS = 8
#: Rows of a product, so that it stays in the cache, and numbers gathered for exact scores at a time.
_BLOCK_QUERIES, _BLOCK_ITEMS, _PAIR_NUMBERS = 1024, 2048, 1 << 21
#: Rows of a side and entries of a row from which on products are bounded first, items of such a block,
#: and products of a block that cost as much as that of a single pair.
_MANY_ROWS, _MANY_COLUMNS, _BOUND_ITEMS, _PAIR_COST = 2048, 64, 1024, 32
#: Unit vectors further apart than the first score below 1 when rounded; steps and number of the lines they are laid on.
_NEAR, _STEP, _LINES = 4e-5, 2.5e-4, 4


# ---------------------------------------------------------------- in a task

def _unit_rows(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows scaled to length one; short rows are padded with zeros, zero rows stay zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    longest = int(sizes.max()) if len(sizes) else 0
    full = max(longest, width or 0)
    if len(sizes) and (sizes == full).all():
        rows = flat.reshape(len(sizes), full)
    else:
        rows = np.zeros((len(sizes), full))
        rows[np.repeat(np.arange(len(sizes)), sizes),
             np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    rows /= np.where(norms == 0, 1.0, norms)[:, None]
    return rows


def _usable(rows):
    """Rows whose vector is there and has finite elements only; others are nobody's
    neighbours and have none.  Done here and not by a filter on the column, which
    would run the function that makes the vector a second time."""
    vectors = rows.column("vec")
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    good = vectors.is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(vectors.value_lengths(), 0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    finite = np.isfinite(flat.astype(np.float64) if flat.dtype == object else flat)
    if not finite.all():
        good = good.copy()
        good[np.repeat(np.arange(len(sizes)), sizes)[~finite]] = False
    return rows if good.all() else rows.filter(pa.array(good))


def _matched(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices at the wider width (the norms were taken before)."""
    width = max(a.shape[1], b.shape[1])

    def widen(m):
        return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))

    return widen(a), widen(b)


class _Best:
    """Best ``k`` items per query row seen so far in this task.

    Products in single precision say which pairs may be among them, by a bound of
    their error; only these are scored in double precision.
    """

    def __init__(self, k: int, n_queries: int):
        self.k = k
        self.limit = 4 * k * max(n_queries, 1) + 100_000
        #: The k-th best score of a query is not below this.
        self.floor = np.full(n_queries, -np.inf)
        self.parts: list[pd.DataFrame] = []
        self.held = 0
        #: Products of a whole query and a whole item in single precision.
        self.products = 0

    def offer(self, queries: np.ndarray, items: np.ndarray, ids: np.ndarray) -> None:
        if self.k == 1 and min(len(queries), len(items)) >= _MANY_ROWS and queries.shape[1] >= _MANY_COLUMNS:
            return self._offer_by_bounds(queries, items, ids)
        near, far = queries.astype(np.float32), items.astype(np.float32)
        slack = (queries.shape[1] + 8) * 2.0 ** -23 + 10.0 ** -SCORE_DIGITS
        for a in range(0, len(near), _BLOCK_QUERIES):
            for b in range(0, len(far), _BLOCK_ITEMS):
                scores = near[a:a + _BLOCK_QUERIES] @ far[b:b + _BLOCK_ITEMS].T
                self.products += scores.size
                if self.k == 1:
                    row, col = self._highest(scores, np.arange(a, a + len(scores)), slack)
                else:
                    row, col = self._may_enter(scores, a, slack)
                    row = row + a
                if len(row):
                    col = col + b
                    self.add(row, exact_scores(queries, items, row, col), ids[col])

    def _offer_by_bounds(self, queries: np.ndarray, items: np.ndarray, ids: np.ndarray) -> None:
        """Products only where a bound of them reaches the query's floor (``k`` = 1).

        Queries are taken by their nearest of a few directions and items from the nearest
        to it on.  The angles end a block of queries where no later item can reach a
        floor, ``product_bounds`` leave out single pairs.  Where these leave out little,
        products follow at once.
        """
        slack = 3 * (queries.shape[1] + 8) * 2.0 ** -23 + 10.0 ** -SCORE_DIGITS
        of_queries, of_items = product_bounds(queries, items)
        towards = _directions(queries)
        along, reaches = queries @ towards.T, (items @ towards.T).T
        taken = along.argmax(axis=1)
        for c, reach in enumerate(reaches):
            mine = np.flatnonzero(taken == c)
            mine = mine[np.argsort(-along[mine, c], kind="stable")]
            if not len(mine):
                continue
            order = np.argsort(-reach, kind="stable")
            reach, right_bounds = reach[order], of_items[order]
            # The first block is small, as nothing can be left out before a query has a floor.
            starts = [0, *range(_BOUND_ITEMS // 4, len(order), _BOUND_ITEMS)]
            bounded = full = 0
            for a in range(0, len(mine), _BLOCK_QUERIES):
                rows = mine[a:a + _BLOCK_QUERIES]
                left, left_bounds, cosine = queries[rows].astype(np.float32), of_queries[rows], along[rows, c]
                for b, end in zip(starts, [*starts[1:], len(order)]):
                    least = self.floor[rows] - slack
                    live = _angle_bound(cosine, reach[b]) >= least
                    if not live.any():
                        break
                    if np.count_nonzero(live) < 0.9 * len(rows):
                        rows, left, left_bounds, cosine, least = (
                            x[live] for x in (rows, left, left_bounds, cosine, least))
                    block = order[b:end]
                    if bounded < 8 * _BLOCK_QUERIES * _BOUND_ITEMS or full < 0.6 * bounded:
                        high = left_bounds @ right_bounds[b:end].T
                        bounded += high.size
                        least = least.astype(np.float32)
                        some = np.flatnonzero(high.max(axis=1) >= least)
                        row, col = np.divmod(np.flatnonzero(high[some] >= least[some, None]), len(block))
                        if len(row) * _PAIR_COST < len(some) * len(block):
                            row, col = self._highest_pairs(_products(queries, items, rows[some[row]], block[col]), rows[some[row]], col, slack)
                            full += len(row) * _PAIR_COST
                        else:
                            scores = left[some] @ items[block].astype(np.float32).T
                            row, col = self._highest(scores, rows[some], slack)
                            full += scores.size
                            self.products += scores.size
                    else:
                        scores = left @ items[block].astype(np.float32).T
                        row, col = self._highest(scores, rows, slack)
                        self.products += scores.size
                    if len(row):
                        col = block[col]
                        self.add(row, exact_scores(queries, items, row, col), ids[col])

    def _highest(self, scores: np.ndarray, rows: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a block that may be the best of the queries in ``rows``, whose floors follow (``k`` = 1)."""
        # Only the queries whose highest product reaches their floor are looked through.
        highest = scores.max(axis=1)
        some = np.flatnonzero(highest >= (self.floor[rows] - slack).astype(np.float32))
        if len(some) < len(rows):
            scores, highest, rows = scores[some], highest[some], rows[some]
        highest = highest.astype(np.float64)
        self.floor[rows] = np.maximum(self.floor[rows], highest - slack)
        row, col = np.divmod(np.flatnonzero(scores >= (highest - 2 * slack).astype(np.float32)[:, None]), scores.shape[1])
        return rows[row], col

    def _highest_pairs(self, scores: np.ndarray, rows: np.ndarray, cols: np.ndarray, slack: float):
        """As ``_highest`` for single pairs, those of a query one after another."""
        self.products += len(scores)
        if not len(scores):
            return rows, cols
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        highest = np.maximum.reduceat(scores, first).astype(np.float64)
        floor = self.floor[rows[first]] = np.maximum(self.floor[rows[first]], highest - slack)
        good = scores >= np.repeat(floor - slack, np.diff(np.append(first, len(rows))))
        return rows[good], cols[good]

    def _may_enter(self, scores: np.ndarray, first: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a block that may be among the best, and the floors that follow from the block."""
        floor = self.floor[first:first + len(scores)]
        hit = scores >= (floor - slack).astype(np.float32)[:, None]
        if scores.shape[1] > self.k and np.count_nonzero(hit) > 4 * self.k * len(scores):
            many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * self.k)
            some = scores[many]
            kth = np.partition(some, some.shape[1] - self.k, axis=1)[:, -self.k].astype(np.float64)
            hit[many] &= some >= (kth - 2 * slack)[:, None].astype(np.float32)
            floor[many] = np.maximum(floor[many], kth - slack)
        return np.divmod(np.flatnonzero(hit), scores.shape[1])

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scored pairs of the queries in ``rows``."""
        part = pd.DataFrame({"q": rows, "score": scores, "id": ids})
        if len(part) > self.limit // 4:
            part = self._cut(part)
        self.parts.append(part)
        self.held += len(part)
        if self.held > self.limit:
            self._merge()

    def settle(self) -> None:
        """Raise the floors when many pairs were added since they were last."""
        if self.held > self.limit // 4:
            self._merge()

    def _cut(self, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["q", "score", "id"], ascending=[True, False, True])
        return part[part.groupby("q").cumcount() < self.k]

    def _merge(self) -> None:
        merged = self._cut(pd.concat(self.parts, ignore_index=True))
        self.parts, self.held = [merged], len(merged)
        last = merged[(merged.groupby("q").cumcount() == self.k - 1).to_numpy()]
        at = last["q"].to_numpy(np.int64)
        self.floor[at] = np.maximum(self.floor[at], last["score"].to_numpy())

    def rows(self) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame({"q": np.zeros(0, int), "score": np.zeros(0), "id": []})
        self._merge()
        return self.parts[0]


def _products(queries: np.ndarray, items: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Products of pairs of rows."""
    step = max(1, _PAIR_NUMBERS // max(queries.shape[1], 1))
    return np.concatenate([np.zeros(0, queries.dtype), *(
        np.einsum("ij,ij->i", queries[row[a:a + step]], items[col[a:a + step]]) for a in range(0, len(row), step))])


def exact_scores(queries: np.ndarray, items: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Rounded scores of pairs of unit rows."""
    return np.round(_products(queries, items, row, col), SCORE_DIGITS) + 0.0


def product_bounds(queries: np.ndarray, items: np.ndarray, share: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices in single precision whose product, but for rounding, is nowhere below that of ``queries`` and ``items``, with fewer columns.

    One in ``share`` columns, those with the largest entries, stay as they are; the
    others are cut into as many parts.  In a part a product is at most that of the
    lengths, and at most that of the largest entry of one side and the sum of the
    other.  Of these the form with the lowest mean is taken: rows with few entries,
    such as those of short texts, lose little by it.
    """
    weight = sum((_some(x).astype(np.float64) ** 2).mean(axis=0) for x in (queries, items))
    order = np.argsort(-weight, kind="stable")
    n = len(order) // share
    starts = n + np.arange(n) * (len(order) - n) // n

    def parts(x, how):
        out = np.empty((len(x), 2 * n), np.float32)
        for a in range(0, len(x), _BLOCK_QUERIES):
            rows = x[a:a + _BLOCK_QUERIES, order]
            out[a:a + len(rows), :n] = rows[:, :n]
            out[a:a + len(rows), n:] = how(np.abs(rows))
        return out

    def largest(x):
        return np.maximum.reduceat(x, starts, axis=1)

    def total(x):
        return np.add.reduceat(x, starts, axis=1)

    def length(x):
        return np.sqrt(np.add.reduceat(x * x, starts, axis=1))

    def mean(form):
        a, b = (parts(_some(x), how)[:, n:].mean(axis=0, dtype=np.float64) for x, how in zip((queries, items), form))
        return a @ b

    form = min(((largest, total), (length, length), (total, largest)), key=mean)
    return parts(queries, form[0]), parts(items, form[1])


def _some(rows: np.ndarray) -> np.ndarray:
    """Rows from all over a matrix, 4,096 to 8,191 of many."""
    return rows[::max(1, len(rows) // 4096)]


def _directions(rows: np.ndarray, n: int = 8, rounds: int = 6) -> np.ndarray:
    """A few unit vectors that most rows are near to, by k-means over some of them."""
    some = _some(rows)
    found = some[np.linspace(0, len(some) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        taken = (some @ found.T).argmax(axis=1)
        for c in range(n):
            total = some[taken == c].sum(axis=0)
            length = np.sqrt(total @ total)
            if length > 0:
                found[c] = total / length
    return found


def _angle_bound(cosine: np.ndarray, reach: float) -> np.ndarray:
    """The highest product of a unit row with ``cosine`` to a direction and one with ``reach`` to it or less."""
    far = cosine * reach + np.sqrt(np.maximum(0, 1 - cosine ** 2)) * np.sqrt(max(0.0, 1 - reach ** 2))
    return np.where(reach >= cosine, 1.0, far) + 1e-6


def _emit(best: _Best, keys: pa.Table, id_type: pa.DataType, schema: pa.Schema,
          others: int | None = None) -> pa.Table:
    """Arrow rows of the bests; ``others`` drops the query itself and keeps that many."""
    rows = best.rows()
    if others is not None:
        own = keys.column(0).to_numpy()[rows["q"].to_numpy(np.int64)]
        rows = rows[rows["id"].to_numpy() != own]
        rows = rows[rows.groupby("q").cumcount() < others]
    picked = keys.take(pa.array(rows["q"].to_numpy(np.int64)))
    columns = [picked.column(i) for i in range(picked.num_columns)]
    columns.append(pa.array(rows["id"].to_numpy(), type=id_type, from_pandas=True))
    columns.append(pa.array(rows["score"].to_numpy(np.float64)))
    if "rank" in schema.names:
        columns.append(pa.array(rows.groupby("q").cumcount().to_numpy() + 1))
    return pa.table(columns, names=schema.names).cast(schema)


# ---------------------------------------------------------------- on Spark

def _top(partial: DataFrame, query_keys: Sequence[str], k: int) -> DataFrame:
    """Global best ``k`` from the per-task bests.

    ``dense_rank`` gives copies of one pair (found through several codes) the
    same rank, so they fall away without losing a neighbour.
    """
    order = W.partitionBy(*query_keys).orderBy(F.desc("score"), F.asc("item_id"))
    return (partial.withColumn("rank", F.dense_rank().over(order))
            .where(F.col("rank") <= k)
            .dropDuplicates([*query_keys, "item_id", "score", "rank"]))


def _result_schema(items: DataFrame, queries: DataFrame, query_keys: Sequence[str]) -> T.StructType:
    return T.StructType(
        [T.StructField(c, queries.schema[c].dataType) for c in query_keys]
        + [T.StructField("item_id", items.schema["item_id"].dataType),
           T.StructField("score", T.DoubleType())])


def longest_vector(table: DataFrame) -> int:
    """Length of the longest vector; 1 when there are none."""
    return max(table.agg(F.max(F.size("vec")).alias("d")).first()["d"] or 1, 1)


def vector_width(*tables: DataFrame) -> int:
    return max(map(longest_vector, tables))


def choose_method(items: DataFrame, queries: DataFrame, width: int | None, limit_bytes: int) -> str:
    """Share the smaller side when its matrix in double precision stays within the limit.

    Without a given width a side short enough in rows is also measured for its
    longest vector before it is taken.
    """
    limit = limit_bytes // (8 * (width or 1))
    # Rows alone are counted, so a computed vector column is not computed for this.
    counts = {"items": items.count(), "queries": queries.count()}
    for name in sorted(counts, key=counts.get):
        side = items if name == "items" else queries
        if counts[name] <= limit and (
                width or counts[name] * 8 * longest_vector(side) <= limit_bytes):
            return name
    return "grid"


def _by_shared_items(items: DataFrame, queries: DataFrame, query_keys: Sequence[str], k: int,
                     schema: T.StructType, exclude_self: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    table = _usable(items.toArrow())
    ids = table.column("item_id")
    shared = items.sparkSession.sparkContext.broadcast(
        (ids.to_numpy(), _unit_rows(table.column("vec")), ids.type))
    ranked = T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())])
    arrow_schema = to_arrow_schema(ranked)
    n_keys = len(query_keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, id_type = shared.value
        for batch in batches:
            batch = _usable(batch)
            if batch.num_rows and len(ids):
                keys = pa.Table.from_batches([batch]).select(list(range(n_keys)))
                best = _Best(k + exclude_self, batch.num_rows)
                best.offer(*_matched(_unit_rows(batch.column(n_keys)), matrix), ids)
                yield from _emit(best, keys, id_type, arrow_schema,
                                 k if exclude_self else None).to_batches()

    return queries.select(*query_keys, "vec").mapInArrow(scan, ranked)


def _by_shared_queries(items: DataFrame, queries: DataFrame, query_keys: Sequence[str], k: int,
                       schema: T.StructType):
    """Bests of each task, and the broadcast that they are found with."""
    from pyspark.sql.pandas.types import to_arrow_schema

    table = _usable(queries.select(*query_keys, "vec").toArrow())
    shared = items.sparkSession.sparkContext.broadcast(
        (table.select(list(query_keys)), _unit_rows(table.column("vec"))))
    arrow_schema = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, wanted = shared.value
        best, id_type = _Best(k, len(wanted)), None
        for batch in batches:
            batch = _usable(batch)
            if batch.num_rows:
                id_type = batch.column(0).type
                best.offer(*_matched(wanted, _unit_rows(batch.column(1))),
                           batch.column(0).to_numpy(zero_copy_only=False))
        if id_type is not None:
            yield from _emit(best, keys, id_type, arrow_schema).to_batches()

    return items.select("item_id", "vec").mapInArrow(scan, schema), shared


def _shared_in_parts(items: DataFrame, queries: DataFrame, query_keys: Sequence[str], k: int,
                     schema: T.StructType, parts: int) -> DataFrame:
    """As many queries as may be shared travel to the items at a time, part after part.

    Every part meets all items and writes its bests, so neither the driver nor a
    task holds more than one part.
    """
    items, queries = cut_lineage(items), cut_lineage(queries)
    part, found = F.pmod(F.xxhash64(*query_keys, F.lit(3)), F.lit(parts)), None
    for n in range(parts):
        hits, shared = _by_shared_queries(spread(items), queries.where(part == n), query_keys, k, schema)
        hits = cut_lineage(_top(hits, query_keys, k))
        shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
    return found


def _cells(items: DataFrame, queries: DataFrame, query_keys: Sequence[str]):
    """Give every item fragment and query fragment of a code one common cell.

    Both sides carry ``i_cuts`` and ``q_cuts``, the numbers of fragments of their
    code: an item row goes to one fragment and is repeated for each of the query
    fragments, and the other way round.
    """
    left = (items.withColumn("i", F.pmod(F.xxhash64("item_id", F.lit(1)), F.col("i_cuts")).cast("int"))
            .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("q_cuts") - 1)))
            .select("code", "i", "q", F.col("item_id").alias("item_id"), F.col("vec").alias("vec")))
    right = (queries.withColumn("q", F.pmod(F.xxhash64(*query_keys, F.lit(2)), F.col("q_cuts")).cast("int"))
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("i_cuts") - 1)))
             .select("code", "i", "q", *query_keys, F.col("vec").alias("query_vec"))
             .withColumnRenamed("query_vec", "vec"))
    return left, right


def _whole(items: DataFrame, queries: DataFrame, cell_items: int, cell_queries: int, most: int):
    """One code for all rows, cut by their counts.

    A row is copied for each fragment of the other side, so the number of these is
    held: past ``FRAGMENTS`` they have up to ``most`` rows, whatever the sizes say.
    """
    def cuts(df, size):
        n = df.count()
        return F.lit(max(1, min(-(-n // size), max(FRAGMENTS, -(-n // most))))).cast("int")

    i_cuts, q_cuts = cuts(items, cell_items), cuts(queries, cell_queries)
    return tuple(df.withColumn("code", F.lit(0).cast("long"))
                 .withColumn("i_cuts", i_cuts).withColumn("q_cuts", q_cuts)
                 for df in (items, queries))


def _by_code(items: DataFrame, queries: DataFrame, codes, probed, n_codes: int,
             cell_items: int, cell_queries: int):
    """One row per code of an item and per probed code of a query; codes on one side only fall away.

    The table of cuts has at most ``n_codes`` rows, a number the options fix.
    """
    def pieces(df, name, size):
        n = F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int")
        return df.groupBy("code").agg(n.alias(name))

    items, queries = (df.withColumn("code", F.explode(of("vec"))) for df, of in ((items, codes), (queries, probed)))
    cuts = cut_lineage(pieces(items, "i_cuts", cell_items).join(
        pieces(queries, "q_cuts", cell_queries), "code"))
    cuts = F.broadcast(cuts) if n_codes <= CODES_BROADCAST else cuts
    return items.join(cuts, "code"), queries.join(cuts, "code")


def _by_cells(items: DataFrame, queries: DataFrame, query_keys: Sequence[str], k: int,
              schema: T.StructType) -> DataFrame:
    """Score each cell on its own; a cell has a bounded number of rows on either side."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(schema)
    left, right = _cells(items, queries, query_keys)

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = _usable(a), _usable(b)
        if not a.num_rows or not b.num_rows:
            return arrow_schema.empty_table()
        ids = a.column("item_id")
        best = _Best(k, b.num_rows)
        best.offer(*_matched(_unit_rows(b.column("vec")), _unit_rows(a.column("vec"))),
                   ids.to_numpy())
        return _emit(best, b.select(list(query_keys)), ids.type, arrow_schema)

    grid = ["code", "i", "q"]
    return left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(cell, schema)


def _lowest_copies(items: DataFrame, n: int) -> DataFrame:
    """Of items with an equal vector only the ``n`` lowest ids can be among the best
    ``n`` of any query; the others are left out, however many there are."""
    keyed = items.withColumn("_h", F.xxhash64("vec"))
    return keep_first(keyed, ["_h", "vec"], [F.asc("item_id")], n).drop("_h")


def _by_distinct_vector(items: DataFrame, queries: DataFrame, query_keys: Sequence[str], k: int,
                        schema: T.StructType, width: int, cut, whole=None) -> DataFrame:
    """Search once per distinct query vector, then give each query its rows.

    Copies on either side therefore cost no scoring.  Distinct vectors are told
    apart by 128 bits of hash.  Where only the best is wanted, a query that has an
    item in its own direction is done before anything meets in cells.  With
    ``whole``, those that find fewer than ``k`` items by ``cut`` search again by it.
    """
    # Without its length an empty vector would hash as none does.
    length = F.coalesce(F.size("vec"), F.lit(-1))
    mark = {"_h1": F.xxhash64(length, "vec"), "_h2": F.xxhash64(F.lit(7), length, "vec")}
    # Vectors may cost more than the search, and both sides are read more than once.
    marked = cut_lineage(queries.withColumns(mark))
    distinct = cut_lineage(marked.groupBy("_h1", "_h2").agg(F.any_value("vec").alias("vec")))
    keys = ["_h1", "_h2"]
    inner = T.StructType([T.StructField(c, T.LongType()) for c in keys] + schema.fields[-2:])
    lowest = cut_lineage(_lowest_copies(items, k))
    found = None
    if k == 1 and not whole:
        found = cut_lineage(_top(_same_direction(lowest, distinct, keys, inner, width), keys, 1))
        distinct = cut_lineage(distinct.join(found, keys, "left_anti"))
    best = _top(_by_cells(*cut(lowest, distinct), keys, k, inner), keys, k)
    if found is not None:
        best = best.unionByName(found)
    if whole:
        best = cut_lineage(best)
        full = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        short = cut_lineage(distinct.join(full, keys, "left_anti"))
        if not short.isEmpty():
            again = _top(_by_cells(*whole(lowest, short), keys, k, inner), keys, k)
            best = best.join(full, keys, "left_semi").unionByName(again)
    return marked.select(*query_keys, *keys).join(best, keys).drop(*keys)


def _same_direction(items: DataFrame, queries: DataFrame, query_keys: Sequence[str], schema: T.StructType,
                    width: int) -> DataFrame:
    """Pairs with a score of 1, above which there is none, without a product of the sides.

    Unit vectors of such a pair are less than ``_NEAR`` apart, and so are their
    places on any line.  Rows meet by their steps on a few lines; a query near the
    end of a step looks in the next one too.  What meets is scored as elsewhere.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    lines = np.random.default_rng(23).standard_normal((width, _LINES))
    lines /= np.linalg.norm(lines, axis=0)
    factors = np.random.default_rng(29).integers(1, 1 << 62, _LINES) | 1
    turns = np.array(np.meshgrid(*[[0, 1]] * _LINES)).reshape(_LINES, -1).T

    def stepped(df, names, reach):
        out = T.StructType([T.StructField("code", T.LongType()), *(df.schema[c] for c in (*names, "vec"))])

        def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrow = to_arrow_schema(out)
            for batch in batches:
                batch = _usable(batch)
                if not batch.num_rows:
                    continue
                unit = _unit_rows(batch.column("vec"), width)
                at = unit[:, :width] @ lines
                low, high = (np.floor((at + d) / _STEP).astype(np.int64) for d in (-reach, reach))
                # One code for each corner whose turned steps differ.
                use = ((high > low)[:, None, :] | (turns == 0)[None]).all(axis=2) & unit.any(axis=1)[:, None]
                row, turn = np.nonzero(use)
                code = (np.where(turns[turn] == 1, high[row], low[row]) * factors).sum(axis=1)
                rows = pa.Table.from_batches([batch]).take(pa.array(row))
                yield from pa.table([pa.array(code), *rows.columns], names=arrow.names).cast(arrow).to_batches()

        return df.select(*names, "vec").mapInArrow(steps, out)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            a, b = _matched(_unit_rows(batch.column("query_vec")), _unit_rows(batch.column("vec")))
            every = np.arange(batch.num_rows)
            score = exact_scores(a, b, every, every)
            rows = pa.Table.from_batches([batch]).select([*query_keys, "item_id"])
            rows = rows.append_column("score", pa.array(score)).filter(pa.array(score >= 1.0))
            yield from rows.cast(arrow).to_batches()

    asked = stepped(queries, query_keys, _NEAR).withColumnRenamed("vec", "query_vec")
    return asked.join(stepped(items, ["item_id"], 0.0), "code").drop("code").mapInArrow(scored, schema)


def hyperplane_codes(dim: int, tables: int, bits: int, seed: int = 17, probes: int = 0):
    """Column function: one sign code per table, the table number in the high bits.

    ``probes`` adds, for each table, the codes in which one of the bits nearest to
    their hyperplane is turned.
    """
    probes = min(probes, bits)
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    weights = (1 << np.arange(bits, dtype=np.int64))

    @F.pandas_udf("array<long>")
    def codes(vectors: pd.Series) -> pd.Series:
        rows = np.zeros((len(vectors), dim))
        known = vectors.notna().to_numpy()
        if known.any() and set(map(len, vectors[known])) == {dim}:
            rows[known] = np.stack(vectors[known])
        else:
            for r in np.flatnonzero(known):
                v = vectors.iloc[r][:dim]
                rows[r, :len(v)] = v
        sides = (rows @ planes).reshape(len(rows), tables, bits)
        values = (sides > 0) @ weights + (np.arange(tables, dtype=np.int64) << bits)
        if probes:
            nearest = np.argsort(np.abs(sides), axis=2, kind="stable")[:, :, :probes]
            values = np.concatenate([values[:, :, None], values[:, :, None] ^ weights[nearest]], axis=2)
            values = values.reshape(len(rows), -1)
        return pd.Series(list(values)).where(known, None)

    return run_once(codes)


def knn(items: DataFrame, queries: DataFrame, k: int = TOP_K, *,
        query_keys: Sequence[str] = ("query_id",), method: str = "auto",
        exclude_self: bool = False, width: int | None = None,
        broadcast_bytes: int = BROADCAST_BYTES,
        cell_items: int | None = None, cell_queries: int | None = None,
        tables: int = 8, bits: int = 8, probes: int = 2) -> DataFrame:
    """Best ``k`` of ``items(item_id, vec)`` for each of ``queries(keys…, vec)``.

    Ids and query keys are unique; ``exclude_self`` compares the first key with
    the item id.  A vector that is null or has a null, NaN or infinite element is no
    one's neighbour and finds none; shorter vectors count as padded with zeros.

    ``auto`` is exact: it broadcasts the smaller side when its measured size fits
    and uses the grid when neither does.  ``width`` is the vector length where the
    caller knows it, which saves the measuring.
    ``lsh`` is the approximate form; more ``tables`` and ``probes`` raise recall, more
    ``bits`` lower the work.  A query gets ``k`` items wherever there are that many.
    """
    query_keys = list(query_keys)
    items = items.select("item_id", "vec")
    queries = queries.select(*query_keys, "vec")
    schema = _result_schema(items, queries, query_keys)
    want = k + 1 if exclude_self else k
    if method == "auto":
        method = choose_method(items, queries, width, broadcast_bytes)
    if width is None and method in ("grid", "lsh"):
        width = vector_width(items, queries)
    if method in ("items", "queries"):
        side = items if method == "items" else queries
        size = 8 * side.count() * (width or longest_vector(side))
        most = max(broadcast_bytes, BROADCAST_BYTES)
        if size > most and method == "items":
            raise ValueError(f"{method} of {size} bytes are too many to share")

    if method == "items":
        return _by_shared_items(items, queries, query_keys, k, schema, exclude_self)
    if method == "queries":
        if size > most:
            hits = _shared_in_parts(items, queries, query_keys, want, schema, -(-size // most))
        else:
            hits = _top(_by_shared_queries(items, queries, query_keys, want, schema)[0], query_keys, want)
    elif method in ("grid", "lsh"):
        # A cell's item matrix takes about CELL_BYTES, its query matrix a quarter of that, or all of it where many.
        most = max(1, CELL_BYTES // (8 * width))
        cell_items = cell_items or most
        sizes = cell_items, cell_queries or max(1, cell_items // 4)
        def whole(i, q):
            return _whole(i, q, *sizes, most)

        codes, probed = (hyperplane_codes(width, tables, bits, probes=n) for n in (0, probes))

        def near(i, q):
            return _by_code(i, q, codes, probed, tables << bits, *sizes)

        cut = (whole,) if method == "grid" else (near, whole)
        hits = _by_distinct_vector(items, queries, query_keys, want, schema, width, *cut)
    else:
        raise ValueError(f"unknown method: {method}")

    if exclude_self:
        others = hits.where(~F.col(query_keys[0]).eqNullSafe(F.col("item_id")))
        hits = _top(others.drop("rank"), query_keys, k)
    return hits
