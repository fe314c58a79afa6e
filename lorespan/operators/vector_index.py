"""Approximate nearest neighbours by an inverted file with product-quantised residuals.

The index is fitted on a bounded sample and holds every row.  k-means over unit vectors
makes cells; what a vector lacks of its cell's centre, the residual, is cut into
subspaces, each coded by the nearest of at most 256 codewords.  A search reads, for each query,
the cells whose centres are nearest.  In a cell the codes give scores by table lookup, and
only the best of those are scored exactly.

A query that has found too few rows reads the next cells, and so on.  With ``exact`` it reads
on until the triangle inequality says that no cell left can hold a better row: a row of a cell
is no nearer to the query than the cell's centre, less the cell's radius.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespan.fixed_values import TOP_K
from lorespan.operators.similarity import SCORE_DIGITS, _top, _unit_rows, _usable, vector_width
from lorespan.session import cut_lineage

#: Rows that cells and codewords are fitted on, at most, and bytes of their vectors.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 * 1024 * 1024
#: Cells, at most; their centres travel to every task.
MAX_CELLS = 4096
#: Rows of a cell that one task scores; a larger cell is read in parts.
PART_ROWS = 16_384
CODEWORDS = 256
_FIT_ROUNDS = 12
#: Vectors of the sample that searches are tried with, and the share of their neighbours to be reached.
TRIED, REACHED = 400, 0.97


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; ties go to the first."""
    lengths = np.einsum("ij,ij->i", centres, centres)
    step = max(1, 4_000_000 // max(len(centres), 1))
    return np.concatenate([np.zeros(0, np.int64), *(
        (lengths - 2 * rows[a:a + step] @ centres.T).argmin(1) for a in range(0, len(rows), step))])


def fit_centres(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means from distinct rows; a centre that loses all its rows stays where it is."""
    distinct = np.unique(rows, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(_FIT_ROUNDS):
        of = _nearest(rows, centres)
        counts = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rows)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def needed_probes(sample: np.ndarray, centres: np.ndarray, k: int = TOP_K) -> int:
    """Cells to read so that ``REACHED`` of the neighbours of vectors of the sample are among their rows.

    Neighbours in the sample are farther away than those among all rows, so this is on the safe side.
    """
    if len(sample) < 2:
        return 1
    tried = sample[:TRIED]
    scores = tried @ sample.T
    scores[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
    near = np.argsort(-scores, axis=1, kind="stable")[:, :min(k, len(sample) - 1)]
    lengths = np.einsum("ij,ij->i", centres, centres)
    order = np.argsort(lengths - 2 * tried @ centres.T, axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    return int(np.quantile(np.take_along_axis(place, _nearest(sample, centres)[near], axis=1), REACHED, method="higher")) + 1


@dataclass
class VectorIndex:
    """``rows``: ``cell, part, item_id, vec, code``, written; the rest are arrays of bounded size."""

    rows: DataFrame
    width: int
    centres: np.ndarray
    books: list[np.ndarray]
    parts: np.ndarray
    radii: np.ndarray
    probes: int

    @property
    def cells(self) -> int:
        return len(self.centres)


def _padded(vectors, width: int) -> np.ndarray:
    """Unit rows of at least ``width``; what a query has beyond no item has."""
    return _unit_rows(vectors, width)[:, :width]


def build_index(items: DataFrame, cells: int | None = None, subspaces: int | None = None, width: int | None = None,
                sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS, seed: int = 7) -> VectorIndex:
    """An index of all ``items(item_id, vec)``.

    Trials on the sample say how many cells a search reads by default.  The sample takes rows from everywhere, in the order of a hash of their ids.  By default
    there are as many cells as the root of the number of rows, and four entries a subspace.
    Vectors that are null or not finite are left out; shorter ones count as padded with zeros.
    """
    items = items.select("item_id", "vec")
    width = width or vector_width(items)
    most = max(1, min(sample_rows, SAMPLE_BYTES // (8 * width)))
    chosen = _usable(items.orderBy(F.xxhash64("item_id"), "item_id").limit(most).toArrow())
    sample = _padded(chosen.column("vec"), width)
    cells = min(MAX_CELLS, cells or max(1, round(items.count() ** .5)))
    centres = fit_centres(sample, cells, seed) if len(sample) else np.zeros((1, width))
    apart = sample - centres[_nearest(sample, centres)] if len(sample) else np.zeros((1, width))
    bounds = np.linspace(0, width, (subspaces or max(1, width // 4)) + 1).astype(int)
    books = [fit_centres(apart[:, a:b], CODEWORDS, seed + 1 + j) for j, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]
    id_type = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("item_id", id_type),
                           T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("code", T.BinaryType()),
                           T.StructField("far", T.DoubleType())])
    shared = items.sparkSession.sparkContext.broadcast((centres, books))

    def assign(batches):
        centres, books = shared.value
        for batch in batches:
            batch = _usable(batch)
            rows = _padded(batch.column(1), width)
            of = _nearest(rows, centres)
            rest = rows - centres[of]
            codes = np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(bounds[:-1], bounds[1:], books)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(of.astype(np.int32)), batch.column(0), pa.array(list(rows), pa.list_(pa.float64())),
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.sqrt(np.einsum("ij,ij->i", rest, rest)))], names=schema.names)

    placed = cut_lineage(items.mapInArrow(assign, schema))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row for each cell
    parts, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in sizes:
        parts[r["cell"]], radii[r["cell"]] = -(-r["n"] // part_rows), r["far"]
    of = F.element_at(F.lit(np.maximum(parts, 1).tolist()), F.col("cell") + 1)
    rows = placed.withColumn("part", F.pmod(F.xxhash64("item_id"), of).cast("int")).drop("far")
    return VectorIndex(rows, width, centres, books, parts, radii, needed_probes(sample, centres))


def search_index(index: VectorIndex, queries: DataFrame, k: int = TOP_K, *, query_keys: Sequence[str] = ("query_id",),
                 probes: int | None = None, rescored: int | None = None, exact: bool = False,
                 seen: list[int] | None = None) -> DataFrame:
    """``keys…, item_id, score, rank``: the best ``k`` rows by cosine for each of ``queries(keys…, vec)``.

    Each query reads its ``probes`` nearest cells (as many as trials on the sample asked for) and scores the best
    ``rescored`` of a part (eight times ``k``; with ``exact`` all) exactly.  Query keys are unique.  Ties
    go to the lower id.  ``seen`` takes the number of (query, cell) pairs of each round.
    """
    query_keys = list(query_keys)
    rescored = None if exact else rescored or 8 * k
    probes = min(index.cells, probes or index.probes)
    item_type = index.rows.schema["item_id"].dataType
    key_fields = [queries.schema[c] for c in query_keys]
    asked = T.StructType([*key_fields, T.StructField("cell", T.IntegerType()), T.StructField("part", T.IntegerType()),
                          T.StructField("vec", T.ArrayType(T.DoubleType()))])
    shape = T.StructType([*key_fields, T.StructField("item_id", item_type), T.StructField("score", T.DoubleType())])
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, index.books, index.parts, index.radii))
    width, n_keys = index.width, len(query_keys)

    def ask(first: int, last: int):
        def run(batches):
            centres, _, parts, radii = shared.value
            for batch in batches:
                batch = _usable(batch)
                rows = _unit_rows(batch.column(n_keys), width)
                lengths = np.einsum("ij,ij->i", centres, centres)
                own = np.einsum("ij,ij->i", rows, rows)[:, None]
                away = np.sqrt(np.maximum(own + lengths - 2 * rows[:, :width] @ centres.T, 0))
                order = np.argsort(away, axis=1, kind="stable")
                # From the score of the k-th row to its distance; a hundred-millionth is left for rounding.
                worst = np.sqrt(np.maximum(2 - 2 * batch.column(n_keys + 1).to_numpy(zero_copy_only=False), 0)) + 1e-8
                q, cell = [], []
                for i, (line, far) in enumerate(zip(order, away)):
                    near = line[parts[line] > 0][first:last]
                    if exact:
                        near = near[far[near] - radii[near] <= worst[i]]
                    for c in near:
                        q += [i] * parts[c]
                        cell += [(c, p) for p in range(parts[c])]
                cells = np.array(cell, np.int32).reshape(-1, 2)
                picked = pa.array(np.array(q, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j).take(picked) for j in range(n_keys)), pa.array(cells[:, 0].copy()), pa.array(cells[:, 1].copy()),
                     pa.array(list(rows[np.array(q, np.int64), :width]), pa.list_(pa.float64()))], names=asked.names)

        return run

    def score(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        centres, books, _, _ = shared.value
        names, picked, ids, scores = wanted.select(query_keys), [], [], []
        if rows.num_rows and wanted.num_rows:
            rows = rows.sort_by("item_id")
            matrix = _as_matrix(rows.column("vec"))
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, len(books))
            centre = centres[rows.column("cell")[0].as_py()]
            asks = _as_matrix(wanted.column("vec"))
            bounds = np.cumsum([0, *(book.shape[1] for book in books)])
            for i, ask_ in enumerate(asks):
                best = np.arange(len(matrix))
                if rescored and len(best) > rescored:
                    near = ask_ @ centre + sum((book @ ask_[a:b])[codes[:, j]] for j, (book, a, b) in enumerate(zip(books, bounds[:-1], bounds[1:])))
                    best = np.sort(np.argsort(-np.round(near, SCORE_DIGITS), kind="stable")[:rescored])
                got = np.round(matrix[best] @ ask_, SCORE_DIGITS) + 0.0
                top = np.argsort(-got, kind="stable")[:k]  # ids ascend, so ties stay in their order
                picked += [i] * len(top)
                ids.append(best[top])
                scores.append(got[top])
        at = np.concatenate([np.zeros(0, np.int64), *ids])
        columns = [names.column(j).take(pa.array(np.array(picked, np.int64))) for j in range(n_keys)]
        columns += [rows.column("item_id").take(pa.array(at)), pa.array(np.concatenate([np.zeros(0), *scores]))]
        return pa.table(columns, names=shape.names)

    pending = cut_lineage(queries.select(*query_keys, "vec").withColumn("worst", F.lit(-1.0)))
    hits, first, last = None, 0, probes
    while first < index.cells:
        pairs = pending.mapInArrow(ask(first, last), asked)
        if seen is not None:
            pairs = cut_lineage(pairs)
            seen.append(pairs.count())
        found = index.rows.groupBy("cell", "part").cogroup(pairs.groupBy("cell", "part")).applyInArrow(score, shape)
        hits = found if hits is None else hits.drop("rank").unionByName(found)
        hits = cut_lineage(_top(hits, query_keys, k))
        state = hits.groupBy(*query_keys).agg(F.count("*").alias("n"), F.min("score").alias("low"))
        state = pending.drop("worst").join(state, query_keys, "left").withColumn("worst", F.when(F.col("n") >= k, F.col("low")).otherwise(-1.0))
        pending = cut_lineage((state if exact else state.where("worst = -1")).select(*query_keys, "vec", "worst"))
        if pending.isEmpty():
            break
        first, last = last, min(index.cells, 2 * last)
    return hits


def _as_matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def recall(hits: DataFrame, truth: DataFrame, query_keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """``n_true, n_found, recall``: the share of the true neighbours that were found, one row."""
    keys = [*query_keys, "item_id"]
    both = truth.select(*keys).join(hits.select(*keys, F.lit(1).alias("hit")), keys, "left")
    return both.agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("recall"))
