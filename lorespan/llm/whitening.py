"""Whitening of embeddings by an incrementally updated eigendecomposition.

Each task keeps the spectrum of the vectors it has read: their number, exact sums, and the
eigenvalues and eigenvectors of their centred scatter.  A vector that joins is a centred
rank-one update: the secular equation gives the new eigenvalues, components that the
update does not reach (or that share an eigenvalue) are deflated.  ``FOLD`` vectors
at a time are first turned by an orthogonal factorisation, which keeps their scatter, into
as many as a vector has entries, so the updates follow the entries and not the rows.

The spectra of tasks are combined by rank-one updates too: one for each eigenvector
of the other spectrum, one for the distance of the means; ``FAN`` of them meet in a task,
level by level.  At last all rows are projected on the combined eigenvectors and the
covariance of the projections, summed up in each task, is solved (Rayleigh-Ritz), so the
components are those of the exact covariance to double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.session import cut_lineage

SCALE, SHIFT = 1024, 100_000
#: Vectors turned into rank-one updates together; 1 makes an update of each vector.
FOLD = 4096
#: Spectra combined in one task.
FAN = 16
#: A vector with a greater entry is not finite for this purpose.
LARGEST = 1e9

_SPECTRUM = "part long, n long, sums array<decimal(38,0)>, mean array<double>, values array<double>, vectors array<double>"
_EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of diag(d) + z z', and each one's distance to every entry of ``d``.

    ``d`` ascends strictly and no ``z`` is zero, so one root lies after each entry.
    Row j of the distances is ``root j - d``, from the root's place beside its nearer entry.
    """
    n, w = len(d), z * z
    upper = np.append(d[1:], d[-1] + w.sum())
    gap = upper - d
    below = np.tri(n, dtype=bool)
    # The sign at the middle says which end is nearer.
    middle = 1 + (w / (d - (d + gap / 2)[:, None])).sum(1)
    near_low = middle >= 0
    near_low[-1] = True
    origin = np.where(near_low, d, upper)
    shifted = d - origin[:, None]
    lo, hi = np.where(near_low, 0.0, -gap / 2), np.where(near_low, gap / 2, 0.0)
    hi[-1] = gap[-1]
    x = (lo + hi) / 2
    ends = upper - origin
    for _ in range(60):
        away = shifted - x[:, None]
        terms = w / away
        f = 1 + terms.sum(1)
        # Roots lie to the right of negative values.
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
        done = (np.abs(f) <= 4 * n * _EPS * (1 + np.abs(terms).sum(1))) | (hi - lo <= 2 * _EPS * np.abs(x))
        if done.all():
            break
        slopes = terms / away
        low, high = (slopes * below).sum(1), (slopes * ~below).sum(1)
        # Each side of the sum by its nearest pole, with equal value and slope.
        p, q = np.diagonal(away), ends - x
        s, t = low * p * p, high * q * q
        c = f - low * p - high * q
        a, b = c * (p + q) + s + t, p * q * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = p[-1] + s[-1] / c[-1]
            y = x + step
        x = np.where(done | (y == x), x, np.where((y > lo) & (y < hi), y, (lo + hi) / 2))
    return origin + x, x[:, None] - shifted


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors (columns) of ``vectors diag(values) vectors' + x x'``."""
    z = vectors.T @ x
    reach = float(z @ z)
    if not reach:
        return values, vectors
    small = 8 * _EPS * max(abs(values[-1]), reach)
    # Deflation: what shares an eigenvalue is turned so that one of it takes the whole update.
    starts, k = [0], 0
    for i in range(1, len(values)):
        if values[i] - values[k] > small:
            starts.append(i)
            k = i
    if len(starts) < len(values):
        vectors = vectors.copy()
        for a, b in zip(starts, [*starts[1:], len(values)]):
            norm = float(np.linalg.norm(z[a:b]))
            if b - a == 1 or not norm:
                continue
            mirror = z[a:b].copy()
            mirror[0] += math.copysign(norm, mirror[0])
            mirror /= np.linalg.norm(mirror)
            vectors[:, a:b] -= 2 * np.outer(vectors[:, a:b] @ mirror, mirror)
            first = -math.copysign(norm, z[a])
            z[a:b] = 0
            z[a] = first
    live = np.abs(z) * math.sqrt(reach) > small
    live &= np.isin(np.arange(len(values)), starts)
    if not live.any():
        return values, vectors
    d, weights = values[live], z[live]
    roots, away = secular_roots(d, weights)
    # Weights for which the roots are exact; with them the eigenvectors are orthogonal.
    apart = d[None, :] - d[:, None]
    np.fill_diagonal(apart, 1)
    logs = np.log(np.abs(away)).sum(0) - np.log(np.abs(apart)).sum(1)
    exact = np.copysign(np.exp(logs / 2), weights)
    turn = exact[:, None] / -away.T
    turn /= np.linalg.norm(turn, axis=0)
    values, out = values.copy(), vectors.copy()
    values[live] = roots
    out[:, live] = vectors[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], out[:, order]


class Spectrum:
    """Number, exact sums, mean and spectrum of the centred scatter of vectors."""

    def __init__(self, dim: int):
        self.n, self.sums, self.mean = 0, np.zeros(dim, object), np.zeros(dim)
        self.values, self.vectors = np.zeros(dim), np.eye(dim)

    def _apart(self, n: int, mean: np.ndarray) -> None:
        """The update for the distance of the means."""
        if self.n and n:
            self.update(math.sqrt(self.n / (self.n + n) * n) * (mean - self.mean))
        self.n += n
        self.mean = self.mean + (n / self.n) * (mean - self.mean)

    def update(self, x: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, x)

    def add(self, block: np.ndarray) -> None:
        """Vectors of whole numbers join."""
        sums = block.sum(0, dtype=object) if np.abs(block).max() > 2 ** 40 else block.sum(0)
        mean = np.array([int(s) / len(block) for s in sums])
        centred = block - mean
        if len(block) > 1:
            rows = centred if len(block) <= block.shape[1] else np.linalg.qr(centred, mode="r")
            for row in rows:
                self.update(row)
        self.sums = self.sums + np.array([int(s) for s in sums], object)
        self._apart(len(block), mean)

    def merge(self, n: int, sums, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> None:
        for value, vector in zip(values, vectors.T):
            if value > 0:
                self.update(math.sqrt(value) * vector)
        self.sums = self.sums + np.array([int(s) for s in sums], object)
        self._apart(n, mean)

    def row(self, part: int) -> pa.RecordBatch:
        from decimal import Decimal

        return pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([self.n]), pa.array([[Decimal(int(s)) for s in self.sums]], pa.list_(pa.decimal128(38, 0))),
             pa.array([self.mean.tolist()]), pa.array([self.values.tolist()]), pa.array([self.vectors.ravel().tolist()])],
            names=["part", "n", "sums", "mean", "values", "vectors"])


def _matrix(column) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def whole_vectors(embeddings: DataFrame, id_column: str, column: str) -> DataFrame:
    """``id, x`` of the rows that remain, ``x`` = floor(1024 * c) + 100000 of each entry."""
    kept = embeddings.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= F.lit(LARGEST))))
    lengths = kept.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).first()
    size = lengths["size"] if lengths else 0
    return kept.where(F.size("v") == size).select(
        "id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT)).alias("x")), size


def combined_spectrum(x: DataFrame, dim: int, fold: int = FOLD, fan: int = FAN) -> Spectrum:
    """The spectrum of the vectors in column ``x``."""
    def read(batches):
        whole = Spectrum(dim)
        for batch in batches:
            block = _matrix(batch.column(0))
            for a in range(0, len(block), fold):
                whole.add(block[a:a + fold])
        if whole.n:
            yield whole.row(0)

    def meet(table: pa.Table) -> pa.Table:
        whole = Spectrum(dim)
        for r in table.sort_by("part").to_pylist():
            whole.merge(r["n"], r["sums"], np.array(r["mean"]), np.array(r["values"]), np.array(r["vectors"]).reshape(dim, dim))
        return pa.Table.from_batches([whole.row(0)])

    # A row for each task; its number is that of the task, however often it is asked for.
    parts = cut_lineage(x.mapInArrow(read, _SPECTRUM).withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)))
    count = parts.count()
    while count > 1:
        dealt = parts.withColumn("part", F.col("part").cast("long")).withColumn("node", F.floor(F.col("part") / fan))
        met = dealt.groupBy("node").applyInArrow(lambda key, table: meet(table).set_column(0, "part", pa.array([key[0].as_py()])), _SPECTRUM)
        parts, before = cut_lineage(met), count
        count = parts.count()
        if count == before:  # numbers of tasks that read nothing leave gaps: deal closer
            fan *= fan
    whole, row = Spectrum(dim), parts.first()
    if row:
        whole.n, whole.sums, whole.mean = row.n, np.array([int(s) for s in row.sums], object), np.array(row["mean"])
        whole.values, whole.vectors = np.array(row["values"]), np.array(row.vectors).reshape(dim, dim)
    return whole


def _deviations(block: np.ndarray, n: int, sums: np.ndarray, largest: int) -> np.ndarray:
    """n * x - S, exactly: as 64-bit numbers where they and their squares' sum fit, else as Python's."""
    if 2 * n * largest < 2 ** 62:
        return block * n - np.array(sums, np.int64)
    return block.astype(object) * n - sums


def _products(x: DataFrame, project, dim: int) -> np.ndarray:
    """The sum over all rows of y y', y being the row's projection and a last entry of 1."""
    def run(batches):
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            y = project(_matrix(batch.column(0)))
            y = np.hstack([y, np.ones((len(y), 1))])
            total += y.T @ y
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "value"])

    rows = x.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros((dim + 1) ** 2)
    total[rows.column("at").to_numpy()] = rows.column("value").to_numpy()
    return total.reshape(dim + 1, dim + 1)


def whiten(embeddings: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = 8,
           fold: int = FOLD) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and component.

    Rows whose vector is null or empty, holds a null, NaN, an infinite entry or one beyond
    ``LARGEST``, or has another length than most vectors (of equally common lengths the
    greater counts) are left out.  Each entry c becomes x = floor(1024 * c) + 100000; n
    vectors have the sums S.  ``deviation`` is the exact sum of (n * x - S)^2, null where
    it exceeds 64 bits; ``whitened`` is x - S / n along the component, over the root of its
    variance e; ``explained`` is e over the trace of the covariance; ``identity_error`` is
    the largest distance of the whitened rows' covariance from the identity, measured over
    all rows.  Components are numbered by falling variance; those without variance have
    no rows, so equal vectors alone, one vector or an empty table give none.  Repeated rows
    count and return as often as they occur, a null id is kept; other columns are ignored.
    """
    x, dim = whole_vectors(embeddings, id_column, column)
    schema = f"{id_column} {dict(embeddings.dtypes)[id_column]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dim:
        return embeddings.sparkSession.createDataFrame([], schema)
    x = cut_lineage(x)
    spectrum = combined_spectrum(x.select("x"), dim, fold)
    n, sums = spectrum.n, spectrum.sums
    largest = int(x.agg(F.max(F.array_max(F.transform("x", lambda c: F.abs(c))))).first()[0])
    basis = spectrum.vectors

    def centred(block):
        return _deviations(block, n, sums, largest).astype(float) / n

    # Rayleigh-Ritz over the whole basis: the covariance of the projections, nearly diagonal.
    total = _products(x.select("x"), lambda block: centred(block) @ basis, dim)
    off = total[-1, :-1] / n
    ritz = total[:-1, :-1] / n - np.outer(off, off)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    trace = float(values.sum())
    order = np.argsort(-values)[:components]
    order = order[values[order] > dim * 16 * _EPS * max(values.max(), 0)]
    if not len(order):
        return embeddings.sparkSession.createDataFrame([], schema)
    axes = basis @ turn[:, order] / np.sqrt(values[order])
    explained = values[order] / trace
    check = _products(x.select("x"), lambda block: centred(block) @ axes, len(order))
    off = check[-1, :-1] / n
    error = float(np.abs(check[:-1, :-1] / n - np.outer(off, off) - np.eye(len(order))).max())
    k = len(order)

    def run(batches):
        for batch in batches:
            apart = _deviations(_matrix(batch.column(1)), n, sums, largest)
            top = int(np.abs(apart).max(initial=0))
            squares = (apart * apart).sum(1) if top * top * dim < 2 ** 63 else (apart.astype(object) ** 2).sum(1)
            squares = [int(s) if s < 2 ** 63 else None for s in squares]
            rows = len(squares)
            at = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, n)), pa.array(squares, pa.int64()).take(pa.array(at)),
                 pa.array(((apart.astype(float) / n) @ axes).ravel()), pa.array(np.tile(explained, rows)),
                 pa.array(np.full(rows * k, error))],
                names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, schema)
