import math

import numpy as np
import pytest

from lorespan.llm.whitening import Spectrum, combined_spectrum, rank_one, secular_roots, whiten, whole_vectors


def test_secular_roots_are_the_eigenvalues():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64):
        d = np.sort(rng.normal(size=n)) * 10.0 ** rng.integers(-2, 6)
        z = rng.normal(size=n) + .01
        roots, away = secular_roots(d, z)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        assert np.allclose(roots, want, rtol=1e-12, atol=1e-12 * abs(want).max())
        assert np.allclose(away, roots[:, None] - d, atol=1e-9 * abs(want).max()) and (np.tril(away) >= 0).all()


@pytest.mark.parametrize("dim", [1, 2, 9, 40])
def test_updates_with_deflation(dim):
    rng = np.random.default_rng(dim)
    values, vectors, matrix = np.zeros(dim), np.eye(dim), np.zeros((dim, dim))
    repeated = rng.normal(size=dim)
    for i in range(120):
        x = repeated if i % 5 == 0 else rng.normal(size=dim) * (rng.random(dim) < .4) if i % 5 < 3 else np.eye(dim)[i % dim]
        matrix += np.outer(x, x)
        values, vectors = rank_one(values, vectors, x)
        assert np.abs(vectors.T @ vectors - np.eye(dim)).max() < 1e-11 and (np.diff(values) >= 0).all()
    assert np.abs(vectors @ np.diag(values) @ vectors.T - matrix).max() < 1e-11 * np.abs(matrix).max()


@pytest.mark.parametrize("fold", [1, 7, 4096])
def test_spectra_of_tasks_combine(spark, fold):
    rng = np.random.default_rng(2)
    rows = (rng.normal(size=(900, 6)) @ rng.normal(size=(6, 6))).astype(float)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>").repartition(40)
    x, dim = whole_vectors(df, "vec_id", "embedding")
    got = combined_spectrum(x.select("x"), dim, fold, fan=3)
    whole = np.floor(rows * 1024) + 100000
    centred = whole - whole.mean(0)
    assert got.n == 900 and list(got.sums) == [int(s) for s in whole.sum(0)]
    scatter = centred.T @ centred
    assert np.abs(got.vectors @ np.diag(got.values) @ got.vectors.T - scatter).max() < 1e-10 * np.abs(scatter).max()


def brute(rows, k):
    """Per id: deviation and whitened coordinates up to sign, straight from the definition."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return ([sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x],
            centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum())


def check(spark, rows, extra=(), k=8):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in [*rows, *extra]], "vec_id long, embedding array<double>, n int, x int").repartition(7)
    got = whiten(df).toPandas()
    deviation, coordinates, explained = brute(rows, k)
    at = {i: j for j, (i, _) in enumerate(rows)}
    assert len(got) == len(rows) * coordinates.shape[1] and (got.n == len(rows)).all()
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-8
    for c, part in got.groupby("component"):
        order = [at[i] for i in part.vec_id]
        assert part.deviation.tolist() == [deviation[j] for j in order]
        want = coordinates[order, c - 1]
        sign = np.sign((part.whitened * want).sum())
        assert np.allclose(part.whitened, sign * want, rtol=1e-9, atol=1e-9)
        assert np.allclose(part.explained, explained[c - 1], rtol=1e-10)


def test_against_the_definition(spark):
    rng = np.random.default_rng(5)
    spread = rng.normal(size=(400, 12)) * np.linspace(.2, 3, 12)
    rows = [(i, v.tolist()) for i, v in enumerate(spread)] + [(1000 + i, spread[0].tolist()) for i in range(300)]
    bad = [(2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 10), (2003, [float("nan")] * 12),
           (2004, [float("inf")] + [0.0] * 11), (2005, [1.0, 2.0]), (2006, [1e200] * 12)]
    check(spark, rows, bad)


def test_few_entries_and_components_without_variance(spark):
    rng = np.random.default_rng(6)
    check(spark, [(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(50, 2)))])
    flat = [(i, [float(a), 1.0, 2.0]) for i, a in enumerate(rng.normal(size=30))]
    check(spark, flat, k=1)
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whiten(df).count() == 0 and whiten(df.limit(1)).count() == 0
    empty = whiten(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_sums_stay_exact(spark):
    rows = [(i, [(-1.0) ** i * 9e8 + i, float(i % 7)]) for i in range(200)]
    deviation, _, _ = brute(rows, 2)
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()
    assert {r.vec_id: r.deviation for r in got} == {i: (d if d < 2 ** 63 else None) for (i, _), d in zip(rows, deviation)}


def test_repeated_ids_and_null_ids_return(spark):
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [2.0, 0.0]), (3, [1.0, 4.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id int, embedding array<float>"))
    assert sorted(str(r.vec_id) for r in got.where("component = 1").collect()) == ["1", "1", "3", "None"]
    assert dict(got.dtypes)["vec_id"] == "int" and Spectrum(2).n == 0
