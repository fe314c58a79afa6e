import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespan.llm.quality import keep_quality, quality_report, site_posteriors
from lorespan.llm.toxicity import GRADES, fit_ordinal, toxicity_report
from lorespan.session import load_table

DATA = "/root/testdata/sf0.1"


def held_out(labels, skip):
    return labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(10)) < skip)


def test_quality_on_held_out_labels(spark):
    docs, labels = load_table(spark, DATA, "documents"), load_table(spark, DATA, "labels")
    report = quality_report(docs, labels, skip=3)
    counts = {(r.quality, r.keep): r["count"] for r in report.join(held_out(labels, 3), "doc_id").groupBy("quality", "keep").count().collect()}
    assert counts[1, True] / (counts[1, True] + counts.get((1, False), 0)) > .995
    assert counts[0, False] / (counts[0, False] + counts.get((0, True), 0)) > .95


def test_toxicity_on_held_out_labels(spark):
    docs, labels = load_table(spark, DATA, "documents"), load_table(spark, DATA, "labels")
    report = toxicity_report(docs, labels, skip=3).withColumnRenamed("toxic", "flag")
    rows = report.join(held_out(labels, 3), "doc_id").groupBy("toxic", "flag").agg(
        F.count("*").alias("n"), F.avg("expected_severity").alias("severity")).collect()
    n = {(r.toxic, r.flag): r.n for r in rows}
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) > .99
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > .8
    severity = {(r.toxic, r.flag): r.severity for r in rows}
    assert severity[1, True] > 1 > severity[0, False]


def test_ordinal_fit_recovers_the_model():
    rng = np.random.default_rng(3)
    x = rng.random((6000, 5)) < .3
    weights, thresholds = np.array([3.0, 2.0, 0.0, -1.0, 1.0]), np.array([1.0, 2.5, 4.0])
    above = 1 / (1 + np.exp(-(x @ weights)[:, None] + thresholds[None, :]))
    grades = (rng.random((6000, 1)) < above).sum(axis=1)
    rows, columns = np.nonzero(x)
    w, t = fit_ordinal(rows, columns, grades, 5)
    assert np.abs(w - weights).max() < .35 and np.abs(t - thresholds).max() < .35 and (np.diff(t) > 0).all() and len(t) == GRADES


def test_sparse_sites_shrink_more(spark):
    rows = [("a", "x", .9)] * 400 + [("b", "x", .1)] * 400 + [("c", "x", .0)] * 2 + [(None, None, .5)] * 3 + [("a", "y", .0)] * 1
    sites = {(r.host, r.path): r for r in site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert len(sites) == 5 and sites[None, None].n == 3
    rate = sites["a", "x"].global_rate
    assert math.isclose(rate, sum(r[2] for r in rows) / len(rows), rel_tol=1e-9)
    assert abs(sites["b", "x"].host_rate - .1) < .05 and sites["c", "x"].host_rate > 0.05
    assert sites["a", "y"].host_rate == sites["a", "x"].host_rate


def small(spark):
    rows = [(i, "Plain words and more plain words. " * (1 + i % 5), "h" if i % 3 else None, "en", i) for i in range(60)]
    rows += [(100 + i, "$$$ *** %%% junk### " * (1 + i % 5), "h", None, i) for i in range(60)] + [(900, None, "h", "en", 0), (901, "", None, None, 0), (0, "Plain words again.", "h", "en", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, odds int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100 + i, 0, i % 2) for i in range(30)] + [(3, None, None), (None, 1, 1), (5, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_edge_cases(spark):
    docs, labels = small(spark)
    report = quality_report(docs, labels).collect()
    assert len(report) == docs.count() and all(r.keep == (r.doc_id < 100) for r in report if r.doc_id < 900)
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect() if r.doc_id < 900} == set(range(60))
    none = labels.limit(0)
    assert all(r.keep for r in quality_report(docs, none).collect())
    assert quality_report(docs.limit(0), labels).count() == 0 and keep_quality(docs.limit(0), labels).count() == 0


def test_toxicity_edge_cases(spark):
    docs, labels = small(spark)
    report = toxicity_report(docs, labels).collect()
    assert len(report) == docs.count()
    for r in report:
        assert 0 <= r.expected_severity <= GRADES and 0 <= r.grade <= GRADES
    assert not any(r.toxic for r in toxicity_report(docs, labels.limit(0)).collect())
    assert toxicity_report(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("seed", [0])
def test_marked_texts_are_toxic(spark, seed):
    rows = [(i, f"some usual words number {i} " + ("you idiot and moron" if i % 4 == 0 else "you friend")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    assert all(r.toxic == (r.doc_id % 4 == 0) for r in toxicity_report(docs, labels).collect())
