"""Toxicity grades by cumulative-link ordinal regression on the words of a text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm.labelled import SAMPLE_ROWS, labelled_sample

GRADES = 3
#: Words of the model, at most; least documents and least z-score of a word.
WORDS, LEAST_DOCUMENTS, LEAST_Z = 2000, 3, 5.0
#: A word counts toward the severity of a training document when so large a part of its documents is toxic.
MARKER_RATE = 0.5
#: Beginnings of words, in letters, that are features beside the words.
BEGINNINGS = (4, 5, 6)
LETTERS = re.compile(r"[^\W\d_]+").findall


def text_features(words: list[str]) -> set[str]:
    """The distinct words, and the beginnings of longer ones marked by a star."""
    found = set(words)
    for n in BEGINNINGS:
        found |= {w[:n] + "*" for w in found if len(w) > n and w[-1] != "*"}
    return found


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade >= k) = sigmoid(weights . x - thresholds[k - 1]); the weights serve all thresholds."""

    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -30, 30)))

    def score(self, text: str) -> float:
        words = self.words
        return float(sum(self.weights[words[w]] for w in text_features(LETTERS(text.lower())) if w in words))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, width: int,
                ridge: float = 0.02, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient steps with adapted rates.

    ``rows, columns`` place the ones of a sparse 0/1 matrix; ``grades`` has 0 to
    ``GRADES``.  Thresholds stay ordered as the first plus positive gaps.
    """
    n = max(len(grades), 1)
    share = [(np.sum(grades >= k) + 0.5) / (n + 1) for k in range(1, GRADES + 1)]
    start = -np.log(np.array(share) / (1 - np.array(share)))
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    params = np.concatenate([np.zeros(width), start[:1], gaps])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w, t = params[:width], np.append(params[width], params[width] + np.cumsum(np.exp(params[width + 1:])))
        scores = np.bincount(rows, w[columns], minlength=len(grades))
        cdf = 1 / (1 + np.exp(-np.clip(t[None, :] - scores[:, None], -30, 30)))  # P(grade <= k - 1)
        bounds = np.concatenate([np.zeros((len(grades), 1)), cdf, np.ones((len(grades), 1))], axis=1)
        slope = np.concatenate([np.zeros((len(grades), 1)), cdf * (1 - cdf), np.zeros((len(grades), 1))], axis=1)
        i = np.arange(len(grades))
        p = np.maximum(bounds[i, grades + 1] - bounds[i, grades], 1e-9)
        by_score = (slope[i, grades + 1] - slope[i, grades]) / p  # of the loss, toward the score
        by_t = np.zeros(GRADES)
        for k in range(GRADES):
            upper, lower = grades == k, grades == k + 1
            by_t[k] = np.sum(-slope[upper, k + 1] / p[upper]) + np.sum(slope[lower, k + 1] / p[lower])
        gradient = np.concatenate([
            np.bincount(columns, by_score[rows], minlength=width) / n + ridge / 100 * w,
            [by_t.sum() / n], np.exp(params[width + 1:]) * np.cumsum(by_t[::-1])[::-1][1:] / n])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient ** 2
        params -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return params[:width], np.append(params[width], params[width] + np.cumsum(np.exp(params[width + 1:])))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, skip: int = 0) -> OrdinalModel:
    """Fit on at most ``rows`` labelled documents.

    The labels say toxic or not; the grade of a toxic document is how many of its
    distinct words have a marker, 1 to ``GRADES``, a marker being a feature of which at least half
    the documents are toxic.  The driver gets the word counts that pass the
    significance test, at most ``WORDS``, and the places of those words.
    """
    sample = labelled_sample(docs, labels, "toxic", rows, skip).select("doc_id", "text", "target")

    def count(batches):
        for batch in batches:
            n, toxic = Counter(), Counter()
            for text, target in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text_features(LETTERS((text or "").lower()))
                n.update(words)
                if target:
                    toxic.update(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()),
                 pa.array([toxic[w] for w in n], pa.int64())], names=["word", "n", "toxic"])

    sizes = sample.agg(F.count("*"), F.sum("target")).first()
    total, positive = sizes[0], sizes[1] or 0
    base = (positive + 0.5) / (total + 1)
    counts = (sample.mapInArrow(count, "word string, n long, toxic long").groupBy("word")
              .agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
              .where(F.col("n") >= LEAST_DOCUMENTS)
              .withColumn("z", F.expr(f"(toxic - n * {base}D) / sqrt(n * {base}D * (1 - {base}D))"))
              .where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "word").limit(WORDS).collect())
    words = {r["word"]: i for i, r in enumerate(counts)}
    markers = {r["word"] for r in counts if r["z"] > 0 and r["toxic"] >= MARKER_RATE * r["n"]}

    def place(batches):
        for batch in batches:
            found, grades = [], []
            for text, target in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                all_words = LETTERS((text or "").lower())
                used = text_features(all_words)
                found.append(sorted({words[w] for w in used if w in words}))
                marked = sum(not markers.isdisjoint(text_features([w])) for w in set(all_words)) if target else 0
                grades.append(min(GRADES, max(1, marked)) if target else 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())), pa.array(grades, pa.int64())], names=["found", "grade"])

    got = sample.mapInArrow(place, "found array<int>, grade long").toPandas()
    lengths = np.array([len(x) for x in got["found"]], np.int64)
    columns = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in got["found"])])
    weights, thresholds = fit_ordinal(np.repeat(np.arange(len(got)), lengths), columns,
                                      got["grade"].to_numpy(np.int64), len(words))
    return OrdinalModel(words, weights, thresholds)


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5,
                    rows: int = SAMPLE_ROWS, skip: int = 0) -> DataFrame:
    """One row per document: ``expected_severity`` (0 to ``GRADES``), the likeliest grade, and ``toxic``.

    Null and empty text have no words and so the severity of the thresholds alone;
    repeated rows give repeated results; other columns are ignored; with no toxic
    label nothing is toxic.
    """
    model = train(docs, labels, rows, skip)

    def run(batches):
        for batch in batches:
            scores = np.array([model.score(t or "") for t in batch.column(1).to_pylist()])
            above = model.above(scores)
            each = -np.diff(np.concatenate([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.round(above.sum(axis=1), 6)),
                 pa.array(each.argmax(axis=1).astype(np.int64)), pa.array(np.round(above[:, 0], 6)),
                 pa.array(above[:, 0] >= threshold)],
                names=["doc_id", "expected_severity", "grade", "toxic_score", "toxic"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, expected_severity double, grade long, toxic_score double, toxic boolean")
