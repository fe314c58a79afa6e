"""Document quality by hierarchical empirical Bayes.

A logistic classifier of the text gives the evidence of each document.  Grouped sums of
that evidence give posteriors for hosts and for the paths below them: a host is shrunk
toward the global rate, a path toward its host, with prior weights estimated from the
spread between the groups, so sparse sites say little.  The decision adds what the path
tells about the document to the document's own evidence.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm.labelled import SAMPLE_ROWS, labelled_sample
from lorespan.llm.textarrays import utf8
from lorespan.session import cut_lineage

#: Log-odds beyond this count as this.
BOUND = 8.0
#: Least and greatest prior weight of a level, in documents.
WEIGHTS = (2.0, 1000.0)
N_FEATURES = 14

_CLASS = np.full(256, 5, np.uint8)  # 5: other signs
_CLASS[128:] = 0
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"?-()"]] = 4


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of text statistics per document."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES))
    for a in range(0, n, 256):
        edges = offsets[a:a + 257]
        part = data[edges[0]:edges[-1]]
        kinds = _CLASS[part]
        edges = edges - edges[0]
        counts = np.stack([np.append(0, np.cumsum(kinds == c, dtype=np.int64))[edges] for c in range(6)])
        counts = np.diff(counts, axis=1).T.astype(float)
        size = np.maximum(np.diff(edges), 1)[:, None]
        out[a:a + 256, :6] = counts / size
        out[a:a + 256, 6] = np.log1p(np.diff(edges)) / 10
        out[a:a + 256, 7] = np.minimum(np.diff(edges) / (counts[:, 3] + 1), 40) / 10
        raw = part.tobytes()
        for i, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            text = raw[s:e]
            lines, words = text.split(b"\n"), text.split()
            out[a + i, 8] = 1 - len(set(lines)) / len(lines)
            out[a + i, 9] = min(len(lines) * 100 / (e - s + 100), 5)
            out[a + i, 10] = sum(map(eq, words, words[1:])) / max(len(words), 1)
            out[a + i, 11] = 1 - len(set(words)) / max(len(words), 1)
    # A small share of odd signs, capitals or repeated words already tells much.
    out[:, 5], out[:, 1] = np.log1p(100 * out[:, 5]), np.log1p(20 * out[:, 1])
    out[:, 12] = np.log1p(50 * out[:, 10])
    out[:, 13] = 1
    return out


@dataclass(frozen=True)
class TextModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(((rows - self.mean) / self.scale) @ self.weights, -BOUND, BOUND)


def fit_logistic(rows: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> TextModel:
    """Newton's method with a ridge; the last feature is the constant."""
    if not len(rows):
        return TextModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES))
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    x, w = (rows - mean) / scale, np.zeros(rows.shape[1])
    penalty = np.full(rows.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (p - target) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return TextModel(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, skip: int = 0) -> TextModel:
    """Fit the text classifier on at most ``rows`` labelled documents; only their statistics reach the driver."""
    def run(batches):
        for batch in batches:
            made = features(*utf8(batch.column(0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(made), pa.list_(pa.float64())), batch.column(1)], names=["x", "target"])

    sample = labelled_sample(docs, labels, "quality", rows, skip).select("text", "target")
    got = sample.mapInArrow(run, "x array<double>, target long").toPandas()
    if not len(got):
        return fit_logistic(np.zeros((0, N_FEATURES)), np.zeros(0))
    return fit_logistic(np.stack(got["x"].to_numpy()), got["target"].to_numpy(float))


def with_evidence(docs: DataFrame, model: TextModel, columns: list[str], name: str) -> DataFrame:
    """``columns`` of the documents and the log-odds of their texts; an empty text says nothing."""
    text_at, read = len(columns), [*columns, "text"]
    if "row" in columns:  # the text is in there
        text_at, read = columns.index("row"), columns

    def run(batches):
        for batch in batches:
            text = batch.column(text_at)
            data, offsets = utf8(text.field("text") if pa.types.is_struct(text.type) else text)
            odds = model.log_odds(features(data, offsets))
            odds[np.diff(offsets) == 0] = 0.0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(columns)], pa.array(odds)], names=[*columns, name])

    schema = docs.select(columns).schema.add(name, "double")
    return docs.select(read).mapInArrow(run, schema)


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """``host, path, n, s, host_rate, path_weight, global_rate`` from ``host, path, p``."""
    low, high = WEIGHTS
    paths = cut_lineage(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn"), F.sum("hs"), F.sum(F.expr("hs * hs / hn"))).first()
    joined = paths.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    within = joined.agg(F.sum(F.expr("s * s / n - n * (hs / hn) * (hs / hn)"))).first()[0] or 0.0
    n, rate = total[0] or 1, (total[1] or 0.0) / (total[0] or 1)
    between = (total[2] or 0.0) / n - rate * rate
    # The spread of the group rates beyond the global rate gives each level's prior weight.
    weight = [min(max(rate * (1 - rate) / max(spread, 1e-6) - 1, low), high) for spread in (between, within / n)]
    rate = min(max(rate, 0.001), 0.999)
    return joined.select(
        "host", "path", "n", "s", F.lit(rate).alias("global_rate"), F.lit(weight[1]).alias("path_weight"),
        ((F.col("hs") + weight[0] * rate) / (F.col("hn") + weight[0])).alias("host_rate"))


def _decided(rows: DataFrame, sites: DataFrame, host: str, path: str, odds: str) -> DataFrame:
    sites = sites.withColumnsRenamed({c: f"_q_{c}" for c in sites.columns})
    out = rows.join(sites, rows[host].eqNullSafe(sites._q_host) & rows[path].eqNullSafe(sites._q_path), "left")
    # A document's own evidence is taken out of its site's.
    own = f"(1 / (1 + exp(-`{odds}`)))"
    site = f"greatest(_q_s - {own} + _q_path_weight * _q_host_rate, 1e-6) / (_q_n - 1 + _q_path_weight)"
    out = out.withColumn("_q_site", F.expr(f"least(greatest({site}, 0.001), 0.999)"))
    return out.withColumn("_q_score", F.expr(
        f"1 / (1 + exp(-(`{odds}` + ln(_q_site / (1 - _q_site)) - ln(_q_global_rate / (1 - _q_global_rate)))))"))


def quality_report(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
                   threshold: float = 0.5, rows: int = SAMPLE_ROWS, skip: int = 0) -> DataFrame:
    """One row per document: its own probability of quality, its site's, the joint score and ``keep``.

    Null or empty text has no evidence, so its site decides; a null host or path is a
    site of its own; repeated rows count as often as they occur; without labels every
    document has the score one half and stays; other columns are ignored.
    """
    model = train(docs, labels, rows, skip)
    named = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    scored = with_evidence(named, model, ["doc_id", "host", "path"], "odds")
    sites = site_posteriors(scored.withColumn("p", F.expr("1 / (1 + exp(-odds))")))
    out = _decided(scored, sites, "host", "path", "odds")
    return out.select("doc_id", F.round(F.expr("1 / (1 + exp(-odds))"), 6).alias("document_score"),
                      F.round("_q_site", 6).alias("site_score"), F.round("_q_score", 6).alias("quality_score"),
                      (F.col("_q_score") >= threshold - 1e-9).alias("keep"))


def keep_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
                 threshold: float = 0.5, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that the score keeps, with their columns."""
    model = train(docs, labels, rows)
    named = docs.select(F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text",
                        F.struct("*").alias("row"))
    sites = site_posteriors(with_evidence(named, model, ["host", "path"], "odds").withColumn("p", F.expr("1 / (1 + exp(-odds))")))
    scored = with_evidence(named, model, ["host", "path", "row"], "odds")
    return _decided(scored, sites, "host", "path", "odds").where(F.col("_q_score") >= threshold - 1e-9).select("row.*")
