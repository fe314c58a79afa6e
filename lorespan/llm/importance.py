"""Resampling of documents towards a target text by hashed n-gram weights.

Features are runs of words, hashed into buckets.  What a bucket gains, the logarithm of
its share in the target over its share in the corpus, is an array of one number a bucket, so
a document is scored by looking up its features and adding up.  Each document's weight
gets noise of its own from its id (Gumbel), and the highest scores are drawn: that is a sample
without replacement in which chances follow the weights.

The cutoff is found without sorting the corpus.  A quantile sketch of the scores, summed
up from all tasks, gives a bracket that should hold the cutoff; the exact counts above and
inside it tell whether it does, and if not it is widened on the side that missed.  Only the
rows in the bracket are sorted.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm.textarrays import row_slices, utf8
from lorespan.operators.ordering import number_rows
from lorespan.session import cut_lineage

BUCKETS = 10_000
#: Size of the quantile sketch; its ranks err by about 1.7 / SKETCH.
SKETCH = 2000
#: Share of the rows that the first bracket spans on each side of the expected cutoff.
BRACKET = 0.004
#: Bytes of text split into words at a time, but for longer single texts.
SLICE_BYTES = 1024 * 1024

#: ASCII letters in lower case and digits stay, other ASCII becomes a space, all beyond belongs to words.
_WORD_BYTES = bytes(c if c > 127 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def feature_buckets(column, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every feature, the row offsets of the features, and the words of each row."""
    data, offsets = utf8(column)
    found, counts, words_in = [np.zeros(0, np.int64)], [], []
    for a, b in row_slices(offsets, SLICE_BYTES):
        text = data[offsets[a]:offsets[b]].tobytes().translate(_WORD_BYTES)
        for i in range(a, b):
            words = text[offsets[i] - offsets[a]:offsets[i + 1] - offsets[a]].split()
            words_in.append(len(words))
            n = 0
            for size in range(1, longest + 1):
                runs = words if size == 1 else [b" ".join(words[j:j + size]) for j in range(len(words) - size + 1)]
                found.append(np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % buckets)
                n += len(runs)
            counts.append(n)
    return np.concatenate(found), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64), np.array(words_in, np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """Features of the column ``text`` in each bucket; one row a bucket and task is shuffled."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(feature_buckets(batch.column(0), buckets, longest)[0], minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(buckets, np.int64)
    total[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return total


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's share in the target over that in the corpus, one added to each count."""
    s, t, k = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k))))
                     for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def _scored(docs: DataFrame, gains: np.ndarray, longest: int, seed: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, no_id, row`` of each row, written once."""
    def run(batches):
        for batch in batches:
            buckets, offsets, words = feature_buckets(batch.column(1), len(gains), longest)
            sums = np.concatenate([[0], np.cumsum(gains[buckets])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(np.diff(offsets)), pa.array(sums[offsets[1:]] - sums[offsets[:-1]])],
                names=["doc_id", "n_words", "n_features", "weight"])

    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((noise.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")
    made = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return cut_lineage(made.withColumn("score", F.col("weight") + gumbel).withColumn("no_id", F.col("doc_id").isNull())
                       .withColumn("row", F.monotonically_increasing_id()))


def find_cutoff(scored: DataFrame, draw: int, total: int, bracket: float = BRACKET) -> tuple[int, int, int]:
    """``low, high, above``: scores that bracket the ``draw``-th highest of ``total`` rows, and how many rows lie above.

    Exact counts validate it: fewer than ``draw`` rows are above, as many or more are not below.
    """
    def counts(low, high):
        row = scored.agg(F.count_if(F.col("score") > high).alias("above"), F.count_if(F.col("score") >= low).alias("down")).first()
        return row.above, row.down

    sketch = scored.agg(F.kll_sketch_agg_bigint("score", F.lit(SKETCH)).alias("s"), F.min("score").alias("low"), F.max("score").alias("high"))
    ranks = lambda share: [min(1.0, max(0.0, 1 - draw / total + side * share)) for side in (-1, 1)]
    at = lambda share: sketch.select("low", "high", *(
        F.kll_sketch_get_quantile_bigint("s", F.lit(float(r))).alias(c) for r, c in zip(ranks(share), "ab"))).first()
    row = at(bracket)
    low, high, share = row.a, row.b, bracket
    while True:
        above, down = counts(low, high)
        if above < draw <= down:
            break
        # The missed side moves to a quantile farther away, at last to the end of the scores.
        share = max(4 * share, 1 / SKETCH)
        row = at(share)
        if above >= draw:
            low, high = high + 1, row.high if share >= 1 else max(row.b, high + 1)
        else:
            low, high = row.low if share >= 1 else min(row.a, low - 1), low - 1
    return low, high, above


#: Highest score first, then the smaller id, none last; equal rows in any order.
ORDER = ["down", "no_id", "doc_id", "n_features", "row"]


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = BUCKETS,
             longest: int = 1, seed: int = 2024, bracket: float = BRACKET) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``.

    Features are all runs of 1 to ``longest`` words of the lower-cased text (ASCII letters,
    digits and all beyond ASCII), repeats counted, in ``buckets`` buckets.  Of the rows with
    ``least_words`` words or more, the ``percent`` of 100 (rounded down) with the highest
    scores are drawn and ranked from 1; ``rank`` is null elsewhere.  Ties go to the smaller
    id, then to fewer features; rows without an id share the noise of an empty id and come after
    others of their score.  A null or empty text has no features and weight 0; texts of any
    length are read whole; repeated rows are rows of their own; other columns are ignored; an
    empty table gives no row, an empty target still gives weights.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gains = bucket_gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = _scored(docs, gains, longest, seed)
    columns = ["doc_id", "n_features", "weight", "score"]
    undrawn = lambda rows: rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    able = scored.where(F.col("n_words") >= least_words)
    total = able.count()
    draw = percent * total // 100
    if not draw:
        return undrawn(scored)
    low, high, above = find_cutoff(able, draw, total, bracket)
    down = able.withColumn("down", -F.col("score"))
    top = number_rows(down.where(F.col("score") > high), "rank", ORDER).select(*columns, "rank")
    inside = number_rows(down.where((F.col("score") >= low) & (F.col("score") <= high)), "place", ORDER).select(
        *columns, F.when(F.col("place") <= draw - above, F.col("place") + above).alias("rank"))
    return top.unionByName(inside).unionByName(undrawn(scored.where((F.col("n_words") < least_words) | (F.col("score") < low))))
