"""Text vectors: hashed bag of words, replaceable by the caller's own model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.functions.text import text_slices
from lorespan.session import run_once, spread

DIM = 256
_TOKEN = re.compile(r"[^\W_]+")
#: Bytes of text made into vectors at a time.
_SLICE_BYTES = 2 * 1024 * 1024
#: Tokens whose bucket a task remembers.
_KNOWN_TOKENS = 100_000


def bucket_of(token: str, dim: int) -> int:
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % dim


class _Slots(dict):
    """Token to bucket, filled on first use."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= _KNOWN_TOKENS:
            self.clear()
        slot = self[token] = bucket_of(token, self.dim)
        return slot


def hashed_words(dim: int = DIM) -> Callable[[Column], Column]:
    """Token counts in ``dim`` hash buckets, scaled to unit length.

    Runs beside the scan: one row in, one row out, no shuffle.
    """

    @F.arrow_udf("array<float>")
    def vector(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slots = _Slots(dim)

        def counted(text):
            tokens = _TOKEN.findall(text.lower())
            return np.bincount(np.fromiter(map(slots.__getitem__, tokens), np.int64, len(tokens)), minlength=dim)

        for batch in batches:
            for texts in text_slices(batch, _SLICE_BYTES):
                counts = np.zeros((len(texts), dim))
                for row, text in enumerate(texts.to_pylist()):
                    if text is not None:
                        counts[row] = counted(text)
                norms = np.sqrt(np.einsum("ij,ij->i", counts, counts))
                rows = (counts / np.where(norms == 0, 1.0, norms)[:, None]).astype(np.float32)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), dim).cast(pa.list_(pa.float32()))
                missing = texts.is_null()
                yield pc.if_else(missing, pa.scalar(None, flat.type), flat) if texts.null_count else flat

    return run_once(vector)


def embed(text: Column, dim: int = DIM, model: Callable[[Column], Column] | None = None) -> Column:
    """``model`` is any column function giving ``array<float>``."""
    return (model or hashed_words(dim))(text)


def with_vectors(df: DataFrame, text: str = "text", name: str = "vec", dim: int = DIM,
                 model: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add the vector of a text column, with small inputs shared out first."""
    return spread(df).withColumn(name, embed(F.col(text), dim, model))


def cosine(a: Column, b: Column) -> Column:
    """Row-wise cosine; 0 for a zero vector, shorter length wins in the product."""
    def norm(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    size = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, size), F.slice(b, 1, size),
                          lambda x, y: x.cast("double") * y.cast("double"))
    dot = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot / scale)
