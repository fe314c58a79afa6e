"""Texts as lossless WebP images in a media column, read back with features."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorespan.llm.textarrays import row_slices, utf8
from lorespan.llm.webp import load_many, store

UNIT = 64
#: Payload bytes that a task holds at a time.
BYTES = 8 * 1024 * 1024
SCHEMA = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
          "media_bytes long, media_sha256 string, feature string")


def describe(payload: bytes, images: list[np.ndarray]) -> str:
    """Size, frames, mean of each channel and number of distinct samples of the decoded images."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, 4)
    means = samples.sum(axis=0, dtype=np.int64) * 100 // len(samples)
    height, width = sum(i.shape[0] for i in images), images[0].shape[1]
    distinct = int(np.count_nonzero(np.bincount(samples.reshape(-1), minlength=256)))
    return f"{width}x{height};frames={len(images)};mean={','.join(map(str, means))};samples={distinct}"


def media_columns(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Store each text as an image, decode the stored bytes, and describe what came back.

    The payload is the UTF-8 text, null as empty, filled with zero bytes to a positive
    multiple of 64.  ``media`` is the file.  Equal texts give equal values; a null
    ``doc_id`` stays null; other columns are ignored; an empty table gives no row.
    """
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in row_slices(offsets, BYTES):
                sizes = np.diff(offsets[a:b + 1])
                raw = data[offsets[a]:offsets[b]].tobytes()
                edges = (offsets[a:b + 1] - offsets[a]).tolist()
                files = []
                for s, e in zip(edges[:-1], edges[1:]):
                    files.append(store(raw[s:e] + bytes(-(e - s) % UNIT if e > s else UNIT)))
                back = load_many(files)
                columns = [
                    batch.column(0).slice(a, b - a), pa.array(sizes),
                    pa.array([len(p) for p, _ in back], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p, _ in back]),
                    pa.array([zlib.crc32(p[-UNIT:]) for p, _ in back], pa.int64()),
                    pa.array([len(f) for f in files], pa.int64()),
                    pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                    pa.array([describe(*x) for x in back])]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                if with_media:
                    columns.append(pa.array(files, pa.binary()))
                    names.append("media")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA + ", media binary" * with_media)
