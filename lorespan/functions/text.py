"""Text expressions.  Lengths are code points; white space is Unicode's."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lorespan.fixed_values import (
    DEFAULT_TITLE, MIN_LINE_CHARS, SUMMARY_CHARS, TITLE_CHARS,
)
from lorespan.session import run_once

# Every code point that counts as white space; the last one is U+3000.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def text_slices(texts: pa.Array, most: int = 4 * 1024 * 1024) -> Iterator[pa.Array]:
    """Neighbouring rows of up to ``most`` bytes, or one longer row, so that few become Python strings at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def strip(text: Column) -> Column:
    """Remove outer white space (one linear pass, no regular expression)."""
    return F.btrim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    """Every run of white space becomes one space; ends are stripped."""
    return strip(F.regexp_replace(text, _SPACE_RUN, " "))


@F.pandas_udf(StringType())
def _compatibility_form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(
            lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalize(text: Column) -> Column:
    """NFKC form with collapsed white space.

    Spark has no built-in for compatibility forms, so that step alone is an
    Arrow batch function.
    """
    return collapse(run_once(_compatibility_form)(text))


def map_characters(text: Column, source: str = "", target: str = "") -> Column:
    """Script conversion by a character table; identity without one."""
    return F.translate(text, source, target) if source else text


def fold_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def clean_lines(text: Column, min_chars: int = MIN_LINE_CHARS) -> Column:
    """Strip each line and keep those longer than ``min_chars``."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: F.length(x) > min_chars), "\n")


def _shorten(text: Column, size: int, fallback: str) -> Column:
    short = F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("...")))
    return F.coalesce(short, F.nullif(text, F.lit("")), F.lit(fallback))


def title_of(message: Column, size: int = TITLE_CHARS) -> Column:
    return _shorten(strip(message), size, DEFAULT_TITLE)


def summary_of(message: Column, size: int = SUMMARY_CHARS) -> Column:
    return _shorten(collapse(message), size, DEFAULT_TITLE)


def display_name(name: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(strip(name), F.lit("")), fallback.cast("string"))


def blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))
