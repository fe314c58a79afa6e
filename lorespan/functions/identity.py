"""Document and chunk identity."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespan.fixed_values import CHUNK_ID_HASH_CHARS


def plain_path(path: Column) -> Column:
    """Drop a ``file:`` scheme so paths read the same from every reader."""
    return F.regexp_replace(path, "^file:/*(?=/)", "")


def doc_id(path: Column, root: str) -> Column:
    """``file:`` plus the path below ``root``, or the whole path outside it."""
    prefix = "^" + re.escape(root.rstrip("/") + "/")
    return F.concat(F.lit("file:"), F.regexp_replace(path, prefix, ""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case text after the last dot; empty when there is none."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def stem(name: Column) -> Column:
    """Name without its last suffix; a leading dot is part of the stem."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def title_from_name(name: Column) -> Column:
    return F.replace(stem(name), F.lit("_"), F.lit(" "))


def chunk_id(doc: Column, index: Column, content_hash: Column) -> Column:
    return F.concat(doc, F.lit(":chunk:"), index.cast("string"), F.lit(":"),
                    F.left(content_hash, F.lit(CHUNK_ID_HASH_CHARS)))
