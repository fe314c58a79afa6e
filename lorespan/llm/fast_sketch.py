"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``BANDS * ROWS`` coordinates.  In round after round every shingle of a set
is placed by a fresh hash into one of the coordinates, with a value; a coordinate keeps
the least value of the first round that reached it.  After as many rounds as there are
coordinates, those still empty take the least value over the whole set, one round each,
so every coordinate fills.  Two sets agree in a coordinate with the probability of their
similarity, and the number of coordinates in which they agree is concentrated as if
they were drawn one by one, also for sets of a few shingles.

``ROWS`` coordinates make a band.  Sets at a similarity of 0.85 have no equal band with
probability (1 - 0.85^8)^64, about 1.4e-9.  Sets with an equal band are candidates:

* Each set is verified against one centre: of the heads of its bands' buckets the one it
  shares most bands with.  The head of a bucket is the member that shares bands with most
  sets, so copies of one text meet that text and not each other.
* What the verified links connect needs no further look.  A set of which more shingles
  than a link allows are in no other set that is still open has no more links either.
* The other candidates of different components are verified on their full sets, unless
  the parities of hashed shingle counts already differ in more places than a link allows.

Nothing is capped: a bucket of any size is summed up in each task before the shuffle,
and no set travels more than once for each candidate of it that is verified.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm.components import components
from lorespan.llm.jaccard_join import BLANKS, shingle_sets
from lorespan.llm.textarrays import mix
from lorespan.session import cut_lineage

BANDS, ROWS = 64, 8
#: Shingles placed at a time; a larger set is placed alone.
PLACE_ITEMS = 200_000
#: Places of the parities that bound how far two candidates differ.
PARITIES = 1024
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _salt(k: int) -> np.uint64:
    return np.uint64(k * int(_STEP) & 0xFFFFFFFFFFFFFFFF)


def fast_sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` coordinates for each non-empty set of hashes."""
    out = np.zeros((len(sets), size), np.uint64)
    lengths = np.array([len(s) for s in sets], np.int64)
    a = 0
    while a < len(sets):
        b = max(a + 1, int(np.searchsorted(np.cumsum(lengths[a:]), PLACE_ITEMS, "right")) + a)
        out[a:b] = _placed(sets[a:b], lengths[a:b], size)
        a = b
    return out


def _placed(sets: list[np.ndarray], lengths: np.ndarray, size: int) -> np.ndarray:
    """Rounds of placement over several sets at once; a set leaves when its sketch is full."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    table = np.full(len(sets) * size, empty)
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    shift = np.uint64(32)
    for k in range(size):
        hashed = mix(items + _salt(k + 1))
        # High bits choose the coordinate, all bits are the value; one of an earlier round stays.
        cell = owner * size + ((hashed >> shift) * np.uint64(size) >> shift).astype(np.int64)
        free = table[cell] == empty
        np.minimum.at(table, cell[free], mix(hashed[free]) & ~np.uint64(1))
        full = (table.reshape(-1, size) != empty).all(axis=1)
        stays = ~full[owner]
        items, owner = items[stays], owner[stays]
        if not len(items):
            break
    else:
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = owner[starts]
        for k in range(size):
            gaps = table[rows * size + k] == empty
            if gaps.any():
                least = np.minimum.reduceat(mix(mix(items + _salt(size + k + 1))) & ~np.uint64(1), starts)
                table[rows[gaps] * size + k] = least[gaps]
    return table.reshape(-1, size)


def band_keys(sketches: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of each sketch; bands of different places never share keys but by chance."""
    parts = sketches.reshape(len(sketches), bands, -1)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _STEP, parts.shape[:2])
    for j in range(parts.shape[2]):
        keys = mix(keys * _STEP + parts[:, :, j])
    return keys


def _spaced(column: str = "text"):
    return F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), BLANKS, " "))


def _profiles(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, hash, n, key, bands, id`` of each row, written once."""
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(2), size)
            filled = [s for s in sets if len(s)]
            keys = iter(band_keys(fast_sketches(filled, BANDS * ROWS)).view(np.int64)) if filled else iter(())
            bands = [next(keys) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "hash", "n", "key", "bands"])

    made = docs.select("doc_id", F.xxhash64("text").alias("hash"), _spaced().alias("text")).mapInArrow(
        run, "doc_id long, hash long, n long, key binary, bands array<long>")
    return cut_lineage(made.withColumn("id", F.monotonically_increasing_id()))


def _items(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``id, items`` of the sets in ``wanted`` (``id, doc_id, hash``); rows that repeat an id and a text count once."""
    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "items"])

    wanted = wanted.select("id", F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash"))
    text = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    rows = text.join(wanted, text.doc_id.eqNullSafe(wanted._doc) & (text.hash == wanted._hash))
    # Repeats of a row are the same set; the least of equal texts is any of them.
    rows = rows.groupBy("id").agg(F.min("text").alias("text"))
    return rows.select("id", _spaced().alias("text")).mapInArrow(run, "id long, items binary")


def _verified(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The ``a, b`` pairs whose full sets are similar enough."""
    side = lambda name: items.select(F.col("id").alias(name), F.col("items").alias(f"items_{name}"))

    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(100 * same >= percent * (len(both) - same))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "items_a", "items_b")
            .mapInArrow(run, "a long, b long"))


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _rooted(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Entries with the ``root`` of their set; a set without links is its own."""
    return entries.join(components(links), "id", "left").withColumn("root", F.coalesce("root", "id"))


def near_duplicate_sets(rows: DataFrame, docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``key, set_id`` of every distinct set and the ``a, b`` links that connect sets."""
    first = rows.where("n > 0").groupBy("key").agg(F.min("id").alias("id"))
    sets = rows.join(first.select("id"), "id", "left_semi").select("id", "doc_id", "hash", "n", "bands")
    entries = sets.select("id", "n", F.explode("bands").alias("band"))
    # Buckets of one set end here.
    shared = entries.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    entries = cut_lineage(entries.join(shared, "band"))
    sets = sets.drop("bands")

    # Each set meets the head it shares most bands with.
    known = entries.groupBy("id").agg(F.sum("c").alias("met"))
    heads = entries.join(known, "id").groupBy("band").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("head"))
    best = (entries.select("band", "id").join(heads, "band").where("id <> head").groupBy("id", "head").count()
            .groupBy("id").agg(F.max_by("head", F.struct("count", -F.col("head"))).alias("head")))
    stars = cut_lineage(best.select(*_ordered("id", "head")).distinct())
    items = cut_lineage(_items(docs, sets.join(known, "id", "left_semi"), size))
    links = cut_lineage(_verified(stars, items, percent))

    # Buckets that hold more than one component stay open.
    entries = _rooted(entries.select("band", "id", "n"), links)
    mixed = entries.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    entries = cut_lineage(entries.join(mixed.select("band"), "band", "left_semi"))
    open_sets = entries.select("id", "n").distinct()
    spread = items.join(open_sets.select("id"), "id", "left_semi").mapInArrow(_spread, "id long, item long")
    alone = (spread.groupBy("item").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1")
             .groupBy("id").agg(F.count("*").alias("alone")))
    able = (open_sets.join(alone, "id", "left").withColumn("rest", F.col("n") - F.coalesce("alone", F.lit(0)))
            .where(f"100 * rest >= {percent} * n").select("id", "rest")
            .join(items.mapInArrow(_parities, "id long, bits array<long>"), "id"))
    entries = cut_lineage(entries.join(able, "id"))
    p, q = (entries.select("band", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "root", "rest", "bits"))) for s in "xy")
    least = f"(({percent} * (n_x + n_y) + {99 + percent}) div {100 + percent})"  # shingles that two linked sets share
    differ = " + ".join(f"bit_count(bits_x[{i}] ^ bits_y[{i}])" for i in range(PARITIES // 64))
    left = p.join(q, "band").where(f"""id_x < id_y and root_x <> root_y and 100 * n_x >= {percent} * n_y and 100 * n_y >= {percent} * n_x
        and least(rest_x, rest_y) >= {least} and {differ} <= n_x + n_y - 2 * {least}""").select(*_ordered("id_x", "id_y")).distinct()
    more = cut_lineage(_verified(left.join(stars, ["a", "b"], "left_anti"), items, percent))
    return first.withColumnRenamed("id", "set_id"), links.unionByName(more)


def _spread(batches):
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        for a in range(0, len(sets), 256):
            part = sets[a:a + 256]
            ids = np.repeat(batch.column(0).to_numpy()[a:a + 256], [len(s) for s in part])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(part))], names=["id", "item"])


def _parities(batches):
    """How often each of ``PARITIES`` hashed places occurs in a set, odd or even: sets differ in a
    shingle or more for each place in which these differ."""
    for batch in batches:
        bits = []
        for x in batch.column(1):
            places = (np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(PARITIES)).astype(np.int64)
            odd = (np.bincount(places, minlength=PARITIES) & 1).astype(np.uint8)
            bits.append(np.packbits(odd, bitorder="little").view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.list_(pa.int64()))], names=["id", "bits"])


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each document.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of
    ``size``-word shingles (words parted by ASCII white space, A-Z in lower case).  The
    component is named by its smallest ``doc_id``, the one that is kept.  A text of fewer
    words is one shingle; a null or empty text, or one of white space only, links with
    nothing and is kept.  Texts of any length are read whole.  Rows that repeat an id are
    documents of their own with one id, so all of them are kept or none; a row without
    an id never names the component of others, and is kept where no other has an id.
    Other columns are ignored; an empty table gives no row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _profiles(docs, size)
    first, links = near_duplicate_sets(rows, docs, size, percent)
    root = components(links)
    named = (rows.where("n > 0").select("doc_id", "n", "key").join(first, "key")
             .join(root.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
