"""N-gram Jaccard join with set relations: exact components of similar texts.

Texts become sets of hashed word shingles.  Equal sets are one.  Each set enters the
lists of its prefix: two similar sets share a shingle there.  The lists are read by
blocks: the entries of one list that belong to one group of highly similar sets.
A block that lies too late in the list, or is too large or small, is skipped whole.

A group has a centre, the set that most lists of its members name as their head.  The head
of a list is the member that stands with most others in all its lists, so a centre
follows no other and copies meet the text they come from.  The answers of the members follow from the centre's: a set that is far from the centre, farther than
the members' distance and the threshold together, is far from every member.  Distances
are first bounded by bitmaps, whose difference is never more than that of the sets, so
only near pairs are counted exactly.  Members of one group are never paired with each
other, unless one is not linked to its centre.

Shingles are compared by 64-bit hashes.  Shingles that stand in many texts come last
in the order of all prefixes; that choice only shortens lists.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm.components import components
from lorespan.llm.textarrays import gram_hashes, row_slices, utf8, word_hashes, words_of
from lorespan.session import cut_lineage

BLANKS = r"[\x20\x09-\x0D]+"
#: Shingles of this part of the texts come last in every prefix, the commonest at the end: at most twice the mean set size over it.
COMMON = 0.0002
#: Bytes of text hashed at a time.
SLICE_BYTES = 1024 * 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of spaced text.

    A text of fewer words is one shingle; one without words has none.
    """
    data, offsets = utf8(column)
    out = []
    for a, b in row_slices(offsets, SLICE_BYTES):
        part = _LOWER[data[offsets[a]:offsets[b]]]
        starts, ends, rows = words_of(part, offsets[a:b + 1] - offsets[a])
        words = word_hashes(part, starts, ends)
        grams = gram_hashes(words, size)
        for i, j in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if j - i >= size:
                out.append(np.unique(grams[i:j - size + 1]))
            else:
                out.append(gram_hashes(words[i:j], j - i) if j > i else np.zeros(0, np.uint64))
    return out


def bitmap(items: np.ndarray) -> bytes:
    """Parities of the items by their low bits; two bits an item or more, a power of two."""
    bits = max(64, 1 << (2 * len(items) - 1).bit_length())
    counts = np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


#: Places of the parities that two sets of one list are compared by where they meet.
PARITIES = 512


def parity(items: np.ndarray) -> np.ndarray:
    """Odd or even counts of the items in ``PARITIES`` hashed places, as 64-bit numbers."""
    counts = np.bincount((items % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def bitmap_distance(a: bytes, b: bytes) -> int:
    """At most the size of the symmetric difference; the longer bitmap is folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _overlap(na: str, nb: str, percent: int) -> str:
    """SQL for the least intersection of two linked sets of these sizes."""
    return f"(({percent} * ({na} + {nb}) + {99 + percent}) div {100 + percent})"


def _spaced(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("hash"),
                       F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, " ")).alias("text"))


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that stand in about ``COMMON`` of the texts, or more, and the place of each by its count.

    Each batch of rows reports the shingles that are that common in it; as a shingle
    common in all is common in some batch, the reports hold every such shingle.
    Their number is at most twice the mean set size over ``COMMON``, whatever the input.
    """
    def report(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(0), size)
            items, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            often = counts >= max(4, math.ceil(COMMON * len(sets)))
            yield pa.RecordBatch.from_arrays([pa.array(items[often].view(np.int64)), pa.array(counts[often])], names=["item", "n"])

    total = docs.count()
    rows = (_spaced(docs).select("text").mapInArrow(report, "item long, n long").groupBy("item").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= max(4, COMMON / 2 * total)).toArrow())
    items, counts = rows.column("item").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(items)
    items, counts = items[order], counts[order]
    places = np.empty(len(items), np.int64)
    places[np.lexsort((items, counts))] = np.arange(len(items))
    return items, places


def _profiles(docs: DataFrame, size: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``id, doc_id, hash, n, key, bits, parity, prefix`` of each row, written once."""
    often, places = common

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(2), size)
            keys, bits, odd, prefix = [], [], [], []
            for s in sets:
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bits.append(bitmap(s) if len(s) else None)
                odd.append(parity(s) if len(s) else None)
                length = len(s) - (percent * len(s) + 99) // 100 + 1 if len(s) else 0
                if len(often) and length:
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    late = often[at] == s
                    s = np.concatenate([s[~late], s[late][np.argsort(places[at[late]])]])
                prefix.append(s[:length].view(np.int64))
            lengths = np.array([len(p) for p in prefix], np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)),
                                             pa.array(np.concatenate([np.zeros(0, np.int64), *prefix])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(bits, pa.binary()), pa.array(odd, pa.list_(pa.int64())), lists],
                names=["doc_id", "hash", "n", "key", "bits", "parity", "prefix"])

    made = _spaced(docs).mapInArrow(run, "doc_id long, hash long, n long, key binary, bits binary, parity array<long>, prefix array<long>")
    return cut_lineage(made.withColumn("id", F.monotonically_increasing_id()))


def _near(pairs: DataFrame, sets: DataFrame, percent: int, slack: str = "0") -> DataFrame:
    """The ``a, b`` pairs whose bitmaps allow a link, given the slack of each pair."""
    side = lambda name: sets.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").withColumn(
        "most", F.expr(f"cast(n_a + n_b - 2 * {_overlap('n_a', 'n_b', percent)} + {slack} as long)"))

    def run(batches):
        for batch in batches:
            most = batch.column(2).to_numpy()
            far = [bitmap_distance(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(np.array(far, np.int64) <= most))

    return joined.where("most >= 0").select("a", "b", "most", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def _counted(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """``a, b, distance, linked`` of each pair, from the whole sets."""
    side = lambda name: items.select(F.col("id").alias(name), F.col("items").alias(f"items_{name}"))

    def run(batches):
        for batch in batches:
            distance, linked = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(x) + len(y) - len(np.union1d(x, y))
                distance.append(len(x) + len(y) - 2 * same)
                linked.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance, pa.int64()), pa.array(linked, pa.bool_())],
                                             names=["a", "b", "distance", "linked"])

    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "items_a", "items_b")
            .mapInArrow(run, "a long, b long, distance long, linked boolean"))


def _items(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``id, items`` of the sets in ``wanted`` (``id, doc_id, hash``), from their texts.

    Rows that repeat an id and a text are one set and give one row.
    """
    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "items"])

    wanted = wanted.select("id", F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash"))
    text = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    rows = text.join(wanted, text.doc_id.eqNullSafe(wanted._doc) & (text.hash == wanted._hash))
    rows = rows.groupBy("id").agg(F.min("text").alias("text"))  # equal texts: any of them
    rows = rows.select("id", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, " ")).alias("text"))
    return rows.mapInArrow(run, "id long, items binary")


def _alike(percent: int) -> str:
    """SQL for two sets of different components whose sizes allow a link."""
    return f"root_x <> root_y and 100 * n_x >= {percent} * n_y and 100 * n_y >= {percent} * n_x"


def _apart() -> str:
    """SQL for the places in which two sets' parities differ: they differ in as many shingles or more."""
    return "(" + " + ".join(f"bit_count(parity_x[{i}] ^ parity_y[{i}])" for i in range(PARITIES // 64)) + ")"


def _ordered() -> list:
    return [F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")]


def _entries(sets: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """``item, id, n, c, level, rest, parity`` of every prefix shingle that more than one set has, written once.

    ``c`` is the length of the list.  ``rest`` is the most that the set can share with another
    whose first common shingle this is.
    """
    places = prefixes.select("id", F.posexplode("prefix").alias("pos", "item"))
    shared = places.groupBy("item").agg(F.count("*").alias("c")).where("c > 1")
    # Most shingles stand in one set: only those that are shared meet the set's other columns.
    return cut_lineage(places.join(shared, "item").join(sets.select("id", "n", "parity"), "id").selectExpr(
        "item", "id", "n", "c", f"cast(floor(ln(n) / ln({100 / percent}D)) as int) as level", "n - pos as rest", "parity"))


def _meeting(entries: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, slack``: groups, by their centres, with blocks that meet in a list, and how much farther than a
    link centres of groups with linked members can be apart.

    Blocks of a list meet unless place or size forbids every pair between them, or, for two sets
    that are in no group, the parities of their shingle counts.
    """
    groups_of = (entries.join(groups, "id").groupBy("item", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"))
                 .withColumn("parity", F.lit(None).cast("array<long>")))
    alone = entries.join(groups, "id", "left_anti").select("item", F.col("id").alias("g"), F.col("n").alias("low"), F.col("n").alias("high"), "rest", "parity")
    blocks = groups_of.unionByName(alone)
    x, y = (blocks.select("item", *(F.col(c).alias(f"{c}_{s}") for c in ("g", "low", "high", "rest", "parity"))) for s in "xy")
    # The parities are those of sets without a group.
    met = (x.join(y, "item").where(f"""g_x < g_y and 100 * high_x >= {percent} * low_y and 100 * high_y >= {percent} * low_x
                 and least(rest_x, rest_y) >= {_overlap('low_x', 'low_y', percent)}
                 and coalesce({_apart()} <= low_x + low_y - 2 * {_overlap('low_x', 'low_y', percent)}, true)""")
           .select(F.col("g_x").alias("a"), F.col("g_y").alias("b")).distinct())
    # How far the members of a group can be from its centre, and how much larger; one row a group.
    reach = cut_lineage(groups.join(sets.select("id", "n"), "id").join(sets.select(F.col("id").alias("g"), F.col("n").alias("m")), "g")
                        .groupBy("g").agg(F.expr(f"max(n + m - 2 * {_overlap('n', 'm', percent)}) + greatest(max(n - m), 0)").alias("reach")))
    side = lambda s: reach.select(F.col("g").alias(s), F.col("reach").alias(f"reach_{s}"))
    # What is allowed grows with the sizes, but for rounding by less than 2.
    return met.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
        "a", "b", F.expr("2 + coalesce(reach_a, 0) + coalesce(reach_b, 0)").alias("slack"))


def _open_pairs(known: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """Pairs of members, of groups that have met and are not connected, that the distances leave open.

    |x - z| is at least the distance of the centres less those of the members.
    """
    spans = known.groupBy("g").agg(F.max("delta").alias("far"), F.max("n").alias("high"), F.count("*").alias("size"),
                                   F.max(F.when(F.col("id") == F.col("g"), F.col("root"))).alias("root"))
    ends = lambda s: spans.select(*(F.col(c).alias(f"{c}_{s}") for c in ("g", "far", "high", "size", "root")))
    pairs = cut_lineage(met.select(F.col("a").alias("g_x"), F.col("b").alias("g_y"), "distance").distinct()
                        .join(ends("x"), "g_x").join(ends("y"), "g_y").where("root_x <> root_y and size_x + size_y > 2").drop("root_x", "root_y"))
    # First the members of either group that can be near the other group at all, then their pairs.
    reaches = "distance - delta_{0} - far_{1} <= 2 + n_{0} + high_{1} - 2 * " + _overlap("n_{0}", "high_{1}", percent)
    of = lambda s: known.select(*(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "g", "root", "delta", "parity")))
    x = of("x").join(pairs, "g_x").where(reaches.format("x", "y")).select("g_x", "g_y", "distance", "id_x", "n_x", "root_x", "delta_x", "parity_x")
    y = of("y").join(pairs, "g_y").where(reaches.format("y", "x")).select("g_x", "g_y", "id_y", "n_y", "root_y", "delta_y", "parity_y")
    return x.join(y, ["g_x", "g_y"]).where(
        f"{_alike(percent)} and greatest(distance - delta_x - delta_y, {_apart()}) <= n_x + n_y - 2 * {_overlap('n_x', 'n_y', percent)}").select(*_ordered())


def similar_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each document.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of
    ``size``-word shingles (words parted by ASCII white space, A-Z in lower case).  The
    component is named by its smallest ``doc_id``.  A document without words links with
    nothing; rows with one id are documents of their own; a null id never names a
    component of others; other columns are ignored; an empty table gives no row.
    """
    rows = similar_rows(docs, size, percent)
    linked = rows.where("n_shingles > 0")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return linked.join(least, "root").select("doc_id", "n_shingles", "component_id").unionByName(
        rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def similar_rows(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, hash, n_shingles, root`` of each row: its text's hash, and a number of its component.

    Rows without words have no number.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _profiles(docs, size, percent, common_shingles(docs, size))
    first = rows.where("n > 0").groupBy("key").agg(F.min("id").alias("id"))
    sets = cut_lineage(rows.select("id", "doc_id", "hash", "n", "bits", "parity").join(first.select("id"), "id", "left_semi"))
    # Prefixes, the largest column, are written with the rows alone.
    entries = _entries(sets, rows.select("id", "prefix").join(sets.select("id"), "id", "left_semi"), percent)
    parities = sets.select("id", "parity")
    sets = sets.drop("parity")
    ids = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("id"))

    # Centres: the set that most of a set's lists have as their head, among those of about its size.
    met = entries.groupBy("id").agg(F.sum("c").alias("met"))
    heads = entries.join(met, "id").groupBy("item", "level").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("b"))
    named = (entries.join(heads, ["item", "level"]).where("id <> b").groupBy("id", "b").count()
             .groupBy("id").agg(F.max_by("b", F.struct(F.col("count"), -F.col("b"))).alias("b")).select(F.col("id").alias("a"), "b"))
    stars = cut_lineage(_near(named, sets, percent))
    # Who follows another is no centre; its followers stay groups of their own.
    roots = cut_lineage(stars.join(stars.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b"))
    groups = roots.select(F.col("a").alias("id"), F.col("b").alias("g"))

    met = cut_lineage(_near(_meeting(entries, groups, sets, percent), sets, percent, "slack"))
    items = cut_lineage(_items(docs, sets.join(ids(stars).unionByName(ids(met)).distinct(), "id", "left_semi"), size))
    counted = cut_lineage(_counted(stars.unionByName(met).distinct(), items, percent))
    root = components(counted.where("linked").select("a", "b"))

    # Members answer for themselves where their centre's answer leaves it open and nothing connects them yet.
    delta = groups.select(F.col("id").alias("a"), F.col("g").alias("b")).join(counted, ["a", "b"]).select(
        F.col("a").alias("id"), F.col("distance").alias("delta"), F.col("linked").alias("near_centre"))
    known = cut_lineage(entries.select("id", "n").distinct().join(parities, "id")
                        .join(groups, "id", "left").join(root, "id", "left").join(delta, "id", "left")
                        .select("id", "n", "parity", F.coalesce("g", "id").alias("g"), F.coalesce("root", "id").alias("root"),
                                F.coalesce("delta", F.lit(0)).alias("delta"), F.coalesce("near_centre", F.lit(True)).alias("near_centre")))
    more = _open_pairs(known, met.join(counted, ["a", "b"]).select("a", "b", "distance"), percent)
    # A member that is not linked to its centre does not share the centre's answers.
    p, q = (known.select("id", "root", "near_centre").join(entries, "id").select(
        "item", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "rest", "parity", "root", "near_centre"))) for s in "xy")
    more = more.unionByName(p.where("not near_centre_x").join(q, "item").where(
        f"id_x <> id_y and {_alike(percent)} and least(rest_x, rest_y) >= {_overlap('n_x', 'n_y', percent)} and {_apart()} <= n_x + n_y - 2 * {_overlap('n_x', 'n_y', percent)}").select(*_ordered())).distinct()
    more = more.join(counted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = cut_lineage(_near(more, sets, percent))
    if not more.isEmpty():
        missing = cut_lineage(sets.join(ids(more).distinct(), "id", "left_semi").join(items.select("id"), "id", "left_anti"))
        if not missing.isEmpty():
            items = items.unionByName(_items(docs, missing, size))
        links = cut_lineage(_counted(more, items, percent).where("linked").select("a", "b"))
        if not links.isEmpty():
            # Only the components that the new links join are joined again.
            at = lambda name: known.select(F.col("id").alias(name), F.col("root").alias(f"root_{name}"))
            joined = components(links.join(at("a"), "a").join(at("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
            root = known.select("id", "root").join(joined.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select(
                "id", F.coalesce("top", "root").alias("root"))

    names = rows.where("n > 0").join(first.withColumnRenamed("id", "set_id"), "key").join(
        root.select(F.col("id").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    return names.select("doc_id", "hash", F.col("n").alias("n_shingles"), "root").unionByName(
        rows.where("n = 0").select("doc_id", "hash", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("root")))
