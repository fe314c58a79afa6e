"""Query preparation: normal form, dictionary expansion, fan-out, intent."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespan.fixed_values import INTENT_DEFAULT, INTENT_RULES, MAX_EXPANSIONS
from lorespan.functions.text import map_characters, normalize, strip
from lorespan.operators.ordering import keep_first
from lorespan.session import spread

INLINE_KEYS = 2_000
KEYS_BROADCAST_BYTES = 32 * 1024 * 1024
#: Characters of keywords that one automaton may hold: about 28 bytes each in every worker.
AUTOMATON_CHARACTERS = 2_000_000
# A keyword is looked up by its first characters: the longest of these lengths it has.
_GRAMS = (1, 2, 3, 8)


def dictionary_table(spark, entries: Iterable[tuple[str, Sequence[str]]]) -> DataFrame:
    """Ordered synonym table from ``(keyword, synonyms)`` pairs."""
    rows = [(i, k, list(s)) for i, (k, s) in enumerate(entries)]
    return spark.createDataFrame(rows, "key_order int, keyword string, synonyms array<string>")


def usable_entries(dictionary: DataFrame) -> DataFrame:
    """Entries that can say something: a keyword (the empty one is in every text) and
    synonyms, nulls among them left out."""
    known = dictionary.where(F.col("keyword").isNotNull() & F.col("synonyms").isNotNull())
    return known.withColumn("synonyms", F.array_compact("synonyms"))


# Tied entries are read in the order of keyword and synonyms.
_ENTRY_ORDER = ("key_order", "keyword", "synonyms")


def expand_inline(text: Column, entries: Sequence[tuple[str, Sequence[str]]],
                  m: int = MAX_EXPANSIONS) -> Column:
    """Expansions as one expression over a constant array; no join, no shuffle."""
    if not entries:
        return F.array().cast("array<string>")
    table = F.array(*[
        F.struct(F.lower(F.lit(k)).alias("k"),
                 F.array(*[F.lit(s) for s in syns[:m]]).cast("array<string>").alias("s"))
        for k, syns in entries])
    # The outer array has one element: it lower-cases the text once, not once per keyword.
    matched = F.transform(F.array(F.lower(text)),
                          lambda low: F.filter(table, lambda d: F.contains(low, d["k"])))[0]
    synonyms = F.flatten(F.transform(matched, lambda d: d["s"]))
    candidates = F.transform(synonyms, lambda s: strip(F.concat(text, F.lit(" "), s)))
    return F.slice(F.array_distinct(F.filter(candidates, lambda c: c != text)), 1, m)


class _Keywords:
    """Keywords as one automaton, built once in each worker from the shared list."""

    def __init__(self, words: list[str]):
        self.words, self.built = words, None

    def __getstate__(self):
        return {"words": self.words, "built": None}

    def found(self, text: str) -> list[int]:
        """The distinct places, in the list, of the keywords that ``text`` contains."""
        if self.built is None:
            self.built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, word in enumerate(self.words):
                if word:
                    self.built.add_word(word, i)
            self.built.make_automaton()
        # The list is sorted, so the empty keyword, which every text contains, is the first.
        always = [0] if self.words and not self.words[0] else []
        return always + sorted({i for _, i in self.built.iter(text)} if len(self.built) else ())


def match_dictionary(queries: DataFrame, dictionary: DataFrame,
                     automaton_characters: int = AUTOMATON_CHARACTERS) -> DataFrame:
    """``(query_id, q, key_order, keyword, synonyms)`` for each keyword contained in ``q``.

    Keywords whose measured length allows it travel to the texts as one automaton, which
    reads each text once, whatever the number of keywords; more are joined on their first
    characters.  Both compare in lower case; the empty keyword is in every text, a null
    text contains nothing, and entries with one keyword all match.
    """
    keys = usable_entries(dictionary).withColumn("_k", F.lower("keyword"))
    held = keys.agg(F.sum(F.length("_k") + 1)).first()[0] or 0
    if held > automaton_characters:
        return match_by_grams(queries, dictionary)
    words = sorted(r["_k"] for r in keys.select("_k").distinct().collect())  # of checked length
    shared = queries.sparkSession.sparkContext.broadcast(_Keywords(words))
    schema = T.StructType([queries.schema["query_id"], queries.schema["q"],
                           T.StructField("_at", T.ArrayType(T.IntegerType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            places = [keywords.found(text) if text is not None else [] for text in texts]
            kept = pa.array(np.flatnonzero([bool(p) for p in places]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(kept), batch.column(1).take(kept),
                 pa.array([p for p in places if p], pa.list_(pa.int32()))], names=["query_id", "q", "_at"])

    met = spread(queries).select("query_id", "q", F.lower("q").alias("_low")).mapInArrow(scan, schema)
    numbers = queries.sparkSession.createDataFrame(
        pa.table({"_k": pa.array(words, pa.string()), "_at": pa.array(range(len(words)), pa.int32())}))
    # As many entries as the keywords, with synonyms: shared where those are small too.
    entries = keys.join(F.broadcast(numbers), "_k")
    used = keys.agg(F.sum(F.octet_length(F.to_json("synonyms")))).first()[0] or 0
    entries = F.broadcast(entries) if used + 4 * held <= KEYS_BROADCAST_BYTES else entries.hint("merge")
    return (met.select("query_id", "q", F.explode("_at").alias("_at")).join(entries, "_at")
            .select("query_id", "q", "key_order", "keyword", "synonyms"))


def match_by_grams(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``match_dictionary`` for dictionaries too large for one automaton.

    A containment join without a product of both sides: a keyword can only be
    contained where the text holds its first characters, so ids and keywords meet
    on those, and the full test follows on the few pairs that met.
    """
    keyword = F.lower("keyword")
    size = F.length(keyword)
    length = F.lit(0)
    for n in _GRAMS:
        length = F.when(size >= n, n).otherwise(length)
    keys = (usable_entries(dictionary).withColumn("_k", keyword).withColumn("_length", length)
            .withColumn("_gram", F.left("_k", F.col("_length"))))
    used = keys.groupBy("_length").agg(F.sum(
        F.octet_length("_k") + F.octet_length(F.to_json("synonyms"))).alias("bytes")).collect()  # a row for each length
    # Spark takes the exploded grams for small; say which side really is, once measured.
    small = sum(r["bytes"] or 0 for r in used) <= KEYS_BROADCAST_BYTES
    keys = keys.drop("_length")
    keys = F.broadcast(keys) if small else keys.hint("merge")
    # A look-ahead gives the overlapping grams of a text in one pass over it; the empty
    # keyword meets every text.
    grams = F.array_distinct(F.concat(F.array().cast("array<string>"), *[
        F.regexp_extract_all(F.lower("q"), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) if n else F.array(F.lit(""))
        for n in sorted(r["_length"] for r in used)]))
    # The text itself stays behind: it would be copied once per gram.
    met = (spread(queries).select("query_id", F.explode(grams).alias("_gram"))
           .join(keys, "_gram").drop("_gram"))
    return (met.join(queries.select("query_id", "q"), "query_id")
            .where(F.contains(F.lower("q"), F.col("_k")))
            .select("query_id", "q", "key_order", "keyword", "synonyms"))


def expand_joined(queries: DataFrame, dictionary: DataFrame, m: int = MAX_EXPANSIONS) -> DataFrame:
    """``(query_id, variant ≥ 1, q)`` for a dictionary of any size."""
    matched = match_dictionary(queries, dictionary)
    candidates = (matched
                  .select("query_id", "q", *_ENTRY_ORDER,
                          F.posexplode(F.slice("synonyms", 1, m)).alias("syn_pos", "syn"))
                  .withColumn("candidate", strip(F.concat("q", F.lit(" "), "syn")))
                  .where("candidate <> q"))
    order = [*map(F.col, _ENTRY_ORDER), F.col("syn_pos")]
    distinct = keep_first(candidates, ["query_id", "candidate"], order)
    return (keep_first(distinct, ["query_id"], order, m, "variant")
            .select("query_id", "variant", F.col("candidate").alias("q")))


def normal_form(text: Column, charmap: tuple[str, str] | None = None) -> Column:
    """Script conversion first, then compatibility form, then white space."""
    return normalize(map_characters(text, *(charmap or ("", ""))))


def prepare_queries(queries: DataFrame, dictionary: DataFrame,
                    charmap: tuple[str, str] | None = None, m: int = MAX_EXPANSIONS,
                    inline_keys: int = INLINE_KEYS) -> DataFrame:
    """``(query_id, variant, q)``: the normal form, then at most ``m`` expansions.

    A dictionary of checked size is folded into one expression; a larger one is joined.
    """
    base = spread(queries).select("query_id", normal_form(F.col("text"), charmap).alias("q"))
    rows = usable_entries(dictionary).orderBy(*_ENTRY_ORDER).limit(inline_keys + 1).collect()
    if len(rows) <= inline_keys:
        entries = [(r["keyword"], r["synonyms"]) for r in rows]
        variants = F.concat(F.array("q"), expand_inline(F.col("q"), entries, m))
        return base.select("query_id", F.posexplode(variants).alias("variant", "q"))
    first = base.select("query_id", F.lit(0).alias("variant"), "q")
    return first.unionByName(expand_joined(base, dictionary, m))


def intent_of(text: Column, rules=INTENT_RULES, default: str = INTENT_DEFAULT) -> Column:
    """Label of the first rule with a keyword inside the lower-cased text."""
    def choose(lowered: Column) -> Column:
        chain = F.when(F.lit(False), default)
        for label, keywords in rules:
            hit = F.lit(False)
            for word in keywords:
                hit = hit | F.contains(lowered, F.lit(word))
            chain = chain.when(hit, label)
        return chain.otherwise(default)

    # One element: the text is lower-cased once, not once per keyword.
    return F.transform(F.array(F.lower(text)), choose)[0]


def label_intent(queries: DataFrame, rules=INTENT_RULES, default: str = INTENT_DEFAULT,
                 text: str = "text") -> DataFrame:
    return spread(queries).withColumn("intent", intent_of(F.col(text), rules, default))
