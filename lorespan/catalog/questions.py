"""Query preparation, retrieval, contexts and prompts."""

from pyspark.sql import functions as F

from lorespan.catalog.chunk_sql import chunk_ctes
from lorespan.catalog.sql import collapse, similarities, word_vectors
from lorespan.fixed_values import INTENT_DEFAULT, INTENT_RULES
from lorespan.functions.embedding import embed
from lorespan.functions.text import normalize
from lorespan.operators.chunking import chunk
from lorespan.operators.querytext import (
    dictionary_table, expand_joined, label_intent, match_dictionary, normal_form, prepare_queries,
)
from lorespan.operators.retrieval import render_context, retrieve
from lorespan.plans.retrieval import prompts_for
from lorespan.session import cut_lineage, load_table

# A small user dictionary in words of the test tables; "and" shadows "than".
DICTIONARY = (
    ("and", ["with the", "of it"]),
    ("THAN", ["rather than", "then"]),
    ("dans", ["avec", "pour", "sur"]),
    ("und", ["die", "und", "der"]),
    ("que", ["los que", "para"]),
)
CHARMAP = ("éèê", "eee")
TEMPLATE = "Question: {input}\nReferences:\n{context}\nAnswer from the references only."


def _questions(spark, d):
    """Benchmark passages and all messages as questions."""
    bench = load_table(spark, d, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id")).alias("query_id"), "text")
    said = load_table(spark, d, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("query_id"), "text")
    return bench.unionByName(said)


_QUESTIONS = """
    SELECT 'b' || item_id AS query_id, text FROM benchmark
    UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations"""


def normalized_questions(spark, d):
    return _questions(spark, d).select("query_id", normalize(F.col("text")).alias("q"))


NORMALIZED_SQL = f"SELECT query_id, {collapse('text')} AS q FROM ({_QUESTIONS})"


def query_variants(spark, d):
    return _variants(prepare_queries(_questions(spark, d), dictionary_table(spark, DICTIONARY), CHARMAP))


def query_variants_joined(spark, d):
    """The same through the dictionary join, for dictionaries of any size."""
    return _variants(prepare_queries(
        _questions(spark, d), dictionary_table(spark, DICTIONARY), CHARMAP, inline_keys=0))


def _variants(df):
    return df.select("query_id", F.col("variant").cast("long").alias("variant"), "q")


def _dictionary_sql():
    rows = ", ".join(
        "({}, '{}', [{}])".format(i, k, ", ".join(f"'{s}'" for s in syn))
        for i, (k, syn) in enumerate(DICTIONARY))
    return f"(VALUES {rows}) d(key_order, keyword, synonyms)"


def _variant_ctes(source):
    return f"""
    base AS (SELECT query_id, {collapse(f"translate(text, '{CHARMAP[0]}', '{CHARMAP[1]}')")} AS q FROM ({source})),
    cand AS (SELECT query_id, q, key_order, p, {collapse("q || ' ' || synonyms[p]")} AS c
             FROM base JOIN {_dictionary_sql()} ON contains(lower(q), lower(keyword)),
                  range(1, 3) AS g(p) WHERE p <= len(synonyms)),
    uniq AS (SELECT query_id, c, min(key_order * 10 + p) AS o FROM cand WHERE c <> q GROUP BY 1, 2),
    ranked AS (SELECT query_id, c, row_number() OVER (PARTITION BY query_id ORDER BY o) AS variant FROM uniq),
    variants AS (SELECT query_id, 0 AS variant, q FROM base
                 UNION ALL SELECT query_id, variant, c FROM ranked WHERE variant <= 2)"""


VARIANTS_SQL = f"WITH {_variant_ctes(_QUESTIONS)} SELECT query_id, variant, q FROM variants"


def synonym_expansions(spark, d):
    base = _questions(spark, d).select("query_id", normal_form(F.col("text"), CHARMAP).alias("q"))
    return _variants(expand_joined(base, dictionary_table(spark, DICTIONARY)))


EXPANSIONS_SQL = f"WITH {_variant_ctes(_QUESTIONS)} SELECT query_id, variant, q FROM variants WHERE variant > 0"


def dictionary_matches(spark, d):
    found = match_dictionary(_questions(spark, d).withColumnRenamed("text", "q"),
                             dictionary_table(spark, DICTIONARY))
    return found.select("query_id", F.col("key_order").cast("long").alias("key_order"), "keyword")


MATCHES_SQL = f"""
SELECT query_id, key_order, keyword FROM ({_QUESTIONS}) JOIN {_dictionary_sql()}
ON contains(lower(text), lower(keyword))
"""


def intent_labels(spark, d):
    docs = load_table(spark, d, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("query_id"), "text")
    return label_intent(_questions(spark, d).unionByName(docs)).select("query_id", "intent")


def _intent_sql():
    cases = " ".join(
        "WHEN {} THEN '{}'".format(" OR ".join(f"contains(lower(text), '{k}')" for k in words), label)
        for label, words in INTENT_RULES)
    return f"""
    SELECT query_id, CASE {cases} ELSE '{INTENT_DEFAULT}' END AS intent
    FROM ({_QUESTIONS} UNION ALL SELECT 'd' || doc_id, text FROM documents)"""


def _passages(spark, d):
    return load_table(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"), "text", "lang", "source")


def _asked(spark, d):
    return load_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def retrieved_documents(spark, d):
    variants = prepare_queries(_asked(spark, d), dictionary_table(spark, DICTIONARY), CHARMAP)
    docs = retrieve(variants, _passages(spark, d))
    return docs.select("query_id", F.col("n").cast("long").alias("n"), F.col("item_id").alias("doc_id"),
                       F.col("variant").cast("long").alias("variant"),
                       F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("similarity"))


def _retrieved_ctes(passages):
    """CTE ``n`` with the numbered passages of each question, from ``passages(item_id, text, …)``."""
    return f"""
{_variant_ctes("SELECT item_id AS query_id, text FROM benchmark")},
passage AS ({passages}),
{word_vectors("v", "SELECT item_id AS id, text FROM passage")},
{word_vectors("q", "SELECT query_id * 10 + variant AS id, q AS text FROM variants")},
{similarities("s", "q", "v")},
r AS (SELECT q // 10 AS query_id, q % 10 AS variant, i AS item_id, score,
             row_number() OVER (PARTITION BY q ORDER BY score DESC, i) AS rank FROM s),
t AS (SELECT r.*, p.* EXCLUDE (item_id),
             row_number() OVER (PARTITION BY query_id, left(p.text, 100) ORDER BY variant, rank) AS copy
      FROM r JOIN passage p USING (item_id) WHERE rank <= 6),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY variant, rank) AS n FROM t WHERE copy = 1)"""


_RETRIEVED = "WITH " + _retrieved_ctes("SELECT doc_id AS item_id, text, lang, source FROM documents")
RETRIEVED_SQL = _RETRIEVED + """
SELECT query_id, n, item_id AS doc_id, variant, rank, round(score, 4) AS similarity FROM n
"""


def rendered_contexts(spark, d):
    variants = prepare_queries(_asked(spark, d), dictionary_table(spark, DICTIONARY), CHARMAP)
    return render_context(retrieve(variants, _passages(spark, d)), ["lang", "source"])


def _context_cte(first, second):
    return f""",
c AS (SELECT query_id, count(*) AS n_refs,
             string_agg('[Reference ' || n || '] Content: ' || text || ' | Metadata: {{"{first}":"' || {first}
                        || '","{second}":"' || {second} || '"}}' || chr(10), '' ORDER BY n) AS context
      FROM n GROUP BY 1)
"""


_CONTEXTS = _RETRIEVED + _context_cte("lang", "source")
CONTEXTS_SQL = _CONTEXTS + "SELECT query_id, n_refs, context FROM c"


def filled_prompts(spark, d):
    return prompts_for(_asked(spark, d), _passages(spark, d), dictionary_table(spark, DICTIONARY),
                       TEMPLATE, charmap=CHARMAP, metadata=["lang", "source"])


_PROMPTS = """
SELECT item_id AS query_id, coalesce(n_refs, 0) AS n_refs,
       'Question: ' || text || chr(10) || 'References:' || chr(10) || coalesce(context, '') || chr(10)
       || 'Answer from the references only.' AS prompt
FROM benchmark LEFT JOIN c ON query_id = item_id
"""
PROMPTS_SQL = _CONTEXTS + _PROMPTS


def chunk_prompts(spark, d):
    """Documents to chunks to prompts, with the benchmark passages as questions."""
    docs = load_table(spark, d, "documents").select(
        F.concat(F.lit("file:doc/"), F.col("doc_id")).alias("doc_id"),
        F.sha2("text", 256).alias("hash"), "text", "source")
    # The chunk table is written once, as an index would hold it.
    passages = cut_lineage(chunk(docs).select(
        F.col("chunk_id").alias("item_id"), "text", "doc_id", "source", embed(F.col("text")).alias("vec")))
    return prompts_for(_asked(spark, d), passages, dictionary_table(spark, DICTIONARY), TEMPLATE,
                       charmap=CHARMAP, metadata=["doc_id", "source"])


CHUNK_PROMPTS_SQL = (
    "WITH RECURSIVE " + chunk_ctes("SELECT doc_id AS id, text FROM documents") + ","
    + _retrieved_ctes("""
    SELECT 'file:doc/' || id || ':chunk:' || chunk_index || ':' || left(sha256(d.text), 12) AS item_id,
           chunk.text, 'file:doc/' || id AS doc_id, source FROM chunk JOIN documents d ON d.doc_id = id""")
    + _context_cte("doc_id", "source") + _PROMPTS)

QUERIES = {
    "normalized_questions": (normalized_questions, NORMALIZED_SQL),
    "query_variants": (query_variants, VARIANTS_SQL),
    "query_variants_joined": (query_variants_joined, VARIANTS_SQL),
    "synonym_expansions": (synonym_expansions, EXPANSIONS_SQL),
    "dictionary_matches": (dictionary_matches, MATCHES_SQL),
    "intent_labels": (intent_labels, _intent_sql()),
    "retrieved_documents": (retrieved_documents, RETRIEVED_SQL),
    "rendered_contexts": (rendered_contexts, CONTEXTS_SQL),
    "filled_prompts": (filled_prompts, PROMPTS_SQL),
    "chunk_prompts": (chunk_prompts, CHUNK_PROMPTS_SQL),
}
