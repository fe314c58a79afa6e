"""Vectors and nearest neighbours."""

from pyspark.sql import functions as F

from lorespan.catalog.sql import similarities, word_vectors
from lorespan.functions.embedding import DIM, cosine, with_vectors
from lorespan.operators.similarity import knn
from lorespan.operators.vector_index import build_index, recall, search_index
from lorespan.operators.weighted_lists import list_search
from lorespan.session import load_table


def _vectors(spark, d):
    return load_table(spark, d, "embeddings")


def _neighbours(spark, d, **options):
    rows = _vectors(spark, d)
    items = rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    queries = rows.select("vec_id", F.col("embedding").alias("vec"))
    hits = knn(items, queries, query_keys=["vec_id"], exclude_self=True, **options)
    return _neighbour_rows(hits)


def _neighbour_rows(hits):
    return hits.select("vec_id", F.col("item_id").alias("neighbor_id"),
                       F.round("score", 4).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def nearest_vectors(spark, d):
    return _neighbours(spark, d)


def nearest_vectors_shared_queries(spark, d):
    return _neighbours(spark, d, method="queries")


def nearest_vectors_grid(spark, d):
    return _neighbours(spark, d, method="grid", cell_items=256, cell_queries=128)


def approximate_neighbors(spark, d):
    return _neighbours(spark, d, method="lsh", tables=8, bits=4)


def _indexed(spark, d, **options):
    """Every hundredth vector against all, each with itself."""
    rows = _vectors(spark, d)
    items = rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    asked = rows.where("vec_id % 100 = 0").select("vec_id", F.col("embedding").alias("vec"))
    return items, asked, search_index(build_index(items), asked, query_keys=["vec_id"], **options)


def indexed_neighbors(spark, d):
    return _neighbour_rows(_indexed(spark, d)[2])


def indexed_neighbors_exact(spark, d):
    return _neighbour_rows(_indexed(spark, d, exact=True)[2])


def indexed_recall(spark, d):
    """The neighbours that the index should find, and whether nine of ten are among those it finds."""
    items, asked, hits = _indexed(spark, d)
    found = recall(hits, knn(items, asked, query_keys=["vec_id"]), ["vec_id"])
    return found.select("n_true", (F.col("recall") >= 0.9).alias("recall_reached"))


INDEXED_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_cosine_similarity(a.e, b.e), 9) AS score
      FROM v a CROSS JOIN v b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS rank FROM s)
SELECT vec_id, neighbor_id, round(score, 4) AS similarity, rank FROM r WHERE rank <= 6
"""

INDEXED_RECALL_SQL = f"SELECT count(*) AS n_true, true AS recall_reached FROM ({INDEXED_SQL})"

NEAREST_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_cosine_similarity(a.e, b.e), 9) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS rank FROM s)
SELECT vec_id, neighbor_id, round(score, 4) AS similarity, rank FROM r WHERE rank <= 6
"""


def vector_pairs(spark, d):
    rows = _vectors(spark, d)
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(following, "vec_id").select(
        "vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 4).alias("similarity"))


VECTOR_PAIRS_SQL = """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
"""


def text_vectors(spark, d):
    docs = load_table(spark, d, "documents")
    return (with_vectors(docs).select("doc_id", F.posexplode("vec").alias("bucket", "weight"))
            .where("weight > 0")
            .select("doc_id", F.col("bucket").cast("long").alias("bucket"),
                    F.round(F.col("weight").cast("double"), 6).alias("weight")))


TEXT_VECTORS_SQL = f"""
WITH {word_vectors("v", "SELECT doc_id AS id, text FROM documents")}
SELECT id AS doc_id, b AS bucket, round(f, 6) AS weight FROM v
"""


def model_vectors(spark, d):
    """A model of the caller's in place of the word vectors: here lengths and digits of the text."""
    def model(text):
        return F.array(F.length(text), F.length(F.regexp_replace(text, "[^0-9]", "")),
                       F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("array<float>")

    docs = with_vectors(load_table(spark, d, "documents"), model=model)
    return docs.select("doc_id", F.posexplode("vec").alias("place", "value")).select(
        "doc_id", F.col("place").cast("long").alias("place"), F.col("value").cast("double").alias("value"))


MODEL_SQL = """
SELECT doc_id, unnest([0, 1, 2])::BIGINT AS place,
       unnest([length(text), length(regexp_replace(text, '[^0-9]', '', 'g')), length(replace(text, ' ', ''))])::DOUBLE AS value
FROM documents
"""


def _documents_and_items(spark, d):
    return (with_vectors(load_table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")),
            with_vectors(load_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")))


def nearest_documents(spark, d):
    return _document_rows(knn(*_documents_and_items(spark, d), width=DIM))


def nearest_documents_sparse(spark, d):
    """The same neighbours by weighted inverted lists."""
    return _document_rows(list_search(*_documents_and_items(spark, d), width=DIM))


def _document_rows(hits):
    return hits.select(
        "query_id", F.col("item_id").alias("doc_id"), F.round("score", 4).alias("similarity"),
        F.col("rank").cast("long").alias("rank"))


NEAREST_DOCUMENTS_SQL = f"""
WITH {word_vectors("v", "SELECT doc_id AS id, text FROM documents")},
{word_vectors("q", "SELECT item_id AS id, text FROM benchmark")},
{similarities("s", "q", "v")},
r AS (SELECT q, i, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, i) AS rank FROM s)
SELECT q AS query_id, i AS doc_id, round(score, 4) AS similarity, rank FROM r WHERE rank <= 6
"""

QUERIES = {
    "nearest_vectors": (nearest_vectors, NEAREST_SQL),
    "nearest_vectors_shared_queries": (nearest_vectors_shared_queries, NEAREST_SQL),
    "nearest_vectors_grid": (nearest_vectors_grid, NEAREST_SQL),
    "approximate_neighbors": (approximate_neighbors, None),
    "indexed_neighbors": (indexed_neighbors, None),
    "indexed_neighbors_exact": (indexed_neighbors_exact, INDEXED_SQL),
    "indexed_recall": (indexed_recall, INDEXED_RECALL_SQL),
    "vector_pairs": (vector_pairs, VECTOR_PAIRS_SQL),
    "text_vectors": (text_vectors, TEXT_VECTORS_SQL),
    "model_vectors": (model_vectors, MODEL_SQL),
    "nearest_documents": (nearest_documents, NEAREST_DOCUMENTS_SQL),
    "nearest_documents_sparse": (nearest_documents_sparse, NEAREST_DOCUMENTS_SQL),
}
