"""Questions to prompts, over many questions in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.fixed_values import CACHE_THRESHOLD, TOP_K
from lorespan.functions.embedding import DIM, with_vectors
from lorespan.functions.text import blank, strip
from lorespan.operators.cache import cache_lookup
from lorespan.operators.querytext import prepare_queries
from lorespan.operators.retrieval import fill_prompt, render_context, retrieve
from lorespan.session import cut_lineage


def contexts_for(questions: DataFrame, passages: DataFrame, dictionary: DataFrame, *,
                 metadata: list[str], charmap=None, k: int = TOP_K, **options) -> DataFrame:
    """``questions(query_id, text)`` to ``(query_id, n_refs, context)``."""
    variants = prepare_queries(questions, dictionary, charmap)
    return render_context(retrieve(variants, passages, k, **options), metadata)


def prompts_for(questions: DataFrame, passages: DataFrame, dictionary: DataFrame,
                template: str, *, metadata: list[str], **options) -> DataFrame:
    """``(query_id, n_refs, prompt)``.  A question without any passage gets an empty context."""
    contexts = contexts_for(questions, passages, dictionary, metadata=metadata, **options)
    filled = (questions.select("query_id", F.col("text").alias("q"))
              .join(contexts, "query_id", "left")
              .withColumn("context", F.coalesce("context", F.lit("")))
              .withColumn("n_refs", F.coalesce("n_refs", F.lit(0))))
    return fill_prompt(template, filled).select("query_id", "n_refs", "prompt")


def answer_or_prompt(questions: DataFrame, entries: DataFrame, passages: DataFrame,
                     dictionary: DataFrame, template: str, now: int, *, metadata: list[str],
                     threshold: float = CACHE_THRESHOLD, dim: int = DIM, model=None,
                     **options) -> tuple[DataFrame, DataFrame]:
    """Cached answers for the questions that hit, prompts for the others.

    The cache key is the stripped question as asked; blank questions are refused.
    """
    asked = (questions.withColumn("text", strip(F.col("text")))
             .where(~blank(F.col("text"))))
    vectors = with_vectors(asked, dim=dim, model=model).select("query_id", "vec")
    found = cut_lineage(cache_lookup(entries, vectors, now, threshold))
    hits = found.where("hit").select("query_id", "score", "answer")
    misses = asked.join(hits.select("query_id"), "query_id", "left_anti")
    prompts = prompts_for(misses, passages, dictionary, template, metadata=metadata,
                          dim=dim, model=model, **options)
    return hits, prompts
