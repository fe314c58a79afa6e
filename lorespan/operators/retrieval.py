"""From query variants to numbered contexts and prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorespan.fixed_values import DEDUP_PREFIX, TOP_K
from lorespan.functions.embedding import DIM, with_vectors
from lorespan.operators.ordering import keep_first
from lorespan.operators.similarity import knn
from lorespan.session import cut_lineage, is_small


def with_text(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """Join the passage text to its hits.

    The hits are written once, so the search runs once and their size can be
    measured: where it is small they travel to the passages, which then stay where they
    are.  Of many hits the distinct ids go first, so that only passages that were hit
    shuffle with them.
    """
    hits = cut_lineage(hits)
    if is_small(hits):
        return F.broadcast(hits).join(passages, "item_id")
    ids = hits.select("item_id").distinct()
    # Passages that nothing hit end here; few ids decide that without moving text.
    wanted = passages.join(F.broadcast(ids) if is_small(ids) else ids, "item_id", "left_semi")
    return hits.hint("merge").join(wanted, "item_id")


def merge_variants(hits: DataFrame, prefix: int = DEDUP_PREFIX,
                   max_docs: int | None = None) -> DataFrame:
    """Union over the variants of a query, first passage per text prefix, numbered."""
    order = [F.col("variant"), F.col("rank")]
    firsts = keep_first(hits.withColumn("_key", F.left("text", F.lit(prefix))),
                        ["query_id", "_key"], order).drop("_key")
    numbered = firsts.withColumn(
        "n", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return numbered if max_docs is None else numbered.where(F.col("n") <= max_docs)


def retrieve(variants: DataFrame, passages: DataFrame, k: int = TOP_K, *,
             prefix: int = DEDUP_PREFIX, max_docs: int | None = None, dim: int = DIM,
             model: Callable[[Column], Column] | None = None, **knn_options) -> DataFrame:
    """Top ``k`` passages per variant, merged per query.

    ``variants(query_id, variant, q)``; ``passages(item_id, text, …)`` with an
    optional ``vec`` column computed earlier.
    """
    items = passages if "vec" in passages.columns else with_vectors(passages, dim=dim, model=model)
    if model is None and "vec" not in passages.columns:
        knn_options.setdefault("width", dim)
    # Counted, then searched with: written once so that both read the same rows.
    queries = cut_lineage(with_vectors(variants, "q", dim=dim, model=model)
                          .select("query_id", "variant", "vec"))
    hits = knn(items, queries, k, query_keys=("query_id", "variant"), **knn_options)
    return merge_variants(with_text(hits, passages.drop("vec")), prefix, max_docs)


def context_line(n: Column, text: Column, metadata: Column) -> Column:
    return F.concat(F.lit("[Reference "), n.cast("string"), F.lit("] Content: "), text,
                    F.lit(" | Metadata: "), metadata, F.lit("\n"))


def render_context(docs: DataFrame, metadata: list[str]) -> DataFrame:
    """One context string per query; at most a few passages each, in number order."""
    lines = docs.withColumn(
        "line", context_line(F.col("n"), F.col("text"), F.to_json(F.struct(*metadata))))
    return lines.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_refs"),
        F.expr("listagg(line, '') within group (order by n)").alias("context"))


def fill_prompt(template: str, contexts: DataFrame, question: str = "q",
                context: str = "context") -> DataFrame:
    """Replace the two slots of the template in one pass over it.

    The template is cut at its slots first, so a question that itself holds
    slot text is not filled again.
    """
    import re

    parts = re.split(r"(\{input\}|\{context\})", template)
    slots = {"{input}": F.col(question), "{context}": F.col(context)}
    return contexts.withColumn(
        "prompt", F.concat(*[slots.get(p, F.lit(p)) for p in parts]))


def with_history(queries: DataFrame, history: DataFrame) -> DataFrame:
    """Message list per query: the earlier messages, then the question."""
    message = F.struct(F.lit("user").alias("role"), F.col("q").alias("content"))
    earlier = F.coalesce(F.col("messages"), F.array().cast("array<struct<role:string,content:string>>"))
    return (queries.join(history.select("conv_id", "messages"), "conv_id", "left")
            .withColumn("messages", F.concat(earlier, F.array(message))))
