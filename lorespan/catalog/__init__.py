"""Every operator as a query over the test tables, with the same result in SQL.

A query is ``name -> (function of (spark, folder), SQL or None)``.
"""

from lorespan.catalog import (
    accounts, answers, cache, conversations, indexing, questions, similarity, streams, webpages,
)

CATALOG = {
    **similarity.QUERIES, **questions.QUERIES, **cache.QUERIES, **indexing.QUERIES,
    **conversations.QUERIES, **accounts.QUERIES, **webpages.QUERIES, **answers.QUERIES,
    **streams.QUERIES,
}
