"""SQL pieces shared by the checks."""

from lorespan.functions.embedding import DIM


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def word_vectors(name: str, source: str, dim: int = DIM) -> str:
    """CTEs giving ``name(id, b, w)`` for the query ``source(id, text)``."""
    return f"""
    {name}_t AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS t FROM ({source})),
    {name}_c AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS b, count(*) AS c
                 FROM {name}_t GROUP BY 1, 2),
    {name}_n AS (SELECT id, sqrt(sum(c * c)) AS n FROM {name}_c GROUP BY 1),
    {name}_f AS (SELECT id, b, (c / n)::FLOAT::DOUBLE AS f FROM {name}_c JOIN {name}_n USING (id)),
    {name} AS (SELECT id, b, f, sqrt(sum(f * f) OVER (PARTITION BY id)) AS l FROM {name}_f)"""


def similarities(name: str, queries: str, items: str) -> str:
    """CTE ``name(q, i, score)`` from two word-vector tables."""
    return f"""
    {name} AS (SELECT q.id AS q, i.id AS i,
                      round(sum(q.f * i.f) / (any_value(q.l) * any_value(i.l)), 9) AS score
               FROM {queries} q JOIN {items} i ON q.b = i.b GROUP BY 1, 2)"""
