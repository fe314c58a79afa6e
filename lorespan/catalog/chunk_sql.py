"""The chunking rule in SQL, for checks on whole documents.

Long pieces are cut again level by level; neighbouring short pieces form a run.
A run is packed on its list of cuts: from a start the farthest end within the
size, then the first start within the overlap that leaves room for one more piece.
"""

from lorespan.fixed_values import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS


def _literal(separator: str) -> str:
    return "'" + separator.replace("\n", "' || chr(10) || '") + "'"


def chunk_ctes(source: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> str:
    """CTEs ending in ``chunk(id, chunk_index, text)`` for the query ``source(id, text)``.

    They stand after ``WITH RECURSIVE``.
    """
    seps = "[" + ", ".join(_literal(s) for s in SEPARATORS) + "]"

    def pieces(of):
        return f"""
        SELECT id, path, sep, level, unnest(list_filter(list_transform(parts, lambda p, i: CASE WHEN i = 1 THEN p ELSE sep || p END),
                                                        lambda p: p <> '')) AS piece,
               generate_subscripts(list_filter(list_transform(parts, lambda p, i: CASE WHEN i = 1 THEN p ELSE sep || p END),
                                               lambda p: p <> ''), 1) AS n
        FROM (SELECT *, string_split(text, sep) AS parts FROM (
            SELECT *, {seps}[level] AS sep FROM (
                SELECT id, path, text, list_filter(range(least(lv, {len(SEPARATORS)}), {len(SEPARATORS) + 1}),
                       lambda l: {seps}[l] = '' OR contains(text, {seps}[l]))[1] AS level FROM {of})))"""

    return f"""
    seg(id, path, text, lv) AS (
        SELECT id, []::BIGINT[], text, 1::BIGINT FROM ({source})
        UNION ALL
        SELECT id, list_append(path, n), piece, level + 1 FROM ({pieces("seg")}) WHERE length(piece) >= {size}),
    piece AS (SELECT id, path, n, piece, length(piece) AS len,
                     sum((length(piece) >= {size})::INT) OVER (PARTITION BY id, path ORDER BY n) AS long
              FROM ({pieces("seg")})),
    run AS (SELECT id, path, min(n) AS start, string_agg(piece, '' ORDER BY n) AS text,
                   list_prepend(0, list(total ORDER BY n)) AS cuts
            FROM (SELECT *, sum(len) OVER (PARTITION BY id, path, long ORDER BY n)::BIGINT AS total
                  FROM piece WHERE len < {size})
            GROUP BY id, path, long),
    pack(id, path, start, text, cuts, a, b, step) AS (
        SELECT id, path, start, text, cuts, 1::BIGINT,
               list_max(list_filter(range(2, len(cuts) + 1), lambda j: cuts[j] <= {size})), 0 FROM run
        UNION ALL
        SELECT id, path, start, text, cuts, a,
               list_max(list_filter(range(a + 1, len(cuts) + 1), lambda j: cuts[j] - cuts[a] <= {size})), step
        FROM (SELECT id, path, start, text, cuts, step + 1 AS step,
                     list_min(list_filter(range(a, b + 1), lambda i: i = b
                         OR (cuts[b] - cuts[i] <= {overlap} AND cuts[b + 1] - cuts[i] <= {size}))) AS a
              FROM pack WHERE b < len(cuts))),
    cut AS (SELECT id, path, start, step,
                   trim(substr(text, (cuts[a] + 1)::BIGINT, (cuts[b] - cuts[a])::BIGINT), ' ' || chr(10)) AS text FROM pack),
    chunk AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY list_append(path, start), step) - 1 AS chunk_index,
                     text FROM cut WHERE text <> '')"""
