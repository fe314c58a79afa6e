"""The operators as queries over the whole tables, with SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers

from lorespan.llm.decontamination import scan_report
from lorespan.llm.fast_sketch import near_duplicates
from lorespan.llm.importance import resample
from lorespan.llm.jaccard_join import similar_components
from lorespan.llm.media import media_columns
from lorespan.llm.packing import pack_documents
from lorespan.llm.pii import pii_report
from lorespan.llm.quality import quality_report
from lorespan.llm.secrets import scan_secrets
from lorespan.llm.substring_dedup import remove_repeated_windows
from lorespan.llm.suffix_dedup import remove_repeated_bytes
from lorespan.llm.toxicity import toxicity_report
from lorespan.llm.whitening import whiten
from lorespan.session import load_table


def op1_suffix_dedup(spark, d):
    return remove_repeated_bytes(load_table(spark, d, "documents"))


SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k
      FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM w) WHERE n > 1),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run
      FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, run),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
             string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
      FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""


def op2_substring_dedup(spark, d):
    return (remove_repeated_windows(load_table(spark, d, "documents"))
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d)),
f AS (SELECT k, min(doc_id) AS m FROM v GROUP BY k),
hit AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM v JOIN f USING (k) WHERE m < doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM hit GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept
      FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op3_jaccard(spark, d):
    return similar_components(load_table(spark, d, "documents"), size=4, percent=85)


JACCARD_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 85 * (x.n + y.n - o)),
c AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.r = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM c GROUP BY doc_id) USING (doc_id)
"""


def op4_media(spark, d):
    return media_columns(load_table(spark, d, "documents"))


def op5_pii(spark, d):
    return pii_report(load_table(spark, d, "documents"))


def op6_quality(spark, d):
    return quality_report(load_table(spark, d, "documents"), load_table(spark, d, "labels"))


def op7_toxicity(spark, d):
    return toxicity_report(load_table(spark, d, "documents"), load_table(spark, d, "labels"))


def op8_secrets(spark, d):
    return scan_secrets(load_table(spark, d, "documents"))


def op9_decontamination(spark, d):
    return scan_report(load_table(spark, d, "documents"), load_table(spark, d, "benchmark"))


DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw))),
hit AS (SELECT doc_id, dw.n, s, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op10_packing(spark, d):
    docs = load_table(spark, d, "documents")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op11_near_duplicates(spark, d):
    return near_duplicates(load_table(spark, d, "documents"), size=3, percent=85)


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 85 * (x.n + y.n - o)),
c AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.r = e.a),
m AS (SELECT doc_id, min(r) AS r FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r, d.doc_id) AS component_id,
       coalesce(r, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op12_importance(spark, d):
    return resample(load_table(spark, d, "documents"), load_table(spark, d, "benchmark"))


# The table of the byte-wise CRC-32 follows from its polynomial in eight steps a byte.
IMPORTANCE_SQL = r"""
WITH t AS MATERIALIZED (
    SELECT list(list_reduce(list_prepend(b, range(8)::BIGINT[]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
    FROM (SELECT unnest(range(256))::BIGINT AS b)),
w AS (SELECT 0 AS part, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
      UNION ALL
      SELECT 1, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
n AS MATERIALIZED (SELECT part, id, word, count(*) AS n FROM w GROUP BY ALL),
v AS MATERIALIZED (
    SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
                                 lambda c, b: xor(c // 256, t.t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM n)), t),
k AS (SELECT bucket, sum(CASE part WHEN 0 THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE part WHEN 1 THEN n ELSE 0 END)::DOUBLE AS t
      FROM n JOIN v USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM k) + 10000) / ((s + 1) * ((SELECT sum(t) FROM k) + 10000))))::BIGINT AS gain FROM k),
f AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
      FROM n JOIN v USING (word) JOIN g USING (bucket) WHERE part = 0 GROUP BY id),
d AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM documents LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM d WHERE n_features >= 20)
SELECT d.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN rank END AS rank
FROM d LEFT JOIN r USING (doc_id)
"""


def op13_whitening(spark, d):
    return whiten(load_table(spark, d, "embeddings"))


QUERIES = {
    "op1_suffix_dedup": (op1_suffix_dedup, SUFFIX_SQL),
    "op2_substring_dedup": (op2_substring_dedup, SUBSTRING_SQL),
    "op3_jaccard": (op3_jaccard, JACCARD_SQL),
    "op4_media": (op4_media, None),
    "op5_pii": (op5_pii, None),
    "op6_quality": (op6_quality, None),
    "op7_toxicity": (op7_toxicity, None),
    "op8_secrets": (op8_secrets, None),
    "op9_decontamination": (op9_decontamination, DECONTAMINATION_SQL),
    "op10_packing": (op10_packing, None),
    "op11_near_duplicates": (op11_near_duplicates, NEAR_DUPLICATES_SQL),
    "op12_importance": (op12_importance, IMPORTANCE_SQL),
    "op13_whitening": (op13_whitening, None),
}
