"""Incremental indexing.

The documents are the current listing.  The previous manifest holds the labelled
documents (those of low quality with an older text) and the benchmark passages,
which the listing no longer has; notes are records of another origin.
"""

from pyspark.sql import functions as F

from lorespan.catalog.chunk_sql import chunk_ctes
from lorespan.fixed_values import CHUNK_OVERLAP, CHUNK_SIZE
from lorespan.functions.identity import chunk_id
from lorespan.operators.chunking import chunk, chunk_lists, flat_metadata
from lorespan.operators.indexing import (
    apply_chunks, diff_manifest, removed_documents, run_report, triage,
)
from lorespan.plans.indexing import ChunkStore, index_documents
from lorespan.session import cut_lineage, load_table, work_dir
from lorespan.sources.corpus import listing, source_records

ROOT = "/srv/corpus"


def _current(spark, d):
    return load_table(spark, d, "documents").select(
        F.concat(F.lit("file:doc/"), F.col("doc_id")).alias("doc_id"),
        F.sha2("text", 256).alias("hash"), "text", "lang")


def _previous_texts(spark, d):
    docs = load_table(spark, d, "documents")
    labels = load_table(spark, d, "labels")
    old = F.when(F.col("quality") == 0, F.concat(F.lit("older\n"), F.col("text"))).otherwise(F.col("text"))
    known = docs.join(labels, "doc_id").select(
        F.concat(F.lit("file:doc/"), F.col("doc_id")).alias("doc_id"), old.alias("text"))
    bench = load_table(spark, d, "benchmark").select(
        F.concat(F.lit("file:bench/"), F.col("item_id")).alias("doc_id"), "text")
    notes = load_table(spark, d, "conversations").where("role = 'system'").select(
        F.concat(F.lit("note:"), F.col("conv_id")).alias("doc_id"), "text")
    return known.unionByName(bench).unionByName(notes).withColumn("hash", F.sha2("text", 256))


def _line_chunks(texts):
    """One chunk per line: a cutting rule that SQL can repeat."""
    rows = texts.select("*", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"))
    rows = rows.drop("text").withColumnRenamed("line", "text")
    return rows.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("hash")))


def _manifest(spark, d):
    texts = _previous_texts(spark, d)
    lines = F.transform(F.split("text", "\n"),
                        lambda x, i: chunk_id(F.col("doc_id"), i, F.col("hash")))
    return texts.select("doc_id", "hash", lines.alias("chunk_ids"))


_STATE = """
cur AS (SELECT 'file:doc/' || doc_id AS doc_id, sha256(text) AS hash, text, lang FROM documents),
old AS (SELECT *, sha256(text) AS hash FROM (
    SELECT 'file:doc/' || doc_id AS doc_id,
           CASE WHEN quality = 0 THEN 'older' || chr(10) || text ELSE text END AS text
    FROM documents JOIN labels USING (doc_id)
    UNION ALL SELECT 'file:bench/' || item_id, text FROM benchmark
    UNION ALL SELECT 'note:' || conv_id, text FROM conversations WHERE role = 'system')),
diff AS (SELECT doc_id, cur.hash AS hash, old.hash AS old_hash, len(string_split(old.text, chr(10))) AS n_old,
                CASE WHEN old.hash IS NULL THEN 'NEW'
                     WHEN cur.hash IS NULL AND doc_id LIKE 'file:%' THEN 'REMOVED'
                     WHEN cur.hash IS NULL THEN 'KEPT'
                     WHEN cur.hash = old.hash THEN 'UNCHANGED' ELSE 'CHANGED' END AS status
         FROM cur FULL JOIN old USING (doc_id)),
lines AS (SELECT doc_id, hash, unnest(string_split(text, chr(10))) AS text,
                 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index FROM old),
chunks AS (SELECT *, doc_id || ':chunk:' || chunk_index || ':' || left(hash, 12) AS chunk_id FROM lines),
newlines AS (SELECT doc_id, hash, unnest(string_split(text, chr(10))) AS text,
                    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index
             FROM cur JOIN diff USING (doc_id, hash) WHERE status IN ('NEW', 'CHANGED'))
"""


def manifest_diff(spark, d):
    diff = diff_manifest(_current(spark, d), _manifest(spark, d))
    return diff.select("doc_id", "status", "hash", "old_hash",
                       "n_old_chunks")


DIFF_SQL = f"WITH {_STATE} SELECT doc_id, status, hash, old_hash, n_old AS n_old_chunks FROM diff"


def removed_records(spark, d):
    gone = removed_documents(_current(spark, d), _manifest(spark, d))
    return gone.select("doc_id", "hash")


REMOVED_SQL = f"""
WITH {_STATE} SELECT doc_id, hash FROM old
WHERE doc_id LIKE 'file:%' AND doc_id IN (SELECT doc_id FROM old EXCEPT SELECT doc_id FROM cur)
"""


def updated_chunks(spark, d):
    """The line chunks after the run: stale ones out, those of new texts in."""
    diff = cut_lineage(diff_manifest(_current(spark, d), _manifest(spark, d)))
    touched = diff.where("status in ('NEW', 'CHANGED')").select("doc_id")
    fresh = _line_chunks(_current(spark, d).select("doc_id", "hash", "text")
                         .join(touched, "doc_id", "left_semi"))
    after = apply_chunks(_line_chunks(_previous_texts(spark, d)), diff, _manifest(spark, d), fresh)
    return after.select("chunk_id", "text")


UPDATED_SQL = f"""
WITH {_STATE}
SELECT chunk_id, text FROM chunks JOIN diff USING (doc_id) WHERE status IN ('UNCHANGED', 'KEPT')
UNION ALL
SELECT doc_id || ':chunk:' || chunk_index || ':' || left(hash, 12), text FROM newlines
"""


def chunk_id_lists(spark, d):
    lists = chunk_lists(_line_chunks(_current(spark, d).select("doc_id", "hash", "text")))
    return lists.select("doc_id", F.array_join("chunk_ids", "|").alias("chunk_ids"))


LISTS_SQL = f"""
WITH {_STATE},
l AS (SELECT doc_id, hash, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM cur)
SELECT doc_id, string_agg(doc_id || ':chunk:' || i || ':' || left(hash, 12), '|' ORDER BY i) AS chunk_ids
FROM l GROUP BY 1
"""


def indexing_report(spark, d):
    current = _current(spark, d)
    diff = cut_lineage(diff_manifest(current, _manifest(spark, d)))
    touched = diff.where("status in ('NEW', 'CHANGED')").select("doc_id")
    made = _line_chunks(current.select("doc_id", "hash", "text").join(touched, "doc_id", "left_semi"))
    # Lines without text make no chunk, so a document of blank lines is skipped.
    return run_report(diff, made.where("length(trim(text)) > 0"))


REPORT_SQL = f"""
WITH {_STATE},
made AS (SELECT doc_id, count(*) AS made FROM newlines WHERE length(trim(text)) > 0 GROUP BY 1)
SELECT CASE WHEN status IN ('NEW', 'CHANGED') AND made IS NULL THEN 'SKIPPED'
            WHEN status IN ('NEW', 'CHANGED') THEN 'LOADED' ELSE status END AS action,
       count(*) AS documents, sum(coalesce(made, 0))::BIGINT AS chunks_added,
       sum(CASE WHEN status IN ('CHANGED', 'REMOVED') THEN coalesce(n_old, 0) ELSE 0 END)::BIGINT AS chunks_deleted
FROM diff LEFT JOIN made USING (doc_id) GROUP BY 1
"""


def chunk_metadata(spark, d):
    """Flat metadata of line chunks: scalar extras, loader keys, missing text as ''."""
    docs = load_table(spark, d, "documents").select(
        F.concat(F.lit("file:doc/"), F.col("doc_id")).alias("doc_id"),
        F.sha2("text", 256).alias("hash"), "text", F.lit(None).cast("string").alias("source_url"),
        F.col("source").alias("title"),
        F.struct(F.col("lang").alias("filename"), F.col("n_chars").alias("size_bytes")).alias("extra"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("page"), F.lit(None).cast("string")).alias("loader_meta"))
    flat = flat_metadata(_line_chunks(docs))
    return flat.select("chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), "source_url",
                       "title", "filename", "size_bytes",
                       F.col("loader_meta")["loader_lang"].alias("loader_lang"),
                       F.col("loader_meta")["loader_page"].alias("loader_page"))


METADATA_SQL = """
WITH l AS (SELECT doc_id, sha256(text) AS hash, source, lang, n_chars,
                  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT 'file:doc/' || doc_id || ':chunk:' || i || ':' || left(hash, 12) AS chunk_id, i AS chunk_index,
       '' AS source_url, source AS title, lang AS filename, n_chars AS size_bytes,
       lang AS loader_lang, '' AS loader_page FROM l
"""


def document_chunks(spark, d):
    """Overlapping chunks of every document."""
    rows = chunk(_current(spark, d))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"),
                       "chunk_id", "text", "lang")


def measured_chunks(spark, d):
    """A length function of the caller's: every character counts twice, so chunks are half as long."""
    rows = chunk(_current(spark, d), length=lambda text: 2 * len(text))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


MEASURED_SQL = f"""
WITH RECURSIVE {chunk_ctes("SELECT doc_id AS id, text FROM documents", CHUNK_SIZE // 2, CHUNK_OVERLAP // 2)}
SELECT 'file:doc/' || id AS doc_id, chunk_index, text FROM chunk
"""


CHUNKS_SQL = f"""
WITH RECURSIVE {chunk_ctes("SELECT doc_id AS id, text FROM documents")}
SELECT 'file:doc/' || id AS doc_id, chunk_index,
       'file:doc/' || id || ':chunk:' || chunk_index || ':' || left(sha256(d.text), 12) AS chunk_id,
       chunk.text, lang
FROM chunk JOIN documents d ON d.doc_id = id
"""


def content_hashes(spark, d):
    return load_table(spark, d, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


HASHES_SQL = "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents"


def _file_path():
    """Half of the documents lie below the root, with two extensions."""
    folder = F.when(F.col("lang") == "en", F.lit(ROOT)).otherwise(F.lit("/mnt/other"))
    end = F.when(F.col("lang") == "fr", F.lit(".v2.TXT")).otherwise(F.lit(".txt"))
    return F.concat(folder, F.lit("/"), "source", F.lit("/my_doc_"), "doc_id", end)


def document_records(spark, d):
    files = load_table(spark, d, "documents").select(
        F.concat(F.lit("file:"), _file_path()).alias("path"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modificationTime"),
        F.octet_length("text").cast("long").alias("length"),
        F.col("text").cast("binary").alias("content"))
    return source_records(files, ROOT).select(
        "doc_id", "source_type", "title", "file_path", "hash", "permission_scope", "extra.*")


RECORDS_SQL = f"""
WITH f AS (SELECT text, CASE WHEN lang = 'en' THEN '{ROOT}' ELSE '/mnt/other' END || '/' || source || '/my_doc_'
                  || doc_id || CASE WHEN lang = 'fr' THEN '.v2.TXT' ELSE '.txt' END AS p,
                  'my doc ' || doc_id || CASE WHEN lang = 'fr' THEN '.v2' ELSE '' END AS title FROM documents)
SELECT 'file:' || CASE WHEN starts_with(p, '{ROOT}/') THEN substr(p, {len(ROOT) + 2}) ELSE p END AS doc_id,
       'local_file' AS source_type, title, p AS file_path, sha256(text) AS hash,
       'public' AS permission_scope, string_split(p, '/')[-1] AS filename, 'txt' AS extension,
       strlen(text) AS size_bytes FROM f
"""


def upload_triage(spark, d):
    """Documents as uploads; the size is scaled so that some pass the limit."""
    name = (F.when(F.col("lang") == "en", F.concat(F.lit("in/"), "source", F.lit(".TXT")))
            .when(F.col("lang") == "de", F.concat(F.col("source"), F.lit(".docx")))
            .when(F.col("lang") == "es", F.lit("folder//")).otherwise(F.lit("/")))
    files = load_table(spark, d, "documents").select(
        "doc_id", name.alias("filename"), (F.col("n_chars") * 20_000).alias("size_bytes"))
    return triage(files).select("doc_id", "name", "reason")


TRIAGE_SQL = """
SELECT doc_id,
       CASE lang WHEN 'en' THEN source || '.TXT' WHEN 'de' THEN source || '.docx'
                 WHEN 'es' THEN 'folder' ELSE '' END AS name,
       CASE WHEN lang NOT IN ('en', 'de', 'es') THEN 'Invalid filename'
            WHEN lang = 'de' THEN 'Unsupported file type: .docx'
            WHEN lang = 'es' THEN 'Unsupported file type: .'
            WHEN n_chars * 20000 > 52428800 THEN 'File exceeds 50 MB limit' END AS reason
FROM documents
"""


def document_listing(spark, d):
    """The documents as files of a folder, newest first."""
    docs = load_table(spark, d, "documents")
    return listing(docs.select(
        F.concat(F.lit(f"file:{ROOT}/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("path"),
        F.timestamp_seconds(F.col("doc_id") * 60 + F.col("n_chars")).alias("modificationTime"),
        F.octet_length("text").cast("long").alias("length")))


LISTING_SQL = """
SELECT doc_id || '.txt' AS name, strlen(text)::BIGINT AS size, doc_id * 60 + n_chars AS modified FROM documents
"""


def _sources(texts):
    """Source documents of a listing, as the folder scan gives them."""
    name = F.element_at(F.split("doc_id", "/"), -1)
    return texts.select(
        "doc_id", F.lit("local_file").alias("source_type"), F.lit(None).cast("string").alias("source_url"), name.alias("title"),
        F.col("doc_id").alias("file_path"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"), "hash",
        F.lit("public").alias("permission_scope"), F.struct(
            name.alias("filename"), F.lit("txt").alias("extension"), F.octet_length("text").cast("long").alias("size_bytes")).alias("extra"),
        "text", F.lit(None).cast("string").alias("reason"))


def _two_runs(spark, d):
    """A store after two indexing runs, and the report of the second."""
    store = ChunkStore(spark, work_dir(spark, "store"))
    index_documents(_sources(_previous_texts(spark, d)), store)
    report, _ = index_documents(_sources(_current(spark, d)), store)
    return store, report


def indexed_chunks(spark, d):
    return _two_runs(spark, d)[0].current_chunks().select("chunk_id", "text", "title")


def indexed_manifest(spark, d):
    return _two_runs(spark, d)[0].manifest.read().select(
        "doc_id", "hash", F.size("chunk_ids").cast("long").alias("n_chunks"), "indexed_in")


def indexed_report(spark, d):
    return _two_runs(spark, d)[1]


_LIVE = """
SELECT 'new|' || doc_id AS id, text FROM cur UNION ALL SELECT 'old|' || doc_id, text FROM old
"""
_RUNS = f"""
WITH RECURSIVE {_STATE}, {chunk_ctes(_LIVE)},
live AS (SELECT doc_id, status, n, CASE WHEN n = 'new' THEN hash ELSE old_hash END AS hash
         FROM diff, (VALUES ('new'), ('old')) AS v(n)
         WHERE (n = 'new') = (status IN ('NEW', 'CHANGED')) AND status <> 'REMOVED'),
counts AS (SELECT id, count(*) AS n_chunks FROM chunk GROUP BY id)
"""
INDEXED_CHUNKS_SQL = f"""{_RUNS}
SELECT doc_id || ':chunk:' || chunk_index || ':' || left(hash, 12) AS chunk_id, text, string_split(doc_id, '/')[-1] AS title
FROM live JOIN chunk ON id = n || '|' || doc_id
"""
INDEXED_MANIFEST_SQL = f"""{_RUNS}
SELECT doc_id, hash, n_chunks, CASE WHEN n = 'new' THEN 2 ELSE 1 END::BIGINT AS indexed_in
FROM live JOIN counts ON id = n || '|' || doc_id
"""
INDEXED_REPORT_SQL = f"""{_RUNS}
SELECT CASE WHEN status IN ('NEW', 'CHANGED') THEN 'LOADED' ELSE status END AS action, count(*) AS documents,
       sum(CASE WHEN status IN ('NEW', 'CHANGED') THEN a.n_chunks ELSE 0 END)::BIGINT AS chunks_added,
       sum(CASE WHEN status IN ('CHANGED', 'REMOVED') THEN o.n_chunks ELSE 0 END)::BIGINT AS chunks_deleted
FROM diff LEFT JOIN counts a ON a.id = 'new|' || doc_id LEFT JOIN counts o ON o.id = 'old|' || doc_id
GROUP BY 1
"""


QUERIES = {
    "manifest_diff": (manifest_diff, DIFF_SQL),
    "removed_records": (removed_records, REMOVED_SQL),
    "updated_chunks": (updated_chunks, UPDATED_SQL),
    "chunk_id_lists": (chunk_id_lists, LISTS_SQL),
    "indexing_report": (indexing_report, REPORT_SQL),
    "chunk_metadata": (chunk_metadata, METADATA_SQL),
    "document_chunks": (document_chunks, CHUNKS_SQL),
    "measured_chunks": (measured_chunks, MEASURED_SQL),
    "content_hashes": (content_hashes, HASHES_SQL),
    "document_records": (document_records, RECORDS_SQL),
    "upload_triage": (upload_triage, TRIAGE_SQL),
    "document_listing": (document_listing, LISTING_SQL),
    "indexed_chunks": (indexed_chunks, INDEXED_CHUNKS_SQL),
    "indexed_manifest": (indexed_manifest, INDEXED_MANIFEST_SQL),
    "indexed_report": (indexed_report, INDEXED_REPORT_SQL),
}
