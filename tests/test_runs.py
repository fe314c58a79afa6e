"""Indexing runs over folders, and the streaming jobs against their batch forms."""

import time

from pyspark.sql import functions as F

import pytest

from lorespan.operators.answers import split_thinking
from lorespan.operators.conversations import recent_messages, titles
from lorespan.plans.indexing import ChunkStore, index_corpus
from lorespan.plans.retrieval import answer_or_prompt, prompts_for
from lorespan.operators.querytext import dictionary_table
from lorespan.functions.embedding import with_vectors
from lorespan.sources.corpus import list_documents, scan_corpus
from lorespan.sources.snapshots import Snapshots
from lorespan.sources.stores import CACHE
from lorespan.streaming.cache import start_cache_stream
from lorespan.streaming.conversations import (
    current_messages, log_schema, start_conversation_stream,
)
from lorespan.streaming.indexing import start_indexing_stream
from lorespan.streaming.markers import marker_stream
from lorespan.streaming.sessions import session_stream


def report_of(report):
    return {r.action: (r.documents, r.chunks_added, r.chunks_deleted) for r in report.collect()}


def test_scan(spark, tmp_path):
    (tmp_path / "My_Doc.TXT").write_bytes("a\r\nb\rc\nd".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "pic.png").write_bytes(b"\x89PNG")
    (tmp_path / "xtxt").write_text("no dot")
    (tmp_path / "other.doc").write_text("not allowed")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "deep.txt").write_text("deeper")
    rows = {r.extra.filename: r for r in scan_corpus(spark, str(tmp_path)).collect()}
    assert set(rows) == {"My_Doc.TXT", "bad.txt", "pic.png"}
    doc = rows["My_Doc.TXT"]
    assert (doc.doc_id, doc.title, doc.text, doc.reason) == ("file:My_Doc.TXT", "My Doc", "a\nb\nc\nd", None)
    assert (doc.extra.extension, doc.extra.size_bytes, doc.source_type) == ("txt", 8, "local_file")
    assert (rows["bad.txt"].text, rows["bad.txt"].reason) == (None, "not valid UTF-8")
    assert rows["pic.png"].reason == "no loader for this type"
    loaded = scan_corpus(spark, str(tmp_path), loaders={"png": lambda p, c: F.lit("words")})
    assert {r.text for r in loaded.where("extra.extension = 'png'").collect()} == {"words"}
    listed = list_documents(spark, str(tmp_path)).collect()
    assert {r.name for r in listed} == set(rows)
    assert [r.modified for r in listed] == sorted((r.modified for r in listed), reverse=True)


def test_indexing_runs(spark, tmp_path):
    folder, store = tmp_path / "kb", ChunkStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    (folder / "one.txt").write_text("first " * 300)
    (folder / "two.txt").write_text("second")
    (folder / "blank.txt").write_text("  \n ")
    report, skipped = index_corpus(spark, str(folder), store, dim=16)
    assert report_of(report) == {"LOADED": (2, 4, 0), "SKIPPED": (1, 0, 0)}
    assert [tuple(r) for r in skipped.collect()] == [("file:blank.txt", "no chunks")]
    chunks = {r.chunk_id: r for r in store.current_chunks().collect()}
    assert len(chunks) == 4
    one = chunks[next(c for c in chunks if c.startswith("file:two.txt:chunk:0:"))]
    assert (one.text, one.title, one.source_url, one.filename, len(one.vec)) == ("second", "two", "", "two.txt", 16)

    report, _ = index_corpus(spark, str(folder), store, dim=16)
    assert report_of(report) == {"UNCHANGED": (2, 0, 0), "SKIPPED": (1, 0, 0)}
    assert store.current_chunks().count() == 4

    (folder / "one.txt").write_text("shorter now")
    (folder / "two.txt").unlink()
    (folder / "three.txt").write_text("third")
    report, _ = index_corpus(spark, str(folder), store, dim=16)
    assert report_of(report) == {"LOADED": (2, 2, 3), "REMOVED": (1, 0, 1), "SKIPPED": (1, 0, 0)}
    assert sorted(r.text for r in store.current_chunks().collect()) == ["shorter now", "third"]
    listed = {r.doc_id: r.chunk_ids for r in store.manifest.read().collect()}
    assert {k: len(v) for k, v in listed.items()} == {"file:one.txt": 1, "file:three.txt": 1}

    (folder / "one.txt").write_text("first " * 300)     # back to an earlier version
    index_corpus(spark, str(folder), store, dim=16)
    assert store.current_chunks().count() == 4
    slim = store.compact(str(tmp_path / "slim"))
    assert slim.chunks.read_all().count() == 4 < store.chunks.read_all().count()
    report, _ = index_corpus(spark, str(folder), slim, dim=16)
    assert report_of(report) == {"UNCHANGED": (2, 0, 0), "SKIPPED": (1, 0, 0)}


def test_unfinished_run_is_not_seen(spark, tmp_path):
    folder, store = tmp_path / "kb", ChunkStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    (folder / "one.txt").write_text("one")
    index_corpus(spark, str(folder), store, dim=8)
    # A run that died before its manifest: chunks and dead records of version 2 exist.
    store.chunks.publish(store.current_chunks(), 2)
    store.dead.publish(store.manifest.read(), 2)
    assert [r.text for r in store.current_chunks().collect()] == ["one"]
    (folder / "one.txt").write_text("two")
    index_corpus(spark, str(folder), store, dim=8)
    assert [r.text for r in store.current_chunks().collect()] == ["two"]


def test_indexing_stream(spark, tmp_path):
    folder, store = tmp_path / "kb", ChunkStore(spark, str(tmp_path / "store"))
    folder.mkdir()

    def run():
        start_indexing_stream(spark, str(folder), store, str(tmp_path / "check"), dim=8).awaitTermination()
        return sorted(r.text for r in store.current_chunks().collect())

    (folder / "a.txt").write_text("alpha")
    assert run() == ["alpha"]
    (folder / "b.txt").write_text("beta")
    (folder / "c.exe").write_text("never")
    assert run() == ["alpha", "beta"]
    assert run() == ["alpha", "beta"]


def test_conversation_stream_equals_batch(spark, tmp_path):
    schema = "conv_id string, turn long, role string, text string"
    rows = [("a", i, "user" if i % 2 == 0 else "assistant", f"a{i}") for i in range(12)] + \
           [("b", 0, "user", "b0"), ("b", 1, "assistant", " ")]
    batches = [rows[6:9] + rows[12:], rows[:6], rows[9:12]]        # late rows in the second batch
    log = Snapshots(spark, str(tmp_path / "log"), log_schema())
    for n, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        turns = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        start_conversation_stream(turns, log, str(tmp_path / "check"), keep=5).awaitTermination()
    spoken = spark.createDataFrame([r for r in rows if r[3].strip()], schema)
    want = sorted(map(tuple, recent_messages(spoken, 5).collect()))
    assert sorted(map(tuple, current_messages(log.read_all()).collect())) == want
    newest = {r.conv_id: r.title for r in log.read().collect()}
    assert newest["a"] == {r.conv_id: r.title for r in titles(spoken).collect()}["a"]


def test_marker_stream_equals_batch(spark, tmp_path):
    texts = {1: "__THINK__plan__ENDTHINK__Hello __THINK__ more __ENDTHINK__world_", 2: "no markers _ here__",
             3: "open __THINK__ never closed", 4: "__THINK__a__ENDTHINK____THINK__b__ENDTHINK__"}
    schema = "stream_id int, seq int, chunk string, last boolean"
    rows = []
    for key, text in texts.items():
        cuts = [text[i:i + 5] for i in range(0, len(text), 5)]
        rows += [(key, i, c, i == len(cuts) - 1) for i, c in enumerate(cuts)]
    rows.sort(key=lambda r: r[1])
    for part in (rows[:9], rows[9:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        chunks = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        (marker_stream(chunks).writeStream.format("parquet").trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / "check")).start(str(tmp_path / "out")).awaitTermination())
    parts = spark.read.parquet(str(tmp_path / "out")).orderBy("stream_id", "part").collect()
    whole = split_thinking(spark.createDataFrame(list(texts.items()), "stream_id int, text string")).collect()
    for row in whole:
        mine = [p for p in parts if p.stream_id == row.stream_id]
        assert [p.text for p in mine if p.kind == "step"] == row.steps
        assert "".join(p.text for p in mine if p.kind == "answer").strip() == row.answer


def test_sessions_expire(spark, tmp_path):
    schema = "token string, student_id string, created_at long"
    spark.createDataFrame([("t", "ann", int(time.time()))], schema).write.parquet(str(tmp_path / "in"))
    logins = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = (session_stream(logins, 3).writeStream.format("parquet").trigger(processingTime="1 second")
             .option("checkpointLocation", str(tmp_path / "check")).start(str(tmp_path / "out")))
    try:
        for _ in range(60):
            time.sleep(1)
            got = [r.event for r in spark.read.schema(
                "token string, student_id string, expires_at long, event string").parquet(str(tmp_path / "out")).collect()] \
                if (tmp_path / "out" / "_spark_metadata").exists() else []
            if "EXPIRED" in got:
                break
    finally:
        query.stop()
    assert sorted(got) == ["EXPIRED", "OPEN"]


def test_cache_stream(spark, tmp_path):
    schema = "arrival long, question string, answer string, created_at long"
    store = Snapshots(spark, str(tmp_path / "cache"), CACHE)
    for part in ([(1, "q1", "a1", 5), (2, "q2", "", 5)], [(3, "q3", "a3", 6), (4, "q4", "a4", 6)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        answers = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        start_cache_stream(answers, store, str(tmp_path / "check"), cap=2, dim=8).awaitTermination()
    rows = store.read().orderBy("seq").collect()
    assert [(r.seq, r.question, len(r.vec)) for r in rows] == [(2, "q3", 8), (3, "q4", 8)]


def test_cache_stream_keeps_few_versions(spark, tmp_path):
    schema = "arrival long, question string, answer string, created_at long"
    store = Snapshots(spark, str(tmp_path / "cache"), CACHE)
    with pytest.raises(ValueError):
        start_cache_stream(spark.readStream.schema(schema).parquet(str(tmp_path)), store, str(tmp_path / "c"), keep=1)
    for i in range(5):
        spark.createDataFrame([(i, f"q{i}", "a", i)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        answers = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        start_cache_stream(answers, store, str(tmp_path / "check"), cap=3, dim=4, keep=2).awaitTermination()
    assert store.versions() == [4, 5]
    assert sorted(r.question for r in store.read().collect()) == ["q2", "q3", "q4"]


def test_passages_of_many_hits(spark, monkeypatch):
    """The same rows whether hits, or their ids, are measured as small or not."""
    from lorespan.operators import retrieval

    hits = spark.createDataFrame([(q, f"p{q % 7}", 0.5, 1) for q in range(60)], "query_id int, item_id string, score double, rank int")
    passages = spark.createDataFrame([(f"p{i}", f"text {i}") for i in range(12)], "item_id string, text string")
    want = sorted((q, f"p{q % 7}", f"text {q % 7}") for q in range(60))
    for answers in ([True], [False, True], [False, False]):
        left = iter(answers)
        monkeypatch.setattr(retrieval, "is_small", lambda df: next(left))
        got = retrieval.with_text(hits, passages)
        assert sorted((r.query_id, r.item_id, r.text) for r in got.collect()) == want


def test_questions_to_answers(spark):
    questions = spark.createDataFrame([(1, " green apples "), (2, "red bricks"), (3, "  ")], "query_id int, text string")
    entries = with_vectors(spark.createDataFrame([(1, "green apples", "cached", 100)],
                                                 "seq long, question string, answer string, created_at long"),
                           "question", dim=64)
    passages = spark.createDataFrame([("p1", "walls are made of red bricks"), ("p2", "rain"), ("p3", "green apples")],
                                     "item_id string, text string")
    words = dictionary_table(spark, [("brick", ["clay", "walls"])])
    hits, prompts = answer_or_prompt(questions, entries, passages, words, "{input}|{context}", 200,
                                     metadata=["item_id"], dim=64, k=1)
    assert [(r.query_id, r.answer) for r in hits.collect()] == [(1, "cached")]
    rows = prompts.collect()
    assert [r.query_id for r in rows] == [2]
    assert rows[0].prompt == 'red bricks|[Reference 1] Content: walls are made of red bricks | Metadata: {"item_id":"p1"}\n'
    nothing = passages.limit(0)
    empty = prompts_for(questions.where("query_id = 2"), nothing, words, "{input}|{context}", metadata=["item_id"], dim=64)
    assert [(r.n_refs, r.prompt) for r in empty.collect()] == [(0, "red bricks|")]
