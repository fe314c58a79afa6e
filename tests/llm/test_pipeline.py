"""Each stage of the pipeline against a brute-force version of it, on the smallest tables."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lorespan.llm.quality import quality_report
from lorespan.session import load_table
from tests.llm.test_decontamination import WORD, words
from tests.llm.test_jaccard_join import brute as brute_components
from tests.llm.test_pii import base_spans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, the input first."""
    docs = load_table(spark, DATA, "documents")
    out = [("documents", docs)]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def rows(stages, i):
    return {r.doc_id: r for r in stages[i][1].collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in stages[1:]] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    for _, df in stages[1:-1]:
        assert df.columns == stages[0][1].columns


def test_quality(spark, stages):
    kept = {r.doc_id for r in quality_report(stages[0][1], load_table(spark, DATA, "labels")).where("keep").collect()}
    assert set(rows(stages, 1)) == kept
    bad = {r.doc_id for r in load_table(spark, DATA, "labels").where("quality = 1").collect()} & set(rows(stages, 0)) - kept
    assert not bad


def test_near_duplicates(stages):
    before = [(r.doc_id, r.text) for r in rows(stages, 1).values()]
    assert set(rows(stages, 2)) == {i for i, _, c in brute_components(before, 5, 80) if i == c}


def test_one_row_of_each_group_stays(spark):
    """Null ids, repeated rows, and an id that two texts share."""
    def text(c, end=""):
        return " ".join(f"{c}{i}" for i in range(40)) + end

    docs = [(None, "", "k"), (None, "", "k"), (None, text("a"), "k"), (None, text("a", " x"), "k"),   # no id in the group
            (1, text("b"), "k"), (None, text("b", " x"), "k"),                                      # one with an id
            (2, text("c"), "k"), (2, text("c"), "k"), (2, text("c"), "l"),                           # repeated rows
            (3, text("d"), "k"), (3, text("e"), "k"), (2, text("e", " x"), "k"), (None, text("f"), "k"), (None, text("f"), "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, DATA).collect()]
    a = [r for r in got if r[0] is None and r[1].startswith("a0")]
    assert len(a) == 1
    assert sorted((r for r in got if r not in a), key=repr) == sorted([
        *docs[:2], docs[4], docs[6], docs[9], docs[11], docs[12]], key=repr)


def test_decontamination(spark, stages):
    windows = set()
    for r in load_table(spark, DATA, "benchmark").collect():
        w = words(r.text)
        n = min(len(w), 10)
        windows |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1 if n else 0)}
    want = {}
    for r in rows(stages, 2).values():
        w, hit = words(r.text), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
        text = r.text
        if hit and len(hit) < len(w):
            lower = re.sub("[A-Z]", lambda m: m.group().lower(), r.text)
            found = [m.span() for m in re.finditer(WORD, lower)]
            ends = [s for s, _ in found[1:]] + [len(text)]
            text = text[:found[0][0]] + "".join(text[s:e] for i, ((s, _), e) in enumerate(zip(found, ends)) if i not in hit)
        if not (hit and len(hit) == len(w)):
            want[r.doc_id] = (text, len(text))
    assert {i: (r.text, r.n_chars) for i, r in rows(stages, 3).items()} == want


def test_pii(stages):
    after = rows(stages, 4)
    for i, r in rows(stages, 3).items():
        spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in base_spans(r.text)))
        text, end = "", 0
        for a, b, kind in spans:
            if a >= end:
                text += r.text[end:a] + f"[{kind.upper()}]"
            end = max(end, b)
        assert after[i].text == text + r.text[end:] and after[i].n_chars == len(after[i].text)


def test_packing_and_run(spark, stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [1], "<u4") for i, r in rows(stages, 4).items()}
    total = 0
    for r in stages[5][1].collect():
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
        total += r.length
    assert total == sum(map(len, ids.values()))
    again = corpus_pipeline.run(spark, DATA).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in again} == {i: len(x) for i, x in ids.items()}
