"""The chunker against a model that works on piece strings, and its properties."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespan.fixed_values import SEPARATORS
from lorespan.functions.splitter import split_text
from lorespan.operators.chunking import chunk

SIZE, OVERLAP = 40, 12


def pieces_of(text, sep):
    if not sep:
        return list(text)
    parts = text.split(sep)
    return [p for p in [parts[0]] + [sep + p for p in parts[1:]] if p]


def pack(pieces, size, overlap):
    out, held = [], []
    for piece in pieces:
        if held and len("".join(held)) + len(piece) > size:
            out.append("".join(held).strip())
            while held and (len("".join(held)) > overlap or len("".join(held)) + len(piece) > size):
                held = held[1:]
        held = held + [piece]
    return out + (["".join(held).strip()] if held else [])


def model(text, size=SIZE, overlap=OVERLAP, seps=SEPARATORS):
    which = next((i for i, s in enumerate(seps) if s in text), len(seps) - 1)
    sep, rest = seps[which], seps[which + 1:]
    out, short = [], []
    for piece in pieces_of(text, sep):
        if len(piece) < size:
            short.append(piece)
        else:
            out += pack(short, size, overlap)
            short = []
            out += model(piece, size, overlap, rest) if rest and sep else [piece]
    return [c for c in out + pack(short, size, overlap) if c]


WORDS = ["a", "bb", "lorem", "ipsum. ", "dolor! ", "sit; ", "\n", "\n\n", " ", "  ", ", ", ": ",
         "x" * 50, "中文字符", "😀😀", "\t", "? ", "。"]
texts = st.lists(st.sampled_from(WORDS), max_size=60).map("".join) | st.text(max_size=200)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_equals_model(text):
    assert split_text(text, SIZE, OVERLAP) == model(text)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_properties(text):
    chunks = split_text(text, SIZE, OVERLAP)
    assert all(0 < len(c) <= SIZE and c == c.strip() for c in chunks)
    if len(text) < SIZE:
        assert chunks == ([text.strip()] if text.strip() else [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.sampled_from([" ", "\n", "\n\n", "  "])), max_size=30))
def test_cover_and_overlap(shape):
    """With every letter different, the place of a chunk in the text is known."""
    letters = iter(range(0x4E00, 0x9FFF))
    text = "".join("".join(chr(next(letters)) for _ in range(n)) + gap for n, gap in shape)
    end = 0
    for c in split_text(text, SIZE, OVERLAP):
        start = text.index(c)
        assert not text[end:start].strip() and end - start <= OVERLAP and start + len(c) > end
        end = start + len(c)
    assert not text[end:].strip()


@pytest.mark.parametrize("text, sizes", [
    ("", []), (" \n ", []), ("short", [5]), ("w" * 800, [800]), ("w" * 2000, [800, 800, 640]),
    ("中" * 1000, [800, 320]), ("😀" * 801, [800, 121]),
])
def test_default_sizes(text, sizes):
    assert [len(c) for c in split_text(text)] == sizes


def test_long_random_text():
    rng = random.Random(5)
    text = "".join(rng.choice(WORDS) for _ in range(5_000))
    assert split_text(text, 800, 120) == model(text, 800, 120)


def test_other_length_function():
    words = split_text("one two three four five six", 4, 1, (" ", ""), lambda t: len(t.split()))
    assert words == ["one two three four", "four five six"]


def test_no_empty_separator_keeps_a_long_piece():
    assert split_text("aaaa bbbbbbbb", 5, 1, (" ",)) == model("aaaa bbbbbbbb", 5, 1, (" ",))


def test_chunk_rows(spark):
    docs = spark.createDataFrame(
        [("file:a", "h" * 64, "x" * 1000, "keep"), ("file:b", "g" * 64, None, "none"),
         ("file:c", "f" * 64, "  ", "blank")], "doc_id string, hash string, text string, tag string")
    rows = chunk(docs).orderBy("chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.chunk_id, len(r.text), r.tag) for r in rows] == [
        ("file:a", 0, "file:a:chunk:0:" + "h" * 12, 800, "keep"),
        ("file:a", 1, "file:a:chunk:1:" + "h" * 12, 320, "keep")]


def test_index_runs_across_parts(spark):
    docs = spark.createDataFrame(
        [("d", "h" * 64, p, "y" * n) for p, n in [(0, 1000), (1, 10), (2, 0), (3, 1600)]],
        "doc_id string, hash string, part_no int, text string")
    rows = chunk(docs).orderBy("chunk_index").collect()
    assert [(r.part_no, r.chunk_index) for r in rows] == [(0, 0), (0, 1), (1, 2), (3, 3), (3, 4), (3, 5)]


def test_overlap_must_be_smaller(spark):
    docs = spark.createDataFrame([("d", "h", "t")], "doc_id string, hash string, text string")
    with pytest.raises(ValueError):
        chunk(docs, size=10, overlap=10)
