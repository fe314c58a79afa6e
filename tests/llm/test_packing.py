import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from lorespan.llm.packing import Encoder, pack, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def plain(encoder, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_tokenizer(encoder):
    rnd = random.Random(3)
    texts = ["", " \n ", "Don't, she'LL! 12ab É", "<|endoftext|>x", "ΑΣ áb", "a\x1cb\x85c", "x" * 3000]
    for _ in range(1500):
        texts.append("".join(chr(rnd.choice([rnd.randrange(256), rnd.randrange(128), 32, 39, 115])) for _ in range(rnd.randrange(40))))
    assert encoder.encode(texts) == plain(encoder, texts)
    assert encoder.encode(texts) == plain(encoder, texts)


def check(pieces, lengths, limit):
    seen, sequences = {}, {}
    for d, start, length, sequence, offset in pieces:
        assert length > 0
        seen.setdefault(d, []).append((start, length))
        sequences.setdefault(sequence, []).append((offset, length))
    for d, parts in seen.items():
        end = 0
        for start, length in sorted(parts):
            assert start == end
            end += length
        assert end == lengths[d]
    assert set(seen) == {d for d, n in enumerate(lengths) if n}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= limit and end & (end - 1) == 0  # no padding
    return sequences


def test_pack_covers_every_token():
    rnd = random.Random(1)
    for limit in (8, 64, 2048):
        lengths = np.array([rnd.randrange(1, 3 * limit) for _ in range(200)])
        check(pack(lengths, limit), lengths, limit)
    assert pack(np.array([5]), 8) and check(pack(np.array([5]), 8), [5], 8)


def test_pack_balances_cost():
    lengths = np.array([1024] * 8 + [64] * 128)
    sequences = check(pack(lengths, 2048), lengths, 2048)
    longs = [sum(n == 1024 for _, n in parts) for parts in sequences.values()]
    assert max(longs) - min(longs) <= 1


def test_documents(spark, encoder):
    rows = [(1, "Some text, again."), (1, "Some text, again."), (2, None), (None, "é"), (3, "word " * 5000)]
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, start int")
    out = pack_documents(df, PATH, 64).collect()
    ids = {a: b + np.array([1], "<u4").tobytes() for (a, _), b in zip(rows, plain(encoder, [t or "" for _, t in rows]))}
    for r in out:
        part = ids[r.doc_id][4 * r.start:4 * (r.start + r.length)]
        assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[r.doc_id]) // 4
    assert sum(r.length for r in out) == sum(len(ids[a]) // 4 for a, _ in rows)
    assert pack_documents(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        pack_documents(df, PATH, 100)
