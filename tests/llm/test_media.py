import hashlib
import zlib

import numpy as np
import pytest

from lorespan.llm import webp
from lorespan.llm.media import media_columns

rng = np.random.default_rng(0)


def images():
    for height, width in ((1, 1), (1, 16), (5, 7), (40, 33), (17, 16)):
        noise = rng.integers(0, 1 << 32, (height, width), dtype=np.uint64).astype(np.uint32)
        yield noise
        yield rng.integers(0, 3, (height, width)).astype(np.uint32) * np.uint32(0x01030507)
        yield np.zeros((height, width), np.uint32)
        yield np.repeat(noise[:, :1], width, axis=1)


@pytest.mark.parametrize("cache_bits", [0, 1, 7])
@pytest.mark.parametrize("transforms", [(), (webp.SUBTRACT_GREEN,), (webp.CROSS_COLOUR,), (webp.PALETTE,), (webp.PALETTE, webp.PREDICTOR),
                                        (webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN)])
def test_round_trip(transforms, cache_bits):
    for pixels in images():
        if webp.PALETTE in transforms and len(np.unique(pixels)) > 256:
            continue
        stream = webp.write_stream(pixels, transforms, cache_bits)
        assert np.array_equal(webp.decode_streams([stream])[0], pixels)


@pytest.mark.parametrize("mode", range(14))
def test_predictor_modes(mode):
    for pixels in images():
        stream = webp.write_stream(pixels, (webp.PREDICTOR,), block_bits=3, mode=mode)
        assert np.array_equal(webp.decode_streams([stream])[0], pixels)


def test_hand_made_stream_with_groups_and_a_far_copy():
    """Two prefix groups, and a copy whose distance names the pixel above."""
    w = webp.Writer()
    w.put(0x2F, 8), w.put(3, 14), w.put(1, 14), w.put(1, 1), w.put(0, 3)  # 4 x 2
    w.put(0, 1), w.put(0, 1)  # no transform, no cache
    w.put(1, 1), w.put(0, 3)  # groups in blocks of 4: one block
    w.put(0, 1)  # the map has no cache
    for symbol in (1, 0, 0, 0, 0):  # all of group 1
        w.code(np.bincount([symbol], minlength=280 if symbol else 256))
    for group in (0, 1):
        green = np.zeros(280, np.int64)
        green[[10 * group + 1, 10 * group + 2, 256 + 3]] = (1, 2, 2)
        w.code(green)
        for symbol in (20, 30, 255, 0):
            w.code(np.bincount([symbol], minlength=256)[:256] if symbol else np.bincount([0], minlength=40))
    codes = {11: (0, 1), 12: (1, 2), 259: (3, 2)}
    for g in (11, 12, 12, 11, 259):  # a copy of 4 pixels at distance code 1: the row above
        w.put(*codes[g])
    image = webp.decode_streams([w.bytes()])[0]
    row = [0xFF000000 | 20 << 16 | g << 8 | 30 for g in (11, 12, 12, 11)]
    assert image.tolist() == [row, row]


def test_damaged_streams_are_refused():
    with pytest.raises(ValueError):
        webp.read_file(b"no image")
    with pytest.raises(ValueError):
        webp.decode_streams([b"\x00\x00\x00\x00\x00"])
    with pytest.raises(ValueError):
        webp.code_table(np.array([1, 2, 0, 3]))


def test_code_lengths_are_complete_and_bounded():
    for counts in ([1, 1], [1 << i for i in range(30)], rng.integers(0, 50, 300)):
        lengths = webp.code_lengths(np.array(counts))
        used = lengths[lengths > 0]
        assert used.max() <= webp.MOST_BITS and (2.0 ** -used).sum() == 1


def test_media_columns(spark):
    texts = ["", None, "a", "x" * 64, "é" * 33, "Some text that says little. " * 40, "long " * 30_000, "Some text that says little. " * 40]
    df = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in media_columns(df, with_media=True).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (
            len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert webp.load_many([bytes(r.media)])[0][0] == payload
    assert rows[0][1:] == rows[1][1:] and rows[5][1:] == rows[7][1:]
    assert "frames=5" in rows[6].feature
    assert media_columns(df.limit(0)).count() == 0


def test_frames_choose_their_form():
    """Before, the cache and the transforms were written by tests alone; no frame is larger than without them."""
    import pyarrow.parquet as pq

    numbered = "".join(f"{i:05d} one line of text that repeats but for the number before it.\n"[:64] for i in range(300))
    greys = "".join(chr(32 + int(c)) * 4 for c in rng.integers(0, 90, 4000))
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist() + [numbered, greys]
    used = set()
    for text in texts:
        raw = (text or "").encode()[:webp.FRAME_BYTES]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        file = webp.store(payload)
        image = webp.read_stream(webp.read_file(file)[0])
        form = (*(t[0] for t in image.transforms), *("cache",) * bool(image.cache_bits))
        used |= set(form)
        if form and webp.PALETTE not in form:
            samples = np.frombuffer(payload, np.uint8).reshape(-1, 4)
            pixels = np.ascontiguousarray(samples[:, [2, 1, 0, 3]]).view(np.uint32).reshape(-1, webp.ROW_PIXELS)
            assert len(webp.read_file(file)[0]) <= len(webp.write_stream(pixels))
            assert webp.load_many([file])[0][0] == payload
    assert used >= {"cache", webp.PALETTE, webp.PREDICTOR, webp.SUBTRACT_GREEN}


def test_a_code_is_put_in_few_numbers_and_read_back():
    """Before, a code took 20 numbers for its head and one to three for each gap between symbols."""
    for size, most in ((256, 256), (280, 30), (344, 5), (344, 344), (40, 39)):
        counts = np.bincount(rng.integers(0, most, 60) * (size - 1) // max(most - 1, 1), minlength=size)
        lengths = webp.code_lengths(counts)
        writer = webp.Writer()
        writer.code(lengths)
        assert len(writer.values) <= np.count_nonzero(lengths) + 2
        for shift in range(8):
            bits = webp.Bits((int.from_bytes(writer.bytes(), "little") << shift).to_bytes(400, "little"), shift)
            assert np.array_equal(webp.read_code(bits, size), lengths) and bits.at - shift == sum(writer.sizes)


def test_code_lengths_are_those_of_a_heap():
    """Ties are broken by the place of the leaf or sum, so that files stay as they were."""
    import heapq

    for n in (2, 3, 17, 200):
        counts = rng.integers(1, 4 + n, n)
        heap, parent = [(int(w), i) for i, w in enumerate(counts)], {}
        heapq.heapify(heap)
        for node in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = node
            heapq.heappush(heap, (a + b, node))
        want = []
        for i in range(n):
            depth = 0
            while i in parent:
                i, depth = parent[i], depth + 1
            want.append(depth)
        if max(want) <= webp.MOST_BITS:
            assert webp.code_lengths(counts).tolist() == want
