"""Cost-balanced packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import gc
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

LIMIT = 2048
END_ID = 1
#: Relative cost of a token and of a pair of tokens that attend to each other.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens that a task packs together; its memory is bounded by this and its longest document.
BUFFER_TOKENS = 4_000_000
#: Documents tokenised together: their words stay in the processor's cache.
GROUP_ROWS = 24
#: Words remembered by a worker; beyond this it starts anew.
CACHE_WORDS = 1_500_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


SIGNS = frozenset(".,;:!?")
BEYOND_LATIN_1 = re.compile("[^\0-\xff]").search


class Encoder:
    """Token ids as little-endian 32-bit integers.

    The tokenizer lower-cases, drops white space, and encodes each word (a run of
    letters, one digit, or a run of signs) by itself, so each distinct word is
    encoded once.  Words are told apart in Latin-1 texts, which no composition of
    characters changes; any other text, and one that may hold a special token, is
    encoded as a whole.
    """

    WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]"
                       "|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾\t-\r \x85\xa0]+").findall

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.seen: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        """Remember the ids of these chunks and of the words in them."""
        seen = self.seen
        words = [[c] if c.isalpha() else [c[:-1], c[-1]] if c[-1:] in SIGNS and c[:-1].isalpha() else self.WORDS(c)
                 for c in chunks]
        fresh = list({w for row in words for w in row if w not in seen})
        ids = np.array(self.tokenizer.encode(" ".join(fresh), add_special_tokens=False).ids, "<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(stops) != len(fresh):
            raise ValueError("the tokenizer does not encode words one by one")
        code, start = ids.tobytes(), 0
        for word, stop in zip(fresh, stops):
            seen[word] = code[4 * start:4 * stop]
            start = stop
        for chunk, row in zip(chunks, words):
            if row != [chunk]:
                seen[chunk] = b"".join([seen[w] for w in row])

    def encode(self, texts: list[str]) -> list[bytes]:
        seen = self.seen
        if len(seen) > CACHE_WORDS:
            seen.clear()
        plain = [not ("<|" in t or not t.isascii() and BEYOND_LATIN_1(t)) for t in texts]
        rows = [t.lower().replace("\n", " ").split(" ") if p else () for t, p in zip(texts, plain)]
        found = [list(map(seen.get, row)) for row in rows]
        gaps = [(i, j) for i, codes in enumerate(found) if None in codes for j, code in enumerate(codes) if code is None]
        if gaps:
            self._learn(list({rows[i][j] for i, j in gaps}))
            for i, j in gaps:
                found[i][j] = seen[rows[i][j]]
        out = [b"".join(codes) for codes in found]
        for i, p in enumerate(plain):
            if not p:
                ids = self.tokenizer.encode(texts[i], add_special_tokens=False).ids
                out[i] = np.array(ids, "<u4").tobytes()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(lengths: np.ndarray, limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents of these lengths.

    Whole sequences are cut off long documents first.  The rest goes in descending
    order of estimated attention cost, each to the sequence of the lowest cost so
    far among those with enough capacity left; where none has, the document is cut
    to fill the emptiest.  The sequences hold all tokens exactly: their number is
    the total over the limit, and what remains is held by sequences whose lengths
    are powers of two, which need no padding.
    """
    pieces, sequence = [], 0
    for d in np.flatnonzero(lengths >= limit):
        for start in range(0, int(lengths[d]) - limit + 1, limit):
            pieces.append((int(d), start, limit, sequence, 0))
            sequence += 1
    rest = lengths % limit
    total = int(rest.sum())
    tail = [1 << b for b in reversed(range(limit.bit_length())) if (total % limit) >> b & 1]
    room = np.array([limit] * (total // limit) + tail, np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    for d in np.argsort(-rest, kind="stable"):
        length, start = int(rest[d]), int(lengths[d] - rest[d])
        while length:
            fits = room >= length
            best = int(np.where(fits, cost, np.inf).argmin())
            if not fits[best]:
                best = int(room.argmax())
            part = min(length, int(room[best]))
            pieces.append((int(d), start, part, sequence + best, int(size[best] - room[best])))
            room[best] -= part
            cost[best] += LINEAR * part + QUADRATIC * part * part
            start, length = start + part, length - part
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """Pack every document (``doc_id``, ``text``); one row per piece.

    A task packs what it reads, in buffers of bounded size, so no text or token
    moves between machines and no sequence needs padding.  Null text is empty and
    has the end id alone; repeated rows are packed one by one; a null ``doc_id``
    stays null; other columns are ignored; an empty table gives no row.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encoder = encoder_of(tokenizer)
        base, used = TaskContext.get().partitionId() << 36, 0
        ids, codes, held = [], [], 0

        def flush():
            nonlocal used, ids, codes, held
            lengths = np.array([len(c) // 4 for c in codes], np.int64)
            pieces = pack(lengths, limit)
            d, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces))
            crc = [zlib.crc32(memoryview(codes[i])[4 * s:4 * (s + n)]) for i, s, n, *_ in pieces]
            sequence += base + used
            used = int(sequence.max()) - base + 1
            out = pa.table([pa.array([ids[i] for i in d], pa.int64()), pa.array(start), pa.array(length),
                            pa.array(crc, pa.int64()), pa.array(lengths[d]), pa.array(sequence),
                            pa.array(offset)],
                           names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            ids, codes, held = [], [], 0
            return out.to_batches(max_chunksize=20_000)

        # The many small objects hold no cycles, so the collector would only walk them again and again.
        gc.disable()
        try:
            for batch in batches:
                for a in range(0, batch.num_rows, GROUP_ROWS):
                    part = batch.slice(a, GROUP_ROWS)
                    made = [c + end for c in encoder.encode([t or "" for t in part.column(1).to_pylist()])]
                    ids += part.column(0).to_pylist()
                    codes += made
                    held += sum(map(len, made)) // 4
                    if held >= BUFFER_TOKENS:
                        yield from flush()
            if codes:
                yield from flush()
        finally:
            gc.enable()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
