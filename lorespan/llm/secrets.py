"""Secret scans through a trigram inverted index.

Each rule is a regular expression over UTF-8 bytes.  From its syntax tree follows a
Boolean query of trigrams that every match must hold; the postings of those trigrams
are intersected and united, and only the documents left are searched with the rule.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass
from re import _constants as kinds
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorespan.llm.textarrays import row_slices, utf8

#: A choice of more strings than this is left open by the trigram query.
MOST_STRINGS = 64
#: Bytes of the documents that are indexed together.
SEGMENT_BYTES = 8 * 1024 * 1024


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 1
    base: bool = False

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern.encode(), re.IGNORECASE if self.ignore_case else 0)


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         ignore_case=True, group=2, least=6, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", r"[0-9a-f]+", least=24, base=True),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat", r"xox[abeprs]-[A-Za-z0-9-]+", least=15),
    Rule("maps", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("claims", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("login", r"://[A-Za-z0-9._~%-]{1,64}:[A-Za-z0-9._~%!$&*+=-]{1,128}@[A-Za-z0-9-]"),
)


def _strings(strings: set[str]):
    """The query of texts that hold one of these strings."""
    choices = []
    for s in sorted(strings):
        if len(s) < 3:
            return True
        choices.append(("and", tuple(sorted({s[i:i + 3] for i in range(len(s) - 2)}))))
    return ("or", tuple(choices))


def _both(a, b):
    return b if a is True else a if b is True else ("and", (a, b))


def _analyse(nodes) -> tuple[set[str] | None, object]:
    """The strings that a node list can match, or None, and the query of its matches."""
    strings, query, whole = {""}, True, True

    def flush():
        nonlocal strings, query, whole
        query, strings, whole = _both(query, _strings(strings)), {""}, False

    for op, value in nodes:
        more, inner = None, True
        if op is kinds.LITERAL:
            more = {chr(value).lower()}
        elif op is kinds.IN and all(k in (kinds.LITERAL, kinds.RANGE) for k, _ in value):
            some = {chr(c).lower() for k, v in value
                    for c in ([v] if k is kinds.LITERAL else range(v[0], min(v[1], v[0] + MOST_STRINGS) + 1))}
            more = some if len(some) <= 8 else None
        elif op is kinds.SUBPATTERN:
            more, inner = _analyse(value[-1])
        elif op is kinds.BRANCH:
            parts = [_analyse(branch) for branch in value[1]]
            if all(s is not None for s, _ in parts):
                more = set().union(*(s for s, _ in parts))
            else:
                queries = [q if s is None else _both(q, _strings(s)) for s, q in parts]
                inner = True if True in queries else ("or", tuple(queries))
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            low, high, body = value
            some, sub = _analyse(body)
            if some is not None and (low, high) == (0, 1):
                more = some | {""}
            elif some is not None and low == high and low <= 8 and len(some) ** low <= MOST_STRINGS:
                more = {"".join(p) for p in itertools.product(some, repeat=low)}
            elif low:
                inner = sub if some is None else _both(sub, _strings(some))
        elif op is kinds.AT:
            more = {""}
        if more is None or len(strings) * len(more) > MOST_STRINGS:
            flush()
            if more is not None and len(more) <= MOST_STRINGS:
                strings = more
            query = _both(query, inner)
        else:
            strings = {a + b for a in strings for b in more}
            query = _both(query, inner)
    if whole:
        return strings, query
    return None, _both(query, _strings(strings))


def trigram_query(pattern: str):
    """True (any document) or nested ``("and" | "or", parts)`` of lower-case trigrams."""
    strings, query = _analyse(parser.parse(pattern))
    return query if strings is None else _both(query, _strings(strings))


def trigrams_in(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1]))


def candidates(query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    """The documents that satisfy a query, from sorted postings."""
    if query is True or isinstance(query, str) and not query.isascii():  # not indexed
        return np.arange(n)
    if isinstance(query, str):
        return postings.get(query, np.zeros(0, np.int64))
    parts = [candidates(q, postings, n) for q in query[1]]
    join = np.intersect1d if query[0] == "and" else np.union1d
    out = parts[0]
    for part in parts[1:]:
        out = join(out, part)
    return out


class TrigramIndex:
    """Postings of the trigrams that a set of rules asks for."""

    FOLD = np.arange(256, dtype=np.uint32)
    FOLD[65:91] += 32

    def __init__(self, trigrams: set[str]):
        self.names = sorted(t for t in trigrams if t.isascii())
        self.slots = np.zeros(1 << 24, np.uint8 if len(self.names) < 255 else np.uint16)
        for i, t in enumerate(self.names):
            a, b, c = t.encode()
            self.slots[a << 16 | b << 8 | c] = i + 1

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        found = []
        for a in range(0, max(0, len(data) - 2), 1 << 20):
            part = self.FOLD[data[a:a + (1 << 20) + 2]]
            slot = self.slots[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            at = np.flatnonzero(slot)
            found.append(np.stack([slot[at].astype(np.int64) - 1, at + a]))
        if not found:
            return {}
        slot, at = np.concatenate(found, axis=1)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        pairs = np.unique(slot[inside] * len(offsets) + row[inside])
        slot, row = pairs // len(offsets), pairs % len(offsets)
        cuts = np.flatnonzero(np.diff(slot)) + 1
        return {self.names[s[0]]: r for s, r in zip(np.split(slot, cuts), np.split(row, cuts)) if len(s)}


_INDEXES: dict[tuple[Rule, ...], tuple] = {}


def _prepared(rules: tuple[Rule, ...]):
    if rules not in _INDEXES:
        queries = [trigram_query(rule.pattern) for rule in rules]
        index = TrigramIndex(set().union(*map(trigrams_in, queries)))
        # Of a repeated class only runs of the least length can pass, so the search skips shorter ones.
        regexes = [re.compile(re.sub(rb"^(\[[^\]]+\])\+$", rb"\1{%d,}" % rule.least, rule.pattern.encode()),
                              re.IGNORECASE if rule.ignore_case else 0) for rule in rules]
        _INDEXES[rules] = queries, index, regexes
    return _INDEXES[rules]


def scan(data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...] = RULES) -> dict[int, list[tuple[int, int, int]]]:
    """``(start, rule, end)`` in code points of each match, by row that has any."""
    queries, index, regexes = _prepared(rules)
    postings, buffer = index.postings(data, offsets), data.tobytes()
    rows: dict[int, list[tuple[int, int, int]]] = {}
    for r, (rule, query, regex) in enumerate(zip(rules, queries, regexes)):
        for row in candidates(query, postings, len(offsets) - 1).tolist():
            a, b = int(offsets[row]), int(offsets[row + 1])
            for m in regex.finditer(buffer, a, b):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    rows.setdefault(row, []).append((m.start() - a, r, m.end() - a))
    for row, spans in rows.items():
        begins = (data[offsets[row]:offsets[row + 1]] & 0xC0) != 0x80
        place = np.concatenate([[0], np.cumsum(begins)])
        rows[row] = sorted((int(place[s]), r, int(place[e])) for s, r, e in spans)
    return rows


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, and all spans.

    Each task indexes what it reads, segment by segment, so nothing is shuffled.
    Null and empty text have no span; a null ``doc_id`` stays null; repeated rows
    give repeated results; other columns are ignored; an empty table gives no row.
    """
    base = [i for i, rule in enumerate(rules) if rule.base]
    names = [f"n_{rules[i].kind}" for i in base]
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", n_added long, base_sha256 string, spans string"

    def listed(spans):
        return ",".join(f"{rules[r].kind}:{s}:{e}" for s, r, e in spans)

    def run(batches):
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n = batch.num_rows
            counts = np.zeros((len(rules), n), np.int64)
            digests, texts = [nothing] * n, [""] * n
            for a, b in row_slices(offsets, SEGMENT_BYTES):
                found = scan(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], rules)
                for row, spans in found.items():
                    for _, r, _ in spans:
                        counts[r, a + row] += 1
                    digests[a + row] = hashlib.sha256(listed([x for x in spans if rules[x[1]].base]).encode()).hexdigest()
                    texts[a + row] = listed(spans)
            added = counts.sum(axis=0) - counts[base].sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[i]) for i in base), pa.array(added),
                 pa.array(digests), pa.array(texts)],
                names=["doc_id", *names, "n_added", "base_sha256", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
