import hashlib
import random
import re

from lorespan.llm.secrets import RULES, candidates, scan_secrets, trigram_query


def spans(text):
    out = []
    for r, rule in enumerate(RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII | (re.IGNORECASE if rule.ignore_case else 0)):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), r, m.end()))
    return sorted(out)


def texts():
    rnd = random.Random(7)
    bits = ["password", "PassWd", "api_key", "APIKEY", "token", " ", "=", ": ", "\"", "'", "abc123", "é", "\U0001f600", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef",
            "deadbeef" * 4, "ghp_" + "a1" * 20, "xoxb-1234567890-ab", "eyJabcdefgh.eyJabcdefgh.sig", "://u:p@h", "-----BEGIN RSA PRIVATE KEY-----", "\n"]
    return [None, "", "f" * 5000, "a" * 100_000] + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 12))) for _ in range(500)]


def test_against_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "token = abcdef"), (5, "token = abcdef"), (5, "token = abcdef")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, spans int")
    got = sorted(((repr(r.doc_id), r.spans, r.base_sha256, (r.n_assign, r.n_access, r.n_hex, r.n_added)) for r in scan_secrets(df).collect()))
    want = []
    for i, t in rows:
        s = spans(t)
        text = lambda x: ",".join(f"{RULES[r].kind}:{a}:{b}" for a, r, b in x)
        want.append((repr(i), text(s), hashlib.sha256(text([x for x in s if RULES[x[1]].base]).encode()).hexdigest(),
                     (*(sum(x[1] == k for x in s) for k in range(3)), sum(x[1] > 2 for x in s))))
    assert got == sorted(want)
    assert scan_secrets(df.limit(0)).count() == 0


def holds(query, text):
    if query is True:
        return True
    if isinstance(query, str):
        return query in text.lower()
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


def test_every_match_satisfies_its_query():
    cases = [(rule.pattern, re.IGNORECASE if rule.ignore_case else 0) for rule in RULES] + [
        (p, 0) for p in ("abc", "ab|cde", "(ab|cd)ef", "a?bcd", "(abc)+x", "(ab){2}", "x[ab]yz", "x[a-z]yz", "(a|b)*cde", "^abc$", "a.cdef", "(?:abc|de)fg", "abc(d|ef)?gh")]
    for pattern, flags in cases:
        query = trigram_query(pattern)
        found = 0
        for text in [t for t in texts() if t] + ["abc", "cde", "abef", "bcd", "abcabcx", "abab", "xayz", "xbyz", "cde", "aXcdef", "defg", "abcefgh", "abcgh"]:
            if re.search(pattern, text, flags):
                found += 1
                assert holds(query, text), (pattern, text)
    assert trigram_query("[0-9a-f]+") is True and candidates(True, {}, 2).tolist() == [0, 1]


def test_rule_with_other_letters(spark):
    from lorespan.llm.secrets import Rule

    df = spark.createDataFrame([(1, "x Schlüssel=abc12"), (2, "Schlussel=abc12"), (3, None)], "doc_id long, text string")
    rules = (Rule("key", "Schlüssel=[a-z0-9]+"), Rule("hex", "[0-9a-f]+", base=True))
    assert {r.doc_id: r.n_added for r in scan_secrets(df, rules).collect()} == {1: 1, 2: 0, 3: 0}
