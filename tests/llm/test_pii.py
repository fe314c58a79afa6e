import hashlib
import random
import re

from pyspark.sql import functions as F

from lorespan.llm.pii import BASE, KINDS, candidate_spans, pii_report, redact, vote_model

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in zip(BASE, (EMAIL, IP, CARD, PHONE)):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def samples():
    rnd = random.Random(2)
    bits = ["a.b@c.de", "x@y", "@", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0000255.1.1.1", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "4111111111111111", "1", "+1 (743) 555-3824", "+12", "+123456789", "é", "\U0001f600", " ", "\n", "mail ",
            "call 555-123-4567", "(212) 555-0100", "123-45-6789", "jo [at] x [dot] org", "Dr. Mary Poe", "v", "-", "."]
    rows = [None, "", "9" * 3000, "a." * 2000 + "@x.y", "1." * 3000, "+" + "1 " * 2000, "mail a.b@c.de " * 400]
    return rows + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 14))) for _ in range(400)]


def test_base_spans_against_brute_force(spark):
    rows = list(enumerate(samples())) + [(3, "again a@b.cd"), (3, "again a@b.cd"), (None, "a@b.cd")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, start int, kind string")
    got = pii_report(df).collect()
    want = sorted((repr(i), ",".join(base_spans(t))) for i, t in rows)
    kept = sorted((repr(r.doc_id), ",".join(s for s in r.spans.split(",") if s.split(":")[0] in BASE)) for r in got)
    assert kept == want
    texts = dict(rows[:-3])
    for r in got:
        if r.doc_id is not None and r.doc_id != 3:
            spans = base_spans(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k + ":") for s in spans) for k in BASE)
    assert any(r.n_added for r in got)
    assert pii_report(df.limit(0)).count() == 0


def test_expectation_maximisation_finds_the_reliable_votes(spark):
    rnd, rows = random.Random(4), []
    for i in range(4000):
        good = rnd.random() < .4
        votes = [float(rnd.random() < (p if good else q)) for p, q in ((.9, .1), (.85, .2), (.8, .15), (.5, .5), (.9, .3))]
        rows.append((rnd.choice(KINDS[4:]), votes, good))
    df = spark.createDataFrame(rows, "kind string, votes array<double>, good boolean")
    model = vote_model(df)
    judged = df.join(F.broadcast(model), ["kind", "votes"])
    right = judged.select(F.avg(((F.col("probability") >= .5) == F.col("good")).cast("double")),
                          F.avg(((F.col("posterior") >= .5) == F.col("good")).cast("double"))).first()
    assert right[0] > .9 and right[1] > .9


def test_plan_is_native_and_redaction_keeps_the_rest(spark):
    rows = [(1, "mail a.b@c.de now, or call +1 (743) 555-3824.", "x", 2), (2, "nothing", "y", 3), (3, None, "z", None), (4, "é a@b.cd", "w", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, m int")
    out = redact(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {
        1: "mail [EMAIL] now, or call [PHONE].", 2: "nothing", 3: None, 4: "é [EMAIL]"}
    plan = candidate_spans(df)._jdf.queryExecution().executedPlan().toString() + pii_report(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_hidden_addresses_in_upper_case(spark):
    texts = ["JOHN [AT] EXAMPLE [DOT] COM", "jo <At> x <DOT> org", "JO (AT) X.ORG", "AT [A] T", "at"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.match) for r in candidate_spans(df).where("kind = 'hidden'").collect()}
    assert got == {(0, texts[0]), (1, texts[1]), (2, texts[2])}
