import hashlib
import random
import re

from lorespan.llm.decontamination import remove_spans, scan_report

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), size)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                owners = windows.get(tuple(w[i:i + n]))
                if owners is not None:
                    hit |= set(range(i, i + n))
                    found |= {str(o) for o in owners if o is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def table(seed):
    rnd = random.Random(seed)
    voc = ["a", "B", "é", "ΑΣ", "Σ", "c1", "İ", "K", "d"]
    join = lambda n: "".join(rnd.choice(voc) + rnd.choice([" ", ", ", "\n", "'", "  "]) for _ in range(n))
    items = [(i, join(rnd.choice([0, 1, 2, 3, 5, 9, 10, 14, 30]))) for i in range(12)] + [(3, "x y z " * 4), (None, "q w e r t"), (99, None)]
    docs = [(i, join(rnd.randrange(40)) + (rnd.choice(items)[1] or "") + join(rnd.randrange(12))) for i in range(120)]
    return docs + [(None, items[5][1]), (7, None), (8, ""), (9, "x y z " * 40), (9, "x y z " * 40)], items


def test_against_brute_force(spark):
    for seed, size in ((0, 10), (1, 4), (2, 7)):
        docs, items = table(seed)
        df = spark.createDataFrame([(*d, 1, "u") for d in docs], "doc_id long, text string, start int, item_id string")
        bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
        got = scan_report(df, bench, size)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, size)
        assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert scan_report(docs, bench).first().contaminated is False
    assert scan_report(docs.limit(0), bench).count() == 0
    assert remove_spans(docs, bench).collect() == docs.collect()


def test_removed_spans(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before, {passage.upper()}! After.", "r", 1), (2, "untouched", "s", 2), (3, passage, "t", 3), (4, None, "u", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, spans int")
    out = remove_spans(df, spark.createDataFrame([(5, passage)], "item_id long, text string"))
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Before, After.", 2: "untouched", 4: None}
