"""Personal data by weak supervision; DataFrame and SQL functions only.

Patterns propose spans.  Five labelers vote on each: its form, a gazetteer, the words
before it, its neighbours, and its variety of characters.  Expectation-maximisation
over the counts of vote patterns estimates how often each labeler is right, and a
logistic classifier of the votes and the kind is trained on the posteriors.  Spans of
the base kinds that pass their check always stay; the classifier decides about the
further kinds.  The vote patterns are at most 2^5 for each kind, so both trainings are
expressions over one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.session import cut_lineage

BASE = ("email", "ip", "card", "phone")
#: Kind, what a text must contain (a character, a pattern, or "" for a digit), and the pattern.  A lookbehind keeps the search linear: a match
#: starts where a run of its first class starts, or where the match before ended.
PATTERNS = (
    ("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", ".", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"),
    ("card", "", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("local", "", r"(?<![0-9A-Za-z+.(-])(?<!\+[0-9]{1,3}[ -])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z-])"),
    ("national", "-", r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("hidden", r"[(\[<][Aa][Tt][)\]>]", r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{1,64} ?(?:\(at\)|\[at\]|<at>) ?[a-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|<dot>|\.) ?[a-z0-9-]{1,63}){1,4}"),
    ("person", ".", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. ?[A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30}){0,2}"),
)
KINDS = tuple(kind for kind, _, _ in PATTERNS)
#: Of each kind: what its gazetteer lists, and the words that announce it.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$",
    "ip": r"^(?!0|127\.|255\.)", "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "local": r"^\(?[2-9][0-9]{2}", "national": r"^(?!000|666|9)",
    "hidden": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$",
    "person": r" (?:James|John|Mary|Anna|Maria|Peter|Paul|Michael|David|Sarah|Laura|Jean|Marie|Hans|Karl|Jose|Juan|Carmen)\b",
}
CUES = {
    "email": r"mail|contact|write|reach", "hidden": r"mail|contact|write|reach",
    "ip": r"\bip\b|host|server|address|from", "card": r"card|visa|master|pay|credit|account",
    "phone": r"phone|tel|call|mobile|fax|contact", "local": r"phone|tel|call|mobile|fax|contact",
    "national": r"ssn|social|security|tax|identity", "person": r"name|by|from|dear|patient|contact",
}
VOTES, ROUNDS, STEPS, RATE = 5, 25, 300, 2.0
#: Characters of text before a span that the context labeler reads.
CONTEXT = 40


def _by_kind(kind: Column, rules: dict[str, Column]) -> Column:
    out = F.lit(False)
    for name, rule in rules.items():
        out = F.when(kind == name, rule).otherwise(out)
    return out


def _valid() -> Column:
    """Whether a base match passes its check."""
    kind, match = F.col("kind"), F.col("match")
    digits = F.regexp_replace(match, "[^0-9]", "")
    small = F.forall(F.split(match, r"\."), lambda p: (
        (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)))
    return _by_kind(kind, {
        "email": F.lit(True), "ip": small,
        "card": F.length(digits).between(16, 19) & F.expr("luhn_check(regexp_replace(match, '[^0-9]', ''))"),
        "phone": F.length(digits).between(8, 15)})


def candidate_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, kind, start, end, match, valid`` and the votes of every match.

    The pieces between the matches of a pattern give the places, in code points; only
    the matches and some characters around them leave the scan.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("text"))
    rows = rows.select("*", *(
        F.when(F.contains("text", F.lit(need)) if len(need) == 1 else F.col("text").rlike(need or "[0-9]"),
               F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(f"m_{kind}")
        for kind, need, pattern in PATTERNS))
    found = F.array(*(F.struct(
        F.lit(kind).alias("kind"), F.col(f"m_{kind}").alias("m"),
        F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)).alias("p")) for kind, _, pattern in PATTERNS))
    rows = rows.where(" OR ".join(f"size(m_{kind}) > 0" for kind in KINDS)).select("doc_id", "text_hash", F.inline(found))
    rows = rows.where("size(m) > 0").select("doc_id", "text_hash", "kind", F.posexplode(F.arrays_zip(
        F.col("m").alias("match"), F.transform(F.col("p"), lambda x: F.length(x)).alias("gap"),
        F.transform(F.col("p"), lambda x: F.right(x, F.lit(CONTEXT))).alias("before"),
        F.expr("transform(slice(p, 2, size(p)), x -> left(x, 1))").alias("after"))).alias("i", "z"))
    rows = rows.where("z.match is not null").select(
        "doc_id", "text_hash", "kind", "i", "z.match", "z.gap", "z.before", "z.after").dropDuplicates(
        ["doc_id", "text_hash", "kind", "i"])
    rows = rows.selectExpr("*", """cast(sum(gap + length(match)) over (
        partition by doc_id, text_hash, kind order by i) as bigint) as end""")
    kind, match = F.col("kind"), F.col("match")
    votes = (
        (_valid() | ~kind.isin(*BASE)),
        _by_kind(kind, {k: match.rlike(p) for k, p in GAZETTEER.items()}),
        _by_kind(kind, {k: F.lower("before").rlike(p) for k, p in CUES.items()}),
        ~F.col("before").rlike("[A-Za-z0-9_]$") & ~F.coalesce("after", F.lit("")).rlike("^[A-Za-z0-9_]"),
        F.size(F.array_distinct(F.split(match, ""))) >= 5,
    )
    return rows.select(
        "doc_id", "text_hash", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match",
        (kind.isin(*BASE) & _valid()).alias("valid"),
        F.array(*(F.coalesce(v, F.lit(False)).cast("double") for v in votes)).alias("votes"))


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def vote_model(spans: DataFrame) -> DataFrame:
    """``kind, votes, posterior, probability`` of every vote pattern that occurs.

    Expectation-maximisation starts from labelers that are right in four of five
    cases; the classifier starts from zero weights.
    """
    one_hot = F.array(*((F.col("kind") == k).cast("double") for k in KINDS))
    patterns = (spans.groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n"))
                .select("kind", "votes", "n", F.concat("votes", one_hot, F.array(F.lit(1.0))).alias("x")))
    table = patterns.agg(F.sort_array(F.collect_list(F.struct("kind", "votes", "n", "x"))).alias("t"))

    def product(rates: str) -> str:
        return (f"aggregate(zip_with(p.votes, {rates}, (v, q) -> if(v > 0, q, 1 - q)), 1D, (m, q) -> m * q)")

    posterior = _let(f"s.pi * {product('s.a')}", "u", f"u / (u + (1 - s.pi) * {product('s.b')})")
    total = "aggregate(t, 0D, (m, p) -> m + p.n)"

    def rate(weight: str) -> str:
        return (f"transform(sequence(0, {VOTES - 1}), j -> (1 + aggregate(r, 0D, (m, y) -> m + y.n * {weight} * y.votes[j]))"
                f" / (2 + aggregate(r, 0D, (m, y) -> m + y.n * {weight})))")

    m_step = (f"named_struct('pi', (1 + aggregate(r, 0D, (m, y) -> m + y.n * y.r)) / (2 + {total}), "
              f"'a', {rate('y.r')}, 'b', {rate('(1 - y.r)')})")
    em = (f"aggregate(sequence(1, {ROUNDS}), named_struct('pi', 0.5D, 'a', array_repeat(0.8D, {VOTES}), "
          f"'b', array_repeat(0.2D, {VOTES})), (s, _i) -> "
          + _let(f"transform(t, p -> named_struct('n', p.n, 'votes', p.votes, 'r', {posterior}))", "r", m_step) + ")")
    width = VOTES + len(KINDS) + 1
    score = "1 / (1 + exp(-aggregate(zip_with(w, y.x, (c, v) -> c * v), 0D, (m, q) -> m + q)))"
    gradient = (f"transform(sequence(0, {width - 1}), j -> "
                f"0.01D * w[j] / ({total} + 1) + aggregate(e, 0D, (m, y) -> m + y.n * y.d * y.x[j]) / ({total} + 1))")
    train = (f"aggregate(sequence(1, {STEPS}), array_repeat(0D, {width}), (w, _i) -> "
             + _let(f"transform(g, y -> named_struct('n', y.n, 'x', y.x, 'd', {score} - y.r))", "e",
                    f"zip_with(w, {gradient}, (c, v) -> c - {RATE}D * v)") + ")")
    return (table.selectExpr("t", f"{em} as s")
            .selectExpr("t", f"transform(t, p -> named_struct('kind', p.kind, 'votes', p.votes, 'n', p.n, 'x', p.x, 'r', {posterior})) as g")
            .selectExpr("t", "g", f"{train} as w")
            .selectExpr(f"inline(transform(g, y -> named_struct('kind', y.kind, 'votes', y.votes, 'posterior', y.r, 'probability', {score})))"))


def find_spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, text_hash, kind, start, end, base`` of the personal data in ``docs``.

    The candidates are written once, as both the model and its use read them.
    """
    spans = cut_lineage(candidate_spans(docs))
    model = vote_model(spans).select("kind", "votes", "probability")  # at most 2^5 rows for each kind
    return (spans.join(F.broadcast(model), ["kind", "votes"])
            .where(F.when(F.col("kind").isin(*BASE), F.col("valid")).otherwise(F.col("probability") >= threshold))
            .select("doc_id", "text_hash", "kind", "start", "end", F.col("kind").isin(*BASE).alias("base")))


def _with_spans(docs: DataFrame, lists: DataFrame) -> DataFrame:
    lists = lists.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    return docs.join(lists, docs.doc_id.eqNullSafe(lists._id) & (docs.text_hash == lists._hash), "left").drop("_id", "_hash")


def pii_report(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, and all spans.

    Null and empty text have no span; repeated rows give repeated results; an empty
    table gives no row; other columns are ignored.
    """
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    lists = (find_spans(docs, threshold).withColumn("o", order)
             .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("o", "start", "end", "kind", "base"))).alias("s")))
    rows = _with_spans(docs.select("doc_id", F.xxhash64("text").alias("text_hash")), lists)
    rows = rows.withColumn("s", F.coalesce("s", F.array().cast("array<struct<o:bigint,start:bigint,end:bigint,kind:string,base:boolean>>")))
    listed = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    return rows.select(
        "doc_id", *(F.expr(f"cast(size(filter(s, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in BASE),
        F.expr("cast(size(filter(s, x -> not x.base)) as bigint)").alias("n_added"),
        F.sha2(F.expr(listed.format("filter(s, x -> x.base)")), 256).alias("base_sha256"),
        F.expr(listed.format("s")).alias("spans"))


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with each span of personal data replaced by its kind in brackets.

    Overlapping spans become one, named after the first.  Documents without spans and
    all other columns are unchanged.
    """
    lists = find_spans(docs, threshold).groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("s"))
    merged = F.expr("""aggregate(s, cast(array() as array<struct<start: bigint, end: bigint, kind: string>>), (a, x) ->
        if(size(a) > 0 and x.start < element_at(a, -1).end,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start,
                  'end', greatest(element_at(a, -1).end, x.end), 'kind', element_at(a, -1).kind))),
           concat(a, array(x))))""")
    text = F.expr("""concat(array_join(zip_with(m, concat(array(0L), m.end), (x, before) -> if(x is null, '', concat(
        substring(row.text, cast(before + 1 as int), cast(x.start - before as int)), '[', upper(x.kind), ']'))), ''),
        substring(row.text, cast(element_at(m, -1).end + 1 as int)))""")
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"))
    rows = _with_spans(keyed, lists).withColumn("m", merged)
    return rows.select(F.when(F.size("m") > 0, F.col("row").withField("text", text)).otherwise(F.col("row")).alias("row")).select("row.*")
