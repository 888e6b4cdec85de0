"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is a column expression. A pattern's matches come from regexp_extract_all and
the text between them from split; running sums of their lengths are the positions, in
code points. Patterns are possessive and can only start where a run starts or the last
match ended, which gives the leftmost matches in linear time and without recursion on
long runs.

The base kinds are email, ip, card and phone; a base match that passes its check always
stays. The method adds iban (mod-97; lost to a word such as "sample" nearby, unless one
such as "account" is there too) and ssn (needs a context word) if their score is high
enough. Words are nearby if they lie within REACH code points and before the next match
of the kind. Spans of one kind don't overlap; those of different kinds may. Time is
linear in the text: no span looks for its place in the whole text.

Cases: null and empty texts have no spans; repeated rows are searched each; redact()
replaces spans that overlap by one mark, of the first that starts (the longer of two
that start together); other columns pass through detect() unless they have the names it
adds, or a kind's name after an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: What each kind looks like.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this holds no match.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": "\\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]{2}-[0-9]"}
#: Words near a span, within REACH code points on either side, that speak for its kind.
CONTEXT = {
    "email": r"e-?mail|mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": r"card|visa|credit|karte|tarjeta|carte|payment",
    "phone": r"phone|tel|call|fax|mobile|telefon|móvil",
    "iban": r"iban|bank|account|konto|cuenta|compte|transfer",
    "ssn": r"\bssn\b|social security",
}
REACH = 40
#: Words that speak against any kind.
AGAINST = r"\b(?:example|sample|test|dummy|beispiel|ejemplo|exemple)\b"
#: Score: pattern alone, a passed checksum, a context word, a word against. Added kinds need THRESHOLD.
PLAIN, CHECKED, NEARBY, DOUBT, THRESHOLD = 0.4, 0.4, 0.2, 0.3, 0.6
#: Elements in a block of running sums, and code points in a block of a text that is cut up.
BLOCK, PIECE = 256, 1024


def _running(lengths: Column, plus=lambda s, x: s + x) -> Column:
    """Sums (or what plus gives, from 0 on) of the elements before each element, in blocks: time is a block's size times the length."""

    def running(of: Column) -> Column:
        empty = F.array().cast("array<long>")
        start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("all"))
        return F.aggregate(of, start, lambda s, x: F.struct(plus(s["at"], x).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])

    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), plus))
    whole = F.flatten(F.zip_with(blocks, running(sums), lambda b, at: F.transform(running(b), lambda x: plus(x, at))))
    return F.when(n <= BLOCK, running(lengths)).otherwise(whole)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def _mod97(iban: Column) -> Column:
    """Whether an account number leaves 1 when divided by 97, its first four characters last and letters as 10 to 35."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return (F.length(plain).between(15, 34)) & (F.aggregate(values, F.lit(0), lambda r, v: F.when(v > 9, (r * 100 + v) % 97).otherwise((r * 10 + v) % 97)) == 1)


def _passes(kind: str, match: Column) -> Column:
    """The check of a match. A base match that fails is dropped."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, "\\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return _mod97(match)
    return F.lit(True)


def _check_of(kind: str):
    return lambda x: _passes(kind, x["m"])


def _score_of(kind: str):
    """Turns a match of a kind into a span with its score."""
    own = PLAIN + (CHECKED if kind in ("ip", "card", "phone", "iban") else 0.0)

    def span(x: Column) -> Column:
        near = F.lower(x["near"])
        score = F.lit(own) + F.when(near.rlike(CONTEXT[kind]), NEARBY).otherwise(0.0) - F.when(near.rlike(AGAINST), DOUBT).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.round(score, 3).alias("score"))

    return span


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with spans: array of (kind, start, end, score), by kind as in KINDS, then start. No shuffle; rows stay where they are."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs
    for kind in KINDS:
        has = body.rlike(NEEDS[kind])
        gaps = F.when(has, F.split(body, PATTERNS[kind], -1))
        found = F.when(has, F.regexp_extract_all(body, F.lit(PATTERNS[kind]), F.lit(0)))
        out = out.withColumns({"_gaps": gaps, "_found": found})
        # Each match with the text before it and after it up to the next ones.
        sides = F.zip_with(F.slice("_gaps", 1, F.size("_found")), F.slice("_gaps", 2, F.size("_found")), lambda g, h: F.struct(F.length(g).cast("long").alias("gap"), F.concat_ws(" ", F.right(g, F.lit(REACH)), F.left(h, F.lit(REACH))).alias("near")))
        out = out.withColumn(f"_{kind}", F.when(has, F.zip_with(sides, F.col("_found"), lambda g, m: F.struct(g["gap"].alias("gap"), g["near"].alias("near"), m.alias("m"))))).drop("_gaps", "_found")
        some = F.size(f"_{kind}") > 0
        # A column of its own: a lambda would compute an expression again for each element.
        out = out.withColumn("_lengths", F.transform(f"_{kind}", lambda x: x["gap"] + F.length(x["m"])))
        out = out.withColumn("_starts", F.when(some, _running(F.col("_lengths"))))
        starts = F.col("_starts")
        at = F.zip_with(F.col(f"_{kind}"), starts, lambda x, s: F.struct((s + x["gap"]).alias("start"), (s + x["gap"] + F.length(x["m"])).alias("end"), x["m"].alias("m"), x["near"].alias("near")))
        passed = F.filter(at, _check_of(kind))
        spans = F.transform(passed, _score_of(kind))
        if kind not in BASE:
            spans = F.filter(spans, lambda x: x["score"] >= THRESHOLD)
        out = out.withColumn(f"_{kind}", F.when(some, spans).otherwise(F.array().cast(SPAN)))
    return out.withColumn("spans", F.concat(*[F.col(f"_{k}") for k in KINDS])).drop("_lengths", "_starts", *[f"_{k}" for k in KINDS])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets."""
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    found = detect(docs, text).withColumn("_order", order).withColumn("_ends", F.transform("_order", lambda x: -x["end"]))
    ends = _running(F.col("_ends"), lambda s, x: F.greatest(s, x))
    # Where what came before ends; a span that starts earlier is part of that.
    with_ends = F.zip_with("_order", ends, lambda x, e: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), e.alias("after")))
    some = F.size("_order") > 0
    found = found.withColumn("_heads", F.when(some, F.filter(with_ends, lambda x: x["start"] >= x["after"])))
    found = found.withColumn("_last", F.array_max("_ends"))
    found = found.withColumn("_pieces", F.when(some, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    block = lambda at: F.floor(at / PIECE).cast("int")
    inside = lambda at: F.pmod(at, F.lit(PIECE)).cast("int")
    piece = lambda at: F.coalesce(F.get("_pieces", block(at)), F.lit(""))

    def between(a: Column, b: Column) -> Column:
        whole = F.array_join(F.slice("_pieces", block(a) + 2, block(b) - block(a) - 1), "")
        apart = F.concat(F.substr(piece(a), inside(a) + 1), whole, F.left(piece(b), inside(b)))
        return F.when(block(a) == block(b), F.substr(piece(a), inside(a) + 1, (b - a).cast("int"))).otherwise(apart)

    marked = F.transform("_heads", lambda x: F.concat(between(x["after"], x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    rest = F.concat(F.substr(piece(F.col("_last")), inside(F.col("_last")) + 1), F.array_join(F.slice("_pieces", block(F.col("_last")) + 2, F.size("_pieces")), ""))
    whole = F.concat(F.array_join(marked, ""), rest)
    return found.withColumn(text, F.when(some, whole).otherwise(F.col(text))).drop("spans", "_order", "_ends", "_heads", "_last", "_pieces")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_pii: counts and positions of every document's spans."""
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


#: The same in DuckDB, whose patterns always find leftmost matches in linear time.
ORACLE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def oracle() -> str:
    """DuckDB SQL for the base kinds. The added kinds need look-around, which DuckDB lacks, so on a table that holds such numbers the column spans has more in Spark."""
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(ltrim(p, '0') as bigint), 0) > 255)) = 0",
        "card": "length(d) between 13 and 19 and list_sum(list_transform(string_split(reverse(d), ''), lambda c, i: case when i % 2 = 1 then cast(c as int) when cast(c as int) > 4 then cast(c as int) * 2 - 9 else cast(c as int) * 2 end)) % 10 = 0",
        "phone": "length(d) between 9 and 15",
    }
    parts = []
    for rank, kind in enumerate(BASE):
        parts.append(f"""select r, {rank} as k, '{kind}' as kind, s, s + length(m) as e from (
  select r, m, regexp_replace(m, '[^0-9]', '', 'g') as d, cast(coalesce(list_sum(list_transform(gaps[:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) as bigint) as s
  from (select r, gaps, ms, unnest(range(1, len(ms) + 1)) as i, unnest(ms) as m from (
    select r, string_split_regex(t, '{ORACLE_PATTERNS[kind]}') as gaps, regexp_extract_all(t, '{ORACLE_PATTERNS[kind]}') as ms from d))) where {checks[kind]}""")
    return f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents), hits as ({' union all '.join(parts)}),
a as (select r, {', '.join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in BASE)}, string_agg(kind || ':' || s || ':' || e, ',' order by k, s) as spans from hits group by r)
select doc_id, {', '.join(f'coalesce(n_{k}, 0) as n_{k}' for k in BASE)}, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (r)"""
